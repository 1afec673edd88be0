"""python -m veilspark INPUT [OUTPUT]: mask a file, or every file of a folder; OUTPUT is ./output by default.

For each file: {stem}_anonymized.txt and {stem}_report.json, and the masked workbook or Word file beside them. This is the
interactive form for files at hand; tables go through veilspark.plans.pipeline.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.labels import BY_NAME
from veilspark.plans.pipeline import cell_registrations, enrich_generic, process, with_report
from veilspark.sources import sinks
from veilspark.sources.documents import cells, documents, files


def workbook_mapping(spark: SparkSession, path: str, known: dict[str, str]) -> dict[str, str]:
    """A workbook's generic mapping with what its cells add."""
    found = cells(files(spark, path)).select(F.lit(1).cast("long").alias("doc_seq"), F.col("source_path").alias("source_file"), "value")
    mapping = spark.createDataFrame(list(known.items()), "original string, placeholder string")
    return {r["original"]: r["placeholder"] for r in enrich_generic(mapping, cell_registrations(found)).toLocalIterator()}


def write_one(spark: SparkSession, row: Row, top: Path, folder: Path) -> None:
    """The results of one document, in the place under folder that its source has under top, and a summary on the screen."""
    source = Path(unquote(urlparse(row["source_path"]).path))
    folder = folder / source.parent.relative_to(top) if source.parent.is_relative_to(top) else folder
    folder.mkdir(parents=True, exist_ok=True)
    name = lambda suffix, ending: folder / sinks.output_name(row["source_file"], suffix, ending)
    name("_anonymized", "txt").write_text(row["masked"], encoding="utf-8")
    name("_report", "json").write_text(json.dumps(json.loads(row["report"]), ensure_ascii=False, indent=2), encoding="utf-8")
    ending = source.suffix.lower().lstrip(".")
    if row["source_format"] == "xlsx":
        name("_anonymized", ending).write_bytes(sinks.xlsx_masked(source.read_bytes(), workbook_mapping(spark, str(source), row["mapping"])))
    elif row["source_format"] == "docx":
        name("_anonymized", ending).write_bytes(sinks.docx_masked(source.read_bytes(), row["mapping"]))
    print(f"{row['source_file']}: {row['total_entities']}")
    for label, n in row["stats"].items():
        print(f"  {BY_NAME[label].ru if label in BY_NAME else label}: {n}")


def main(args: list[str]) -> int:
    if not args or not Path(args[0]).exists():
        print(f"no such file: {args[0]}" if args else __doc__, file=sys.stderr)
        return 1
    source, folder = Path(args[0]).resolve(), Path(args[1] if len(args) > 1 else "output")
    spark = SparkSession.builder.appName("veilspark").getOrCreate()
    done = with_report(process(documents(spark, str(source))))
    for row in done.toLocalIterator():
        write_one(spark, row, source if source.is_dir() else source.parent, folder)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
