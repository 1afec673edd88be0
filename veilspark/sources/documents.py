"""Documents from files: one row per file (source_path, source_file, source_format, text), by extension.

Files come through Spark's binaryFile reader, so any store that Spark reads will do; office formats are parsed from the
bytes with the standard library in Arrow batches on the executors.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.cells import cell_string
from veilspark.plans.staging import ship

TEXT = ("txt", "md", "csv", "log")
FORMATS = {**dict.fromkeys(TEXT, "text"), "docx": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "pdf": "pdf", **dict.fromkeys(("png", "jpg", "jpeg", "tiff", "bmp", "gif"), "image")}
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "source_path string, sheet_no int, sheet string, row int, col int, raw string, kind string, is_formula boolean"


def files(spark: SparkSession, path: str) -> DataFrame:
    """source_path, source_file, ext, source_format (null if unknown) and content of every file under path."""
    ship(spark)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[ext]
    return f.select(F.col("path").alias("source_path"), name.alias("source_file"), ext.alias("ext"), kind.alias("source_format"), "content")


def paragraph_text(p: ElementTree.Element) -> str:
    return "".join(x.text or "" if x.tag == W + "t" else "\t" if x.tag == W + "tab" else "\n" if x.tag in (W + "br", W + "cr") else "" for x in p.iter())


def docx_text(content: bytes, with_margins: bool = False) -> str:
    """Body paragraphs that aren't blank, then each table's rows with their cells joined by " | "; with_margins adds headers and footers."""
    lines: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        lines += [t for p in body.findall(W + "p") if (t := paragraph_text(p)).strip()]
        for row in body.iterfind(f"{W}tbl/{W}tr"):
            cells = ["\n".join(map(paragraph_text, c.findall(W + "p"))).strip() for c in row.findall(W + "tc")]
            if any(cells):
                lines.append(" | ".join(c for c in cells if c))
        if with_margins:
            for name in sorted(n for n in z.namelist() if n.startswith(("word/header", "word/footer"))):
                lines += [t for p in ElementTree.fromstring(z.read(name)).iter(W + "p") if (t := paragraph_text(p)).strip()]
    return "\n".join(lines)


def column_number(ref: str) -> int:
    return reduce(lambda n, c: n * 26 + ord(c) - 64, (c for c in ref if c.isalpha()), 0)


def xlsx_cells(content: bytes) -> Iterator[tuple[str, int, int, str | None, str, bool]]:
    """(sheet, row, col, raw value, kind, is_formula) of every cell, in order; formulas have their cached value."""
    import datetime

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(S + "numFmt")}
            xfs = styles.find(S + "cellXfs")
            for xf in xfs if xfs is not None else ():
                k = int(xf.get("numFmtId", 0))
                dates.append(14 <= k <= 22 or any(c in custom.get(k, "").lower() for c in ("yy", "dd", "hh")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"):
            part = targets[sheet.get(R)].lstrip("/")
            root = ElementTree.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}"))
            for i, row in enumerate(root.iter(S + "row"), 1):
                for j, c in enumerate(row.findall(S + "c"), 1):
                    kind, v, formula = c.get("t", "n"), c.findtext(S + "v"), c.find(S + "f") is not None
                    r, col = int(row.get("r", i)), column_number(c.get("r", "")) or j
                    if kind == "inlineStr":
                        v, kind = "".join(t.text or "" for t in c.iter(S + "t")), "str"
                    elif v is None:
                        kind = "none"
                    elif kind == "s":
                        v, kind = shared[int(v)], "str"
                    elif kind == "b":
                        v, kind = ("true" if v == "1" else "false"), "bool"
                    elif kind == "n" and int(c.get("s", 0)) < len(dates) and dates[int(c.get("s", 0))]:
                        v, kind = (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(v))).isoformat(" ", "seconds"), "datetime"
                    elif kind == "n":
                        kind = "float" if "." in v or "e" in v.lower() else "int"
                    else:
                        kind = "str"
                    yield sheet.get("name"), r, col, v, kind, formula


def _docx(with_margins: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [docx_text(c.as_py(), with_margins) for c in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["source_path", "text"])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())
    names = ["source_path", "sheet_no", "sheet", "row", "col", "raw", "kind", "is_formula"]
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            order: dict[str, int] = {}
            rows = [(path, order.setdefault(c[0], len(order)), *c) for c in xlsx_cells(content.as_py())]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def text_documents(found: DataFrame) -> DataFrame:
    """Plain text; malformed UTF-8 becomes the replacement character."""
    return found.filter("source_format = 'text'").select("source_path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def docx_documents(found: DataFrame, with_margins: bool = False) -> DataFrame:
    return found.filter("source_format = 'docx'").select("source_path", "content").mapInArrow(_docx(with_margins), "source_path string, text string")


def cells(found: DataFrame) -> DataFrame:
    """(source_path, sheet_no, sheet, row, col, raw, kind, is_formula, value) of every cell of the workbooks; sheets are numbered in workbook order."""
    raw = found.filter("source_format = 'xlsx'").select("source_path", "content").mapInArrow(_cells, CELLS)
    return raw.withColumn("value", cell_string(F.col("raw"), F.col("kind")))


def sheet_texts(cell: DataFrame) -> DataFrame:
    """Workbooks as text: per sheet, in workbook order, a heading and its rows, cells joined by " | "; empty cells, rows and sheets left out."""
    full = cell.filter("value <> ''")
    rows = full.groupBy("source_path", "sheet", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), " | ").alias("line"))
    order = cell.groupBy("source_path", "sheet").agg(F.min("sheet_no").alias("no"))
    sheets = rows.groupBy("source_path", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    texts = sheets.join(order, ["source_path", "sheet"]).withColumn("text", F.concat(F.lit("=== "), F.col("sheet"), F.lit(" ===\n"), F.col("lines")))
    return texts.groupBy("source_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def needs(library: str, what: str):
    def fail(*_args, **_kwargs):
        raise RuntimeError(f"{what} need the optional package {library}, which isn't installed here")

    return fail


pdf_documents = needs("pdfplumber", "PDF files")
image_documents = needs("pytesseract", "images")


def documents(spark: SparkSession, path: str, with_margins: bool = False) -> DataFrame:
    """All files under path as documents. Files of unknown or unavailable formats raise ValueError, naming them."""
    found = files(spark, path)
    known = F.coalesce(F.col("source_format").isin("text", "docx", "xlsx"), F.lit(False))
    if odd := found.filter(~known).select("source_file").take(5):
        raise ValueError("no reader for " + ", ".join(r["source_file"] for r in odd))
    texts = text_documents(found).unionByName(docx_documents(found, with_margins)).unionByName(sheet_texts(cells(found)))
    return found.select("source_path", "source_file", "source_format").join(texts, "source_path", "left").withColumn("text", F.coalesce("text", F.lit("")))


def gold_cases(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases from JSON files; missing thresholds are recall .8, precision .5, F1 .6, and the mode label_text."""
    schema = "id string, description string, source string, source_type string, text string, match_mode string, min_recall double, min_precision double, min_f1 double, notes string, entities array<struct<label:string,text:string,start:int,end:int>>"
    g = spark.read.schema(schema).option("multiLine", "true").json(path)
    return g.na.fill({"match_mode": "label_text", "min_recall": 0.8, "min_precision": 0.5, "min_f1": 0.6})


def gold_spans(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("id").alias("case_id"), F.posexplode("entities").alias("i", "e")).select("case_id", "e.label", "e.text", "e.start", "e.end", "i")
