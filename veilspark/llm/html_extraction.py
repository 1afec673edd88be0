"""Main-text extraction by a recurrent block labeller (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import ship, table
from veilspark.llm.html_blocks import blocks
from veilspark.llm.html_lstm import Features, probabilities, trained

AT_ONCE = 1024


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page: its main blocks, in order, joined by one space."""
    parsed = [[b for b in blocks(p) if not b.hidden] for p in pages]
    p = probabilities(trained(), Features(parsed)) if any(parsed) else np.zeros(0)
    out, k = [], 0
    for page in parsed:
        out.append(" ".join(b.text for b, x in zip(page, p[k : k + len(page)], strict=True) if x >= 0.5))
        k += len(page)
    return out


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), AT_ONCE):
            part = batch.slice(k, AT_ONCE)
            texts = main_texts(part.column(2).to_pylist())
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null or empty html, and pages without main text, give an empty text. Broken markup is read as far as it goes; repeated
    rows are extracted each; null ids and URLs stay null; other columns are ignored; no rows give no rows.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
