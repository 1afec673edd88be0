"""A corpus pipeline of five operators: toxicity, exact and near de-duplication, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns
of documents, but for the last, which returns the mix: how much of each document it takes. run() writes each stage's rows as
Parquet to the shared folder and reads them again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import row_keyed, ship, stage, table, work_dir
from veilspark.llm.decontamination import leaks
from veilspark.llm.exact_dedup import DigestIndex, exact_dedup
from veilspark.llm.mixing import mixed_documents
from veilspark.llm.simhash import simhash_components
from veilspark.llm.toxicity import fit_toxicity, severity

#: The key of a row within a stage; doc_id may be null or repeated.
ROW = "_pipeline_row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted to the labelled rows, doesn't call toxic.

    Null and empty texts stay; repeated rows stay or go together; very long texts are scored whole; without labels all stay.
    """
    ship(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(~severity(model, F.col("text").cast("string"))["toxic"])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, the one with the smallest doc_id (a null one only where no row of the group has an id).

    Null and empty texts are equal texts, and repeated rows are copies; no rows give no rows.
    """
    rows = row_keyed(docs, ROW)
    found = exact_dedup(rows.select("doc_id", "text", ROW), DigestIndex(spark, work_dir(spark, "index")), ROW)
    return without(rows, found.filter("NOT kept").select(ROW)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays, the one with the smallest doc_id (a null one only where no row has an id).

    Null and empty texts have one fingerprint and are copies of each other, and so are repeated rows; no rows give no rows.
    """
    rows = row_keyed(docs, ROW)
    found = stage(simhash_components(rows, ROW).select(ROW, "doc_id", "component"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(ROW).alias("r"))
    first = found.groupBy("component").agg(F.min(order)["r"].alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # Only rows of components with several can go, and each of these but the first does.
    gone = found.join(first, "component").filter(F.col(ROW) != F.col("first"))
    return without(rows, gone.select(ROW)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark; null and empty texts contain none; repeated rows stay or go together."""
    rows = row_keyed(docs, ROW)
    return without(rows, leaks(rows, table(spark, sf_dir, "benchmark"), ROW).select(ROW).distinct()).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: doc_id, size, source_size, target, taken. Null and empty texts have size 0; repeated rows each give a row."""
    return mixed_documents(docs)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (see :func:`row_keyed`) without those whose key is in gone: few keys beside all texts.

    Spark broadcasts the keys below its own limit of size, and else joins by sorting both sides.
    """
    return rows.join(stage(gone, "dropped"), ROW, "left_anti")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The model, the fingerprints and the latent space are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
