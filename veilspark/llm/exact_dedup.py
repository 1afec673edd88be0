"""Exact de-duplication against a persistent index of digests (operator 10, native).

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one
representative per digest, sort-merge anti-joined with the index, and what is new is
appended in the same bucketing, so the next batch meets sorted buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import SPACE, stage, text_or_empty, work_dir


class DigestIndex:
    """Digests seen so far, with the doc_id that keeps each: (digest binary, keep_id long).

    ``path`` is a folder on shared storage; a later session that names the same path and
    bucket count goes on with the same index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, reps: DataFrame) -> DataFrame:
        """Rows of reps (one per digest) whose digest the index lacks."""
        return reps.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, reps: DataFrame) -> None:
        """Add (digest, keep_id); the digests must be new. One task writes each bucket, in order."""
        rows = reps.select("digest", "keep_id").repartition(self.buckets, "digest")
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest: SHA-256 of the text with each run of ASCII white space as one space."""
    return docs.withColumn("digest", F.unhex(F.sha2(F.encode(F.regexp_replace(text_or_empty(text), f"{SPACE}+", " "), "UTF-8"), 256)))


def exact_dedup(docs: DataFrame, index: DigestIndex, key: str | None = None) -> DataFrame:
    """De-duplicate a batch (doc_id, text) against the index and within itself, and add what is new to the index.

    Returns one row per input row: doc_id, keep_id, group_size (rows of the batch with an equal
    text), kept, digest. Null text counts as empty. The smallest doc_id of a new text stays; a text
    that the index already holds keeps the index's doc_id and every row of the batch with it goes.
    Of rows that repeat a doc_id with the same text, exactly one is kept. A null doc_id stays
    only where no row of its group has an id. Empty input gives empty output; other columns are ignored,
    but for ``key``, a column of distinct values that tells a row's verdict from those of equal rows: it is returned too.
    """
    row = F.monotonically_increasing_id() if key is None else F.col(key)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), row.alias("row"))
    rows = stage(with_digest(rows).select("doc_id", "digest", "row"), "digests")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    # Partial aggregation leaves one row per digest and task before the shuffle, so a hot text is no hot key.
    reps = stage(rows.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    # A join with the index leaves a piece for every bucket, however small; rebalanced, a staged table has files of a fair size.
    fresh = stage(index.unseen(reps.select("digest", F.col("first.d").alias("keep_id"), F.col("first.r").alias("keep_row"))).hint("rebalance"), "fresh")
    index.append(fresh)
    known = index.table().hint("merge")
    verdict = reps.select("digest", "group_size").join(known, "digest", "left").join(fresh.select("digest", "keep_row"), "digest", "left")
    # Groups of one need no join back on a hot key, but the rows of large groups do: a sort-merge join whose skewed side Spark splits.
    out = rows.join(stage(verdict.hint("rebalance"), "verdict"), "digest")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), "digest", *([] if key is None else [F.col("row").alias(key)]))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, work_dir(spark, "index"))
    return exact_dedup(docs, index).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
