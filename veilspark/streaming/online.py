"""Streams of documents: detection and masking are projections and run unchanged; numbering needs state.

An extension: numbered pseudonyms over a stream keep the mapping as a table that each micro-batch reads and extends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.mapping import build_mapping, pseudonymise, registrations
from veilspark.operators.detect import with_spans
from veilspark.operators.masking import mask_generic
from veilspark.plans.config import PiiConfig


def mask_stream(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """A streaming DataFrame with spans and masked added; stateless, so any output mode and trigger will do."""
    return mask_generic(with_spans(docs, config=config))


def counts_stream(docs: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes", config: PiiConfig = PiiConfig()) -> DataFrame:
    """Spans by label and event-time window, with a watermark for late documents."""
    spans = with_spans(docs.withWatermark(time, late), config=config).select(time, F.explode("spans.label").alias("label"))
    return spans.groupBy(F.window(time, width), "label").agg(F.count(F.lit(1)).alias("n"))


def pseudonymise_stream(docs: DataFrame, folder: str, checkpoint: str, config: PiiConfig = PiiConfig()) -> StreamingQuery:
    """docs (doc_seq, source_file, text) -> folder/registrations and folder/documents, a part for each micro-batch.

    A batch's registrations are written before they are read with all earlier ones, under the batch's number, so a
    repeated batch overwrites its own part. doc_seq must rise with the stream for numbers to be stable.
    """
    spark: SparkSession = docs.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        found = with_spans(batch, config=config)
        registrations(found).write.mode("overwrite").parquet(f"{folder}/registrations/batch={number}")
        mapping = build_mapping(spark.read.parquet(f"{folder}/registrations"), config.canonical_persons, config.strict_persons)
        pseudonymise(found, mapping).drop("spans").write.mode("overwrite").parquet(f"{folder}/documents/batch={number}")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
