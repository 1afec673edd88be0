"""Whole queries: one document at a time, a batch with shared pseudonyms, workbooks, gold cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.cells import covers_cell, is_junk, looks_like_org, pipe_fragments, rewritten_cell
from veilspark.functions.labels import generic_placeholder
from veilspark.operators.detect import with_spans
from veilspark.operators.evaluation import evaluate, gates
from veilspark.operators.mapping import build_mapping, pseudonymise, registrations, surfaces
from veilspark.operators.masking import first_wins_mapping, mask_generic, report, stats
from veilspark.plans.config import PiiConfig
from veilspark.plans.staging import staged


def process(docs: DataFrame, config: PiiConfig = PiiConfig(), text: str = "text") -> DataFrame:
    """Detect and mask every document on its own: adds spans, masked, mapping, stats, total_entities. No shuffle."""
    out = mask_generic(with_spans(docs, text, config), text)
    return out.withColumns({"mapping": first_wins_mapping(F.col("spans")), "stats": stats(F.col("spans")), "total_entities": F.size("spans")})


def with_report(processed: DataFrame, source: str = "source_file") -> DataFrame:
    return processed.withColumn("report", report(F.col(source), F.col("spans"), F.col("mapping"), F.col("masked")))


@dataclass(frozen=True)
class Batch:
    documents: DataFrame
    mapping: DataFrame
    spans: DataFrame


def process_batch(docs: DataFrame, config: PiiConfig = PiiConfig(), extra: DataFrame | None = None) -> Batch:
    """docs (doc_seq, source_file, text): pseudonyms shared over the whole batch, numbered in the order of doc_seq.

    extra: more registrations, e.g. of :func:`cell_registrations`. Each document gets only its own placeholders.
    """
    found = staged(with_spans(docs, config=config), "spans")  # read twice: for registration and for masking
    reg = registrations(found)
    if extra is not None:
        reg = reg.unionByName(extra)
    mapping = staged(build_mapping(reg, config.canonical_persons, config.strict_persons), "mapping")
    return Batch(pseudonymise(found, mapping), mapping, found)


def mapping_as_of(mapping: DataFrame, docs: DataFrame) -> DataFrame:
    """The mapping as each document of the batch saw it: the surfaces first met in it or before. A join by range; meant for a few documents."""
    return docs.select("doc_seq").join(mapping, mapping["first_doc"] <= docs["doc_seq"]).select("doc_seq", "original", "placeholder")


def cell_registrations(cells: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """Registrations from workbook cells (doc_seq, source_file, value): each fragment of each different value is analysed once.

    Every span of a fragment is registered; so is the whole cell under the label of its longest span, where that span stands for
    the cell; a fragment without spans that looks like an organisation is registered as one. Header words and
    other junk aren't.
    """
    each = cells.select("doc_seq", "source_file", F.explode(pipe_fragments(F.col("value"))).alias("value")).filter(~is_junk(F.col("value")))
    found = with_spans(each.select("value").distinct(), "value", config)
    best = F.array_max(F.transform("spans", lambda e: F.struct(F.length(e["text"]).alias("n"), e["confidence"].alias("c"), (-e["start"]).alias("s"), e["label"].alias("label"), e["text"].alias("text"))))
    whole = F.when(best.isNotNull() & covers_cell(best["text"], F.col("value")), best["label"]).when(best.isNull() & looks_like_org(F.col("value")), F.lit("ORGANIZATION"))
    known = found.withColumn("whole", whole)
    surfaces = F.concat(F.transform("spans", lambda e: F.struct(e["text"].alias("original"), e["label"].alias("label"), e["start"].alias("start"))), F.when(F.col("whole").isNotNull(), F.array(F.struct(F.col("value").alias("original"), F.col("whole").alias("label"), F.lit(0).alias("start")))).otherwise(F.array().cast("array<struct<original:string,label:string,start:int>>")))
    regs = each.join(known.select("value", F.explode(surfaces).alias("s")), "value").select("doc_seq", "source_file", "s.original", "s.label", "s.start")
    return regs.filter(~is_junk(F.col("original")))


def mask_cells(cells: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """cells (value, is_formula, ...) with a workbook's dictionary applied; formulas stay. The dictionary is one workbook's own, a driver-side value."""
    entries = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return cells.withColumn("masked", rewritten_cell(F.col("value"), F.col("is_formula"), entries))


def enrich_generic(mapping: DataFrame, registered: DataFrame) -> DataFrame:
    """A document's generic mapping (original, placeholder) with the surfaces that only its cells have, under their label's placeholder; known surfaces keep theirs."""
    new = surfaces(registered).join(mapping.select("original"), "original", "left_anti")
    return mapping.select("original", "placeholder").unionByName(new.select("original", generic_placeholder(F.col("label")).alias("placeholder")))


def run_gold(cases: DataFrame, gold: DataFrame, config: PiiConfig = PiiConfig(), mode: str = "label_text") -> DataFrame:
    """Detect in every gold case's text and compare with its gold: metrics of each case, and whether it passes its minimum."""
    found = with_spans(cases.select(F.col("id").alias("case_id"), "text"), config=config)
    predicted = found.select("case_id", F.inline("spans")).select("case_id", "label", "text", "start", "end")
    return gates(evaluate(gold, predicted, mode, gold_labels_only=True), cases)
