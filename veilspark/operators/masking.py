"""Masking: generic placeholders, dictionaries, and the JSON report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.labels import generic_placeholder, russian
from veilspark.functions.spans import rewrite


def mask_generic(df: DataFrame, text: str = "text", spans: str = "spans", name: str = "masked") -> DataFrame:
    """Replace every span by its label's placeholder; spans of a label with only white space between become one."""
    return df.withColumn(name, rewrite(F.col(text), F.col(spans), lambda e: generic_placeholder(e["label"])))


def first_wins_mapping(spans: Column) -> Column:
    """map surface -> generic placeholder; the first span of a surface decides."""
    surfaces = F.array_distinct(F.transform(spans, lambda e: e["text"]))
    first = lambda s: F.filter(spans, lambda e: e["text"] == s)[0]["label"]
    return F.map_from_entries(F.transform(surfaces, lambda s: F.struct(s.alias("key"), generic_placeholder(first(s)).alias("value"))))


def dictionary_rewrite(text: Column, mapping: Column) -> Column:
    """Replace every key of a map by its value, the longest key first, one after the other (later keys may hit earlier replacements)."""
    entries = F.filter(F.map_entries(mapping), lambda e: e["key"] != "")
    keyed = F.transform(entries, lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    return F.aggregate(F.array_sort(keyed), text, lambda t, e: F.replace(t, e["k"], e["v"]))


def stats(spans: Column) -> Column:
    """map label -> number of spans."""
    labels = F.array_sort(F.array_distinct(F.transform(spans, lambda e: e["label"])))
    return F.map_from_entries(F.transform(labels, lambda x: F.struct(x.alias("key"), F.size(F.filter(spans, lambda e: e["label"] == x)).alias("value"))))


def legend(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda e: e["label"])))


def placeholders_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("<[A-Za-z0-9_]+>"), F.lit(0))


def report(source: Column, spans: Column, mapping: Column, masked: Column) -> Column:
    """The JSON report of one document; placeholders of entities are the generic ones."""
    labels = legend(spans)
    counts = F.map_from_entries(F.transform(labels, lambda x: F.struct(x.alias("key"), F.struct(russian(x).alias("ru"), F.size(F.filter(spans, lambda e: e["label"] == x)).alias("count")).alias("value"))))
    entities = F.transform(spans, lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), russian(e["label"]).alias("label_ru"), e["start"].alias("start"), e["end"].alias("end"), F.round(e["confidence"], 3).alias("confidence"), generic_placeholder(e["label"]).alias("placeholder")))
    return F.to_json(F.struct(source.alias("source_file"), F.size(spans).alias("total_entities"), counts.alias("stats"), mapping.alias("mapping"), entities.alias("entities"), masked.alias("anonymized_text")))
