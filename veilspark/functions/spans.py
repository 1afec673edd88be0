"""Spans as arrays inside the row: finding, conflict resolution, merging and rewriting. No shuffle, no UDF.

A span is struct<label, text, start, end, confidence, source>; start and end count code points, half open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from veilspark.functions import fx as F

from veilspark.functions.labels import priority

SPAN = "struct<label:string,text:string,start:int,end:int,confidence:double,source:string>"
HIT = "struct<start:int,text:string>"


def empty(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def hits(text: Column, pattern: str) -> Column:
    """array<struct<start, text>> of the matches of a Java pattern, left to right.

    The pattern must not match an empty string and its groups must not capture. Texts without a match, nearly all,
    cost one search; the others are cut at the matches and the lengths of the parts add up to the places.
    """
    p = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)))  # fields 0 (gap) and 1 (hit)
    start = F.struct(F.lit(0).alias("at"), empty(HIT).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["0"])
        hit = F.struct(at.alias("start"), x["1"].alias("text"))
        return F.struct((at + F.coalesce(F.length(x["1"]), F.lit(0))).alias("at"), F.when(x["1"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(hit))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(empty(HIT))


def span(label: Column | str, text: Column, start: Column, confidence: Column, source: Column | str, end: Column | None = None) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    end = start + F.length(text) if end is None else end
    return F.struct(label.alias("label"), text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"), confidence.cast("double").alias("confidence"), (F.lit(source) if isinstance(source, str) else source).alias("source"))


def window(text: Column, e: Column, size: int = 48) -> Column:
    """The text around a span, in lower case."""
    first = F.greatest(e["start"] - size, F.lit(0))
    return F.lower(F.substring(text, first + 1, e["end"] + size - first))


def _rank(e: Column) -> Column:
    return F.struct(priority(e["label"]).alias("p"), e["confidence"].alias("c"), (e["end"] - e["start"]).alias("n"))


def resolve(spans: Column) -> Column:
    """Resolve conflicts: in order of start, a span that overlaps the last kept one replaces it if it ranks strictly higher
    (priority, confidence, length), and else goes. The input is in order of start, so only the last kept span can overlap."""
    keyed = F.transform(spans, lambda e: F.struct(e["start"].alias("s"), (-priority(e["label"])).alias("p"), (-e["confidence"]).alias("c"), (e["start"] - e["end"]).alias("n"), e.alias("e")))
    none = F.filter(keyed, lambda x: F.lit(False))
    rank = lambda x: F.struct(x["p"], x["c"], x["n"])

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        clear = (F.size(kept) == 0) | (last["e"]["end"] <= x["s"])
        return F.when(clear, F.concat(kept, F.array(x))).when(rank(x) < rank(last), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

    return F.aggregate(F.array_sort(keyed), none, step, lambda kept: F.transform(kept, lambda x: x["e"]))


def union_spans(spans: Column, text: Column) -> Column:
    """The parity-breaking alternative to :func:`resolve`: overlapping spans become one with the highest-ranking label, so no
    character of any span is left unmasked."""
    ordered = F.array_sort(F.transform(spans, lambda e: F.struct(e["start"].alias("s"), e["end"].alias("t"), e.alias("e"))))

    def step(kept: Column, x: Column) -> Column:
        e, last = x["e"], F.try_element_at(kept, F.lit(-1))
        best = F.when(_rank(e) > _rank(last), e).otherwise(last)
        end = F.greatest(last["end"], e["end"])
        joined = span(best["label"], F.substring(text, last["start"] + 1, end - last["start"]), last["start"], best["confidence"], "union", end)
        return F.when((F.size(kept) == 0) | (last["end"] <= e["start"]), F.concat(kept, F.array(e))).otherwise(F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(ordered, empty(), step)


def merge_persons(spans: Column, text: Column, most_gap: int = 2) -> Column:
    """Neighbouring PERSON spans with at most most_gap characters of white space between become one, with the lower confidence."""
    persons = F.filter(spans, lambda e: e["label"] == "PERSON")
    ordered = F.transform(F.array_sort(F.transform(persons, lambda e: F.struct(e["start"].alias("s"), e["end"].alias("t"), e.alias("e")))), lambda x: x["e"])

    def step(kept: Column, e: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        gap = F.substring(text, last["end"] + 1, e["start"] - last["end"])
        near = (F.size(kept) > 0) & (e["start"] - last["end"] <= most_gap) & (F.trim(F.regexp_replace(gap, r"(?U)\s", "")) == "")
        joined = span("PERSON", F.substring(text, last["start"] + 1, e["end"] - last["start"]), last["start"], F.least(last["confidence"], e["confidence"]), "ner_merged", e["end"])
        return F.when(near, F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(kept, F.array(e)))

    return F.concat(F.filter(spans, lambda e: e["label"] != "PERSON"), F.aggregate(ordered, empty(), step))


def rewrite(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with every span replaced; spans must be disjoint. One pass from left to right."""
    ordered = F.transform(F.array_sort(F.transform(spans, lambda e: F.struct(e["start"].alias("s"), e.alias("e")))), lambda x: x["e"])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, e: F.struct(e["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), replacement(e)).alias("out"))
    return F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])
