"""The mapping store as tables: surfaces, placeholders, persons, and restoring.

registrations: (doc_seq, source_file, original, label, start) -> mapping: one row per surface. Numbers run per
label in the order of first registration, which is document order, and within a document persons first, longer
spans first, then by place. Only distinct surfaces are shuffled; a hot surface shrinks in the partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.names import person_canonical, surname_key
from veilspark.functions.spans import rewrite

#: Documents of one chunk are numbered by one task; chunk totals are summed up over chunks.
CHUNK = 4096


def registrations(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """docs (doc_seq, source_file, spans) -> a row for each span."""
    return docs.select("doc_seq", "source_file", F.inline(spans)).select("doc_seq", "source_file", F.col("text").alias("original"), "label", "start")


def order_of(reg: DataFrame) -> Column:
    return F.struct(F.col("doc_seq").cast("long").alias("doc"), (F.col("label") != "PERSON").alias("other"), (-F.length("original")).alias("shorter"), F.col("start").cast("long").alias("start"))


def surfaces(reg: DataFrame) -> DataFrame:
    """One row per surface: its first label, first place and the files it occurs in (in order). Blank surfaces are left out."""
    rows = reg.filter(F.trim("original") != "").withColumn("ord", order_of(reg))
    per_file = rows.groupBy("original", "source_file").agg(F.min(F.struct("ord", "label")).alias("first"))
    out = per_file.groupBy("original").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct(F.col("first.ord").alias("ord"), F.col("source_file").alias("file")))).alias("seen"))
    return out.select("original", F.col("first.label").alias("label"), F.col("first.ord").alias("ord"), F.filter(F.transform("seen", lambda x: x["file"]), lambda f: f.isNotNull()).alias("files"))


def identity_key(original: Column, label: Column, canonical_persons: bool = True, strict: bool = False) -> tuple[Column, Column]:
    """(canonical form, key): persons are one by their first canonical token, or in strict mode by the whole form."""
    canon = person_canonical(original)
    key = canon if strict else surname_key(canon)
    if not canonical_persons:
        return F.lit(None).cast("string"), original
    return F.when(label == "PERSON", canon), F.when(label == "PERSON", key).otherwise(original)


def numbered(keys: DataFrame) -> DataFrame:
    """(label, key, ord) -> n, from 1 per label in order of ord; a prefix sum over chunks of documents, then within a chunk."""
    k = keys.withColumn("chunk", F.floor(F.col("ord.doc") / CHUNK))
    totals = k.groupBy("label", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("label").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("label", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("label", "chunk").orderBy("ord", "key")
    return k.withColumn("i", F.row_number().over(inside)).join(base, ["label", "chunk"]).withColumn("n", F.col("base") + F.col("i")).drop("chunk", "base", "i")


def build_mapping(reg: DataFrame, canonical_persons: bool = True, strict: bool = False) -> DataFrame:
    """mapping (original, label, placeholder, first_doc, files, canonical, primary, aliases).

    The first label of a surface wins; primary is the surface of a placeholder with the most tokens, the earliest of equals.
    """
    canon, key = identity_key(F.col("original"), F.col("label"), canonical_persons, strict)
    s = surfaces(reg).withColumn("canonical", canon).withColumn("key", key)
    rank = F.struct((-F.size(F.split(F.trim("original"), r"\s+"))).alias("t"), F.col("ord"), F.col("original"))
    keys = s.groupBy("label", "key").agg(F.min("ord").alias("ord"), F.min(rank).alias("best"), F.array_sort(F.collect_list(F.struct("ord", "original"))).alias("all"))
    n = numbered(keys.select("label", "key", "ord", F.col("best.original").alias("primary"), F.transform("all", lambda x: x["original"]).alias("aliases")))
    named = n.withColumn("placeholder", F.format_string("<%s_%d>", "label", "n")).select("label", "key", "placeholder", "primary", "aliases")
    out = s.join(named, ["label", "key"])
    return out.select("original", "label", "placeholder", F.col("ord.doc").alias("first_doc"), "files", "canonical", "primary", "aliases")


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """Per label: distinct placeholders and surfaces; the row with a null label has the totals."""
    return mapping.groupingSets([["label"], []], "label").agg(F.count_distinct("placeholder").alias("entities"), F.count(F.lit(1)).alias("surfaces"))


def pseudonymise(docs: DataFrame, mapping: DataFrame, key: str = "doc_seq", text: str = "text", spans: str = "spans", name: str = "pseudonymised") -> DataFrame:
    """Replace every span by its surface's numbered placeholder.

    The spans go out, meet the mapping by surface (a join that Spark may broadcast or split when skewed) and come back by
    document. Where a surface isn't in the mapping the span stays as it is.
    """
    each = docs.select(F.col(key).alias("__key"), F.inline(spans)).select("__key", "start", "end", F.col("text").alias("original"))
    each = each.join(mapping.select("original", "placeholder"), "original", "left")
    back = each.groupBy("__key").agg(F.collect_list(F.struct("start", "end", F.coalesce("placeholder", "original").alias("ph"))).alias("__ph")).withColumnRenamed("__key", key)
    out = docs.join(back, key, "left").withColumn("__ph", F.coalesce("__ph", F.array().cast("array<struct<start:int,end:int,ph:string>>")))
    return out.withColumn(name, rewrite(F.col(text), F.col("__ph"), lambda e: e["ph"])).drop("__ph")


def restore(df: DataFrame, mapping: DataFrame, key: str, text: str, name: str = "restored") -> DataFrame:
    """Put the primary surface back for every placeholder of the text; unknown placeholders stay.

    The text is cut at its placeholders, so <PERSON_1> never hits <PERSON_1_2> and a broadcast of the mapping isn't needed.
    """
    pattern = "<[A-Za-z0-9_]+>"
    tokens = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("ph"))
    known = mapping.select(F.col("placeholder").alias("ph"), "primary").distinct()
    of_doc = tokens.join(known, "ph").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("ph", "primary"))).alias("__map"))
    out = df.join(of_doc, key, "left")
    parts = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("gap"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("ph"))
    put = lambda x: F.concat(x["gap"], F.coalesce(F.when(x["ph"].isNotNull(), F.coalesce(F.col("__map")[x["ph"]], x["ph"])), F.lit("")))
    return out.withColumn(name, F.array_join(F.transform(parts, put), "")).drop("__map")


def restore_with(text: Column, mapping: dict[str, str]) -> Column:
    """The driver-side form for one mapping: placeholder -> surface, the longest placeholder first."""
    for ph in sorted(mapping, key=len, reverse=True):
        text = F.replace(text, F.lit(ph), F.lit(mapping[ph]))
    return text
