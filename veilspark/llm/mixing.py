"""Mixing sources to target weights by blocks (operator 2, native).

1. pack:   every source's words, document after document, fill blocks of a fixed length.
2. plan:   targets by weight, none above ``max_epochs`` times its source (the excess is shared anew).
3. draw:   each source has exactly the slots that its target needs; a hash deals every slot to an output
           shard, so the counts of a source over the shards are a multinomial draw given its total. The
           totals are held fixed so that a source meets its target, not only on average.
4. map:    slot -> (epoch, index) through a pseudorandom permutation of the source's blocks.
5. join:   blocks and slots meet by (source, block index); both sides are spread evenly, whatever the
           sizes of the sources.
6. write:  the words of every piece are cut out of its document and joined to blocks, which are written to
           the shared folder with their shard; how much of a document is taken is counted from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import WORD, row_keyed, stage, text_or_empty

#: Odd multipliers of the permutation's rounds (fixed values).
ROUND_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


@dataclass(frozen=True)
class MixConfig:
    block_words: int = 256
    #: words of one output shard
    shard_words: int = 1 << 20
    max_epochs: int = 3
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    seed: int = 42
    #: packing runs in parallel within so many chunks of a source
    chunks: int = 1024
    #: slots that one task row expands to
    slots_per_row: int = 1024


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, hash) of docs with a row key: size counts the words of the whole text, null text has none."""
    n = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size"), F.xxhash64(text_or_empty()).alias("hash"))


def source_plan(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """One row per source: sid, source, source_size, target.

    Water-filling: in ascending order of cap / weight, a source is capped as long as its cap is at most the
    share it would get of what is left; from the first that isn't, all get shares by weight. That is where
    resharing the excess again and again ends. The windows run over one row per source, the mix's own
    configuration, never over documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    s = total.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(weights, (F.col("sid") % len(config.weights) + 1).cast("int")))
    cap = F.col("source_size") * float(config.max_epochs)
    s = s.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "sid")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", rest / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    free = F.col("ratio") > F.col("level")
    level = F.min(F.when(free, F.struct("ratio", "sid", "level"))).over(everything)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return s.select("sid", "source", "source_size", target.alias("target"))


def keyed(df: DataFrame, n: str, key: str) -> DataFrame:
    """Add what :func:`permuted` needs of a key and its [0, n): the rounds' offsets, and the power of two that is at most n."""
    df = df.withColumn("bits", F.expr(f"CAST(length(bin({n})) - 1 AS INT)")).withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    return df.withColumns({f"offset{r}": F.expr(f"pmod(xxhash64({key}, {r}), {n})") for r in range(len(ROUND_MULTIPLIERS))})


def permuted(df: DataFrame, k: str, n: str, out: str) -> DataFrame:
    """Add out, a pseudorandom permutation of [0, n) at k.

    Each round rotates [0, n) by its offset, then scrambles the part below the largest power of two that is at
    most n with an odd multiplication and a shifted exclusive or. Every step is a bijection. Each is a column of its
    own, so that the expression doesn't grow with the rounds.
    """
    df = df.withColumn(out, F.col(k))
    for r, odd in enumerate(ROUND_MULTIPLIERS):
        df = df.withColumn("at", F.expr(f"({out} + offset{r}) % {n}"))
        df = df.withColumn("low", F.expr(f"((at & mask & 4294967295L) * {odd & 0x7FFFFFFF}L) & mask"))
        df = df.withColumn(out, F.expr("IF(at <= mask, low ^ shiftright(low, CAST(bits / 2 AS INT) + 1), at)"))
    return df


def packed(sizes: DataFrame, plan: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Pieces of documents in blocks: sid, block, row, doc_id, at and first (first word's place in the block and in the document), n_words.

    The place of a document in its source is a two-level prefix sum: over at most ``chunks`` chunk totals of
    a source, then within a chunk, so that no task orders a whole source. Chunk and order follow from id and text, so
    that the same rows in another partitioning are packed alike (rows that agree in both may change places).
    """
    docs = sizes.join(plan.select("sid", F.col("source").alias("s2")), F.col("source").eqNullSafe(F.col("s2"))).filter("size > 0")
    docs = docs.select("sid", "row", "doc_id", "size", "hash", F.pmod(F.xxhash64("doc_id", "hash", F.lit(config.seed)), F.lit(config.chunks)).alias("chunk"))
    totals = docs.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("sid", "chunk", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "chunk").orderBy("doc_id", "hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["sid", "chunk"])
    b = F.lit(config.block_words).cast("long")
    docs = docs.withColumn("start", F.col("start") + F.col("base")).withColumn("end", F.col("start") + F.col("size"))
    first, last = F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b)
    pieces = docs.select("sid", "row", "doc_id", "start", "end", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block"))
    at = F.greatest(F.col("start") - F.col("block") * b, F.lit(0))
    first = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
    return pieces.select("sid", "block", "row", "doc_id", at.alias("at"), first.alias("first"), (F.least(F.col("end") - F.col("block") * b, b) - at).alias("n_words"))


def slots(plan: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The draw: shard, sid, epoch, block, n_words (words of the block that the mix takes; all but in a source's last slot).

    An epoch of a source is its full blocks in permuted order, then its last, shorter block. The slots are made by two
    explodes with a shuffle between, so a source of any size is spread over all tasks.
    """
    b = F.lit(config.block_words).cast("long")
    p = plan.filter("source_size > 0").withColumn("words", F.round("target").cast("long")).filter("words > 0")
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("words").over(Window.partitionBy(F.lit(0))) / config.shard_words).cast("long"))
    p = p.withColumn("shards", shards).withColumn("full", F.greatest(F.lit(1).cast("long"), F.floor(F.col("source_size") / b).cast("long")))
    last = F.ceil(F.col("words") / F.col("source_size")).cast("long") - 1
    p = p.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    p = p.withColumn("due", F.least("source_size", F.col("words") - F.col("epoch") * F.col("source_size")))
    p = p.withColumn("slots", F.ceil(F.col("due") / b).cast("long")).withColumn("key", F.xxhash64("sid", "epoch", F.lit(config.seed)))
    p = keyed(p, "full", "key")
    p = p.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(config.slots_per_row).cast("long"))))
    # With the number named, Spark doesn't merge the few rows into one task before they expand.
    p = p.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "epoch", "from")
    s = p.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + config.slots_per_row, F.col("slots")) - 1)))
    s = permuted(s, "k", "full", "shuffled")
    # The last, shorter block (or the only one) comes last in its epoch.
    whole = (F.col("k") + 1) * b <= F.col("source_size")
    shard = F.pmod(F.xxhash64("key", "k", F.lit(config.seed + 1)), F.col("shards"))
    return s.select(shard.alias("shard"), "sid", "epoch", F.when(whole, F.col("shuffled")).otherwise(F.col("k")).alias("block"), F.least(b, F.col("due") - F.col("k") * b).alias("n_words"))


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix docs (row, doc_id, text, source; row as from :func:`common.row_keyed`) to the weights.

    Returns (sizes, plan, taken): sizes as :func:`sized`; plan as :func:`source_plan`; taken has one row for
    each piece of a document in each slot: shard, sid, epoch, block, row, doc_id, at, first, n_words (words that the
    mix takes, from ``first`` of the document and ``at`` of the block on). No document is taken more than ``max_epochs`` times in whole. Null and
    empty texts have size 0 and are never taken; a null source is a source of its own, after all others; repeated
    rows count as rows of their own; very long texts are read whole; no documents give no rows. Reruns agree, in any partitioning.
    """
    sizes = stage(sized(docs), "sizes")
    plan = stage(source_plan(sizes, config), "plan")
    drawn = slots(plan, config).withColumnRenamed("n_words", "limit")
    pieces = packed(sizes, plan, config)
    got = F.least(F.col("at") + F.col("n_words"), F.col("limit")) - F.col("at")
    # Both sides grow with the data; the draw is made by explodes, whose size Spark underestimates, so the join is named.
    taken = drawn.hint("merge").join(pieces, ["sid", "block"]).withColumn("n_words", got).filter("n_words > 0")
    return sizes, plan, taken.select("shard", "sid", "epoch", "block", "row", "doc_id", "at", "first", "n_words")


def blocks(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix itself, one row for each block drawn: shard, sid, epoch, block, n_words, text, pieces (array of at, row, doc_id, first, n_words).

    text is the block's words with a space between; docs is :func:`mix`'s argument, and taken its result. A document is cut into words once, and
    its pieces are cut from them before they are shuffled to their blocks.
    """
    piece = F.struct("shard", "sid", "epoch", "block", "at", "first", "n_words")
    wanted = taken.groupBy("row").agg(F.collect_list(piece).alias("wanted"))  # at most the pieces of a document in each epoch
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(wanted.hint("merge"), "row")

    def cut(words):
        return F.transform("wanted", lambda x: F.struct(x.alias("p"), F.slice(words, (x["first"] + 1).cast("int"), x["n_words"].cast("int")).alias("words")))

    # The words are an element of an array, so that they are found once for a document and not once for a piece.
    found = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), cut)
    each = docs.select("row", "doc_id", F.explode(F.element_at(found, 1)).alias("x"))
    each = each.select("x.p.shard", "x.p.sid", "x.p.epoch", "x.p.block", F.struct("x.p.at", "row", "doc_id", "x.p.first", F.size("x.words").cast("long").alias("n_words"), F.array_join("x.words", " ").alias("text")).alias("piece"))
    # Written once cut, so that the shuffle of the texts is gone before that of the pieces. At most block_words pieces in a group.
    each = stage(each, "pieces")
    out = each.groupBy("shard", "sid", "epoch", "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), " ")
    total = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["n_words"])
    return out.select("shard", "sid", "epoch", "block", total.alias("n_words"), text.alias("text"), F.transform("pieces", lambda p: p.dropFields("text")).alias("pieces"))


def mixed_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words of it in the blocks written)."""
    docs = row_keyed(docs.select("doc_id", "text", "source"), "row")
    sizes, plan, taken = mix(docs, config)
    written = stage(blocks(docs, taken), "blocks").select(F.explode("pieces").alias("p"))
    per_row = written.groupBy("p.row").agg(F.sum("p.n_words").alias("taken"))
    out = sizes.join(plan.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).join(per_row, "row", "left")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
