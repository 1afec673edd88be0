"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 5).

A 64-bit fingerprint is cut into 4 segments of 16 bits. Two fingerprints that differ in at most 3 bits have, by the
pigeonhole principle, a segment without an error whose next segment (in a ring) has at most one: take the errors
as 3+0+0+0, 2+1+0+0 or 1+1+1+0; at most one error-free segment stands before the segment with 2 or 3 errors, and
another one serves. So each fingerprint is filed under (segment number, the segment itself, an index of a Golay
codeword near the next segment), with 1 or 6 codewords each (see :mod:`golay`); linked fingerprints share a key.

Only distinct fingerprints are filed. Within a key, fingerprints are compared bit by bit, and only a spanning forest
of the links comes out, never all pairs. A key with more than ``block`` fingerprints is cut into blocks and every
two blocks meet in a task of their own, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veilspark.llm.common import ship, stage
from veilspark.llm.components import connected_components
from veilspark.llm.golay import segment_keys

SEED = 42
SEGMENTS = 4


def fingerprint(text: bytes, words: int = 3, at_once: int = 1 << 15) -> int:
    """The fingerprint as an unsigned number: a bit is 1 if it is set in over half of the shingles' XXH64."""
    tokens = text.lower().split()  # bytes: lower() changes A-Z only, split() cuts at ASCII white space only
    if not tokens:
        return 0
    hashes = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return hashes(b" ".join(tokens), SEED)
    total, ones = len(tokens) - words + 1, np.zeros(64, dtype=np.int64)
    for k in range(0, total, at_once):
        part = tokens[k : min(k + at_once, total) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        h = np.array([hashes(s, SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        found = np.array([fingerprint(t.as_py() or b"") for t in texts], dtype="<u8").view("<i8")
        yield pa.record_batch([pa.array(found, pa.int64()), *batch.columns[1:]], names=["fp", *batch.schema.names[1:]])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """(fp, doc_id, and the columns named by keys) of every row of docs; fp holds the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *keys)
    return rows.mapInArrow(_fingerprints, StructType([StructField("fp", LongType()), *rows.schema.fields[1:]]))


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): the positions of the fingerprints, and a key for each."""
    codes, counts = segment_keys()
    rows, keys = [], []
    for i in range(SEGMENTS):
        own = (fps >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF
        after = (fps >> np.uint64(16 * ((i + 1) % SEGMENTS))).astype(np.int64) & 0xFFFF
        for column in range(6):
            has = np.flatnonzero(counts[after] > column)
            rows.append(has)
            keys.append(i << 28 | own[has] << 12 | codes[after[has], column])
    return np.concatenate(rows), np.concatenate(keys)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        rows, keys = keys_of(fps.view("<u8"))
        yield pa.record_batch([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the links (at most ``most`` differing bits) among fingerprints.

    Breadth first from each position not yet reached: one row of distances at a time, so memory stays linear.
    """
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= most
            reached = left[near]
            out += [(at, int(x)) for x in reached]
            queue += reached.tolist()
            left = left[~near]
    return out


def _linked(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            lists = batch.column(0)
            ends, flat = lists.offsets.to_numpy(), lists.values
            ids_of = flat.to_numpy(zero_copy_only=False).astype("<i8")
            fp = ids_of.view("<u8")
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                own, ids = fp[a:b], ids_of[a:b]
                if b - a == 2:
                    pairs = [(0, 1)] if (int(own[0]) ^ int(own[1])).bit_count() <= most else []
                else:
                    pairs = forest(own, most)
                u += [ids[x] for x, _ in pairs]
                v += [ids[y] for _, y in pairs]
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def links(distinct: DataFrame, most: int = 3, block: int = 2048) -> DataFrame:
    """distinct (fp), each fp once -> links (u, v) between fingerprints, enough for every component.

    Exact: every key with several fingerprints is compared in whole, large ones block by block.
    """
    if most > 3:
        raise ValueError("the keys find pairs with up to 3 differing bits")
    filed = stage(distinct.select("fp").mapInArrow(_filed, "key long, fp long"), "keys")
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    n_blocks = F.ceil(F.col("n") / block).cast("long")
    rows = filed.join(sizes.select("key", n_blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    met = rows.groupBy("key", "p", "q").agg(F.collect_list("fp").alias("group")).filter("size(group) > 1")
    return met.select("group").mapInArrow(_linked(most), "u long, v long")


def simhash_components(docs: DataFrame, *keys: str, most: int = 3) -> DataFrame:
    """doc_id, fp, component_id, component, and the columns named by keys, for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links (at most ``most`` differing bits) lead to, the row's own
    included. Null and empty texts have fingerprint 0 and link like others; repeated rows each give a row; very long texts
    are read whole. A row with a null doc_id links like others, but its id names no component: where no row of a component has
    an id, component_id is null. component is a fingerprint that names the component in any case. No rows give no rows; other
    columns are ignored.
    """
    rows = stage(fingerprints(docs, *keys), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(distinct, most))
    # The nodes are fingerprints; a component's id is the least doc_id of its nodes.
    of = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(of.select("fp", "component").join(ids, "component"), "named")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id", "component", *keys)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
