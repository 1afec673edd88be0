"""Token counts from flat token files by a separator scan (operator 9).

A token file is a flat run of 16-bit big-endian identifiers without any index; every document ends with the end-of-document
identifier. :func:`write_token_files` makes such files, :func:`scan` finds the documents in them again: each block of
a file is searched for separators as one numpy comparison, what lies between separators is measured by differences,
and the two ragged ends of every block are stitched to their neighbours by a prefix scan over the blocks of the file.

The file keeps no index, so a document opens with its own doc_id in control identifiers beyond the vocabulary; they
are not tokens and aren't counted.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import ship, table, work_dir

#: Where the public vocabulary files lie; the vocabulary's size; the identifier that ends a document (the two bytes C4 80,
#: which are one UTF-8 character, so that Spark's text writer can use it as its line separator).
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = 50257
END = 0xC480
SEPARATOR = "Ā"
#: Control identifiers that carry a doc_id: 5 digits of 13 bits.
DIGIT, DIGITS, DIGIT_BITS = END + 1, 5, 13
BLOCK = 1 << 16

_encodings: dict[str, object] = {}


def load_encoder(folder: str, name: str = "byte_bpe_50k.tiktoken"):
    """The public byte-level BPE of 50,256 ranks, from the folder of vocabulary files; cached in each Python process."""
    path = str(Path(folder) / name)
    if path not in _encodings:
        import tiktoken

        public = importlib.import_module(Path(folder).resolve().name)
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        _encodings[path] = tiktoken.Encoding("flat", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def header(doc_id: int | None) -> list[int]:
    """Control identifiers for a doc_id; none for null."""
    if doc_id is None:
        return []
    u = doc_id & (1 << 64) - 1
    return [DIGIT + (u >> DIGIT_BITS * k & (1 << DIGIT_BITS) - 1) for k in range(DIGITS)]


def _encoded(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(folder).encode_ordinary
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tokens = encode(t.as_py() or "")
                out.append(np.array(header(i) + tokens, dtype=">u2").tobytes())
            yield pa.record_batch([pa.array(out, pa.binary())], names=["tokens"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizers: str = TOKENIZERS) -> None:
    """Tokenise docs (doc_id, text) and write flat token files to path, in parallel.

    Null and empty texts become documents without tokens. An identifier never equals the separator, as all are
    below the vocabulary's size or control identifiers above it.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    flat = rows.mapInArrow(_encoded(tokenizers), "tokens binary")
    # Spark's text writer puts the bytes of a string down as they are, followed by the separator.
    flat.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def block_summary(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the separators in a block, and how many tokens (identifiers of the vocabulary) lie before each position."""
    return np.flatnonzero(ids == END), np.concatenate([[0], np.cumsum(ids < VOCABULARY)])


def _scanned(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), dtype=">u2")
                for k in range(0, len(ids), block):
                    part = ids[k : k + block].astype(np.uint16)
                    ends, before = block_summary(part)
                    cuts = np.concatenate([[0], ends, [len(part)]])
                    counts = np.diff(before[cuts])
                    # The header's digits of each piece, as far as they lie in this block; a digit list may be cut by the block's edge.
                    digits = np.flatnonzero(part >= DIGIT)
                    owner = np.searchsorted(ends, digits)
                    edge = np.searchsorted(owner, np.arange(len(counts) + 1))
                    heads = [part[digits[edge[i] : edge[i + 1]]].astype(int).tolist() for i in range(len(counts))]
                    n = len(counts)
                    yield pa.record_batch(
                        [
                            pa.array([name] * n, pa.string()),
                            pa.array([k // block] * n, pa.int64()),
                            pa.array(range(n), pa.int64()),
                            pa.array([i < n - 1 for i in range(n)], pa.bool_()),
                            pa.array(counts, pa.int64()),
                            pa.array(heads, pa.list_(pa.int32())),
                        ],
                        names=["file", "block", "piece", "closed", "n", "head"],
                    )

    return run


def scan(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, doc, doc_id, n_tokens): every document of the flat token files under path, in the order of each file.

    A block yields a piece for each separator in it (closed) and one open piece after the last. The open piece, and whole
    blocks without a separator, belong to the next closed piece of the file; the number of separators in earlier blocks,
    a prefix scan over one row per block, says to which, so that only the first piece of a block and the
    open ones are brought together. Identifiers after a file's last separator are an unfinished document, and left out.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    pieces = files.mapInArrow(_scanned(block), "file string, block long, piece long, closed boolean, n long, head array<int>")
    by_block = pieces.groupBy("file", "block").agg(F.sum(F.col("closed").cast("long")).alias("ends"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = by_block.select("file", "block", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["file", "block"]).withColumn("doc", F.col("base") + F.col("piece"))
    whole = placed.groupBy("file", "doc").agg(F.sum("n").alias("n_tokens"), F.max("closed").alias("closed"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "head"))), lambda x: x["head"])).alias("head"))
    digits = F.transform("head", lambda x, k: F.call_function("shiftleft", (x - DIGIT).cast("long"), (k * DIGIT_BITS).cast("int")))
    doc_id = F.when(F.size("head") == DIGITS, F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))
    return whole.filter("closed").select("file", "doc", doc_id.alias("doc_id"), "n_tokens")


def token_counts(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id and n_tokens of every row of docs (doc_id, text), by way of flat token files in the shared folder.

    Null and empty texts count 0 tokens, repeated rows count each, a null doc_id stays null, no rows give no rows.
    """
    path = work_dir(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizers)
    return scan(docs.sparkSession, path).select("doc_id", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
