"""Benchmark decontamination by latent semantic retrieval (operator 1).

1. Terms: every text is cut into words once, and what is kept of it is where words of the benchmark stand and which; these
   numbers are written to the shared folder, and all that follows reads them in place of the texts.
2. Corpus statistics: in how many documents each benchmark term occurs, over all documents. No term is left out, however
   common: its weight (idf) falls to 1 and no further, so an item that was copied to most documents is still found.
3. A latent space: distributed randomised SVD of the TF-IDF matrix of the benchmark's passages. Directions that no
   benchmark passage has cannot tell a leak from other text, so the space is fitted to the passages searched for.
4. Candidates: the whole text is read as overlapping windows, of the least width in ``windows`` that holds the item's passage. A
   document, and then a window with its surroundings, that doesn't hold as many of the item's words as the checks ask for can't pass
   them and goes no further; of the others, those whose latent vector has a cosine of at least ``cosine`` with the passage are compared.
5. Checks: the longest common subsequence of the item's words and the words around the window, over the item's length, is at
   least ``lcs``; or, for paraphrases, at least ``lcs_paraphrase`` while the answer (a column, or else the item's
   last sentence) is found to ``answer`` as well. Items of under ``least_words`` words must occur word for word.

The benchmark is the stated query set: it is taken in blocks of ``block_items`` items, whose models
(terms x rank numbers) are what goes to the executors; all blocks read the same numbers in one pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from veilspark.llm.common import ship, stage, table

WORDS = re.compile(r"\w+")
#: Rows, and terms in rows, that a Python worker holds at a time.
ROWS, TERMS = 1024, 1 << 20


@dataclass(frozen=True)
class DecontaminationConfig:
    #: widths of windows, in words; a window moves on by half its width
    windows: tuple[int, ...] = (16, 32, 64)
    #: words of an item's passage; longer items have several passages
    passage: int = 64
    rank: int = 256
    power_rounds: int = 2
    cosine: float = 0.45
    lcs: float = 0.8
    lcs_paraphrase: float = 0.6
    answer: float = 0.8
    least_words: int = 8
    block_items: int = 1024
    seed: int = 42


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for places in map(where.__getitem__, filter(where.__contains__, b)):
        hit = row & places
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@dataclass
class Item:
    item_id: int
    words: list[str]
    answer: list[str]


@dataclass
class Bag:
    """An item's terms in order and how often it has each; of these the rarer ones, of which a window has to hold at least ``few``."""

    n: int
    terms: np.ndarray
    times: np.ndarray
    rare: np.ndarray
    few: int


@dataclass
class Model:
    """A block of the benchmark, with words as numbers of the vocabulary.

    items: (item_id, words, answer); of the vocabulary's terms, term has the number in this block (-1: in no item) and latent
    the weighted latent vectors; passages are rows of the latent space, owned by item k from first[k] to first[k + 1], and width is
    the item's width of window. The items that have a term among their rarer ones are posted[ends[term]:ends[term + 1]].
    """

    items: list[tuple[int, list[int], list[int]]]
    term: np.ndarray
    latent: np.ndarray
    passages: np.ndarray
    first: np.ndarray
    width: np.ndarray
    ends: np.ndarray
    posted: np.ndarray
    bags: list[Bag]
    few: np.ndarray
    #: the words that a window of an item and its surroundings have
    span: np.ndarray


def last_sentence(text: str) -> str:
    parts = [p for p in re.split(r"[.!?\n]+", text) if len(words_of(p)) >= 3]
    return parts[-1] if parts else ""


def item_blocks(benchmark: DataFrame, size: int) -> Iterator[list[Item]]:
    """The items in order of item_id, a block at a time; those without words are left out."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).filter("item_id IS NOT NULL")
    block: list[Item] = []
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if words := words_of(r["text"]):
            block.append(Item(r["item_id"], words, words_of(r["answer"] or last_sentence(r["text"]))))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _tokenised(vocabulary: dict[str, int]):
    """(text, ...) -> (id, gap, ...): the words of the vocabulary in each text, and how many words each stands behind the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get

        def lists(parts: list[np.ndarray], ends: list[int]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))

        for b in batches:
            first, ends, ids, gaps = 0, [0], [], []
            for k, t in enumerate(b.column(0)):
                words = words_of(t.as_py())
                found = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(found >= 0)
                ids.append(found[at])
                gaps.append(np.diff(at, prepend=-1).astype(np.int32))
                ends.append(ends[-1] + len(at))
                if k + 1 - first == ROWS or ends[-1] >= TERMS or k + 1 == len(b):
                    part = b.slice(first, k + 1 - first)
                    yield pa.record_batch([lists(ids, ends), lists(gaps, ends), *part.columns[1:]], names=["id", "gap", *part.schema.names[1:]])
                    first, ends, ids, gaps = k + 1, [0], [], []

    return run


def tokenised(docs: DataFrame, vocabulary: dict[str, int], *keys: str) -> DataFrame:
    """(id, gap, keys) of every row of docs, written to the shared folder: see :func:`_tokenised`."""
    rows = docs.select(F.col("text").cast("string").alias("text"), *keys)
    schema = StructType().add("id", ArrayType(IntegerType())).add("gap", ArrayType(IntegerType()))
    for f in rows.schema.fields[1:]:
        schema = schema.add(f)
    return stage(rows.mapInArrow(_tokenised(vocabulary), schema), "terms")


def document_frequencies(terms: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many rows of terms (see :func:`tokenised`) each of size terms occurs, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(size, np.int64), 0
        for b in batches:
            for k in range(0, len(b), ROWS):
                part = b.column(0).slice(k, ROWS)
                n += len(part)
                row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                found += np.bincount(np.unique(row * size + part.flatten().to_numpy()) % size, minlength=size)
        some = np.flatnonzero(found)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(found[some], n))], names=["id", "n"])

    got = terms.select("id").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each term of the benchmark
    out, n = np.zeros(size, np.int64), 0
    for i, x in zip(got.column("id").to_pylist(), got.column("n").to_pylist(), strict=True):
        if i < 0:
            n = x
        else:
            out[i] = x
    return out, n


def randomised_svd(rows: DataFrame, n_terms: int, rank: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (terms x rank) and singular values of a sparse matrix, rows of (cols array<int>, vals array<double>).

    Range finder with power rounds (Halko, Martinsson and Tropp, 2011): each round is a pass over the distributed rows that sums
    A'(A V), a terms x rank matrix, from one partial sum per partition.
    """

    def times(v: np.ndarray, gram: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((v.shape[1], v.shape[1]) if gram else v.shape)
            for b in batches:
                for cols, vals in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if cols:
                        y = np.asarray(vals) @ v[cols]
                        if gram:
                            out += np.outer(y, y)
                        else:
                            out[cols] += np.outer(vals, y)
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["part"])

        return run

    def total(v: np.ndarray, gram: bool = False) -> np.ndarray:
        parts = rows.mapInArrow(times(v, gram), "part binary").collect()
        return sum(np.frombuffer(r["part"]) for r in parts).reshape(-1, v.shape[1])

    v = np.random.default_rng(seed).standard_normal((n_terms, rank))
    for _ in range(rounds + 1):
        v = np.linalg.qr(total(v))[0]
    values, turn = np.linalg.eigh(total(v, gram=True))
    order = np.argsort(-values)
    return v @ turn[:, order], np.sqrt(np.maximum(values[order], 0))


def passage_starts(n: int, size: int) -> list[int]:
    """Where the passages of an item of n words begin: the last one ends with the item."""
    return [*range(0, max(1, n - size + 1), size), *([n - size] if n > size and n % size else [])]


def fit_model(spark: SparkSession, items: list[Item], vocabulary: dict[str, int], df: np.ndarray, n_docs: int, config: DecontaminationConfig) -> Model:
    """The latent space of a block of items, its passages in it, and the postings of its items."""
    idf = 1 + np.log((1 + n_docs) / (1 + df))
    known = [(i.item_id, [vocabulary[w] for w in i.words], [vocabulary[w] for w in i.answer]) for i in items]
    terms = sorted({w for _, words, _ in known for w in words})
    term = np.full(len(vocabulary), -1, np.int32)
    term[terms] = np.arange(len(terms))
    vectors, owner = [], []
    for k, (_, words, _) in enumerate(known):
        for at in passage_starts(len(words), config.passage) if len(words) >= config.least_words else ():
            counts = Counter(words[at : at + config.passage])
            vals = np.array([c * idf[w] for w, c in counts.items()])
            vectors.append((term[list(counts)].tolist(), (vals / np.linalg.norm(vals)).tolist()))
            owner.append(k)
    latent, passages = np.zeros((len(terms), 1)), np.zeros((0, 1))
    if vectors:
        frame = spark.createDataFrame(vectors, "cols array<int>, vals array<double>").repartition(-(-len(vectors) // 1024))
        v, values = randomised_svd(frame, len(terms), min(config.rank, len(vectors), len(terms)), config.power_rounds, config.seed)
        v = v[:, values > 1e-6 * max(values[0], 1e-12)]
        passages = np.array([np.asarray(vals) @ v[cols] for cols, vals in vectors])
        passages /= np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-12)
        latent = v * idf[terms][:, None]
    width = np.array([next((w for w in config.windows if w >= min(len(words), config.passage)), config.windows[-1]) for _, words, _ in known])
    bags = [bag(words, df, share_needed(len(words), config)) for _, words, _ in known]
    posted = np.array(sorted((w, k) for k, b in enumerate(bags) for w in b.rare.tolist()), dtype=np.int64).reshape(-1, 2)
    ends = np.searchsorted(posted[:, 0], np.arange(len(vocabulary) + 1))
    first = np.searchsorted(owner, np.arange(len(known) + 1))
    span = width + 2 * np.array([b.n for b in bags])
    return Model(known, term, latent.astype(np.float32), passages.astype(np.float32), first, width, ends, posted[:, 1], bags, np.array([b.few for b in bags]), span)


def share_needed(n: int, config: DecontaminationConfig) -> float:
    """The share of an item's n words that has to stand in a window and its surroundings for the checks to pass."""
    return min(config.lcs, config.lcs_paraphrase) if n >= config.least_words else 1.0


def bag(words: list[int], df: np.ndarray, needed: float) -> Bag:
    """What holds needed of the words holds, without the commonest words (up to half of needed), the rest of needed of the others."""
    terms, times = np.unique(words, return_counts=True)
    order = np.argsort(-df[terms], kind="stable")
    common = np.cumsum(times[order]) <= needed * len(words) / 2
    few = int(np.ceil(needed * len(words) - times[order[common]].sum() - 1e-6))
    return Bag(len(words), terms, times, np.sort(terms[order[~common]]), max(1, few))


def within_reach(ids: np.ndarray, at: np.ndarray, model: Model) -> dict[int, np.ndarray]:
    """The items of which the row has ``few`` of the rarer words close enough together, and the places of these words."""
    n = model.ends[ids + 1] - model.ends[ids]
    total = int(n.sum())
    if not total:
        return {}
    item = model.posted[np.repeat(model.ends[ids] - np.cumsum(n) + n, n) + np.arange(total)]
    order = np.argsort(item, kind="stable")
    item, place = item[order], np.repeat(at, n)[order]
    last = np.arange(total) + model.few[item] - 1
    some = np.flatnonzero(last < total)
    last = last[some]
    near = (item[last] == item[some]) & (place[last] - place[some] < model.span[item[some]])
    found = np.unique(item[some[near]])
    low, high = np.searchsorted(item, found), np.searchsorted(item, found, side="right")
    return {k: place[a:z] for k, a, z in zip(found.tolist(), low.tolist(), high.tolist(), strict=True)}


def windows_within_reach(place: np.ndarray, ids: np.ndarray, at: np.ndarray, item: Bag, width: int, needed: float) -> list[int]:
    """The starts of windows around which an item has as many words as the checks ask for; place has its rarer words.

    Words that stand there count as often as the item has them; the longest common subsequence is at most that.
    """
    starts = np.arange(0, max(1, int(at[-1]) + 1 - width // 2), width // 2)
    some = np.searchsorted(place, starts + width + item.n) - np.searchsorted(place, starts - item.n) >= item.few
    out = []
    for start in starts[some].tolist():
        low, high = np.searchsorted(at, (start - item.n, start + width + item.n))
        around = ids[low:high]
        column = np.minimum(np.searchsorted(item.terms, around), len(item.terms) - 1)
        held = np.bincount(column[item.terms[column] == around], minlength=len(item.terms))
        if np.minimum(held, item.times).sum() >= needed * item.n - 1e-6:
            out.append(start)
    return out


def candidates(ids: np.ndarray, at: np.ndarray, reach: dict[int, np.ndarray], model: Model, config: DecontaminationConfig) -> dict[int, list[tuple[int, int, float]]]:
    """By item of reach, the windows (start, width, cosine) that are close to one of its passages, of those that can pass the checks at all."""
    out: dict[int, list[tuple[int, int, float]]] = {}
    for k, place in reach.items():
        own = model.passages[model.first[k] : model.first[k + 1]]
        if not len(own):
            continue
        width = int(model.width[k])
        for start in windows_within_reach(place, ids, at, model.bags[k], width, share_needed(model.bags[k].n, config)):
            low, high = np.searchsorted(at, (start, start + width))
            term = model.term[ids[low:high]]
            x = model.latent[term[term >= 0]].sum(axis=0)
            cosine = float((own @ x).max()) / max(float(np.linalg.norm(x)), 1e-6)
            if cosine >= config.cosine:
                out.setdefault(k, []).append((start, width, cosine))
    return out


def has_run(ids: np.ndarray, at: np.ndarray, run: list[int]) -> bool:
    n = len(run)
    first = np.flatnonzero(ids[: max(0, len(ids) - n + 1)] == run[0])
    return any(at[k + n - 1] - at[k] == n - 1 and ids[k : k + n].tolist() == run for k in first)


def leaks_in(ids: np.ndarray, at: np.ndarray, model: Model, config: DecontaminationConfig) -> list[tuple[int, float, float, float]]:
    """The items that a row contains: item_id, cosine, lcs, answer (of the window with the greatest lcs among those that pass the checks)."""
    reach = within_reach(ids, at, model)
    if not reach:
        return []
    out, needed = [], min(config.lcs, config.lcs_paraphrase)
    for k, windows in candidates(ids, at, reach, model, config).items():
        item_id, words, answer = model.items[k]
        n, counts, best, seen = len(words), Counter(words), None, {}
        for start, width, cosine in windows:
            low, high = np.searchsorted(at, (start - n, start + width + n))
            if (low, high) not in seen:
                around = ids[low:high].tolist()
                # The item's words that stand around the window at all bound the common subsequence.
                bound = sum(map(counts.__getitem__, counts.keys() & around))
                share = lcs_length(words, around) / n if bound >= needed * n else 0.0
                said = (lcs_length(answer, around) / len(answer) if answer else 1.0) if share >= needed else 0.0
                seen[low, high] = share, said
            share, said = seen[low, high]
            if (share >= config.lcs or share >= config.lcs_paraphrase and said >= config.answer) and (best is None or (share, cosine) > (best[2], best[1])):
                best = (item_id, cosine, share, said)
        if best:
            out.append(best)
    for k in reach:
        item_id, words, _ = model.items[k]
        if len(words) < config.least_words and has_run(ids, at, words):
            out.append((item_id, 1.0, 1.0, 1.0))
    return out


def _searched(models: list[Model], config: DecontaminationConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, rows = [], []
            for k in range(0, len(b), ROWS):
                id_lists, gap_lists = b.column(0).slice(k, ROWS), b.column(1).slice(k, ROWS)
                ends = np.cumsum(id_lists.value_lengths().to_numpy())
                ids, gaps = id_lists.flatten().to_numpy(), gap_lists.flatten().to_numpy()
                for i, (low, high) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
                    own, at = ids[low:high], np.cumsum(gaps[low:high], dtype=np.int64) - 1
                    for model in models:
                        new = leaks_in(own, at, model, config)
                        found += new
                        rows += [k + i] * len(new)
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
            keys = [c.take(pa.array(rows, pa.int64())) for c in b.columns[2:]]
            yield pa.record_batch([*(pa.array([x[j] for x in found], t) for j, t in enumerate(kinds)), *keys], names=["item_id", "cosine", "lcs", "answer", *b.schema.names[2:]])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, *keys: str, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """item_id, cosine, lcs, answer, and the columns named by keys: a row for each row of docs (text) and benchmark item that it contains.

    benchmark has item_id, text and perhaps answer. Rows of it without an id or without words are left out; items of
    equal text are each reported. Null and empty texts contain nothing; repeated rows are reported each; very long texts are searched
    whole; without documents or a benchmark there are no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks = list(item_blocks(benchmark, config.block_items))
    vocabulary = {w: k for k, w in enumerate(sorted({w for b in blocks for i in b for w in (*i.words, *i.answer)}))}
    terms = tokenised(docs, vocabulary, *keys)
    schema = StructType().add("item_id", "long").add("cosine", "double").add("lcs", "double").add("answer", "double")
    for f in terms.schema.fields[2:]:
        schema = schema.add(f)
    df, n_docs = document_frequencies(terms, max(1, len(vocabulary)))
    models = [fit_model(spark, b, vocabulary, df, n_docs, config) for b in blocks]
    return terms.mapInArrow(_searched(models, config), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer: a row for each row of docs (doc_id, text) and benchmark item that it contains."""
    found = leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, "doc_id", config=config)
    return found.select("doc_id", "item_id", "cosine", "lcs", "answer")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
