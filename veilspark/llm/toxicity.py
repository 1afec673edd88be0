"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features (operator 8).

P(grade <= k | x) = sigmoid(theta_k - w x): one weight vector w for all thresholds theta_0 < theta_1 < theta_2.
Features are words and word beginnings (3 to 7 letters), each valued log(1 + occurrences per 100 words).
The labels say only toxic or not, so the grades of toxic rows are thirds of the density of the features that
are most distinctive of toxic rows (1 mild, 2 strong, 3 severe); rows that aren't toxic have grade 0.

The model is fitted on the driver to at most ``sample_rows`` labelled rows, which bounds all that is collected
(sample_rows x features numbers); scoring runs over every row, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import ship, stage, table

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 8)
GRADES = 4
#: Words added to a text's length, so that one occurrence in a very short text isn't a high rate.
SMOOTH = 40


@dataclass(frozen=True)
class ToxicityConfig:
    sample_rows: int = 8000
    features: int = 400
    least_toxic_rows: int = 4
    steps: int = 400
    l2: float = 1e-3
    threshold: float = 0.5


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def feature_counts(text: str | None) -> tuple[Counter, int]:
    """Occurrences of each feature in the whole text, and its number of words."""
    words = Counter(LETTERS.findall((text or "").lower()))
    out: Counter = Counter()
    for word, n in words.items():
        for f in features_of(word):
            out[f] += n
    return out, sum(words.values())


def value(occurrences: int, words: int) -> float:
    return math.log1p(100.0 * occurrences / (words + SMOOTH))


@dataclass
class OrdinalModel:
    """weights by feature, and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, text: str | None, cache: dict[str, tuple[str, ...]]) -> float:
        words = Counter(LETTERS.findall((text or "").lower()))
        found: Counter = Counter()
        for word, n in words.items():
            known = cache.get(word)
            if known is None:
                known = cache[word] = tuple(f for f in features_of(word) if f in self.weights)
            for f in known:
                found[f] += n
        total = sum(words.values())
        return sum(self.weights[f] * value(n, total) for f, n in found.items())

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2: a row for each score."""
        if not self.weights:
            return np.zeros((len(scores), GRADES - 1))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, n_features: int, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised likelihood; rows, cols and vals are the sparse features.

    The thresholds are a first one and the logarithms of the gaps to the next, so they stay in order.
    """
    n, w = len(grade), np.zeros(n_features)
    raw = np.array([1.0, 0.0, 0.0])
    m, v = np.zeros(n_features + 3), np.zeros(n_features + 3)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, config.steps + 1):
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        edges = np.concatenate([[-1e9], theta, [1e9]])
        score = np.bincount(rows, weights=vals * w[cols], minlength=n)
        upper, lower = sig(edges[grade + 1] - score), sig(edges[grade] - score)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_score = (du - dl) / n
        g_w = np.bincount(cols, weights=vals * g_score[rows], minlength=n_features) + config.l2 * w
        g_theta = np.array([(dl[grade == k + 1].sum() - du[grade == k].sum()) / n for k in range(3)])
        gaps = np.exp(raw[1:])
        g = np.concatenate([g_w, [g_theta.sum(), gaps[0] * g_theta[1:].sum(), gaps[1] * g_theta[2]]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, raw = w - move[:n_features], raw - move[n_features:]
    return w, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for t, x in _rows(batches):
        (toxic if t else clean).update(feature_counts(x)[0].keys())
    names = list(toxic)  # a feature that only clean rows have is never chosen
    yield pa.record_batch([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([clean[f] for f in names], pa.int64())], names=["feature", "toxic_rows", "clean_rows"])


def _vectors(chosen: list[str]):
    at = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for t, x in _rows(batches):
            counts, words = feature_counts(x)
            known = [(at[f], value(n, words)) for f, n in counts.items() if f in at]
            out.append((int(t), [i for i, _ in known], [y for _, y in known]))
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()))
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["toxic", "cols", "vals"])

    return run


def sizes(sample: DataFrame) -> dict[int, int]:
    """Rows by label."""
    return {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> OrdinalModel:
    """Fit to the labelled rows of docs (doc_id, text), labels (doc_id, toxic 0/1).

    Which labelled rows are in the sample depends on a hash of their doc_id alone. Rows with a null label, id or text are
    left out. The bound holds for rows, also where many share an id. Without rows of both kinds the model has no weights and calls nothing toxic.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    # The labels joined are at most sample_rows pairs of numbers, so they may be broadcast.
    sample = stage(texts.join(F.broadcast(known), "doc_id").select("toxic", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")), "labelled")
    size = sizes(sample)
    if sum(size.values()) > config.sample_rows:
        # Rows that repeat an id would exceed the bound: repeated texts count once, and the first rows by the two hashes stay.
        one = stage(sample.dropDuplicates(["h", "t"]), "labelled")
        last = one.select("h", "t").orderBy("h", "t").limit(config.sample_rows).agg(F.max(F.struct("h", "t")).alias("x")).first()["x"]
        sample = one.filter((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("t") <= last["t"]))
        size = sizes(sample)
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return OrdinalModel({}, np.zeros(GRADES - 1))
    sample = sample.select("toxic", "text")
    stats = sample.mapInArrow(_statistics, "feature string, toxic_rows long, clean_rows long").groupBy("feature").agg(F.sum("toxic_rows").alias("a"), F.sum("clean_rows").alias("b"))
    p, q = F.col("a") / n1, F.col("b") / n0
    mean = (F.col("a") + F.col("b")) / (n1 + n0)
    z = (p - q) / F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    best = stats.filter(F.col("a") >= config.least_toxic_rows).withColumn("z", z).orderBy(F.desc("z"), "feature").limit(config.features).collect()
    chosen = [r["feature"] for r in best]
    if not chosen:
        return OrdinalModel({}, np.zeros(GRADES - 1))
    got = sample.mapInArrow(_vectors(chosen), "toxic int, cols array<int>, vals array<double>").toArrow().combine_chunks()
    lists, values = (pa.chunked_array(got.column(k)).combine_chunks() for k in (1, 2))
    rows = np.repeat(np.arange(len(got)), np.diff(lists.offsets.to_numpy()))
    cols, vals = lists.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy()
    toxic = got.column(0).to_numpy()
    distinctive = np.array([r["a"] / n1 > 10 * r["b"] / n0 for r in best])
    density = np.bincount(rows, weights=vals * distinctive[cols], minlength=len(toxic))
    cuts = np.quantile(density[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, density, side="right"), 0)
    w, thresholds = fit_ordinal(rows, cols, vals, grade, len(chosen), config)
    return OrdinalModel({f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-6}, thresholds)


def severity(model: OrdinalModel, text: Column, config: ToxicityConfig = ToxicityConfig()) -> Column:
    """A struct of p_toxic, severity (the expected grade, 0 to 3), grade (the most likely one) and toxic."""
    threshold = config.threshold

    @F.arrow_udf("struct<p_toxic:double,severity:double,grade:int,toxic:boolean>")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, tuple[str, ...]] = {}
        for part in texts:
            if len(cache) > 500_000:
                cache.clear()
            above = model.above(np.array([model.score(t.as_py(), cache) for t in part]))
            each = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
            p = above[:, 0] if len(above) else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(p), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p >= threshold)], names=["p_toxic", "severity", "grade", "toxic"])

    return score(text)


def score_toxicity(docs: DataFrame, model: OrdinalModel, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, p_toxic, severity, grade, toxic for every row of docs (doc_id, text).

    Null and empty texts have no features and score like a text without any known one. Repeated rows are
    scored alike; other columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), severity(model, F.col("text").cast("string"), config).alias("s"))
    return rows.select("doc_id", "s.p_toxic", "s.severity", "s.grade", "s.toxic")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
