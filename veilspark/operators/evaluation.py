"""Evaluation of spans against gold: exact, overlap and label-and-text matching; precision, recall, F1.

gold (case_id, label, text, start, end: null where unknown), predicted (case_id, label, text, start, end).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from veilspark.plans.staging import ship, tasks_for


def prf(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1 to tp, fp, fn: nothing predicted and no gold is precision 1; no gold and nothing predicted recall 1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).when(fn == 0, 1.0).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).when(fp == 0, 1.0).otherwise(0.0)
    out = counts.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    out = out.withColumn("f1", f1)
    return out.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def restrict(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions whose label the case's gold has."""
    return predicted.join(gold.select("case_id", "label").distinct(), ["case_id", "label"], "left_semi")


def tagged(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Both as one table, with i (the order within a case and label: the column i, or else the start) and gold, which tells them apart."""

    def side(df: DataFrame, gold: bool) -> DataFrame:
        i = F.col("i") if "i" in df.columns else F.coalesce("start", F.lit(0))
        return df.select("case_id", "label", "text", F.col("start").cast("long"), F.col("end").cast("long"), i.cast("long").alias("i"), F.lit(gold).alias("gold"))

    return side(gold, True).unionByName(side(predicted, False))


def _totals(per_label: DataFrame) -> DataFrame:
    """Per case and label, and per case (label null), from a row for each case and label, dealt by case: the last label's running sums are the case's."""
    kind, by_label = per_label.schema["label"].dataType, Window.partitionBy("case_id").orderBy("label")
    so_far = by_label.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.struct("label", "tp", "fp", "fn")
    whole = F.struct(F.lit(None).cast(kind).alias("label"), *(F.sum(c).over(so_far).alias(c) for c in ("tp", "fp", "fn")))
    rows = per_label.select("case_id", own.alias("own"), whole.alias("whole"), F.lead(F.lit(1)).over(by_label).isNull().alias("last"))
    return prf(rows.select("case_id", F.explode(F.when(F.col("last"), F.array("own", "whole")).otherwise(F.array("own"))).alias("m")).select("case_id", "m.*"))


def _exact(spans: DataFrame, tasks: int) -> DataFrame:
    """Equal spans meet in one task, those of a long case by stretches of its text, so that neither a case nor a label has to fit one."""
    placed = F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("case_id").isNotNull() & F.col("label").isNotNull()
    far = F.coalesce(F.shiftright("start", 16), F.lit(0)).alias("far")
    one = lambda c, name: F.when(c, 1).otherwise(0).alias(name)
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    rows = spans.select("case_id", "label", far, "start", "end", one(F.col("gold"), "g"), one(~F.col("gold"), "p")).repartition(tasks, "case_id", "label", "far")
    met = rows.groupBy("case_id", "label", "far", "start", "end").agg(*sums("g", "p"))
    tp = F.when(placed, F.least("g", "p")).otherwise(0)
    found = met.select("case_id", "label", "far", tp.alias("tp"), (F.col("p") - tp).alias("fp"), (F.col("g") - tp).alias("fn"))
    stretches = found.groupBy("case_id", "label", "far").agg(*sums("tp", "fp", "fn"))
    return stretches.repartition(tasks, "case_id").groupBy("case_id", "label").agg(*sums("tp", "fp", "fn"))


def overlap_candidates(gold: DataFrame, predicted: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Pairs of a case and label with an intersection over union of at least least_iou."""
    g = gold.select("case_id", "label", F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("text").alias("gt"))
    p = predicted.select("case_id", "label", F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("text").alias("pt"))
    tasks, keys = max(tasks_for(gold), tasks_for(predicted)), ["case_id", "label"]
    pairs = g.repartition(tasks, *keys).join(p.repartition(tasks, *keys), keys).filter((F.col("gs") < F.col("pe")) & (F.col("ge") > F.col("ps")))
    common = F.least("ge", "pe") - F.greatest("gs", "ps")
    return pairs.withColumn("iou", common / (F.greatest("ge", "pe") - F.least("gs", "ps"))).filter(F.col("iou") >= least_iou)


@lru_cache(4096)
def _norm(t: str) -> str:
    return " ".join(t.split()).casefold()


@lru_cache(4096)
def _core(t: str) -> str:
    return "".join(c for c in t if c.isdigit() or c == "-")


def _same(a: str, b: str) -> bool:
    """Of two normalised texts."""
    if not a or not b:
        return False
    if a == b:
        return True
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) >= 4 and short in long:
        return True
    x, y = _core(a), _core(b)
    if len(x) > len(y):
        x, y = y, x
    return len(x) >= 8 and x in y


#: A span in Python: start, end, text.
Span = tuple[int | None, int | None, str]


def _iou(g: Span, p: Span) -> float:
    """Gold without offsets counts by its text."""
    if g[0] is None or g[1] is None:
        return float(_norm(g[2]) == _norm(p[2]))
    if p[0] is None or p[1] is None:
        return 0.0
    common = min(g[1], p[1]) - max(g[0], p[0])
    return common / (max(g[1], p[1]) - min(g[0], p[0])) if common > 0 else 0.0


def _overlapping(gold: list[Span], predicted: list[Span], least_iou: float) -> int:
    """Pairs of the greedy matching by intersection over union, best first; of equal ones the last.

    Only predictions that can reach least_iou are looked at: they start before the gold span's end, and at most its length / least_iou before it.
    """
    by_start = sorted((p[0], j) for j, p in enumerate(predicted) if p[0] is not None and p[1] is not None)
    longest = max((predicted[j][1] - s for s, j in by_start), default=0)
    pairs = []
    for i, g in enumerate(gold):
        near: Iterable[int] = range(len(predicted))
        if least_iou > 0 and g[0] is not None and g[1] is not None:
            at = bisect_left(by_start, (max(g[0] - longest, g[1] - int((g[1] - g[0]) / least_iou) - 2),))
            near = (j for _, j in takewhile(lambda x: x[0] < g[1], islice(by_start, at, None)))
        pairs += [(iou, i, j) for j in near if (iou := _iou(g, predicted[j])) >= least_iou]
    if len(pairs) < 2:
        return len(pairs)
    used_g, used_p = set(), set()
    for _, i, j in sorted(pairs, reverse=True):
        if i not in used_g and j not in used_p:
            used_g.add(i)
            used_p.add(j)
    return len(used_g)


def _saying(gold: list[Span], predicted: list[Span]) -> int:
    """Gold spans that find a prediction of the same text, longest gold first; each takes the longest, of equal ones the first."""
    if len(gold) == len(predicted) == 1:
        return int(_same(_norm(gold[0][2]), _norm(predicted[0][2])))
    left = {j: _norm(p[2]) for j, p in sorted(enumerate(predicted), key=lambda x: -len(x[1][2]))}
    found = 0
    for text in sorted((g[2] for g in gold), key=lambda t: -len(t)):
        said = _norm(text)
        j = next((j for j, other in left.items() if _same(said, other)), None)
        if j is not None:
            del left[j]
            found += 1
    return found


def _greedy(kind: str, least_iou: float):
    """Over rows sorted by case, label, gold first and order: a row of counts for each case and label."""
    matched = _saying if kind == "label_text" else lambda g, p: _overlapping(g, p, least_iou)
    names = ("case_id", "label", "tp", "fp", "fn")

    def firsts(rows: pa.Table) -> np.ndarray:
        """Where a case and label begins."""
        new = np.ones(rows.num_rows, bool)
        new[1:] = False
        for name in ("case_id", "label"):
            c = rows[name].combine_chunks()
            a, b = c[1:], c[:-1]
            new[1:] |= pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False) & ~(pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
        return np.flatnonzero(new)

    def counted(rows: pa.Table) -> pa.RecordBatch:
        at = firsts(rows)
        n = np.diff(np.append(at, rows.num_rows))
        g = np.add.reduceat(rows["gold"].to_numpy().astype(np.int64), at)
        tp = np.zeros(len(at), np.int64)
        case_id, label = (rows[c].combine_chunks().take(pa.array(at)) for c in ("case_id", "label"))
        known = ~(pc.is_null(case_id).to_numpy(zero_copy_only=False) | pc.is_null(label).to_numpy(zero_copy_only=False))
        spans = list(zip(*(rows[c].to_pylist() if rows[c].null_count else rows[c].to_numpy().tolist() for c in ("start", "end", "text")), strict=True))
        for k in np.flatnonzero((g > 0) & (g < n) & known).tolist():
            tp[k] = matched(spans[at[k] : at[k] + g[k]], spans[at[k] + g[k] : at[k] + n[k]])
        return pa.RecordBatch.from_arrays([case_id, label, *map(pa.array, (tp, n - g - tp, g - tp))], names=names)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the case and label that goes on
        for b in batches:
            if not b.num_rows:
                continue
            seam = [held[-1].slice(held[-1].num_rows - 1), b] if held else [b]
            last = int(firsts(pa.Table.from_batches(seam))[-1]) - bool(held)
            if last < 0 or not held and not last:  # all of it goes on
                held.append(b)
                continue
            yield counted(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = [b.slice(last)]
        if held:
            yield counted(pa.Table.from_batches(held))

    return match


def _matched(spans: DataFrame, kind: str, least_iou: float, tasks: int) -> DataFrame:
    """Matching never crosses labels, so a case's labels are matched apart, as a sorted stream: one case and label in memory at a time."""
    ship(spans.sparkSession)
    rows = spans.withColumn("text", F.coalesce("text", F.lit(""))).repartition(tasks, "case_id", "label")
    rows = rows.sortWithinPartitions("case_id", "label", F.desc("gold"), "i", "start", "end", "text")
    counts = StructType([rows.schema["case_id"], rows.schema["label"]]).add("tp", LongType()).add("fp", LongType()).add("fn", LongType())
    return rows.mapInArrow(_greedy(kind, least_iou), counts).repartition(tasks, "case_id")


def evaluate_exact(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Multiset intersection of (label, start, end); gold without offsets matches nothing."""
    return evaluate_tagged(tagged(gold, predicted), "exact")


def evaluate_overlap(gold: DataFrame, predicted: DataFrame, least_iou: float = 0.5) -> DataFrame:
    return evaluate_tagged(tagged(gold, predicted), "overlap", least_iou)


def evaluate_label_text(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    return evaluate_tagged(tagged(gold, predicted), "label_text")


def evaluate_tagged(spans: DataFrame, mode: str, least_iou: float = 0.5) -> DataFrame:
    """Gold and predictions in one table (see :func:`tagged`): a source of both is read once."""
    tasks = tasks_for(spans)
    if mode == "exact":
        return _totals(_exact(spans, tasks))
    if mode in ("overlap", "label_text"):
        return _totals(_matched(spans, mode, least_iou, tasks))
    raise ValueError(f"unknown mode {mode!r}")


def evaluate(gold: DataFrame, predicted: DataFrame, mode: str = "label_text", gold_labels_only: bool = False, least_iou: float = 0.5) -> DataFrame:
    if gold_labels_only:
        predicted = restrict(predicted, gold)
    return evaluate_tagged(tagged(gold, predicted), mode, least_iou)


def gates(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """Overall metrics of each case beside its minimum thresholds: passed."""
    overall = metrics.filter("label IS NULL")
    return overall.join(cases.select(F.col("id").alias("case_id"), "min_recall", "min_precision", "min_f1"), "case_id").withColumn("passed", (F.col("recall") >= F.col("min_recall")) & (F.col("precision") >= F.col("min_precision")) & (F.col("f1") >= F.col("min_f1")))


def residuals(gold: DataFrame, predicted: DataFrame) -> Iterator[DataFrame]:
    """Gold and predictions that the exact mode leaves unmatched."""
    cols = ["case_id", "label", "start", "end"]
    yield gold.select(cols).exceptAll(predicted.select(cols))
    yield predicted.select(cols).exceptAll(gold.select(cols))
