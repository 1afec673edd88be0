import random
from collections import Counter, defaultdict

import pytest

from veilspark import queries
from veilspark.operators.evaluation import evaluate
from veilspark.plans import staging

SCHEMA = "case_id string, label string, text string, start int, end int"
TEXTS = ["item 3", "ITEM  3", "the item 3 here", "Иванов Иван", "иванов", "id 770-7083893", "7707083893", "chat 770-7083893!", "else", "", "x"]


def spans(r, n, offsets):
    """Distinct starts within a case and label, as ties leave the order open; a case of many spans, null keys, gold without offsets."""
    rows = {}
    for _ in range(n):
        case, label, start = r.choice(["long", "long", "a", "b", "c", None]), r.choice(["PERSON", "RU_INN", "IP_ADDRESS", None]), r.randrange(0, 200)
        at = (None, None) if not offsets and r.random() < 0.1 else (start, start + r.randint(1, 12))
        rows[case, label, at[0]] = (case, label, r.choice(TEXTS), *at)
    return list(rows.values())


def same(a, b):
    a, b = (" ".join(t.split()).casefold() for t in (a, b))
    x, y = ("".join(c for c in t if c.isdigit() or c == "-") for t in (a, b))
    return bool(a and b) and (a == b or len(a) >= 4 and a in b or len(b) >= 4 and b in a or len(x) >= 8 and x in y or len(y) >= 8 and y in x)


def iou(g, p):
    if g[3] is None:
        return float(" ".join(g[2].split()).casefold() == " ".join(p[2].split()).casefold())
    common = min(g[4], p[4]) - max(g[3], p[3])
    return common / (max(g[4], p[4]) - min(g[3], p[3])) if common > 0 else 0.0


def plainly(g, p, mode):
    """True positives of one case and label, over all pairs."""
    if mode == "exact":
        return sum((Counter(s[3:] for s in g if s[3] is not None) & Counter(s[3:] for s in p)).values())
    g, p = (sorted(s, key=lambda s: s[3] or 0) for s in (g, p))
    used_g, used_p = set(), set()
    if mode == "overlap":
        for score, i, j in sorted(((iou(x, y), i, j) for i, x in enumerate(g) for j, y in enumerate(p)), reverse=True):
            if score >= 0.5 and i not in used_g and j not in used_p:
                used_g.add(i)
                used_p.add(j)
        return len(used_g)
    for i in sorted(range(len(g)), key=lambda i: -len(g[i][2])):
        fits = [j for j in range(len(p)) if j not in used_p and same(g[i][2], p[j][2])]
        if fits:
            used_g.add(i)
            used_p.add(max(fits, key=lambda j: (len(p[j][2]), -j)))
    return len(used_g)


def expected(gold, predicted, mode):
    groups = defaultdict(lambda: ([], []))
    for k, rows in enumerate((gold, predicted)):
        for s in rows:
            groups[s[:2]][k].append(s)
    found, cases = Counter(), defaultdict(lambda: [0, 0, 0])
    for (case, label), (g, p) in groups.items():
        tp = plainly(g, p, mode) if case is not None and label is not None else 0
        found[case, label, tp, len(p) - tp, len(g) - tp] += 1
        cases[case] = [a + b for a, b in zip(cases[case], (tp, len(p) - tp, len(g) - tp), strict=True)]
    return found + Counter((case, None, *sums) for case, sums in cases.items())


@pytest.fixture
def few_rows(spark):
    """Arrow batches of a few rows, so that cases go on from one to the next, and a single shuffle partition."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def agrees_in_tasks_by_size(spark, tmp_path, monkeypatch, mode):
    r = random.Random(7)
    gold, predicted = spans(r, 300, offsets=False), spans(r, 300, offsets=True)
    gold, predicted = (gold + gold[:9], predicted + predicted[:5]) if mode == "exact" else (gold, predicted)
    read = []
    for name, rows in (("gold", gold), ("predicted", predicted)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
        read.append(spark.read.parquet(str(tmp_path / name)))
    monkeypatch.setattr(staging, "TASK_BYTES", 1000, raising=False)
    found = evaluate(*read, mode)
    assert Counter((r.case_id, r.label, r.tp, r.fp, r.fn) for r in found.collect()) == expected(gold, predicted, mode)
    assert found.rdd.getNumPartitions() > 4, "tasks by the size of the input, not by the session's number"


def test_exact_matching_is_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch, few_rows):
    agrees_in_tasks_by_size(spark, tmp_path, monkeypatch, "exact")


def scans(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan")


def test_exact_evaluation_reads_the_lines_once(spark):
    assert scans(spark, "eval_exact") == 1


def test_overlap_matching_is_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch, few_rows):
    agrees_in_tasks_by_size(spark, tmp_path, monkeypatch, "overlap")


def test_overlap_evaluation_reads_the_lines_once(spark):
    assert scans(spark, "eval_overlap") == 1


def test_label_text_matching_is_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch, few_rows):
    agrees_in_tasks_by_size(spark, tmp_path, monkeypatch, "label_text")


def test_label_text_evaluation_reads_the_lines_once(spark):
    assert scans(spark, "eval_label_text") == 1
