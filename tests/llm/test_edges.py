"""Every operator's query and the pipeline over empty tables and over nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re

import corpus_pipeline
import pytest
from veilspark.llm.queries import QUERIES

#: Columns that documents and pages have beside their own, named like columns the operators make.
CLASHING = ("row", "key", "size", "block", "salt", "n", "h", "doc", "toxic", "spans", "component_id", "keep_id", "fetched", "host", "fingerprint", "i")
EXTRA = "".join(f", {c} string" for c in CLASHING)
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long" + EXTRA,
    "pages": "page_id long, url string, html string" + EXTRA,
    "benchmark": "item_id long, text string" + EXTRA,
    "labels": "doc_id long, quality int, toxic int",
}


def _text(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(n))


PLAIN, LONG = _text(1, 90), _text(2, 20000)
DOCUMENTS = [
    (1, PLAIN, "en", "a", 9), (1, PLAIN, "en", "a", 9), (2, PLAIN, "en", None, None), (3, None, None, None, None), (4, "", "en", "", 0),
    (5, " \t\n\x0b\x0c\r ", "en", "b", 6), (6, LONG, "en", "b", 9), (7, "x" * 50000, "en", "b", 9), (8, "один   два три 🙂", "ru", "é", 9),
    (None, _text(3, 60), "en", "a", 9), (None, None, None, None, None), (9, PLAIN.replace(" ", "\n "), "de", "a", 9), (10, _text(4, 3), "en", "c", 9), (11, _text(4, 2), "en", "c", 9),
    (12, "same line here\n" * 400, "en", "c", 9), (13, _text(5, 40), "en", "c", 9),
]
PAGES = [
    (1, "http://a.example/x", "<html><body><article><p>One &amp; two.</p></article></body></html>"), (1, "http://a.example/x", "<html><body><article><p>One &amp; two.</p></article></body></html>"),
    (2, None, None), (3, "", ""), (4, "not a url", "<<<>&&&;</p><p"), (None, None, "<p>" * 3000 + _text(6, 30)), (5, "http://b.example:80/y?z", "plain words only"), (6, "http://[::1]/", "<script>" + LONG[:20000]),
]
BENCHMARK = [(1, _text(7, 30) + "."), (1, _text(7, 30) + "."), (2, None), (3, ""), (None, _text(8, 30) + "."), (4, "one")]
LABELS = [(1, 1, 0), (13, None, None), (None, 1, 1), (99, 0, 1), (13, 1, 0)]


def _put(spark, folder, rows):
    for name, schema in SCHEMAS.items():
        more = ("clash",) * (len(CLASHING) if EXTRA in schema else 0)
        spark.createDataFrame([(*r, *more) for r in rows.get(name, [])], schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd") / "tables")
    _put(spark, folder, {"documents": DOCUMENTS, "pages": PAGES, "benchmark": BENCHMARK, "labels": LABELS})
    return folder


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bare") / "tables")
    _put(spark, folder, {})
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, bare, name):
    assert QUERIES[name](spark, bare).collect() == []


def test_pipeline_of_empty_tables(spark, bare):
    assert corpus_pipeline.run(spark, bare).collect() == []


def test_one_row_for_every_document_or_page(spark, odd):
    found = {n: QUERIES[n](spark, odd).collect() for n in ("op2_mixing", "op3_html_extraction", "op4_substring_dedup", "op5_simhash", "op6_url_filters", "op10_exact_dedup")}
    ids = lambda rows, c: sorted((x[c] for x in rows), key=str)
    for name, rows in found.items():
        pages = name in ("op3_html_extraction", "op6_url_filters")
        assert ids(rows, "page_id" if pages else "doc_id") == sorted((r[0] for r in (PAGES if pages else DOCUMENTS)), key=str), name


def test_exact_groups(spark, odd):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = QUERIES["op10_exact_dedup"](spark, odd).collect()
    groups = {}
    for i, t, *_ in DOCUMENTS:
        groups.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append(i)
    for x in rows:
        group = groups[x.text_sha256]
        known = [i for i in group if i is not None]
        assert x.group_size == len(group)
        if known:
            assert x.keep_id == min(known)
    assert {h: len(g) for h, g in groups.items()} == {h: sum(x.text_sha256 == h for x in rows) for h in groups}
    for h in groups:
        assert sum(x.kept for x in rows if x.text_sha256 == h) >= 1


def test_substring_bytes(spark, odd):
    sizes = sorted(len((t or "").encode()) for _, t, *_ in DOCUMENTS)
    rows = QUERIES["op4_substring_dedup"](spark, odd).collect()
    assert sorted(x.n_bytes for x in rows) == sizes
    by_id = {x.doc_id: x for x in rows}
    assert by_id[7].n_removed == 50000 and by_id[1].n_removed == len(PLAIN) and by_id[6].n_removed == 0
    assert by_id[3].kept_sha256 == by_id[4].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_simhash_of_empty_documents(spark, odd):
    by_id = {x.doc_id: x for x in QUERIES["op5_simhash"](spark, odd).collect() if x.doc_id is not None}
    assert by_id[3].fingerprint == by_id[4].fingerprint == by_id[5].fingerprint == "0" * 16
    assert by_id[5].component_id == by_id[4].component_id == by_id[3].component_id
    assert by_id[2].component_id == by_id[9].component_id == 1


def test_mixing_sizes(spark, odd):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = QUERIES["op2_mixing"](spark, odd).collect()
    assert sorted(x["size"] for x in rows) == sorted(size(t) for _, t, *_ in DOCUMENTS)
    assert all(x.taken <= 3 * x["size"] for x in rows)


@pytest.mark.parametrize("name", ["op1_decontamination", "op7_line_dedup", "op8_toxicity", "op9_token_counts"])
def test_odd_rows(spark, odd, name):
    assert all(x is not None for x in QUERIES[name](spark, odd).collect())


def test_pipeline_of_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, odd)
        assert docs.columns == spark.read.parquet(f"{odd}/documents.parquet").columns, name
    kept = {x.doc_id for x in corpus_pipeline.run(spark, odd).collect()}
    assert {1, 6, 7, 13, None} <= kept and not kept & {2, 9}


def test_line_dedup_texts(spark, odd, tmp_path):
    """The digests of the texts that op7 leaves, and its counts, against all pairs of lines."""
    near = PLAIN.replace(PLAIN.split()[7], "qq", 1)
    more = [
        (20, f"\n \t\n{near}\r\n{near}\n\x0b\nnew\tline  here \n", "en", "a", 9), (21, f"{PLAIN}  \n{near} zz", "en", "a", 9), (22, f"\n{PLAIN}\n\n", "en", "a", 9),
        (23, "new line here\nlast\n\xa0", "en", "a", 9), (24, " ".join(PLAIN.split()[1:]) + "\nsame line here\nnew line  here", "en", "a", 9),
    ]
    folder = str(tmp_path / "tables")
    _put(spark, folder, {"documents": DOCUMENTS + more})

    def is_near(a, b):
        if len(a) == len(b) >= 8:
            return sum(x != y for x, y in zip(a, b)) <= 1
        short, long = sorted((a, b), key=len)
        return len(short) >= 8 and len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    for where, documents in ((odd, DOCUMENTS), (folder, DOCUMENTS + more)):
        seen, want = [], []
        for i, t, *_ in sorted(documents, key=lambda r: (r[0] is None, r[0] or 0)):
            left, n_lines, n_near, n_kept = [], 0, 0, 0
            for line in (t or "").split("\n"):
                w = re.findall(r"[^\x20\x09-\x0D]+", line)
                n_lines += bool(w)
                if w and w in seen:
                    continue
                goes = bool(w) and any(is_near(v, w) for v in seen)
                n_near += goes
                n_kept += bool(w) and not goes
                if w:
                    seen.append(w)
                if not goes:
                    left.append(line)
            want.append((i, n_lines, n_near, n_kept, hashlib.sha256("\n".join(left).encode()).hexdigest()))
        got = [tuple(x) for x in QUERIES["op7_line_dedup"](spark, where).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert sum(x[2] for x in want) == (0 if where == odd else 3)
