import random

import corpus_pipeline
def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    bad = ["zorgh", "plimf", "vraxy"]
    clean = [(i, words(r, 80), "en", "a" if i % 3 else "b", 0) for i in range(60)]
    toxic = [(100 + i, words(r, 40) + " " + " ".join(r.choice(bad) for _ in range(6)), "en", "a", 0) for i in range(60)]
    item = words(r, 30) + "."
    copies = [(200, clean[5][1], "en", "a", 0), (201, "  ".join(clean[6][1].split(" ")), "en", "b", 0), (202, clean[7][1] + " .", "en", "b", 0)]
    leak = [(300, words(r, 60) + " " + item + " " + words(r, 60), "en", "a", 0)]
    odd = [(400, None, None, None, None), (401, "", "en", "a", 0), (None, words(r, 50), "en", "a", 0)]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put([*clean, *toxic, *copies, *leak, *odd], COLUMNS, "documents")
    put([(i, 1, 0) for i in range(40)] + [(100 + i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int", "labels")
    put([(0, item)], "item_id long, text string", "benchmark")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {x.doc_id for x in out}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "mixing"]
    assert {i for i, *_ in clean} <= ids and None in ids
    assert not ids & {*range(100, 160), 200, 201, 300}
    assert sum(x.taken for x in out) <= 3 * sum(x.size for x in out)


def test_copies_with_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(14)
    a, b, c, d, e = (words(r, 80) for _ in range(5))
    rows = [(1, a), (1, a), (None, b), (None, b), (2, c), (3, c), (3, d), (None, e), (7, e), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], COLUMNS)
    key = lambda out: sorted(((x.doc_id, x.text) for x in out.collect()), key=str)
    want = sorted([(1, a), (None, b), (2, c), (3, d), (7, e), (None, None)], key=str)
    assert key(corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path))) == want
    near = spark.createDataFrame([(i, t and t + " tail" * (k % 2), "en", "a", 0) for k, (i, t) in enumerate(rows)], COLUMNS)
    out = corpus_pipeline.drop_near_copies(spark, near, str(tmp_path)).collect()
    found = sorted(((x.doc_id, x.text and x.text.removesuffix(" tail")) for x in out), key=str)
    assert found == want
