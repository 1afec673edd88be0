import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import decontamination as dc
from veilspark.llm import golay, html_extraction, line_dedup, mixing, simhash, substring_dedup, token_counts, toxicity, url_filters
from veilspark.llm.common import row_keyed, work_dir
from veilspark.llm.components import connected_components
from veilspark.llm.exact_dedup import DigestIndex, exact_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def frame(spark, texts, source="s"):
    """Documents with an extra column whose name clashes with the operators' own."""
    return spark.createDataFrame([(i, t, "en", source, 0, "x") for i, t in texts], DOCS)


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


def test_exact_dedup_and_its_index(spark):
    d = frame(spark, [(3, "a  b"), (1, "a\tb"), (2, "c"), (4, None), (5, ""), (2, "c"), (None, "z"), (None, "c")])
    index = DigestIndex(spark, work_dir(spark, "i"), 4)
    got = exact_dedup(d, index).collect()
    assert len(got) == 8
    by = {(r.doc_id, r.keep_id, r.group_size) for r in got}
    assert {(3, 1, 2), (1, 1, 2), (2, 2, 3), (4, 4, 2), (5, 4, 2), (None, 2, 3), (None, None, 1)} == by
    assert sum(r.kept for r in got) == 4
    again = exact_dedup(frame(spark, [(9, "a b"), (10, "new")]), index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in again} == {(9, 1, False), (10, 10, True)}
    assert exact_dedup(frame(spark, []), index).count() == 0


def test_mixing_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, None if i % 17 == 0 else words(r, r.choice([0, 1, 5, 300])), "en", r.choice(["a", "b", "c", None, "a", "a"]), 0, "") for i in range(200)]
    out = mixing.mixed_documents(spark.createDataFrame(rows, DOCS), mixing.MixConfig(block_words=16)).collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, *_ in rows}
    total, names = sum(size.values()), ["a", "b", "c", None]
    have = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    weight, target, free = dict(zip(names, (5, 2, 1, 5))), {}, set(names)
    while True:  # cap, and share the excess anew
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * have[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * have[s] for s in over}
        free -= over
    taken = dict.fromkeys(names, 0)
    for x in out:
        s = source[x.doc_id]
        assert x.size == size[x.doc_id] and x.source_size == have[s] and abs(x.target - target[s]) < 1e-6 * total and x.taken <= 3 * x.size
        taken[s] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names) and len(out) == 200
    assert mixing.mixed_documents(frame(spark, [])).count() == 0


def test_mixing_writes_the_words_of_its_blocks(spark):
    r = random.Random(15)
    rows = [(None if i % 9 == 0 else i // 2, words(r, r.choice([0, 1, 7, 120])).replace(" ", " \n", 3), "en", r.choice("abc"), 0, "") for i in range(80)]
    docs = row_keyed(spark.createDataFrame(rows, DOCS), "row")
    sizes, plan, taken = mixing.mix(docs, mixing.MixConfig(block_words=16, shard_words=256))
    text = {x.row: x.text.split() for x in docs.collect()}
    assert sorted(map(" ".join, text.values())) == sorted(" ".join(t.split()) for _, t, *_ in rows)
    due = {(x.shard, x.sid, x.epoch, x.block): x.n_words for x in mixing.slots(plan, mixing.MixConfig(block_words=16, shard_words=256)).collect()}
    got = mixing.blocks(docs, taken).collect()
    assert {(x.shard, x.sid, x.epoch, x.block): len(x.text.split(" ")) for x in got} == due and len(got) == len(due)
    for x in got:
        assert x.text.split(" ") == [w for p in x.pieces for w in text[p.row][p["first"] : p["first"] + p.n_words]] and x.n_words == due[x.shard, x.sid, x.epoch, x.block]


def test_mixing_does_not_depend_on_the_partitioning(spark):
    r = random.Random(16)
    rows = [(None if i % 9 == 0 else i, words(r, r.choice([0, 1, 7, 120])), "en", r.choice("abc"), 0, "") for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    key = lambda d: sorted(((x.doc_id, x.size, x.source_size, x.target, x.taken) for x in mixing.mixed_documents(d, mixing.MixConfig(block_words=16)).collect()), key=str)
    one = key(docs.coalesce(1))
    assert one == key(docs.repartition(7)) == key(docs.repartition(41))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(spark, n):
    d = mixing.keyed(spark.range(n).withColumn("n", F.lit(n).cast("long")).withColumn("key", F.lit(5).cast("long")), "n", "key")
    assert sorted(r.p for r in mixing.permuted(d, "id", "n", "p").collect()) == list(range(n))


def test_golay_keys_meet_at_one_error():
    codes, counts = golay.segment_keys()
    assert set(np.unique(counts)) <= {1, 6}
    r = np.random.default_rng(0)
    for x in r.integers(0, 1 << 16, 300):
        own = set(codes[x, : counts[x]])
        for bit in range(16):
            y = x ^ 1 << bit
            assert own & set(codes[y, : counts[y]])


def test_simhash_against_brute_force(spark):
    r = random.Random(2)
    base = [words(r, 120) for _ in range(12)]
    texts = [None, "", "one", "One", "one two"] + base + [b + " tail" for b in base] + [" ".join(w if r.random() > 0.01 else "zz" for w in b.split()) for b in base for _ in range(4)]
    got = simhash.simhash_components(frame(spark, list(enumerate(texts)))).collect()
    fp = {i: simhash.fingerprint((t or "").encode()) for i, t in enumerate(texts)}
    comp = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            comp[i] = min(comp[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3)
    assert {x.doc_id: (x.fp & (1 << 64) - 1, x.component_id) for x in got} == {i: (fp[i], comp[i]) for i in fp}
    assert any(comp[i] != i for i in fp if i > 16)
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def test_simhash_links_through_rows_without_an_id(spark):
    r = random.Random(17)
    base = words(r, 400).split()
    texts, last = [" ".join(base)], simhash.fingerprint(" ".join(base).encode())
    while len(texts) < 3:  # a chain: each within 3 bits of the one before, the last over 3 bits from the first
        more = [*texts[-1].split(), words(r, 1)]
        more[r.randrange(len(more))] = words(r, 1)
        fp, first = simhash.fingerprint(" ".join(more).encode()), simhash.fingerprint(texts[0].encode())
        if 1 <= (fp ^ last).bit_count() <= 3 and (len(texts) == 1 or (fp ^ first).bit_count() > 3):
            texts, last = [*texts, " ".join(more)], fp
    got = simhash.simhash_components(frame(spark, [(5, texts[0]), (None, texts[1]), (9, texts[2]), (None, words(r, 90))])).collect()
    assert sorted(((x.doc_id, x.component_id) for x in got), key=str) == [(5, 5), (9, 5), (None, 5), (None, None)]
    assert len({x.component for x in got}) == 2


def test_simhash_blocks_lose_no_link(spark):
    r = random.Random(4)
    fps = list({(r.getrandbits(64) & ~0xFF) if k % 40 == 0 else 0xABCDEF << 20 ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for k in range(300)})
    d = spark.createDataFrame([((f ^ 1 << 63) - (1 << 63), i) for i, f in enumerate(fps)], "fp long, rep long")
    whole, cut = (sorted(map(tuple, connected_components(simhash.links(d, block=b)).collect())) for b in (2048, 8))
    assert whole == cut


def test_components_of_a_chain(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert dict(map(tuple, connected_components(d).collect())) == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup_against_brute_force(spark, hot):
    r = random.Random(5)
    passage, other = words(r, 80), "ab" * 300
    texts = [words(r, 60) + passage[: r.randint(150, len(passage))] + words(r, 40) for _ in range(12)] + [passage, passage, other, None, "", "short", words(r, 300)]
    got = {x.doc_id: x for x in substring_dedup.substring_dedup(frame(spark, list(enumerate(texts))), hot).collect()}
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in raw:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert bytes(got[i].kept) == bytes(c for c, g in zip(b, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]))


def test_suffix_sort_orders_suffixes():
    r = random.Random(6)
    text = np.frombuffer("".join(r.choice("ab") for _ in range(1500)).encode(), dtype=np.uint8)
    prefix = substring_dedup.prefix_hashes(text)
    at = np.array(r.sample(range(1200), 300))
    zero, size = np.zeros(300, dtype=np.int64), np.full(300, 300)
    got = substring_dedup.sort_suffixes(text, prefix, at, zero, size)
    assert [text[k : k + 200].tobytes() for k in got] == sorted(text[k : k + 200].tobytes() for k in at)


def test_line_dedup_against_brute_force(spark):
    r = random.Random(7)
    base = [words(r, 12).split() for _ in range(6)]

    def edit(w):
        k, w = r.randrange(len(w)), list(w)
        return r.choice([w[:k] + w[k + 1 :], w[:k] + ["qq"] + w[k:], w[:k] + ["qq"] + w[k + 1 :], w])

    docs = [(i, "\n".join([" ".join(edit(edit(r.choice(base)))) for _ in range(4)] + ["", "short line", "  "])) for i in range(25)] + [(50, None), (51, "")]
    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < line_dedup.LEAST_WORDS or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    lines = [(i, k, x.split()) for i, t in docs for k, x in enumerate((t or "").split("\n"))]
    kept = {i: "\n".join(" ".join(w) for j, k, w in lines if j == i and (not w or not any(w2 and near(w, w2) for j2, k2, w2 in lines if (j2, k2) < (j, k)))) for i, _ in docs}
    got = {x.doc_id: "\n".join(" ".join(y.split()) for y in x.text.split("\n")) for x in line_dedup.deduplicated(frame(spark, docs)).collect()}
    assert got == kept


def test_line_dedup_of_repeated_rows(spark):
    r = random.Random(18)
    a, b = words(r, 12), words(r, 12)
    near = " ".join([*a.split()[:-1], "zz"])
    docs = frame(spark, [(1, f"{a}\n{a}\n{b}"), (1, f"{a}\n{a}\n{b}"), (None, f"{b}\nlast"), (2, near), (None, None)])
    got = sorted(((x.doc_id, x.text) for x in line_dedup.deduplicated(docs).collect()), key=str)
    assert got == sorted([(1, f"{a}\n{b}"), (1, ""), (None, "last"), (2, ""), (None, "")], key=str)


def test_url_filter_as_of(spark):
    events = spark.createDataFrame([("l", "Bad.com", "add", 10), ("l", "bad.com", "remove", 20), ("l", "bad.com", "add", 30), ("m", "x.org/fr", "add", 0), ("l", None, "add", 1), ("l", "t.com", "add", 5), ("l", "t.com", "remove", 5)], "list string, key string, action string, at int")
    caps = spark.createDataFrame([(1, "http://www.bad.com/a", 9), (2, "http://www.bad.com/a", 10), (3, "https://bad.com:80", 20), (4, "http://bad.com", 31), (5, "http://notbad.com", 31), (6, "http://x.org/fr/1", 1), (7, "http://x.org/en/1", 1), (8, None, 1), (9, "http://t.com", 6), (10, "http://bad.com", None)], "page_id long, url string, fetched int")
    got = {r.page_id: r.blocked for r in url_filters.url_filter(caps, url_filters.intervals(events)).collect()}
    assert {k for k, v in got.items() if v} == {2, 4, 6} and len(got) == 10


def test_token_files_round_trip(spark):
    texts = [(5, "Hello world, hello"), (-1, None), (2**62, "é" * 50), (None, ""), (5, "again")]
    path = work_dir(spark, "t")
    token_counts.write_token_files(frame(spark, texts), path)
    encode = token_counts.load_encoder(token_counts.TOKENIZERS).encode_ordinary
    want = sorted(((i is None, i or 0, len(encode(t or ""))) for i, t in texts))
    for block in (3, 1 << 16):
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.scan(spark, path, block).collect()) == want
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_decontamination(spark):
    r = random.Random(8)
    items = [(i, words(r, 30) + ". " + words(r, 8) + ".") for i in range(20)] + [(99, None)]
    clean = [words(r, 200) for _ in range(30)]
    para = items[3][1].split()
    for k in range(2, len(para) - 10, 5):
        para[k] = "other"
    docs = [*enumerate(clean), (100, clean[0] + " " + items[0][1].upper() + " " + clean[1]), (101, clean[2] + " " + " ".join(para) + " " + clean[3]), (102, None), (103, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(frame(spark, docs), bench).collect()}
    assert got == {(100, 0), (101, 3)}
    assert dc.contaminated(frame(spark, docs), bench.limit(0)).count() == 0
    assert dc.lcs_length("a b c d".split(), "x b d y".split()) == 2


def test_decontamination_of_an_item_in_many_documents(spark):
    r = random.Random(12)
    lexicon = words(r, 4000).split()
    prose = lambda n: " ".join(r.choices(lexicon, k=n))
    items = [(i, prose(18) + ". " + prose(6) + ".") for i in range(12)]
    para = items[5][1].split()
    para[2:17:3] = ["other"] * 5
    docs = [(i, prose(90)) for i in range(120)]
    hot = [(200 + i, f"{prose(50)} {items[5][1] if i % 2 else ' '.join(para)} {prose(50)}") for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(frame(spark, [*docs, *hot, (300, f"{prose(50)} {items[7][1]}")]), bench).collect()}
    assert got == {(i, 5) for i, _ in hot} | {(300, 7)}


def test_decontamination_recall_against_brute_force(spark):
    """Every place of every text is held against every item by the checks alone; the search finds at least 0.9 of what they find."""
    r, config = random.Random(19), dc.DecontaminationConfig()
    common = [w * 2 for w in "ab cd ef gh ij kl mn op qr st uv wx yz".split()]  # words that all documents are full of
    lexicon = common * 40 + words(r, 1500).split()
    prose = lambda n, of: [r.choice(of) for _ in range(n)]
    items = [prose(n, common if n % 4 == 0 else lexicon) for n in (8, 9, 12, 16, 17, 24, 31, 33, 48, 64, 65, 90, 100, 130, 150)]
    docs = [prose(r.choice([20, 150, 400]), lexicon) for _ in range(60)]
    for k in range(90):  # copies, and copies with words replaced, left out or put in
        leak = list(items[k % len(items)])
        for _ in range(r.choice([0, 0, 1, len(leak) // 8, len(leak) // 6])):
            at = r.randrange(len(leak))
            leak[at : at + r.choice([0, 1, 1])] = prose(r.choice([0, 1, 1]), lexicon)
        docs.append([*prose(r.choice([0, 3, 40, 200]), lexicon), *leak, *prose(r.choice([0, 5, 90]), lexicon)])
    want = set()
    for i, words_of_doc in enumerate(docs):
        for k, item in enumerate(items):
            n = len(item)
            for at in range(0, len(words_of_doc), max(1, n // 4)):
                around = words_of_doc[at : at + n + n // 4]
                if dc.lcs_length(item, around) / n >= config.lcs:
                    want.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(frame(spark, [(i, " ".join(w)) for i, w in enumerate(docs)]), bench).collect()}
    assert len(want) >= 80 and len(want & got) >= 0.9 * len(want)
    assert {(60 + k, k % len(items)) for k in range(90) if " ".join(items[k % len(items)]) in " ".join(docs[60 + k])} <= got


def test_passages_reach_to_the_end_of_an_item():
    for n in (1, 63, 64, 65, 96, 97, 128, 130, 200):
        starts = dc.passage_starts(n, 64)
        assert {k for a in starts for k in range(a, min(n, a + 64))} == set(range(n)) and len(set(starts)) == len(starts)


def test_decontamination_judges_every_window(spark):
    r = random.Random(13)
    item = words(r, 32).split()
    # Better aligned without the answer (24 of 32), then worse aligned with it (20 of 32).
    first = item[:24] + ["other"] * 8
    second = ["other"] * 12 + item[12:]
    text = " ".join([words(r, 100), *first, words(r, 200), *second, words(r, 100)])
    bench = spark.createDataFrame([(1, " ".join(item), " ".join(item[24:]))], "item_id long, text string, answer string")
    got = dc.contaminated(frame(spark, [(1, text), (2, " ".join([words(r, 100), *first]))] + [(9 + i, words(r, 50)) for i in range(50)]), bench).collect()
    assert [(x.doc_id, x.item_id, x.lcs, x.answer) for x in got] == [(1, 1, 20 / 32, 1.0)]


def test_toxicity_held_out(spark):
    r = random.Random(9)
    bad = ["zorgh", "plimf", "vraxy"]
    text = lambda t: words(r, 40) + (" " + " ".join(r.choice(bad) for _ in range(r.randint(2, 8))) if t else "")
    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, [*rows, (900, None), (901, "")])
    model = toxicity.fit_toxicity(docs, labels)
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, model).collect()}
    right = sum(got[i].toxic == (i % 4 == 0) for i in range(200, 400))
    assert right >= 196 and not got[900].toxic and not got[901].toxic
    assert np.all(np.diff(model.thresholds) > 0) and 0 <= got[0].severity <= 3
    assert not toxicity.fit_toxicity(docs, labels.limit(0)).weights


def test_html_extraction(spark):
    page = "<html><head><title>no</title></head><body><nav><a href='/'>Home</a></nav><div class=ad>Buy now</div><article><h1>A &amp; B</h1><p><b>One two,\n three four five.<br><p>Six seven eight nine.</p></article><section class='comments'><p>Great post, thanks!</p></section><footer>&copy; x</footer><script>var t='</p>';</script></body></html>"
    d = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<p", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extraction.extract(d).collect()}
    assert got[1] == "A & B One two, three four five. Six seven eight nine." and got[2] == got[3] == ""


def test_only_hiding_attributes_hide_text():
    from veilspark.llm.html_blocks import blocks

    shown = ['class="overflow-hidden"', "class='hidden-xs'", 'style="overflow:hidden"', 'title="the hidden truth"', "data-x=hidden", 'hidden="until-found"', 'data-style="display:none"']
    gone = ["hidden", "HIDDEN=''", 'class="a" hidden="hidden"', 'style="color:red; display : none"', 'aria-hidden="true"']
    assert [x for x in shown if any(b.hidden for b in blocks(f"<div {x}><p>hello</p></div>"))] == []
    assert [x for x in gone if not all(b.hidden for b in blocks(f"<div {x}><p>hello</p></div>"))] == []


def test_raw_elements_end_where_they_end():
    from veilspark.llm.html_blocks import blocks

    text = lambda h: " ".join(b.text for b in blocks(h))
    for head in ('<svg-icon name="x"></svg-icon>', "<title-bar></title-bar>", "<select-box>", "<template-x>", "<object-view>", '<svg class="i"/>', "<math/>", "<select>", "<object>", "<noscript>", "<svg>", "<svg><path/></svg>", "<script>x</script>", "<title>x</title>"):
        assert text(f"{head}<article>hello</article>") == "hello", head
    assert [b.text for b in blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <svg><text>no</text></svg>holds</p>")] == ["so x=1 holds"]
    assert text("<p>a</p><script>b<p>c</p>") == "a" and text("<p>a</p><style>b") == "a"


def test_labeller_held_out():
    from veilspark.llm.html_lstm import trained
    from veilspark.llm.train_extractor import Maker, accuracy

    assert accuracy(trained(), [Maker(5_000_000 + i).page() for i in range(60)]) > 0.97
