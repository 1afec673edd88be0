import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark import queries
from veilspark.functions import cells, checks
from veilspark.functions.labels import generic_placeholder
from veilspark.functions.names import person_canonical, surname_key
from veilspark.functions.spans import SPAN, hits, resolve, rewrite
from veilspark.operators.context import judge_mixed
from veilspark.operators.detect import with_spans
from veilspark.operators.evaluation import evaluate
from veilspark.operators.mapping import build_mapping, pseudonymise, restore
from veilspark.operators.masking import dictionary_rewrite
from veilspark.plans.config import PiiConfig
from veilspark.plans.pipeline import process, process_batch, run_gold, with_report
from veilspark.sources import sinks

LINE = (
    "ИНН 7707083893 СНИЛС 123-456-789 64 тел. +7 900 111 22 33 email test@example.com карта 4111 1111 1111 1111 IP 10.0.0.1 MAC aa:bb:cc:dd:ee:ff "
    "БИК 044525225 р/с 40702810400000000001 паспорт 45 12 345678 госномер А123ВС 777 ВУ 77 АВ 123456 GPS 55.7558, 37.6173 TG -1001234567890"
)
GOLD = {
    "RU_INN": "7707083893", "RU_SNILS": "123-456-789 64", "PHONE_NUMBER": "+7 900 111 22 33", "EMAIL_ADDRESS": "test@example.com", "CREDIT_CARD": "4111 1111 1111 1111",
    "IP_ADDRESS": "10.0.0.1", "MAC_ADDRESS": "aa:bb:cc:dd:ee:ff", "RU_BIK": "044525225", "RU_ACCOUNT": "40702810400000000001", "RU_PASSPORT": "45 12 345678",
    "RU_VEHICLE_PLATE": "А123ВС 777", "RU_DRIVER_LICENSE": "77 АВ 123456", "GPS_COORDS": "55.7558, 37.6173", "TG_CHAT_ID": "-1001234567890",
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("d,ok", [("7707083893", True), ("1234567890", False), ("500100732259", True), ("123456789012", False), ("12345", False), ("abcde", False)])
def test_inn(spark, d, ok):
    assert one(spark, checks.inn(F.lit(d))) is ok


@pytest.mark.parametrize("d,ok", [("12345678964", True), ("00000000000", False), ("12345", False)])
def test_snils(spark, d, ok):
    assert one(spark, checks.snils(F.lit(d))) is ok


def test_hits_count_code_points(spark):
    got = spark.createDataFrame([("😀 7 and 88 я9",)], "t string").select(hits(F.col("t"), r"\d+").alias("h")).first()["h"]
    assert [(h.start, h.text) for h in got] == [(2, "7"), (8, "88"), (12, "9")]


def test_structured_line_finds_every_identifier_and_leaves_none(spark):
    r = process(spark.createDataFrame([(1, LINE), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert {e.label: e.text for e in r[0].spans} == GOLD
    assert all(LINE[e.start : e.end] == e.text for e in r[0].spans)
    assert not any(k in r[0].masked for k in r[0].mapping)
    assert r[1].spans == [] and r[2].spans == []


def test_gold_gate(spark):
    cases = spark.createDataFrame([("s", LINE, 0.9, 0.75, 0.8)], "id string, text string, min_recall double, min_precision double, min_f1 double")
    gold = spark.createDataFrame([("s", k, v, None, None) for k, v in GOLD.items()], "case_id string, label string, text string, start int, end int")
    r = run_gold(cases, gold).first()
    assert r.passed and r.recall == 1.0


def reference_resolution(spans):
    """A plain restatement: against every kept span, not only the last."""
    kept = []
    for s in sorted(spans, key=lambda s: (s[1], -s[0], -s[3], s[1] - s[2])):
        rank = (s[0], s[3], s[2] - s[1])
        hit = [k for k in kept if k[1] < s[2] and k[2] > s[1]]
        if not hit:
            kept.append(s)
        elif all(rank > (k[0], k[3], k[2] - k[1]) for k in hit):
            kept = [k for k in kept if k not in hit] + [s]
    return sorted(kept, key=lambda s: s[1])


def test_resolution_matches_a_plain_restatement(spark):
    r = random.Random(3)
    labels = {50: "PERSON", 88: "RU_INN", 100: "EMAIL_ADDRESS"}
    sets = [[(p := r.choice(list(labels)), a := r.randint(0, 20), a + r.randint(1, 9), r.choice([0.5, 0.9])) for _ in range(r.randint(1, 7))] for _ in range(200)]
    rows = [(i, [(labels[p], "x", a, b, c, "s") for p, a, b, c in s]) for i, s in enumerate(sets)]
    got = spark.createDataFrame(rows, f"i int, s array<{SPAN}>").select("i", resolve(F.col("s")).alias("k")).collect()
    for row in got:
        assert [(e.start, e.end, e.label) for e in row.k] == [(a, b, labels[p]) for p, a, b, _ in reference_resolution(sets[row.i])]


def test_context_and_thresholds(spark):
    d = spark.createDataFrame([(1, "Телефон +7 900 111 22 33"), (2, "БИК +7 900 111 22 33")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in with_spans(d, config=PiiConfig(enabled=("PHONE_NUMBER",))).collect()}
    assert got[1][0].confidence == 1.0 and round(got[2][0].confidence, 2) == 0.7
    strict = PiiConfig(enabled=("PHONE_NUMBER",)).with_threshold("PHONE_NUMBER", 0.85)
    assert [len(r.spans) for r in with_spans(d, config=strict).orderBy("doc_id").collect()] == [1, 0]
    with pytest.raises(ValueError):
        PiiConfig().with_threshold("PERSON", 1.5)


def test_external_spans_are_judged(spark):
    spans = [("RU_INN", "1234567890", 0, 10, 0.99, "m"), ("ORGANIZATION", "Acme", 11, 15, 0.9, "m")]
    d = spark.createDataFrame([("1234567890 Acme", spans)], f"text string, s array<{SPAN}>")
    got = d.select(judge_mixed(F.col("text"), F.col("s"), PiiConfig()).alias("k")).first()["k"]
    assert [e.label for e in got] == ["ORGANIZATION"]


@pytest.mark.parametrize("a,b,same", [("Иванов", "Иванову", True), ("Иванов", "Ивановым", True), ("Егорова", "Егоровой", True), ("Иванов Иван", "Иванову Ивану", True), ("Егоров", "Егорова", False)])
def test_person_key(spark, a, b, same):
    key = lambda x: one(spark, surname_key(person_canonical(F.lit(x))))
    assert (key(a) == key(b)) is same


def test_numbering_first_label_wins_and_primary(spark):
    reg = spark.createDataFrame(
        [(1, "a", "Новиков", "PERSON", 0), (1, "a", "7707083893", "RU_INN", 9), (2, "b", "Новиков Павел Игоревич", "PERSON", 0), (2, "b", "7707083893", "PHONE_NUMBER", 5), (3, "b", "Петров", "PERSON", 0), (3, "b", "  ", "PERSON", 0)],
        "doc_seq long, source_file string, original string, label string, start int",
    )
    m = {r.original: r for r in build_mapping(reg).collect()}
    assert m["Новиков"].placeholder == m["Новиков Павел Игоревич"].placeholder == "<PERSON_1>"
    assert m["Новиков"].primary == "Новиков Павел Игоревич"
    assert m["Петров"].placeholder == "<PERSON_2>" and m["7707083893"].placeholder == "<RU_INN_1>" and m["7707083893"].files == ["a", "b"] and len(m) == 4


def test_batch_shares_pseudonyms_and_restores(spark):
    docs = spark.createDataFrame([(1, "a", "Пишет Иванов Иван Иванович, ИНН 7707083893."), (2, "b", "Для Иванов Иван Иванович: x@y.ru"), (3, "c", None)], "doc_seq long, source_file string, text string")
    b = process_batch(docs)
    texts = [r.pseudonymised for r in b.documents.orderBy("doc_seq").collect()]
    assert texts[0] == "Пишет <PERSON_1>, ИНН <RU_INN_1>." and texts[1] == "Для <PERSON_1>: <EMAIL_ADDRESS_1>"
    back = restore(b.documents, b.mapping, "doc_seq", "pseudonymised").orderBy("doc_seq").collect()
    assert [r.restored for r in back[:2]] == [r.text for r in back[:2]]


def test_restore_takes_whole_placeholders(spark):
    m = spark.createDataFrame([("<PERSON_1>", "A"), ("<PERSON_1_2>", "B")], "placeholder string, primary string")
    d = spark.createDataFrame([(1, "<PERSON_1_2> <PERSON_1> <X_9>")], "k int, t string")
    assert restore(d, m, "k", "t").first()["restored"] == "B A <X_9>"


def test_pseudonymise_rewrites_by_place(spark):
    d = spark.createDataFrame([(1, "AAA and BB", [("X", "AAA", 0, 3, 1.0, "s"), ("Y", "BB", 8, 10, 1.0, "s")])], f"doc_seq long, text string, spans array<{SPAN}>")
    m = spark.createDataFrame([("AAA", "<X_1>"), ("BB", "<Y_1>")], "original string, placeholder string")
    assert pseudonymise(d, m).first()["pseudonymised"] == "<X_1> and <Y_1>"
    assert d.select(rewrite(F.col("text"), F.col("spans"), lambda e: generic_placeholder(e["label"])).alias("x")).first()["x"] == "<X> and <Y>"


def test_encrypted_mapping(spark, tmp_path):
    m = spark.createDataFrame([("Иванов", "PERSON", "<PERSON_1>", "Иванов", None, [])], "original string, label string, placeholder string, primary string, canonical string, files array<string>")
    path = sinks.save_mapping(m, str(tmp_path / "m.txt"), "secret")
    assert path.endswith(".mapenc") and sinks.load_mapping(spark, path, "secret").first()[:4] == ("Иванов", "PERSON", "<PERSON_1>", "Иванов")
    with pytest.raises(ValueError):
        sinks.load_mapping(spark, path, "wrong")
    (tmp_path / "x.mapenc").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        sinks.load_mapping(spark, str(tmp_path / "x.mapenc"), "secret")


def test_evaluation_modes(spark):
    schema = "case_id string, label string, text string, start int, end int"
    gold = spark.createDataFrame([("c", "PERSON", "Иванов Иван", 0, 11), ("c", "RU_INN", "7707083893", 20, 30)], schema)
    pred = spark.createDataFrame([("c", "PERSON", "Иванов", 0, 6), ("c", "RU_INN", "7707083893", 20, 30), ("c", "IP_ADDRESS", "1.1.1.1", 40, 47)], schema)
    overall = lambda mode, **k: evaluate(gold, pred, mode, **k).filter("label IS NULL").first()
    assert (overall("exact").tp, overall("exact").fp, overall("exact").fn) == (1, 2, 1)
    assert (overall("overlap").tp, overall("overlap").fp) == (2, 1)  # 6 of 11 characters
    assert overall("label_text", gold_labels_only=True).f1 == 1.0


def test_cells_and_dictionary(spark):
    c = lambda v, k: one(spark, cells.cell_string(F.lit(v), F.lit(k)))
    assert c("7707083893.0", "float") == "7707083893" and c("1.5", "float") == "1.5" and c("true", "bool") == "да"
    assert c("2024-03-15 00:00:00", "datetime") == "15.03.2024" and c("2024-03-15 10:30:00", "datetime") == "15.03.2024 10:30"
    m = F.create_map(F.lit("AB"), F.lit("<1>"), F.lit("ABC"), F.lit("<2>"))
    assert one(spark, dictionary_rewrite(F.lit("ABC AB"), m)) == "<2> <1>"
    assert one(spark, cells.rewritten_cell(F.lit("=A1+1"), F.lit(False), m)) == "=A1+1"


def test_office_files_round_trip(spark, tmp_path):
    from veilspark.sources.documents import docx_text, documents

    docx = sinks.docx_from_text("ДОГОВОР\nИНН 7707083893")
    (tmp_path / "a.docx").write_bytes(docx)
    (tmp_path / "b.txt").write_bytes("привет \xff".encode("latin-1", "ignore") + "мир".encode())
    got = {r.source_file: r.text for r in documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == "ДОГОВОР\nИНН 7707083893" and got["b.txt"].endswith("мир")
    assert docx_text(sinks.docx_masked(docx, {"7707083893": "<INN>"})) == "ДОГОВОР\nИНН <INN>"
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    with pytest.raises(ValueError):
        documents(spark, str(tmp_path))


def test_report_and_stream(spark, tmp_path):
    import json

    from veilspark.streaming.online import mask_stream

    d = spark.createDataFrame([(1, "f.txt", "x@y.ru")], "doc_id long, source_file string, text string")
    r = json.loads(with_report(process(d, PiiConfig(enabled=("EMAIL_ADDRESS",)))).first()["report"])
    assert r["total_entities"] == 1 and r["mapping"] == {"x@y.ru": "<EMAIL>"} and r["stats"]["EMAIL_ADDRESS"]["count"] == 1
    d.write.parquet(str(tmp_path / "in"))
    s = mask_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), PiiConfig(enabled=("EMAIL_ADDRESS",)))
    q = s.select("masked").writeStream.format("memory").queryName("masked_stream").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.masked for r in spark.table("masked_stream").collect()] == ["<EMAIL>"]


def test_cards_in_any_form_and_the_mapping_of_several_surfaces(spark, tmp_path):
    texts = ["4111 1111-11111111 b@x.org", "378282246310005 and 3782 822463 10005", "4111111111111111 4111111111111111", "4111111111111112 a@x.org b@x.org a@x.org", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def luhn(number):
        digits = [int(c) for c in reversed(number) if c.isdigit()]
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0

    forms = re.compile(r"(?<!\d)(?:[3-6]\d{3}(?:[ -]?\d{4}){3}|3[47]\d\d[ -]?\d{6}[ -]?\d{5})(?!\d)")
    cards = sorted((i, m.group(), m.start(), m.end()) for i, t in enumerate(texts) for m in forms.finditer(t or "") if luhn(m.group()))
    found = queries.QUERIES["card_spans"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"], r["start"], r["end"]) for r in found) == cards and len(cards) == 5
    mapped = queries.QUERIES["first_wins"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in mapped) == [(0, "b@x.org", "<EMAIL>"), (3, "a@x.org", "<EMAIL>"), (3, "b@x.org", "<EMAIL>")]
