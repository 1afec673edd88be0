"""The registered queries of the personal-data engine, with SQL for those that SQL can express.

The tables hold few Russian identifiers, so identifiers and spans are also derived from keys by rules that both dialects state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import cells, checks
from veilspark.functions.labels import generic_placeholder, normalised, russian
from veilspark.functions.names import person_canonical, surname_key
from veilspark.functions.spans import SPAN, merge_persons, resolve, span
from veilspark.operators.context import thresholds
from veilspark.operators.detect import exploded, with_spans
from veilspark.operators.evaluation import evaluate_tagged, overlap_candidates
from veilspark.operators.mapping import build_mapping, mapping_stats, pseudonymise, registrations, restore
from veilspark.operators.masking import dictionary_rewrite, first_wins_mapping, legend, mask_generic, placeholders_in
from veilspark.operators.recognizers import RECOGNIZERS
from veilspark.plans.config import PiiConfig
from veilspark.plans.pipeline import enrich_generic, process, process_batch, with_report
from veilspark.plans.staging import tasks_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PATTERN = {r.label: r.patterns for r in RECOGNIZERS}
EMAIL = PATTERN["EMAIL_ADDRESS"][0][0]
ONLY = lambda *labels: PiiConfig(enabled=labels)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_spans(table: str, key: str, text: str, pattern: str) -> str:
    """CTE body: key, start, text of the matches, from the matches and the gaps between them."""
    return f"""
  SELECT {key}, i, m[i] AS text, list_sum(list_transform(g[:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[:i - 1], lambda z: length(z))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM {table}))"""


# --- detection over the driver's texts ---------------------------------------------------------------------------


@query()
def pii_spans(spark, sf_dir):
    """Every span of every document, all recognizers."""
    return exploded(with_spans(_t(spark, sf_dir, "documents").select("doc_id", "text")))


@query(f"""WITH s AS ({_sql_spans("documents", "doc_id", "text", EMAIL)})
SELECT doc_id, 'EMAIL_ADDRESS' AS label, text, CAST(start AS INT) AS start, CAST(start + length(text) AS INT) AS "end" FROM s""")
def email_spans(spark, sf_dir):
    return exploded(with_spans(_t(spark, sf_dir, "documents").select("doc_id", "text"), config=ONLY("EMAIL_ADDRESS"))).select("doc_id", "label", "text", "start", "end")


_BYTE = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@query(f"""WITH s AS ({_sql_spans("documents", "doc_id", "text", "[0-9.]*[0-9]")})
SELECT doc_id, 'IP_ADDRESS' AS label, text, CAST(start AS INT) AS start, CAST(start + length(text) AS INT) AS "end" FROM s
WHERE regexp_full_match(text, '({_BYTE}[.]){{3}}{_BYTE}')""")
def ipv4_spans(spark, sf_dir):
    return exploded(with_spans(_t(spark, sf_dir, "documents").select("doc_id", "text"), config=ONLY("IP_ADDRESS"))).select("doc_id", "label", "text", "start", "end")


_LUHN = "(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN CAST(d[i] AS INT) > 4 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END) ELSE CAST(d[i] AS INT) END)) % 10 = 0)"


@query(f"""WITH s AS ({_sql_spans("documents", "doc_id", "text", "[0-9]+")}), c AS (SELECT *, text AS d FROM s WHERE regexp_full_match(text, '[3-6][0-9]{{15}}'))
SELECT doc_id, 'CREDIT_CARD' AS label, text, CAST(start AS INT) AS start, CAST(start + 16 AS INT) AS "end" FROM c WHERE {_LUHN}""")
def card_spans(spark, sf_dir):
    """Card numbers, in one piece or with separators; the SQL finds 16 digits in one piece, the only form that these tables hold."""
    found = exploded(with_spans(_t(spark, sf_dir, "documents").select("doc_id", "text"), config=ONLY("CREDIT_CARD")))
    return found.select("doc_id", "label", "text", "start", "end")


@query(f"""SELECT lang, count(*) AS documents, CAST(sum(len(regexp_extract_all(text, '{EMAIL}'))) AS BIGINT) AS emails FROM documents GROUP BY lang""")
def emails_by_lang(spark, sf_dir):
    d = with_spans(_t(spark, sf_dir, "documents").select("lang", "text"), config=ONLY("EMAIL_ADDRESS"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("spans")).alias("emails"))


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g') AS masked FROM documents")
def mask_email_text(spark, sf_dir):
    return mask_generic(with_spans(_t(spark, sf_dir, "documents").select("doc_id", "text"), config=ONLY("EMAIL_ADDRESS"))).select("doc_id", "masked")


@query(f"""WITH s AS ({_sql_spans("pages", "page_id", "html", EMAIL)})
SELECT page_id, text, CAST(start AS INT) AS start FROM s""")
def pages_email_spans(spark, sf_dir):
    return exploded(with_spans(_t(spark, sf_dir, "pages").select("page_id", "html"), "html", ONLY("EMAIL_ADDRESS")), "page_id").select("page_id", "text", "start")


@query()
def pii_stats_by_label(spark, sf_dir):
    e = exploded(with_spans(_t(spark, sf_dir, "documents").select("doc_id", "text")))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("doc_id").alias("documents"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query()
def conversation_pii(spark, sf_dir):
    return exploded(with_spans(_t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")))


@query()
def json_reports(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id")).alias("source_file"), "text")
    return with_report(process(d)).select("doc_id", "report")


# --- checksums ---------------------------------------------------------------------------------------------------

_d = lambda i: f"CAST(substr(d, {i}, 1) AS INT)"
_w = lambda ws, first=1: " + ".join(f"{_d(i + first)} * {w}" for i, w in enumerate(ws))
_number = lambda n, mult: f"lpad(CAST(o_orderkey * {mult} % {10**n} AS VARCHAR), {n}, '0')"


def _numbers(spark, sf_dir, n, mult):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * mult % 10**n).cast("string"), n, "0").alias("d"))


@query(f"SELECT o_orderkey, d, ({_w(checks.INN10)}) % 11 % 10 = {_d(10)} AS valid FROM (SELECT o_orderkey, {_number(10, 7919777)} AS d FROM orders)")
def inn10_checksum(spark, sf_dir):
    return _numbers(spark, sf_dir, 10, 7919777).withColumn("valid", checks.inn10(F.col("d")))


_INN12_1 = f"({_w(checks.INN12_FIRST)}) % 11 % 10 = {_d(11)}"


@query(f"""SELECT o_orderkey, d, {_INN12_1} AND ({_w(checks.INN12_SECOND, 2)}) % 11 % 10 = {_d(12)} AS valid, {_INN12_1} AND ({_w(checks.INN12_OFFICIAL)}) % 11 % 10 = {_d(12)} AS official
FROM (SELECT o_orderkey, {_number(12, 79197770129)} AS d FROM orders)""")
def inn12_checksum(spark, sf_dir):
    return _numbers(spark, sf_dir, 12, 79197770129).withColumns({"valid": checks.inn12(F.col("d")), "official": checks.inn12(F.col("d"), True)})


@query(f"""SELECT o_orderkey, d, substr(d, 10, 2) <> '00' AND substr(d, 1, 3) <> '000' AND ({_w(checks.SNILS)}) % 101 % 100 = CAST(substr(d, 10, 2) AS INT) AS valid
FROM (SELECT o_orderkey, {_number(11, 7919777013)} AS d FROM orders)""")
def snils_checksum(spark, sf_dir):
    return _numbers(spark, sf_dir, 11, 7919777013).withColumn("valid", checks.snils(F.col("d")))


@query(f"SELECT o_orderkey, d, {_LUHN} AS valid FROM (SELECT o_orderkey, {_number(16, 791977701377)} AS d FROM orders)")
def luhn_checksum(spark, sf_dir):
    return _numbers(spark, sf_dir, 16, 791977701377).withColumn("valid", checks.luhn(F.col("d")))


# --- recognizers over derived Russian texts ----------------------------------------------------------------------


@query(f"""WITH n AS (SELECT o_orderkey, {_number(10, 7919777)} AS d FROM orders)
SELECT o_orderkey AS doc_id, 'RU_INN' AS label, d AS text, 18 AS start, CAST(1.0 AS DOUBLE) AS confidence FROM n WHERE ({_w(checks.INN10)}) % 11 % 10 = {_d(10)}""")
def ru_inn_detect(spark, sf_dir):
    d = _numbers(spark, sf_dir, 10, 7919777).select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Заказчик ООО, ИНН "), F.col("d"), F.lit(" КПП 770701001")).alias("text"))
    return exploded(with_spans(d, config=ONLY("RU_INN", "RU_PASSPORT", "PHONE_NUMBER"))).select("doc_id", "label", "text", "start", "confidence")


_PHONE = "'+7 9' || lpad(CAST(c_custkey * 7919 % 100 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(c_custkey * 31 % 1000 AS VARCHAR), 3, '0') || ' 22 33'"


@query(f"""SELECT c_custkey AS doc_id, {_PHONE} AS text, CAST(CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.95 END AS DOUBLE) AS confidence FROM customer""")
def context_score(spark, sf_dir):
    """A phone number near a word for it, near a word against it, and alone."""
    lead = F.when(F.col("c_custkey") % 3 == 0, "Телефон: ").when(F.col("c_custkey") % 3 == 1, "БИК рядом ").otherwise("Номер ")
    d = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(lead, F.expr(_PHONE.replace("VARCHAR", "STRING"))).alias("text"))
    return exploded(with_spans(d, config=ONLY("PHONE_NUMBER"))).select("doc_id", "text", F.round("confidence", 4).alias("confidence"))


@query(f"SELECT c_custkey AS doc_id, {_PHONE} AS text FROM customer WHERE c_custkey % 3 <> 1")
def threshold_filter(spark, sf_dir):
    lead = F.when(F.col("c_custkey") % 3 == 0, "Телефон: ").when(F.col("c_custkey") % 3 == 1, "БИК рядом ").otherwise("Номер ")
    d = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(lead, F.expr(_PHONE.replace("VARCHAR", "STRING"))).alias("text"))
    return exploded(with_spans(d, config=ONLY("PHONE_NUMBER").with_threshold("PHONE_NUMBER", 0.8))).select("doc_id", "text")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'NORP' ELSE 'OTHER' END AS label,
  CASE c_custkey % 4 WHEN 0 THEN 'ФИО' WHEN 1 THEN 'Адрес' WHEN 2 THEN 'Национальность' ELSE 'OTHER' END AS ru,
  CASE c_custkey % 4 WHEN 0 THEN '<PERSON>' WHEN 1 THEN '<LOC>' WHEN 2 THEN '<GROUP>' ELSE '<OTHER>' END AS placeholder,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 0.35 WHEN 1 THEN 0.4 ELSE 0.5 END AS DOUBLE) AS threshold FROM customer""")
def label_dimension(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("PER", "GPE", "NRP", "OTHER"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    label = normalised(raw)
    return _t(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), russian(label).alias("ru"), generic_placeholder(label).alias("placeholder"), thresholds(PiiConfig(), label).alias("threshold"))


# --- intervals ---------------------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    """One row for each order and line number; few share one, so rows are dealt out before they are grouped, to tasks by the table's size."""
    l = _t(spark, sf_dir, "lineitem")
    l = l.repartition(tasks_for(l), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber")
    return l.agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_discount").alias("l_discount"))


_ONE_LINE = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL)"


def _line_spans(spark, sf_dir):
    """Derived spans of an order: place from l_partkey, label from l_linenumber, confidence from l_discount."""
    label = F.element_at(F.array(*map(F.lit, ("EMAIL_ADDRESS", "PERSON", "RU_INN"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    start = (F.col("l_partkey") * 7 % 40).cast("int")
    one = span(label, F.lit("x"), start, F.round(0.5 + F.col("l_discount"), 2), "s", start + (F.col("l_suppkey") % 15 + 3).cast("int"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", one.alias("e")).groupBy("l_orderkey").agg(F.collect_list("e").cast(f"array<{SPAN}>").alias("spans"))


_LINES = """l AS (SELECT l_orderkey, CAST(l_partkey * 7 % 40 AS INT) AS s, CAST(l_partkey * 7 % 40 + l_suppkey % 15 + 3 AS INT) AS t, round(0.5 + l_discount, 2) AS c,
  CASE l_linenumber % 3 WHEN 0 THEN 100 WHEN 1 THEN 50 ELSE 88 END AS p FROM lineitem)"""


@query(f"""WITH RECURSIVE {_LINES},
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, -p, -c, s - t) AS i FROM l),
f AS (
  SELECT l_orderkey, i, [{{'s': s, 't': t, 'p': p, 'c': c}}] AS kept FROM o WHERE i = 1
  UNION ALL
  SELECT o.l_orderkey, o.i, CASE
    WHEN f.kept[-1].t <= o.s THEN list_append(f.kept, {{'s': o.s, 't': o.t, 'p': o.p, 'c': o.c}})
    WHEN (o.p, o.c, o.t - o.s) > (f.kept[-1].p, f.kept[-1].c, f.kept[-1].t - f.kept[-1].s) THEN list_append(f.kept[:-2], {{'s': o.s, 't': o.t, 'p': o.p, 'c': o.c}})
    ELSE f.kept END
  FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.i = f.i + 1
)
SELECT l_orderkey, array_to_string(list_transform(arg_max(kept, i), lambda x: x.s || '-' || x.t || ':' || x.p), ' ') AS kept FROM f GROUP BY l_orderkey""")
def interval_dedup(spark, sf_dir):
    from veilspark.functions.labels import priority

    kept = resolve(F.col("spans"))
    shown = F.transform(kept, lambda e: F.concat(e["start"], F.lit("-"), e["end"], F.lit(":"), priority(e["label"])))
    return _line_spans(spark, sf_dir).select("l_orderkey", F.array_join(shown, " ").alias("kept"))


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber * 12 AS s, l_linenumber * 12 + 8 + l_partkey % 5 AS t, round(0.5 + l_discount, 2) AS c FROM {_ONE_LINE}),
g AS (SELECT *, CASE WHEN s - lag(t) OVER w <= 2 THEN 0 ELSE 1 END AS cut FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY s)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY l_orderkey ORDER BY s) AS island FROM g)
SELECT l_orderkey, CAST(min(s) AS INT) AS start, CAST(max(t) AS INT) AS "end", min(c) AS confidence FROM r GROUP BY l_orderkey, island""")
def adjacent_merge(spark, sf_dir):
    start = (F.col("l_linenumber") * 12).cast("int")
    one = span("PERSON", F.lit("x"), start, F.round(0.5 + F.col("l_discount"), 2), "ner", start + (8 + F.col("l_partkey") % 5).cast("int"))
    rows = _lines(spark, sf_dir).select("l_orderkey", one.alias("e")).groupBy("l_orderkey").agg(F.collect_list("e").cast(f"array<{SPAN}>").alias("spans"))
    rows = rows.withColumn("text", F.lit(" " * 200))
    return rows.select("l_orderkey", F.explode(merge_persons(F.col("spans"), F.col("text"))).alias("e")).select("l_orderkey", "e.start", "e.end", "e.confidence")


# --- mapping -----------------------------------------------------------------------------------------------------


def _registrations(spark, sf_dir):
    label = F.when(F.col("o_custkey") % 2 == 0, "ORGANIZATION").otherwise("LOCATION")
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_seq"), F.col("o_orderstatus").alias("source_file"), F.concat(F.lit("Клиент "), F.col("o_custkey") % 997).alias("original"), label.alias("label"), F.lit(0).alias("start"))


_FIRST = """r AS (SELECT o_orderkey, 'Клиент ' || (o_custkey % 997) AS original, CASE WHEN o_custkey % 2 = 0 THEN 'ORGANIZATION' ELSE 'LOCATION' END AS label FROM orders),
f AS (SELECT original, arg_min(label, o_orderkey) AS label, min(o_orderkey) AS first_doc FROM r GROUP BY original),
m AS (SELECT *, '<' || label || '_' || row_number() OVER (PARTITION BY label ORDER BY first_doc) || '>' AS placeholder FROM f)"""


@query(f"WITH {_FIRST} SELECT original, label, placeholder, first_doc FROM m")
def first_seen_numbering(spark, sf_dir):
    return build_mapping(_registrations(spark, sf_dir)).select("original", "label", "placeholder", "first_doc")


@query(f"WITH {_FIRST} SELECT label, count(DISTINCT placeholder) AS entities, count(*) AS surfaces FROM m GROUP BY GROUPING SETS ((label), ())")
def mapping_distinct_counts(spark, sf_dir):
    return mapping_stats(build_mapping(_registrations(spark, sf_dir)))


_FORMS = (("Иванов", "иванов"), ("Иванову", "иванов"), ("Ивановым", "иванов"), ("Иванов Иван", "иванов"), ("Егорова", "егорова"), ("Егоровой Марине", "егорова"), ("Петровский", "петровский"), ("Петровского П.И.", "петровский"))


def _persons(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x, _ in _FORMS]), (F.col("o_custkey") % len(_FORMS) + 1).cast("int"))
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_seq"), F.lit("a").alias("source_file"), name.alias("original"), F.lit("PERSON").alias("label"), F.lit(0).alias("start"))


_PERSONS = f"""p AS (SELECT o_orderkey, list_extract({[x for x, _ in _FORMS]}, CAST(o_custkey % {len(_FORMS)} + 1 AS INT)) AS original, list_extract({[k for _, k in _FORMS]}, CAST(o_custkey % {len(_FORMS)} + 1 AS INT)) AS key FROM orders)"""


@query(f"WITH {_PERSONS} SELECT o_orderkey, original, key FROM p")
def person_key(spark, sf_dir):
    return _persons(spark, sf_dir).select(F.col("doc_seq").alias("o_orderkey"), "original", surname_key(person_canonical(F.col("original"))).alias("key"))


@query(f"""WITH {_PERSONS}, f AS (SELECT key, original, min(o_orderkey) AS o FROM p GROUP BY ALL),
g AS (SELECT key, min(o) AS o, arg_min(original, (-len(string_split(original, ' ')), o)) AS best FROM f GROUP BY key),
n AS (SELECT *, '<PERSON_' || row_number() OVER (ORDER BY o) || '>' AS placeholder FROM g)
SELECT f.original, n.placeholder, n.best AS "primary" FROM f JOIN n USING (key)""")
def primary_surface(spark, sf_dir):
    return build_mapping(_persons(spark, sf_dir)).select("original", "placeholder", "primary")


def _email_batch(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_seq"), F.concat(F.lit("doc"), F.col("doc_id")).alias("source_file"), "text")
    return process_batch(d, ONLY("EMAIL_ADDRESS"))


@query(f"""WITH s AS ({_sql_spans("documents", "doc_id", "text", EMAIL)}),
f AS (SELECT text, min((doc_id, -length(text), start)) AS o FROM s GROUP BY text),
m AS (SELECT text, '<EMAIL_ADDRESS_' || row_number() OVER (ORDER BY o) || '>' AS ph FROM f),
g AS (SELECT doc_id, string_split_regex(text, '{EMAIL}') AS g FROM documents),
x AS (SELECT g.doc_id, g.i AS k, g.g[g.i] || coalesce(m.ph, '') AS part FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM g) g LEFT JOIN s ON s.doc_id = g.doc_id AND s.i = g.i LEFT JOIN m ON m.text = s.text)
SELECT doc_id, string_agg(part, '' ORDER BY k) AS pseudonymised FROM x GROUP BY doc_id""")
def batch_pseudonyms(spark, sf_dir):
    return _email_batch(spark, sf_dir).documents.select(F.col("doc_seq").alias("doc_id"), "pseudonymised")


@query("SELECT doc_id, text AS restored FROM documents")
def restore_roundtrip(spark, sf_dir):
    b = _email_batch(spark, sf_dir)
    return restore(b.documents, b.mapping, "doc_seq", "pseudonymised").select(F.col("doc_seq").alias("doc_id"), "restored")


@query()
def batch_mapping(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_seq"), F.concat(F.lit("doc"), F.col("doc_id")).alias("source_file"), "text")
    return process_batch(d).mapping


@query(f"""WITH s AS ({_sql_spans("documents", "doc_id", "text", EMAIL)})
SELECT doc_id, count(*) AS emails, count(DISTINCT text) AS surfaces FROM s GROUP BY doc_id""")
def document_stats(spark, sf_dir):
    p = process(_t(spark, sf_dir, "documents").select("doc_id", "text"), ONLY("EMAIL_ADDRESS")).filter("total_entities > 0")
    return p.select("doc_id", F.col("stats")["EMAIL_ADDRESS"].cast("long").alias("emails"), F.size("mapping").cast("long").alias("surfaces"))


# --- evaluation --------------------------------------------------------------------------------------------------


def _label():
    return F.element_at(F.array(*map(F.lit, ("EMAIL_ADDRESS", "PERSON", "RU_INN"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("label")


def _side(gold, text, start):
    """A gold span or a prediction of a line, for a table in which both stand."""
    start = start.cast("long")
    return F.struct(text.alias("text"), start.alias("start"), (start + 10).alias("end"), start.alias("i"), F.lit(gold).alias("gold"))


def _gold_and_predicted(spark, sf_dir):
    """Both from one pass over the lines."""
    start = F.col("l_linenumber") * 20
    gold, predicted = _side(True, F.lit("x"), start), _side(False, F.lit("x"), start + F.col("l_partkey") % 7)
    sides = F.when(F.col("l_suppkey") % 4 != 0, F.array(gold, predicted)).otherwise(F.array(gold))
    return _lines(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("case_id"), _label(), F.explode(sides).alias("e")).select("case_id", "label", "e.*")


_GP = f"""g AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, CASE l_linenumber % 3 WHEN 0 THEN 'EMAIL_ADDRESS' WHEN 1 THEN 'PERSON' ELSE 'RU_INN' END AS label, l_linenumber * 20 AS s, l_linenumber * 20 + 10 AS t FROM {_ONE_LINE}),
p AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, CASE l_linenumber % 3 WHEN 0 THEN 'EMAIL_ADDRESS' WHEN 1 THEN 'PERSON' ELSE 'RU_INN' END AS label, l_linenumber * 20 + l_partkey % 7 AS s, l_linenumber * 20 + l_partkey % 7 + 10 AS t FROM {_ONE_LINE} WHERE l_suppkey % 4 <> 0)"""
_PRF = """SELECT case_id, label, tp, fp, fn, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN fp = 0 THEN 1.0 ELSE 0.0 END AS re FROM (
    SELECT case_id, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY GROUPING SETS ((case_id, label), (case_id))))"""


@query(f"""WITH {_GP}, a AS (SELECT case_id, label, s, t, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT case_id, label, s, t, count(*) AS k FROM p GROUP BY ALL),
c AS (SELECT case_id, label, least(coalesce(n, 0), coalesce(k, 0)) AS tp, coalesce(k, 0) - least(coalesce(n, 0), coalesce(k, 0)) AS fp, coalesce(n, 0) - least(coalesce(n, 0), coalesce(k, 0)) AS fn FROM a FULL JOIN b USING (case_id, label, s, t))
{_PRF}""")
def eval_exact(spark, sf_dir):
    return evaluate_tagged(_gold_and_predicted(spark, sf_dir), "exact")


@query(f"""WITH {_GP} SELECT g.case_id, g.label, CAST(g.s AS INT) AS gs, CAST(p.s AS INT) AS ps, round((least(g.t, p.t) - greatest(g.s, p.s)) / (greatest(g.t, p.t) - least(g.s, p.s)), 6) AS iou
FROM g JOIN p ON g.case_id = p.case_id AND g.label = p.label AND g.s < p.t AND g.t > p.s WHERE (least(g.t, p.t) - greatest(g.s, p.s)) / (greatest(g.t, p.t) - least(g.s, p.s)) >= 0.5""")
def eval_overlap_candidates(spark, sf_dir):
    spans = _gold_and_predicted(spark, sf_dir)
    found = overlap_candidates(spans.filter("gold"), spans.filter("NOT gold"))
    return found.select("case_id", "label", F.col("gs").cast("int"), F.col("ps").cast("int"), F.round("iou", 6).alias("iou"))


@query(f"""WITH {_GP}, a AS (SELECT case_id, label, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT case_id, label, count(*) AS k FROM p GROUP BY ALL),
h AS (SELECT g.case_id, g.label, count(*) AS tp FROM g JOIN p ON g.case_id = p.case_id AND g.label = p.label AND g.s <= p.s AND p.s < g.s + 7 AND (g.t - p.s) / (p.t - g.s) >= 0.5 GROUP BY ALL),
c AS (SELECT case_id, label, coalesce(tp, 0) AS tp, coalesce(k, 0) - coalesce(tp, 0) AS fp, coalesce(n, 0) - coalesce(tp, 0) AS fn FROM a LEFT JOIN b USING (case_id, label) LEFT JOIN h USING (case_id, label))
{_PRF}""")
def eval_overlap(spark, sf_dir):
    """The derived spans overlap one another only within a line, so the greedy matching has a closed form."""
    return evaluate_tagged(_gold_and_predicted(spark, sf_dir), "overlap")


_item = lambda: F.concat(F.lit("item "), F.col("l_linenumber"))


@query(f"""WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, CASE l_linenumber % 3 WHEN 0 THEN 'EMAIL_ADDRESS' WHEN 1 THEN 'PERSON' ELSE 'RU_INN' END AS label, l_partkey % 3 AS k FROM {_ONE_LINE}),
c AS (SELECT case_id, label, CASE WHEN k < 2 THEN 1 ELSE 0 END AS tp, CASE WHEN k < 2 THEN 0 ELSE 1 END AS fp, CASE WHEN k < 2 THEN 0 ELSE 1 END AS fn FROM l)
{_PRF}""")
def eval_label_text(spark, sf_dir):
    """A prediction of every gold item: with the same text in other white space and case, with words around it, or of something else."""
    k = F.col("l_partkey") % 3
    said = F.when(k == 0, F.upper(F.replace(_item(), F.lit(" "), F.lit("  ")))).when(k == 1, F.concat(F.lit("the "), _item(), F.lit(" here"))).otherwise("else")
    start = F.col("l_linenumber") * 20
    sides = F.array(_side(True, _item(), start), _side(False, said, start))
    spans = _lines(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("case_id"), _label(), F.explode(sides).alias("e")).select("case_id", "label", "e.*")
    return evaluate_tagged(spans, "label_text")


# --- dictionaries and cells --------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, replace(replace(replace(o_orderpriority || ' ' || o_orderstatus, '1-URGENT', '<A>'), 'HIGH', '<B>'), '-', '~') AS masked FROM orders""")
def dictionary_replace(spark, sf_dir):
    m = F.create_map(*map(F.lit, ("-", "~", "HIGH", "<B>", "1-URGENT", "<A>")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", dictionary_rewrite(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"), m).alias("masked"))


@query("""SELECT c_custkey, unnest(list_filter(list_transform(string_split(c_name || ' | ' || c_mktsegment || ' |  | ' || c_nationkey, ' | '), lambda x: trim(x)), lambda x: x <> '')) AS fragment FROM customer""")
def pipe_split(spark, sf_dir):
    row = F.concat("c_name", F.lit(" | "), "c_mktsegment", F.lit(" |  | "), F.col("c_nationkey").cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.explode(cells.pipe_fragments(row)).alias("fragment"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'да' ELSE 'нет' END AS flag FROM orders""")
def cell_format(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    day = cells.cell_string(F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00"), F.lit("datetime"))
    price = cells.cell_string(F.concat(F.round("o_totalprice").cast("long").cast("string"), F.lit(".0")), F.lit("float"))
    return o.select("o_orderkey", day.alias("day"), price.alias("price"), cells.cell_string((F.col("o_orderkey") % 2 == 0).cast("string"), F.lit("bool")).alias("flag"))


@query("""SELECT c_custkey, v AS value, length(trim(v)) < 2 OR contains(v, '===') OR lower(trim(v)) IN ('инн') AS junk, regexp_matches(v, '^ООО ') AS org
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ООО ' || c_name WHEN 1 THEN ' ИНН ' WHEN 2 THEN '=== ' || c_name WHEN 3 THEN c_name END AS v FROM customer)""")
def cell_heuristics(spark, sf_dir):
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, F.concat(F.lit("ООО "), "c_name")).when(k == 1, " ИНН ").when(k == 2, F.concat(F.lit("=== "), "c_name")).otherwise(F.col("c_name"))
    return _t(spark, sf_dir, "customer").select("c_custkey", v.alias("value")).withColumns({"junk": cells.is_junk(F.col("value")), "org": cells.looks_like_org(F.col("value"))})


@query(f"""SELECT doc_id, surface, '<EMAIL>' AS placeholder FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{EMAIL}'))) AS surface FROM documents)""")
def first_wins(spark, sf_dir):
    """The mapping of every document: each surface once, with the placeholder of its first span."""
    d = with_spans(_t(spark, sf_dir, "documents").select("doc_id", "text"), config=ONLY("EMAIL_ADDRESS"))
    return d.select("doc_id", F.explode(first_wins_mapping(F.col("spans"))).alias("surface", "placeholder"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '<[A-Za-z0-9_]+>'))), ' ') AS placeholders, len(regexp_extract_all(t, '<[A-Za-z0-9_]+>')) AS found
FROM (SELECT o_orderkey, '<' || o_orderstatus || '_' || (o_custkey % 9) || '> < a> <B_1>, <' || o_orderstatus || '_1>' AS t FROM orders)""")
def placeholder_tokens(spark, sf_dir):
    t = F.concat(F.lit("<"), "o_orderstatus", F.lit("_"), F.col("o_custkey") % 9, F.lit("> < a> <B_1>, <"), "o_orderstatus", F.lit("_1>"))
    found = placeholders_in(t)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("placeholders"), F.size(found).cast("long").alias("found"))


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(CASE l_linenumber % 3 WHEN 0 THEN 'EMAIL_ADDRESS' WHEN 1 THEN 'PERSON' ELSE 'RU_INN' END))), ' ') AS labels FROM lineitem GROUP BY l_orderkey""")
def legend_labels(spark, sf_dir):
    return _line_spans(spark, sf_dir).select("l_orderkey", F.array_join(legend(F.col("spans")), " ").alias("labels"))


@query("""SELECT DISTINCT 'Клиент ' || o_custkey AS original, CASE WHEN o_custkey % 3 = 0 THEN '<KNOWN>' WHEN o_custkey % 2 = 0 THEN '<ORG>' ELSE '<LOC>' END AS placeholder FROM orders""")
def cell_enrichment(spark, sf_dir):
    """A generic mapping that knows a third of the surfaces, extended by what only the cells have."""
    label = F.when(F.col("o_custkey") % 2 == 0, "ORGANIZATION").otherwise("LOCATION")
    reg = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_seq"), F.lit("a").alias("source_file"), F.concat(F.lit("Клиент "), "o_custkey").alias("original"), label.alias("label"), F.lit(0).alias("start"), "o_custkey")
    known = reg.filter("o_custkey % 3 = 0").select("original", F.lit("<KNOWN>").alias("placeholder")).distinct()
    return enrich_generic(known, reg)
