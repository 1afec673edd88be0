"""Line de-duplication within an edit bound, by deletion neighbourhoods (operator 7, native).

The symbols of a line are its words and the bound is one edited word (inserted, deleted or replaced) for lines of at
least ``least_words`` words; shorter lines match when equal. A line goes if an equal line, or one within the
bound, stands earlier (by doc_id, row, line number) anywhere in the corpus. Blank lines always stay.

1. Every line once: MD5 of the normalised line, its place, and hashes of its halves. Lines are counted from these rows.
2. Which lines can have a neighbour? One edit leaves a line's first or second half as it is, so lines without
   a half in common with another line have none, whatever the rest. This drops most lines, and no pair; and where only one half
   of a line is shared, the edit is in the other one.
3. The rest emit their deletion variants as hashed keys: the line without its i-th word, for each i in a half that may hold
   the edit. Two lines of a length within the bound share the variant at the same i; a longer one has the whole shorter one
   as a variant. The hash of a variant adds up two word hashes, so running sums give all variants of a line in linear time.
4. Equal variants are joined with the earliest line of the key only, never pair by pair, and verified word by word.
   Keys have 128 bits, so that no other line takes the earliest one's place at a key.
5. Every text is written anew without the lines that go: the lines that stay are brought together by row, and a text that loses
   lines is cut at them, in time linear in its lines; a text that loses none stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import SPACE, row_keyed, stage, text_or_empty

LEAST_WORDS = 8
MASK = (1 << 40) - 1


def normalised(line: Column) -> Column:
    """Each run of white space as one space, none at the ends. Lines with single spaces only, nearly all, see no pattern."""
    odd = line.contains("  ")
    for c in "\t\n\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(line, f"{SPACE}{{2,}}|[\\x09-\\x0D]", " ")).otherwise(line))


def has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def lines_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, pos, line): the lines of each row of docs that aren't blank, normalised."""
    each = docs.select("row", "doc_id", F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
    # The test of the line as it is: one of the normalised line would be pushed down and normalise each line twice.
    return each.filter(has_words(F.col("line"))).withColumn("line", normalised(F.col("line")))


def half_keys(line: Column, n: Column) -> list[Column]:
    """Keys of the halves of a line of n words, taken at its own length and at one word less (as a longer line meets a shorter one)."""
    keys = []
    for less in (0, 1):
        a = F.floor((n - less) / 2).cast("int")
        keys += [F.xxhash64(F.lit("p"), n - less, F.call_function("substring_index", line, F.lit(" "), a)), F.xxhash64(F.lit("s"), n - less, F.call_function("substring_index", line, F.lit(" "), a - (n - less)))]
    return keys


#: The halves' columns: first and second half at the own length, and at one word less.
HALVES = ("p0", "s0", "p1", "s1")


def all_lines(docs: DataFrame, least_words: int) -> DataFrame:
    """(line_id, row, doc_id, pos, halves), a row for each line; halves are null for lines of under least_words words."""
    rows = lines_of(docs).withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    halves = [F.when(F.col("n") >= least_words, k).alias(c) for c, k in zip(HALVES, half_keys(F.col("line"), F.col("n")), strict=True)]
    return rows.select(F.unhex(F.md5("line")).alias("line_id"), "row", "doc_id", "pos", *halves)


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(line_id, place of its first occurrence, halves), one row for each distinct line."""
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "pos")
    # Equal lines have equal halves, so any of them will do: first() takes part in the partial aggregation.
    return lines.groupBy("line_id").agg(F.min(place).alias("place"), *[F.first(c).alias(c) for c in HALVES])


def running(each: DataFrame, seed: int) -> tuple[Column, Column]:
    """Sums of 40-bit hashes of (place, word) over a line without the word at hand (later words move up), and over the whole line."""
    here = F.xxhash64("i", "word", F.lit(seed)).bitwiseAND(MASK)
    moved = F.xxhash64(F.col("i") - 1, "word", F.lit(seed)).bitwiseAND(MASK)
    by_line, total = Window.partitionBy("line_id").orderBy("i"), Window.partitionBy("line_id")
    before = F.coalesce(F.sum(here).over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(moved).over(total) - F.sum(moved).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    return before + after, F.sum(here).over(total)


def variants(lines: DataFrame) -> DataFrame:
    """lines (line_id, place, words, shared) -> (line_id, place, at, sub_key, ins_key): a row for each word left out, and one with at = 0 for the whole line.

    sub_key meets lines of the same length and ins_key longer with shorter ones; a key is null where the half that the word is
    in can't hold the edit. shared has a bit for each of HALVES that another line has as well.
    """
    each = lines.select("line_id", "place", "shared", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    (left, whole), (left2, whole2) = (running(each, seed) for seed in (1, 2))
    each = each.select("line_id", "place", "shared", "n", "i", left.alias("left"), whole.alias("whole"), left2.alias("left2"), whole2.alias("whole2"))
    key = lambda *parts: F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))
    has = lambda half: F.col("shared").bitwiseAND(1 << HALVES.index(half)) != 0
    n, i = F.col("n"), F.col("i")
    # The word stands behind the first half, or before the second one; a longer line's halves have a word between them.
    sub = has("p0") & (i >= F.floor(n / 2)) | has("s0") & (i < F.floor(n / 2))
    ins = has("p1") & (i >= F.floor((n - 1) / 2)) | has("s1") & (i <= F.floor((n - 1) / 2))
    deleted = each.filter(sub | ins).select("line_id", "place", (i + 1).alias("at"), F.when(sub, key(n, i, F.col("left"), F.col("left2"))).alias("sub_key"), F.when(ins, key(n - 1, F.col("left"), F.col("left2"))).alias("ins_key"))
    full = each.filter((i == 0) & (has("p0") | has("s0"))).select("line_id", "place", F.lit(0).alias("at"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("sub_key"), key(n, F.col("whole"), F.col("whole2")).alias("ins_key"))
    return deleted.unionByName(full)


def without(words: Column, at: Column) -> Column:
    return F.concat(F.slice(words, 1, at - 1), F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))))


def near_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """line_id of the distinct lines that have an earlier line within one edited word."""
    halves = found.filter("p0 IS NOT NULL").select("line_id", "place", F.posexplode(F.array(*HALVES)).alias("which", "half"))
    of_line = F.xxhash64("line_id")  # a long, so that the aggregation needs no sort
    shared = halves.groupBy("half").agg(F.min(of_line).alias("a"), F.max(of_line).alias("b")).filter("a <> b").select("half")
    some = halves.join(shared, "half", "left_semi").groupBy("line_id", "place").agg(F.bit_or(F.expr("shiftleft(1, which)")).alias("shared"))
    wanted = stage(some, "candidates").select(F.col("place.row").alias("row"), F.struct(F.col("place.pos").alias("pos"), "line_id", "place", "shared").alias("w"))
    of_row = wanted.groupBy("row").agg(F.collect_list("w").alias("wanted"))  # at most the lines of a document
    texts = docs.select("row", "text").join(of_row, "row")
    texts = texts.select(F.split(text_or_empty(), "\n", -1).alias("all"), F.explode("wanted").alias("w"))
    lines = texts.select("w.line_id", "w.place", "w.shared", F.split(normalised(F.col("all")[F.col("w.pos")]), " ").alias("words"))
    lines = stage(lines, "candidate_lines")

    emitted = stage(variants(lines), "variants")
    me = F.struct("place", "line_id", "at")
    # Replaced word: the earliest line of each (length, i, rest).
    first = emitted.filter("sub_key IS NOT NULL").groupBy("sub_key").agg(F.min(me).alias("e"), F.max(me).alias("l")).filter("e.line_id <> l.line_id").select("sub_key", "e")
    replaced = emitted.join(first, "sub_key").filter("line_id <> e.line_id AND at = e.at").select("line_id", "at", F.col("e.line_id").alias("other"), F.col("e.at").alias("other_at"))
    # Inserted or deleted word: whole lines that are a variant of a longer one; the earlier of the two stays.
    whole = emitted.filter("at = 0").select("ins_key", F.col("line_id").alias("o_id"), F.col("place").alias("o_place"))
    longer = emitted.filter("at > 0 AND ins_key IS NOT NULL").select("ins_key", "line_id", "place", "at").join(whole, "ins_key")
    later = F.col("place") > F.col("o_place")
    changed = longer.select(F.when(later, F.col("line_id")).otherwise(F.col("o_id")).alias("line_id"), F.when(later, F.col("at")).otherwise(F.lit(0)).alias("at"), F.when(later, F.col("o_id")).otherwise(F.col("line_id")).alias("other"), F.when(later, F.lit(0)).otherwise(F.col("at")).alias("other_at"))
    pairs = stage(replaced.unionByName(changed).distinct(), "pairs")
    a, b = lines.select("line_id", F.col("words").alias("wa")), lines.select(F.col("line_id").alias("other"), F.col("words").alias("wb"))
    cut = lambda words, at: F.when(F.col(at) == 0, F.col(words)).otherwise(without(F.col(words), F.col(at)))
    same = pairs.join(a, "line_id").join(b, "other").filter(cut("wa", "at") == cut("wb", "other_at"))
    return same.select("line_id").distinct()


def line_dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """De-duplicate the lines of docs (doc_id, text).

    Returns (rows, lines, kept): rows (row, doc_id, text); lines (row, pos, ...), one row for each line that isn't blank; kept
    (line_id, place, near), one row for each distinct line: place is its first occurrence, and near says that it goes because an
    earlier line is within the bound. A line stays where its place is and near is false. Null and empty texts have no lines;
    rows with a null doc_id come after all others; repeated rows are rows of their own, of which one comes first; very long
    texts and lines are read whole; no rows give no rows; other columns are ignored.
    """
    rows = row_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "row")
    lines = stage(all_lines(rows, least_words), "all_lines")
    found = stage(distinct_lines(lines), "lines")
    near = near_repeats(rows, found).withColumn("near", F.lit(True))
    return rows, lines, found.select("line_id", "place").join(near, "line_id", "left").withColumn("near", F.coalesce("near", F.lit(False)))


def left_texts(rows: DataFrame, lines: DataFrame, kept: DataFrame) -> DataFrame:
    """(row, doc_id, text, n_lines, n_near, n_kept) of each row of :func:`line_dedup`'s result: text is what is left of the text.

    Blank lines and the lines that stay are as they were, joined by line feeds; a text without any is empty.
    """
    none, zero = F.lit(None).cast("int"), F.lit(0).cast("long")
    parts = lines.groupBy("row").agg(F.count(F.lit(1)).alias("n_lines")).select("row", "n_lines", zero.alias("n_near"), none.alias("stay"))
    first = kept.select(F.col("place.row").alias("row"), zero.alias("n_lines"), F.col("near").cast("long").alias("n_near"), F.when(~F.col("near"), F.col("place.pos")).alias("stay"))
    found = parts.unionByName(first).groupBy("row").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_near").alias("n_near"), F.collect_list("stay").alias("stays"))
    out = rows.select("row", "doc_id", text_or_empty().alias("text")).join(found, "row", "left")
    counts = [F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce(F.size("stays").cast("long"), zero).alias("n_kept")]
    out = out.select("row", "doc_id", "text", "stays", *counts)
    # Each step is a projection of its own and names the arrays twice, so that none is computed for each line anew.
    out = out.withColumn("pieces", F.when(F.col("n_kept") < F.col("n_lines"), F.split("text", "\n", -1)))
    filled = F.filter(F.transform("pieces", lambda x, i: F.when(has_words(x), i)), lambda i: i.isNotNull())
    out = out.withColumn("gone", F.array_except(filled, F.col("stays")))
    runs = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform("gone", lambda i: i + 1)).alias("a"), F.concat(F.col("gone"), F.array(F.size("pieces"))).alias("b"))
    left = F.flatten(F.transform(runs, lambda r: F.slice("pieces", r["a"] + 1, r["b"] - r["a"])))
    left = F.when(F.col("pieces").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return out.select("row", "doc_id", left.alias("text"), "n_lines", "n_near", "n_kept")


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text) of each row without the lines that go; blank lines and the others stay as they are."""
    return left_texts(*line_dedup(docs, least_words)).select("doc_id", "text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines (not blank), n_near (first occurrences that go for an earlier near line), n_kept, kept_sha256 (of the text left)."""
    out = left_texts(*line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n_lines", "n_near", "n_kept", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), l AS (
  SELECT * FROM (SELECT doc_id, pos, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM d) WHERE line <> ''
), u AS (SELECT line, string_split(line, ' ') AS words, min({'d': doc_id, 'p': pos}) AS place FROM l GROUP BY line),
v AS (
  SELECT line, place, len(words) AS n, i, list_concat(words[:i - 1], words[i + 1:]) AS rest
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM u WHERE len(words) >= 8)
), m AS (SELECT n, i, rest, min(place) AS earliest FROM v GROUP BY ALL),
near AS (
  SELECT v.line FROM v JOIN m ON v.n = m.n AND v.i = m.i AND v.rest = m.rest WHERE v.place > m.earliest
  UNION
  SELECT CASE WHEN v.place > u.place THEN v.line ELSE u.line END FROM v JOIN u ON v.rest = u.words WHERE len(u.words) >= 8
), first_places AS (
  SELECT u.place.d AS doc_id, count(*) FILTER (WHERE near.line IS NOT NULL) AS n_near, count(*) FILTER (WHERE near.line IS NULL) AS n_kept
  FROM u LEFT JOIN near USING (line) GROUP BY 1
), n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id),
stays AS (
  SELECT u.place.d AS doc_id, u.place.p AS pos FROM u WHERE line NOT IN (SELECT line FROM near)
  UNION ALL
  SELECT doc_id, pos FROM d WHERE NOT regexp_matches(raw, '[^\x20\x09-\x0D]')
), left_texts AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS text_left FROM d JOIN stays USING (doc_id, pos) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept,
  sha256(coalesce(text_left, '')) AS kept_sha256
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN first_places USING (doc_id) LEFT JOIN left_texts USING (doc_id)
"""
