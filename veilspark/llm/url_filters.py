"""URL filters: a temporal join of captures with dated block lists (operator 6, native).

List events (add or remove a key at a time) become validity intervals; a capture is judged by the entries whose
interval holds its fetch time, as of that time. Keys are hosts (a key covers its sub-domains) or a host with a first
path segment. A capture's few keys are exploded and met by equality, so only the interval test is left to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import stage

#: A host may hold a third of all captures: captures are dealt to so many salts, and each interval goes to all.
SALTS = 16


def intervals(events: DataFrame) -> DataFrame:
    """events (list, key, action 'add' or 'remove', at) -> (list, key, valid_from, valid_to), valid_to null while still listed.

    Of events of a key at the same time a removal wins; repeated additions or removals change nothing. Events with a
    null field or another action are left out.
    """
    known = events.select("list", F.lower("key").alias("key"), "action", "at").dropna().filter(F.col("action").isin("add", "remove"))
    one = known.groupBy("list", "key", "at").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    of_key = Window.partitionBy("list", "key").orderBy("at")
    turns = one.withColumn("was", F.lag("action", 1, "remove").over(of_key)).filter("action <> was")
    return turns.withColumn("valid_to", F.lead("at").over(of_key)).filter("action = 'add'").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    """The host of an http(s) URL in lower case, without user, port and a final dot; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*https?://(?:[^/?#@]*@)?([^/:?#\s]+?)\.?(?::\d*)?(?:[/?#]|\s*$)", 1)


def keys_of(url: Column) -> Column:
    """The keys that cover a URL: its host, each parent domain of two labels or more, and host/first path segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, F.greatest(n - i + 1, F.lit(1)))))
    segment = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*https?://[^/?#]+/([^/?#]+)", 1)
    paths = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, paths)))


def url_filter(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) judged by intervals (list, key, valid_from, valid_to).

    Returns one row per capture: page_id, url, fetched, host, n_entries (entries active at the fetch), first_list (the
    first of their lists by name) and blocked. A capture with a null url or fetch time, or without a host, meets
    no entry; repeated captures are judged each; without captures or entries there are no rows or no blocks.
    """
    rows = stage(captures.select("page_id", "url", "fetched").withColumn("row", F.monotonically_increasing_id()).withColumn("host", host_of(F.col("url"))), "captures")
    asked = rows.select("row", "fetched", F.explode(keys_of(F.col("url"))).alias("key"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    spread = listed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = asked.join(spread, ["key", "salt"]).filter("valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to)")
    active = met.groupBy("row").agg(F.count(F.lit(1)).alias("n_entries"), F.min("list").alias("first_list"))
    out = rows.join(active, "row", "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0).cast("long")))
    return out.select("page_id", "url", "fetched", "host", "n_entries", "first_list", (F.col("n_entries") > 0).alias("blocked"))


#: The tables have no fetch times and no lists, so both are derived by rules that either SQL dialect can state.
FETCHED = "CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS DATE)"
DIGIT = "(instr('0123456789abcdef', substr(md5(key), {}, 1)) - 1)"


def dated_lists(hosts: DataFrame) -> DataFrame:
    """List events for (host) rows: a rule on the MD5 of the key decides what is listed, and when it comes and goes."""
    keys = hosts.select(F.explode(F.array(F.col("host"), F.regexp_replace("host", r"^[^.]+\.", ""), F.concat("host", F.lit("/fr")))).alias("key"))
    d = {i: F.expr(DIGIT.format(i)).cast("int") for i in range(1, 6)}
    keys = keys.distinct().filter(F.col("key").contains(".") & (d[1] < 4))
    start, stay = F.date_add(F.lit("2024-01-01").cast("date"), d[2] * 12), d[3] * 9 + 5
    add = keys.select(F.concat(F.lit("list"), d[5] % 3).alias("list"), "key", F.lit("add").alias("action"), start.alias("at"))
    gone = keys.filter(d[4] % 2 == 0).select(F.concat(F.lit("list"), d[5] % 3).alias("list"), "key", F.lit("remove").alias("action"), F.date_add(start, stay).alias("at"))
    back = keys.filter(d[4] % 4 == 0).select(F.concat(F.lit("list"), d[5] % 3).alias("list"), "key", F.lit("add").alias("action"), F.date_add(start, stay + 30).alias("at"))
    return add.unionByName(gone).unionByName(back)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    return url_filter(pages.withColumn("fetched", F.expr(FETCHED)), intervals(dated_lists(hosts)))


_D = {i: f"CAST({DIGIT.format(i)} AS INT)" for i in range(1, 6)}
OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS DATE) AS fetched,
    regexp_extract(lower(coalesce(url, '')), '^\s*https?://(?:[^/?#@]*@)?([^/:?#\s]+?)\.?(?::\d*)?(?:[/?#]|\s*$)', 1) AS host,
    regexp_extract(lower(coalesce(url, '')), '^\s*https?://[^/?#]+/([^/?#]+)', 1) AS segment
  FROM pages
), k AS (
  SELECT DISTINCT unnest([host, regexp_replace(host, '^[^.]+\.', ''), host || '/fr']) AS key FROM p WHERE host <> ''
), listed AS (
  SELECT key, 'list' || ({_D[5]} % 3) AS list, CAST(DATE '2024-01-01' + {_D[2]} * 12 AS DATE) AS since, {_D[3]} * 9 + 5 AS stay, {_D[4]} AS d4
  FROM k WHERE contains(key, '.') AND {_D[1]} < 4
), spans AS (
  SELECT key, list, since AS valid_from, CASE WHEN d4 % 2 = 0 THEN CAST(since + stay AS DATE) END AS valid_to FROM listed
  UNION ALL
  SELECT key, list, CAST(since + stay + 30 AS DATE), NULL FROM listed WHERE d4 % 4 = 0
), asked AS (
  SELECT DISTINCT page_id, fetched, unnest(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END)) AS key
  FROM p WHERE host <> ''
), active AS (
  SELECT a.page_id, count(*) AS n_entries, min(s.list) AS first_list FROM asked a JOIN spans s ON a.key = s.key
    AND s.valid_from <= a.fetched AND (s.valid_to IS NULL OR a.fetched < s.valid_to) GROUP BY a.page_id
)
SELECT p.page_id, p.url, p.fetched, p.host, coalesce(a.n_entries, 0) AS n_entries, a.first_list, coalesce(a.n_entries, 0) > 0 AS blocked
FROM p LEFT JOIN active a USING (page_id)
"""
