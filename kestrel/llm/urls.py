"""URL filtering with a temporal list join.

A list is a log of dated entries (rule key, action, date).  The entries of each
key become validity intervals that end where the key's next entry begins; an
as-of join then evaluates every capture against the entries active when it was
fetched.  A capture's rule keys are its host with all parent domains and its
host with all leading path folders; of the active entries the longest key
decides, so an allowed page inside a blocked domain stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import table


def validity(entries: DataFrame) -> DataFrame:
    """(rule_key, action, valid_from, valid_to): half-open intervals; the last of a key is open (null).

    ``entries`` has rule_key, action (block, allow or remove) and listed_at.  Of
    entries of one key and time the alphabetically last action holds; removals end
    an interval and open none; entries with a null in any column are left out.
    """
    log = entries.select(F.lower("rule_key").alias("rule_key"), "action", "listed_at").where("rule_key IS NOT NULL AND action IS NOT NULL AND listed_at IS NOT NULL")
    log = log.groupBy("rule_key", "listed_at").agg(F.max("action").alias("action"))
    later = F.lead("listed_at").over(Window.partitionBy("rule_key").orderBy("listed_at"))
    spans = log.select("rule_key", "action", F.col("listed_at").alias("valid_from"), later.alias("valid_to"))
    return spans.where("action IN ('block', 'allow')")


def host_of(url):
    """Lower-case host without user and port; null where the text is no URL with a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def rule_keys(url):
    """All keys a capture's URL answers to: parent domains, and the host with leading folders."""
    host = host_of(url)
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    folders = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    upto = F.size(folders)
    nested = F.when(upto > 0, F.transform(F.sequence(F.lit(1), upto), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(folders, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, nested))).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """One row a capture: id, host, fetched_at, matched rule and action at fetch time, kept.

    Captures without a host, a time or an active entry are kept with no rule.  An
    entry is active from its time on, until before its key's next entry.  Lists of
    a size that Spark has measured to be small are broadcast; else both sides are
    dealt by key, and adaptive execution splits a host that holds many captures.
    Repeated rows come back as often as they are there.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("timestamp").alias("fetched_at"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    spans = validity(entries)
    keyed = rows.select("url", "fetched_at", "page_id", "host", F.explode_outer(rule_keys(F.col("url"))).alias("k"))
    active = (F.col("k") == F.col("rule_key")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = keyed.join(spans, active, "left")
    best = F.max(F.when(F.col("rule_key").isNotNull(), F.struct(F.char_length("rule_key").alias("n"), F.col("rule_key").alias("rule"), F.col("action").alias("action"))))
    own = F.count_if(F.col("k").isNull() | (F.col("k") == F.col("host")))  # a row has its host once among its keys
    judged = hits.groupBy("page_id", "url", "fetched_at", "host").agg(best.alias("b"), own.alias("times"))
    out = judged.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return out.select("page_id", "host", "fetched_at", F.col("b.rule").alias("matched_rule"), F.col("b.action").alias("action"), (F.coalesce("b.action", F.lit("allow")) != "block").alias("kept"))


def _fetch_time(page_id):
    """A capture's fetch time where the table has none: a fixed rule over two years."""
    return F.timestamp_seconds(F.lit(1704067200) + F.pmod(page_id * 7919, F.lit(730)) * 86400 + F.pmod(page_id, F.lit(86400)))


def _entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and their folders that the pages have, by a fixed rule of their digests."""
    host = host_of(F.col("url"))
    folder = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)
    keys = pages.select(host.alias("h"), F.concat(host, F.lit("/"), F.lower(folder)).alias("f"), F.concat_ws(".", F.slice(F.split(host, r"\."), -3, 3)).alias("d"))
    keys = keys.select(F.explode(F.array("h", "f", "d")).alias("rule_key")).where("rule_key IS NOT NULL").distinct()
    digit = F.conv(F.substring(F.md5(F.col("rule_key").cast("binary")), 1, 4), 16, 10).cast("long")
    day = lambda k: F.timestamp_seconds(F.lit(1704067200) + F.pmod(digit * k, F.lit(730)) * 86400)
    first = F.when(digit % 3 == 0, "block").when(digit % 3 == 1, "allow")
    dated = keys.select("rule_key", F.explode(F.array(
        F.struct(first.alias("action"), day(1).alias("listed_at")),
        F.struct(F.lit("remove").alias("action"), day(5).alias("listed_at")),
        F.struct(F.when(digit % 3 == 0, "allow").when(digit % 3 == 1, "block").alias("action"), day(11).alias("listed_at")),
    )).alias("e"))
    return dated.select("rule_key", "e.action", "e.listed_at")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page capture judged by the list entries active at its fetch time.

    Pages carry no fetch time and no list comes with them, so both follow a fixed
    rule of page_id and of the digests of hosts and folders, which the SQL
    restates.  A null url has no host and is kept; a null page_id has no fetch time
    and is kept; an empty table gives no rows.
    """
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", _fetch_time(F.col("page_id")).alias("fetched_at"))
    return judge(captures, _entries(pages), "page_id", "url", "fetched_at")


SQL = r"""
WITH p AS (SELECT page_id, url, to_timestamp(1704067200 + ((page_id * 7919) % 730) * 86400 + page_id % 86400) AT TIME ZONE 'UTC' AS fetched_at,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1)), '/'), lambda x: x <> '') AS folders,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)', 1)) AS folder FROM pages),
q AS (SELECT *, string_split(host, '.') AS parts FROM p),
k AS (SELECT DISTINCT unnest([host, host || '/' || folder, array_to_string(parts[-3:], '.')]) AS rule_key FROM q WHERE host IS NOT NULL),
g AS (SELECT rule_key, CAST('0x' || substr(md5(rule_key), 1, 4) AS BIGINT) AS x FROM k),
e AS (SELECT rule_key, CASE x % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END AS action, to_timestamp(1704067200 + (x % 730) * 86400) AT TIME ZONE 'UTC' AS since FROM g
  UNION ALL SELECT rule_key, 'remove', to_timestamp(1704067200 + (x * 5 % 730) * 86400) AT TIME ZONE 'UTC' FROM g
  UNION ALL SELECT rule_key, CASE x % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' END, to_timestamp(1704067200 + (x * 11 % 730) * 86400) AT TIME ZONE 'UTC' FROM g),
o AS (SELECT rule_key, since, max(action) AS action FROM e WHERE action IS NOT NULL GROUP BY ALL),
v AS (SELECT rule_key, action, since AS valid_from, lead(since) OVER (PARTITION BY rule_key ORDER BY since) AS valid_to FROM o),
c AS (SELECT page_id, url, host, fetched_at, unnest(list_distinct(list_concat(
    list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '.')),
    list_transform(range(1, len(folders) + 1), lambda i: host || '/' || array_to_string(folders[1:i], '/'))))) AS key FROM q WHERE host IS NOT NULL),
h AS (SELECT c.page_id, max({'n': length(v.rule_key), 'rule': v.rule_key, 'action': v.action}) AS b FROM c JOIN v
  ON c.key = v.rule_key AND v.action IN ('block', 'allow') AND c.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to) GROUP BY c.page_id)
SELECT q.page_id, host, fetched_at, b.rule AS matched_rule, b.action AS action, coalesce(b.action, 'allow') <> 'block' AS kept FROM q LEFT JOIN h ON q.page_id = h.page_id
"""
