"""URL filter lists in time: dated list events become validity intervals, and every capture meets those valid when it was fetched.

All in DataFrame operations. What a URL can be listed by, its host, the host's parent domains, and host and first path
segment, is looked up by equality; the interval then decides. The most specific entry valid at fetch time gives the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/:?#\s]+)"
_SEGMENT = r"^[^:]+://[^/?#]+/([^/?#]+)"


def host(url: Column) -> Column:
    """The host in small letters without a final dot; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), _HOST, 1), r"\.$", "")


def segment(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _SEGMENT, 1)


def keys(host_: Column, segment_: Column) -> Column:
    """What a URL can be listed by: host/segment, host, and each parent domain of two labels or more."""
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when(host_ == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.when(segment_ != "", F.array(F.concat_ws("/", host_, segment_))).otherwise(F.array().cast("array<string>")), parents)))


def intervals(events: DataFrame) -> DataFrame:
    """events(key, verdict, dated): 'block', 'allow', or 'none', which ends an entry -> (key, verdict, since, until), until excluded.

    An entry holds from its date until the key's next event; the last has no end (null). Of several events of a key on a
    day the last verdict in the alphabet counts. Events without key, verdict or date are void. Hosts are taken in small
    letters; a path keeps its case, as in the URLs.
    """
    listed = F.substring_index("key", "/", 1)
    key = F.concat(F.lower(listed), F.col("key").substr(F.char_length(listed) + 1, F.char_length("key")))
    daily = events.where("key IS NOT NULL AND verdict IS NOT NULL AND dated IS NOT NULL").groupBy(key.alias("key"), "dated").agg(F.max("verdict").alias("verdict"))
    # The events of one key are few: one a day at most.
    following = Window.partitionBy("key").orderBy("dated")
    return daily.withColumn("until", F.lead("dated").over(following)).where("verdict <> 'none'").select("key", "verdict", F.col("dated").alias("since"), "until")


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures(page_id, url, fetched_on) and, for each, blocked, entry, verdict, since: the most specific entry valid on that day.

    Captures without a valid entry, a host or a date are not blocked, with null entry. Repeated rows give repeated results,
    other columns are not read, empty tables are fine on either side. A host with very many captures meets the lists once
    for each segment and day; only the last join sees all its rows, and Spark splits those.
    """
    own = captures.select("page_id", F.col("url").cast("string").alias("url"), F.col("fetched_on").cast("date").alias("fetched_on"))
    own = own.withColumn("_host", host(F.col("url"))).withColumn("_segment", segment(F.col("url")))
    asked = own.where("_host <> '' AND fetched_on IS NOT NULL").select("_host", "_segment", "fetched_on").distinct()
    looked_up = asked.withColumn("key", F.explode(keys(F.col("_host"), F.col("_segment"))))
    valid = looked_up.join(intervals(events), "key").where("since <= fetched_on AND (until IS NULL OR fetched_on < until)")
    best = valid.groupBy("_host", "_segment", "fetched_on").agg(F.max(F.struct(F.char_length("key").alias("n"), "key", "verdict", "since")).alias("best"))
    out = own.join(best, ["_host", "_segment", "fetched_on"], "left")
    return out.select("page_id", "url", "fetched_on", F.coalesce(F.col("best.verdict") == "block", F.lit(False)).alias("blocked"), F.col("best.key").alias("entry"), F.col("best.verdict").alias("verdict"), F.col("best.since").alias("since"))


def demonstration_captures(pages: DataFrame) -> DataFrame:
    """pages with a day of fetching, which the table itself lacks: day page_id mod 365 of 2024 (null: null)."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).alias("fetched_on"))


def demonstration_events(pages: DataFrame) -> DataFrame:
    """Dated list events for the keys under which pages can be listed, drawn from the keys' md5: the tables hold no list.

    A key's first event is a block for about a third of the hosts and domains, an allowance for a tenth of host and segment;
    half of these end after 30 to 93 days, and half of those come back 20 days later.
    """
    each = pages.select(host(F.col("url")).alias("h"), segment(F.col("url")).alias("s")).distinct()
    listed = each.select(F.explode(keys(F.col("h"), F.col("s"))).alias("key")).distinct()
    digits = lambda at: F.conv(F.substring(F.md5("key"), at, 4), 16, 10).cast("int")
    path = F.col("key").contains("/")
    chosen = listed.where(F.when(path, digits(1) % 10 == 0).otherwise(digits(1) % 3 == 0))
    start = F.date_add(F.lit("2024-01-01").cast("date"), digits(5) % 300)
    end = F.date_add(start, 30 + digits(9) % 64)
    verdict = F.when(path, "allow").otherwise("block")
    first = chosen.select("key", verdict.alias("verdict"), start.alias("dated"))
    second = chosen.where(digits(13) % 2 == 0).select("key", F.lit("none").alias("verdict"), end.alias("dated"))
    third = chosen.where(digits(13) % 4 == 0).select("key", verdict.alias("verdict"), F.date_add(end, 20).alias("dated"))
    return first.union(second).union(third)


ORACLE = r"""
WITH u AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched_on,
         regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/:?#\s]+)', 1), '\.$', '') AS h,
         regexp_extract(coalesce(url, ''), '^[^:]+://[^/?#]+/([^/?#]+)', 1) AS s
  FROM pages),
k AS (
  SELECT DISTINCT h, s, key FROM (
    SELECT h, s, h || '/' || s AS key FROM u WHERE h <> '' AND s <> ''
    UNION ALL
    SELECT h, s, array_to_string(string_split(h, '.')[i:], '.') AS key
    FROM (SELECT h, s, unnest(range(1, greatest(len(string_split(h, '.')) - 1, 1) + 1)) AS i FROM u WHERE h <> ''))),
x AS (
  SELECT key, contains(key, '/') AS p, CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) AS a, CAST('0x' || substr(md5(key), 5, 4) AS INTEGER) AS b,
         CAST('0x' || substr(md5(key), 9, 4) AS INTEGER) AS c, CAST('0x' || substr(md5(key), 13, 4) AS INTEGER) AS d
  FROM (SELECT DISTINCT key FROM k)),
y AS (SELECT *, CASE WHEN p THEN 'allow' ELSE 'block' END AS v, DATE '2024-01-01' + b % 300 AS s1, DATE '2024-01-01' + b % 300 + 30 + c % 64 AS s2
      FROM x WHERE CASE WHEN p THEN a % 10 = 0 ELSE a % 3 = 0 END),
e AS (
  SELECT key, v AS verdict, s1 AS dated FROM y
  UNION ALL SELECT key, 'none', s2 FROM y WHERE d % 2 = 0
  UNION ALL SELECT key, v, s2 + 20 FROM y WHERE d % 4 = 0),
f AS (SELECT lower(key) AS key, dated, max(verdict) AS verdict FROM e GROUP BY ALL),
i AS (SELECT key, verdict, dated AS since, lead(dated) OVER (PARTITION BY key ORDER BY dated) AS until FROM f),
m AS (
  SELECT k.h, k.s, t.fetched_on, arg_max({'k': i.key, 'v': i.verdict, 'f': i.since}, length(i.key)) AS best
  FROM (SELECT DISTINCT h, s, fetched_on FROM u) t JOIN k ON k.h = t.h AND k.s = t.s JOIN i ON i.key = k.key
  WHERE i.verdict <> 'none' AND i.since <= t.fetched_on AND (i.until IS NULL OR t.fetched_on < i.until)
  GROUP BY ALL)
SELECT u.page_id, u.url, u.fetched_on, coalesce(m.best.v = 'block', false) AS blocked, m.best.k AS entry, m.best.v AS verdict, m.best.f AS since
FROM u LEFT JOIN m ON u.h = m.h AND u.s = m.s AND u.fetched_on = m.fetched_on
"""
