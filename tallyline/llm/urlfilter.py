"""URL filter by a temporal list join.

A list's history is a table of dated entries: a domain is put on a list, or
taken off it. Each entry is valid from its date until the next entry of the
same list and domain (a validity interval), and a capture is judged as of its
fetch date: an entry counts if it is the last one on or before that date and it
put the domain on the list. A domain covers its subdomains. Of the active
entries the longest domain wins, and at equal length an allowing list.

A capture is reduced to its host and date before the join, so that a host with
a third of all captures is judged once a day; the host's domains (bounded by
its labels) are then the join keys. The entries, and the verdicts that go back
to the captures, are broadcast only below MOST_BROADCAST rows, by count. Beyond
it the entries' join shuffles, and the captures of a host and day are dealt over
SALTS tasks. ENTRIES is an example of a list's history: any table of its columns
will do.

Defined results: a null URL or one without a host is judged ``none``; a null
date has no active entries; entries without a domain or date are void; of
entries of one list and domain on one date, one that takes off holds; repeated
captures get equal results; empty tables give no rows, or no verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import Durable

MOST_BROADCAST, SALTS = 100_000, 64
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"

# fixed values: (list, verdict, domain, date, on the list from then)
ENTRIES = (
    ("abuse", "block", "casino-win.example.com", "2024-01-15", True),
    ("abuse", "block", "casino-win.example.net", "2024-02-01", True),
    ("abuse", "block", "casino-win.example.org", "2024-02-01", True),
    ("abuse", "block", "casino-win.example.net", "2024-09-01", False),
    ("abuse", "block", "cheap-pills.example.com", "2023-11-20", True),
    ("abuse", "block", "cheap-pills.example.net", "2024-05-05", True),
    ("abuse", "block", "cheap-pills.example.org", "2024-05-05", True),
    ("abuse", "block", "spam-farm.example.com", "2024-03-10", True),
    ("abuse", "block", "spam-farm.example.com", "2024-04-10", False),
    ("abuse", "block", "spam-farm.example.com", "2024-08-10", True),
    ("abuse", "block", "spam-farm.example.org", "2023-06-01", True),
    ("adult", "block", "adult-x.example.com", "2023-01-01", True),
    ("adult", "block", "adult-x.example.net", "2024-07-01", True),
    ("adult", "block", "adult-x.example.org", "2023-01-01", True),
    ("ads", "block", "ads-track.example.com", "2024-01-01", True),
    ("ads", "block", "ads-track.example.net", "2024-01-01", True),
    ("ads", "block", "ads-track.example.org", "2024-06-15", True),
    ("ads", "block", "free-bets.example.com", "2024-10-01", True),
    ("ads", "block", "free-bets.example.net", "2023-10-01", True),
    ("trusted", "allow", "blog.casino-win.example.com", "2024-06-01", True),
    ("trusted", "allow", "blog.casino-win.example.com", "2024-11-01", False),
    ("trusted", "allow", "m.ads-track.example.com", "2024-03-01", True),
)


def entry_table(spark) -> DataFrame:
    table = spark.createDataFrame(list(ENTRIES), "list string, verdict string, domain string, dated string, listed boolean")
    return table.withColumn("dated", F.col("dated").cast("date"))


def host_of(url: Column) -> Column:
    return F.rtrim(F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit("")), F.lit("."))


def domains_of(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, domain, valid_from, valid_until) of the times that a domain is on a list; open ends are null."""
    entries = entries.filter("domain is not null and dated is not null").select("list", "verdict", F.lower("domain").alias("domain"), "dated", "listed")
    entries = entries.groupBy("list", "domain", "dated").agg(F.max("verdict").alias("verdict"), F.min("listed").alias("listed"))
    until = F.lead("dated").over(Window.partitionBy("list", "domain").orderBy("dated"))
    return entries.withColumn("valid_until", until).filter("listed").select("list", "verdict", "domain", F.col("dated").alias("valid_from"), "valid_until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (page_id, url, fetched_on) with host, verdict, list, domain, valid_from."""
    valid = intervals(entries)
    if valid.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        valid = F.broadcast(valid)
    hosted = captures.select("page_id", "fetched_on", host_of(F.col("url")).alias("host"))
    asked = hosted.filter("host != ''").select("host", "fetched_on").distinct()
    keyed = asked.select("host", "fetched_on", F.explode(domains_of(F.col("host"))).alias("domain"))
    active = keyed.join(valid, "domain").filter("valid_from <= fetched_on and (valid_until is null or fetched_on < valid_until)")
    best = F.max_by(
        F.struct("verdict", "list", "domain", "valid_from"),
        F.struct(F.length("domain"), (F.col("verdict") == "allow"), F.col("list")),
    )
    verdicts = Durable(captures.sparkSession).keep(active.groupBy("host", "fetched_on").agg(best.alias("best")))
    if verdicts.count() <= MOST_BROADCAST:
        judged = hosted.join(F.broadcast(verdicts), ["host", "fetched_on"], "left")
    else:
        salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        judged = dealt.join(salted, ["host", "fetched_on", "salt"], "left")
    return judged.select(
        "page_id",
        "host",
        "fetched_on",
        F.coalesce("best.verdict", F.lit("none")).alias("verdict"),
        F.col("best.list").alias("list"),
        F.col("best.domain").alias("domain"),
        F.col("best.valid_from").alias("valid_from"),
    )


def with_fetch_date(pages: DataFrame) -> DataFrame:
    """``pages`` has no fetch time, so each page gets a fixed day of 2024 from its id."""
    return pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")))


def oracle_sql() -> str:
    rows = ",\n    ".join(f"('{lst}', '{verdict}', '{domain}', DATE '{day}', {str(on).lower()})" for lst, verdict, domain, day, on in ENTRIES)
    return rf"""
WITH entries(list, verdict, domain, dated, listed) AS (VALUES
    {rows}),
valid AS (
  SELECT * FROM (SELECT *, lead(dated) OVER (PARTITION BY list, domain ORDER BY dated) AS valid_until FROM entries) WHERE listed),
captures AS (
  SELECT page_id, rtrim(coalesce(regexp_extract(lower(url), '{HOST}', 1), ''), '.') AS host,
         DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS fetched_on
  FROM pages),
ranked AS (
  SELECT c.page_id, v.verdict, v.list, v.domain, v.dated AS valid_from,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.domain) DESC, v.verdict = 'allow' DESC, v.list DESC) AS place
  FROM captures c JOIN valid v
    ON (c.host = v.domain OR ends_with(c.host, '.' || v.domain))
   AND v.dated <= c.fetched_on AND (v.valid_until IS NULL OR c.fetched_on < v.valid_until))
SELECT c.page_id, c.host, CAST(c.fetched_on AS VARCHAR) AS fetched_on, coalesce(r.verdict, 'none') AS verdict, r.list, r.domain, CAST(r.valid_from AS VARCHAR) AS valid_from
FROM captures c LEFT JOIN ranked r ON r.page_id = c.page_id AND r.place = 1
"""
