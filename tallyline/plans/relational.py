"""Joins and windows of the evidence model on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text
from ..operators import dedup, headers, joins, windows
from .base import Tables, query

BOXES = """
b AS (
  SELECT l_orderkey AS page, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 5 + l_linenumber AS x1, l_discount * 100 + 4 + l_tax * 100 AS y1, l_returnflag AS word
  FROM lineitem)"""
AREA = "greatest(0.0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0.0, least(a.y1, c.y1) - greatest(a.y0, c.y0))"


def _boxes(t: Tables) -> DataFrame:
    """Boxes from the figures of order lines; an order is a page."""
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    box = g.box(q, d, q + 5 + F.col("l_linenumber"), d + 4 + F.col("l_tax") * 100)
    return t.lineitem.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("word"), box.alias("box")
    )


@query(f"""
WITH {BOXES}
SELECT a.page, count(*) AS n_pairs, round(max({AREA} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - {AREA})), 9) AS max_iou,
       round(max({AREA} / least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0))), 9) AS max_ios
FROM b a JOIN b c ON a.page = c.page AND (a.line, a.part, a.supp) < (c.line, c.part, c.supp)
WHERE {AREA} > 0 GROUP BY a.page
""")
def iou_pairs(t: Tables) -> DataFrame:
    """Overlapping pairs of a page."""
    b = _boxes(t).select("page", F.struct("line", "part", "supp").alias("id"), "box")
    c = b.select("page", F.col("id").alias("id2"), F.col("box").alias("box2"))
    pairs = b.join(c, "page").filter("id < id2").filter(g.intersection(F.col("box"), F.col("box2")) > 0)
    return pairs.groupBy("page").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.round(F.max(g.iou(F.col("box"), F.col("box2"))), 9).alias("max_iou"),
        F.round(F.max(g.ios(F.col("box"), F.col("box2"))), 9).alias("max_ios"),
    )


@query()
def dedup_boxes(t: Tables) -> DataFrame:
    """Greedy survivors of a page's words; what counts is overlap with those already kept, so SQL has no form of it."""
    words = _boxes(t).select(
        "page", F.col("word").alias("text"), "box", (F.lit(1.0) - F.col("line") / 100).alias("confidence"), F.lit("digital").alias("source"), F.struct("line", "part", "supp").alias("id")
    )
    kept = dedup.unique_words(words, ["page"])
    return kept.groupBy("page").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("id.line").alias("lines"))


@query("""
SELECT r.r_name AS band, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem JOIN region r ON l_quantity >= r.r_regionkey * 10 + 1 AND l_quantity <= r.r_regionkey * 10 + 10 GROUP BY r.r_name
""")
def band_join(t: Tables) -> DataFrame:
    """Quantities in the band that holds them, bounds included; the five bands are broadcast."""
    bands = t.region.select(F.lit(1).alias("page"), F.col("r_name").alias("band"), (F.col("r_regionkey") * 10 + 1).alias("low"), (F.col("r_regionkey") * 10 + 10).alias("high"))
    inside = joins.band_join(t.lineitem.withColumn("page", F.lit(1)), F.broadcast(bands), ["page"], F.col("l_quantity"))
    return inside.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))


@query("""
WITH c AS (SELECT p_brand, p_size, avg(CAST(p_retailprice AS DECIMAL(18,2)))::DOUBLE AS unused, count(*) AS n FROM part GROUP BY p_brand, p_size),
m AS (SELECT p_brand, p_size, (lag(p_size) OVER w + p_size) / 2.0 AS low, (p_size + lead(p_size) OVER w) / 2.0 AS high FROM c WINDOW w AS (PARTITION BY p_brand ORDER BY p_size))
SELECT p_brand, CAST(p_size AS BIGINT) AS center, coalesce(low, -1)::DOUBLE AS low, coalesce(high, -1)::DOUBLE AS high FROM m
""")
def header_bands(t: Tables) -> DataFrame:
    """Column bounds half way between header centres."""
    centers = t.part.select("p_brand", F.col("p_size").cast("double").alias("center")).distinct()
    bands = windows.midpoints(centers, ["p_brand"], "center")
    closed = lambda c: F.when(F.abs(c) == float("inf"), -1.0).otherwise(c)
    return bands.select("p_brand", F.col("center").cast("long").alias("center"), closed(F.col("low")).alias("low"), closed(F.col("high")).alias("high"))


@query("""
WITH p AS (
  SELECT s.s_suppkey, c.c_custkey, abs(CAST(s.s_acctbal AS DECIMAL(18,2)) - CAST(c.c_acctbal AS DECIMAL(18,2))) AS d FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) AS k FROM p)
SELECT s_suppkey, c_custkey FROM r WHERE k = 1
""")
def nearest_owner(t: Tables) -> DataFrame:
    """The customer of a supplier's nation with the nearest balance."""
    exact = lambda c: F.col(c).cast("decimal(18,2)").alias("balance")
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), "s_suppkey", exact("s_acctbal"))
    c = t.customer.select(F.col("c_nationkey").alias("nation"), "c_custkey", exact("c_acctbal"))
    return joins.nearest_value(s, c, ["nation"], "s_suppkey", "c_custkey", "balance").select("s_suppkey", "c_custkey")


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, l_suppkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
b AS (SELECT *, max(n) OVER (PARTITION BY o_orderkey) AS m FROM p),
t AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS ties FROM b WHERE n = m)
SELECT o_orderkey, l_suppkey FROM t WHERE ties = 1
""")
def unique_ownership(t: Tables) -> DataFrame:
    """The supplier with strictly the most lines of an order owns it."""
    pairs = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joins.unique_best(pairs, ["o_orderkey"], F.col("n")).select("o_orderkey", "l_suppkey")


@query("""
WITH s AS (
  SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section
  FROM events)
SELECT user_id, CAST(section AS BIGINT) AS section, count(*) FILTER (event_type <> 'purchase') AS n_regions, bool_or(event_type = 'purchase') AS has_total,
       CASE WHEN count(*) FILTER (event_type <> 'purchase') = 0 THEN 'total_without_table' ELSE '' END AS diagnostic
FROM s GROUP BY user_id, section
""")
def interval_between_totals(t: Tables) -> DataFrame:
    """Events between two purchases of a user."""
    total = F.col("event_type") == "purchase"
    sectioned = joins.between_marks(t.events, ["user_id"], ["ts", "event_id"], total)
    regions = F.count_if(~total)
    return sectioned.groupBy("user_id", "section").agg(regions.alias("n_regions"), F.bool_or(total).alias("has_total"), F.when(regions == 0, "total_without_table").otherwise("").alias("diagnostic"))


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.event_id, b.event_id AS preceding
FROM (SELECT * FROM e WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.k > b.k
""")
def asof_preceding(t: Tables) -> DataFrame:
    """The last view of a user before each purchase, one sorted pass instead of a join."""
    seen = joins.preceding(t.events, ["user_id"], ["ts", "event_id"], F.col("event_id"), F.col("event_type") == "view", "preceding")
    return seen.filter("event_type = 'purchase'").select("event_id", "preceding")


@query("""
WITH p AS (SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND CAST(floor(s.s_acctbal / 100) AS BIGINT) = CAST(floor(c.c_acctbal / 100) AS BIGINT)),
n AS (SELECT *, count(*) OVER (PARTITION BY s_suppkey) AS a, count(*) OVER (PARTITION BY c_custkey) AS b FROM p)
SELECT s_suppkey, c_custkey FROM n WHERE a = 1 AND b = 1
""")
def mutual_unique_match(t: Tables) -> DataFrame:
    """Balances that round to the same hundred inside a nation, unique on both sides."""
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("missing"))
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("missing"))
    return joins.mutually_unique(s, c, ["nation", "missing"], "s_suppkey", "c_custkey").select("s_suppkey", "c_custkey")


@query("""
SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def full_identity(t: Tables) -> DataFrame:
    """J2, U6."""
    return joins.identity_gaps(t.documents, t.labels, ["doc_id"])


@query("""
SELECT o_custkey, count(*) AS n_unclaimed FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity >= 25) GROUP BY o_custkey
""")
def unclaimed_regions(t: Tables) -> DataFrame:
    """Orders that no large line claims."""
    large = t.lineitem.filter("l_quantity >= 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(large, "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_unclaimed"))


@query("""
SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity = p_size)
""")
def corroborated_values(t: Tables) -> DataFrame:
    """Parts whose size a returned line's quantity repeats."""
    notes = t.lineitem.filter("l_returnflag = 'R'").select("l_partkey", "l_quantity")
    return t.part.join(notes, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_quantity") == F.col("p_size")), "left_semi").select("p_partkey")


HEADERS = (
    "Transaction date", "the posting date of it", "Amount charged", "amount due", "Original Amount / currency", "merchant", "סכוםהעסקה", "תאריך", "סכום לחיוב בש״ח", "שם בית Qxz", "exchange-rate", "unknown thing",
    "Date of conversion", "123", "billing currency code", "details, city", "Installments", "commission amount", "עסק",
)
_TERMS = ", ".join(f"('{role}', '{term}')" for role, terms in headers.TERMS.items() for term in terms)
_HEADERS = ", ".join(f"({i}, '{h}')" for i, h in enumerate(HEADERS))


@query(rf"""
WITH v(role, term) AS (VALUES {_TERMS}), h(i, header) AS (VALUES {_HEADERS}),
w AS (SELECT i, trim(regexp_replace(lower(header), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS line FROM h),
m AS (
  SELECT w.i, v.role, max(CASE WHEN line = term OR (regexp_matches(term, '\p{{Hebrew}}') AND replace(line, ' ', '') = replace(term, ' ', '')) THEN 1.0
    WHEN regexp_matches(term, '\p{{Hebrew}}') AND (contains(replace(line, ' ', ''), replace(term, ' ', ''))
      OR (len(string_split(term, ' ')) >= 3 AND len(string_split(line, ' ')) = len(string_split(term, ' ')) AND string_split(line, ' ')[:-2] = string_split(term, ' ')[:-2] AND regexp_matches(string_split(line, ' ')[-1], '^[a-z]+$'))) THEN 0.82
    WHEN contains(' ' || line || ' ', ' ' || term || ' ') THEN 0.82 ELSE 0.0 END) AS score
  FROM w, v GROUP BY ALL),
r AS (SELECT *, row_number() OVER o AS k, lead(score) OVER o AS next, count(*) FILTER (WHERE score = 1) OVER (PARTITION BY i) AS exact FROM m WINDOW o AS (PARTITION BY i ORDER BY score DESC, role))
SELECT event_id, CASE WHEN exact = 1 OR (score >= 0.65 AND score - next >= 0.13) THEN role ELSE 'UNKNOWN' END AS role, score::DOUBLE AS score FROM events JOIN r ON r.i = event_id % {len(HEADERS)} WHERE k = 1
""")
def header_roles(t: Tables) -> DataFrame:
    """A header's role by its score against the vocabulary of all roles, accepted from .65 with a lead of .13."""
    header = F.element_at(F.array(*(F.lit(h) for h in HEADERS)), (F.pmod("event_id", F.lit(len(HEADERS))) + 1).cast("int"))
    scored = t.events.select("event_id", headers.role_scores(header).alias("scores"))
    return scored.select("event_id", headers.role(F.col("scores")).alias("role"), F.coalesce(F.get("scores", F.lit(0))["score"], F.lit(0.0)).alias("score"))


@query("""
SELECT l_orderkey AS page, min(l_quantity)::DOUBLE AS x0, max(l_quantity + 5 + l_linenumber)::DOUBLE AS x1, count(*) AS n FROM lineitem GROUP BY l_orderkey
""")
def union_box(t: Tables) -> DataFrame:
    """A7."""
    boxed = _boxes(t).groupBy("page").agg(g.union_box(F.col("box")).alias("u"), F.count(F.lit(1)).alias("n"))
    return boxed.select("page", F.col("u.x0").alias("x0"), F.col("u.x1").alias("x1"), "n")


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events),
g AS (SELECT *, t - lag(t) OVER w AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS cell FROM g)
SELECT user_id, CAST(cell - 1 AS BIGINT) AS cell, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, cell
""")
def gap_cells(t: Tables) -> DataFrame:
    """Runs of a user's events with gaps of up to six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts"))
    cells = windows.sessions(t.events.withColumn("gap", gap), ["user_id"], ["ts", "event_id"], F.col("gap").isNull() | (F.col("gap") > 21600000000), "cell")
    return cells.groupBy("user_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS owner FROM conversations
""")
def continuation_owner(t: Tables) -> DataFrame:
    """The last user turn owns what follows it."""
    return windows.owners(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user", F.col("turn")).select("conv_id", "turn", "owner")


@query("""
SELECT event_id, lag(event_id) OVER w AS previous_event_id, lead(event_id) OVER w AS next_event_id, CAST((epoch_us(ts) - lag(epoch_us(ts)) OVER w) AS BIGINT) AS gap
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def prev_next_gap(t: Tables) -> DataFrame:
    """W1, W14."""
    near = windows.neighbours(windows.neighbours(t.events, ["user_id"], ["ts", "event_id"], "event_id"), ["user_id"], ["ts", "event_id"], "ts")
    return near.select("event_id", "previous_event_id", "next_event_id", F.timestamp_diff("MICROSECOND", F.col("previous_ts"), F.col("ts")).alias("gap"))


@query("""
SELECT event_id, printf('group-p%03d-r%04d', user_id % 1000, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS row_id FROM events
""")
def row_ids(t: Tables) -> DataFrame:
    """W2."""
    ordinal = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", F.format_string("group-p%03d-r%04d", F.pmod("user_id", F.lit(1000)), ordinal).alias("row_id"))


@query("""
SELECT c_custkey, printf('group-%04d', dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment)) AS group_id FROM customer WHERE c_acctbal > 0
""")
def group_numbers(t: Tables) -> DataFrame:
    """W3."""
    rank = F.dense_rank().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment"))
    return t.customer.filter("c_acctbal > 0").select("c_custkey", F.format_string("group-%04d", rank).alias("group_id"))


@query("""
WITH RECURSIVE s AS (
  SELECT p_brand, list_sort(list(DISTINCT CAST(p_retailprice AS DOUBLE))) AS v FROM part GROUP BY p_brand),
k(p_brand, v, kept, n) AS (
  SELECT p_brand, v, v[1], 1 FROM s
  UNION ALL
  SELECT p_brand, v, list_min(list_filter(v, lambda x: x - kept > 25.0)), n + 1 FROM k WHERE list_min(list_filter(v, lambda x: x - kept > 25.0)) IS NOT NULL)
SELECT p_brand, CAST(max(n) AS BIGINT) AS n_kept, max(kept) AS last_kept FROM k GROUP BY p_brand
""")
def spaced_separators(t: Tables) -> DataFrame:
    """Prices of a brand that are more than 25 above the last kept one."""
    values = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_retailprice")).alias("v"))
    kept = values.select("p_brand", windows.spaced(F.col("v"), F.lit(25.0)).alias("kept"))
    return kept.select("p_brand", F.size("kept").cast("long").alias("n_kept"), F.element_at("kept", -1).alias("last_kept"))


@query("""
WITH w AS (
  SELECT l_orderkey AS page, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CAST(CAST(l_quantity * 10 AS BIGINT) AS VARCHAR) AS word, l_quantity AS q FROM lineitem),
s AS (SELECT page, substr(word, 1, length(word) - 1) AS short, word, q FROM w WHERE length(word) >= 3)
SELECT page, count(*) AS n_primary, count(*) AS n_replaced, CAST(sum(CAST(word AS BIGINT)) AS BIGINT) AS digits_sum
FROM (SELECT page, q, max(word) AS word FROM s GROUP BY page, q, short) GROUP BY page
""")
def ocr_fuse(t: Tables) -> DataFrame:
    """Truncated numbers in boxes that only their own longer reading overlaps."""
    q = F.col("l_quantity")
    word = (q * 10).cast("long").cast("string")
    read = t.lineitem.select(F.col("l_orderkey").alias("page"), word.alias("text"), g.box(q * 100, F.lit(0), q * 100 + 50, F.lit(10)).alias("box"), F.lit(0.9).alias("confidence")).filter(F.length("text") >= 3)
    read = read.distinct()
    short = read.withColumn("text", F.expr("substr(text, 1, length(text) - 1)")).withColumn("ordinal", F.row_number().over(Window.partitionBy("page").orderBy("box")))
    fused = joins.fuse_words(short, read, ["page"])
    return fused.groupBy("page").agg(F.count(F.lit(1)).alias("n_primary"), F.count_if("replaced").alias("n_replaced"), F.sum(F.col("text").cast("long")).alias("digits_sum"))


@query("""
WITH w AS (SELECT doc_id % 5 AS kind, doc_id, CAST(doc_id % 97 AS BIGINT) AS x, CAST(doc_id % 31 AS BIGINT) AS y FROM documents)
SELECT doc_id, round(x * 72.0 / 300, 9)::DOUBLE AS x0, round((y + 10) * 72.0 / 300, 9)::DOUBLE AS y1, 0.87::DOUBLE AS confidence, 'w' || doc_id AS word FROM w WHERE kind IN (0, 4)
""")
def tsv_words(t: Tables) -> DataFrame:
    """SRC3: recognised words from tab-separated lines; bad lines (few fields, negative confidence, no width) fall out."""
    from ..sources.tsv import words_of_lines

    fields = lambda width, confidence, n: F.concat_ws("\t", *(F.lit(str(i)) for i in range(n)), F.pmod("doc_id", F.lit(97)).cast("string"), F.pmod("doc_id", F.lit(31)).cast("string"), F.lit(width), F.lit("10"), F.lit(confidence), F.concat(F.lit(" w"), F.col("doc_id").cast("string")))
    kind = F.pmod("doc_id", F.lit(5))
    line = F.when(kind == 0, fields("20", "87", 6)).when(kind == 1, fields("20", "87", 5)).when(kind == 2, fields("0", "87", 6)).when(kind == 3, fields("20", "-1", 6)).otherwise(fields("20", "87.0", 6))
    words = words_of_lines(t.documents.select("doc_id", line.alias("line")), "line", dpi=300, origin=(0.0, 0.0))
    return words.select("doc_id", F.round("box.x0", 9).alias("x0"), F.round("box.y1", 9).alias("y1"), "confidence", F.col("text").alias("word"))
