"""Evidence rules on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import evidence as e
from .base import Tables, query
from .relational import _boxes


@query("""
WITH c AS (
  SELECT l_orderkey AS page, l_partkey AS atom, CASE WHEN l_returnflag = 'R' THEN 'billed' WHEN l_returnflag = 'A' THEN 'date' ELSE 'ancillary' END AS owner,
         CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 3 END AS priority FROM lineitem),
f AS (SELECT page, atom, arg_min(owner, priority) AS owner FROM c GROUP BY page, atom)
SELECT page, count(*) AS n_atoms, count(*) FILTER (owner = 'billed') AS n_billed, count(*) FILTER (owner = 'ancillary') AS n_ancillary FROM f GROUP BY page
""")
def first_claims(t: Tables) -> DataFrame:
    """An atom belongs to the first claim in the order of the rules."""
    flag = F.col("l_returnflag")
    claims = t.lineitem.select(
        F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("atom"), F.when(flag == "R", "billed").when(flag == "A", "date").otherwise("ancillary").alias("owner"), F.when(flag == "R", 1).when(flag == "A", 2).otherwise(3).alias("priority")
    )
    first = e.first_claims(claims, ["page", "atom"], "priority", ["owner"])
    return first.groupBy("page").agg(F.count(F.lit(1)).alias("n_atoms"), F.count_if(F.col("owner") == "billed").alias("n_billed"), F.count_if(F.col("owner") == "ancillary").alias("n_ancillary"))


@query("""
WITH d AS (SELECT l_orderkey AS page, l_partkey AS part, max(l_tax) AS tax FROM lineitem GROUP BY ALL)
SELECT page, part, CAST(row_number() OVER (PARTITION BY page ORDER BY part) - 1 AS BIGINT) AS atom_id, tax FROM d
""")
def atom_ledger(t: Tables) -> DataFrame:
    """Atoms once, the surest of equals, numbered in reading order."""
    atoms = t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("part"), F.col("l_tax").alias("tax"))
    return e.ledger(atoms, ["page"], ["part"], "tax", ["part"]).select("page", "part", F.col("atom_id").cast("long").alias("atom_id"), "tax")


@query("""
WITH r AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey),
c AS (SELECT l_suppkey, l_linenumber, count(DISTINCT l_orderkey) AS support FROM lineitem GROUP BY ALL)
SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, support, round(support / n, 9) AS fraction, support < least(2, n) AS weak FROM c JOIN r USING (l_suppkey)
""")
def column_support(t: Tables) -> DataFrame:
    """The share of a supplier's orders that have a line of a number."""
    return e.column_support(t.lineitem, ["l_suppkey"], "l_linenumber", "l_orderkey").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query("""
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 10) = 1 AND count(*) FILTER (l_returnflag = 'A' AND l_quantity > 10) = 0 AS valid FROM lineitem GROUP BY l_orderkey
""")
def one_amount_rows(t: Tables) -> DataFrame:
    """P8."""
    flag = F.col("l_returnflag")
    return e.one_amount_rows(t.lineitem, ["l_orderkey"], flag == "R", F.col("l_quantity") > 10, flag == "A")


@query("""
WITH k AS (SELECT *, row_number() OVER w AS at_, max(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id) AS u FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN at_ END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(floor(value / 20) AS BIGINT) ORDER BY ts, event_id) AS again FROM h WHERE event_type = 'purchase')
SELECT event_id, CASE WHEN at_ - heading <= 2 THEN 'future_billing_total' WHEN again > 1 THEN 'overlay_total' ELSE '' END AS excluded FROM t
""")
def countable_totals(t: Tables) -> DataFrame:
    """Purchases just after a signup, or repeats of a like one, don't count."""
    kind = F.col("event_type")
    marked = t.events.withColumn("band", F.floor(F.col("value") / 20))
    found = e.countable_totals(marked, ["user_id"], ["ts", "event_id"], kind == "purchase", kind == "signup", 2, ["band"])
    return found.select("event_id", F.coalesce("excluded", F.lit("")).alias("excluded"))


@query("""
WITH m AS (
  SELECT l_partkey AS doc, l_linenumber AS page, l_returnflag AS shape, l_discount * 5 AS top, 1 - l_tax * 5 AS bottom, count(*) OVER (PARTITION BY l_partkey, l_linenumber) AS n
  FROM (SELECT l_partkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_discount) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY ALL)),
g AS (SELECT *, lag(page) OVER w AS p, lag(shape) OVER w AS s, lag(bottom) OVER w AS b FROM m WINDOW w AS (PARTITION BY doc ORDER BY page))
SELECT doc, CAST(page AS BIGINT) AS page, coalesce(page = p + 1 AND shape = s AND b >= 0.75 AND top <= 0.25, false) AS continues FROM g
""")
def page_continuations(t: Tables) -> DataFrame:
    """A part's lines as tables on consecutive pages."""
    tables = t.lineitem.groupBy(F.col("l_partkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.min("l_returnflag").alias("shape"), F.min("l_discount").alias("d"), F.min("l_tax").alias("x"))
    proven = e.page_continuations(tables, "doc", "page", F.col("shape"), F.col("d") * 5, 1 - F.col("x") * 5)
    return proven.select("doc", F.col("page").cast("long").alias("page"), "continues")


@query("""
WITH f AS (SELECT o_custkey AS c, list_sort(list(DISTINCT CAST(year(o_orderdate) AS INTEGER))) AS years FROM orders WHERE o_orderkey % 3 > 0 GROUP BY o_custkey),
s AS (SELECT o_custkey AS c, CAST(year(o_orderdate) AS INTEGER) % 100 AS suffix, list(DISTINCT month(o_orderdate)) AS months FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL),
n AS (SELECT c, count(*) AS n FROM s GROUP BY c),
k AS (
  SELECT s.c, s.suffix, s.months, n.n, coalesce(f.years, []) AS years,
         list_distinct(list_concat(list_filter(coalesce(f.years, []), lambda y: y % 100 = s.suffix),
                                   list_filter(list_transform(coalesce(f.years, []), lambda y: y + 1), lambda y: y % 100 = s.suffix AND list_contains(f.years, y + 1)))) AS found
  FROM s JOIN n USING (c) LEFT JOIN f USING (c)),
o AS (SELECT k.*, p.suffix AS osuffix, p.months AS omonths FROM k LEFT JOIN s p ON p.c = k.c AND p.suffix <> k.suffix AND k.n = 2),
r AS (
  SELECT c, suffix, CASE WHEN len(found) > 0 THEN found ELSE list_distinct(list_filter(list_transform(years, lambda a: CASE
    WHEN n = 2 AND a % 100 = osuffix AND suffix = (a + 99) % 100 AND list_min(months) >= 10 AND list_max(omonths) <= 3 THEN a - 1
    WHEN n = 2 AND a % 100 = osuffix AND suffix = (a + 1) % 100 AND list_min(omonths) >= 10 AND list_max(months) <= 3 THEN a + 1 END), lambda y: y IS NOT NULL)) END AS years
  FROM o)
SELECT c AS customer, CASE WHEN bool_and(len(years) = 1) THEN string_agg(suffix || ':' || years[1], ',' ORDER BY suffix) ELSE '' END AS resolved FROM r GROUP BY c
""")
def resolved_years(t: Tables) -> DataFrame:
    """a third of a customer's dates are short, the others prove years."""
    short = F.col("o_orderkey") % 3 == 0
    year = F.year("o_orderdate")
    full = t.orders.filter(~short).groupBy("o_custkey").agg(F.array_sort(F.collect_set(year)).alias("years"))
    shorts = t.orders.filter(short).groupBy("o_custkey", (year % 100).alias("suffix")).agg(F.collect_set(F.month("o_orderdate")).alias("months"))
    grouped = shorts.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("suffix", "months"))).alias("shorts")).join(full, "o_custkey", "left")
    years = F.coalesce("years", F.array().cast("array<int>"))
    known = grouped.withColumn("years", years).withColumn("m", e.resolved_years(F.col("shorts"), F.col("years")))
    pairs = F.transform(F.array_sort(F.map_entries("m")), lambda p: F.concat(p["key"].cast("string"), F.lit(":"), p["value"].cast("string")))
    return known.select(F.col("o_custkey").alias("customer"), F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("resolved"))


@query("""
SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN max(o_orderpriority) END AS o_orderpriority, count(DISTINCT o_orderpriority) > 1 AS conflict FROM orders GROUP BY o_custkey
""")
def merged_values(t: Tables) -> DataFrame:
    """A33."""
    return e.merged_values(t.orders, ["o_custkey"], "o_orderpriority")


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 > 0 OR doc_id % 3 > 0 THEN n_chars ELSE n_chars + 1 END AS reading, NOT (doc_id % 4 > 0 OR doc_id % 3 > 0) AS repaired FROM documents
""")
def repaired_readings(t: Tables) -> DataFrame:
    """A second reading replaces a first one only if it alone is exact."""
    id_ = F.col("doc_id")
    first = t.documents.select("doc_id", F.col("n_chars").alias("reading"), (id_ % 4 > 0).alias("exact"))
    second = t.documents.select("doc_id", (F.col("n_chars") + 1).alias("reading"), (id_ % 3 == 0).alias("exact"))
    return e.repaired(first, second, ["doc_id"], "exact").select("doc_id", "reading", "repaired")


@query("""
SELECT conv_id, turn, role AS tier0, concat_ws(' ', lag(role) OVER w, role, lead(role) OVER w) AS tier1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def context_tiers(t: Tables) -> DataFrame:
    """A row alone, and with its neighbours."""
    return e.context_tiers(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role", 1).select("conv_id", "turn", "tier0", "tier1")


@query("""
WITH s AS (SELECT doc_id, tier, (doc_id * 7 + tier * 3) % 5 < 2 + tier AS exact FROM labels, (SELECT unnest(range(3)) AS tier)),
m AS (SELECT *, lag(exact) OVER (PARTITION BY doc_id ORDER BY tier) AS before FROM s)
SELECT tier, count(*) AS rows, count(*) FILTER (exact) AS exact, count(*) FILTER (NOT before AND exact) AS gains, count(*) FILTER (before AND NOT exact) AS losses FROM m GROUP BY tier
""")
def tier_gains(t: Tables) -> DataFrame:
    """A27."""
    tiers = t.labels.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("tier"))
    scored = tiers.withColumn("exact", (F.col("doc_id") * 7 + F.col("tier") * 3) % 5 < 2 + F.col("tier"))
    return e.tier_gains(scored, ["doc_id"], "tier", "exact")


@query("""
WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PRIMARY' WHEN 1 THEN 'CONTINUATION' WHEN 2 THEN 'STRUCTURAL' ELSE 'AMBIGUOUS' END AS row_type, doc_id % 8 = 3 AS ambiguous FROM labels),
f AS (SELECT doc_id, 'billed_amount' AS role FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'billing_currency' FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'kind' FROM labels WHERE doc_id % 3 > 0
      UNION ALL SELECT doc_id, 'original_amount' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'kind' FROM labels WHERE doc_id % 9 = 1),
r AS (SELECT doc_id, list(DISTINCT role) AS roles, count(*) AS n, count(DISTINCT role) AS d FROM f GROUP BY doc_id)
SELECT l.doc_id, concat_ws('|', CASE WHEN ambiguous <> (row_type = 'AMBIGUOUS') THEN 'ambiguous_flag' END, CASE WHEN row_type = 'AMBIGUOUS' AND coalesce(n, 0) > 0 THEN 'ambiguous_fields' END,
  CASE WHEN row_type = 'STRUCTURAL' AND coalesce(n, 0) > 0 THEN 'structural_fields' END,
  CASE WHEN row_type = 'PRIMARY' AND NOT coalesce(list_has_all(roles, ['billed_amount', 'billing_currency', 'kind']), false) THEN 'missing_fields' END,
  CASE WHEN row_type = 'CONTINUATION' AND coalesce(n, 0) = 0 THEN 'empty_continuation' END, CASE WHEN n > d THEN 'repeated_role' END,
  CASE WHEN list_contains(roles, 'original_amount') <> list_contains(roles, 'original_currency') THEN 'unpaired_original' END) AS violations
FROM l LEFT JOIN r ON r.doc_id = l.doc_id
""")
def annotation_violations(t: Tables) -> DataFrame:
    """K25."""
    id_ = F.col("doc_id")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("PRIMARY", "CONTINUATION", "STRUCTURAL", "AMBIGUOUS"))), (id_ % 4 + 1).cast("int"))
    labels = t.labels.select("doc_id", kind.alias("row_type"), (id_ % 8 == 3).alias("ambiguous"))
    good = F.col("quality") == 1
    found = F.array_compact(
        F.array(F.when(good, "billed_amount"), F.when(good, "billing_currency"), F.when(id_ % 3 > 0, "kind"), F.when(F.col("toxic") == 1, "original_amount"), F.when(id_ % 9 == 1, "kind"))
    )
    return e.annotation_violations(labels, t.labels.select("doc_id", F.explode(found).alias("role")), ["doc_id"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 3 WHEN 0 THEN 'percentage=' || CAST(CAST(l_tax * 100 AS BIGINT) AS VARCHAR) WHEN 1 THEN 'decimal=' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
    ELSE 'percentage=' || CAST(CAST(l_discount * 100 AS BIGINT) AS VARCHAR) || ',decimal=' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS found
FROM lineitem
""")
def number_candidates(t: Tables) -> DataFrame:
    """F31."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    whole = lambda c: (F.col(c) * 100).cast("decimal(18,0)").cast("string")
    written = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("fee "), whole("l_tax"), F.lit(" % of 100"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("rate "), price)).otherwise(
        F.concat(whole("l_discount"), F.lit("% or "), price, F.lit(" in 2024"))
    )
    found = F.transform(e.number_candidates(written), lambda c: F.concat_ws("=", c["kind"], c["digits"]))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(found, ",").alias("found"))


@query()
def structure_profiles(t: Tables) -> DataFrame:
    """Documents of equal box structure, by content-free fingerprints."""
    boxes = _boxes(t).withColumns({"w": F.lit(120.0), "h": F.lit(30.0)})
    profiles = e.profile(boxes, "page", "w", "h")
    return profiles.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_documents"), F.min("page").alias("first"))


@query()
def clustered_columns(t: Tables) -> DataFrame:
    """Columns of an order's boxes, one cell of a line in each; a sequence, tested against its rules."""
    cells = _boxes(t).select("page", "line", "box", F.col("word").alias("text"))
    made = e.clustered_columns(cells, ["page"], "line")
    return made.groupBy("page").agg((F.max("column") + 1).alias("n_columns"), F.count(F.lit(1)).alias("n_cells"))


@query("""
SELECT l_orderkey AS page, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
       sha256(concat_ws(',', l_orderkey, 1, CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_discount * 100 * 100) AS BIGINT), CAST(round((l_quantity + 5 + l_linenumber) * 100) AS BIGINT),
                              CAST(round((l_discount * 100 + 4 + l_tax * 100) * 100) AS BIGINT))) AS row_id
FROM lineitem
""")
def fixed_row_ids(t: Tables) -> DataFrame:
    """F86."""
    return _boxes(t).select("page", "line", "part", "supp", e.fixed_row_id(F.col("page"), F.lit(1), F.col("box")).alias("row_id"))


@query("""
WITH w AS (SELECT doc_id, doc_id % 40 AS page, CASE doc_id % 5 WHEN 0 THEN '₪' WHEN 1 THEN '$.' WHEN 2 THEN 'x$' ELSE 'word' END AS text FROM documents),
s AS (SELECT page, CASE WHEN text = '₪' THEN '₪' ELSE '$' END AS symbol FROM w WHERE text IN ('₪', '$.'))
SELECT page, max(symbol) AS symbol FROM s GROUP BY page HAVING count(DISTINCT symbol) = 1
""")
def currency_symbols(t: Tables) -> DataFrame:
    """SRC6."""
    id_ = F.col("doc_id")
    shown = F.when(id_ % 5 == 0, "₪").when(id_ % 5 == 1, "$.").when(id_ % 5 == 2, "x$").otherwise("word")
    zero = F.lit(0.0)
    words = t.documents.select((id_ % 40).alias("page"), shown.alias("text"), F.lit(0.5).alias("confidence"), g.box(zero, zero, id_, zero).alias("box"))
    return e.currency_symbol(words, ["page"]).select("page", "symbol")
