"""Metadata grammars on generated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as m
from .base import Tables, query


def _form(id_: str, *texts) -> Column:
    """One of the texts by the id."""
    return F.element_at(F.array(*texts), (F.pmod(F.col(id_), F.lit(len(texts))) + 1).cast("int"))


@query("""
WITH f AS (SELECT o_orderkey, o_orderkey % 6 AS form, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN form IN (0, 1, 2, 3) THEN strftime(CASE WHEN form = 2 THEN make_date(2000 + year(d) % 100, month(d), day(d)) ELSE d END, '%Y-%m-%d') END AS canonical FROM f
""")
def statement_dates(t: Tables) -> DataFrame:
    """F48."""
    d = F.col("o_orderdate")
    written = _form("o_orderkey", F.date_format(d, "yyyy / M / d"), F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "d M yy"), F.date_format(d, " yyyy-MM-dd "), F.date_format(d, "'31/02/'yyyy"), F.date_format(d, "MM/yyyy"))
    return t.orders.select("o_orderkey", m.statement_date(written).cast("string").alias("canonical"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 > 0 AND l_shipdate >= o_orderdate AND year(l_shipdate) - year(o_orderdate) <= 1 THEN CAST(year(o_orderdate) AS BIGINT) END AS anchor
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def pdf_year_anchor(t: Tables) -> DataFrame:
    """orders and shipments as creation and modification dates; some cannot be read."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    created = F.when(F.col("l_linenumber") % 4 > 0, F.date_format("o_orderdate", "'D:'yyyyMMddHHmmss")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    anchor = m.pdf_year_anchor(created, F.date_format("l_shipdate", "'D:'yyyyMMdd'Z'"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", anchor.cast("long").alias("anchor"))


@query("""
WITH f AS (SELECT c_custkey, c_custkey % 5 AS form, printf('%08d', 10000000 + c_custkey) AS digits FROM customer)
SELECT c_custkey, CASE form WHEN 0 THEN digits WHEN 1 THEN substr(digits, 1, 4) WHEN 2 THEN digits END AS card FROM f
""")
def card_values(t: Tables) -> DataFrame:
    """F85."""
    digits = F.format_string("%08d", F.col("c_custkey") + 10000000)
    spaced = F.concat(F.substring(digits, 1, 4), F.lit(" "), F.substring(digits, 5, 4))
    text = _form("c_custkey", F.concat(F.lit("Card number: "), digits), F.concat(F.lit("for card ending with "), spaced), F.concat(F.lit("CARD NO "), spaced), F.concat(F.lit("card no 12")), F.concat(F.lit("number "), digits))
    return t.customer.select("c_custkey", m.card_value(text).alias("card"))


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'max' WHEN 2 THEN 'amex' WHEN 3 THEN 'cal' WHEN 5 THEN 'max|amex' ELSE '' END AS issuers FROM customer
""")
def issuer_names(t: Tables) -> DataFrame:
    """F85."""
    text = _form("c_custkey", *(F.lit(x) for x in ("MAX", "max purchase", "an American Express card", "www.cal-online.co.il", "calendar", "max.co.il and amex")))
    return t.customer.select("c_custkey", F.array_join(m.issuers(text), "|").alias("issuers"))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 3 THEN true ELSE false END AS safe, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 2 THEN 'בע״מ' ELSE source || ' shop' END AS merchant FROM documents
""")
def paths_and_merchants(t: Tables) -> DataFrame:
    """F6, F10, F11."""
    path = _form("doc_id", F.concat("source", F.lit("/a.pdf")), F.lit("/abs.pdf"), F.lit("a/../b.pdf"), F.lit("./a..b/c.pdf"), F.lit(""), F.lit("./"))
    description = _form("doc_id", F.concat("source", F.lit("  shop ")), F.concat(F.lit("\u200e"), "source", F.lit(" shop")), F.lit('בע " מ'), F.lit(" \u200f "))
    return t.documents.select("doc_id", m.is_safe_path(path).alias("safe"), m.merchant(description).alias("merchant"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, string_agg(DISTINCT CAST(l_linenumber % 2 + 1 AS VARCHAR), ';' ORDER BY CAST(l_linenumber % 2 + 1 AS VARCHAR)) AS pages,
       string_agg((l_linenumber % 2 + 1) || ':' || CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber // 2 AS VARCHAR) ELSE CAST(l_linenumber / 2.0 AS VARCHAR) END || ',0,' || (l_linenumber + 10) || ',0.25', ';' ORDER BY l_linenumber % 2, l_linenumber) AS boxes
FROM l GROUP BY l_orderkey
""")
def provenance_strings(t: Tables) -> DataFrame:
    """SNK5."""
    n = F.col("l_linenumber")
    box = F.struct((n / 2.0).alias("x0"), F.lit(0.0).alias("y0"), (n + 10).cast("double").alias("x1"), F.lit(0.25).alias("y1"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((n % 2 + 1).alias("page"), "l_linenumber", box.alias("box")))).alias("refs"))
    made = grouped.withColumn("p", m.provenance(F.col("refs")))
    return made.select("l_orderkey", F.col("p.pages").alias("pages"), F.col("p.boxes").alias("boxes"))


@query("""
WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PRIMARY' WHEN 1 THEN 'CONTINUATION' WHEN 2 THEN 'STRUCTURAL' ELSE 'AMBIGUOUS' END AS k, doc_id % 3 > 0 AS previous, doc_id % 5 AS c, doc_id % 7 > 0 AS resolved FROM labels)
SELECT doc_id, CASE WHEN k = 'STRUCTURAL' THEN 'IGNORE' WHEN k = 'AMBIGUOUS' OR (k = 'CONTINUATION' AND NOT previous) OR c = 3 OR c = 4 OR NOT resolved THEN 'ABSTAIN' ELSE 'ACCEPT' END AS decision,
  CASE WHEN k = 'STRUCTURAL' THEN 'page_baseline_structural_row' WHEN k = 'AMBIGUOUS' THEN 'page_baseline_ambiguous_row' WHEN k = 'CONTINUATION' AND NOT previous THEN 'page_baseline_continuation_without_previous_row'
    WHEN c = 3 THEN 'page_baseline_duplicate_role' WHEN c = 4 THEN 'page_baseline_no_supported_field' WHEN NOT resolved THEN 'page_baseline_unresolved_proposal' ELSE 'page_baseline_supported_fields' END AS reason
FROM r
""")
def page_baseline(t: Tables) -> DataFrame:
    """K26."""
    id_ = F.col("doc_id")
    kind = _form("doc_id", *(F.lit(x) for x in ("PRIMARY", "CONTINUATION", "STRUCTURAL", "AMBIGUOUS")))
    of = lambda *roles: F.array(*(F.lit(r).cast("string") for r in roles))
    roles = _form("doc_id", of("DATE", "AMOUNT"), of("AMOUNT", None), of("DATE"), of("DATE", "DATE"), of(None))
    decided = t.labels.select("doc_id", m.page_baseline(kind, id_ % 3 > 0, roles, id_ % 7 > 0).alias("p"))
    return decided.select("doc_id", F.col("p.decision").alias("decision"), F.col("p.reason").alias("reason"))
