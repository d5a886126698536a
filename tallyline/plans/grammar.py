"""Grammars on columns: amounts, dates, installments, phrases, text quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..operators import edits
from .base import Tables, query, spread

CENTS = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)"


def _amount_forms(t: Tables) -> DataFrame:
    """One written form of the line's amount by ``form`` = (l_orderkey + l_linenumber) % 12, with a currency hint for some."""
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(12)).alias("form"), F.expr(f"{CENTS} AS cents")
    )
    whole, rest = F.floor(F.col("cents") / 100).cast("long"), F.lpad(F.pmod("cents", F.lit(100)).cast("string"), 2, "0")
    grouped = lambda mark: F.regexp_replace(whole.cast("string"), r"(?<=\d)(?=(\d{3})+$)", mark)
    forms = [
        F.concat(F.lit("₪"), grouped(","), F.lit("."), rest),
        F.concat(grouped("."), F.lit(","), rest, F.lit(" EUR")),
        F.concat(F.lit("("), whole.cast("string"), F.lit("."), rest, F.lit(") $")),
        F.concat(whole.cast("string"), F.lit("."), rest, F.lit("-")),
        F.concat(F.lit("refund "), whole.cast("string"), F.lit("."), rest, F.lit(" USD")),
        F.concat(F.lit("1,"), F.lpad(F.pmod("cents", F.lit(1000)).cast("string"), 3, "0"), F.lit(" GBP")),
        F.concat(grouped(" "), F.lit("."), rest, F.lit(" CHF")),
        F.concat(F.lit("$"), whole.cast("string"), F.lit(" EUR")),
        F.concat(F.lit("charge -"), whole.cast("string"), F.lit(" USD")),
        F.concat(whole.cast("string"), F.lit("."), rest),
        F.concat(F.lit("+"), whole.cast("string"), F.lit(" NIS")),
        F.concat(whole.cast("string"), F.lit(" apples JPY")),
    ]
    hint = F.when(F.col("form") == 3, "GBP").when(F.col("form") == 6, "USD")
    return spread(df).withColumn("written", F.element_at(F.array(*forms), (F.col("form") + 1).cast("int"))).withColumn("hint", hint)


@query(f"""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey + l_linenumber) % 12 AS form, {CENTS} AS cents FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE form WHEN 0 THEN cents / 100.0 WHEN 1 THEN cents / 100.0 WHEN 2 THEN -cents / 100.0 WHEN 3 THEN -cents / 100.0 WHEN 4 THEN -cents / 100.0
            WHEN 10 THEN CAST(cents // 100 AS DOUBLE) END AS amount,
  CASE form WHEN 0 THEN 'ILS' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'GBP' WHEN 4 THEN 'USD' WHEN 5 THEN 'GBP' WHEN 6 THEN 'CHF' WHEN 8 THEN 'USD'
            WHEN 10 THEN 'ILS' WHEN 11 THEN 'JPY' END AS currency,
  CASE form WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.95 WHEN 4 THEN 1.0 WHEN 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
  CASE form WHEN 5 THEN 'ambiguous_decimal_separator' WHEN 6 THEN 'currency_hint_conflict' WHEN 7 THEN 'conflicting_currency'
            WHEN 8 THEN 'conflicting_sign_marker' WHEN 9 THEN 'unknown_currency' WHEN 11 THEN 'invalid_amount_text' ELSE '' END AS diagnostics
FROM f
""")
def parse_amount_forms(t: Tables) -> DataFrame:
    """F20-F24 on twelve ways to write an amount."""
    p = F.col("p")
    parsed = _amount_forms(t).withColumn("p", money.parse_amount(F.col("written"), F.col("hint")))
    return parsed.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p["amount"].cast("double").alias("amount"), p["currency"].alias("currency"),
        p["confidence"].alias("confidence"), F.concat_ws("|", p["diagnostics"]).alias("diagnostics"),
    )


@query("""
WITH f AS (SELECT l_returnflag, (l_orderkey + l_linenumber) % 12 AS form FROM lineitem),
s AS (SELECT l_returnflag, CASE WHEN form IN (0, 1, 2, 3, 4, 6, 9, 10) THEN 'money' ELSE 'other' END AS shape FROM f),
n AS (SELECT l_returnflag, shape, count(*) AS n FROM s GROUP BY ALL)
SELECT l_returnflag, max_by(shape, n) AS profile, max(n) AS n, CAST(sum(n) AS BIGINT) AS total, max(n) * 2 >= sum(n) AS stable,
       round(0.92 * coalesce(sum(n) FILTER (shape = 'money'), 0) / sum(n), 9) AS score
FROM n GROUP BY l_returnflag
""")
def money_shaped_profile(t: Tables) -> DataFrame:
    """The majority shape of a column's values and its profile score.

    Shape is judged without a hint, so the twelve forms are read again without one.
    """
    shape = F.when(money.money_shaped(F.col("written")), "money").otherwise("other")
    flagged = _amount_forms(t).select("l_returnflag", shape.alias("shape"))
    counted = flagged.groupBy("l_returnflag", "shape").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return counted.groupBy("l_returnflag").agg(
        F.max_by("shape", "n").alias("profile"),
        F.max("n").alias("n"),
        total.alias("total"),
        (F.max("n") * 2 >= total).alias("stable"),
        F.round(F.lit(0.92) * F.coalesce(F.sum(F.when(F.col("shape") == "money", F.col("n"))), F.lit(0)) / total, 9).alias("score"),
    )


CODES = ("₪", "nis", "Usd", "$", "eu", "€", "GB", "£", "שח", 'ש"ח', "ש ח", "jpy", "XYZ", "", "US D")


@query("""
WITH codes(i, code, canonical) AS (VALUES
  (0, '₪', 'ILS'), (1, 'nis', 'ILS'), (2, 'Usd', 'USD'), (3, '$', 'USD'), (4, 'eu', 'EUR'), (5, '€', 'EUR'), (6, 'GB', 'GBP'), (7, '£', 'GBP'),
  (8, 'שח', 'ILS'), (9, 'ש"ח', 'ILS'), (10, 'ש ח', 'ILS'), (11, 'jpy', 'JPY'), (12, 'XYZ', NULL), (13, '', NULL), (14, 'US D', NULL))
SELECT p_partkey, code, canonical, canonical IS NOT NULL AS shaped FROM part JOIN codes ON i = p_partkey % 15
""")
def canonical_currency_codes(t: Tables) -> DataFrame:
    """F23."""
    code = F.element_at(F.array(*(F.lit(c) for c in CODES)), (F.pmod("p_partkey", F.lit(len(CODES))) + 1).cast("int"))
    coded = t.part.select("p_partkey", code.alias("code"))
    return coded.select("p_partkey", "code", money.canonical_currency(F.col("code")).alias("canonical"), money.is_currency_shaped(F.col("code")).alias("shaped"))


@query("""
WITH f AS (SELECT o_orderkey, o_orderkey % 10 AS form, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN form < 6 THEN strftime(d, '%Y-%m-%d') END AS parsed,
       CASE form WHEN 6 THEN 'invalid_date' WHEN 7 THEN 'ambiguous_date_or_installment' WHEN 8 THEN 'ambiguous_date_tokens' WHEN 9 THEN 'invalid_date' END AS diagnostic
FROM f
""")
def parse_date_styles(t: Tables) -> DataFrame:
    """Six styles, an impossible day, a fraction, two dates and a two-digit year without context."""
    d = F.col("o_orderdate")
    patterns = ("dd/MM/yyyy", "d.M.yyyy", "dd-MM-yyyy", "yyyy/M/d", "yyyy.MM.dd", "yyyy-MM-dd")
    forms = [F.date_format(d, p) for p in patterns]
    forms += [F.date_format(d, "'31/02/'yyyy"), F.date_format(d, "d/M"), F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" "), F.date_format(d, "dd/MM/yyyy")), F.date_format(d, "dd/MM/yy")]
    written = t.orders.select("o_orderkey", F.element_at(F.array(*forms), (F.pmod("o_orderkey", F.lit(10)) + 1).cast("int")).alias("written"))
    parsed = written.withColumn("p", dates.parse_date(F.col("written")))
    return parsed.select("o_orderkey", F.col("p.date").cast("string").alias("parsed"), F.col("p.diagnostic").alias("diagnostic"))


@query("""
WITH y AS (SELECT o_custkey, list(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY o_custkey)
SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 5 <> 0 THEN strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') END AS parsed,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'date_year_context_mismatch' END AS diagnostic
FROM orders o
""")
def year_context(t: Tables) -> DataFrame:
    """two-digit years read by the years that full dates of the same customer prove.

    Every fifth token has a suffix that no full date proves.
    """
    proven = t.orders.groupBy("o_custkey").agg(F.collect_set(F.year("o_orderdate")).alias("years"))
    by_suffix = F.map_from_entries(F.transform(F.array_distinct("years"), lambda y: F.struct((y % 100).alias("suffix"), y.alias("year"))))
    suffix = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.lit("50")).otherwise(F.date_format("o_orderdate", "yy"))
    short = F.concat(F.date_format("o_orderdate", "dd/MM/"), suffix)
    joined = t.orders.join(proven, "o_custkey").withColumn("p", dates.parse_short_date(short, "day_first_slash", by_suffix))
    return joined.select("o_orderkey", F.col("p.date").cast("string").alias("parsed"), F.col("p.diagnostic").alias("diagnostic"))


@query("""
WITH j AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS s, CAST(o_orderdate AS DATE) AS a
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
c AS (
  SELECT *, list_distinct(list_filter([
    try_strptime((y - 1) || strftime(s, '-%m-%d'), '%Y-%m-%d'), try_strptime(y || strftime(s, '-%m-%d'), '%Y-%m-%d'), try_strptime((y + 1) || strftime(s, '-%m-%d'), '%Y-%m-%d'),
    try_strptime((y - 1) || '-' || strftime(s, '%m-%y'), '%Y-%m-%d'), try_strptime(y || '-' || strftime(s, '%m-%y'), '%Y-%m-%d'), try_strptime((y + 1) || '-' || strftime(s, '%m-%y'), '%Y-%m-%d')],
    lambda d: d IS NOT NULL AND abs(date_diff('day', a, CAST(d AS DATE))) <= 31
      AND (strftime(d, '%d-%y') = strftime(s, '%d-%y') OR strftime(d, '%y-%d') = strftime(s, '%d-%y')))) AS found
  FROM (SELECT *, year(a) AS y FROM j))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN len(found) = 1 THEN strftime(found[1], '%Y-%m-%d') END AS near FROM c
""")
def near_anchor_date(t: Tables) -> DataFrame:
    """a ship date with a two-digit year, read next to its order's date."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    near = dates.near_anchor(F.date_format("l_shipdate", "dd/MM/yy"), F.to_date("o_orderdate"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", near.cast("string").alias("near"))


@query("""
SELECT o_orderkey, bool_and(o_orderdate <= l_shipdate) AND bool_or(o_orderdate < l_shipdate) AS ordered, count(*) AS n_pairs
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def date_order_proof(t: Tables) -> DataFrame:
    """Two date columns are typed by their order if no pair is reversed and some pair differs."""
    joined = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    ordered = F.bool_and(F.col("o_orderdate") <= F.col("l_shipdate")) & F.bool_or(F.col("o_orderdate") < F.col("l_shipdate"))
    return joined.groupBy("o_orderkey").agg(ordered.alias("ordered"), F.count(F.lit(1)).alias("n_pairs"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <= l_suppkey % 7 THEN CAST(l_linenumber AS BIGINT) END AS current_part,
       CASE WHEN l_linenumber <= l_suppkey % 7 THEN CAST(l_suppkey % 7 AS BIGINT) END AS total_parts
FROM lineitem
""")
def installment_parse(t: Tables) -> DataFrame:
    """``n / m`` with n up to m."""
    written = F.concat(F.col("l_linenumber").cast("string"), F.lit(" / "), F.pmod("l_suppkey", F.lit(7)).cast("string"))
    read = t.lineitem.withColumn("p", dates.installment(written))
    return read.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p.current").cast("long").alias("current_part"), F.col("p.total").cast("long").alias("total_parts"))


@query(r"""
SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS digest FROM documents
""")
def normalize_text(t: Tables) -> DataFrame:
    """F1, with composition."""
    return t.documents.select("doc_id", F.sha2(text.normalize_text(F.col("text")).cast("binary"), 256).alias("digest"))


@query(r"""
SELECT conv_id, turn, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g'))) AS digest FROM conversations
""")
def phrase_tokens(t: Tables) -> DataFrame:
    """F2."""
    return t.conversations.select("conv_id", "turn", F.sha2(F.array_join(text.phrase_tokens(F.col("text")), " ").cast("binary"), 256).alias("digest"))


@query(r"""
WITH w AS (SELECT doc_id, ' ' || trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS p FROM documents)
SELECT doc_id, contains(p, ' of the ') OR contains(p, ' to ') AS has_of_the, contains(p, ' de la ') AS has_de_la FROM w
""")
def phrase_match(t: Tables) -> DataFrame:
    """F3."""
    tokens = F.col("tokens")
    return t.documents.select("doc_id", text.phrase_tokens(F.col("text")).alias("tokens")).select(
        "doc_id", text.has_phrase(tokens, ("of the", "to")).alias("has_of_the"), text.has_phrase(tokens, ("de la",)).alias("has_de_la")
    )


KINDS = ("monthly fee", "Refund for order", "INTEREST charged", "price adjustment", "purchase at shop", "nothing known", "credit and fee", "commissioned work")


@query("""
WITH c(i, description, category) AS (VALUES
  (0, 'monthly fee', 'FEE'), (1, 'Refund for order', 'REFUND'), (2, 'INTEREST charged', 'INTEREST'), (3, 'price adjustment', 'ADJUSTMENT'),
  (4, 'purchase at shop', 'PURCHASE'), (5, 'nothing known', 'UNKNOWN'), (6, 'credit and fee', 'REFUND'), (7, 'commissioned work', 'UNKNOWN')),
k AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'INSTALLMENT' ELSE category END AS category, CASE WHEN value < 50 THEN 'CREDIT' ELSE 'CHARGE' END AS kind
      FROM events JOIN c ON i = event_id % 8)
SELECT event_id, category, kind,
       (category = 'REFUND' AND kind <> 'CREDIT') OR (category IN ('PURCHASE', 'FEE', 'INTEREST', 'INSTALLMENT') AND kind <> 'CHARGE') AS contradiction
FROM k
""")
def categorize(t: Tables) -> DataFrame:
    """F7."""
    description = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (F.pmod("event_id", F.lit(8)) + 1).cast("int"))
    kind = F.when(F.col("value") < 50, "CREDIT").otherwise("CHARGE")
    named = t.events.select("event_id", text.category(description, F.pmod("event_id", F.lit(11)) == 0).alias("category"), kind.alias("kind"))
    return named.withColumn("contradiction", text.sign_contradicts(F.col("category"), F.col("kind")))


@query(r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[a-m]', 'ש', 'g') ELSE text END AS x FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(x, '[\p{Hebrew}\p{Arabic}]')) AS rtl, len(regexp_extract_all(x, '[\p{Latin}\p{Greek}\p{Cyrillic}]')) AS ltr FROM d)
SELECT doc_id, CASE WHEN rtl > ltr THEN 'rtl' ELSE 'ltr' END AS direction FROM n
""")
def text_direction(t: Tables) -> DataFrame:
    """the direction of a whole text, Hebrew put into every third."""
    mixed = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.regexp_replace("text", "[a-m]", "ש")).otherwise(F.col("text"))
    return spread(t.documents.select("doc_id", "text")).select("doc_id", text.direction(mixed).alias("direction"))


@query(r"""
WITH m AS (
  SELECT doc_id, length(text) AS characters, length(regexp_replace(text, '[\s\x{FFFD}\p{C}]', '', 'g')) AS usable,
         len(regexp_extract_all(text, '[\p{Cc}\p{Cf}]')) / greatest(length(text), 1) AS control
  FROM documents)
SELECT doc_id, characters, usable, round(control, 9) AS control,
       concat_ws('|', CASE WHEN usable < 8 THEN 'nearly_empty_text' END, CASE WHEN control > 0.02 THEN 'excessive_control_characters' END) AS reasons
FROM m
""")
def text_quality(t: Tables) -> DataFrame:
    """A document as a page without images."""
    judged = t.documents.select("doc_id", text.quality(F.col("text"), F.lit(0.0), F.lit(1)).alias("q"))
    return judged.select(
        "doc_id", F.col("q.characters").cast("long").alias("characters"), F.col("q.usable").cast("long").alias("usable"),
        F.round("q.control", 9).alias("control"), F.concat_ws("|", "q.reasons").alias("reasons"),
    )


def _pairs(t: Tables) -> DataFrame:
    """Each document's whole text and that of a benchmark item."""
    n = t.benchmark.agg(F.count(F.lit(1)).alias("n"))
    items = t.benchmark.select("item_id", F.col("text").alias("reference"))
    docs = spread(t.documents.select("doc_id", "lang", F.col("text").alias("hypothesis"))).join(F.broadcast(n)).withColumn("item_id", F.pmod("doc_id", "n"))
    return docs.join(items, "item_id")


@query()
def char_error_rate(t: Tables) -> DataFrame:
    """Micro rate, sums of edits over sums of reference lengths (SQL's edit distance counts bytes; tested against a plain one)."""
    counted = edits.edit_counts(_pairs(t), "reference", "hypothesis", ["lang"])
    edited, units = F.sum("edits"), F.sum("units")
    return counted.groupBy("lang").agg(edited.alias("edits"), units.alias("units"), F.round(edited / units, 9).alias("cer"))


@query()
def word_error_rate(t: Tables) -> DataFrame:
    """A19, F9 on tokens (the edit distance of arrays has no SQL function; tested against a plain one)."""
    counted = edits.edit_counts(_pairs(t), "reference", "hypothesis", ["lang"], words=True)
    edited, words = F.sum("edits"), F.sum("units")
    return counted.groupBy("lang").agg(edited.alias("edits"), words.alias("words"), F.round(edited / words, 9).alias("wer"))


@query(r"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_discount AS DECIMAL(18,4)) * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) AS VARCHAR) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN regexp_replace(s, '\.?0+$', '') IN ('-0', '') THEN '0' ELSE regexp_replace(s, '\.?0+$', '') END AS plain
FROM v
""")
def plain_decimal(t: Tables) -> DataFrame:
    """SNK7."""
    value = F.col("l_discount").cast("decimal(18,4)") * F.when(F.col("l_linenumber") % 2 == 0, F.lit(-1)).otherwise(F.lit(1))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.plain_decimal(value.cast("decimal(18,4)")).alias("plain"))


FEE = """
f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS billed, l_extendedprice / (3 + l_linenumber * 0.01) AS original,
             3 + l_linenumber * 0.012 AS rate, l_extendedprice * l_tax AS gross, l_tax * 100 AS percent, l_extendedprice * l_discount AS discount FROM lineitem)"""


def _fees(t: Tables) -> DataFrame:
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("billed"), (price / (3 + line * 0.01)).alias("original"), (3 + line * 0.012).alias("rate"),
        (price * F.col("l_tax")).alias("gross"), (F.col("l_tax") * 100).alias("percent"), (price * F.col("l_discount")).alias("discount"),
    )


@query(f"""
WITH {FEE}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(rate * original - billed) <= 0.05 * abs(billed) AS rate_plausible,
       percent > 0 AND percent <= 100 AND discount >= 0 AND discount <= gross AND abs(100 * gross - abs(billed) * percent) <= greatest(1.0, 5.0 * gross) AS fee_plausible
FROM f
""")
def fx_plausibility(t: Tables) -> DataFrame:
    """F28."""
    c = F.col
    return _fees(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.fx_plausible(c("billed"), c("original"), c("rate")).alias("rate_plausible"),
        money.fee_plausible(c("gross"), c("billed"), c("percent"), c("discount")).alias("fee_plausible"),
    )


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * l_tax, 2) + (CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) AS fee,
                  round(l_extendedprice, 0) AS base, round(l_tax * 100, 0) AS percent FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       (base + 0.5) * (percent + 0.5) / 100 >= fee - 0.5 * pow(10.0, -2) AND (base - 0.5) * (percent - 0.5) / 100 <= fee + 0.5 * pow(10.0, -2) AS explained
FROM f
""")
def percentage_explains(t: Tables) -> DataFrame:
    """rounded figures explain each other within half of their last printed unit."""
    off = F.when(F.col("l_linenumber") % 3 == 0, F.lit(1)).otherwise(F.lit(0))
    fee = F.round(F.col("l_extendedprice") * F.col("l_tax"), 2) + off
    explained = money.percentage_explains(fee, F.lit(2), F.round("l_extendedprice", 0), F.lit(0), F.round(F.col("l_tax") * 100, 0), F.lit(0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", explained.alias("explained"))


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * l_tax AS gross, l_extendedprice * l_discount AS discount,
                  CASE WHEN l_linenumber % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN gross - discount >= 0 AND currency = 'USD' THEN gross - discount END AS net FROM f
""")
def net_fee(t: Tables) -> DataFrame:
    """F30."""
    currency: Column = F.when(F.col("l_linenumber") % 5 == 0, "EUR").otherwise("USD")
    net = money.net_fee(F.col("l_extendedprice") * F.col("l_tax"), F.col("l_extendedprice") * F.col("l_discount"), F.lit("USD"), currency)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", net.alias("net"))
