"""Truth tables of the scalar grammars."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyline.functions import dates, geometry, money, text

AMOUNTS = [
    ("₪1,234.56", None, "1234.56", "ILS", ()),
    ("1.234,56 EUR", None, "1234.56", "EUR", ()),
    ("(12.30) $", None, "-12.30", "USD", ()),
    ("($ 12.30)", None, "-12.30", "USD", ()),
    ("12.30- GBP", None, "-12.30", "GBP", ()),
    ("GBP 12.30-", None, "-12.30", "GBP", ()),
    ("refund 10 USD", None, "-10.00", "USD", ()),
    ("charge -10 USD", None, None, "USD", ("conflicting_sign_marker",)),
    ("credit +10 USD", None, None, "USD", ("conflicting_sign_marker",)),
    ("refund charge 10 USD", None, None, "USD", ("conflicting_sign_marker",)),
    ("1,234", "USD", None, "USD", ("ambiguous_decimal_separator",)),
    ("1,234,567", "USD", "1234567.00", "USD", ()),
    ("1 234 567.5", "USD", "1234567.50", "USD", ()),
    ("1'234.5", "USD", "1234.50", "USD", ()),
    ("12 34.5", "USD", None, "USD", ("invalid_grouping_separator",)),
    ("1.2345", "USD", None, "USD", ("invalid_decimal_separator",)),
    ("1,23.456", "USD", None, "USD", ("ambiguous_decimal_separator",)),
    ("12,34.56", "USD", None, "USD", ("invalid_grouping_separator",)),
    ("10", None, None, None, ("unknown_currency",)),
    ("10", "XYZ", None, None, ("unknown_currency_hint", "unknown_currency")),
    ("$10", "EUR", None, "USD", ("currency_hint_conflict",)),
    ("$10 EUR", None, None, None, ("conflicting_currency",)),
    ("abc", "USD", None, "USD", ("invalid_amount_text",)),
    ("", "USD", None, "USD", ("invalid_amount_text",)),
    ("10 ש\"ח", None, "10.00", "ILS", ()),
    ("{ 10", None, "10.00", "ILS", ()),
    ("זיכוי 5.5 ₪", None, "-5.50", "ILS", ()),
    ("בזיכוי 5.5 ₪", None, "-5.50", "ILS", ()),
    ("1-2", "USD", None, "USD", ("invalid_sign_syntax", "invalid_amount_text")),
]


def test_amounts(spark):
    rows = [(i, t, h) for i, (t, h, *_) in enumerate(AMOUNTS)]
    df = spark.createDataFrame(rows, "i int, t string, h string")
    got = {r.i: r.p for r in df.select("i", money.parse_amount(F.col("t"), F.col("h")).alias("p")).collect()}
    for i, (t, h, amount, currency, codes) in enumerate(AMOUNTS):
        p = got[i]
        want = None if amount is None else Decimal(amount)
        assert (p.amount, p.currency, tuple(p.diagnostics)) == (want, currency, codes), (t, h, p)
        assert p.confidence == (0.0 if codes else 0.95 if h and not any(c in t for c in "$€£₪") else 1.0)


DATES = [
    ("01/02/2026", "2026-02-01", None),
    ("2026-2-1", "2026-02-01", None),
    ("1 . 2 . 2026", "2026-02-01", None),
    ("31/02/2026", None, "invalid_date"),
    ("01/02-2026", None, "invalid_date"),
    ("3/12", None, "ambiguous_date_or_installment"),
    ("01/02/26", None, "invalid_date"),
    ("01/02/2026 03/02/2026", None, "ambiguous_date_tokens"),
    ("0​1/02/2026", None, "invalid_date"),
    ("‎01/02/2026", "2026-02-01", None),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(DATES)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", dates.parse_date(F.col("t")).alias("p")).collect()}
    for i, (t, day, code) in enumerate(DATES):
        want = None if day is None else datetime.date.fromisoformat(day)
        assert (got[i].date, got[i].diagnostic) == (want, code), t


def test_short_and_near_dates(spark):
    df = spark.sql("select map(25, 2025, 26, 2026) m, date'2026-01-10' a")
    row = df.select(
        dates.parse_short_date(F.lit("05/12/25"), "day_first_slash", F.col("m")).alias("p"),
        dates.parse_short_date(F.lit("05/12/27"), "day_first_slash", F.col("m")).alias("q"),
        dates.parse_short_date(F.lit("25-12-05"), "year_first_dash", F.col("m")).alias("r"),
        dates.near_anchor(F.lit("28/12/25"), F.col("a")).alias("s"),
        dates.near_anchor(F.lit("28/06/25"), F.col("a")).alias("t"),
        dates.installment(F.lit(" 3 / 12")).alias("u"),
        dates.installment(F.lit("13/12")).alias("v"),
    ).first()
    assert row.p.date == row.r.date == datetime.date(2025, 12, 5)
    assert row.q.diagnostic == "date_year_context_mismatch"
    assert row.s == datetime.date(2025, 12, 28) and row.t is None
    assert (row.u.current, row.u.total, row.v.current) == (3, 12, None)


def test_text(spark):
    row = spark.range(1).select(
        text.normalize_text(F.lit(" a​b‎   c­\t")).alias("n"),
        text.phrase_tokens(F.lit("Groß-Total: 3‍x, ok")).alias("p"),
        text.phrase_tokens(F.lit('ש"ח a"b'), drop_acronym_quotes=True).alias("q"),
        text.has_phrase(text.phrase_tokens(F.lit("the big total due")), ["big total"]).alias("h"),
        text.has_phrase(text.phrase_tokens(F.lit("the big totals")), ["big total"]).alias("h2"),
        text.has_phrase(text.phrase_tokens(F.lit("בזיכוי")), ["זיכוי"], clitic=True).alias("h3"),
        text.has_phrase(text.phrase_tokens(F.lit("בזיכוי")), ["זיכוי"]).alias("h4"),
        text.direction(F.lit("abc שלום עולם")).alias("d"),
        text.category(F.lit("Monthly fee and interest")).alias("c"),
        text.word_error_counts(F.lit("a b c d"), F.lit("a x c")).alias("w"),
        text.word_error_counts(F.lit(""), F.lit("a b")).alias("w2"),
        text.nfc(F.lit("é")).alias("nfc"),
    ).first()
    assert row.n == "a b c"
    assert row.p == ["gross", "total", "3x", "ok"] and row.q == ["שח", "ab"]
    assert (row.h, row.h2, row.h3, row.h4) == (True, False, True, False)
    assert row.d == "rtl" and row.c == "INTEREST"
    assert tuple(row.w) == (2, 4) and tuple(row.w2) == (2, 1) and row.nfc == "é"


@pytest.mark.parametrize("value, plain", [("10.50", "10.5"), ("-0.00", "0"), ("100.00", "100"), ("0.05", "0.05")])
def test_plain_decimal(spark, value, plain):
    assert spark.range(1).select(money.plain_decimal(F.lit(value).cast("decimal(38,2)"))).first()[0] == plain


def test_geometry(spark):
    a, b = (geometry.box(*(F.lit(float(v)) for v in box)) for box in ((0, 0, 10, 10), (5, 0, 15, 20)))
    row = spark.range(1).select(geometry.iou(a, b), geometry.ios(a, b), geometry.vertical_overlap(a, b), geometry.center_inside(a, b), geometry.is_valid(a)).first()
    assert row[0] == pytest.approx(50 / 250) and row[1] == 0.5 and row[2] == 1.0 and row[3] and row[4]
    flat = geometry.box(*(F.lit(0.0) for _ in range(4)))
    assert spark.range(1).select(geometry.iou(flat, flat)).first()[0] == 0.0


def test_fees(spark):
    d = lambda x: F.lit(float(x))
    row = spark.range(1).select(
        money.net_fee(d(5), d(2), F.lit("USD"), F.lit("USD")).alias("n"),
        money.net_fee(d(2), d(5), F.lit("USD"), F.lit("USD")).alias("m"),
        money.fx_plausible(d(370), d(100), d(3.7)).alias("f"),
        money.fee_plausible(d(3), d(100), d(3), d(1)).alias("g"),
        money.percentage_explains(d(2.97), F.lit(2), d(99), F.lit(0), d(3), F.lit(0)).alias("p"),
    ).first()
    assert row.n == 3 and row.m is None and row.f and row.g and row.p
