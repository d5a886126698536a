"""Fields of a transaction from its cells and the detail lines below it: the original amount, and foreign exchange.

A field is read from exactly one source; none or several leave it null with a
diagnostic, so no value is chosen among rivals. Everything is an aggregate per
row over per-cell or per-line projections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions.let import diagnostics, let
from .evidence import number_candidates

# fixed values: the words that name a detail line's values
RATE_CUES = ("conversion rate", "exchange rate", "representative rate", "שער המרה", "שער ההמרה", "שער יציג", "שער")
FEE_CUES = ("commission", "fee", "surcharge", "עמלה", "עמלת")
GROSS_CUES = ("gross fee", "fee amount", "commission amount", "charged fee", "עמלה בסך", "עמלת מט ח בסך")
DISCOUNT_CUES = ("discount", "הנחה", "מופחתת")
NET_MODIFIERS = ("net", "נטו")
NET_NOUNS = (*FEE_CUES, "amount", "סכום")


def original_amounts(rows: DataFrame, columns: DataFrame, cells: DataFrame, table: Sequence[str], row: Sequence[str]) -> DataFrame:
    """``rows`` (table, row, billed_amount) with ``original_amount``, ``original_currency`` and ``original_diagnostics``.

    ``columns`` (table, column, role) and ``cells`` (table, row, column, text).
    The one cell of the one original column is read, in the currency of the one
    cell of the original currency's column if there is one. A credit without
    that cell in a table without that column simply has no original.
    """
    keys, money_role, currency_role = [*table, *row], "ORIGINAL_AMOUNT", "ORIGINAL_CURRENCY"
    counts = columns.groupBy(*table).agg(F.count_if(F.col("role") == money_role).alias("__amounts"), F.count_if(F.col("role") == currency_role).alias("__currencies"))
    placed = cells.join(columns.filter(F.col("role").isin(money_role, currency_role)), [*table, "column"])
    of = lambda role: F.when(F.col("role") == role, F.col("text"))
    found = placed.groupBy(*keys).agg(
        F.count(of(money_role)).alias("__n"), F.max(of(money_role)).alias("__text"), F.count(of(currency_role)).alias("__m"), F.max(of(currency_role)).alias("__unit")
    )
    joined = rows.join(counts, list(table), "left").join(found, keys, "left").fillna(0, ["__amounts", "__currencies", "__n", "__m"])
    one_column, several = F.col("__amounts") == 1, F.col("__currencies") > 1
    one_unit = (F.col("__currencies") == 1) & (F.col("__m") == 1)
    unit = F.when(one_unit, money.canonical_currency(F.col("__unit")))
    excused = (F.col("__n") == 0) & (F.col("billed_amount") < 0) & (F.col("__currencies") == 0)
    read = joined.withColumn("__u", unit).withColumn("__p", F.when(one_column & (F.col("__n") == 1), money.parse_amount(F.col("__text"), F.col("__u"))))
    asked = one_column & (F.col("__n") == 1)
    raised = diagnostics(
        (F.col("__amounts") > 1, "multiple_original_amount_columns"),
        (one_column & (F.col("__n") == 0) & ~excused, "missing_original_amount_cell"),
        (one_column & (F.col("__n") > 1), "multiple_original_amount_cells"),
        (asked & several, "multiple_original_currency_columns"),
        (asked & (F.col("__currencies") == 1) & (F.col("__m") == 0), "missing_original_currency_cell"),
        (asked & (F.col("__currencies") == 1) & (F.col("__m") > 1), "multiple_original_currency_cells"),
        (asked & one_unit & F.col("__u").isNull(), "unknown_original_currency"),
    )
    own = F.transform(F.coalesce(F.col("__p.diagnostics"), F.array().cast("array<string>")), lambda d: F.concat(F.lit("original_amount:"), d))
    whole = F.col("__p.amount").isNotNull() & F.col("__p.currency").isNotNull()
    return read.select(
        *rows.columns,
        F.when(whole, F.col("__p.amount")).alias("original_amount"),
        F.when(whole, F.col("__p.currency")).alias("original_currency"),
        F.concat(raised, own).alias("original_diagnostics"),
    )


_NUMBER = r"[+-]?\d[\d,]*(?:\.\d+)?"
_UNIT = money.CURRENCY.removeprefix("(?i)")
MONEY = rf"(?i)(?:{_UNIT})\s*{_NUMBER}(?![\d.])|{_NUMBER}\s*(?:{_UNIT})"


def fx_line(line: Column, billing_currency: Column) -> Column:
    """What a detail line says: for rate, percentage, gross, discount and net, whether it names one (``has_``) and its only value;
    ``date``, the only whole date beside a rate. A rate beside another value belongs to neither."""

    def read(s: Column) -> Column:
        has = lambda cues: text.phrase_in(s["flat"], cues)
        rate, discount_cue = has(RATE_CUES), has(DISCOUNT_CUES)
        net = has(NET_MODIFIERS) & has(NET_NOUNS)
        percentage = has(FEE_CUES) & s["line"].contains("%")
        gross = has(GROSS_CUES) & ~net
        discount = discount_cue & ~net & ~gross
        mixed = rate & (percentage | has(GROSS_CUES) | discount_cue | net)
        numbers = lambda kind: F.filter(s["numbers"], lambda n: n["kind"] == kind)
        only = lambda found: F.when((F.size(found) == 1) & ~mixed, F.get(found, F.lit(0)))
        value = lambda found: F.replace(only(found)["digits"], F.lit(","), F.lit(".")).try_cast("decimal(20,6)")
        billed = F.filter(s["money"], lambda p: p["currency"] == s["unit"])
        amount = F.when(F.size(s["money"]) == 1, only(billed)["amount"])
        days = F.array_distinct(F.transform(F.regexp_extract_all(s["line"], F.lit(dates.WHOLE_DATE), F.lit(0)), lambda d: dates.parse_date(d)["date"]))
        return F.struct(
            rate.alias("has_rate"), F.when(rate, value(numbers("decimal"))).alias("rate"),
            percentage.alias("has_percentage"), F.when(percentage, value(numbers("percentage"))).alias("percentage"),
            gross.alias("has_gross"), F.when(gross, amount).alias("gross"),
            discount.alias("has_discount"), F.when(discount, amount).alias("discount"),
            net.alias("has_net"), F.when(net, amount).alias("net"),
            F.when(rate & ~mixed & (F.size(days) == 1), F.get(days, F.lit(0))).alias("date"),
        )

    pieces = F.transform(F.regexp_extract_all(line, F.lit(MONEY), F.lit(0)), lambda m: money.parse_amount(m))
    source = F.struct(line.alias("line"), text.padded(text.phrase_tokens(line)).alias("flat"), number_candidates(line).alias("numbers"), pieces.alias("money"), billing_currency.alias("unit"))
    return let(source, read)


def foreign_exchange(rows: DataFrame, lines: DataFrame, row: Sequence[str]) -> DataFrame:
    """``rows`` (row, original_currency, billing_currency) with ``exchange_rate``, ``fee_percentage``, ``gross_fee``, ``fee_discount``,
    ``net_fee``, ``net_source`` (printed or derived), ``conversion_date`` and ``fx_diagnostics``, from detail ``lines`` (row, text).

    Rows of one currency have none. A value that two lines name, or whose line
    doesn't have exactly one, is null with a diagnostic. Without a printed net
    fee it is the gross fee less the discount.
    """
    foreign = rows.filter(F.col("original_currency").isNotNull() & (F.col("original_currency") != F.col("billing_currency"))).select(*row, "billing_currency")
    read = lines.join(foreign, list(row)).select(*row, fx_line(F.col("text"), F.col("billing_currency")).alias("x"))
    parts = ("rate", "percentage", "gross", "discount", "net")
    counted = [c for p in parts for c in (F.count_if(F.col(f"x.has_{p}")).alias(f"n_{p}"), F.max(f"x.{p}").alias(p))]
    found = read.groupBy(*row).agg(*counted, F.count_distinct("x.date").alias("n_date"), F.max("x.date").alias("date"))
    sure = {p: F.when(F.col(f"n_{p}") == 1, F.col(p)) for p in parts}
    lost = lambda *names: F.lit(False) if not names else (F.col(f"n_{names[0]}") > 0) & sure[names[0]].isNull() | lost(*names[1:])
    raised = diagnostics(
        (lost("rate"), "unparsed_exchange_rate_candidate"),
        (lost("percentage"), "unparsed_foreign_currency_fee_percentage_candidate"),
        (lost("gross", "net"), "unparsed_foreign_currency_fee_candidate"),
        (lost("discount"), "unparsed_foreign_currency_fee_discount_candidate"),
        (F.col("n_date") > 1, "ambiguous_conversion_date"),
    )
    unit = F.lit("")
    derived = F.when(F.col("n_net") == 0, money.net_fee(sure["gross"], sure["discount"], unit, unit))
    made = found.select(
        *row,
        sure["rate"].alias("exchange_rate"),
        sure["percentage"].alias("fee_percentage"),
        sure["gross"].alias("gross_fee"),
        sure["discount"].alias("fee_discount"),
        F.coalesce(sure["net"], derived).alias("net_fee"),
        F.when(sure["net"].isNotNull(), "printed").when(derived.isNotNull(), "derived").alias("net_source"),
        F.when(F.col("n_date") == 1, F.col("date")).alias("conversion_date"),
        raised.alias("fx_diagnostics"),
    )
    return rows.join(made, list(row), "left")
