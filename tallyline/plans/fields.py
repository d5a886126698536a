"""Original amounts and foreign exchange of generated transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fields as f
from .base import Tables, query
from .structure import picked

#: Eight kinds of rows: the cells of the original column, and of the currency's where the table has one.
SCHEMAS = {0: "a", 1: "ac", 2: "ac", 3: "a", 4: "aac", 5: "a", 6: "ac", 7: ""}


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS form, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)
SELECT o_orderkey, CASE WHEN form IN (0, 1) THEN CAST(amount AS DOUBLE) WHEN form = 3 AND o_orderkey % 3 > 0 THEN 1234.5 END AS amount,
  CASE WHEN form = 0 THEN 'USD' WHEN form = 1 THEN 'EUR' WHEN form = 3 AND o_orderkey % 3 > 0 THEN 'GBP' END AS currency,
  CASE form WHEN 2 THEN 'unknown_original_currency,original_amount:unknown_currency' WHEN 3 THEN CASE WHEN o_orderkey % 3 > 0 THEN '' ELSE 'multiple_original_amount_cells' END
    WHEN 4 THEN 'multiple_original_amount_columns' WHEN 5 THEN CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'missing_original_amount_cell' END
    WHEN 6 THEN 'missing_original_currency_cell,original_amount:unknown_currency' ELSE '' END AS diagnostics
FROM o
""")
def original_amounts(t: Tables) -> DataFrame:
    """The original amount of a row, from the cells of its table's original columns."""
    form, amount = F.col("o_orderkey") % 8, F.col("o_totalprice").cast("decimal(18,2)")
    base = t.orders.select(form.alias("tbl"), F.col("o_orderkey").alias("row"), amount.alias("written"))
    rows = base.select("tbl", "row", F.when((F.col("tbl") == 5) & (F.col("row") % 3 == 0), -F.col("written")).otherwise(F.col("written")).alias("billed_amount"))
    columns = [(i, k, "ORIGINAL_AMOUNT" if c == "a" else "ORIGINAL_CURRENCY") for i, shape in SCHEMAS.items() for k, c in enumerate(shape)]
    columns += [(i, 9, "AMOUNT") for i in SCHEMAS]
    plain = F.col("written").cast("string")
    cell = lambda column, written, when: F.when(when, F.struct(F.lit(column).alias("column"), written.alias("text")))
    of = lambda *forms: F.col("tbl").isin(*forms)
    cells = F.array_compact(
        F.array(
            cell(9, plain, F.lit(True)),
            cell(0, F.concat(F.lit("$"), plain), of(0)),
            cell(0, plain, of(1, 2, 4, 6)),
            cell(1, F.lit("EUR"), of(1)),
            cell(1, F.lit("tokens"), of(2)),
            cell(0, F.lit("1,234.50 GBP"), of(3)),
            cell(0, plain, of(3) & (F.col("row") % 3 == 0)),
            cell(1, plain, of(4)),
        )
    )
    found = base.select("tbl", "row", F.explode(cells).alias("c")).select("tbl", "row", "c.column", "c.text")
    schema = t.spark.createDataFrame(columns, "tbl long, column int, role string")
    made = f.original_amounts(rows, F.broadcast(schema), found, ["tbl"], ["row"])  # a constant of a few rows
    return made.select(F.col("row").alias("o_orderkey"), F.col("original_amount").cast("double").alias("amount"), F.col("original_currency").alias("currency"), F.array_join("original_diagnostics", ",").alias("diagnostics"))


#: Detail lines, and what each names: (line, rate, percentage, gross, discount, net, date); '?' is a name without its value.
DETAILS = (
    ("Exchange rate 3.6500 on 05/02/2024", "3.65", None, None, None, None, "2024-02-05"),
    ("foreign-currency fee 2.50%", None, "2.5", None, None, None, None),
    ("Fee amount ILS 4.20", None, None, "4.2", None, None, None),
    ("discount 1.20 NIS", None, None, None, "1.2", None, None),
    ("exchange rate 3.1 fee amount ILS 2.00", "?", None, "?", None, None, None),
    ("net fee ILS 3.00", None, None, None, None, "3", None),
    ("conversion rate 3.1 3.2", "?", None, None, None, None, None),
    ("some shop 4.50", None, None, None, None, None, None),
    ("שער המרה 3.70 מיום 6.2.2024", "3.7", None, None, None, None, "2024-02-06"),
    ("עמלת מט״ח בסך 2.10 ש״ח", None, None, "2.1", None, None, None),
    ("discount 5.00 USD", None, None, None, "?", None, None),
    ("commission 1.5 %, not 2 %", None, "?", None, None, None, None),
    ("הנחה ₪0.60", None, None, None, "0.6", None, None),
)
_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in (i, *line[1:])) + ")" for i, line in enumerate(DETAILS))
_NAMES = ("rate", "percentage", "gross", "discount", "net")


@query(f"""
WITH d(i, rate, percentage, gross, discount, net, day) AS (VALUES {_ROWS}),
o AS (SELECT o_orderkey, o_orderkey % 5 > 0 AS is_foreign FROM orders),
l AS (SELECT o_orderkey, d.* FROM o, range(4) r(k) JOIN d ON CAST(d.i AS BIGINT) = (o_orderkey // 5 * (2 * k + 1) + k * 3) % {len(DETAILS)} WHERE is_foreign),
s AS (SELECT o_orderkey, {", ".join(f"count({n}) AS n_{n}, CASE WHEN count({n}) = 1 AND max({n}) <> '?' THEN CAST(nullif(max({n}), '?') AS DOUBLE) END AS {n}" for n in _NAMES)},
  count(DISTINCT day) AS n_day, max(day) AS day FROM l GROUP BY o_orderkey),
f AS (SELECT *, CASE WHEN n_net = 0 AND gross - discount >= 0 THEN gross - discount END AS derived FROM s)
SELECT o.o_orderkey, rate, percentage, gross, discount, round(coalesce(net, derived), 6) AS net, CASE WHEN net IS NOT NULL THEN 'printed' WHEN derived IS NOT NULL THEN 'derived' END AS net_source,
  CASE WHEN n_day = 1 THEN day END AS day,
  coalesce(concat_ws(',', CASE WHEN n_rate > 0 AND rate IS NULL THEN 'rate' END, CASE WHEN n_percentage > 0 AND percentage IS NULL THEN 'percentage' END,
    CASE WHEN (n_gross > 0 AND gross IS NULL) OR (n_net > 0 AND net IS NULL) THEN 'fee' END, CASE WHEN n_discount > 0 AND discount IS NULL THEN 'discount' END, CASE WHEN n_day > 1 THEN 'date' END), '') AS lost
FROM o LEFT JOIN f USING (o_orderkey)
""")
def foreign_exchange(t: Tables) -> DataFrame:
    """Rate, fee percentage, fees and conversion date from the detail lines of foreign transactions."""
    key = F.col("o_orderkey")
    unit = F.when(key % 5 > 0, "USD").otherwise("ILS")
    rows = t.orders.select(key.alias("row"), unit.alias("original_currency"), F.lit("ILS").alias("billing_currency"))
    k = t.orders.select(key.alias("row"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    lines = k.select("row", picked(F.floor(F.col("row") / 5) * (2 * F.col("k") + 1) + F.col("k") * 3, *(d[0] for d in DETAILS)).alias("text"))
    made = f.foreign_exchange(rows, lines, ["row"])
    short = {"unparsed_exchange_rate_candidate": "rate", "unparsed_foreign_currency_fee_percentage_candidate": "percentage", "unparsed_foreign_currency_fee_candidate": "fee", "unparsed_foreign_currency_fee_discount_candidate": "discount", "ambiguous_conversion_date": "date"}
    names = F.create_map(*(F.lit(x) for pair in short.items() for x in pair))
    figure = lambda c, name: F.col(c).cast("double").alias(name)
    return made.select(
        F.col("row").alias("o_orderkey"), figure("exchange_rate", "rate"), figure("fee_percentage", "percentage"), figure("gross_fee", "gross"), figure("fee_discount", "discount"), figure("net_fee", "net"),
        "net_source", F.col("conversion_date").cast("string").alias("day"), F.coalesce(F.array_join(F.transform("fx_diagnostics", lambda d: names[d]), ","), F.lit("")).alias("lost"),
    )


