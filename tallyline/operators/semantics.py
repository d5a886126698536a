"""Which cells of a row no column accounts for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions.let import diagnostics, let

# fixed values: digits of identifiers that say nothing of a transaction
CARD_IDENTIFIER, LOCATION_IDENTIFIER = r"^\*{0,4}\d{4}$", r"^\d{10}$"


def is_relevant(cell: Column) -> Column:
    """Whether a text has the shape of a date, an amount, an installment or a currency."""
    amount = let(money.parse_amount(cell), money.is_money_shaped)
    return F.coalesce(dates.isolated_date_token(cell).isNotNull() | amount | dates.is_installment(cell) | money.is_currency_shaped(cell), F.lit(False))


def assignment_diagnostics(cells: DataFrame, columns: DataFrame, table: Sequence[str], row: Sequence[str]) -> DataFrame:
    """(table, row, diagnostics) of ``cells`` (table, row, cell, center, text) against ``columns`` (table, column, low, high, role, ambiguous, ancillary).

    A cell belongs to the columns that hold its centre, bounds included. None
    or several are reported; and where the cell is relevant, so is a column of
    no known role, of an ambiguous one, or of a place that the cell is no
    identifier of. Ancillary columns and card identifiers may be unknown. Codes
    are in the order of the cells, each once.
    """
    key = [*table, *row, "cell"]
    inside = F.struct("column", "role", "ambiguous", "ancillary")
    held = cells.join(columns, list(table), "left").withColumn("__in", F.when((F.col("low") <= F.col("center")) & (F.col("center") <= F.col("high")), inside))
    found = held.groupBy(*key).agg(F.any_value("text").alias("text"), F.count("__in").alias("n"), F.max("__in").alias("own"))
    relevant = is_relevant(F.col("text"))
    known = found.withColumn("relevant", relevant)
    name = lambda code: F.concat(F.lit("column:"), F.col("own.column").cast("string"), F.lit(f":{code}"))
    unknown = F.col("own.role") == "UNKNOWN"
    safe = unknown & (F.col("own.ancillary") | F.col("text").rlike(CARD_IDENTIFIER))
    one, asked = F.col("n") == 1, F.col("relevant")
    no_role = one & asked & unknown & ~safe
    no_place = one & asked & (F.col("own.role") == "LOCATION") & ~F.col("text").rlike(LOCATION_IDENTIFIER)
    rival = one & asked & F.col("own.ambiguous") & ~safe
    codes = diagnostics((F.col("n") == 0, "unmatched_cell"), (F.col("n") > 1, "multiply_assigned_cell"))
    named = F.array_compact(F.array(F.when(no_role, name("role_unknown")), F.when(no_place, name("unexpected_location_value")), F.when(rival, name("ambiguous_role"))))
    unresolved = F.when(asked & ((F.col("n") != 1) | no_role | no_place | rival), F.array(F.lit("unresolved_relevant_cell"))).otherwise(F.array().cast("array<string>"))
    judged = known.select(*key, F.concat(codes, named, unresolved).alias("codes"))
    gathered = judged.groupBy(*table, *row).agg(F.array_sort(F.collect_list(F.struct("cell", "codes"))).alias("by_cell"))
    return gathered.select(*table, *row, F.array_distinct(F.flatten(F.transform("by_cell", lambda c: c["codes"]))).alias("diagnostics"))
