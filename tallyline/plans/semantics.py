"""Assignment of generated cells to columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import semantics
from .base import Tables, query

#: (column, low, high, role, ambiguous, ancillary)
COLUMNS = (
    (0, 0.0, 10.0, "DATE", False, False),
    (1, 10.0, 30.0, "DESCRIPTION", False, False),
    (2, 31.0, 40.0, "UNKNOWN", False, False),
    (3, 41.0, 50.0, "LOCATION", False, False),
    (4, 51.0, 60.0, "AMOUNT", True, False),
    (5, 61.0, 70.0, "UNKNOWN", True, True),
)
#: (centre, text, diagnostics) of cells of every kind.
CELLS = (
    (5.0, "12/03/2024", ""),
    (10.0, "shop", "multiply_assigned_cell"),
    (10.0, "3.50 $", "multiply_assigned_cell,unresolved_relevant_cell"),
    (30.5, "words", "unmatched_cell"),
    (30.5, "4/12", "unmatched_cell,unresolved_relevant_cell"),
    (35.0, "12.50", "column:2:role_unknown,unresolved_relevant_cell"),
    (35.0, "1234", ""),
    (35.0, "words", ""),
    (45.0, "05/06/2024", "column:3:unexpected_location_value,unresolved_relevant_cell"),
    (45.0, "0123456789", ""),
    (55.0, "7.10 EUR", "column:4:ambiguous_role,unresolved_relevant_cell"),
    (65.0, "9.99", ""),
    (80.0, "₪", "unmatched_cell,unresolved_relevant_cell"),
)
_CELLS = ", ".join(f"({i}, '{codes}')" for i, (_, _, codes) in enumerate(CELLS))


@query(f"""
WITH k(i, codes) AS (VALUES {_CELLS}),
c AS (SELECT o_orderkey, p, k.codes FROM orders, range(3) r(p) JOIN k ON k.i = (o_orderkey * (p + 1) + p * p) % {len(CELLS)}),
x AS (SELECT o_orderkey, p, j, string_split(codes, ',')[j] AS code FROM c, range(1, 4) t(j) WHERE codes <> '' AND j <= len(string_split(codes, ','))),
f AS (SELECT o_orderkey, code, min((p, j)) AS first_ FROM x GROUP BY ALL),
g AS (SELECT o_orderkey, string_agg(code, ',' ORDER BY first_) AS codes FROM f GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(codes, '') AS diagnostics FROM orders LEFT JOIN g USING (o_orderkey)
""")
def assignment_diagnostics(t: Tables) -> DataFrame:
    """Three cells a row, held by no, one or several columns of every kind."""
    columns = F.broadcast(t.spark.createDataFrame([(0, *c) for c in COLUMNS], "tbl int, column int, low double, high double, role string, ambiguous boolean, ancillary boolean"))  # a constant of a few rows
    kinds = F.array(*(F.struct(F.lit(x).alias("center"), F.lit(written).alias("text")) for x, written, _ in CELLS))
    placed = t.orders.select("o_orderkey", F.lit(0).alias("tbl"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cell"))
    kind = F.element_at(kinds, (F.pmod(F.col("o_orderkey") * (F.col("cell") + 1) + F.col("cell") * F.col("cell"), F.lit(len(CELLS))) + 1).cast("int"))
    cells = placed.withColumn("k", kind).select("tbl", "o_orderkey", "cell", "k.center", "k.text")
    made = semantics.assignment_diagnostics(cells, columns, ["tbl"], ["o_orderkey"])
    return made.select("o_orderkey", F.array_join("diagnostics", ",").alias("diagnostics"))
