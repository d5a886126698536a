"""Region scans and ledger totals of generated pages, some forms of pages over and over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import headers, regions
from .base import Tables, query
from .structure import listed, picked

#: Kinds of lines: (gap above, roles, in band, total, shaped, detail).
KINDS = {
    "head": (4, 3, True, False, False, False),
    "row": (4, 0, True, False, True, False),
    "detail": (4, 0, True, False, False, True),
    "words": (4, 0, True, False, False, False),
    "aside": (4, 0, False, False, True, False),
    "total": (4, 0, True, True, False, False),
    "far": (40, 0, True, False, True, False),
}
#: Pages as their lines, and what a scan says of each: the header's line and the state.
PAGES = (
    (("words", "head", "row", "detail", "row", "total", "row"), ((None, None), (1, "header"), (1, "row"), (1, "row"), (1, "row"), (1, "total"), (None, None))),
    (("head", "words", "words", "row", "words", "row", "far", "row"), ((0, "header"), (0, "preamble"), (0, "preamble"), (0, "row"), (0, "passed"), (0, "row"), (0, "gap"), (None, None))),
    (("head", "words", "words", "words", "words", "words", "row"), ((0, "header"), (0, "preamble"), (0, "preamble"), (0, "preamble"), (0, "preamble"), (0, "change"), (None, None))),
    (("head", "row", "aside", "head", "detail", "row", "words", "words", "words", "words"), ((0, "header"), (0, "row"), (0, "outside"), (3, "header"), (3, "preamble"), (3, "row"), (3, "change"), (None, None), (None, None), (None, None))),
    (("head", "row", "words", "words", "total", "head", "row", "words", "aside", "words", "row"), ((0, "header"), (0, "row"), (0, "change"), (None, None), (None, None), (5, "header"), (5, "row"), (5, "change"), (None, None), (None, None), (None, None))),
)
_SAID = ", ".join(f"({form}, {at}, {'NULL' if head is None else head}, {'NULL' if state is None else repr(state)})" for form, (_, said) in enumerate(PAGES) for at, (head, state) in enumerate(said))


@query(f"""
WITH s(form, line, header, state) AS (VALUES {_SAID})
SELECT o_orderkey AS page, CAST(line AS BIGINT) AS line, CAST(header AS BIGINT) AS header, state FROM orders JOIN s ON form = o_orderkey % {len(PAGES)}
""")
def region_scan(t: Tables) -> DataFrame:
    """Tables between their headers and what ends them."""
    rows = []
    for form, (kinds, _) in enumerate(PAGES):
        y = 0.0
        for line, kind in enumerate(kinds):
            gap, *flags = KINDS[kind]
            y += gap
            rows.append((form, line, y, y + 10.0, 10.0, *flags))
            y += 10.0
    template = t.spark.createDataFrame(rows, "form long, line long, top double, bottom double, height double, roles int, in_band boolean, is_total boolean, shaped boolean, detail boolean")
    lines = t.orders.select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % len(PAGES)).alias("form")).join(F.broadcast(template), "form").drop("form")  # a constant of a few rows
    return regions.scan_regions(lines, ["page"])


#: Pages as cells (line, column, gap above, text), and the ledger of each total line.
LEDGERS = (
    ((("Reward points", 0, 4), ("1,200", 0, 4), ("350", 0, 4), ("Total", 1, 4), ("1 550", 0, None)), {3: "points"}),
    ((("points", 0, 4), ("Total", 1, 4), ("1550", 0, None)), {1: None}),
    ((("points", 0, 4), ("12", 0, 4), ("Total", 1, 4), ("$ 12", 0, None)), {2: None}),
    ((("Interest rate", 0, 4), ("7.5 %", 0, 4), ("8,1%", 1, None), ("Total amount", 0, 4)), {2: "rates"}),
    ((("APR", 0, 4), ("7.5 %", 0, 4), ("8.1%", 0, 4), ("Subtotal", 0, 60)), {3: None}),
    ((("ריבית", 0, 4), ("7.5 %", 0, 4), ("grand total", 0, 4), ("1%", 1, None)), {2: "rates"}),
    ((("points", 0, 4), ("7", 0, 4), ("subtotal", 1, 4), ("7", 0, None), ("9", 0, 4), ("total", 1, 4), ("16", 0, None)), {2: "points", 4: None}),
)
_LEDGERS = ", ".join(f"({form}, {line}, {'NULL' if name is None else repr(name)})" for form, (_, said) in enumerate(LEDGERS) for line, name in said.items())


@query(f"""
WITH s(form, line, ledger) AS (VALUES {_LEDGERS})
SELECT o_orderkey AS page, CAST(line AS BIGINT) AS line, ledger FROM orders JOIN s ON form = o_orderkey % {len(LEDGERS)}
""")
def ledger_totals(t: Tables) -> DataFrame:
    """P10: totals of points and of rates are no totals of money."""
    rows = []
    for form, (cells, _) in enumerate(LEDGERS):
        y, line = 0.0, -1
        for written, column, gap in cells:
            if gap is not None:
                y, line = y + gap + (10 if line >= 0 else 0), line + 1
            rows.append((form, line, column, y, y + 10.0, written))
    template = t.spark.createDataFrame(rows, "form long, line long, column int, top double, bottom double, text string")
    cells = t.orders.select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % len(LEDGERS)).alias("form")).join(F.broadcast(template), "form").drop("form")  # a constant of a few rows
    return regions.ledger_totals(cells, ["page"])


TOTALS = ("Total: 12.50", "total_billed 3", "a total", "SUBTOTAL", "Totals", 'סה"כ חיוב 5', "סך הכל", "amount due on", "amount, due", "sum", "סכום לחיוב בש״ח")


@query(rf"""
WITH f AS (SELECT event_id, {listed("event_id", TOTALS)} AS line FROM events),
n AS (SELECT event_id, ' ' || trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS flat FROM f)
SELECT event_id, {" OR ".join(f"starts_with(flat, ' {m} ')" for m in headers.TOTAL_MARKERS)} AS is_total FROM n
""")
def total_rows(t: Tables) -> DataFrame:
    """P5."""
    return t.events.select("event_id", headers.is_total(picked(F.col("event_id"), *TOTALS)).alias("is_total"))
