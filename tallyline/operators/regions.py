"""Table regions of a page by one scan with a bounded look ahead, and totals of other ledgers."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text
from .headers import TOTAL_MARKERS
from .layout import median

# fixed values: rows before the first transaction, the gap that ends a table in median heights, rows looked ahead
MOST_PREAMBLE, STRUCTURAL_GAP, LOOK_AHEAD, ADJACENT = 4, 2.5, 3, 1.5

# fixed values: phrases of ledgers that are no transactions
POINTS_MARKERS = ("loyalty points", "points", "reward points", "rewards points", "נקודה", "נקודות")
RATE_MARKERS = (
    "annual percentage rate",
    "annual rate",
    "apr",
    "effective rate",
    "interest rate",
    "interest rates",
    "nominal rate",
    "rate",
    "rates",
    "ריבית",
    "ריביות",
    "ריבית אפקטיבית",
    "ריבית מתואמת",
    "ריבית נומינלית",
    "שיעור ריבית",
    "שיעור הריבית",
)
COUNT_VALUE = r"^[+-]?(?:\d+|\d{1,3}(?:[,\s]\d{3})+)$"
PERCENT_VALUE = r"^[+-]?\d+(?:[.,]\d+)?\s*%$"


class _Scan:
    """The state of a scan: the open region, its rows' heights and how far it has come."""

    def __init__(self):
        self.header, self.heights, self.bottom, self.rows, self.preamble = None, [], 0.0, 0, 0

    def open(self, at: int, line: dict) -> None:
        self.header, self.heights, self.bottom, self.rows, self.preamble = at, [line["height"]], line["bottom"], 0, 0

    def gap(self, line: dict) -> bool:
        return line["top"] - self.bottom > STRUCTURAL_GAP * median(self.heights)

    def take(self, line: dict) -> None:
        insort(self.heights, line["height"])
        self.bottom, self.rows = line["bottom"], self.rows + 1


def scan_page(lines: Sequence[dict]) -> list[tuple[int | None, str | None]]:
    """(index of the header, state) of each line of a page from the top: ``header``, ``row``, ``preamble``, ``outside``,
    ``total``, ``passed`` for a line between rows, ``gap`` or ``change`` for the one that ends a region; nulls outside regions.

    A region goes on from its header through the lines in its band up to a
    total, the next header or a structural gap. A line without the shape of a
    transaction or of its detail ends it too, unless one of the next LOOK_AHEAD
    lines has that shape before any of those ends; before the first row it may
    have MOST_PREAMBLE of them.
    """
    out: list[tuple[int | None, str | None]] = []
    scan = _Scan()
    for at, line in enumerate(lines):
        if line["roles"] >= 2:
            scan.open(at, line)
            out.append((at, "header"))
        elif scan.header is None:
            out.append((None, None))
        elif not line["in_band"]:
            out.append((scan.header, "outside"))
        elif line["is_total"] or scan.gap(line):
            out.append((scan.header, "total" if line["is_total"] else "gap"))
            scan.header = None
        elif line["shaped"] or (scan.rows and line["detail"]):
            scan.take(line)
            out.append((scan.header, "row"))
        elif not scan.rows and scan.preamble < MOST_PREAMBLE:
            scan.preamble, scan.bottom = scan.preamble + 1, line["bottom"]
            out.append((scan.header, "preamble"))
        elif scan.rows and _goes_on(lines[at + 1 : at + 1 + LOOK_AHEAD], scan):
            out.append((scan.header, "passed"))
        else:
            out.append((scan.header, "change"))
            scan.header = None
    return out


def _goes_on(ahead: Sequence[dict], scan: _Scan) -> bool:
    for line in ahead:
        if line["in_band"]:
            if line["roles"] >= 2 or line["is_total"] or scan.gap(line):
                return False
            if line["shaped"]:
                return True
    return False


LINE = ("line", "top", "bottom", "height", "roles", "in_band", "is_total", "shaped", "detail")


def scan_regions(lines: DataFrame, page: Sequence[str]) -> DataFrame:
    """``lines`` (page, and the columns of LINE) as (page, line, header, state) by ``scan_page``; a page is a bounded unit."""
    kinds = dict(lines.dtypes)
    pages = lines.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*LINE))).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, line, header, state = [], [], [], []
            for i, own in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for x, (at, said) in zip(own, scan_page(own), strict=True):
                    of.append(i)
                    line.append(x["line"])
                    header.append(None if at is None else own[at]["line"])
                    state.append(said)
            kept = [c.take(pa.array(of, pa.int64())) for c in batch.columns[:-1]]
            number = batch.schema.field("lines").type.value_type.field("line").type
            yield pa.RecordBatch.from_arrays([*kept, pa.array(line, number), pa.array(header, number), pa.array(state, pa.string())], names=[*batch.schema.names[:-1], "line", "header", "state"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in page), f"line {kinds['line']}, header {kinds['line']}, state string"])
    return pages.mapInArrow(run, schema)


def ledger_totals(cells: DataFrame, page: Sequence[str]) -> DataFrame:
    """Total rows (page, line) of ``cells`` (page, line, column, top, bottom, text) with ``ledger``: ``points`` or ``rates`` where
    they sum no money (P10).

    Points: the total has a count and no currency, above its column stands a
    points header, and between them are counts of that column but no total.
    Rates: a rate header stands above in one run of adjacent rows, which has two
    percentages or more up to its end.
    """
    flat = text.padded(text.phrase_tokens(F.col("text")))
    has = lambda words: text.phrase_in(F.col("__flat"), words)
    known = cells.withColumn("__flat", flat).withColumns(
        {
            "__points": has(POINTS_MARKERS), "__rate": has(RATE_MARKERS), "__total": has(TOTAL_MARKERS), "__count": F.trim("text").rlike(COUNT_VALUE),
            "__percent": F.trim("text").rlike(PERCENT_VALUE), "__money": F.size(money.currencies_in(F.col("text"))) > 0,
        }
    )
    rows = known.groupBy(*page, "line").agg(
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.bool_or("__total").alias("total"), F.bool_or("__rate").alias("rate"), F.bool_or("__money").alias("money"), F.count_if("__percent").alias("percents")
    )
    order = Window.partitionBy(*page).orderBy("line")
    scale = F.greatest(F.col("bottom") - F.col("top"), F.lag(F.col("bottom") - F.col("top")).over(order))
    apart = F.coalesce(F.col("top") - F.lag("bottom").over(order) > ADJACENT * scale, F.lit(True))
    before = F.coalesce(F.sum(F.col("total").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("run", F.sum(apart.cast("int")).over(order))
    run = Window.partitionBy(*page, "run")
    headed = F.max(F.col("rate").cast("int")).over(run.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)) == 1
    first = F.min(F.when(F.col("rate"), F.col("line"))).over(run)
    rows = rows.withColumn("headed", F.coalesce(headed, F.lit(False))).withColumn("first", first)
    rates = F.sum(F.when(F.col("line") >= F.col("first"), F.col("percents"))).over(run) >= 2
    rows = rows.withColumn("rates", F.col("total") & F.col("headed") & F.coalesce(rates, F.lit(False)))
    # down one column: the last points header, and the counts since
    column = Window.partitionBy(*page, "column").orderBy("line")
    marked = known.filter("__points or __count").join(rows.select(*page, "line", "before", "total", "money"), [*page, "line"])
    section = F.sum(F.col("__points").cast("int")).over(column)
    marked = marked.withColumn("section", section).filter("section > 0")
    own = Window.partitionBy(*page, "column", "section").orderBy("line")
    counts = F.sum(F.when(~F.col("__points") & F.col("__count"), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1))
    start = F.first(F.when(F.col("__points"), F.col("before") + F.col("total").cast("int")), True).over(own)
    points = marked.withColumn("ok", F.col("total") & ~F.col("money") & F.col("__count") & ~F.col("__points") & (counts >= 1) & (F.col("before") == start)).filter("ok").select(*page, "line").distinct()
    totals = rows.filter("total").join(points.withColumn("points", F.lit(True)), [*page, "line"], "left")
    return totals.select(*page, "line", F.when(F.col("points"), "points").when(F.col("rates"), "rates").alias("ledger"))
