"""Header bands, marker bands, logical cells and continuation rows of a table.

Everything is windows, minima and equi-joins inside a page or table; a rule
that looks ahead is bounded by a constant, so it is a lead or a row number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions import geometry as g
from ..functions.let import let
from . import headers
from .evidence import reading_order
from .fields import RATE_CUES
from .windows import owners, sessions

# fixed values: the words of detail rows, and the bounds of blocks of them
DETAIL_MARKERS = ("commission", "conversion rate", "exchange rate", "fee", "surcharge", "עמלה", "הערה", "המרה", "הומר", "שער המרה")
CARD_MARKERS = ("card id", "card identifier", "מזהה כרטיס")
CARD_DIGITS = (4, 10)
NOTE = "הערה"
MOST_FRAGMENTS, MOST_CONVERSION_ROWS = 2, 4
# fixed values: rows and the share of rows that prove a band of markers, and how far off a marker's centre may be in heights
BAND_ROWS, BAND_SHARE, BAND_OFF = 3, 3, 0.5


def merged_headers(cells: DataFrame, page: Sequence[str]) -> DataFrame:
    """Header cells (page, line, cell, text, n_fragments) with the words of the lines below that go on with them (K3).

    A header line names two roles or more. A line below goes on with it if it is
    no more than the header's median height away from what it follows, names
    less than two roles, has no date or amount, and the header is no more than
    MOST_FRAGMENTS lines above. A word of it belongs to the header cell whose
    stretch between the middles of neighbouring cells holds its centre.
    """
    role = headers.role(headers.role_scores(F.col("text")))
    shaped = dates.isolated_date_token(F.col("text")).isNotNull() | money.money_shaped(F.col("text"))
    word = F.struct(g.center_x(F.col("box")).alias("center"), "cell", "text")
    known = cells.dropna(subset=[*page, "line"]).select(*page, "line", "box", word.alias("word"), role.alias("role"), shaped.alias("shaped"))
    # a page meets once: its lines carry their words, so nothing is joined to them again
    lines = known.repartition(*page).groupBy(*page, "line").agg(
        F.array_sort(F.collect_list("word")).alias("words"), F.size(F.array_remove(F.collect_set("role"), "UNKNOWN")).alias("roles"), F.bool_or("shaped").alias("shaped"),
        F.min("box.y0").alias("top"), F.max("box.y1").alias("bottom"), F.median(g.height(F.col("box"))).alias("height"),
    )
    order = Window.partitionBy(*page).orderBy("top", "line")
    is_header = F.col("roles") >= 2
    placed = lines.withColumn("at", F.row_number().over(order)).withColumn("gap", F.col("top") - F.lag("bottom").over(order))
    last = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("head", F.last(F.when(is_header, F.struct("line", "at", "height", "words")), True).over(last)).filter("head is not null")
    near = ~is_header & ~F.col("shaped") & (F.col("gap") <= F.col("head.height")) & (F.col("at") - F.col("head.at") <= MOST_FRAGMENTS)
    # each line between the header and this one goes on with it too
    run = Window.partitionBy(*page, "head.line").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = placed.withColumn("ok", F.min((is_header | near).cast("int")).over(run)).filter("ok = 1")
    middle = lambda i, j: (F.get("head.words", i)["center"] + F.get("head.words", j)["center"]) / 2
    stretches = F.transform(
        "head.words",
        lambda w, i: F.named_struct(F.lit("cell"), w["cell"], F.lit("low"), F.coalesce(middle(i - 1, i), F.lit(float("-inf"))), F.lit("high"), F.coalesce(middle(i, i + 1), F.lit(float("inf")))),
    )
    belongs = parts.select(*page, "line", F.col("head.line").alias("header"), F.explode("words").alias("word"), stretches.alias("stretches"))
    own = F.get(F.filter("stretches", lambda s: (s["low"] <= F.col("word.center")) & (F.col("word.center") < s["high"])), F.lit(0))
    owned = belongs.select(*page, "header", "line", "word", own.alias("own")).filter("own is not null")
    merged = owned.groupBy(*page, F.col("header").alias("line"), F.col("own.cell").alias("cell")).agg(F.array_sort(F.collect_list(F.struct("line", "word.center", "word.text"))).alias("words"))
    return merged.select(*page, "line", "cell", F.array_join(F.transform("words", lambda x: x["text"]), " ").alias("text"), (F.size(F.array_distinct(F.transform("words", lambda x: x["line"]))) - 1).alias("n_fragments"))


def separated_markers(cells: DataFrame, table: Sequence[str], row: str, role: str = "DATE") -> DataFrame:
    """Date cells (table, row, box, text) with ``date`` and ``marker``, the label beside it where the table has a band of them (K8).

    A label is what a cell has before or after its one date, without a digit or
    percent sign. A band is on one side, in BAND_ROWS rows or more and a third
    of the rows, its labels' places within BAND_OFF heights of their median;
    other tables keep their cells whole.
    """
    token = dates.isolated_date_token(F.col("text"))
    dated = cells.filter(F.col("role") == role).withColumn("__token", token)
    before = F.trim(F.call_function("substring_index", F.col("text"), F.col("__token"), F.lit(1)))
    after = F.trim(F.call_function("substr", F.col("text"), F.instr(F.col("text"), F.col("__token")) + F.length("__token")))
    sided = dated.withColumn("__before", before).withColumn("__after", after)
    label = lambda own, other: (F.col(own) != "") & (F.col(other) == "") & ~F.col(own).rlike(r"[\p{N}%]")
    sided = sided.withColumn("__side", F.when(label("__before", "__after"), "left").when(label("__after", "__before"), "right"))
    edge = F.when(F.col("__side") == "left", F.col("box.x0")).when(F.col("__side") == "right", F.col("box.x1"))
    sided = sided.withColumn("__edge", edge).withColumn("__height", g.height(F.col("box")))
    bands = sided.groupBy(*table).agg(
        F.count_distinct(row).alias("rows"), F.count("__side").alias("n"), F.count_distinct("__side").alias("sides"), F.max("__side").alias("side"),
        F.median("__edge").alias("edge"), F.median(F.when(F.col("__side").isNotNull(), F.col("__height"))).alias("height"), F.min("__edge").alias("least"), F.max("__edge").alias("most"),
    )
    within = F.greatest(F.col("most") - F.col("edge"), F.col("edge") - F.col("least")) <= BAND_OFF * F.col("height")
    proven = bands.filter((F.col("sides") == 1) & (F.col("n") >= BAND_ROWS) & (F.col("n") * BAND_SHARE >= F.col("rows")) & within).select(*table, F.lit(True).alias("__band"))
    joined = sided.join(proven, list(table), "left")
    split = F.col("__band") & F.col("__side").isNotNull()
    marker = F.when(F.col("__side") == "left", F.col("__before")).otherwise(F.col("__after"))
    return joined.select(*table, row, F.when(split, F.col("__token")).otherwise(F.col("text")).alias("date"), F.when(split, marker).alias("marker"))


def logical_cells(glyphs: DataFrame, cells: DataFrame, page: Sequence[str], cell: Sequence[str], gap: float = 0.25) -> DataFrame:
    """Cells (page, cell, box, text) with ``logical``: what their glyphs (page, char, box) say in reading order, or else their text.

    A glyph belongs to the cell that holds its centre, the one of the nearest
    centre where several do. Glyphs are words by gaps of a quarter of their
    height, right-to-left words are turned, and then the words are ordered.
    """
    keys = [*page, *cell]
    inside = g.center_inside(F.col("g_box"), F.col("box"))
    off = F.abs(g.center_x(F.col("g_box")) - g.center_x(F.col("box"))) + F.abs(g.center_y(F.col("g_box")) - g.center_y(F.col("box")))
    pairs = glyphs.select(*page, "char", F.col("box").alias("g_box")).join(cells.select(*keys, "box"), list(page)).filter(inside)
    owned = pairs.groupBy(*page, "char", "g_box").agg(F.min_by(F.struct(*cell), F.struct(off, *cell)).alias("own")).select(*page, "own.*", "char", F.col("g_box").alias("box"))
    order = ["box.x0", "char"]
    apart = F.col("box.x0") - F.lag("box.x1").over(Window.partitionBy(*keys).orderBy(*order)) > gap * g.height(F.col("box"))
    runs = sessions(owned.withColumn("__apart", F.coalesce(apart, F.lit(True))), keys, order, F.col("__apart"), "__word")
    made = runs.groupBy(*keys, "__word").agg(F.array_sort(F.collect_list(F.struct(F.col("box.x0").alias("x"), "char"))).alias("chars"))
    shown = F.array_join(F.transform("chars", lambda c: c["char"]), "")
    word = F.when(text.direction(shown) == "rtl", F.reverse(shown)).otherwise(shown)
    lines = made.select(*keys, F.struct(F.get("chars", F.lit(0))["x"].alias("x"), word.alias("text")).alias("w")).groupBy(*keys).agg(F.collect_list("w").alias("words"))
    joined = cells.join(lines, keys, "left").withColumn("logical", F.when(F.col("words").isNotNull(), reading_order(F.coalesce("words", F.array().cast("array<struct<x:double,text:string>>")))))
    return joined.withColumn("logical", F.coalesce("logical", "text")).drop("words")


def continuation_kinds(rows: DataFrame, table: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows (table, order, text, n_cells, n_dates, n_amounts, in_description) with ``kind`` and ``owner``.

    ``kind`` is ``primary`` for a row with a date and an amount; for others what
    they say of a primary row, by the first rule that holds; null for rows that
    say nothing. ``owner`` is the ordinal of the primary row above, or, of
    details that lead, below. A conversion block has at most MOST_CONVERSION_ROWS rows.
    """
    line = text.padded(text.phrase_tokens(F.col("text")))
    letters, digits = F.col("text").rlike(r"\p{L}"), F.length(F.regexp_replace("text", r"\D", ""))
    primary = (F.col("n_dates") > 0) & (F.col("n_amounts") > 0)

    def chain(flat: Column) -> Column:
        has = lambda words: text.phrase_in(flat, words)
        return (
            F.when(primary, "primary")
            .when(has(CARD_MARKERS) & digits.between(*CARD_DIGITS), "card_identifier_block")
            .when(has(RATE_CUES), "foreign_conversion_block")
            .when(flat.startswith(f" {NOTE} "), "hebrew_note")
            .when(has(DETAIL_MARKERS), "marked_detail")
            .when(~letters & (F.col("n_amounts") > 0) & (F.col("n_dates") == 0), "auxiliary_fragment")
            .when(letters & (F.col("n_cells") == 1) & F.col("in_description") & (F.col("n_dates") == 0) & (F.col("n_amounts") == 0), "description")
        )

    w = Window.partitionBy(*table).orderBy(*order)
    kinds = rows.withColumn("kind", let(line, chain)).withColumn("ordinal", F.row_number().over(w))
    above = owners(kinds, table, ["ordinal"], F.col("kind") == "primary", F.col("ordinal"), "owner")
    below = F.last(F.when(F.col("kind") == "primary", F.col("ordinal")), True).over(Window.partitionBy(*table).orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    leading = above.withColumn("__below", below)
    details = F.col("kind").isin("marked_detail", "foreign_conversion_block", "hebrew_note", "card_identifier_block")
    kind = F.when(F.col("owner").isNull() & details & F.col("__below").isNotNull(), "leading_detail").when(F.col("owner").isNull(), F.lit(None)).otherwise(F.col("kind"))
    owner = F.when(F.col("kind").isNotNull(), F.when(F.col("owner").isNull() & details, F.col("__below")).otherwise(F.col("owner")))
    known = leading.withColumns({"kind": kind, "owner": owner})
    # a block is a run of rows of its kind; rows beyond its bound are no part of it
    run = sessions(known, table, ["ordinal"], ~F.col("kind").eqNullSafe(F.lag("kind").over(Window.partitionBy(*table).orderBy("ordinal"))), "__run")
    place = F.row_number().over(Window.partitionBy(*table, "__run").orderBy("ordinal"))
    over = (F.col("kind") == "foreign_conversion_block") & (F.col("__place") > MOST_CONVERSION_ROWS)
    bounded = run.withColumn("__place", place)
    return bounded.withColumns({"owner": F.when(~F.coalesce(over, F.lit(False)), F.col("owner")), "kind": F.when(~F.coalesce(over, F.lit(False)), F.col("kind"))}).drop("__run", "__place", "__below")
