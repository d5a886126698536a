"""Header bands, marker bands, logical cells and continuation rows of generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import bands as b
from .base import Tables, query, spread
from .structure import listed, picked

HEIGHT = 10


def _cell(text, x, y, width=40):
    return F.struct(text.alias("text"), g.box(F.lit(float(x)), F.lit(float(y)), F.lit(float(x + width)), F.lit(float(y + HEIGHT))).alias("box"), F.lit(int(y // 15)).alias("line"), F.lit(int(x // 60)).alias("cell"))


@query("""
WITH o AS (SELECT o_orderkey AS page, o_orderkey % 4 AS form FROM orders)
SELECT page, 0 AS cell, CASE WHEN form IN (0, 1) THEN 'Date of sale' ELSE 'Date' END AS text, CASE WHEN form IN (0, 1) THEN 1 ELSE 0 END AS n_fragments FROM o
UNION ALL SELECT page, 1, CASE WHEN form IN (0, 1) THEN 'Merchant name and place' ELSE 'Merchant' END, CASE form WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END FROM o
UNION ALL SELECT page, 2, 'Amount', 0 FROM o
""")
def merged_headers(t: Tables) -> DataFrame:
    """K3: headers over up to three lines; a third line that is too far, a date or an amount ends them."""
    form = F.col("o_orderkey") % 4
    word = lambda when, cell: F.when(when, cell)
    cells = F.array_compact(
        F.array(
            _cell(F.lit("Date"), 0, 0), _cell(F.lit("Merchant"), 60, 0), _cell(F.lit("Amount"), 120, 0),
            word(form <= 1, _cell(F.lit("of sale"), 0, 15)), word(form <= 1, _cell(F.lit("name"), 62, 15)), word(form <= 1, _cell(F.lit("and place"), 61, 30)),
            word(form == 0, _cell(F.lit("not this"), 60, 45)), word(form == 2, _cell(F.lit("far away"), 60, 60)), word(form == 3, _cell(F.lit("12/05/2024"), 0, 15)), word(form == 3, _cell(F.lit("shop"), 60, 15)),
        )
    )
    found = spread(t.orders.select("o_orderkey")).select(F.col("o_orderkey").alias("page"), F.explode(cells).alias("c")).select("page", "c.*")
    return b.merged_headers(found, ["page"]).select("page", "cell", "text", F.col("n_fragments").cast("int").alias("n_fragments"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
m AS (SELECT *, l_orderkey % 5 AS form, CASE l_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN l_linenumber = 1 WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS labelled FROM l),
c AS (SELECT *, count_if(labelled) OVER (PARTITION BY l_orderkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS of,
      min(l_linenumber % 2) OVER (PARTITION BY l_orderkey) = max(l_linenumber % 2) OVER (PARTITION BY l_orderkey) AS one_side FROM m),
d AS (SELECT *, labelled AND n >= 3 AND n * 3 >= of AND (form <> 2 OR one_side) AND (form <> 3 OR l_orderkey % 2 = 0) AS split, (l_linenumber + 10) || '/03/2024' AS day FROM c)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN split OR NOT labelled THEN day WHEN form = 2 AND l_linenumber % 2 = 0 THEN day || ' ▲' ELSE '▲ ' || day END AS date, CASE WHEN split THEN '▲' END AS marker FROM d
""")
def separated_markers(t: Tables) -> DataFrame:
    """K8: pictograms beside dates, in every row, in one row, on both sides, or out of line."""
    form, line = F.col("l_orderkey") % 5, F.col("l_linenumber")
    day = F.concat((line + 10).cast("string"), F.lit("/03/2024"))
    left, right = F.concat(F.lit("▲ "), day), F.concat(day, F.lit(" ▲"))
    written = F.when(form == 2, F.when(line % 2 == 0, right).otherwise(left)).when((form == 0) | ((form == 1) & (line == 1)) | (form == 3), left).otherwise(day)
    x = F.when((form == 3) & (F.col("l_orderkey") % 2 == 1), line * 20.0).otherwise(F.lit(3.0))
    zero = F.lit(0.0)
    cells = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.lit("DATE").alias("role"), written.alias("text"), g.box(x, zero, x + 60, zero + 10).alias("box")).distinct()
    return b.separated_markers(cells, ["l_orderkey"], "l_linenumber")


WORDS = ("abc def", "שלום עולם", "shop 12", "קפה abc")
#: What a line that shows the characters of WORDS from left to right, Hebrew words from right to left, says.
SAID = ("abc def", "שלום עולם", "shop 12", "abc קפה")
SHOWN = ("abc def", "םלוע םולש", "shop 12", "abc הפק")


@query(f"""
SELECT o_orderkey AS page, CASE WHEN o_orderkey % 7 = 0 THEN 'as recognised' ELSE {listed("o_orderkey", SAID)} END AS logical FROM orders
""")
def logical_cells(t: Tables) -> DataFrame:
    """The text of a cell from its glyphs; a cell without glyphs keeps its words."""
    page = F.col("o_orderkey")
    shown = picked(page, *SHOWN)
    at = F.posexplode(F.split(shown, "")).alias("i", "char")
    glyphs = t.orders.filter("o_orderkey % 7 > 0").select(page.alias("page"), at).filter("char != ' '")
    x = F.col("i") * 6.0
    glyphs = glyphs.select("page", "char", g.box(x, F.lit(1.0), x + 5, F.lit(9.0)).alias("box"))
    zero = F.lit(0.0)
    cells = t.orders.select(page.alias("page"), F.explode(F.array(F.struct(F.lit(0).alias("cell"), g.box(zero, zero, zero + 100, zero + 10).alias("box")), F.struct(F.lit(1).alias("cell"), g.box(zero, zero + 20, zero + 100, zero + 30).alias("box")))).alias("c"))
    cells = cells.select("page", "c.cell", "c.box", F.lit("as recognised").alias("text"))
    return b.logical_cells(glyphs, cells, ["page"], ["cell"]).filter("cell = 0").select("page", "logical")


#: Rows after one another, and the kind of each where it follows a transaction.
ROWS = (
    ("12/03/2024 shop 12.50", 3, 1, 1, False, "primary"),
    ("Card ID 12345", 2, 0, 0, False, "card_identifier_block"),
    ("exchange rate 3.65", 2, 0, 1, False, "foreign_conversion_block"),
    ("הערה: תשלום ראשון", 1, 0, 0, True, "hebrew_note"),
    ("surcharge 1.20", 2, 0, 1, False, "marked_detail"),
    ("4.20", 1, 0, 1, False, "auxiliary_fragment"),
    ("of Tel Aviv", 1, 0, 0, True, "description"),
    ("שער המרה 3.70", 2, 0, 1, False, "foreign_conversion_block"),
    ("12/03/2024", 1, 1, 0, False, None),
    ("card id 123", 2, 0, 0, False, None),
    ("conversion rate 3.1", 2, 0, 1, False, "foreign_conversion_block"),
)
_KINDS = tuple(r[5] or "" for r in ROWS)


@query(f"""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal, (event_id * event_id + user_id) % {len(ROWS)} AS form FROM events),
k AS (SELECT *, {listed("form", _KINDS)} AS k FROM r),
o AS (SELECT *, max(CASE WHEN k = 'primary' THEN ordinal END) OVER (PARTITION BY user_id ORDER BY ordinal) AS above,
        min(CASE WHEN k = 'primary' THEN ordinal END) OVER (PARTITION BY user_id ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM k),
n AS (SELECT *, CASE WHEN above IS NOT NULL THEN nullif(k, '') WHEN below IS NOT NULL AND k IN ('marked_detail', 'foreign_conversion_block', 'hebrew_note', 'card_identifier_block') THEN 'leading_detail' END AS kind FROM o),
g AS (SELECT *, ordinal - row_number() OVER (PARTITION BY user_id, kind ORDER BY ordinal) AS run FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind, run ORDER BY ordinal) AS place FROM g)
SELECT user_id, event_id, CASE WHEN kind = 'foreign_conversion_block' AND place > 4 THEN NULL ELSE kind END AS kind,
       CASE WHEN kind IS NULL OR (kind = 'foreign_conversion_block' AND place > 4) THEN NULL WHEN kind = 'leading_detail' THEN below ELSE above END AS owner
FROM p
""")
def continuation_kinds(t: Tables) -> DataFrame:
    """A user's events as rows of a table, and what the rows between transactions are."""
    form = F.pmod(F.col("event_id") * F.col("event_id") + F.col("user_id"), F.lit(len(ROWS)))
    shapes = F.element_at(F.array(*(F.struct(F.lit(r[0]).alias("text"), F.lit(r[1]).alias("n_cells"), F.lit(r[2]).alias("n_dates"), F.lit(r[3]).alias("n_amounts"), F.lit(r[4]).alias("in_description")) for r in ROWS)), (form + 1).cast("int"))
    rows = t.events.select("user_id", "event_id", shapes.alias("r")).select("user_id", "event_id", "r.*")
    return b.continuation_kinds(rows, ["user_id"], ["event_id"]).select("user_id", "event_id", "kind", F.when(F.col("kind").isNotNull(), F.col("owner")).cast("long").alias("owner"))
