"""Joins that equality alone does not express.

Every one keeps an equality on the owning document or page, so that it plans as
a hash or merge join with residual conditions, never as a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def band_join(items: DataFrame, bands: DataFrame, on: Sequence[str], value: Column, low: str = "low", high: str = "high", half_open: bool = False) -> DataFrame:
    """Items with each band that holds their value (J4); ``half_open`` leaves the upper bound to the next band."""
    inside = (F.col(low) <= value) & ((value < F.col(high)) if half_open else (value <= F.col(high)))
    return items.join(bands, list(on)).filter(inside)


def nearest(items: DataFrame, owners: DataFrame, on: Sequence[str], item_id: Sequence[str], distance: Column, order: Sequence[Column], eligible: Column | None = None) -> DataFrame:
    """Each item with its nearest eligible owner; ``order`` decides between equals."""
    pairs = items.join(owners, list(on))
    pairs = pairs if eligible is None else pairs.filter(eligible)
    place = F.row_number().over(Window.partitionBy(*item_id).orderBy(distance, *order))
    return pairs.withColumn("__place", place).filter("__place = 1").drop("__place")


def nearest_value(items: DataFrame, owners: DataFrame, on: Sequence[str], item_id: str, owner_id: str, value: str) -> DataFrame:
    """(on, item_id, owner_id): the owner of the nearest value, the smaller id of equally near ones (J6 on one axis).

    One sorted pass over items and owners together: the nearest is the last value up to the item's or the first beyond
    it, so no pairs are made, however many owners a key has.
    """
    own = owners.groupBy(*on, value).agg(F.min(owner_id).alias("__own"))
    both = items.select(*on, F.col(value).alias("__v"), F.col(item_id).alias("__item"), F.lit(None).cast(own.schema["__own"].dataType).alias("__own"))
    both = both.unionByName(own.select(*on, F.col(value).alias("__v"), F.lit(None).cast(items.schema[item_id].dataType).alias("__item"), "__own"))
    # the way back is its own order: a frame that ends at the last row is summed anew for each row
    up, down = (Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("__v", F.col("__own").isNull()), (F.desc("__v"), F.col("__own").isNull().desc())))
    found = F.when(F.col("__own").isNotNull(), F.struct("__v", "__own"))
    sides = both.withColumn("__low", F.last(found, True).over(up)).withColumn("__high", F.last(found, True).over(down))
    off = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.__v") - F.col("__v")).alias("off"), F.col(f"{side}.__own").alias("own")))
    near = sides.filter(F.col("__own").isNull()).withColumn("__near", F.least(off("__low"), off("__high"))).filter("__near is not null")
    return near.select(*on, F.col("__item").alias(item_id), F.col("__near.own").alias(owner_id))


def unique_best(pairs: DataFrame, item_id: Sequence[str], score: Column) -> DataFrame:
    """The pair of each item with the strictly largest score; tied items have none."""
    own = Window.partitionBy(*item_id)
    best = pairs.withColumn("__score", score).withColumn("__best", F.max("__score").over(own)).filter("__score = __best")
    return best.withColumn("__ties", F.count(F.lit(1)).over(own)).filter("__ties = 1").drop("__score", "__best", "__ties")


def between_marks(events: DataFrame, partition: Sequence[str], order: Sequence[str], is_mark: Column) -> DataFrame:
    """Events with ``section``: the number of marks before them, so those between two marks share one."""
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("section", F.coalesce(F.sum(is_mark.cast("long")).over(before), F.lit(0)))


def preceding(events: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column, eligible: Column, name: str) -> DataFrame:
    """Events with the value of the nearest eligible event strictly before them (J9, as-of join)."""
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(eligible, value), ignorenulls=True).over(before))


def mutually_unique(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs that are each other's only match."""
    pairs = left.join(right, list(on))
    n_left = F.count(F.lit(1)).over(Window.partitionBy(left_id))
    n_right = F.count(F.lit(1)).over(Window.partitionBy(right_id))
    return pairs.withColumn("__l", n_left).withColumn("__r", n_right).filter("__l = 1 and __r = 1").drop("__l", "__r")


def identity_gaps(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side (J2, U6); empty if the identities are equal."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(True))
    side = F.when(F.col("__r").isNull(), "left").otherwise("right")
    return a.join(b, list(keys), "full_outer").filter("__l is null or __r is null").select(*keys, side.alias("side"))


def pareto_front(df: DataFrame, group: Sequence[str], item_id: str, up: Sequence[str], down: Sequence[str] = ()) -> DataFrame:
    """Rows that no other row of the group dominates: as good on every axis and better on one.

    Two axes take one sorted pass over the distinct values of the first; more
    take an anti-join inside the group.
    """
    axes = [*((c, 1) for c in up), *((c, -1) for c in down)]
    scored = df.select(*df.columns, *((F.col(c) * sign).alias(f"__{i}") for i, (c, sign) in enumerate(axes)))
    names = [f"__{i}" for i in range(len(axes))]
    if len(axes) == 2:
        # on two axes one sorted pass decides: a row is dominated if a better first axis, or an equal one, has more on the second
        first = Window.partitionBy(*group, names[0])
        swept = scored.withColumn("__top", F.max(names[1]).over(first))
        above = swept.select(*group, names[0], names[1]).groupBy(*group, names[0]).agg(F.max(names[1]).alias("__m"))
        strict = Window.partitionBy(*group).orderBy(F.desc(names[0])).rowsBetween(Window.unboundedPreceding, -1)
        limits = above.withColumn("__limit", F.max("__m").over(strict)).select(*group, names[0], "__limit")
        kept = swept.join(limits, [*group, names[0]]).filter(F.col(names[1]) == F.col("__top")).filter(F.col("__limit").isNull() | (F.col(names[1]) > F.col("__limit")))
        return kept.select(*df.columns)
    other = scored.select(*(F.col(c).alias(f"__o{c}") for c in (*group, item_id)), *(F.col(n).alias(f"__o{n}") for n in names))
    as_good, better_one = F.lit(True), F.lit(False)
    for n in names:
        as_good, better_one = as_good & (F.col(f"__o{n}") >= F.col(n)), better_one | (F.col(f"__o{n}") > F.col(n))
    same = F.lit(True)
    for c in group:
        same = same & (F.col(c) == F.col(f"__o{c}"))
    return scored.join(other, same & as_good & better_one, "left_anti").select(*df.columns)


def fuse_words(primary: DataFrame, supplemental: DataFrame, page: Sequence[str]) -> DataFrame:
    """Primary words (page, ordinal, text, box, confidence), each replaced by the best overlapping supplemental word.

    A replacement overlaps by 0.7 of the smaller box, has two digits or more,
    and either more digits than a primary word that has some, or repairs one
    letter into a digit. Most digits, then confidence, then text.
    """
    digits = lambda c: F.when(c.rlike(r"^[^\p{L}]*\d[^\p{L}]*$"), F.regexp_count(c, F.lit(r"\d"))).otherwise(F.lit(0))
    chars = lambda c: F.split(c, "", -1)
    diffs = F.filter(F.arrays_zip(chars(F.col("text")).alias("p"), chars(F.col("s_text")).alias("q")), lambda d: d["p"] != d["q"])
    repair = (F.length("text") == F.length("s_text")) & (F.size(diffs) == 1) & F.get(diffs, F.lit(0))["p"].rlike(r"^\p{L}$") & F.get(diffs, F.lit(0))["q"].rlike(r"^\d$")
    candidate = supplemental.select(*page, F.col("text").alias("s_text"), F.col("box").alias("s_box"), F.col("confidence").alias("s_confidence")).filter(digits(F.col("s_text")) >= 2)
    pairs = primary.join(candidate, list(page)).filter(g.ios(F.col("box"), F.col("s_box")) >= 0.7)
    pairs = pairs.filter(((digits(F.col("text")) > 0) & (digits(F.col("s_text")) > digits(F.col("text")))) | repair)
    best = pairs.groupBy(*page, "ordinal").agg(F.max_by(F.struct("s_text", "s_box", "s_confidence"), F.struct(digits(F.col("s_text")), "s_confidence", "s_text")).alias("best"))
    joined = primary.join(best, [*page, "ordinal"], "left")
    pick = lambda new, old: F.coalesce(F.col(f"best.{new}"), F.col(old)).alias(old)
    return joined.select(*page, "ordinal", pick("s_text", "text"), pick("s_box", "box"), pick("s_confidence", "confidence"), F.col("best").isNotNull().alias("replaced"))
