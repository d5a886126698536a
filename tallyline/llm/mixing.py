"""Pivotal dependent rounding: whole copies of documents that meet word targets of their sources.

A source's target is its share of ``budget`` times all words, by weight; a
target stops at ``cap`` times the source's words and what is over goes to the
other sources by weight (water filling). The fraction ``target / words`` is
split into whole copies and a copy probability. Two fractional documents meet
and words (probability times size) move from one to the other, up or down at
random so that neither probability changes on average, until one of the two is
integral. The sum of words therefore never changes while documents settle.

The pairs form a reduction tree. Documents of a source and a size class (a
power of two) are dealt by hash into blocks of about half of ``block``; a block
is folded pair by pair in descending size and leaves one fractional residual
for the next level, until no class has more than ``block``. A last fold per
source goes through those bounded residuals in descending size and pairs each
with the pool of all smaller ones, whose probabilities give or take the words
in proportion; so a large document is never the one left over, and the last
and smallest takes the nearer whole copy. Only ``doc_id``, source and size
move; no block, source or class is gathered whole. Everything is a DataFrame
expression.

The sources themselves, one narrow row each, are ranked and filled in one task.

Defined results: a null text has no words; documents without words take
nothing; a null source is a source of its own, last in the order; a unit is what
has one source, id and text, so rows that repeat all three get the same copies
and rows without an id are told apart by their texts; an empty table gives no
rows; hashes of id and text drive all chances, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import Durable
from .names import fresh, set_aside

#: Any run but of the six white-space characters, named one by one: a class of single characters is a table look-up.
WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"
#: Sources whose narrow rows are broadcast; more are shuffled.
MOST_BROADCAST = 100_000
SETTLED = "array<struct<id:bigint,up:boolean>>"

#: Folds units (w, id, x), x their copy probability: two at a time, until each but the carried one is settled.
FOLD = f"""
aggregate(
  sort_array(units, false),
  named_struct('id', cast(null as bigint), 'w', 0D, 'x', 0D, 'done', cast(array() as {SETTLED})),
  (a, u) -> if(a.w = 0D, named_struct('id', u.id, 'w', u.w, 'x', u.x, 'done', a.done),
    element_at(transform(transform(
      array(named_struct(
        'rise', a.w * (1D - a.x), 'fall', a.w * a.x, 'u_rise', u.w * (1D - u.x), 'u_fall', u.w * u.x,
        'chance', pmod(xxhash64(a.id, u.id, {{seed}}), 1000000007L) / 1000000007D)),
      t -> named_struct(
        'up', t.chance * (least(t.rise, t.u_fall) + least(t.fall, t.u_rise)) < least(t.fall, t.u_rise) or t.fall = 0D and t.u_rise = 0D,
        'rise', t.rise, 'fall', t.fall, 'u_rise', t.u_rise, 'u_fall', t.u_fall)),
      t -> case
        when t.up and t.rise <= t.u_fall then named_struct('id', u.id, 'w', u.w, 'x', greatest(0D, u.x - t.rise / u.w), 'done', array_append(a.done, named_struct('id', a.id, 'up', true)))
        when t.up then named_struct('id', a.id, 'w', a.w, 'x', least(1D, a.x + t.u_fall / a.w), 'done', array_append(a.done, named_struct('id', u.id, 'up', false)))
        when t.fall <= t.u_rise then named_struct('id', u.id, 'w', u.w, 'x', least(1D, u.x + t.fall / u.w), 'done', array_append(a.done, named_struct('id', a.id, 'up', false)))
        else named_struct('id', a.id, 'w', a.w, 'x', greatest(0D, a.x - t.u_rise / a.w), 'done', array_append(a.done, named_struct('id', u.id, 'up', true)))
      end), 1)))
"""

#: The last fold. A unit's probability is now alpha * x + beta, for all that the pool below it gave or took; the pool has w words, m of them expected.
FINALE = f"""
aggregate(
  sort_array(units, false),
  named_struct(
    'alpha', 1D, 'beta', 0D, 'w', aggregate(units, 0D, (s, u) -> s + u.w), 'm', aggregate(units, 0D, (s, u) -> s + u.w * u.x),
    'done', cast(array() as {SETTLED})),
  (a, u) -> element_at(transform(transform(transform(
    array(least(1D, greatest(0D, a.alpha * u.x + a.beta))),
    x -> named_struct('x', x, 'w', greatest(0D, a.w - u.w), 'm', least(greatest(0D, a.w - u.w), greatest(0D, a.m - u.w * x)))),
    t -> named_struct(
      'w', t.w, 'm', t.m, 'rise', u.w * (1D - t.x), 'fall', u.w * t.x,
      'up', case
        when u.w * (1D - t.x) <= t.m and u.w * t.x <= t.w - t.m then pmod(xxhash64(u.id, {{seed}}), 1000000007L) / 1000000007D < t.x
        else greatest(0D, u.w * (1D - t.x) - t.m) < greatest(0D, u.w * t.x - t.w + t.m)
          or greatest(0D, u.w * (1D - t.x) - t.m) = greatest(0D, u.w * t.x - t.w + t.m) and t.x >= 0.5D end)),
    t -> if(t.up,
      named_struct(
        'alpha', a.alpha * if(t.m > 0D, greatest(0D, 1D - t.rise / t.m), 0D), 'beta', a.beta * if(t.m > 0D, greatest(0D, 1D - t.rise / t.m), 0D),
        'w', t.w, 'm', greatest(0D, t.m - t.rise), 'done', array_append(a.done, named_struct('id', u.id, 'up', true))),
      named_struct(
        'alpha', a.alpha * if(t.w > t.m, greatest(0D, 1D - t.fall / (t.w - t.m)), 0D),
        'beta', 1D - (1D - a.beta) * if(t.w > t.m, greatest(0D, 1D - t.fall / (t.w - t.m)), 0D),
        'w', t.w, 'm', least(t.w, t.m + t.fall), 'done', array_append(a.done, named_struct('id', u.id, 'up', false))))), 1)).done
"""


def unit_of(doc_id: Column, text: Column) -> Column:
    """A number for an id and a text, which no null leaves open."""
    return F.xxhash64(doc_id.cast("string"), text)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row per source meets in the windows here.

    The water level is that of the first source, by capacity per weight, that the words left over
    the capped ones before it cannot fill.
    """
    one = Window.partitionBy(F.lit(1))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights)).cast("int") + 1)
    by_fill = one.orderBy(F.col("capacity") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_source.withColumn("weight", weight)
        .withColumn("capacity", F.col("source_size") * F.lit(float(cap)))
        .withColumn("left", F.sum("source_size").over(one) * F.lit(float(budget)) - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("place", F.row_number().over(by_fill))
        .withColumn("first", F.min(F.when(F.col("capacity") >= F.col("level") * F.col("weight"), F.struct("place", "level"))).over(one))
        .select("source", "source_size", F.least(F.col("capacity"), F.coalesce(F.col("first.level") * F.col("weight"), F.col("capacity"))).alias("target"))
    )


def decide(sizes: DataFrame, goals: DataFrame, block: int, seed: int, scratch: Durable) -> DataFrame:
    """(source, id, copies) of every unit with words, from rows (source, id, size) and the sources' targets."""
    units = sizes.filter("size > 0").groupBy("source", "id").agg(F.sum("size").cast("double").alias("w"))
    fraction = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        units.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("fraction", fraction)
        .withColumn("whole", F.floor(F.col("fraction") + 1e-9).cast("int"))
        .select("source", "id", "w", "whole", F.greatest(F.col("fraction") - F.col("whole"), F.lit(0.0)).alias("x"))
    )
    units = scratch.keep(units.withColumn("class", F.floor(F.log2("w")).cast("int")))
    # a probability that is 0 but for rounding is settled at once
    done = [units.filter("x <= 1e-9").select("source", "id", F.lit(False).alias("up"))]
    rest = units.filter("x > 1e-9").select("source", "class", "id", "w", "x")
    fold = F.expr(FOLD.replace("{seed}", f"{seed}L"))
    level = 0
    while True:
        counts = scratch.keep(rest.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n")))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= block:
            break
        level += 1
        key = (F.col("source").eqNullSafe(F.col("s"))) & (F.col("class") == F.col("c"))
        dealt = (
            rest.join(counts.select(F.col("source").alias("s"), F.col("class").alias("c"), "n"), key)
            # every class goes on in blocks of half the bound on average, one block where it already fits
            .withColumn("block", F.when(F.col("n") <= block, F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "source", F.lit(level)), F.ceil(F.col("n") * 2 / block))))
            .groupBy("source", "class", "block")
            .agg(F.collect_list(F.struct("w", "id", "x")).alias("units"))
        )
        folded = scratch.keep(dealt.select("source", "class", fold.alias("f")))
        done.append(folded.select("source", F.inline("f.done")))
        rest = folded.select("source", "class", F.col("f.id").alias("id"), F.col("f.w").alias("w"), F.col("f.x").alias("x"))
    finale = F.expr(FINALE.replace("{seed}", f"{seed}L"))
    last = rest.groupBy("source").agg(F.collect_list(F.struct("w", "id", "x")).alias("units")).select("source", F.inline(finale))
    done.append(scratch.keep(last))
    ups = reduce(DataFrame.unionAll, done).select(F.col("source").alias("s"), F.col("id").alias("i"), "up")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("id") == F.col("i"))
    return units.join(ups, same).select("source", "id", (F.col("whole") + F.col("up").cast("int")).alias("copies"))


def _decided(df: DataFrame, names: tuple[str, str, str, str], weights: tuple[float, ...], budget: float, cap: float, block: int, seed: int, text: str, source: str, doc_id: str) -> DataFrame:
    """``df`` with four more columns: size, source_size, target and copies under the given names."""
    scratch = Durable(df.sparkSession)
    sizes = scratch.keep(df.select(F.col(source).alias("source"), unit_of(F.col(doc_id), F.col(text)).alias("id"), word_count(F.col(text)).alias("size")))
    goals = scratch.keep(targets(sizes, weights, budget, cap))
    if goals.count() <= MOST_BROADCAST:
        goals = F.broadcast(goals)
    copies = decide(sizes, goals, block, seed, scratch)
    size, source_size, target, n = names
    s, i, of, unit = (fresh(df, x) for x in ("s", "i", "of", "unit"))
    goals = goals.select(F.col("source").alias(s), F.col("source_size").alias(source_size), F.col("target").alias(target))
    copies = copies.select(F.col("source").alias(of), F.col("id").alias(i), F.col("copies").alias(n))
    return (
        df.withColumns({size: word_count(F.col(text)), unit: unit_of(F.col(doc_id), F.col(text))})
        .join(goals, F.col(source).eqNullSafe(F.col(s)), "left")
        .join(copies, F.col(source).eqNullSafe(F.col(of)) & (F.col(unit) == F.col(i)), "left")
        .withColumn(n, F.when(F.col(size) > 0, F.coalesce(F.col(n), F.lit(0))).otherwise(F.lit(0)))
        .select(*df.columns, *names)
    )


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, block: int = 32, seed: int = 20, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` (its source's), ``copies`` and ``taken`` (copies times size).

    Columns of the input that have these names are renamed to ``<name>_input``.
    """
    own = ("size", "source_size", "target", "copies")
    df = set_aside(df, (*own, "taken"))
    return _decided(df, own, weights, budget, cap, block, seed, text, source, doc_id).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def repeat(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, block: int = 32, seed: int = 20, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each row of ``df`` as many times as it has copies."""
    names = tuple(fresh(df, n) for n in ("size", "source_size", "target", "copies"))
    decided = _decided(df, names, weights, budget, cap, block, seed, text, source, doc_id)
    times = fresh(df, "times")
    return decided.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(names[3])))).select(*df.columns)
