"""Evaluation (K19-K22, A16-A28, J20, J24): scores of predictions against labels.

Predictions and labels meet on the row identity once; everything after that is
grouped counts over closed vocabularies, which a grid join fills with zeros.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import tie_curve

BINS = 10
EPSILON = 1e-15
RISK_TARGETS = (0.001, 0.005, 0.01)


def ratio(part: Column, whole: Column, digits: int = 9) -> Column:
    """0 where there is nothing to divide by."""
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), digits)


def confusion(df: DataFrame, gold: str, predicted: str, values: Sequence[str]) -> DataFrame:
    """Counts of every (gold, predicted) pair of the vocabulary, zeros kept."""
    grid = df.sparkSession.createDataFrame([(g, p) for g in values for p in values], "gold string, predicted string")
    counted = df.groupBy(F.col(gold).cast("string").alias("gold"), F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(counted, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every value of a confusion table."""
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    by_gold = cells.groupBy(F.col("gold").alias("value")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    by_predicted = cells.groupBy(F.col("predicted").alias("value")).agg(F.sum("n").alias("claimed"))
    return by_gold.join(by_predicted, "value").select(
        "value",
        ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"),
        "support",
    )


def calibration(df: DataFrame, confidence: str, exact: Column) -> DataFrame:
    """Ten equal bins, empty ones kept, with mean confidence and accuracy."""
    bins = df.sparkSession.range(BINS).select(F.col("id").alias("bin"))
    binned = df.withColumn("bin", F.least(F.floor(F.col(confidence) * BINS), F.lit(BINS - 1)).cast("long"))
    counted = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(confidence).cast("decimal(20,6)")).alias("c"), F.sum(exact.cast("long")).alias("right"))
    return F.broadcast(bins).join(counted, "bin", "left").select(
        "bin",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.round(F.col("c").cast("double") / F.col("n"), 9).alias("mean_confidence"),
        F.round(F.col("right") / F.col("n"), 9).alias("accuracy"),
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error: gaps weighted by the rows of their bins."""
    gap = F.abs(F.coalesce("accuracy", F.lit(0.0)) - F.coalesce("mean_confidence", F.lit(0.0)))
    return bins.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 7).alias("ece"), F.sum("n").alias("n"))


def probability_scores(df: DataFrame, group: Sequence[str], confidence: str, exact: Column) -> DataFrame:
    """Brier score and log loss, the probability bounded below."""
    y = exact.cast("int")
    p = F.when(exact, F.col(confidence)).otherwise(1 - F.col(confidence))
    return df.groupBy(*group).agg(F.round(F.avg((F.col(confidence) - y) * (F.col(confidence) - y)), 7).alias("brier"), F.round(F.avg(-F.ln(F.greatest(p, F.lit(EPSILON)))), 7).alias("log_loss"))


def risk_curve(df: DataFrame, confidence: str, exact: Column, total: Column, partition: Sequence[str] = ()) -> DataFrame:
    """Selective risk and coverage at each distinct confidence."""
    points = tie_curve(df, confidence, ~exact, total, partition)
    return points.select(
        *partition, "threshold", "accepted", ratio(F.col("accepted"), F.col("total"), 12).alias("coverage"), ratio(F.col("wrong"), F.col("accepted"), 12).alias("risk")
    )


def curve_summary(points: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Area under the step curve, and the coverage reached at each risk target."""
    w = Window.partitionBy(*partition).orderBy("coverage")
    steps = points.withColumn("step", (F.col("coverage") - F.coalesce(F.lag("coverage").over(w), F.lit(0.0))) * F.col("risk"))
    targets = [F.round(F.coalesce(F.max(F.when(F.col("risk") <= r, F.col("coverage"))), F.lit(0.0)), 9).alias(f"coverage_at_{i}") for i, r in enumerate(RISK_TARGETS)]
    return steps.groupBy(*partition).agg(F.round(F.sum("step"), 7).alias("area"), *targets)


def field_metrics(gold: DataFrame, predicted: DataFrame, row: Sequence[str], roles: Sequence[str], n_rows: Column) -> DataFrame:
    """Per role: eligible, exact, omitted and hallucinated fields of rows (row, role, value).

    A wrong value is a hallucination, and so is a value where no field is. The
    hallucination rate is by all rows, the others by eligible ones.
    """
    g = gold.select(*row, "role", F.col("value").alias("g"))
    p = predicted.select(*row, "role", F.col("value").alias("p"))
    joined = g.join(p, [*row, "role"], "full_outer")
    has_gold, has = F.col("g").isNotNull(), F.col("p").isNotNull()
    counted = joined.groupBy("role").agg(
        F.count_if(has_gold).alias("eligible"),
        F.count_if(has_gold & has & (F.col("g") == F.col("p"))).alias("exact"),
        F.count_if(has_gold & ~has).alias("omitted"),
        F.count_if(has & (~has_gold | (F.col("g") != F.col("p")))).alias("hallucinated"),
    )
    every = gold.sparkSession.createDataFrame([(r,) for r in roles], "role string")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.broadcast(every).join(counted, "role", "left").select(
        "role",
        *(zero(c).alias(c) for c in ("eligible", "exact", "omitted", "hallucinated")),
        ratio(zero("exact"), zero("eligible")).alias("exact_rate"),
        ratio(zero("hallucinated"), n_rows).alias("hallucination_rate"),
    )


def agreement(a: DataFrame, b: DataFrame, row: Sequence[str]) -> DataFrame:
    """Two reviewers' slots (row, role, value) side by side; a slot of one reviewer only disagrees."""
    x, y = a.select(*row, "role", F.col("value").alias("a")), b.select(*row, "role", F.col("value").alias("b"))
    slots = x.join(y, [*row, "role"], "full_outer")
    return slots.groupBy("role").agg(F.count(F.lit(1)).alias("slots"), F.count_if(F.col("a") == F.col("b")).alias("agreed")).withColumn("rate", ratio(F.col("agreed"), F.col("slots")))


def cascade(df: DataFrame, arms: Sequence[tuple[str, float]]) -> DataFrame:
    """The first arm that decides.

    Each arm has columns ``<arm>_decision``, ``<arm>_confidence`` and
    ``<arm>_valid``. One that doesn't accept, or accepts below its threshold,
    passes on; one without a confidence, or accepted without valid evidence,
    makes the row abstain.
    """
    arm, reason = F.lit("none"), F.lit("no_arm_accepted")
    for name, threshold in reversed(arms):
        accepts, confidence, valid = F.col(f"{name}_decision") == "ACCEPT", F.col(f"{name}_confidence"), F.col(f"{name}_valid")
        stop = accepts & (confidence.isNull() | ((confidence >= threshold) & ~valid))
        take = accepts & (confidence >= threshold) & valid
        arm = F.when(take, F.lit(name)).when(stop, F.lit("abstain")).otherwise(arm)
        why = F.when(confidence.isNull(), f"{name}_without_confidence").otherwise(f"{name}_not_grounded")
        reason = F.when(take, F.lit("accepted")).when(stop, why).otherwise(reason)
    return df.withColumn("arm", arm).withColumn("reason", reason)


def bootstrap(df: DataFrame, unit: str, effect: str, samples: int, seed: str) -> DataFrame:
    """Percentile interval of the mean effect of whole units drawn with replacement.

    ``df`` has one row per unit, dense ``place`` from 0. The draws of a sample
    are hashes of (seed, sample, draw), so the interval is the same in every
    run and engine; nothing but (sample, place) pairs is made.
    """
    n = df.agg(F.count(F.lit(1)).alias("n"))
    samples_df = df.sparkSession.range(samples).select(F.col("id").alias("sample"))
    draws = df.select(F.col("place").alias("draw")).join(F.broadcast(samples_df)).join(F.broadcast(n))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "sample", "draw")), 1, 8), 16, 10).cast("long"), F.col("n"))
    drawn = draws.select("sample", pick.alias("place")).join(df.select("place", effect), "place")
    means = drawn.groupBy("sample").agg((F.sum(F.col(effect).cast("decimal(20,6)")).cast("double") / F.count(F.lit(1))).alias("mean"))
    return means.agg(
        F.round(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY mean)"), 9).alias("low"),
        F.round(F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY mean)"), 9).alias("high"),
        F.count(F.lit(1)).alias("samples"),
    )


def choose_policy(candidates: DataFrame, policy: str, within: Column, order: list) -> DataFrame:
    """The first by ``order`` (then by name) of the candidates ``within`` the caps and the empty policy: a null name, and 0 in every other column."""
    empty = candidates.sparkSession.range(1).select(*(F.lit(None if c == policy else 0).cast(kind).alias(c) for c, kind in candidates.dtypes))
    return candidates.filter(within).unionByName(empty).orderBy(*order, policy).limit(1)
