"""Splits, folds and quota samples: greedy assignments in a stable hash order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
TARGETS = (("train", 3), ("validation", 1), ("test", 1))
OF = 5


def hash_order(purpose: str, seed: str, unit: Column) -> Column:
    """sha256 of purpose, seed and unit, with zero bytes between."""
    return F.sha2(F.concat(F.lit(f"{purpose}\0{seed}\0"), unit.cast("string")).cast("binary"), 256)


def atomic_units(documents: DataFrame, unit: str, stratum: str) -> DataFrame:
    """(unit, n, strata): sizes of units by stratum."""
    counted = documents.groupBy(F.col(unit).alias("unit"), F.col(stratum).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("unit").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("s", "n"))).alias("strata"))


def _in_order(units: DataFrame, purpose: str, seed: str) -> DataFrame:
    """One sorted stream: what a unit gets depends on all units before it. Only its narrow row passes, and no more than counts are held."""
    keyed = units.withColumn("__h", hash_order(purpose, seed, F.col("unit")))
    return keyed.repartition(1).sortWithinPartitions("__h", "unit").drop("__h")


def assign(units: DataFrame, seed: str) -> DataFrame:
    """(unit, split): each unit, in hash order, where the deviation from 3:1:1 stays least, over all and in each stratum."""
    totals = {r["s"]: int(r["t"]) for r in units.select(F.explode("strata").alias("x")).groupBy("x.s").agg(F.sum("x.n").alias("t")).collect()}
    everything = int(units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {name: 0 for name, _ in TARGETS}
        by_stratum = {s: dict(held) for s in totals}
        for batch in batches:
            out = []
            for n, strata in zip(batch["n"], batch["strata"], strict=True):
                own = {x["s"]: int(x["n"]) for x in strata}

                def deviation(choice, own=own, n=n):
                    off = 0
                    for name, share in TARGETS:
                        here = name == choice
                        off += abs(OF * (held[name] + here * int(n)) - share * everything)
                        off += sum(abs(OF * (by_stratum[s][name] + here * own.get(s, 0)) - share * total) for s, total in totals.items())
                    return off

                best = min((name for name, _ in TARGETS), key=deviation)
                held[best] += int(n)
                for s, k in own.items():
                    by_stratum[s][best] += k
                out.append(best)
            yield pd.DataFrame({"unit": batch["unit"], "split": out})

    kind = units.schema["unit"].dataType.simpleString()
    return _in_order(units, "split", seed).mapInPandas(run, f"unit {kind}, split string")


def folds(units: DataFrame, seed: str, count: int) -> DataFrame:
    """(unit, fold): each unit, in hash order, into the fold with the fewest documents, then the fewest of its strata."""
    if count < 2:
        raise ValueError("at least two folds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, strata_of = [0] * count, [{} for _ in range(count)]
        for batch in batches:
            out = []
            for n, strata in zip(batch["n"], batch["strata"], strict=True):
                own = {x["s"]: int(x["n"]) for x in strata}
                best = min(range(count), key=lambda i: (sizes[i], sum(strata_of[i].get(s, 0) * k for s, k in own.items()), i))
                sizes[best] += int(n)
                for s, k in own.items():
                    strata_of[best][s] = strata_of[best].get(s, 0) + k
                out.append(best)
            yield pd.DataFrame({"unit": batch["unit"], "fold": out})

    kind = units.schema["unit"].dataType.simpleString()
    return _in_order(units, "fold", seed).mapInPandas(run, f"unit {kind}, fold int")


def quota_sample(df: DataFrame, row: str, owner: str, seed: str, per_owner: int) -> DataFrame:
    """The first rows of each owner in hash order."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(hash_order("sample", seed, F.col(row)), row))
    return df.withColumn("__place", place).filter(F.col("__place") <= per_owner).drop("__place")


def staged_quota(df: DataFrame, row: str, owner: str, seed: str, stages: Sequence[tuple[str, int, Column]], per_owner: int) -> DataFrame:
    """Rows picked stage by stage, each with a quota and a condition, at most ``per_owner`` of an owner over all stages.

    A stage looks at the first ``quota`` eligible rows in hash order after
    those that earlier stages' owners rule out, so each needs only a bounded
    head of the table.
    """
    chosen = None
    keyed = df.withColumn("__h", hash_order("sample", seed, F.col(row)))
    for name, quota, condition in stages:
        rest = keyed.filter(condition)
        if chosen is not None:
            taken = chosen.groupBy(F.col(owner).alias("__o")).agg(F.count(F.lit(1)).alias("__t"))
            rest = rest.join(F.broadcast(chosen.select(F.col(row).alias("__r"))), F.col(row) == F.col("__r"), "left_anti")
            rest = rest.join(F.broadcast(taken), F.col(owner) == F.col("__o"), "left").withColumn("__left", per_owner - F.coalesce("__t", F.lit(0))).drop("__o", "__t")
        else:
            rest = rest.withColumn("__left", F.lit(per_owner))
        place = F.row_number().over(Window.partitionBy(owner).orderBy("__h", row))
        picked = rest.withColumn("__p", place).filter(F.col("__p") <= F.col("__left")).orderBy("__h", row).limit(quota)
        picked = picked.drop("__p", "__left").withColumn("stage", F.lit(name))
        # quotas are constants, so what is chosen stays bounded
        picked = df.sparkSession.createDataFrame(picked.collect(), picked.schema)
        chosen = picked if chosen is None else chosen.unionByName(picked)
    return chosen.drop("__h")
