"""Closures over links: components of groups and owner chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import Durable


def shared_groups(members: DataFrame, node: str, group: str, spark_tables: Durable | None = None) -> DataFrame:
    """(node, unit): nodes that share a group, directly or through others, have one unit, its smallest node.

    Smallest labels go to and fro between nodes and groups; each round is two
    minima that are combined before the shuffle, and doubling back through
    the unit's own label keeps the rounds logarithmic in a chain's length.
    """
    tables = spark_tables or Durable(members.sparkSession)
    links = tables.keep(members.select(F.col(node).alias("node"), F.col(group).alias("group")).distinct())
    labels = tables.keep(links.select("node", F.col("node").alias("unit")).distinct())
    while True:
        by_group = links.join(labels, "node").groupBy("group").agg(F.min("unit").alias("least"))
        reached = links.join(by_group, "group").groupBy("node").agg(F.min("least").alias("least"))
        # a node's unit is itself a node: follow it one step further
        onward = reached.withColumnRenamed("node", "unit").withColumnRenamed("least", "onward")
        moved = labels.join(reached, "node").join(onward, "unit", "left").select("node", "unit", F.least("least", F.coalesce("onward", "least")).alias("next"))
        moved = tables.keep(moved)
        changed = moved.filter("next != unit").limit(1).count()
        tables.drop(labels)
        labels = moved.select("node", F.col("next").alias("unit"))
        if not changed:
            return labels


def owner_chains(rows: DataFrame, row: str, owner: str, spark_tables: Durable | None = None) -> DataFrame:
    """(row, root, state): where each chain of owners ends, by pointer doubling.

    A null owner is a root. ``state`` is ``ok``, ``cycle`` for rows that never
    reach a root, or ``missing`` where an owner does not exist. Rounds end when
    one settles no row: a longer chain has rows at every distance below its own.
    """
    tables = spark_tables or Durable(rows.sparkSession)
    known = rows.select(F.col(row).alias("row"), F.col(owner).alias("next"))
    check = known.join(known.select(F.col("row").alias("next"), F.lit(True).alias("known")), "next", "left")
    state = check.select("row", F.when(F.col("next").isNull(), F.col("row")).otherwise(F.col("next")).alias("to"), F.col("next").isNull().alias("done"), (F.col("next").isNotNull() & F.col("known").isNull()).alias("lost"))
    state = tables.keep(state)
    open_, before_open = state.filter("not done and not lost").count(), None
    while open_ and open_ != before_open:
        ahead = state.select(F.col("row").alias("to"), F.col("to").alias("far"), F.col("done").alias("far_done"), F.col("lost").alias("far_lost"))
        moved = state.join(ahead, "to", "left").select(
            "row",
            F.when(F.col("done") | F.col("lost"), F.col("to")).otherwise(F.col("far")).alias("to"),
            (F.col("done") | F.coalesce("far_done", F.lit(False))).alias("done"),
            (F.col("lost") | F.coalesce("far_lost", F.lit(False))).alias("lost"),
        )
        before, state = state, tables.keep(moved)
        tables.drop(before)
        before_open, open_ = open_, state.filter("not done and not lost").count()
    result = F.when(F.col("lost"), "missing").when(F.col("done"), "ok").otherwise("cycle")
    return state.select("row", F.when(F.col("done") & ~F.col("lost"), F.col("to")).alias("root"), result.alias("state"))
