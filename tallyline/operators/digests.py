"""Order-sensitive and order-free digests of whole tables, run manifests and their drift (A5, A6, J23, F80, F84, SNK1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(columns: Sequence[str]) -> Column:
    """JSON of a row with its keys sorted and nothing between tokens; nulls are written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def fingerprint(*parts: Column) -> Column:
    """Content-free identity of a structure."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))).cast("binary"), 256)


def _joined(parts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, n, d): the digests of a key in order as one digest; a key has a bounded number."""
    gathered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "d"))).alias("ds"), F.sum("n").alias("n"))
    return gathered.select(*keys, "n", F.sha2(F.concat_ws(",", F.transform("ds", lambda x: x["d"])).cast("binary"), 256).alias("d"))


def ordered_digest(df: DataFrame, order: str, value: Column, group: Sequence[str] = (), block: int = 10_000) -> DataFrame:
    """A tree of sha256 digests in order: over rows of ``block`` consecutive order values, over ``block`` consecutive digests
    of those, and so on up to one; no more than ``block`` are ever gathered, however large the table.

    Order values are distinct in a group and at least 0.
    """
    least, highest = df.agg(F.min(order), F.max(order)).first()
    if least is not None and least < 0:
        raise ValueError("order values begin at 0")
    level = df.select(*group, F.col(order).alias("o"), F.sha2(value.cast("binary"), 256).alias("d"), F.lit(1).cast("long").alias("n"))
    blocks = highest or 0
    while True:
        blocks = blocks // block
        level = _joined(level.withColumn("b", F.floor(F.col("o") / block)), [*group, "b"], "o").withColumnRenamed("b", "o")
        if blocks < block:
            return _joined(level, list(group), "o").select(*group, "n", F.col("d").alias("digest"))


def membership_digest(df: DataFrame, member: Column, group: Sequence[str] = (), part: int = 100_000) -> DataFrame:
    """Multiset digest that no order changes: members are dealt by the first digits of their own hash, sorted inside a part, and
    the parts joined in order, 256 at a time. There are as many digits, two at least, as keep a part below ``part`` members
    that differ; equal members count, so that a part is bounded however often one repeats.
    """
    hashed = df.select(*group, F.sha2(member.cast("binary"), 256).alias("h")).groupBy(*group, "h").agg(F.count(F.lit(1)).alias("k"))
    most = hashed.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    digits = 2
    while most > part << 4 * digits:
        digits += 2
    line = F.when(F.col("k") == 1, F.col("h")).otherwise(F.concat_ws("x", "h", "k"))
    level = _joined(hashed.select(*group, F.substring("h", 1, digits).alias("b"), "h", line.alias("d"), F.col("k").alias("n")), [*group, "b"], "h")
    while digits > 2:
        digits -= 2
        level = _joined(level.withColumnRenamed("b", "o").withColumn("b", F.substring("o", 1, digits)), [*group, "b"], "o")
    return _joined(level, list(group), "b").select(*group, "n", F.col("d").alias("digest"))


def drift(current: DataFrame, baseline: DataFrame, key: Sequence[str], checks: Sequence[str], tolerance: dict[str, float] | None = None) -> DataFrame:
    """Differences of two manifests by key, in the order of ``checks``; a column with a tolerance may be worse by that share."""
    tolerance = tolerance or {}
    a = current.select(*key, *(F.col(c).alias(f"a_{c}") for c in checks), F.lit(True).alias("in_a"))
    b = baseline.select(*key, *(F.col(c).alias(f"b_{c}") for c in checks), F.lit(True).alias("in_b"))
    joined = a.join(b, list(key), "full_outer")

    def differs(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return x > y * (1 + tolerance[c]) if c in tolerance else ~x.eqNullSafe(y)

    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    reasons = F.array_compact(
        F.array(F.when(F.col("in_b").isNull(), "not_in_baseline"), F.when(F.col("in_a").isNull(), "missing"), *(F.when(both & differs(c), f"{c}_changed") for c in checks))
    )
    return joined.select(*key, F.concat_ws("|", reasons).alias("reasons"))
