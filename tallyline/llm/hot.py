"""Joins of many rows with one narrow row per key, where one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has over 1 / MOST of all rows, so no more than MOST keys can be; and none with at most LEAST rows is.
MOST, LEAST = 10_000, 1_000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows.join(counted, key)``, where ``counted`` has one row per key and its number of ``rows`` in column ``n``.

    Rows of hot keys meet a broadcast of at most MOST narrow rows where they are; the others are shuffled by key.
    Both frames are read again, so they should be tables or cheap.
    """
    total, most = counted.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    bound = max(LEAST, total // MOST)
    if most <= bound:
        return rows.join(counted, key)
    hot = F.broadcast(counted.filter(F.col(n) > bound))
    cold = counted.filter(F.col(n) <= bound)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
