"""How queries are declared: a function of the tables, and the same result as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable, str | None]] = {}


class Tables:
    """The parquet tables of a folder by name; only Spark's readers open them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def declare(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = (f, sql)
        return f

    return declare


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores before heavy expressions: a file of one row group is one task otherwise. Larger tables have splits enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (16 << 20) else df
