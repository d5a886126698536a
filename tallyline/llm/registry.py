"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embeddings, licenses, linedup, mixing, neardup, secrets, sharding, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.array_join("removed", ",").alias("removed"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = urlfilter.with_fetch_date(_table(spark, sf_dir, "pages").select("page_id", "url"))
    judged = urlfilter.judge(pages, urlfilter.entry_table(spark))
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "valid_from")})


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hash")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # only these columns cross the exchange; the order key is of the text's and the id's hashes
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sharding.size_of(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = sharding.shard(narrow, text="text_hash", size=F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_linedup, op2_toxicity, op3_mixing, op4_urlfilter, op5_secrets, op6_licenses, op7_decontamination, op8_sharding, op9_minhash, op10_embeddings)}


def oracle_sql() -> dict[str, str]:
    return {"op4_urlfilter": urlfilter.oracle_sql()}
