"""File sources and sinks (SRC1, SRC5, SRC7-SRC9, SNK2, SNK3, SNK8, SNK9)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.digests import canonical_json

# fixed values: the order of the transaction file's columns
FEE_FIELDS = ("exchange_rate", "foreign_currency_fee_percentage", "gross_foreign_currency_fee", "foreign_currency_fee_discount", "net_foreign_currency_fee")
CSV_COLUMNS = (
    "source", "source_sha256", "statement_id", "group_id", "transaction_id", "transaction_date", "posting_date", "conversion_date", "description", "category", "kind",
    "billed_amount", "billing_currency", "original_amount", "original_currency", "installment_current", "installment_total", "status", "ambiguity_codes", "diagnostic_codes",
    "source_page", "source_bbox",
    "exchange_rate", "exchange_rate_source_page", "exchange_rate_source_bbox",
    "foreign_currency_fee_percentage", "foreign_currency_fee_percentage_source_page", "foreign_currency_fee_percentage_source_bbox",
    "gross_foreign_currency_fee", "gross_foreign_currency_fee_currency", "gross_foreign_currency_fee_source_page", "gross_foreign_currency_fee_source_bbox",
    "foreign_currency_fee_discount", "foreign_currency_fee_discount_currency", "foreign_currency_fee_discount_source_page", "foreign_currency_fee_discount_source_bbox",
    "net_foreign_currency_fee", "net_foreign_currency_fee_currency", "net_foreign_currency_fee_derivation", "net_foreign_currency_fee_source_page", "net_foreign_currency_fee_source_bbox",
    "merchant",
)


def scan(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]", exclude: Sequence[str] = (), with_content: bool = True) -> DataFrame:
    """Files under a folder (relative_path, length, sha256, source_ordinal), in the order of their relative paths.

    The ordinal needs one global order of the paths, which are narrow rows.
    """
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    at = F.length(F.regexp_extract("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", 0))
    files = files.withColumn("relative_path", F.expr("path").substr(at + 1, F.length("path")))
    for name in exclude:
        files = files.filter(~F.concat(F.lit("/"), "relative_path").contains(f"/{name}/"))
    digest = [F.sha2("content", 256).alias("sha256")] if with_content else []
    ordinal = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("relative_path")) - 1
    return files.select("path", "relative_path", "length", *digest).withColumn("source_ordinal", ordinal)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One canonical JSON object a line."""
    df.select(canonical_json(df.columns).alias("value")).write.text(path)


def read_pinned_json(spark: SparkSession, path: str, schema: StructType | str, sha256: str) -> DataFrame:
    """A JSON file whose bytes must have the digest; anything else is an error (SRC8)."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    if found is None or found[0] != sha256:
        raise ValueError("the file's digest differs from the pinned one")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_manifest(spark: SparkSession, path: str, schema: StructType | str, version: str) -> DataFrame:
    """A versioned manifest; another version is an error (SRC9)."""
    table = spark.read.schema(schema).option("multiLine", True).json(path)
    if table.filter(~F.col("version").eqNullSafe(F.lit(version))).limit(1).count():
        raise ValueError("unsupported manifest version")
    return table


def cache_misses(requests: DataFrame, cache: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """Requests with their content key that the cache table does not have (SRC5)."""
    keyed = requests.withColumn("cache_key", F.sha2(canonical_json(key_columns).cast("binary"), 256))
    return keyed.join(cache.select("cache_key").distinct(), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def csv_rows(statements: DataFrame, transactions: DataFrame) -> DataFrame:
    """The 42 columns of the transaction file; a statement without transactions has one row, what is missing is empty."""
    joined = statements.join(transactions, "statement_id", "left")
    have = set(joined.columns)
    return joined.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in CSV_COLUMNS))


def csv_field(value: Column) -> Column:
    """A field quoted where a comma, quote or line break needs it."""
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in rows.columns)).alias("line"))


def csv_bytes(lines: Iterable[str], header: Sequence[str] = CSV_COLUMNS) -> Iterable[bytes]:
    """The file's bytes, a line at a time: byte-order mark, header, CRLF."""
    yield b"\xef\xbb\xbf" + ",".join(header).encode() + b"\r\n"
    for line in lines:
        yield line.encode() + b"\r\n"


def _store(spark: SparkSession, path: str):
    """The file system that a path names, the path, and its context for renames that replace."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    files = target.getFileSystem(conf)
    return files, target, jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), conf)


def _written(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> str:
    """A file beside ``path`` with the chunks; nothing stays of one that breaks off."""
    beside = f"{path}.{uuid.uuid4().hex}"
    files, target, _ = _store(spark, beside)
    out = files.create(target, False)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
        out.close()
    except BaseException:
        out.close()
        files.delete(target, False)
        raise
    return beside


def _replace(spark: SparkSession, beside: str, path: str) -> None:
    files, target, context = _store(spark, path)
    option = spark._jvm.org.apache.hadoop.fs.Options
    how = spark.sparkContext._gateway.new_array(option.Rename, 1)
    how[0] = option.Rename.OVERWRITE
    source = files.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(beside))
    context.rename(source, files.makeQualified(target), how)


def publish(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """Write beside the target, in whatever store it is, and rename, so that a reader sees the old file or the whole new one (SNK8)."""
    _replace(spark, _written(spark, path, chunks), path)


def publish_pair(spark: SparkSession, first: tuple[str, Iterable[bytes]], second: tuple[str, Iterable[bytes]]) -> None:
    """Two files that change together: both are written whole before the first is replaced, and if the second then can't be, the
    first gets its old bytes back (SNK8)."""
    beside = _written(spark, *first)
    files, target, _ = _store(spark, first[0])
    drop = lambda path: files.delete(spark._jvm.org.apache.hadoop.fs.Path(path), False)
    try:
        other = _written(spark, *second)
    except BaseException:
        drop(beside)
        raise
    before = f"{first[0]}.{uuid.uuid4().hex}"
    had = files.exists(target)
    if had:
        copy = spark._jvm.org.apache.hadoop.fs
        copy.FileUtil.copy(files, target, files, copy.Path(before), False, spark._jsc.hadoopConfiguration())
    try:
        _replace(spark, beside, first[0])
        _replace(spark, other, second[0])
    except BaseException:
        drop(other)
        drop(beside)
        if had:
            _replace(spark, before, first[0])
        else:
            drop(first[0])
        raise
    if had:
        drop(before)


def quarantine_names(decisions: DataFrame, taken: DataFrame) -> DataFrame:
    """Decisions (relative_path, sha256) with a free name: the path, or one with the digest's head, or that with a number (SNK9)."""
    from pyspark.sql import Window

    suffix = F.regexp_extract("relative_path", r"(\.[^./]+)$", 1)
    stem = F.expr("substr(relative_path, 1, length(relative_path) - length(regexp_extract(relative_path, '([.][^./]+)$', 1)))")
    place = F.row_number().over(Window.partitionBy("relative_path").orderBy("sha256"))
    marked = decisions.join(taken.select("relative_path", F.lit(True).alias("exists")).distinct(), "relative_path", "left").withColumn("place", place)
    n = F.col("place") - F.when(F.col("exists"), 0).otherwise(1)
    hashed = F.concat(stem, F.lit("-"), F.substring("sha256", 1, 12))
    name = F.when(n == 0, F.col("relative_path")).when(n == 1, F.concat(hashed, suffix)).otherwise(F.concat(hashed, F.lit("-"), n.cast("string"), suffix))
    return marked.select("relative_path", "sha256", name.alias("quarantine_path"))


def results_bytes(statements: DataFrame, order: str, status: str, diagnostics: Sequence[str]) -> Iterable[bytes]:
    """The batch's JSON, a statement at a time in source order (SNK2); the driver holds one partition."""
    import json

    fields = [c for c in statements.columns if c != order]
    lines = statements.withColumn("__json", canonical_json(fields)).orderBy(order).select("__json")
    yield b'{"diagnostics":' + json.dumps(list(diagnostics), ensure_ascii=False, separators=(",", ":")).encode() + b',"statements":['
    for i, row in enumerate(lines.toLocalIterator()):
        yield b"," * bool(i) + row["__json"].encode()
    yield b'],"status":' + json.dumps(status).encode() + b"}\n"


def summary(statuses: DataFrame, status: str = "status") -> str:
    """Counts by status, the only thing that reaches a console (SNK11)."""
    return ", ".join(f"{r[0]}: {r[1]}" for r in statuses.groupBy(status).count().orderBy(status).collect())
