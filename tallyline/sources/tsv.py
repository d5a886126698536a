"""Recognised words from tab-separated recogniser output (SRC3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import nfc


def words_of_lines(lines: DataFrame, column: str, dpi: int, origin: tuple[float, float], compose: bool = False) -> DataFrame:
    """Lines of twelve fields as words with boxes in points (72 per inch); lines that don't read as a word fall out."""
    if dpi <= 0:
        raise ValueError("dpi must be positive")
    f = F.split(F.col(column), "\t", 12)
    whole = lambda i: F.when(F.trim(F.get(f, F.lit(i))).rlike(r"^[+-]?\d+$"), F.trim(F.get(f, F.lit(i))).try_cast("long"))
    read = lines.withColumn("__n", F.size(f)).withColumns(
        {"__l": whole(6), "__t": whole(7), "__w": whole(8), "__h": whole(9), "__c": F.get(f, F.lit(10)).try_cast("double"), "__x": F.regexp_replace(F.get(f, F.lit(11)), r"(?U)^\s+|\s+$", "")}
    )
    good = read.filter("__n = 12 and __l is not null and __t is not null and __w > 0 and __h > 0 and __c >= 0 and __x != ''")
    scale = 72.0 / dpi
    x0, y0 = F.lit(origin[0]) + F.col("__l") * scale, F.lit(origin[1]) + F.col("__t") * scale
    box = g.box(x0, y0, F.lit(origin[0]) + (F.col("__l") + F.col("__w")) * scale, F.lit(origin[1]) + (F.col("__t") + F.col("__h")) * scale)
    text = nfc(F.col("__x")) if compose else F.col("__x")
    keep = [c for c in lines.columns if c != column]
    return good.select(*keep, text.alias("text"), box.alias("box"), F.lit("ocr").alias("source"), F.least(F.col("__c") / 100, F.lit(1.0)).alias("confidence"))
