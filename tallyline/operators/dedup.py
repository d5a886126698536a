"""Greedy word dedup (J11): a fold over the words of a page in order, as what counts is overlap with those already kept."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_IOU, MIN_IOS = 0.7, 0.9


def _overlaps(a, b) -> bool:
    w = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])
    h = min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    shared = max(0.0, w) * max(0.0, h)
    of = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    union, smaller = of(a) + of(b) - shared, min(of(a), of(b))
    return (union > 0 and shared / union >= MIN_IOU) or (smaller > 0 and shared / smaller >= MIN_IOS)


def survivors(words: list[dict]) -> list[int]:
    """Indexes of kept words: surest first, digital before recognised, then by box and text."""
    corner = lambda b: (b["x0"], b["y0"], b["x1"], b["y1"])
    order = sorted(range(len(words)), key=lambda i: (-words[i]["confidence"], words[i]["source"] != "digital", corner(words[i]["box"]), words[i]["text"]))
    kept: dict[str, list[int]] = {}
    for i in order:
        same = kept.setdefault(words[i]["text"], [])
        if not any(_overlaps(words[j]["box"], words[i]["box"]) for j in same):
            same.append(i)
    return sorted(i for own in kept.values() for i in own)


def unique_words(words: DataFrame, page: Sequence[str]) -> DataFrame:
    """The surviving rows of words (page columns, text, box, confidence, source, ...).

    A page is a bounded unit. Only the few columns that decide go through
    Python; the rows come back by their place on the page.
    """
    indexed = words.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*(c for c in words.columns if c not in page)))).alias("words"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page_words: survivors(list(page_words)))

    keep = F.pandas_udf(run, "array<int>")
    slim = F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["box"].alias("box"), w["confidence"].alias("confidence"), w["source"].alias("source")))
    picked = indexed.withColumn("kept", keep(slim)).select(*page, F.explode(F.transform("kept", lambda i: F.get(F.col("words"), i))).alias("w"))
    return picked.select(*page, "w.*")
