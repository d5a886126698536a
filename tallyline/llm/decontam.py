"""Benchmark decontamination by greedy string tiling over shared-token seeds.

A seed is a run of SEED equal words at a place of a text and a place of a
benchmark item, found by a join of rolling (Karp-Rabin) hashes; an item of fewer
words has its whole sequence as the one seed. The texts' hashes first pass a
bitmap of bounded size made from the benchmark's, so that only candidates are
shuffled; the joins themselves are exact and take a benchmark of any size.

Which pairs of text and item are tiled: a text that holds enough of an item has
at least a certain number of its seeds' places. Half of that number, each item's
most frequent places, are not looked up; of the others a text has to have the
other half. So a seed that most texts have makes no pairs where an item has
rarer ones, and a pair costs no more than counts until it has enough.
The seeds of a pair are brought together as runs along a diagonal, whatever
their number, and a pair whose runs are too short in sum is dropped.

Tiling repeatedly takes the longest run whose words are unmarked on both sides
and marks it; runs that touch marks are cut to their unmarked rests. An item
leaks into a text when marked words are at least ``coverage`` of the item, in
whatever order the text has them.

Defined results: null and empty texts and items match nothing; an item of fewer
than SEED words leaks where a text has them in a row; a run that a text repeats
counts once; rows that repeat id and text give one result; rows of one id with
different texts are told apart; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import Durable
from . import bitmaps
from . import textkernel as tk
from .names import fresh

SEED = 3
#: Leaking texts whose narrow keys are broadcast; more are shuffled.
MOST_BROADCAST = 200_000


def _item_batches(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # item_id, text
            for start, end, data, bounds in tk.chunks(batch):
                words = tk.Words(data, bounds, tk.byte_class("alnum"), fold_latin=True)
                size = np.diff(words.first)
                for span in range(1, seed + 1):
                    grams, at = words.grams(span)
                    doc = words.doc[at]
                    own = (size[doc] >= seed) if span == seed else (size[doc] == span)
                    grams, at, doc = grams[own], at[own], doc[own]
                    ids = batch.column(0).slice(start, end - start).cast(pa.int64()).take(pa.array(doc))
                    numbers = (np.full(len(at), span), at - words.first[doc], size[doc])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams.view(np.int64)), ids, *(pa.array(x.astype(np.int32)) for x in numbers)],
                        names=["gram", "item_id", "span", "place", "item_words"],
                    )

    return run


def _text_batches(spans: Sequence[int], bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # doc_id, hash, text
            for start, _, data, bounds in tk.chunks(batch):
                words = tk.Words(data, bounds, tk.byte_class("alnum"), fold_latin=True)
                for span in spans:
                    grams, at = words.grams(span)
                    hit = bitmaps.has(bitmap.value, grams)
                    grams, at = grams[hit], at[hit]
                    doc = words.doc[at]
                    rows = pa.array(doc + start)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(grams.view(np.int64)), pa.array((at - words.first[doc]).astype(np.int32))],
                        names=["doc_id", "hash", "gram", "position"],
                    )

    return run


def tile(places: np.ndarray, positions: np.ndarray, lengths: np.ndarray, item_words: int, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place, position, length) from the runs of one text and item; of equal lengths the earliest place, then position."""
    heap = [(-n, p, q) for n, p, q in zip(lengths.tolist(), places.tolist(), positions.tolist(), strict=True)]
    heapq.heapify(heap)
    begin = int(positions.min())
    used_places = np.zeros(item_words, bool)
    used_positions = np.zeros(int((positions + lengths).max()) - begin, bool)
    tiles, free_places = [], item_words
    while heap and free_places:
        n, place, position = heapq.heappop(heap)
        n, at = -n, position - begin
        used = used_places[place : place + n] | used_positions[at : at + n]
        if not used.any():
            tiles.append((place, position, n))
            used_places[place : place + n] = used_positions[at : at + n] = True
            free_places -= n
            continue
        # the rests between marks that are still long enough
        edges = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype(np.int8)))
        for i, j in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if j - i >= seed:
                heapq.heappush(heap, (i - j, place + i, position + i))
    return tiles


def _tile_batches(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # doc_id, hash, item_id, item_words, span, runs
            runs = batch.column(5)
            offsets, values = np.asarray(runs.offsets).astype(np.int64), runs.values
            place, position, length = (np.asarray(values.field(c)).astype(np.int64) for c in ("place", "position", "length"))
            found = []
            for row, (words, span) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                own = slice(offsets[row], offsets[row + 1])
                tiles = tile(place[own], position[own], length[own], words, span)
                matched = sum(n for _, _, n in tiles)
                if matched >= coverage * words:
                    found.append((row, matched, len(tiles), max(n for _, _, n in tiles), matched / words))
            rows, *figures = zip(*found, strict=True) if found else ([],) * 5
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:4]]
            made = [pa.array(x, t) for x, t in zip(figures, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*taken, *made], names=["doc_id", "hash", "item_id", "item_words", "matched", "tiles", "longest", "coverage"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df``, a table, to be broadcast if it has no more than MOST_BROADCAST narrow rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _pairs(seen: DataFrame, grams: DataFrame, seed: int, coverage: float, scratch: Durable) -> DataFrame:
    """(d, h, i) of texts that may hold ``coverage`` of an item.

    Marked words of that share take at least a third of their number (one in ``seed``) as places of seeds. Of those places
    at least half are outside the item's most frequent ones, half as many: a pair has to have that half among the others.
    A text's seeds lie in one partition, so pairs are counted before they are shuffled.
    """
    frequency = seen.groupBy("gram").agg(F.count(F.lit(1)).alias("frequency"))
    item = Window.partitionBy("item_id")
    least = F.greatest(F.lit(1), F.ceil(F.lit(coverage) * F.col("item_words") / F.col("span")))
    left_out = F.floor(least / 2)
    ranked = grams.join(frequency, "gram", "left").withColumns(
        {"rank": F.row_number().over(item.orderBy(F.coalesce("frequency", F.lit(0)), "place")), "places": F.count(F.lit(1)).over(item)}
    )
    rare = ranked.filter(F.col("frequency").isNotNull() & (F.col("rank") <= F.col("places") - left_out))
    probes = scratch.keep(rare.groupBy("gram", "item_id").agg(F.count(F.lit(1)).alias("places"), F.max(least - left_out).alias("least")))
    met = seen.join(_small(probes), "gram").groupBy("doc_id", "hash", "item_id").agg(F.sum("places").alias("places"), F.max("least").alias("least"))
    return met.filter("places >= least").select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), F.col("item_id").alias("i"))


def _runs(seeds: DataFrame) -> DataFrame:
    """(doc_id, hash, item_id, item_words, span, place, position, length) of the runs of seeds along diagonals, in words."""
    pair = ["doc_id", "hash", "item_id"]
    diagonal = F.col("position") - F.col("place")
    order = Window.partitionBy(*pair).orderBy("diagonal", "place")
    goes_on = (F.col("diagonal") == F.lag("diagonal").over(order)) & (F.col("place") - F.lag("place").over(order) <= 1)
    marked = seeds.withColumn("diagonal", diagonal).withColumn("opens", F.coalesce(~goes_on, F.lit(True)).cast("long"))
    numbered = marked.withColumn("run", F.sum("opens").over(order))
    made = numbered.groupBy(*pair, "item_words", "span", "run").agg(
        F.min("place").alias("place"), F.min("position").alias("position"), (F.max("place") - F.min("place") + F.max("span")).alias("length")
    )
    return made.drop("run")


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = 0.5) -> DataFrame:
    """One row per (text, item) that leaks: doc_id, hash (of the text), item_id, item_words, matched, tiles, longest, coverage."""
    spark = docs.sparkSession
    scratch = Durable(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    grams = scratch.keep(items.mapInArrow(_item_batches(seed), "gram long, item_id long, span int, place int, item_words int").distinct())
    spans = {r.span: r.n for r in grams.groupBy("span").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``seed``
    bitmap = spark.sparkContext.broadcast(bitmaps.build(grams.select("gram"), sum(spans.values())))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    seen = scratch.keep(texts.mapInArrow(_text_batches(sorted(spans), bitmap), "doc_id long, hash long, gram long, position int"))
    bitmap.unpersist()
    pairs = scratch.keep(_pairs(seen, grams, seed, coverage, scratch))
    wanted = pairs.join(grams, F.col("i") == F.col("item_id")).withColumnRenamed("gram", "g")
    own = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))
    same = own & (F.col("gram") == F.col("g"))
    asked = scratch.keep(pairs.select("d", "h").distinct())
    # rows that repeat id and text are one from here on
    seen = seen.join(_small(asked), own, "left_semi").distinct()
    seeds = seen.join(wanted, same).select("doc_id", "hash", "item_id", "item_words", "span", "place", "position")
    gathered = (
        _runs(seeds)
        .groupBy("doc_id", "hash", "item_id", "item_words", "span")
        .agg(F.sum("length").alias("reach"), F.collect_list(F.struct("place", "position", "length")).alias("runs"))
        .filter(F.col("reach") >= F.lit(coverage) * F.col("item_words"))
        .drop("reach")
    )
    return gathered.mapInArrow(_tile_batches(coverage), "doc_id long, hash long, item_id long, item_words int, matched long, tiles long, longest long, coverage double")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the texts that any item leaks into."""
    d, h, own = fresh(docs, "d"), fresh(docs, "h"), fresh(docs, "own")
    scratch = Durable(docs.sparkSession)
    bad = scratch.keep(leaks(docs, benchmark, **options).select(F.col("doc_id").alias(d), F.col("hash").alias(h)).distinct())
    if bad.count() <= MOST_BROADCAST:
        bad = F.broadcast(bad)
    keyed = docs.withColumn(own, F.xxhash64("text"))
    return keyed.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)), "left_anti").select(*docs.columns)
