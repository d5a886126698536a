r"""Line dedup by a deletion-neighbourhood join.

Lines (parts of a text between ``\n``) are compared as sequences of lower-cased
words. The edit bound is one deleted word on each side: two lines match when
they become equal after at most one word is taken from each, so when a word was
put in, left out, replaced or moved. A line has that bound where one word is at
most a fifth of it (a similarity of 0.8 or more, so from FROM_WORDS words on);
of a shorter line no word may be taken, and lines without words never match.

Equal lines are one class before anything is paired, known by its earliest
place. Of the three parts of a line, two taken words leave one untouched: the
first or the last at its place, or the middle, moved by one word where one word
is taken before it and the other behind it. Only classes that share such a part
with another class go on; each of these emits all its variants (itself and
every deletion) as hashed keys. The earliest class of each
key, a minimum that is combined before the shuffle, is the candidate of all
others of that key, so no pairs within a key are made however many lines share
it. The candidate is verified on the words themselves. A line stays if it is
the earliest of its class and no earlier line matches.

The two passes over the texts are joined by a bitmap of bounded size: the second
reads the words of those lines whose class may have a partner. Where one line or
one variant may hold a large share of all rows, the one narrow row that they
are to meet is broadcast to them instead of shuffling them to it.

Defined results: null and empty texts have no lines; places are ordered by
doc_id (nulls last), then line number; rows that repeat an id are one document,
whose lines keep if any copy's would; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import Durable
from . import bitmaps, hot
from . import textkernel as tk
from .names import fresh, set_aside

#: The least similarity of lines that match, and the number of words from which a line keeps it without one of them.
LEAST_SIMILARITY = 0.8
FROM_WORDS = round(1 / (1 - LEAST_SIMILARITY))
_U = np.uint64


class Sequences:
    """Hashes of any run of a flat list of word hashes."""

    def __init__(self, words: np.ndarray):
        up, self.down = tk._Powers.upto(len(words) + 2)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return tk.mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The runs with their word ``at`` taken out: what follows it moves down a place."""
        with np.errstate(over="ignore"):
            head = (self.sums[at] - self.sums[start]) * self.down[start]
            tail = (self.sums[end] - self.sums[at + 1]) * self.down[start] * self.down[1]
            return tk.mix(head + tail + (end - start - 1).astype(np.uint64))


def _lines(data: np.ndarray, bounds: np.ndarray):
    """(text, line number, first word, end word) of every line, and the words."""
    words = tk.Words(data, bounds, tk.byte_class("alnum"), fold_latin=True)
    breaks = np.flatnonzero(data == 0x0A)
    have = np.flatnonzero(np.diff(bounds) > 0)  # an empty text has no lines
    starts = np.union1d(bounds[have], breaks + 1)
    # the empty line after a text's last break shares its start with the next text and has no words to look at
    doc = np.searchsorted(bounds, starts, side="right") - 1
    starts, doc = starts[starts < len(data)], doc[starts < len(data)]
    number = np.arange(len(starts)) - np.searchsorted(starts, bounds[doc])
    first = np.searchsorted(words.start, starts)
    end = np.append(first[1:], len(words.hash))
    return doc, number, first, end, words


def _parts(seq: Sequences, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(lines, 6) hashes of parts; lines that match share one.

    The parts are those of the longer line of a pair, n words or one more than
    this line has. Of two lines of n words, the first or last third is the same
    in both, or the middle of one is the other's a word earlier; where one line
    is a word shorter, one word is taken and the first or last third is whole.
    """
    n = end - first
    keys = []
    for longer in (n, n + 1):
        t = longer // 3
        keys += [(longer, 0, first, first + t), (longer, 1, end - t, end)]
    t = n // 3
    keys += [(n, 2, first + t, end - t), (n, 2, first + t - 1, end - t - 1)]
    with np.errstate(over="ignore"):
        return np.stack([seq.run(a, b) ^ (longer * 3 + part).astype(np.uint64) * _U(0x9E3779B97F4A7C15) for longer, part, a, b in keys], 1).view(np.int64)


def _line_batches(from_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # doc_id, text
            for start, _, data, bounds in tk.chunks(batch):
                doc, number, first, end, words = _lines(data, bounds)
                some = end > first
                doc, number, first, end = doc[some], number[some], first[some], end[some]
                seq = Sequences(words.hash)
                h = seq.run(first, end).view(np.int64)
                long_ = end - first >= from_words
                at = np.concatenate([[0], np.cumsum(long_ * 6)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + start)),
                        pa.array(number.astype(np.int32)),
                        pa.array(h),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(_parts(seq, first[long_], end[long_]).reshape(-1))),
                    ],
                    names=["doc_id", "line", "h", "parts"],
                )

    return run


def _word_batches(bitmap):
    """(h, words) of the lines whose class is in the bitmap, once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in tk.chunks(batch):
                _, _, first, end, words = _lines(data, bounds)
                first, end = first[end > first], end[end > first]
                h = Sequences(words.hash).run(first, end).view(np.int64)
                rows = np.flatnonzero(bitmaps.has(bitmap.value, h))
                rows = rows[np.unique(h[rows], return_index=True)[1]]
                size = end[rows] - first[rows]
                flat = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(rows) else np.zeros(0, np.int64)
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[rows]), pa.ListArray.from_arrays(pa.array(at), pa.array(words.hash[flat].view(np.int64)))], names=["h", "words"]
                )

    return run


def _variant_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h): each class's own hash and those of all its deletions."""
    for batch in batches:  # h, words
        column = batch.column(1)
        offsets = np.asarray(column.offsets).astype(np.int64)
        flat = np.asarray(column.values)[offsets[0] : offsets[-1]].view(np.uint64)
        first, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        h = np.asarray(batch.column(0))
        seq = Sequences(flat)
        line = np.repeat(np.arange(len(h)), end - first)
        keys = seq.without(first[line], end[line], np.arange(len(flat)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([seq.run(first, end), keys]).view(np.int64)), pa.array(np.concatenate([h, h[line]]))], names=["key", "h"]
        )


def matches(a: list[int], b: list[int]) -> bool:
    """Equal after at most one word is taken from each."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if not x or not y:
        return len(x) + len(y) <= 1
    return x[1:] == y[:-1] or x[:-1] == y[1:] or len(x) == len(y) == 1


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:  # h, earlier, words, other
        good = [matches(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["h", "earlier"])


def repeated_lines(docs: DataFrame, from_words: int = FROM_WORDS) -> DataFrame:
    """(doc_id, line, near, first_doc, first_line) of every line to remove; ``near``: no earlier line is equal, one matches."""
    spark = docs.sparkSession
    scratch = Durable(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = scratch.keep(texts.mapInArrow(_line_batches(from_words), "doc_id long, line int, h long, parts array<long>"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line")
    classes = scratch.keep(lines.groupBy("h").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"), F.any_value("parts").alias("parts")))
    part = classes.select("h", F.explode(F.array_distinct("parts")).alias("part"))
    shared = part.groupBy("part").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select("part")
    likely = scratch.keep(part.join(shared, "part", "left_semi").select("h").distinct())
    bitmap = spark.sparkContext.broadcast(bitmaps.build(likely, likely.count()))
    sequences = scratch.keep(
        texts.mapInArrow(_word_batches(bitmap), "h long, words array<long>")
        .join(likely, "h", "left_semi").groupBy("h").agg(F.any_value("words").alias("words"))
    )
    placed = scratch.keep(sequences.mapInArrow(_variant_batches, "key long, h long").distinct().join(classes.select("h", "place"), "h"))
    least = scratch.keep(placed.groupBy("key").agg(F.min(F.struct("place", "h")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    found = hot.join_counted(placed, least, "key").filter("h != least.h").groupBy("h").agg(F.min("least").alias("least"))
    asked = (
        found.select("h", F.col("least.h").alias("earlier"))
        .join(sequences, "h")
        .join(sequences.select(F.col("h").alias("earlier"), F.col("words").alias("other")), "earlier")
        .select("h", "earlier", "words", "other")
    )
    near = asked.mapInArrow(_verify_batches, "h long, earlier long")
    near = near.join(classes.select(F.col("h").alias("earlier"), F.col("place").alias("near_place")), "earlier").select("h", "near_place")
    # only classes that repeat or match an earlier one have lines to remove
    verdicts = scratch.keep(classes.select("h", "place", "n").join(near, "h", "left").filter("n > 1 or near_place is not null"))
    removed = hot.join_counted(lines.select("doc_id", "line", "h"), verdicts, "h").withColumn("own", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line") == F.col("place"))
    first = F.coalesce("near_place", "place")
    result = scratch.keep(
        removed.filter("not own or near_place is not null").select(
            "doc_id", "line", F.col("own").alias("near"), first["doc_id"].alias("first_doc"), first["line"].alias("first_line")
        )
    )
    scratch.drop(lines, classes, likely, sequences, placed, least, verdicts)
    return result


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``, and ``n_lines``, ``n_removed``, ``n_near``, ``removed`` (line numbers from 0).

    Columns of the input that have these names are renamed to ``<name>_input``.
    """
    docs = set_aside(docs, ("n_lines", "n_removed", "n_near", "removed"))
    key, d = fresh(docs, "key"), fresh(docs, "d")
    gone = (
        repeated_lines(docs, **options)
        .groupBy(F.col("doc_id").alias(d))
        .agg(F.array_sort(F.collect_set("line")).alias("removed"), F.count_distinct(F.when(F.col("near"), F.col("line"))).alias("n_near"))
    )
    split = F.split("text", "\n", -1)
    lines = F.when(F.col("text").isNull() | (F.col("text") == ""), F.array().cast("array<string>")).otherwise(split)
    none = F.array().cast("array<int>")
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(d)), "left").withColumns({"removed": F.coalesce("removed", none), key: lines})
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(key) - 1), "removed"), lambda i: F.get(F.col(key), i))
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(c) for c in docs.columns),
        F.size(key).alias("n_lines"),
        F.size("removed").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        "removed",
    )
