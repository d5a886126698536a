"""Edit distances of whole texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType


def distance(long_: np.ndarray, short: Sequence[int]) -> int:
    """Edit distance of two sequences of numbers: a column of the table is held as bits of two integers (Myers, Hyyrö), so a step of ``short`` costs a few passes over len(long_) bits."""
    n = len(long_)
    every = (1 << n) - 1
    at = {c: int.from_bytes(np.packbits(long_ == c, bitorder="little").tobytes(), "little") for c in set(short)}
    up, down = every, 0  # where the column grows or falls by one
    for c in short:
        same = at[c]
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (every & ~(diagonal | up)), up & diagonal
        right, left = (right << 1 | 1) & every, (left << 1) & every
        same |= down
        up, down = left | (every & ~(same | right)), right & same
    return len(short) + up.bit_count() - down.bit_count()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_distance(a: str, b: str) -> int:
    """Of code points."""
    a, b = sorted((a, b), key=len)
    return distance(_codes(b), _codes(a).tolist())


def word_distance(a: list[str], b: list[str]) -> int:
    a, b = sorted((a, b), key=len)
    known = {w: i for i, w in enumerate(dict.fromkeys(a))}
    return distance(np.fromiter((known.get(w, -1) for w in b), np.int64, len(b)), [known[w] for w in a])


def edit_counts(pairs: DataFrame, reference: str, hypothesis: str, keep: list[str], words: bool = False) -> DataFrame:
    """``keep`` with (edits, units) of every pair: units are the reference's characters or words between white space, at least 1. Beside a null text edits are null."""

    def count(r: str | None, h: str | None) -> tuple[int | None, int]:
        parts = [None if x is None else x.split() if words else x for x in (r, h)]
        edits = None if None in parts else (word_distance if words else text_distance)(*parts)
        return edits, max(1, len(parts[0] or ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # keep, reference, hypothesis
            found = [count(r.as_py(), h.as_py()) for r, h in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True)]
            counts = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *counts], names=[*keep, "edits", "units"])

    schema = StructType([*(pairs.schema[c] for c in keep), StructField("edits", LongType()), StructField("units", LongType())])
    return pairs.select(*keep, reference, hypothesis).mapInArrow(run, schema)
