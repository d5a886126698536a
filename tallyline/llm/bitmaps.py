"""Bitmaps of hashes: a filter of bounded size that texts pass before anything of them is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

#: A bitmap has about SPARE bits a hash, but no fewer than 2**LEAST_BITS and no more than 2**MOST_BITS, 8 MB.
SPARE, LEAST_BITS, MOST_BITS = 16, 16, 26


def bits_for(hashes: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (SPARE * max(1, hashes) - 1).bit_length()))


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (tk.mix(hashes.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def build(hashes: DataFrame, count: int) -> bytes:
    """A bitmap of the one long column of ``hashes``, which has ``count`` rows; the driver gets no more than its bits."""
    bits = bits_for(count)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(_slots(np.asarray(batch.column(0)), bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(slots & 63)], names=["word", "bit"])

    found = hashes.mapInArrow(words_of, "word int, bit int")
    packed = found.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow()
    masks = np.zeros(1 << (bits - 6), "<i8")
    masks[np.asarray(packed["word"])] = np.asarray(packed["mask"])
    return masks.tobytes()


def has(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of the bitmap's; never false for one that is."""
    packed = np.frombuffer(bitmap, np.uint8)
    slots = _slots(hashes, len(packed).bit_length() + 2)
    return (packed[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).view(bool)
