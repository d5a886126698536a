"""Vectorised word hashing over Arrow string buffers.

The kernels look at the UTF-8 bytes of a whole batch at once: word boundaries
come from a byte class, and the hash of any byte range from prefix sums of
``byte * BASE**position`` modulo 2**64. No Python string is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 18
_U = np.uint64


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class _Powers:
    """BASE**i and BASE**-i for the longest chunk seen so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + (1 << 18))
            cls.up = _powers(size, BASE)
            cls.down = _powers(size, pow(BASE, -1, 1 << 64))
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def byte_class(spec: str) -> np.ndarray:
    """``space``: all but ASCII white space. ``alnum``: ASCII letters, digits and every non-ASCII byte."""
    table = np.zeros(256, bool)
    if spec == "space":
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif spec == "alnum":
        table[0x80:] = True
        for a, b in ("09", "AZ", "az"):
            table[ord(a) : ord(b) + 1] = True
    else:
        raise ValueError(f"unknown byte class {spec!r}")
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of some texts: byte ranges, hashes and the text each belongs to.

    ``start``/``end`` are byte offsets in the chunk, ``hash`` the mixed 64-bit
    hash of the lower-cased bytes, ``doc`` the index of the text, and
    ``first[d] : first[d + 1]`` the words of text ``d``.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray, fold_latin: bool = False):
        n = len(data)
        self.n_docs = len(bounds) - 1
        low = _LOWER[data]
        if fold_latin and n:
            after = np.zeros(n, bool)
            after[1:] = data[:-1] == 0xC3
            low[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
        inside = table[data]
        edge = np.empty(n + 1, bool)
        edge[0] = n > 0 and inside[0]
        edge[n] = n > 0 and inside[-1]
        edge[1:n] = inside[1:] != inside[:-1]
        cut = bounds[(bounds > 0) & (bounds < n)]
        both = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut
        flips = np.flatnonzero(edge)
        if len(both):  # a text ends in a word where the next begins with one
            both = np.unique(both)
            flips = np.sort(np.concatenate([flips, both, both]))
        self.start, self.end = flips[0::2], flips[1::2]
        up, down = _Powers.upto(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((low.astype(np.uint64) + _U(1)) * up[:n], out=sums[1:])
            self.sums, self.down = sums, down
            self.hash = self.range_hash(self.start, self.end)
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words within a text, and the index of their first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return chain(self.hash, k)[at], at


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive hashes."""
    n = len(hashes) - k + 1
    with np.errstate(over="ignore"):
        acc = np.full(n, k, np.uint64)
        for j in range(k):
            acc = acc * _U(BASE) + hashes[j : n + j]
    return mix(acc)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its rows; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about CHUNK_BYTES of text: (first row, end row, bytes, bounds). One text is never split."""
    data, bounds = texts(batch.column(batch.schema.get_field_index(column)))
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, side="right")) - 1
        end = min(rows, max(row + 1, end))
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end
