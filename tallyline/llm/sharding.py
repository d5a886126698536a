"""Histogram sort: shards of equal bytes, cut on a global key order.

Rows are ordered by a 62-bit key whose upper 38 bits are a hash of the text and
whose lower 24 bits are a hash of ``doc_id``. Copies of a text are therefore
neighbours in the order, yet a text that a third of all rows share still has
16 million keys to be cut at.

The splitters are found by counting, not by sampling. Each round counts exact
bytes and rows in 256 cells below every prefix that still holds an unsettled
splitter (at most ``256 * splitters`` counts reach the driver), moves into the
cell that holds the splitter's target, and ends when every boundary is within
``tolerance`` of its target or the cell is a single key. The rows are exchanged
once, by piece, and numbered inside their piece; what the histogram counted
below a piece gives the number that its first row has in the shard.

Defined results: a null text has no bytes but its 8 of overhead; null ids are
hashed like any value; rows that repeat both text and id have one key and stay
together, in the order of a hash of all their columns; an empty table has no
rows; more shards than rows leave some empty. Columns of the input keep their
values, and their names but for ``shard`` and ``slot``, which become
``shard_input`` and ``slot_input``; working columns carry a prefix that no input
column has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import Durable
from .names import fresh, set_aside

KEY_BITS, TEXT_BITS, RADIX_BITS = 62, 38, 8
OVERHEAD = 8


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def order_key(text: Column, doc_id: Column) -> Column:
    upper = F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS)
    lower = F.shiftrightunsigned(F.xxhash64(doc_id), 64 - (KEY_BITS - TEXT_BITS))
    return F.shiftleft(upper, KEY_BITS - TEXT_BITS).bitwiseOR(lower)


@dataclass(frozen=True)
class Splitter:
    """Rows with a key of at least ``key`` lie above; the counts are of the rows below."""

    key: int
    bytes_below: int
    rows_below: int


def find_splitters(keys: DataFrame, key: str, size: str, parts: int, tolerance: float) -> tuple[list[Splitter], int]:
    """The ``parts - 1`` splitters of ``keys`` and the number of its rows.

    ``tolerance`` is a share of one part's bytes. Each round reads the narrow
    ``keys`` once; there are at most ``KEY_BITS / RADIX_BITS`` rounds.
    """
    total = keys.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    all_bytes, all_rows = int(total[0]), int(total[1])
    targets = [all_bytes * j / parts for j in range(1, parts)]
    slack = tolerance * all_bytes / parts
    settled: dict[int, Splitter] = {}
    # splitter -> (prefix, bytes below the prefix, rows below the prefix)
    open_ = {j: (0, 0, 0) for j in range(parts - 1)}
    depth = 0
    while open_ and depth < KEY_BITS:
        finer = min(KEY_BITS, depth + RADIX_BITS)
        within = keys if not depth else keys.filter(F.shiftright(key, KEY_BITS - depth).isin(sorted({p for p, _, _ in open_.values()})))
        counted = (
            within.groupBy(F.shiftright(key, KEY_BITS - finer).alias("cell"))
            .agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
            .collect()
        )
        cells: dict[int, list[tuple[int, int, int]]] = {}
        for cell, n_bytes, n_rows in sorted(tuple(r) for r in counted):
            cells.setdefault(cell >> (finer - depth), []).append((cell, n_bytes, n_rows))
        left = {}
        for j, (prefix, n_bytes, n_rows) in open_.items():
            for cell, more_bytes, more_rows in cells.get(prefix, []):
                if n_bytes + more_bytes < targets[j]:
                    n_bytes, n_rows = n_bytes + more_bytes, n_rows + more_rows
                    continue
                below, above = targets[j] - n_bytes, n_bytes + more_bytes - targets[j]
                shift = KEY_BITS - finer
                if min(below, above) <= slack or finer == KEY_BITS:
                    settled[j] = Splitter(cell << shift, n_bytes, n_rows) if below <= above else Splitter((cell + 1) << shift, n_bytes + more_bytes, n_rows + more_rows)
                else:
                    left[j] = (cell, n_bytes, n_rows)
                break
            else:
                settled[j] = Splitter(1 << KEY_BITS, all_bytes, all_rows)
        open_, depth = left, finer
    return sorted(settled.values(), key=lambda s: s.key), all_rows


def _piece(key: Column, splitters: list[Splitter], low: int, high: int) -> Column:
    """Binary search as nested conditions: the number of splitters at or below the key."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key < F.lit(splitters[middle].key), _piece(key, splitters, low, middle)).otherwise(_piece(key, splitters, middle + 1, high))


def shard(df: DataFrame, n_shards: int = 24, pieces: int = 8, tolerance: float = 0.004, text: str = "text", doc_id: str = "doc_id", size: Column | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``pieces`` ranges of each shard are sorted and numbered apart, so that no
    task handles a whole shard. ``tolerance`` is a share of one piece's bytes.
    """
    df = set_aside(df, ("shard", "slot"))
    key, piece = fresh(df, "key"), fresh(df, "piece")
    scratch = Durable(df.sparkSession)
    size = size_of(F.col(text)) if size is None else size
    keys = scratch.keep(df.select(order_key(F.col(text), F.col(doc_id)).alias("k"), size.alias("n")))
    splitters, _ = find_splitters(keys, "k", "n", n_shards * pieces, tolerance)
    scratch.drop(keys)
    rows_below = [0, *(s.rows_below for s in splitters)]
    start = F.array(*(F.lit(rows_below[i] - rows_below[i - i % pieces]).cast("long") for i in range(n_shards * pieces)))
    keyed = df.withColumn(key, order_key(F.col(text), F.col(doc_id)))
    keyed = keyed.withColumn(piece, _piece(F.col(key), splitters, 0, len(splitters)))
    at = F.row_number().over(Window.partitionBy(piece).orderBy(key, doc_id, F.xxhash64(*df.columns)))
    return (
        keyed.withColumn("slot", at.cast("long") - 1 + F.element_at(start, F.col(piece) + 1))
        .withColumn("shard", F.floor(F.col(piece) / F.lit(pieces)).cast("int"))
        .drop(key, piece)
    )
