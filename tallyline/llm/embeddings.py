"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Vectors are scaled to length 1 and quantised, ``x = s * q + e`` with int8 ``q``;
the length of ``e`` is kept with each vector. For two vectors the quantised
product is off by at most ``ex * (1 + ey) + ey * (1 + ex) + ex * ey``. Pairs
surely above the threshold are links, pairs surely below are none, and only the
pairs between are computed again in double precision from the vectors
themselves, which travel for those pairs alone. Products of int8 values are
whole numbers below 2**24 up to 1040 dimensions and are taken as float32 matrix
products; longer vectors use float64.

Which tiles meet: all of them, whatever the number of rows, so that no link is
missed and a pair's link never depends on what else the table holds. This costs
the square of the distinct vectors, and no bound on blocks helps there: vectors
at the threshold are 0.45 apart, and most others only about 1.4. Rows are split
by hash into blocks, and each pair of blocks is a tile, which is taken in strips
of TILE by TILE rows. A strip's products that one comparison in single precision
shows to be surely below the threshold go no further. A tile gives one row per
vector (its links there, and the smallest id of its component there), never a
row per pair, and exact copies of a vector are one class with a weight before
they meet.

Callers who accept missed links may ask for ``by_codes``; no size of a table
does. Then all rows are indexed in several tables of sign codes of fixed random
hyperplanes, and only rows that share a code meet. The number of bits follows
from the row count so that a code holds about BUCKET rows, the number of tables
from the chance that a pair exactly at the threshold agrees in a table, so that
it is missed with probability at most MISS. A pair that agrees in several tables
counts in the first of them only: codes are taken of the int8 values by planes of
whole numbers, so a tile finds the other tables' codes of those vectors that have
links in it, exactly and on the spot, and no row carries more than its own code.

Defined results: null, empty and zero vectors and those with null or non-finite
components link with nothing; vectors of different lengths link with nothing;
rows that repeat an id are one vector; rows with a null id are kept, without
links or a component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import Durable
from . import hot
from .components import components

BUCKET, TILE, MISS = 512, 1024, 0.005
#: Radians that rounding to int8 may add to a pair's angle, as far as the number of tables goes.
ROUNDING = 0.02
#: Blocks of a place: of TILE rows each up to SPREAD blocks, then of more, up to WHOLE rows and BLOCK_BYTES of int8 values.
SPREAD, WHOLE, BLOCK_BYTES = 16, 16_384, 1 << 23
EXACT_DIMS = 1040


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a code and number of tables, where rows meet by codes."""
    bits = max(1, round(math.log2(max(2, rows / BUCKET))))
    agree = (1 - (math.acos(threshold) + ROUNDING) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree)))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and lengths of the errors (rounded up a little) of rows of length 1."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, error


@lru_cache(maxsize=512)
def planes(dims: int, bits: int, table: int) -> np.ndarray:
    """Hyperplanes of whole numbers, whose products with int8 values are exact in whatever order they are summed."""
    return np.rint(np.random.default_rng([dims, bits, table]).standard_normal((dims, bits)) * 64)


def codes_of(q: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) sign codes of int8 rows; those of the first tables don't depend on how many follow."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    x = q.astype(np.float64)
    return np.stack([(x @ planes(q.shape[1], bits, t) > 0) @ weights for t in range(tables)], 1)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values, row bounds and which rows are valid vectors."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = np.asarray(column.offsets)
    values = column.flatten() if column.null_count == 0 else column.values[offsets[0] : offsets[-1]]
    if column.null_count == 0:
        offsets = offsets - offsets[0]
    else:
        offsets = offsets - offsets[0]
    flat = values.to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    size = np.diff(offsets)
    ok = (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & np.asarray(column.is_valid())
    return flat, offsets, ok


def _index_batches(bits: int, tables: int):
    """vec_id, dims, codes, q, scale, error of every valid vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # vec_id, embedding
            flat, offsets, ok = _rows(batch.column(1))
            size = np.diff(offsets)
            for dims in np.unique(size[ok]):
                rows = np.flatnonzero(ok & (size == dims))
                x = flat[offsets[rows][:, None] + np.arange(dims)]
                # the largest component first, so that no square overflows or vanishes
                most = np.abs(x).max(1)
                rows, x, most = rows[most > 0], x[most > 0], most[most > 0]
                if not len(rows):
                    continue
                x = x / most[:, None]
                x /= np.linalg.norm(x, axis=1)[:, None]
                q, scale, error = quantise(x)
                codes = codes_of(q, bits, tables)
                step = np.arange(0, len(x) + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array(np.full(len(x), dims, np.int32)),
                        pa.ListArray.from_arrays(pa.array((step * tables).astype(np.int32)), pa.array(codes.reshape(-1))),
                        pa.array([r.tobytes() for r in q], pa.binary()),
                        pa.array(scale),
                        pa.array(error),
                    ],
                    names=["vec_id", "dims", "codes", "q", "scale", "error"],
                )

    return run


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over edges (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def strip_links(left, right, q, scale, error, table: int, bits: int, threshold: float):
    """Sure links and pairs to compute again, as index pairs, of rows ``left`` and ``right`` of a tile of a table.

    Where both are the same rows, each pair comes once (a < b).
    """
    kind = np.float32 if q.shape[1] <= EXACT_DIMS else np.float64
    product = q[left].astype(kind) @ q[right].astype(kind).T
    # the largest error on the right and 1e-6 for rounding only let more pairs through to the bounds of their own
    most = error[right].max()
    least = (threshold - error[left] * (1 + 2 * most) - most * (1 + error[left]) - 1e-6) / scale[left]
    near = product * scale[right].astype(kind) >= least.astype(kind)[:, None]
    rows = np.flatnonzero(near.any(1))
    i, j = np.nonzero(near[rows])
    i = rows[i]
    a, b = left[i], right[j]
    value = product[i, j].astype(np.float64) * (scale[a] * scale[b])
    slack = error[a] * (1 + 2 * error[b]) + error[b] * (1 + error[a]) + 1e-9
    keep = value + slack >= threshold
    if np.array_equal(left, right):
        keep &= a < b
    a, b, sure = a[keep], b[keep], (value - slack >= threshold)[keep]
    if table and len(a):  # a pair counts in the first table that it agrees in
        own, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        codes = codes_of(q[own], bits, table)
        x, y = at[: len(a)], at[len(a) :]
        new = np.ones(len(a), bool)
        for t in range(table):
            new &= codes[x, t] != codes[y, t]
        a, b, sure = a[new], b[new], sure[new]
    return a, b, sure


def _tile_function(bits: int, threshold: float, strip: int):
    def found(a: np.ndarray, b: np.ndarray, links: np.ndarray, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links), pa.array(np.full(len(a), sure))], names=["a", "b", "links", "sure"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        # by id, so that the smallest index of a component is its smallest id
        group = group.take(pa.array(np.argsort(group["id"].to_numpy())))
        ids, sides, weight = (group[c].to_numpy() for c in ("id", "side", "weight"))
        scale, error = group["scale"].to_numpy(), group["error"].to_numpy()
        q = np.frombuffer(b"".join(group["q"].to_pylist()), np.int8).reshape(len(ids), -1)
        # sides are 0 and 1 for the two blocks of a tile, all 2 where a block meets itself
        own = len(sides) > 0 and sides[0] == 2
        left = np.flatnonzero(sides != 1)
        right = left if own else np.flatnonzero(sides == 1)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for x in range(0, len(left), strip):
            for y in range(x if own else 0, len(right), strip):
                a, b, sure = strip_links(left[x : x + strip], right[y : y + strip], q, scale, error, key[1].as_py(), bits, threshold)
                if not sure.all():
                    yield found(ids[a[~sure]], ids[b[~sure]], np.zeros((~sure).sum(), np.int64), False)
                a, b = a[sure], b[sure]
                if len(a):
                    links += (np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))).astype(np.int64)
                    known = np.flatnonzero(label != np.arange(len(ids)))
                    label = local_components(len(ids), np.concatenate([a, known]), np.concatenate([b, label[known]]))
        have = np.flatnonzero(links > 0)
        yield found(ids[have], ids[label[have]], links[have], True)

    return run


def _exact_batches(threshold: float):
    """Pairs (a, b, wa, wb) whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a, b, wa, wb, va, vb
            flat_a, at_a, _ = _rows(batch.column(4))
            flat_b, at_b, _ = _rows(batch.column(5))
            size = np.diff(at_a)
            keep = np.zeros(len(size), bool)
            for dims in np.unique(size):
                rows = np.flatnonzero(size == dims)
                x, y = flat_a[at_a[rows][:, None] + np.arange(dims)], flat_b[at_b[rows][:, None] + np.arange(dims)]
                x, y = x / np.abs(x).max(1)[:, None], y / np.abs(y).max(1)[:, None]
                keep[rows] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= threshold
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:4]], names=["a", "b", "wa", "wb"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", by_codes: bool = False) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept (it is the smallest id of its component).

    All pairs meet, unless ``by_codes`` asks for the approximate step.
    """
    scratch = Durable(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    named = rows.filter("vec_id is not null and embedding is not null")
    digest = (F.xxhash64("embedding"), F.hash("embedding"), F.size("embedding"))
    keyed = named.select("vec_id", F.struct(*digest).alias("copy"), "embedding")
    # exact copies are one class, named by its smallest id
    classes = scratch.keep(keyed.groupBy("copy").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("weight"), F.min_by("embedding", "vec_id").alias("embedding")))
    bits, tables = plan(classes.count(), threshold) if by_codes else (0, 1)
    fields = "vec_id long, dims int, codes array<long>, q binary, scale double, error double"
    index = classes.select("id", "embedding").mapInArrow(_index_batches(bits, tables), fields)
    index = scratch.keep(index.withColumnRenamed("vec_id", "id").join(classes.select("id", "weight"), "id"))
    placed = index.select("id", "weight", "dims", "q", "scale", "error", F.posexplode("codes").alias("table", "code"))
    placed = placed.withColumn("place", F.struct("dims", "table", "code"))
    sizes = scratch.keep(placed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    most = F.least(F.lit(WHOLE), F.greatest(F.lit(TILE), F.floor(F.lit(BLOCK_BYTES) / F.col("dims"))))
    blocks = F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(SPREAD), F.ceil(F.col("n") / TILE)))
    dealt = hot.join_counted(placed, sizes, "place").withColumn("blocks", blocks.cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiled = (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .withColumn("side", F.when(F.col("i") == F.col("j"), 2).otherwise((F.col("block") == F.col("j")).cast("int")))
        .select("dims", "table", "code", "i", "j", "side", "id", "weight", "q", "scale", "error")
    )
    found = scratch.keep(tiled.groupBy("dims", "table", "code", "i", "j").applyInArrow(_tile_function(bits, threshold, TILE), "a long, b long, links long, sure boolean"))
    side = lambda c, w, v: classes.select(F.col("id").alias(c), F.col("weight").alias(w), F.col("embedding").alias(v))
    again = found.filter("not sure").select("a", "b").join(side("a", "wa", "va"), "a").join(side("b", "wb", "vb"), "b")
    exact = scratch.keep(again.select("a", "b", "wa", "wb", "va", "vb").mapInArrow(_exact_batches(threshold), "a long, b long, wa long, wb long"))
    edges = found.filter("sure").select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(exact.select("a", "b"))
    labels = components(edges, scratch)
    links = (
        found.filter("sure").select(F.col("a").alias("id"), "links")
        .unionAll(exact.select("a", "wb"))
        .unionAll(exact.select("b", "wa"))
        .groupBy("id").agg(F.sum("links").alias("links"))
    )
    indexed = index.select("id", "weight").join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    result = indexed.select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    by_copy = classes.select("copy", "id").join(result, "id")
    owned = rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull(), F.struct(*digest)).alias("copy"))
    joined = owned.join(by_copy, "copy", "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
