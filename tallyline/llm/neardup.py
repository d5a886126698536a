"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set holds the 64-bit hashes of its distinct word shingles. One
hash serves all bins of its signature: the upper bits name the bin, the least
hash of a bin is its value, and an empty bin copies the bin that a fixed
universal hash sequence of (bin, attempt) finds filled first (Shrivastava
2017). Documents of equal sets (a 128-bit digest and the set size) are one
class, represented by its smallest id, before anything is paired.

Classes that agree in a band share a bucket. A bucket with n classes gives
n - 1 candidate pairs, all with one centre; pairs are confirmed on full sets.
A bucket whose classes then lie in one component holds no further news. In any
other bucket a link between two members that both miss the centre could be
lost, so its members meet in tiles: blocks of bounded numbers of sets and of
shingles, the intersections of all sets of two blocks as one matrix product, and
as output only a spanning star of each tile's confirmed links, never a row per
pair. There is no cap, and nothing is dropped.

The number of rows in a band follows from the threshold: as many as keep the
chance to miss a pair exactly at it below MISS.

Defined results: a document without words has an empty set and is kept on its
own; fewer words than a shingle make one shingle of the whole sequence; a null
text is an empty one; rows that repeat an id share its component; rows with a
null id are known by a hash of their text, come after all ids (which are below
2**62), and have a null component where no row with an id is in it; of rows that
repeat id and text ``keep_one`` keeps one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import Durable
from . import hot
from . import textkernel as tk
from .components import components
from .embeddings import local_components
from .names import fresh

MOST_ATTEMPTS, TRIED = 1 << 14, 16
BANDS, MISS = 40, 1e-5
#: Shingles and sets of a block, and columns of a product; they bound a tile's memory.
BLOCK, BLOCK_SETS, COLUMNS = 100_000, 2048, 4096
#: Rows whose signatures are made at once, and cells of a table of ranks looked at once.
SIGNED, LOOKED = 2048, 1 << 22
#: Where the ids of rows without one begin.
UNNAMED = 1 << 62


def rows_of_band(percent: int, bands: int = BANDS) -> int:
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** bands <= MISS:
        rows += 1
    return rows


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a chunk, and where each text's set begins."""
    words = tk.Words(data, bounds, tk.byte_class("space"))
    hashes, at = words.grams(k)
    doc = words.doc[at]
    counts = np.diff(words.first)
    for short in range(1, k):  # the whole sequence is the one shingle
        docs = np.flatnonzero(counts == short)
        if len(docs):
            first = words.first[docs]
            with np.errstate(over="ignore"):
                whole = np.full(len(docs), short, np.uint64)
                for j in range(short):
                    whole = whole * np.uint64(tk.BASE) + words.hash[first + j]
            hashes, doc = np.concatenate([hashes, tk.mix(whole)]), np.concatenate([doc, docs])
    if len(hashes) and np.any(doc[1:] < doc[:-1]):
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    else:
        hashes = hashes.copy()
    edges = np.searchsorted(doc, np.arange(words.n_docs + 1))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        hashes[s:e].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(words.n_docs + 1))


def _sources(bins: int, attempt: int) -> np.ndarray:
    """The bin that each bin looks at on an attempt."""
    with np.errstate(over="ignore"):
        return (tk.mix(np.arange(bins, dtype=np.uint64) * np.uint64(MOST_ATTEMPTS) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)


@lru_cache(maxsize=4)
def _ranks(bins: int) -> np.ndarray:
    """[s, b]: the attempt on which bin b looks at bin s first."""
    ranks = np.full((bins, bins), MOST_ATTEMPTS + 1, np.int16)
    left, own = bins * bins, np.arange(bins)
    for attempt in range(1, MOST_ATTEMPTS + 1):
        source = _sources(bins, attempt)
        new = ranks[source, own] > MOST_ATTEMPTS
        ranks[source[new], own[new]] = attempt
        left -= int(new.sum())
        if not left:
            break
    return ranks


def _densify(sig: np.ndarray, filled: np.ndarray) -> None:
    """Fill the empty bins of rows that have a filled one, in place.

    Rows with many filled bins find one in a few attempts; for the others the filled bin of least rank is the one that
    their attempts would end at.
    """
    bins = sig.shape[1]
    n_filled = filled.sum(1)
    many = np.flatnonzero((n_filled > bins // 8) & (n_filled < bins))
    have, todo, part = filled[many], ~filled[many], sig[many]
    for attempt in range(1, TRIED + 1):
        source = _sources(bins, attempt)
        r, b = np.nonzero(todo & have[:, source])
        part[r, b] = part[r, source[b]]
        todo[r, b] = False
    sig[many] = part
    few = np.concatenate([np.flatnonzero((n_filled > 0) & (n_filled <= bins // 8)), many[todo.any(1)]])
    ranks = _ranks(bins)
    for k in np.unique(n_filled[few]):
        rows = few[n_filled[few] == k]
        for at in range(0, len(rows), max(1, LOOKED // (int(k) * bins))):
            own = rows[at : at + max(1, LOOKED // (int(k) * bins))]
            from_ = np.nonzero(filled[own])[1].reshape(len(own), k)
            best = np.take_along_axis(from_, ranks[from_].argmin(1), 1)
            values = np.take_along_axis(sig[own], best, 1)
            sig[own] = np.where(filled[own], sig[own], values)


def signatures(hashes: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """(texts, bins) densified one-permutation signatures; rows of empty sets are zero."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    # monotone in the hash, so the bins of a sorted set are contiguous and begin with their least value
    bin_ = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    lead = np.ones(len(hashes), bool)
    lead[1:] = (bin_[1:] != bin_[:-1]) | (doc[1:] != doc[:-1])
    sig = np.zeros((n, bins), np.uint64)
    filled = np.zeros((n, bins), bool)
    sig[doc[lead], bin_[lead]] = tk.mix(hashes[lead])
    filled[doc[lead], bin_[lead]] = True
    _densify(sig, filled)
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    n, bins = sig.shape
    grouped = sig.reshape(n, bands, bins // bands)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
        for j in range(bins // bands):
            acc = acc * np.uint64(tk.BASE) + grouped[:, :, j]
    return tk.mix(acc).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _set_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return total[first[1:]] - total[first[:-1]]


def _signature_batches(k: int, bands: int, rows: int):
    def all_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        parts = [np.zeros((0, bands), np.int64)]
        for at in range(0, len(first) - 1, SIGNED):
            own = first[at : at + SIGNED + 1]
            parts.append(band_keys(signatures(hashes[own[0] : own[-1]], own - own[0], bands * rows), bands))
        return np.concatenate(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # doc_id, hash, text
            for start, end, data, bounds in tk.chunks(batch):
                hashes, first = shingle_sets(data, bounds, k)
                n = np.diff(first)
                keys = all_keys(hashes, first)
                keys, at = keys[n > 0].reshape(-1), np.concatenate([[0], np.cumsum((n > 0) * bands)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        batch.column(1).slice(start, end - start),
                        pa.array(n.astype(np.int64)),
                        _signed(_set_sums(tk.mix(hashes), first)),
                        _signed(_set_sums(tk.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys)),
                    ],
                    names=["doc_id", "hash", "n", "d1", "d2", "bands"],
                )

    return run


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, bounds in tk.chunks(batch):
                hashes, first = shingle_sets(data, bounds, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), _signed(hashes))],
                    names=["doc_id", "hash", "shingles"],
                )

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union, as edges (u, v)."""
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        .withColumn("shared", shared)
        .filter(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared")))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
        .distinct()
    )


def tile_links(sets: list[np.ndarray], sides: np.ndarray, component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one tile whose sets reach the threshold and whose components differ.

    ``sides``: 0 and 1 for the two blocks of a tile, all 2 where a block meets itself.
    """
    size = np.array([len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = count[token] > 1  # a token of one set adds to no intersection
    column = np.cumsum(count > 1) - 1
    token, owner = column[token[shared]], owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    left = np.flatnonzero(sides != 1)
    right = left if sides[0] == 2 else np.flatnonzero(sides == 1)
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        a, b = np.searchsorted(token, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], token[a:b] - start] = 1
        common += part[left] @ part[right].T
    i, j = np.nonzero(100 * common >= percent * (size[left][:, None] + size[right][None] - common))
    a, b = left[i], right[j]
    new = component[a] != component[b]
    return a[new], b[new]


def _tile_function(percent: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, sides, component = (group[c].to_numpy() for c in ("id", "side", "component"))
        column = group["shingles"].combine_chunks() if isinstance(group["shingles"], pa.ChunkedArray) else group["shingles"]
        offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
        sets = [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        sides_ok = len(np.unique(sides)) == (1 if sides[0] == 2 else 2)
        u = v = np.zeros(0, np.int64)
        if len(sets) > 1 and sides_ok:
            a, b = tile_links(sets, sides, component, percent)
            order = np.argsort(ids, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(ids))
            label = ids[order][local_components(len(ids), rank[a], rank[b])][rank]
            u, v = ids[label != ids], label[label != ids]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _tiled(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (key, id, n, component) of open buckets with their sets, once for every tile of their bucket."""
    blocks = open_.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.greatest(F.sum("n") / BLOCK, F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    dealt = hot.join_counted(open_, blocks, "key", "members").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return (
        dealt.join(sets.withColumnRenamed("doc_id", "id"), "id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .withColumn("side", F.when(F.col("i") == F.col("j"), 2).otherwise((F.col("block") == F.col("j")).cast("int")))
        .select("key", "i", "j", "id", "side", "component", "shingles")
    )


def _judged(docs: DataFrame, k: int, percent: int, bands: int) -> DataFrame:
    """(doc_id, hash, n, component) of rows (doc_id, hash, text), none of whose ids is null."""
    scratch = Durable(docs.sparkSession)
    rows = rows_of_band(percent, bands)
    sig = scratch.keep(docs.mapInArrow(_signature_batches(k, bands, rows), "doc_id long, hash long, n long, d1 long, d2 long, bands array<long>"))
    classes = scratch.keep(sig.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.count(F.lit(1)).alias("rows")))
    classes = classes.select("d1", "d2", "n", F.col("first.doc_id").alias("rep"), F.col("first.hash").alias("rep_hash"))
    own = classes.select("d1", "d2", "n", F.col("rep").alias("doc_id"), F.col("rep_hash").alias("hash"))
    # rows that repeat id and text are one here
    reps = scratch.keep(sig.filter("n > 0").join(own, ["d1", "d2", "n", "doc_id", "hash"], "left_semi").dropDuplicates(["d1", "d2", "n"]).select(F.col("doc_id").alias("id"), "hash", "n", "bands"))
    keyed = reps.select("id", "hash", "n", F.explode("bands").alias("key"))
    centres = scratch.keep(keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    members = scratch.keep(hot.join_counted(keyed, centres, "key", "members"))
    scratch.drop(reps, centres)
    wanted = members.select(F.col("id").alias("doc_id"), "hash").distinct()
    sets = scratch.keep(docs.join(wanted, ["doc_id", "hash"], "left_semi").select("doc_id", "hash", "text").mapInArrow(_set_batches(k), "doc_id long, hash long, shingles array<long>"))
    if sig.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").limit(1).count():
        sets = scratch.keep(sets.dropDuplicates(["doc_id", "hash"]))
    sets = sets.drop("hash")
    # no set can reach the threshold against one that is too much larger
    sized = members.filter((F.col("id") != F.col("centre.id")) & (100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n")))
    pairs = sized.select(F.col("id").alias("a"), F.col("centre.id").alias("b")).distinct()
    labels = components(_confirm(pairs, sets, percent), scratch)
    scratch.release()
    labelled = members.filter("members > 2").select("key", "id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left")
    labelled = scratch.keep(labelled.withColumn("component", F.coalesce("component", "id")))
    spread = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"))
    news = scratch.keep(spread.filter("lo != hi").select("key", "members"))
    open_ = scratch.keep(hot.join_counted(labelled, news, "key", "members").drop("members"))
    found = _tiled(open_, sets).groupBy("key", "i", "j").applyInArrow(_tile_function(percent), "u long, v long")
    labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(found), scratch)
    scratch.drop(members, sets, labelled, news, open_)
    return (
        sig.select("doc_id", "hash", "n", "d1", "d2")
        .join(classes.drop("rep_hash"), ["d1", "d2", "n"], "left")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "hash", "n", F.coalesce("component", "rep", "doc_id").alias("component"))
    )


def _named(doc_id: Column, text: Column) -> Column:
    """The id, or where there is none a number from a hash of the text that comes after all ids."""
    return F.coalesce(doc_id.cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(UNNAMED))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept (it is the smallest id of its component)."""
    docs = docs.select(_named(F.col(doc_id), F.col(text)).alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    judged = _judged(docs, k, percent, bands)
    own = lambda c: F.when(F.col(c) < UNNAMED, F.col(c))
    return judged.select(own("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), own("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose near-duplicate group has a smaller id, and with one of the rows that repeat id and text."""
    d, h, row = (fresh(docs, x) for x in ("d", "h", "row"))
    keyed = docs.withColumns({d: _named(F.col(doc_id), F.col(text)), h: F.xxhash64(F.col(text))})
    scratch = Durable(docs.sparkSession)
    judged = scratch.keep(_judged(keyed.select(F.col(d).alias("doc_id"), F.col(h).alias("hash"), F.col(text).alias("text")), k, percent, bands))
    keys = lambda df: df.select(F.col("doc_id").alias(d), F.col("hash").alias(h)).distinct()
    left = keyed.join(keys(judged.filter("doc_id != component")), [d, h], "left_anti")
    repeated = judged.filter("n > 0 and doc_id = component").groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if repeated.limit(1).count():
        again = left.join(keys(repeated), [d, h], "left_semi")
        # of rows that differ in other columns, the one of the least hash
        again = again.groupBy(d, h).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row)).select(f"{row}.*")
        return left.join(keys(repeated), [d, h], "left_anti").select(*docs.columns).unionByName(again)
    return left.select(*docs.columns)
