"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

Model. A word's embedding is the sum of four rows of one hashed table: those of
the whole word and of its first 4, 5 and 7 bytes, so that an unseen inflection
still has its stem's rows. Filters of widths 1, 2 and 3 run over a text's
words; each filter's three largest activations (max pooling, kept three deep so
that one chance hit is told from several) feed a logistic output.

Training. A bounded sample of labelled rows (MOST_ROWS of each class in the
order of a hash of their ids, texts of up to MOST_BYTES) is fitted by one task
of an executor, so the driver has the model alone, whose size is fixed. All
weights start at random with a fixed seed and learn by Adam steps on minibatches
of both classes. Only rows whose ``crc32(doc_id as text) % 5`` is not 0 are used.

Calibration. The language of a text is guessed from its function words, never
read from a column. On rows with remainder 1, which the fit does not see, every
language with enough rows gets the threshold that separates best; others share
a global one. The score is the logistic function of the distance from it, so
0.5 is the threshold everywhere.

Scoring reads whole texts in Arrow batches and needs no shuffle. A long text is
read in overlapping pieces of about PIECE_BYTES, cut between words; each piece
adds its largest activations, of which a text keeps the largest.

Defined results: a null or empty text is scored as a text without words; rows
that repeat have equal scores; without labels of both classes every score is
0; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .names import fresh

PREFIXES = (0, 4, 5, 7)  # bytes; 0: the whole word
TABLE_BITS = 18
WIDTH, FILTERS, SPANS, DEEP = 12, 16, (1, 2, 3), 3
FOLDS = 5
MOST_ROWS, MOST_BYTES = 2000, 1 << 15
STEPS, BATCH = 240, 64
NOISE, BIAS, DROPPED = 0.001, 0.0, 0.3
START = np.float32(1e-4)
SCORED_WORDS = 1 << 14
PIECE_BYTES = 1 << 18

# fixed values: frequent function words
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with be this by from or an at not have",
    "de": "der die das und ist von zu den mit sich des ein eine dem nicht auf als auch für im",
    "fr": "le la les de des du et un une est que qui dans pour par sur avec au aux pas",
    "es": "el los las y que en un una por con para del se no su al lo como más",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass
class Model:
    table: np.ndarray
    kernels: list[np.ndarray]  # for each span: (span, WIDTH, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES), np.float32))
    constant: float | None = None

    def __getstate__(self) -> dict:
        """Only the rows of the table that are not zero travel."""
        rows = np.flatnonzero(self.table.any(1))
        return self.__dict__ | {"table": (self.table.shape, rows, self.table[rows])}

    def __setstate__(self, state: dict) -> None:
        shape, rows, values = state["table"]
        table = np.zeros(shape, np.float32)
        table[rows] = values
        self.__dict__ |= state | {"table": table}


def buckets(words: tk.Words) -> np.ndarray:
    """(features, words) rows of the hashed table."""
    found = []
    for salt, n in enumerate(PREFIXES):
        h = words.hash if not n else words.range_hash(words.start, np.minimum(words.end, words.start + n))
        with np.errstate(over="ignore"):
            found.append((tk.mix(h + np.uint64(salt)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
    return np.stack(found)


def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all function words, and (words, languages) whether a language has the word."""
    found = [tk.Words(*tk.texts(pa.array([line])), tk.byte_class("alnum"), fold_latin=True).hash for line in FUNCTION_WORDS.values()]
    known = np.unique(np.concatenate(found))
    return known, np.stack([np.isin(known, h) for h in found], axis=1).astype(float)


def function_words(words: tk.Words) -> np.ndarray:
    """(texts, languages) numbers of words that are function words of each language."""
    known, of = _function_hashes()
    place = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    at = np.flatnonzero(known[place] == words.hash)
    return np.stack([np.bincount(words.doc[at], of[place[at], i], words.n_docs) for i in range(len(FUNCTION_WORDS))], axis=1)


def _most(counts: np.ndarray) -> np.ndarray:
    return np.where(counts.max(1, initial=0) > 0, counts.argmax(1), len(FUNCTION_WORDS))


def languages(words: tk.Words) -> np.ndarray:
    """Index in LANGUAGES of every text: the most function words, the first of equals, ``other`` without any."""
    return _most(function_words(words))


def _embed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = table[rows[0]]
    for r in rows[1:]:
        x += table[r]
    return x


def _activations(model: Model, x: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(words, all filters) after ReLU; a filter that would run past its text's end is 0 there. ``last``: words left in the text."""
    n = len(x)
    out = np.zeros((n, len(SPANS) * FILTERS), np.float32)
    # all taps of all filters in one product, then summed along each filter
    taps = x @ np.concatenate([tap for kernel in model.kernels for tap in kernel], axis=1)
    at = 0
    for s, span in enumerate(SPANS):
        part = out[:, s * FILTERS : (s + 1) * FILTERS]
        for j in range(min(span, n)):
            part[: n - j] += taps[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
        at += span * FILTERS
        part += model.bias[s * FILTERS : (s + 1) * FILTERS]
        np.maximum(part, 0, out=part)
        if span > 1:
            part[last < span] = 0
    return out


def _largest(acts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What ``_pool`` gives as features, for scoring, which needs no places."""
    starts = first[:-1]
    n = acts.shape[1]
    out = np.zeros((len(starts), DEEP * n), np.float32)
    for d, (start, end) in enumerate(zip(starts.tolist(), first[1:].tolist(), strict=True)):
        own = acts[start:end]
        if end - start > DEEP:
            own = np.partition(own, end - start - DEEP, axis=0)[end - start - DEEP :]
        top = -np.sort(-own, axis=0)
        out[d, : top.size] = top.reshape(-1)
    return out


def _pool(acts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that have words: (texts, DEEP, filters) largest activations, and their word indexes."""
    sizes = np.diff(first)
    starts = first[:-1]
    top = np.zeros((len(starts), DEEP, acts.shape[1]), np.float32)
    where = np.full(top.shape, -1, np.int64)
    doc = np.repeat(np.arange(len(starts)), sizes)
    index = np.arange(len(acts))[:, None]
    left = acts.copy()
    for depth in range(DEEP):
        most = np.maximum.reduceat(left, starts, axis=0)
        top[:, depth] = np.maximum(most, 0)
        if not (most > 0).any():
            break
        at = np.where((left == most[doc]) & (left > 0), index, len(acts))
        at = np.minimum.reduceat(at, starts, axis=0)
        r, f = np.nonzero((at < len(acts)) & (most > 0))
        where[r, depth, f] = at[r, f]
        left[at[r, f], f] = -1
    return top, where


def _forward(model: Model, rows: np.ndarray, first: np.ndarray):
    """Logits of a minibatch of texts that all have words, and what the backward step needs."""
    x = _embed(model.table, rows)
    sizes = np.diff(first)
    last = np.repeat(first[1:], sizes) - np.arange(len(x))
    acts = _activations(model, x, last)
    top, where = _pool(acts, first)
    top = top.reshape(len(top), -1)
    return top @ model.out + model.shift, x, where, top


def features(model: Model, words: tk.Words) -> np.ndarray:
    """(texts, DEEP * filters) largest activations; zeros for a text without words. Long runs are cut at text ends."""
    out = np.zeros((words.n_docs, len(model.out)), np.float32)
    rows = buckets(words)
    have = np.flatnonzero(np.diff(words.first) > 0)
    i = 0
    while i < len(have):
        j = i + 1
        while j < len(have) and words.first[have[j] + 1] - words.first[have[i]] <= SCORED_WORDS:
            j += 1
        docs = have[i:j]
        start, end = words.first[docs[0]], words.first[docs[-1] + 1]
        first = np.append(words.first[docs], end) - start
        out[docs] = _largest(_activations(model, _embed(model.table, rows[:, start:end]), np.repeat(first[1:], np.diff(first)) - np.arange(end - start)), first)
        i = j
    return out


def _pieces(data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[tk.Words, bool]]:
    """The words of one text in pieces of about PIECE_BYTES, and whether more follow.

    A piece ends between words, and the next begins with its last words, as many as a filter can reach on from a word.
    """
    overlap = max(SPANS) - 1
    begin, reach = 0, PIECE_BYTES
    while True:
        end = min(begin + reach, len(data))
        if end < len(data):  # the rest of a word that the cut would go through
            gap = np.flatnonzero(~inside[data[end : end + PIECE_BYTES]])
            if not len(gap):
                reach += PIECE_BYTES
                continue
            end += int(gap[0])
        words = tk.Words(data[begin:end], np.array([0, end - begin]), inside, fold_latin=True)
        more = end < len(data)
        if more and len(words.hash) <= overlap:  # too few words to go on from
            reach += PIECE_BYTES
            continue
        yield words, more
        if not more:
            return
        begin, reach = begin + int(words.start[-overlap]), PIECE_BYTES


def _long_features(model: Model, data: np.ndarray) -> tuple[np.ndarray, int]:
    """``features`` and the language of one long text."""
    inside, best, counts = tk.byte_class("alnum"), np.zeros((1, len(model.out)), np.float32), 0
    for words, more in _pieces(data, inside):
        n = len(words.hash)
        # a language's words in the overlap count twice, which a text of this length doesn't notice
        counts = counts + function_words(words)
        if n:
            acts = _activations(model, _embed(model.table, buckets(words)), np.arange(n, 0, -1))
            if more:
                acts = acts[: n - (max(SPANS) - 1)]
            both = np.concatenate([best.reshape(DEEP, -1), acts])
            best = _largest(both, np.array([0, len(both)]))
    return best, int(_most(counts)[0])


class _Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.n, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, value, grad):
        self.n += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.99 * self.v + 0.01 * grad * grad
        return value - self.rate * (self.m / (1 - 0.9**self.n)) / (np.sqrt(self.v / (1 - 0.99**self.n)) + 1e-6)


def fit(texts: pa.Array, labels: np.ndarray, folds: np.ndarray, seed: int = 7, n_steps: int = STEPS) -> Model:
    """The model of labelled texts; rows of fold 1 calibrate the thresholds."""
    rows, lang = [], []
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for _, _, data, bounds in tk.chunks(batch):  # a few MB at a time: the arrays of a chunk are many times its text
        words = tk.Words(data, bounds, tk.byte_class("alnum"), fold_latin=True)
        found = buckets(words)
        rows += [found[:, words.first[d] : words.first[d + 1]].copy() for d in range(words.n_docs)]
        lang.append(languages(words))
    sizes = np.array([r.shape[1] for r in rows], np.int64)
    rng = np.random.default_rng(seed)
    train = [np.flatnonzero((labels == y) & (folds != 1) & (sizes > 0)) for y in (0, 1)]
    n_filters = len(SPANS) * FILTERS
    model = Model(
        table=rng.normal(0, NOISE, (1 << TABLE_BITS, WIDTH)).astype(np.float32),
        kernels=[rng.normal(0, 0.3, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS],
        bias=np.full(n_filters, BIAS, np.float32),
        out=np.full(DEEP * n_filters, 0.05, np.float32),
        shift=-1.0,
    )
    if min(len(t) for t in train) == 0:
        model.constant = 0.0
        return model
    steps = {"out": _Adam(model.out.shape, 0.02), "bias": _Adam(model.bias.shape, 0.01)} | {s: _Adam(k.shape, 0.01) for s, k in enumerate(model.kernels)}
    squares = np.full(1 << TABLE_BITS, START, np.float32)  # Adagrad of the table, a rate for each row
    for _ in range(n_steps):
        batch = np.concatenate([rng.choice(t, min(BATCH // 2, len(t)), replace=False) for t in train])
        # every word is left out of a step with a chance of DROPPED, so that no cue is learnt alone
        hashed = [rows[d][:, rng.random(sizes[d]) >= DROPPED] if sizes[d] > 8 else rows[d] for d in batch]
        first = np.concatenate([[0], np.cumsum([max(1, h.shape[1]) for h in hashed])])
        hashed = np.concatenate([h if h.shape[1] else rows[d][:, :1] for d, h in zip(batch, hashed, strict=True)], axis=1)
        z, x, where, top = _forward(model, hashed, first)
        error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)).astype(np.float32)
        deep = np.einsum("n,f->nf", error, model.out).reshape(len(batch), DEEP, n_filters)
        grads = {"out": top.T @ error + 1e-4 * model.out, "bias": np.zeros_like(model.bias)}
        at_rows, at_grads = [], []
        for s, span in enumerate(SPANS):
            own = slice(s * FILTERS, (s + 1) * FILTERS)
            d, k, f = np.nonzero(where[:, :, own] >= 0)
            place, g = where[:, :, own][d, k, f], deep[:, :, own][d, k, f]
            grads["bias"][own] = np.bincount(f, g, FILTERS)
            kernel_grad = np.zeros_like(model.kernels[s])
            for j in range(span):
                np.add.at(kernel_grad[j].T, f, x[place + j] * g[:, None])
                at_rows.append(place + j)
                at_grads.append(model.kernels[s][j][:, f].T * g[:, None])
            grads[s] = kernel_grad
        model.shift = float(model.shift - 0.5 * error.sum())
        model.out = steps["out"].step(model.out, grads["out"]).astype(np.float32)
        model.bias = steps["bias"].step(model.bias, grads["bias"]).astype(np.float32)
        for s in range(len(SPANS)):
            model.kernels[s] = steps[s].step(model.kernels[s], grads[s]).astype(np.float32)
        place, g = np.concatenate(at_rows), np.concatenate(at_grads)
        for feature in hashed:
            touched, inverse = np.unique(feature[place], return_inverse=True)
            grad = np.zeros((len(touched), WIDTH), np.float32)
            np.add.at(grad, inverse, g)
            squares[touched] += (grad * grad).mean(1)
            model.table[touched] -= 0.01 * grad / np.sqrt(squares[touched])[:, None]
    model.table[squares == START] = 0  # what no step has moved has no say
    _calibrate(model, rows, np.concatenate(lang), labels, folds)
    return model


def _best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap that gives the fewest errors; of equals the widest gap."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    gaps = np.concatenate([[1.0], np.diff(z), [1.0]])
    k = max(np.flatnonzero(errors == errors.min()), key=lambda i: gaps[i])
    return float(z[0] - 0.5 if k == 0 else z[-1] + 0.5 if k == len(z) else (z[k - 1] + z[k]) / 2)


def _calibrate(model: Model, rows: list[np.ndarray], lang: np.ndarray, labels: np.ndarray, folds: np.ndarray, least: int = 10) -> None:
    held = folds == 1
    enough = lambda at: min(np.bincount(labels[at], minlength=2)) >= least
    base = held if enough(held) else np.ones(len(labels), bool)
    z = np.full(len(rows), model.shift)
    for d in np.flatnonzero(base):
        n = rows[d].shape[1]
        if n:
            acts = _activations(model, _embed(model.table, rows[d]), np.arange(n, 0, -1))
            z[d] = (_largest(acts, np.array([0, n])) @ model.out + model.shift)[0]
    model.thresholds[:] = _best_threshold(z[base], labels[base])
    for i in range(len(LANGUAGES)):
        if enough(at := base & held & (lang == i)):
            model.thresholds[i] = _best_threshold(z[at], labels[at])


def train(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on at most MOST_ROWS labelled rows of each class; where labels of an id differ, the larger holds."""
    labels = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    labels = labels.groupBy("id").agg(F.max("y").alias("y")).withColumn("fold", remainder(F.col("id"))).filter("fold != 0")
    order = (F.xxhash64(F.col("id"), F.lit(1)), F.col("id"))
    chosen = labels.filter("y = 1").orderBy(*order).limit(MOST_ROWS).unionAll(labels.filter("y = 0").orderBy(*order).limit(MOST_ROWS))
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.octet_length("text") <= MOST_BYTES)
    # the sample is at most 2 * MOST_ROWS narrow rows; of several texts of an id the one of the least hash
    sample = docs.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by(F.struct("text", "y", "fold"), F.struct(F.xxhash64("text"), "text")).alias("r"))
    made = sample.select("id", "r.*").groupBy().applyInArrow(_fit_group, "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _fit_group(sample: pa.Table) -> pa.Table:
    """The pickled model of the whole sample, which is bounded."""
    sample = sample.combine_chunks().sort_by("id")
    model = fit(sample["text"].combine_chunks(), sample["y"].to_numpy().astype(np.int64), sample["fold"].to_numpy().astype(np.int64))
    return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})


def _score_batches(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for start, end, data, bounds in tk.chunks(batch, text):
                if end - start == 1 and len(data) > PIECE_BYTES:
                    top, own = _long_features(m, data)
                    lang = np.array([own])
                else:
                    words = tk.Words(data, bounds, tk.byte_class("alnum"), fold_latin=True)
                    top, lang = features(m, words), languages(words)
                if m.constant is None:
                    z = np.clip(top @ m.out + m.shift - m.thresholds[lang], -30, 30).astype(np.float64)
                    scores = 1 / (1 + np.exp(-z))
                else:
                    scores = np.full(end - start, m.constant)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores), pa.array([LANGUAGES[i] for i in lang])], names=[*part.schema.names, "#score", "#lang"]
                )

    return run


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", lang_out: str = "lang_guess") -> DataFrame:
    """``df`` with the score of every whole text and the language guessed from it."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    inner = [f"c{i}" for i in range(len(df.columns))]
    schema = ", ".join([*(f"`{n}` {t}" for n, (_, t) in zip(inner, df.dtypes, strict=True)), "score double, lang string"])
    renamed = df.toDF(*inner)
    scored = renamed.mapInArrow(_score_batches(shared, inner[df.columns.index(text)]), schema)
    return scored.toDF(*df.columns, out, lang_out)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    score_, lang = fresh(docs, "score"), fresh(docs, "lang")
    return score(docs, train(docs, labels), out=score_, lang_out=lang).filter(F.col(score_) < 0.5).select(*docs.columns)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_guess of every row."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "lang_guess",
    )
