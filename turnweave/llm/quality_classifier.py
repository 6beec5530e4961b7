"""Quality scores by random indexing and a small network.

Every word has an index vector: a few entries of +1 and -1 at places that its hash decides. A word's meaning is the sum of
the index vectors of the words around it, over all occurrences in all texts. Words share BUCKETS vectors by hash, so the
table of vectors has one size whatever the corpus; words that share one add up, as index vectors do anyway. Marks (runs of
anything but letters and digits) are words too, and a word of capitals or with one in front says so by a mark of its own,
so form counts as well as content.

A document pools its words' unit vectors: mean and spread, besides its index vectors' mean and how long and varied it is.
A two-layer network in numpy learns labels from pooled vectors; a temperature, fitted to labelled rows that the network
has not learned from, calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm._session import bounded, cut, prepare
from turnweave.llm._words import mix, span_hash

#: The fit's bound: labelled rows that the network learns from.
MAX_EXAMPLES = 20_000
#: Vectors that words share, their length, and the entries of an index vector that are not 0.
BUCKETS, DIMENSIONS, ENTRIES = 1 << 15, 32, 4
#: Words to each side that are a word's surroundings.
WINDOW = 2
#: Parts of a unit that vectors are rounded to; sums of whole parts are exact, in whatever order.
UNIT = 1 << 10
#: The network: hidden units, passes over the examples, examples of a step, step size, decay; every so many examples one
#: is kept for the temperature.
HIDDEN, EPOCHS, STEP, RATE, DECAY, KEEP_OUT = 32, 60, 64, 0.01, 1e-3, 5
THRESHOLD = 0.5
#: Decimals of a score; the last bits of a product of matrices depend on the number of rows.
DECIMALS = 9
#: Bytes looked at in one go; words do not cross rows.
_PART = 1 << 18

_U = np.uint64
_SPACE, _MARK, _LETTER = 0, 1, 2
_CLASS = np.full(256, _MARK, np.int8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[0x41:0x5B] = 1
_SMALL = np.zeros(256, np.int64)
_SMALL[0x61:0x7B] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about _PART bytes that end between words or rows; a longer word makes a longer range."""
    low, last = int(offsets[0]), int(offsets[-1])
    while low < last:
        high = min(low + _PART, last)
        if high < last:
            here = np.flatnonzero(_CLASS[data[low:high]] == _SPACE)
            while not len(here) and high < last:
                before, high = high, min(high + _PART, last)
                here = np.flatnonzero(_CLASS[data[before:high]] == _SPACE) + before - low
            row = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            high = last if high == last and not len(here) else max(low + int(here[-1]) + 1 if len(here) else 0, row if row > low else 0) or high
        yield low, high
        low = high


def words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, word) of a column's words in order, by parts; a word is a hash of its bytes, A-Z read as a-z.

    A word with a capital is followed by one that says whether it is the first letter or all of them.
    """
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    for low, high in _parts(data, offsets):
        part = data[low:high]
        kind = _CLASS[part]
        cut_here = np.zeros(len(part) + 1, bool)
        inside = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")]
        cut_here[inside - low] = True
        edge = np.ones(len(part) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge |= cut_here
        places = np.flatnonzero(edge)
        starts, ends = places[:-1], places[1:]
        some = kind[starts] != _SPACE
        starts, ends = starts[some], ends[some]
        powers = np.full(len(part) + 1, _BASE, _U)
        powers[:1] = 1
        powers = np.multiply.accumulate(powers, dtype=_U)
        inverse = np.full(len(part) + 1, pow(_BASE, -1, 1 << 64), _U)
        inverse[:1] = 1
        inverse = np.multiply.accumulate(inverse, dtype=_U)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(_BYTE[_FOLD[part]] * powers[:-1], dtype=_U, out=sums[1:])
        hashes = span_hash(starts, ends, (sums, inverse))
        capitals = np.concatenate([[0], np.cumsum(_CAPITAL[part])])
        small = np.concatenate([[0], np.cumsum(_SMALL[part])])
        n_capitals = capitals[ends] - capitals[starts]
        form = np.where(n_capitals == 0, 0, np.where((small[ends] == small[starts]) & (n_capitals > 1), 2, 1))
        rows = np.searchsorted(offsets, low + starts, "right") - 1
        times = 1 + (form > 0)
        both = np.repeat(hashes, times)
        both[np.cumsum(times)[form > 0] - 1] = mix(form[form > 0].astype(_U))
        yield np.repeat(rows, times), both


def _entries() -> np.ndarray:
    """Places of each bucket's index vector that are not 0: place for +1, DIMENSIONS + place for -1; they may repeat."""
    out = np.empty((BUCKETS, ENTRIES), np.int64)
    for k in range(ENTRIES):
        h = mix(np.arange(BUCKETS, dtype=_U) * _U(ENTRIES) + _U(k + 1))
        out[:, k] = (h % _U(DIMENSIONS)).astype(np.int64) + DIMENSIONS * (h >> _U(63)).astype(np.int64)
    return out


def _summed(of: np.ndarray, entries: np.ndarray, n: int) -> np.ndarray:
    """The sum of index vectors, given by their entries, for each of n numbers in ``of``."""
    counts = np.bincount((of[:, None] * (2 * DIMENSIONS) + entries).ravel(), minlength=n * 2 * DIMENSIONS).reshape(n, 2, DIMENSIONS)
    return counts[:, 0] - counts[:, 1]


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _meanings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, sum of the index vectors around its words) of a task's texts: a row a bucket at most."""
    entries = _entries()
    total = np.zeros((BUCKETS, DIMENSIONS), np.int64)
    for batch in batches:
        last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows, hashes in words(batch.column(0)):
            # a part's first words have their surroundings in the part before
            known = len(last[0])
            rows, bucket = np.concatenate([last[0], rows]), np.concatenate([last[1], _buckets(hashes)])
            last = rows[-WINDOW:], bucket[-WINDOW:]
            of, around = [], []
            for step in range(1, WINDOW + 1):
                right = np.arange(max(step, known), len(rows))
                right = right[rows[right] == rows[right - step]]
                of += [bucket[right - step], bucket[right]]
                around += [bucket[right], bucket[right - step]]
            total += _summed(np.concatenate(of), entries[np.concatenate(around)], BUCKETS)
    some = np.flatnonzero(total.any(axis=1))
    # whole numbers: their sums do not depend on the order of tasks
    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * DIMENSIONS), pa.array(total[some].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), sums], names=["bucket", "sums"])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, in whole parts of 1 / UNIT, from the one column of ``texts``: BUCKETS rows at most reach
    the driver."""
    parts = texts.mapInArrow(bounded(_meanings), "bucket int, sums array<bigint>")
    each = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(DIMENSIONS)]
    found = parts.groupBy("bucket").agg(*each).toPandas()
    out = np.zeros((BUCKETS, DIMENSIONS))
    out[found["bucket"].to_numpy(np.int64)] = found.drop(columns="bucket").to_numpy(float)
    out -= out.sum(axis=0) / max(1, int(out.any(axis=1).sum())) * out.any(axis=1)[:, None]  # what all words have in common
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.round(out / np.where(length > 0, length, 1) * UNIT).astype(np.int16)


#: Numbers of a pooled document: mean and spread of meanings, mean of index vectors, and counts.
POOLED = 3 * DIMENSIONS + 4


def _pooled(vectors):
    """(id, pooled) of texts; a text's words are added up part by part, so its length does not matter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, meaning = _entries(), vectors.value.astype(float)
        table = np.concatenate([meaning, meaning**2], axis=1)
        for batch in batches:
            n = batch.num_rows
            sums, plain, counts, repeats = np.zeros((n, 2 * DIMENSIONS)), np.zeros((n, DIMENSIONS)), np.zeros(n), np.zeros(n)
            last = np.full(1, -1), np.zeros(1, _U)
            for rows, hashes in words(batch.column(1)):
                if not len(rows):
                    continue
                same = (rows == np.concatenate([last[0], rows[:-1]])) & (hashes == np.concatenate([last[1], hashes[:-1]]))
                last = rows[-1:], hashes[-1:]
                bucket = _buckets(hashes)
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                sums[rows[starts]] += np.add.reduceat(table[bucket], starts, axis=0)
                low, high = int(rows[0]), int(rows[-1]) + 1
                plain[low:high] += _summed(rows - low, entries[bucket], high - low)
                counts[low:high] += np.bincount(rows - low, minlength=high - low)
                repeats[low:high] += np.bincount(rows[same] - low, minlength=high - low)
            some = np.maximum(counts, 1)[:, None]
            mean, square = sums[:, :DIMENSIONS] / some / UNIT, sums[:, DIMENSIONS:] / some / UNIT**2
            plain /= some
            spread = np.sqrt(np.maximum(square - mean**2, 0))
            size = np.log1p(counts)[:, None]
            whole = np.concatenate([mean, spread, plain, size, size**2 / 10, (repeats[:, None] / some), np.linalg.norm(mean, axis=1, keepdims=True)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * POOLED), pa.array(whole.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "pooled"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Standardised input, a hidden layer of rectified units, one output; its logit is divided by a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.maximum(z @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((self.logits(x) - self.shift) / self.temperature)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """The network from rows that come in an order of their own, and its temperature from every KEEP_OUT-th row."""
    rng = np.random.default_rng(seed)
    kept = np.arange(len(y)) % KEEP_OUT == 0
    if len(np.unique(y[~kept])) < 2 or len(np.unique(y[kept])) < 2:
        kept[:] = False
    train, target = x[~kept], y[~kept]
    centre, scale = train.mean(axis=0), train.std(axis=0) + 1e-6
    z = np.clip((train - centre) / scale, -8, 8)
    weights = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
    # both kinds weigh alike, which the shift below takes back
    share = min(max(target.mean(), 1e-3), 1 - 1e-3)
    importance = np.where(target > 0, 0.5 / share, 0.5 / (1 - share))
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for at in range(0, len(order), STEP):
            rows = order[at : at + STEP]
            hidden = np.maximum(z[rows] @ weights[0] + weights[1], 0)
            error = (_sigmoid(hidden @ weights[2] + weights[3]) - target[rows]) * importance[rows] / len(rows)
            back = np.outer(error, weights[2]) * (hidden > 0)
            gradients = [z[rows].T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ error + DECAY * weights[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(gradients):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    network = Network(centre, scale, (weights[0], weights[1], weights[2], float(weights[3][0])), shift=-float(np.log(share / (1 - share))))
    if kept.any():
        logits = network.logits(x[kept]) - network.shift
        choices = np.exp(np.linspace(np.log(0.25), np.log(16), 61))
        # a pseudo-row of each kind at the middle keeps a faultless fit from certainty
        loss = [np.logaddexp(0, np.where(y[kept] > 0, -logits, logits) / t).sum() + 2 * np.logaddexp(0, -4 / t) + 4 / t * 0.02 for t in choices]
        network.temperature = float(choices[int(np.argmin(loss))])
    return network


def _scored(network):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, POOLED).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(network.value.scores(x), DECIMALS))], names=["id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """One row per input row: ``id_col, score, predicted``.

    ``labels`` (``id_col``, ``label_col`` 0 or 1) may be any number of rows; of those with an id and a label, at most
    ``max_examples``, chosen by a hash of the id, are learned from; rows of one id count once, as 0 if any says so. Where
    several rows of ``docs`` have an example's id, each is an example up to the bound. Word vectors come from all texts.
    A null text counts as empty and is scored like any other; equal texts have equal scores. With no examples every score is
    0.5, with examples of one kind only their smoothed share. The scores use the text only; other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    vectors = spark.sparkContext.broadcast(word_vectors(texts.select("text")))  # BUCKETS x DIMENSIONS numbers
    pooled = cut(texts.mapInArrow(bounded(_pooled(vectors)), "id bigint, pooled array<float>"))
    examples = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("example")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    examples = examples.orderBy(F.xxhash64("example"), "example").limit(max_examples)
    known = pooled.join(F.broadcast(examples), F.col("id") == F.col("example")).select("id", "y", "pooled")  # max_examples rows at most
    known = known.orderBy(F.xxhash64("id"), "id", "pooled").limit(max_examples).toPandas()
    y = known["y"].to_numpy(np.int64)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        found = pooled.select("id", F.lit(float(share)).alias("score"))
    else:
        network = fit(np.stack(known["pooled"].to_numpy()).astype(float), y)
        found = pooled.mapInArrow(bounded(_scored(spark.sparkContext.broadcast(network))), "id bigint, score double")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
