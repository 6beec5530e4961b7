"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their first 4 and 6 bytes. A text's vector holds each of its terms, as often as it occurs, times
log(N / documents with it); document frequencies are counted over the whole table. As is usual, terms that hardly any or
very many documents have are no features: the first are met by nobody else, the second by everybody. The cosine is of
whole texts, whatever their labels.

Examples are kept in blocks of like ones. For every term and block the index holds the greatest weight, which bounds the
cosine of all examples of a block. A batch of texts visits, round by round, each text's blocks of the highest bounds,
and leaves a text once no block left can hold a nearer example than those it has found. Neighbours vote with weights
that fall with distance; a logistic curve fitted to the examples' own votes, each without itself, turns votes into
calibrated scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm._session import bounded, cut, prepare
from turnweave.llm._words import NOT_ALPHANUMERIC, lowered, mix, span_hash, windows

#: The fit's bound: labelled rows that serve as examples.
MAX_EXAMPLES = 4000
PREFIXES = (4, 6)
#: Shares of all documents that a term is found in at least and at most. A document has some hundred different terms on
#: average, so that many / LEAST_SHARE bounds the number of features, whatever the table's size.
LEAST_SHARE, MOST_SHARE = 0.004, 0.05
#: In a table too small for shares, a term may be in so many documents.
FEW_DOCUMENTS = 10
NEIGHBOURS, BLOCK, EVIDENCE = 40, 128, 3
#: Blocks that a text visits in a round, and terms of a batch of texts.
ROUND_BLOCKS, BATCH_TERMS = 4, 1 << 16
#: A prior vote's weight, and what is added to a distance before it divides.
PRIOR_WEIGHT, NEAR = 0.25, 0.1
THRESHOLD = 0.7
#: Cosines that agree to so many decimals are equal.
DECIMALS = 9
#: Different terms whose counts a task holds before it hands them on.
HELD_TERMS = 1 << 20

_U = np.uint64


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, term) of every word and prefix of a column, by windows."""
    data, offsets = lowered(column)
    for rows, starts, ends, sums in windows(data, offsets, NOT_ALPHANUMERIC):
        found, at = [span_hash(starts, ends, sums)], [rows]
        for n in PREFIXES:
            longer = ends - starts > n
            found.append(mix(span_hash(starts[longer], starts[longer] + n, sums) + _U(n)))
            at.append(rows[longer])
        yield np.concatenate(at), np.concatenate(found)


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents with it) of a task's texts."""

    def batch_of(terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

    held, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    for batch in batches:
        rows, terms = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, _U)), *_terms(batch.column(0))))
        order = np.lexsort((rows, terms))
        rows, terms = rows[order], terms[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
        both, weights = np.concatenate([held, terms[first]]), np.concatenate([counts, np.ones(int(first.sum()), np.int64)])
        order = np.argsort(both, kind="stable")
        both, weights = both[order], weights[order]
        start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])[: len(both)])
        held, counts = both[start], np.add.reduceat(weights, start) if len(start) else weights
        if len(held) > HELD_TERMS:
            yield batch_of(held, counts)
            held, counts = held[:0], counts[:0]
    yield batch_of(held, counts)


def _counted(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end of each row's features, features, how often) of a column; features are places in the sorted vocabulary."""
    size = max(1, len(vocabulary))
    keys = [np.zeros(0, np.int64)]
    for rows, terms in _terms(column) if len(vocabulary) else ():
        at = np.minimum(np.searchsorted(vocabulary, terms), size - 1)
        known = vocabulary[at] == terms
        keys.append(rows[known] * size + at[known])
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    return np.searchsorted(found // size, np.arange(len(column) + 1)), found % size, counts


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range in turn."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


@dataclass
class Index:
    """Labelled examples as unit vectors in blocks of BLOCK."""

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: postings by term and example: example, weight; where each term's postings of each block start
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    starts: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int32))
    #: greatest weight (term, block)
    highest: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    base: float = 0.5
    #: score of a text without any feature, and the calibration's slope and intercept
    without: float = 0.5
    curve: tuple[float, float] = (1.0, 0.0)

    def unit(self, ends: np.ndarray, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of the features, such that each row's vector has length 1."""
        weights = counts * self.idf[features]
        lengths = np.diff(ends)
        squares = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=weights**2, minlength=len(lengths))
        return weights / np.sqrt(np.repeat(np.where(squares > 0, squares, 1), lengths))

    def build(self, ids: np.ndarray, toxic: np.ndarray, ends: np.ndarray, features: np.ndarray, weights: np.ndarray) -> None:
        # examples with the same heaviest feature stand together, which keeps blocks' bounds apart
        heaviest = np.array([features[a + np.argmax(weights[a:b])] if b > a else -1 for a, b in zip(ends[:-1], ends[1:])], np.int64)
        order = np.lexsort((ids, heaviest))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.toxic = ids[order], toxic[order].astype(float)
        owner = place[np.repeat(np.arange(len(ids)), np.diff(ends))]
        by_term = np.lexsort((owner, features))
        features, self.example, self.weight = features[by_term], owner[by_term].astype(np.int32), weights[by_term]
        blocks = -(-len(ids) // BLOCK)
        cells = features * (blocks + 1) + self.example // BLOCK
        self.starts = np.searchsorted(cells, np.arange(len(self.idf) * (blocks + 1))).reshape(-1, blocks + 1).astype(np.int32)
        highest = np.zeros((len(self.idf), blocks))
        np.maximum.at(highest, (features, self.example // BLOCK), self.weight)
        self.highest = (highest * (1 + 1e-6)).astype(np.float32)  # a bound still holds when it is rounded

    def _scored(self, pair_query: np.ndarray, pair_block: np.ndarray, ends: np.ndarray, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact cosines of (query, block) pairs with each example of the block."""
        n = np.diff(ends)[pair_query]
        pair, at = np.repeat(np.arange(len(pair_query)), n), _ragged(ends[pair_query], n)
        start = self.starts[features[at], pair_block[pair]].astype(np.int64)
        length = self.starts[features[at], pair_block[pair] + 1] - start
        posting = _ragged(start, length)
        pair = np.repeat(pair, length)
        cell = (pair - pair_block[pair]) * BLOCK + self.example[posting]
        products = np.repeat(weights[at], length) * self.weight[posting]
        return np.bincount(cell, weights=products, minlength=len(pair_query) * BLOCK).reshape(-1, BLOCK)

    def nearest(self, ends: np.ndarray, features: np.ndarray, weights: np.ndarray, own: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of each row's k nearest examples, nearest first, of equal ones the first; those of no
        positive cosine have cosine 0. ``own`` is the place of a row's own example, which is left out, or -1."""
        rows, blocks = len(ends) - 1, self.highest.shape[1]
        places, keys = np.zeros((rows, k), np.int64), np.zeros((rows, k))
        some = np.flatnonzero(np.diff(ends))
        todo = np.zeros((rows, blocks))
        if len(some) and blocks:
            todo[some] = np.add.reduceat(self.highest[features] * weights[:, None], ends[some], axis=0)
        while blocks:
            # rounding to DECIMALS can raise a cosine above its bound
            todo[todo < keys[:, -1:] - 10.0**-DECIMALS] = 0
            alive = np.flatnonzero(todo.any(axis=1))
            if not len(alive):
                break
            width = min(ROUND_BLOCKS, blocks)
            picked = np.argpartition(-todo[alive], width - 1, axis=1)[:, :width]
            query, block = np.repeat(alive, width), picked.ravel()
            open_ = todo[query, block] > 0
            todo[query, block] = 0
            found = np.zeros((len(query), BLOCK))
            found[open_] = self._scored(query[open_], block[open_], ends, features, weights)
            place = block[:, None] * BLOCK + np.arange(BLOCK)
            found[place == own[query][:, None]] = 0
            # of equal cosines the first place has the greatest key
            key = np.where(found > 0, np.round(found, DECIMALS) + (1 - place / max(len(self.ids), 1)) * 10.0 ** -(DECIMALS + 2), 0)
            key = np.concatenate([keys[alive], key.reshape(len(alive), -1)], axis=1)
            place = np.concatenate([places[alive], place.reshape(len(alive), -1)], axis=1)
            top = np.argpartition(-key, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1, kind="stable"), 1)
            keys[alive], places[alive] = np.take_along_axis(key, top, 1), np.take_along_axis(place, top, 1)
        return np.where(keys > 0, places, 0), np.minimum(np.round(keys, DECIMALS), 1.0)

    def votes(self, places: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        weight = np.where(cosines > 0, 1 / (1 - cosines + NEAR), 0)
        toxic = self.toxic[places] if len(self.toxic) else np.zeros(places.shape)
        return ((weight * toxic).sum(axis=1) + PRIOR_WEIGHT * self.base) / (weight.sum(axis=1) + PRIOR_WEIGHT)

    def scores(self, votes: np.ndarray) -> np.ndarray:
        slope, intercept = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * np.log(votes / (1 - votes)) + intercept, -30, 30)))

    def search(self, ids: list[int | None], ends: np.ndarray, features: np.ndarray, counts: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, places, cosines) by batches of about BATCH_TERMS features."""
        weights = self.unit(ends, features, counts)
        by_id = {int(i): n for n, i in enumerate(self.ids)}
        own = np.array([by_id.get(i, -1) for i in ids], np.int64)
        start = 0
        while start < len(ids):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BATCH_TERMS, "right")) - 1)
            part = slice(ends[start], ends[stop])
            yield slice(start, stop), *self.nearest(ends[start : stop + 1] - ends[start], features[part], weights[part], own[start:stop])
            start = stop

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """A logistic curve over the examples' votes, with smoothed targets."""
        y = toxic.astype(float)
        if len(y) == 0:
            return
        high, low = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
        target = np.where(y > 0, high, low)
        x = np.stack([np.log(votes / (1 - votes)), np.ones(len(y))], 1)
        b, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            gradient = x.T @ (p - target) + 0.1 * (b - prior)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
            b = b - step / max(1.0, float(np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        self.curve = (max(float(b[0]), 1e-3), float(b[1]))


def _vectors(vocabulary):
    """(id, toxic, features, counts) of labelled texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, features, counts = _counted(batch.column(2), vocabulary.value)
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (features, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["id", "toxic", "features", "counts"])

    return run


def _own_votes(index):
    """(toxic, vote) of the examples, each without itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, counts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())]).astype(np.int64)
            votes = [np.zeros(0)]
            for _, places, cosines in index.value.search(batch.column(0).to_pylist(), ends, features.astype(np.int64), counts):
                votes.append(index.value.votes(places, cosines))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(votes))], names=["toxic", "vote"])

    return run


def _scored(index):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = index.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            ends, features, counts = _counted(batch.column(1), i.vocabulary)
            bare = np.diff(ends) == 0
            scores, evidence = np.full(batch.num_rows, i.without), []
            for rows, places, cosines in i.search(batch.column(0).to_pylist(), ends, features, counts):
                scores[rows] = np.where(bare[rows], i.without, i.scores(i.votes(places, cosines)))
                for p, c in zip(places[:, :EVIDENCE].tolist(), cosines[:, :EVIDENCE].tolist()):
                    evidence.append([{"doc_id": int(i.ids[x]), "cosine": y, "toxic": int(i.toxic[x])} for x, y in zip(p, c) if y > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(evidence, kind), pa.array(~bare)], names=["id", "score", "evidence", "known"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, shares: tuple[float, float] = (LEAST_SHARE, MOST_SHARE)) -> DataFrame:
    """One row per input row: ``id_col, score, predicted, evidence``.

    ``labels`` (``id_col``, ``label_col`` 0 or 1) may be any number of rows; of those with an id and a label, at most
    ``max_examples``, chosen by a hash of the id, are examples; rows of one id count once, as toxic if any says so. Where
    several rows of ``docs`` have an example's id, the example is the row whose text sorts last. A text is never its own
    neighbour: the example with its id is left out. Of examples with equal cosines, those of the same heaviest feature
    stand together and then the lowest id is nearer. A text without a feature, such as a null or empty one, gets the
    share of toxic examples among those without one. With no examples, or none of one kind, every score is the examples'
    smoothed share. ``evidence`` lists the nearest examples with their cosines and labels. The scores use the text only.
    ``shares`` are LEAST_SHARE and MOST_SHARE. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    frequencies = texts.select("text").mapInArrow(bounded(_frequencies), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    total = texts.count()
    shared = frequencies.where(F.col("n").between(shares[0] * total, max(shares[1] * total, FEW_DOCUMENTS))).toPandas()  # see LEAST_SHARE
    terms, n = shared["term"].to_numpy(np.int64).view(_U), shared["n"].to_numpy(np.int64)
    order = np.argsort(terms)
    vocabulary, idf = terms[order], np.log(max(total, 1) / np.maximum(n[order], 1)) if len(n) else np.zeros(0)
    # in a table of few documents a term may be in all of them
    idf = np.where(idf > 0, idf, 0.0)

    examples = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("example")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    examples = examples.orderBy(F.xxhash64("example"), "example").limit(max_examples)
    labelled = texts.join(F.broadcast(examples), F.col("id") == F.col("example"))  # max_examples rows at most
    labelled = labelled.groupBy("id", "toxic").agg(F.max("text").alias("text"))
    shipped = spark.sparkContext.broadcast(vocabulary)
    vectors = cut(labelled.mapInArrow(bounded(_vectors(shipped)), "id bigint, toxic int, features array<int>, counts array<int>"))
    known = vectors.orderBy("id").toPandas()  # max_examples rows at most
    ids, toxic = known["id"].to_numpy(np.int64), known["toxic"].to_numpy(np.int64)
    empty = np.concatenate([np.zeros(0, np.int64), *known["features"]]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *known["counts"]]).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in known["features"]])]).astype(np.int64)

    index = Index(vocabulary, idf)
    index.base = (toxic.sum() + 0.5) / (len(toxic) + 1)
    bare = toxic[np.diff(ends) == 0]
    index.without = (bare.sum() + index.base) / (len(bare) + 1)
    if 0 < toxic.sum() < len(toxic):
        index.build(ids, toxic, ends, empty[0], index.unit(ends, *empty))
        some = vectors.where(F.size("features") > 0)
        votes = some.mapInArrow(bounded(_own_votes(spark.sparkContext.broadcast(index))), "toxic int, vote double").toPandas()
        index.calibrate(votes["vote"].to_numpy(float), votes["toxic"].to_numpy(np.int64))
    else:
        index.without = index.base
    kind = "id bigint, score double, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>, known boolean"
    found = texts.mapInArrow(bounded(_scored(spark.sparkContext.broadcast(index))), kind)
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
