"""Near-duplicate classes by DartMinHash and banded joining.

A document is the weighted set of its five-word shingles; a shingle's weight is how often it occurs, or any positive
function of that. A shingle throws hashed darts into its plane of weight and rank, a Poisson process of rate 1 that is
the same in every document; a document keeps the darts below its own weight of the shingle, each of which belongs to one
of k coordinates, and its signature is each coordinate's dart of the lowest rank. Two documents agree in a coordinate
with the probability of their weighted Jaccard similarity. The plane is cut into strips of weight whose widths double,
and these into regions of area 1, so a heavy shingle costs the logarithm of its weight; as many ranks are thrown as fill
all coordinates, so a text of n shingles costs about max(n, k log k) darts, and not n times k.

Copies are folded first, so only different texts meet. Documents that agree in a band are candidates, checked by exact
similarity. A bucket is not expanded into pairs: each member is first checked against that bucket end (lowest or highest
document of any of its buckets) with which it shares most bands, then against the other ends if they are still of
another class. Buckets that are then still of several classes are joined to regions, in which a document is once, however
many buckets it shares with others. A region's documents, but those of its largest class, are searched for among all of
them: blocks of members are inverted indexes, a block of queries asks each for the members that have one of a query's
rarest shingles (a pair without one of them in common cannot be similar), these are checked exactly, and only links leave
the task. Rows are linear in documents, and no candidate is left out: classes are the connected components, at least
those that all candidate pairs would give. What cannot reach the similarity is left out before: two texts share no
shingle that only one document of the buckets has, which bounds what a pair shares by the lesser weight that either has
in common with anyone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm._session import bounded, cut, prepare, release
from turnweave.llm._words import mix, word_hashes

SHINGLE_WORDS = 5
#: The least similarity, 0.8, as a fraction, so that it is compared in whole numbers.
NUM, DEN = 4, 5
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 28, which is 1.5e-5.
BANDS, ROWS = 28, 5

#: Bytes of shingles that the members, or the queries, of one search task hold on average.
BLOCK_BYTES = 4 << 20

_U = np.uint64
_FRACTION = 44
_ODD = mix(np.arange(1, 65, dtype=_U)) | _U(1)
#: The distribution function of Poisson(1) on the scale of 64-bit hashes.
_POISSON = np.array([min(int(p * 2.0**64), (1 << 64) - 1) for p in np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))], _U)


#: Weights of a shingle by how often it occurs.
WEIGHTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"count": lambda n: n.astype(float), "log": lambda n: 1 + np.log2(n)}


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, how often) by row and shingle. A row of fewer words than a shingle has one shingle of all of them;
    one without words has none."""
    counts = np.diff(offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    hashed, at = [], []
    if len(words) >= size:
        joined = np.zeros(len(words) - size + 1, _U)
        for n in range(size):
            joined += words[n : len(words) - size + 1 + n] * _ODD[n]
        whole = row[: len(joined)] == row[size - 1 :]
        hashed.append(mix(joined[whole]))
        at.append(row[: len(joined)][whole])
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        part = words[offsets[r] : offsets[r + 1]]
        hashed.append(mix(np.array([(part * _ODD[8 : 8 + len(part)]).sum(dtype=_U) + _U(len(part))], _U)))
        at.append(np.array([r]))
    if not hashed:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, r = np.concatenate(hashed), np.concatenate(at)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    return h[first], r[first], np.diff(np.concatenate([first, [len(h)]]))


def signatures(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_rows: int, k: int = BANDS * ROWS) -> np.ndarray:
    """(n_rows, k): the rank of the earliest dart of each coordinate, the largest number where a row has no element.

    Strip 0 of an element's plane is weights 0 to 1, strip s weights 2 ** (s - 1) to 2 ** s; a strip of width w is cut
    into cells of height 1 / w, each with a Poisson(1) number of darts.
    """
    never = np.iinfo(_U).max
    out = np.full(n_rows * k, never, _U)
    total = np.bincount(rows, weights=weights, minlength=n_rows)
    strips = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), strips)
    strip = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
    shift = np.maximum(strip - 1, 0)  # the binary logarithm of a strip's width
    low, high = np.zeros(n_rows), np.where(total > 0, k * (np.log(k) + 4) / np.where(total > 0, total, 1), 0)
    todo = total > 0
    while todo.any():
        active = np.flatnonzero(todo[rows[of]])
        owner, width = rows[of[active]], (1 << shift[active]).astype(float)
        from_, cells = np.ceil(low[owner] * width).astype(np.int64), np.ceil(high[owner] * width).astype(np.int64)
        cells -= from_
        for at in _blocks(cells):
            n = cells[at]
            which = np.repeat(active[at], n)
            cell = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(from_[at], n)
            element = of[which]
            region = mix(elements[element] + (cell + 1).astype(_U) * _ODD[21] + strip[which].astype(_U) * _ODD[24])
            darts = np.searchsorted(_POISSON, region, "right")
            place = np.repeat(np.arange(len(region)), darts)
            nth = np.arange(len(place)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(region[place] + (nth + 1).astype(_U) * _ODD[22])
            partly = (strip[which] > 0) | (weights[element] < 1)
            if partly.any():
                place_partly = np.flatnonzero(partly[place])
                at_place = which[place[place_partly]]
                across = (mix(dart[place_partly] + _ODD[25]) >> _U(11)) / float(1 << 53)
                weight = np.where(strip[at_place] > 0, (1 << shift[at_place]) * (1 + across), across)
                kept = np.ones(len(place), bool)
                kept[place_partly] = weight < weights[of[at_place]]
                place, dart = place[kept], dart[kept]
            by = shift[which[place]].astype(_U)
            rank = (cell[place].astype(_U) << (_U(_FRACTION) - by)) | ((dart >> _U(64 - _FRACTION)) >> by)
            coordinate = ((dart & _U(0xFFFFF)) * _U(k)) >> _U(20)
            np.minimum.at(out, rows[element[place]] * k + coordinate.astype(np.int64), rank)
        # a strip's last cells may reach beyond what other strips have thrown
        reached = (high * float(1 << _FRACTION)).astype(_U)
        todo &= (out.reshape(n_rows, k) >= reached[:, None]).any(axis=1)
        low, high = np.where(todo, high, low), np.where(todo, 2 * high, high)
    return out.reshape(n_rows, k)


def _blocks(cells: np.ndarray, most: int = 1 << 18) -> Iterator[slice]:
    """Slices of units whose cells number about ``most``."""
    total = np.cumsum(cells)
    start = 0
    while start < len(cells):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + most, "right")))
        yield slice(start, stop)
        start = stop


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands): one hash per band, different for each band."""
    parts = signature.reshape(len(signature), bands, rows)
    joined = np.zeros(parts.shape[:2], _U)
    for n in range(rows):
        joined += mix(parts[:, :, n]) * _ODD[n]
    return mix(joined + np.arange(1, bands + 1, dtype=_U) * _ODD[23])


def _signed(weight: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, offsets = word_hashes(batch.column(1))
            content = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            elements, rows, often = shingles(words, offsets)
            some = np.bincount(rows, minlength=n) > 0
            keys = band_keys(signatures(elements, WEIGHTS[weight](often), rows, n))[some].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(content, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                names=["id", "content", "keys"],
            )

    return run


def _sets(weight: str):
    """(id, elements, weights, size): sorted 64-bit hashes, 64-bit weights or nothing if all are 1, and their sum."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = word_hashes(batch.column(1))
            elements, rows, often = shingles(words, offsets)
            weights = WEIGHTS[weight](often)
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            parts = list(zip(ends[:-1], ends[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([elements[a:b].tobytes() for a, b in parts], pa.binary()),
                    pa.array([b"" if (weights[a:b] == 1).all() else weights[a:b].tobytes() for a, b in parts], pa.binary()),
                    pa.array([float(weights[a:b].sum()) for a, b in parts], pa.float64()),
                ],
                names=["id", "elements", "weights", "size"],
            )

    return run


def _read(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(elements, _U)
    return h, np.frombuffer(weights, float) if weights else np.ones(len(h))


def _shared(a: np.ndarray, a_weights: np.ndarray, b: np.ndarray, b_weights: np.ndarray) -> float:
    both, weights = np.concatenate([a, b]), np.concatenate([a_weights, b_weights])
    order = np.argsort(both, kind="stable")
    same = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    return float(np.minimum(weights[order[same]], weights[order[same + 1]]).sum())


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for n, (a, aw, sa, b, bw, sb) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 8)))):
            shared = _shared(*_read(a, aw), *_read(b, bw))
            if DEN * shared >= NUM * (sa + sb - shared):
                kept.append(n)
        yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])


def _exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read = [_read(e, w) for e, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        at = np.repeat(np.arange(len(read)), [len(h) for h, _ in read])
        hashes, weights = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip((_U, float), list(zip(*read)) or [(), ()]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(hashes.view(np.int64)), pa.array(weights)], names=["id", "element", "weight"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity NUM / DEN."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"), F.col("size").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"), F.col("size").alias("sb"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "wa", "sa", "eb", "wb", "sb")
    return cut(full.mapInArrow(bounded(_similar), "a bigint, b bigint"))


def _search(members: pa.Table, queries: pa.Table) -> pa.Table:
    """For each query a link (a, b) to a similar member of each other class."""
    owner, label = members.column("node").to_numpy(), members.column("label").to_numpy()
    read = [_read(e, w) for e, w in zip(members.column("elements").to_pylist(), members.column("weights").to_pylist())]
    sizes, lengths = members.column("size").to_numpy(), np.array([len(h) for h, _ in read], np.int64)
    hashes, weights = np.concatenate([np.zeros(0, _U), *(h for h, _ in read)]), np.concatenate([np.zeros(0), *(w for _, w in read)])
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(hashes, kind="stable")
    posted, at = hashes[order], np.repeat(np.arange(len(read)), lengths)[order]
    ragged = lambda start, n: np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    found = []
    columns = (queries.column(c).to_pylist() for c in ("node", "label", "size", "elements", "weights"))
    for node, own_label, size, elements, w in zip(*columns):
        own, own_weights = _read(elements, w)
        low = np.searchsorted(posted, own, "left")
        n = np.searchsorted(posted, own, "right") - low
        # a similar member has one of any elements that weigh more than what it can lack; the rarest are asked for
        rare = np.argsort(n, kind="stable")
        rare = rare[: np.searchsorted(DEN * np.cumsum(own_weights[rare]), (DEN - NUM) * size, "right") + 1]
        candidates = np.unique(at[ragged(low[rare], n[rare])])
        near = (label[candidates] != own_label) & (DEN * np.minimum(sizes[candidates], size) >= NUM * np.maximum(sizes[candidates], size))
        candidates = candidates[near]
        if not len(candidates):
            continue
        of = np.repeat(np.arange(len(candidates)), lengths[candidates])
        theirs = ragged(starts[candidates], lengths[candidates])
        place = np.minimum(np.searchsorted(own, hashes[theirs]), len(own) - 1)
        same = own[place] == hashes[theirs]
        shared = np.bincount(of[same], weights=np.minimum(own_weights[place[same]], weights[theirs[same]]), minlength=len(candidates))
        similar = candidates[DEN * shared >= NUM * (sizes[candidates] + size - shared)]
        for first in np.unique(label[similar], return_index=True)[1]:
            found.append((node, int(owner[similar[first]])))
    return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})


def searched(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between documents of different classes in a region, from (node, region, label).

    Every pair of two classes has an end outside the region's largest class; those ends are the queries. Members and
    queries of a region meet in blocks of BLOCK_BYTES.
    """
    counts = regions.groupBy("region", "label").agg(F.count("*").alias("n"))
    largest = counts.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    held = regions.join(largest, "region").join(sets.withColumnRenamed("id", "node"), "node")
    bytes_ = F.octet_length("elements") + F.octet_length("weights") + 64
    is_query = F.col("label") != F.col("largest")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK_BYTES), F.lit(1)).cast("int")
    shape = held.groupBy("region").agg(blocks(F.sum(bytes_)).alias("blocks"), blocks(F.coalesce(F.sum(F.when(is_query, bytes_)), F.lit(0))).alias("query_blocks"))
    held = held.join(cut(shape), "region")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rest = ("node", "label", "size", "elements", "weights")
    members = held.select("region", place("blocks").alias("block"), every("query_blocks").alias("query_block"), *rest)
    asked = held.where(is_query).select("region", every("blocks").alias("block"), place("query_blocks").alias("query_block"), *rest)
    by = ("region", "block", "query_block")
    members, asked = (f.select(*(F.col(c).alias(c) for c in f.columns)) for f in (members, asked))  # columns of their own, though both come from the same
    return cut(members.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_search, "a bigint, b bigint"))


def regions_of(members: DataFrame) -> DataFrame:
    """(node, region, label) of the documents in buckets of several classes, from (key, node, label): documents that such
    buckets join, directly or over others, are in one region."""
    several = members.groupBy("key").agg(F.min("node").alias("lowest"), F.min("label").alias("l"), F.max("label").alias("h")).where("l < h")
    inside = cut(members.join(several.select("key", "lowest"), "key").select("node", "label", "lowest"))
    region = components(inside.select(F.col("node").alias("a"), F.col("lowest").alias("b")).distinct())
    return cut(inside.select("node", "label").distinct().join(region.withColumnRenamed("label", "region"), "node").select("node", "region", "label"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): the lowest node of its connected component.

    Alternates the large-star and small-star steps, which need a number of rounds logarithmic in a component's size,
    until every component is a star around its lowest node. Minima are aggregated before they are shuffled; each round
    is written to the shared folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    release(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def _as_links(labels: DataFrame) -> DataFrame:
    return labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def _stars(edges: DataFrame) -> bool:
    """Whether no node is above two others, or both above one and below another."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("n").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return sums.where("above > 1 OR (above = 1 AND below = 1)").isEmpty()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: str = "count") -> DataFrame:
    """One row per input row: ``id_col, class_id, kept``.

    Words are runs of anything but U+0020 and U+0009-000D, A-Z read as a-z. Documents are linked if their weighted
    Jaccard similarity over five-word shingles is at least 0.8; a text of one to four words is one shingle; texts of the
    same words are copies, also those without words (null, empty). ``weight`` is a shingle's weight: ``count``, how often
    it occurs, or ``log``, one more than the binary logarithm of that. ``class_id`` is the lowest id of the class, and
    ``kept`` marks that lowest document; rows that repeat it are all kept. Rows that share an id are one document of
    several texts. A row without an id belongs to its copies' class, to none if it has no copies with ids, and is kept
    only in that case. Texts of any length are read whole. An empty table gives an empty result; other columns are
    ignored.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = cut(texts.mapInArrow(bounded(_signed(weight)), "id bigint, content binary, keys array<bigint>"))
    # of copies the lowest id stands for all; their signatures are the same
    nodes = signed.groupBy("content").agg(F.min("id").alias("node"), F.first("keys").alias("keys"))
    banded = nodes.where("node IS NOT NULL").select("node", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("lowest"), F.max("node").alias("highest")).where("lowest < highest")
    members = cut(banded.join(buckets, "key").select("key", "node", "lowest", "highest"))
    in_buckets = members.select("node").distinct()
    sets = cut(texts.join(in_buckets, F.col("id") == F.col("node"), "left_semi").mapInArrow(bounded(_sets(weight)), "id bigint, elements binary, weights binary, size double"))
    # elements that no other document of the buckets has
    own = sets.mapInArrow(bounded(_exploded), "id bigint, element bigint, weight double").groupBy("element").agg(F.min("id").alias("node"), F.max("id").alias("other"), F.max("weight").alias("weight"))
    own = own.where("node = other").groupBy("node").agg(F.sum("weight").alias("own"))
    sizes = sets.groupBy(F.col("id").alias("node")).agg(F.min("size").alias("size"), F.max("size").alias("most"), F.count("*").alias("texts"))
    common = F.when(F.col("texts") == 1, F.col("size") - F.coalesce("own", F.lit(0.0))).otherwise(F.col("most"))  # of several texts, a bound that holds for each
    sizes = cut(sizes.join(own, "node", "left").select("node", "size", (common + 1e-6).alias("common")))  # sums of real weights are rounded
    possible = f"{DEN + NUM} * least(common, end_common) >= {NUM} * (size + end_size)"
    of_end = sizes.select(F.col("node").alias("end"), F.col("size").alias("end_size"), F.col("common").alias("end_common"))

    ends = members.select("node", F.explode(F.array("lowest", "highest")).alias("end")).where("node <> end").groupBy("node", "end").agg(F.count("*").alias("bands"))
    ends = cut(ends.join(sizes, "node").join(of_end, "end").where(possible).select("node", "end", "bands"))
    best = ends.groupBy("node").agg(F.max_by("end", F.struct("bands", -F.col("end"))).alias("end"))
    pair = (F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
    tried = cut(best.select(*pair).distinct())
    links = verified(tried, sets)
    labels = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        label = labels.select(F.col("node").alias("end"), F.col("label").alias("end_label"))
        both = pairs.join(labels, "node", "left").join(label, "end", "left")
        return both.where("coalesce(label, node) <> coalesce(end_label, end)")

    more = cut(apart(ends).select(*pair).distinct().join(tried, ["a", "b"], "left_anti"))
    links = verified(more, sets)
    labels = components(_as_links(labels).union(links))

    # only documents that have enough in common with anyone can have links
    plausible = members.select("key", "node").join(sizes.where(f"{DEN} * common >= {NUM} * size"), "node").join(labels, "node", "left")
    links = searched(regions_of(plausible.select("key", "node", F.coalesce("label", "node").alias("label"))), sets)
    labels = cut(components(_as_links(labels).union(links)))

    of_node = nodes.select("content", "node").join(labels, "node", "left").select("content", F.coalesce("label", "node").alias("class_id"))
    return (
        signed.select("id", "content")
        .join(of_node, "content")
        .select(F.col("id").alias(id_col), "class_id", (F.col("class_id").isNull() | (F.coalesce("id", F.col("class_id") - 1) == F.col("class_id"))).alias("kept"))
    )
