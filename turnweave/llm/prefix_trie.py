"""The trie of conversations' prefixes, by balanced parentheses.

A conversation is a path of turns, each a 128-bit digest of its role and text. Paths are sorted as texts, so those with a
common prefix stand together, and cut into shards of consecutive paths; equal paths may be cut apart. A shard writes its
trie as parentheses, one pair a node, in preorder. Blocks over the running excess keep its least value: ``find_close``
skips blocks that cannot hold the end of a subtree. Within a subtree, ranks count leaf pairs ``()`` and conversations, and
cumulative arrays give the savings.

A node in more than one shard is a prefix of the first or the last path of each of them: on a spine. Two neighbours share
one path of nodes, from the root down, which tells what adding up their spines counts twice; so shards are joined by one
aggregation over spines, whose rows are as many as shards are long paths deep, and no shard's trie leaves its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm._session import cut, prepare

#: Turns that a shard holds on average.
SHARD_TURNS = 200_000
#: Parentheses of a block, and blocks of a block of the next level.
BLOCK = 32
#: Hexadecimal digits of a turn's digest.
_DIGITS = 32
#: Bytes of a piece of a spine's list of conversations.
_PIECE = 4000
_BATCH = 10_000

NODE = "shard int, node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends_sha256 string, ends array<string>, own bigint, path bigint, on_left boolean, on_right boolean, ends_here boolean"


class Parentheses:
    """A balanced sequence (1 opens, -1 closes) with the least excess of blocks, of blocks of blocks, and so on."""

    def __init__(self, steps: np.ndarray) -> None:
        self.steps = steps
        self.excess = np.cumsum(steps, dtype=np.int64)
        self.levels = [self.excess]
        while len(self.levels[-1]) > BLOCK:
            below = self.levels[-1]
            padded = np.full(-(-len(below) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
            padded[: len(below)] = below
            self.levels.append(padded.reshape(-1, BLOCK).min(axis=1))
        leaf = np.zeros(len(steps), np.int64)
        if len(steps):
            leaf[:-1] = (steps[:-1] == 1) & (steps[1:] == -1)
        self.leaves = np.concatenate([[0], np.cumsum(leaf)])

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where the parentheses that open at the places close: the first place after with an excess below their own."""
        wanted = self.excess[opens] - 1
        at, level = opens + 1, np.zeros(len(opens), np.int64)
        found = np.full(len(opens), -1, np.int64)
        todo = np.arange(len(opens))
        # each is at an entry of a level all of whose entries before lie after the opening and are too high
        while len(todo):
            for k, least in enumerate(self.levels):
                here = todo[level[todo] == k]
                if not len(here):
                    continue
                low = least[np.minimum(at[here], len(least) - 1)] <= wanted[here]
                hit = here[low]
                if k == 0:
                    found[hit] = at[hit]
                    level[hit] = -1
                else:
                    at[hit] *= BLOCK
                    level[hit] -= 1
                miss = here[~low]
                at[miss] += 1
                up = miss[(at[miss] % BLOCK == 0) & (k + 1 < len(self.levels))]
                at[up] //= BLOCK
                level[up] += 1
            todo = todo[level[todo] >= 0]
        return found

    def leaf_pairs(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Childless nodes from each opening to its close."""
        return self.leaves[closes + 1] - self.leaves[opens]


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each range; none is empty."""
    table = [values]
    while (1 << len(table)) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    size = high - low
    level = np.zeros(len(size), np.int64)
    for k in range(1, len(table)):
        level[size >= 1 << k] = k
    out = np.empty(len(size), values.dtype)
    for k, row in enumerate(table):
        of = level == k
        out[of] = np.minimum(row[low[of]], row[high[of] - (1 << k)])
    return out


@dataclass
class Shard:
    """The trie of sorted paths: nodes in preorder, the first is the root."""

    ids: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        ids, tokens, sizes = self.ids, self.tokens, self.sizes
        first = np.concatenate([[0], np.cumsum(sizes)])
        # turns that each path has in common with the one before
        common = np.zeros(len(ids), np.int64)
        both = np.minimum(sizes[1:], sizes[:-1])
        owner = np.repeat(np.arange(len(both)), both)
        place = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        differ = tokens[first[owner] + place] != tokens[first[owner + 1] + place]
        common[1:] = both
        np.minimum.at(common[1:], owner[differ], place[differ])
        closes = np.concatenate([[0], sizes[:-1] - common[1:]])
        opens = sizes - common
        steps = np.repeat(np.tile([-1, 1], len(ids)), np.stack([closes, opens], 1).ravel())
        steps = np.concatenate([[1], steps, np.full(sizes[-1] + 1, -1)])
        self.trie = trie = Parentheses(steps)
        self.open = np.flatnonzero(steps == 1)
        self.close = trie.find_close(self.open)
        self.depth = trie.excess[self.open] - 1
        # the place at which each path has been opened whole: its own node's, as equal paths open nothing
        self.end = np.cumsum(closes + opens)
        self.low, self.high = np.searchsorted(self.end, self.open), np.searchsorted(self.end, self.close)
        self.members = self.high - self.low
        self.conv_id = _least(ids, self.low, self.high)
        self.n_leaves = trie.leaf_pairs(self.open, self.close)
        # a node's parent is the last one before it that is one turn less deep
        nodes = np.arange(len(self.open))
        order = np.lexsort((nodes, self.depth))
        keys = self.depth * len(nodes) + nodes
        before = np.searchsorted(keys[order], keys - len(nodes)) - 1
        self.parent = order[np.maximum(before, 0)]
        self.parent[0] = -1
        self.n_children = np.bincount(self.parent[1:], minlength=len(nodes))
        # lengths of nodes' last turns: a path's opened turns are its last ones
        fresh_turn = np.arange(len(tokens)) - np.repeat(first[:-1], sizes) >= np.repeat(common, sizes)
        self.token = np.flatnonzero(fresh_turn)
        self.own = np.concatenate([[0], self.lengths[self.token]])
        cumulative = np.concatenate([[0], np.cumsum((self.members - 1) * self.own)])
        last = np.searchsorted(self.open, self.close)
        self.saved = cumulative[last] - cumulative[:-1]
        self.ending = np.searchsorted(self.open, self.end)

    def spine(self, path: int) -> np.ndarray:
        """Nodes from the root to the end of a path."""
        node, out = int(self.ending[path]), []
        while node >= 0:
            out.append(node)
            node = int(self.parent[node])
        return np.array(out[::-1])


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _pieces(ids: np.ndarray) -> list[str]:
    """The list of the ids in pieces that joined by commas are the whole."""
    step = _PIECE // 20
    return [_joined(ids[at : at + step]) for at in range(0, len(ids), step)]


_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _shard_nodes(number: int, shard: Shard) -> Iterator[pa.RecordBatch]:
    """A shard's nodes: whole ones, but for parents on a spine, and those on a spine, to be added up."""
    n = len(shard.open)
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[shard.spine(0)] = right[shard.spine(-1)] = True
    spine = left | right
    names: dict[int, bytes] = {}
    path: dict[int, int] = {}
    for node in np.flatnonzero(spine).tolist():  # in preorder, so parents come first
        up = int(shard.parent[node])
        token = b"" if up < 0 else bytes(shard.tokens[shard.token[node - 1]])
        names[node] = hashlib.sha256(names.get(up, b"") + token).digest()[:16]
        path[node] = path.get(up, 0) + int(shard.own[node])
    ends: dict[int, tuple[int, int]] = {}
    starts = np.flatnonzero(np.diff(shard.ending, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard.ids)]):
        ends[int(shard.ending[a])] = a, b
    schema = _arrow_schema()
    for at in range(0, n, _BATCH):
        rows = range(at, min(at + _BATCH, n))
        here = slice(rows.start, rows.stop)
        up = shard.parent[here]
        inner = (up >= 0) & ~spine[up]
        on = spine[here]
        hashes = [None if spine[i] else hashlib.sha256(_joined(shard.ids[slice(*ends[i])]).encode()).hexdigest() if i in ends else _NO_ENDS for i in rows]
        columns = {
            "shard": [number] * len(rows),
            "node": [names.get(i) for i in rows],
            "parent": [names.get(int(p)) for p in up],
            "depth": shard.depth[here],
            "conv_id": shard.conv_id[here],
            "parent_conv_id": pa.array(shard.conv_id[up], mask=~inner),
            "n_convs": shard.members[here],
            "n_children": shard.n_children[here],
            "n_leaves": shard.n_leaves[here],
            "saved": shard.saved[here],
            "ends_sha256": hashes,
            "ends": [_pieces(shard.ids[slice(*ends[i])]) if spine[i] and i in ends else [] for i in rows],
            "own": shard.own[here],
            "path": pa.array([path.get(i) for i in rows], pa.int64()),
            "on_left": left[here],
            "on_right": right[here],
            "ends_here": on & (shard.n_children[here] == 0),
        }
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in NODE.split(", "))])


def _tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (shard, conv_id, key, lengths) of one shard to its nodes."""
    number, ids, keys, lengths = None, [], [], []
    for batch in batches:
        if batch.num_rows:
            number = batch.column(0)[0].as_py()
            ids.append(batch.column(1).to_numpy())
            keys.append(batch.column(2))
            lengths.append(batch.column(3))
    if number is None:
        return
    sizes = np.concatenate([x.value_lengths().to_numpy() for x in lengths]).astype(np.int64)
    tokens = "".join(key for part in keys for key in part.to_pylist()).encode()
    shard = Shard(np.concatenate(ids), np.frombuffer(tokens, f"S{_DIGITS}"), sizes, np.concatenate([x.flatten().to_numpy() for x in lengths]).astype(np.int64))
    yield from _shard_nodes(number, shard)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, piece), sorted by node and order, to the digest of each node's pieces joined by commas."""
    node, state = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for here, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if here != node:
                if node is not None:
                    yield told()
                node, state = here, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if node is not None:
        yield told()


def paths(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's turns as an array of (digest, bytes of the text), in order.

    Ordered by turn, nulls first; of equal turns by the digest. A null role or text counts as empty. Rows without a
    conversation's id belong to none and are left out. Repeated rows are turns each.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    # the role's length keeps apart what role and text would run together
    digest = F.left(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(_DIGITS))
    f = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("conv_id"), F.struct(F.col(turn_col).cast("bigint").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes")).alias("t"))
    f = f.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))  # nulls come first
    return f.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of ``conv_id, turns`` as ``paths`` gives them, of different ids; ``turns`` may be empty.

    ``conv_id`` the smallest member, ``depth``, ``parent_conv_id`` the parent's, null for the root, ``n_convs`` members,
    ``n_children``, ``n_leaves`` childless nodes in the subtree, ``saved_tokens`` the subtree's sum of (members - 1) times
    the bytes of the last turn's text, ``ends_sha256`` the digest of the ids that end here, ascending, joined by commas.
    Equal conversations are members of the same nodes. An empty table gives an empty result, without a root.
    """
    spark = conversations.sparkSession
    prepare(spark)
    flat = conversations.select(F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("key"), "conv_id", F.transform("turns", lambda t: t["bytes"]).alias("lengths"))
    flat = cut(flat)
    total = flat.agg(F.sum(F.size("lengths") + 1)).first()[0] or 0
    sorted_ = flat.repartitionByRange(max(1, -(-total // shard_turns)), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    nodes = cut(sorted_.select(F.spark_partition_id().alias("shard"), "conv_id", "key", "lengths").mapInArrow(_tries, NODE))

    spine = nodes.where("node IS NOT NULL")
    # what neighbouring shards share is a path of nodes, which both have counted
    before = spine.where("depth = 0").select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("before"))  # a row a shard
    left = spine.where("on_left").join(before, "shard")
    right = spine.where("on_right").select(F.col("shard").alias("before"), "node", F.col("ends_here").alias("leaf_before"))
    shared = cut(left.join(right, ["before", "node"]).select("shard", "node", "depth", "own", "path", "leaf_before"))
    deepest = shared.groupBy("shard").agg(F.max(F.struct("depth", "path", "leaf_before")).alias("last"))
    twice = shared.join(deepest, "shard").select(
        "node",
        (F.col("depth") < F.col("last.depth")).cast("bigint").alias("children"),
        F.col("last.leaf_before").cast("bigint").alias("leaves"),
        (F.col("last.path") - F.col("path") + F.col("own")).alias("bytes"),
    )
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    parts = spine.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved")
    counted_twice = twice.select("node", none("binary", "parent"), none("bigint", "depth"), none("bigint", "conv_id"), F.lit(0).alias("n_convs"), (-F.col("children")).alias("n_children"), (-F.col("leaves")).alias("n_leaves"), F.col("bytes").alias("saved"))
    whole = parts.union(counted_twice).groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")))
    pieces = spine.select("node", "shard", F.posexplode("ends").alias("nth", "piece")).repartition("node").sortWithinPartitions("node", "shard", "nth")
    digests = pieces.select("node", "piece").mapInArrow(_digests, "node binary, ends_sha256 string")
    whole = cut(whole.join(digests, "node", "left"))
    smallest = whole.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"]
    spines = whole.join(smallest, F.col("parent") == F.col("of"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS))).select(columns)
    inner = nodes.where("node IS NULL")
    # a shard's children of its own spine, however many children the node has in all
    near = spine.select("shard", "node").join(smallest, F.col("node") == F.col("of")).select("shard", F.col("node").alias("parent"), "parent_conv_id")
    below = inner.where("parent IS NOT NULL").drop("parent_conv_id").join(near, ["shard", "parent"]).select(columns)
    return spines.union(below).union(inner.where("parent IS NULL").select(columns))
