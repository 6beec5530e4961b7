import hashlib
import random

import numpy as np
import pytest

from turnweave.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(conversations):
    """From every prefix of every conversation; a turn is (role, text)."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: {q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p} for p in members}
    rows = set()
    for p, of in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in of if len(conversations[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        rows.add((min(of), len(p), parent, len(of), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def rows_of(frame):
    rows = [tuple(r[c] for c in COLUMNS) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(spark, conversations):
    rows = [(c, n, r, t, "x") for c, turns in conversations.items() for n, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, key string")


def test_parentheses_against_a_stack():
    rng = np.random.default_rng(2)
    for size in (1, 2, 31, 32, 33, 500, 40_000):
        steps, depth = [], 0
        for _ in range(size):
            up = depth == 0 or rng.random() < (0.9 if depth < size // 3 else 0.4)
            steps.append(1 if up else -1)
            depth += steps[-1]
        steps = np.array(steps + [-1] * depth)
        trie, stack, close = prefix_trie.Parentheses(steps), [], {}
        for i, s in enumerate(steps.tolist()):
            if s == 1:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(steps == 1)
        closes = trie.find_close(opens)
        assert closes.tolist() == [close[i] for i in opens.tolist()]
        some = rng.choice(len(opens), min(50, len(opens)))
        leaves = [sum(steps[i] == 1 and steps[i + 1] == -1 for i in range(opens[k], closes[k])) for k in some]
        assert trie.leaf_pairs(opens[some], closes[some]).tolist() == leaves


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 10_000])
def test_nodes_against_all_prefixes(spark, shard_turns):
    rng = random.Random(shard_turns)
    said = [("user", "a"), ("user", "é"), ("assistant", "a"), ("", ""), ("user:", "x")]
    conversations = {c: [rng.choice(said[: rng.randint(1, 5)]) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))] for c in range(1, 70)}
    conversations |= {c: [("user", "same"), ("assistant", "again")] for c in range(100, 140)}  # copies that shards cut apart
    conversations |= {c: [("user", "same"), ("assistant", "again"), ("user", str(c % 3))] for c in range(200, 212)}
    conversations[-4] = [("user", "deep")] * 120
    found = rows_of(prefix_trie.trie(prefix_trie.paths(table(spark, conversations)), shard_turns))
    assert found == brute(conversations)


def test_conversations_without_turns_and_edges(spark):
    own = prefix_trie.paths(table(spark, {1: [("u", "a")], 2: [("u", "a"), ("v", "b")]}))
    bare = own.union(spark.createDataFrame([(9, []), (8, [])], own.schema))
    assert rows_of(prefix_trie.trie(bare, 1)) == brute({1: [("u", "a")], 2: [("u", "a"), ("v", "b")], 8: [], 9: []})
    assert rows_of(prefix_trie.trie(own.limit(0))) == set()
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(5, 1, "user", "second"), (5, None, None, None), (5, 0, "user", "Ω" * 50_000), (None, 0, "user", "lost"), (6, 3, None, None), (6, 3, None, None)]
    told = {5: [("", ""), ("user", "Ω" * 50_000), ("user", "second")], 6: [("", ""), ("", "")]}
    assert rows_of(prefix_trie.trie(prefix_trie.paths(spark.createDataFrame(rows, schema)))) == brute(told)
    only_empty = spark.createDataFrame([(3, []), (4, [])], own.schema)
    assert rows_of(prefix_trie.trie(only_empty)) == brute({3: [], 4: []})
