import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from turnweave.llm import _words
from turnweave.llm import near_dedup as nd

SCHEMA = "doc_id bigint, text string, key string, node int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(rows):
    label = {}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)

    sets = []
    for i, t, *_ in rows:
        w = words(t)
        label[i] = i
        sets.append((i, tuple(w), Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()))
    for (i, v, a), (j, w, b) in combinations(sets, 2):
        if v == w or 5 * sum((a & b).values()) >= 4 * sum((a | b).values()) > 0:
            join(i, j)
    return {i: find(i) for i in label}


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"e{rng.randint(0, 9999)}" for w in text.split())


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{n}" for n in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for n in range(30):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 120, 400])))
        if n % 3 == 0:
            base += " " + passage
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04])), "k", 1))
    base = " ".join(rng.choice(vocabulary) for _ in range(150))
    rows += [(len(rows) + n, edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05])), "k", 1) for n in range(120)]
    rows += [(len(rows) + n, t, None, None) for n, t in enumerate([None, "", " \n", "one", "ONE", "one two", "a a a a a a a a a a", "a a a a a a a a a a a"])]
    return rows


def test_same_classes_as_brute_force(spark):
    rows = corpus()
    found = nd.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in found} == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in found)


def test_rows_without_ids_and_empty_table(spark):
    found = nd.near_dedup(spark.createDataFrame([(None, "a b c", "", 1), (None, "other", "", 1), (4, "a b c", "", 1), (4, "a b c", "", 1)], SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.kept) for r in found) == [("4", "4", True), ("4", "4", True), ("None", "4", False), ("None", "None", True)]
    assert nd.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(n, n + 1) for n in range(200, 260)]
    label = {x: x for p in links for x in p}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.label for r in nd.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {k: v for k, v in label.items() if k in found}
    assert {k for k, v in label.items() if k != v} <= set(found)


def test_coordinates_agree_as_often_as_weighted_jaccard():
    rng = random.Random(8)
    a = [f"w{rng.randint(0, 30)}" for _ in range(300)]
    b = a[:220] + [f"v{rng.randint(0, 30)}" for _ in range(80)]
    sets = [Counter(tuple(x[k : k + 5]) for k in range(296)) for x in (a, b)]
    true = sum((sets[0] & sets[1]).values()) / sum((sets[0] | sets[1]).values())
    elements, rows, often = nd.shingles(*_words.word_hashes(pa.array([" ".join(a), " ".join(b)])))
    assert often.sum() == 592 and len(np.unique(elements)) == len(sets[0] | sets[1])
    signature = nd.signatures(elements, nd.WEIGHTS["count"](often), rows, 2, k=4000)
    assert abs((signature[0] == signature[1]).mean() - true) < 4 * (true * (1 - true) / 4000) ** 0.5


@pytest.mark.parametrize("scale", [0.3, 1.0, 40.0])
def test_real_weights(scale):
    """Weights of any size and unlike each other; the cost does not follow the total weight."""
    rng = np.random.default_rng(5)
    elements, k = rng.integers(0, 1 << 63, 60).astype(np.uint64), 6000
    x, y = rng.lognormal(0, 1, 60) * scale, rng.lognormal(0, 1, 60) * scale
    x[:20], y[40:] = y[:20], 0
    present = y > 0
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    rows = np.concatenate([np.zeros(60, np.int64), np.ones(int(present.sum()), np.int64)])
    signature = nd.signatures(np.concatenate([elements, elements[present]]), np.concatenate([x, y[present]]), rows, 2, k)
    assert abs((signature[0] == signature[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5


def block_made(n, seed=6):
    """Documents of 9 of 12 blocks of words each, in order: most pairs are alike, few reach the similarity."""
    rng = random.Random(seed)
    blocks = [" ".join(f"b{k}w{rng.randint(0, 99999)}" for _ in range(25)) for k in range(12)]
    return [(i, " ".join(blocks[k] for k in sorted(rng.sample(range(12), 9))) + " " + " ".join(f"own{i}x{m}" for m in range(rng.choice([1, 8]))), "", 0) for i in range(n)]


def test_candidate_rows_are_linear(spark, monkeypatch):
    rows = {}
    for n in (200, 400, 800):
        seen = []
        plain = nd.searched
        monkeypatch.setattr(nd, "searched", lambda regions, sets, plain=plain, seen=seen: (seen.append(regions.count()), plain(regions, sets))[1])
        docs = block_made(n)
        found = {r.doc_id: r.class_id for r in nd.near_dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
        monkeypatch.setattr(nd, "searched", plain)
        rows[n] = seen[0]
        if n == 200:
            assert found == brute(docs)
    assert all(seen <= n for n, seen in rows.items())


def test_log_weights_and_long_texts(spark):
    long = " ".join(f"w{n % 7000}" for n in range(60_000))
    rows = [(1, long, "", 0), (2, long + " and more", "", 0), (3, "one two three four five six " * 40, "", 0), (4, "one two three four five six " * 60, "", 0)]
    found = lambda weight: {r.doc_id: r.class_id for r in nd.near_dedup(spark.createDataFrame(rows, SCHEMA), weight=weight).collect()}
    assert found("count") == {1: 1, 2: 1, 3: 3, 4: 4} and found("log") == {1: 1, 2: 1, 3: 3, 4: 3}


def test_signature_does_not_depend_on_the_batch():
    texts = ["a b c d e f g", "x", None, "a b c d e f g h i j " * 50]
    def signed(texts):
        elements, rows, often = nd.shingles(*_words.word_hashes(pa.array(texts, pa.string())))
        return nd.signatures(elements, nd.WEIGHTS["count"](often), rows, len(texts))

    whole = signed(texts)
    for n, t in enumerate(texts):
        alone = signed([t])
        assert (alone[0] == whole[n]).all()


@pytest.mark.parametrize("window", [7, 64, 1 << 20])
def test_words(monkeypatch, window):
    monkeypatch.setattr(_words, "WINDOW", window)
    monkeypatch.setattr(_words, "_POWERS", (_words._powers(window + 1, _words._BASE), _words._powers(window + 1, pow(_words._BASE, -1, 1 << 64))))
    texts = ["ab cd", None, "", "  ", "é\tÉ\x0bab", "x" * 50, "AB" + "\n" * 40 + "cd e", "next"]
    hashes, offsets = _words.word_hashes(pa.array(texts))
    seen = {}
    for n, t in enumerate(texts):
        own = words(t)
        assert len(own) == offsets[n + 1] - offsets[n]
        for w, h in zip(own, hashes[offsets[n] : offsets[n + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
