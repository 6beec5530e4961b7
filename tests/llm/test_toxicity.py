import random
import re
from collections import Counter

import numpy as np
import pytest

from turnweave.llm import toxicity

DOCS = "doc_id bigint, text string, term string, toxic int"


def corpus(n=900):
    rng = random.Random(13)
    # a vocabulary of a corpus' kind: no word but the first few is in more than a twentieth of the texts
    plain, bad = [f"w{k}" for k in range(3000)], ["vile", "scoundrel", "wretch", "vermin", "cur", "knave", "oaf", "dolt"]
    often = [1 / (k + 30) for k in range(3000)]
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        words = rng.choices(plain, often, k=rng.randint(3, 80))
        for _ in range(rng.randint(2, 6) if toxic else 0):
            words.insert(rng.randint(0, len(words)), bad[i % 8].capitalize() + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(words), "t", 5))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_calibration(spark):
    rows, labels = corpus()
    known = [x for x in labels if x[0] % 3 != 1] + [(None, 1), (5, None), (10**9, 1)]
    rows += [(-1, None, "", 1), (-2, "", "", 1), (-3, "VILE scoundrel " * 20000, "", 1), (None, "vile", "", 1)]
    found = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(known, "doc_id bigint, toxic int")).collect()}
    assert len(found) == len(rows)
    held = [(found[i].score, y) for i, y in labels if i % 3 == 1]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.97
    assert np.mean([(s - y) ** 2 for s, y in held]) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    assert found[-1].score == found[-2].score < 0.3 and found[-3].score > 0.7 and found[-3].evidence[0].toxic == 1


def test_search_is_exact():
    rng = np.random.default_rng(1)
    n, width = 700, 60
    index = toxicity.Index(np.arange(width, dtype=np.uint64), rng.uniform(0.5, 3, width))
    lists = [np.sort(rng.choice(width, rng.integers(0, 6), replace=False)) for _ in range(n)]
    ends, features = np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists)
    counts = rng.integers(1, 4, len(features))
    weights = index.unit(ends, features, counts)
    index.build(np.arange(n), rng.integers(0, 2, n), ends, features, weights)
    rows = np.repeat(np.arange(n), np.diff(ends))
    dense = np.zeros((n, width))
    dense[rows, features] = weights
    cosines = dense @ dense[index.ids].T
    own = np.argsort(index.ids)
    cosines[np.arange(n), own] = 0
    visited = []
    scored = index._scored
    index._scored = lambda *x: (visited.append(len(x[0])), scored(*x))[1]
    for part, places, found in index.search(list(range(n)), ends, features, counts):
        for row, p, c in zip(range(part.start, part.stop), places, found):
            keyed = sorted(((-round(x, toxicity.DECIMALS), i) for i, x in enumerate(cosines[row]) if x > 1e-12))[: toxicity.NEIGHBOURS]
            assert [i for _, i in keyed] == p[c > 0].tolist()
            assert np.allclose([-x for x, _ in keyed], c[c > 0])
    assert sum(visited) < n * -(-n // toxicity.BLOCK)  # bounds leave blocks out


def test_whole_operator_equals_dense_brute_force(spark):
    """300 documents: terms, document frequencies, vectors, neighbours, votes and calibration by plain loops."""
    rng = random.Random(4)
    words = [f"{rng.choice('abcdef')}{rng.choice('ghijk')}{k:03d}é{rng.choice('xyz')}" for k in range(900)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (n + 3) for n in range(900)], k=rng.randint(0, 90))).upper(), "", 0) for i in range(300)]
    labels = [(i, int(rng.random() < 0.3)) for i in range(200)]
    found = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}

    def terms(text):
        low = "".join(c.lower() if c.isascii() else c for c in text).encode()
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", low):
            yield w
            yield from ((w[:n], n) for n in toxicity.PREFIXES if len(w) > n)

    bags = [Counter(terms(text)) for _, text, _, _ in rows]
    df = Counter(t for b in bags for t in b)
    kept = [t for t, n in df.items() if toxicity.LEAST_SHARE * 300 <= n <= max(toxicity.MOST_SHARE * 300, toxicity.FEW_DOCUMENTS)]
    dense = np.array([[b[t] * np.log(300 / df[t]) for t in kept] for b in bags])
    norms = np.linalg.norm(dense, axis=1)
    dense = dense / np.where(norms > 0, norms, 1)[:, None]
    toxic = np.array([y for _, y in labels], float)
    base = (toxic.sum() + 0.5) / 201

    def vote(i):
        cosines = np.round(dense[:200] @ dense[i], toxicity.DECIMALS)
        near = [n for n in np.argsort(-cosines, kind="stable") if n != i and cosines[n] > 0][: toxicity.NEIGHBOURS]
        w = np.array([1 / (1 - cosines[n] + toxicity.NEAR) for n in near])
        return (w @ toxic[near] + toxicity.PRIOR_WEIGHT * base) / (w.sum() + toxicity.PRIOR_WEIGHT) if near else base

    bare = norms == 0
    x = np.array([np.log(vote(i) / (1 - vote(i))) for i in range(200) if not bare[i]])
    y = toxic[~bare[:200]]
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    b = np.array([1.0, 0.0])
    for _ in range(20000):  # plain gradient descent to the same optimum
        p = 1 / (1 + np.exp(-(b[0] * x + b[1])))
        b = b - 0.02 * (np.array([((p - target) * x).sum(), (p - target).sum()]) + 0.1 * (b - np.array([1.0, 0.0])))
    slope = max(b[0], 1e-3)
    without = (toxic[bare[:200]].sum() + base) / (bare[:200].sum() + 1)
    for i in range(300):
        v = vote(i)
        want = without if bare[i] else 1 / (1 + np.exp(-(slope * np.log(v / (1 - v)) + b[1])))
        # neighbours at equal cosines may differ in order at the end of the list
        assert abs(found[i].score - want) < 1e-6, i
        assert all(e.doc_id != i for e in found[i].evidence)


def test_rare_insult_and_repeated_ids(spark):
    rows, labels = corpus()
    for i in (3, 6, 9):  # three labelled examples and one text that has no label
        rows[i] = (i, rows[i][1] + " blackguard blackguard blackguard blackguard", "t", 5)
        labels[i] = (i, 1)
    rows += [(5000, "w1000 blackguard blackguard blackguard", "", 0), (3, None, "", 0), (7, rows[7][1], "", 0), (7, "another text", "", 0)]
    known = spark.createDataFrame([x for x in labels if x[0] % 3 != 1], "doc_id bigint, toxic int")
    found = toxicity.score(spark.createDataFrame(rows, DOCS), known).collect()
    assert len(found) == len(rows)
    assert next(r for r in found if r.doc_id == 5000).score > 0.7
    assert sorted(map(str, found)) == sorted(map(str, toxicity.score(spark.createDataFrame(rows[::-1], DOCS).repartition(3), known).collect()))


@pytest.mark.parametrize("labels", [[], [(0, 0), (1, 0)], [(0, 1)]])
def test_no_contrast(spark, labels):
    rows, _ = corpus(5)
    found = toxicity.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len({r.score for r in found}) == 1 and len(found) == 5
    assert toxicity.score(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")).count() == 0
