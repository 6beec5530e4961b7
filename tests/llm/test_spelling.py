import random
import zlib
from collections import Counter

import pytest

from turnweave.llm import spelling

DOCS = "doc_id bigint, text string, word string, n int"


def near(a, b):
    """One inserted, deleted or replaced character, by trying all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, ratio):
    out, form = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form[w], n, len(others), counts[form[w]] if form[w] else None]
    for w, row in out.items():
        root = w
        while form[root]:
            root = form[root]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def found(spark, counts, ratio=10):
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(words, ratio).collect()}


def test_variants_against_all_pairs(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(400)}
    words |= {"", "a", "aa", "aaa", "aaaa", "ÿ"}
    counts = {w: rng.choice([1, 2, 2, 5, 30, 400, 5000]) for w in sorted(words)}
    for ratio in (2, 10):
        assert found(spark, counts, ratio) == brute(counts, ratio)


def test_chains_are_followed_to_the_end(spark):
    chain = ["".join("b" if i < k else "a" for i in range(12)) for k in range(9)]
    counts = {w: 3**k for k, w in enumerate(chain)}
    rows = found(spark, counts, 3)
    assert rows == brute(counts, 3) and {r[1] for r in rows.values()} == {chain[-1]}
    assert found(spark, {"alone": 1}) == {"alone": (None, "alone", 1, 0, None)} and found(spark, {"a": 3}, 2)["a"][0] is None
    with pytest.raises(ValueError, match="ratio"):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n bigint"), 1)


def test_words_of_any_length(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé") for _ in range(size)) for size in (62, 63, 64, 65, 66, 67, 150)]
    words = set(base)
    for w in base:
        for _ in range(12):
            i = rng.randrange(len(w))
            words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdé") + w[i + 1 :], w[:i] + rng.choice("abcdé") + w[i:], w + w[-1], w[:-1]}
    counts = {w: rng.choice([2, 2, 20, 300]) for w in sorted(words)}
    assert found(spark, counts) == brute(counts, 10)
    # linear in a word's length: its square would be ten thousand million characters
    giant = "ab" * 50_000
    rows = found(spark, {giant: 2, giant[1:]: 50, giant + "c": 50, "c" + giant: 7})
    assert rows[giant] == (giant + "c", giant + "c", 2, 3, 50) and rows[giant[1:]][2:4] == (50, 1)


def counted(rows, slip_every):
    n = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "[" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if slip_every and h % slip_every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += 1
                run = ""
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def test_words_are_counted_whole(spark):
    rng = random.Random(7)
    stock = ["Wörterbuch", "dictionary", "Dictionary", "ÉTRANGER", "étranger", "short", "sevenxx", "abcdefgh", "aaaaaaaa", "Ωmega", "x×y÷zzzzz"]
    rows = [(i, " ".join(rng.choices(stock, k=60))) for i in range(80)] + [(None, "dictionary, étranger"), (3, None), (4, ""), (5, "Zq" * 30000), (6, "zQ" * 30000), (6, "zQ" * 30000)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)
    for every in (None, 3):
        assert {r.word: r.n for r in spelling.count_words(docs, slip_every=every).collect()} == counted(rows, every)
    assert spelling.variants(spelling.count_words(docs.limit(0), slip_every=31)).count() == 0
