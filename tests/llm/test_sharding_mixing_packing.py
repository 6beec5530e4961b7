import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnweave.llm import mixing, packing
from turnweave.llm.sharding import interleave

SCHEMA = "doc_id bigint, text string, lang string, source string, bucket int, mix string"


def table(spark, n=700):
    rng = random.Random(12)
    rows = [(i, "é " * rng.randint(0, 30) + "x", rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b", None]), 1, "m") for i in range(n)]
    rows += [(None, None, None, None, None, None), (n, "", "en", "rare", 1, ""), (n, "", "en", "rare", 1, "")]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("bucket_rows", [20, 2000])
def test_shards(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr("turnweave.llm.sharding.BUCKET_ROWS", bucket_rows)
    docs, rows = table(spark)
    found = interleave(docs, 16).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in found)
    source = {r[0]: r[3] for r in rows}
    for s in ("hot", "a", "b", None):
        per_shard = Counter(r.shard for r in found if source[r.doc_id] == s)
        assert max(per_shard.values()) - min(per_shard[n] for n in range(16)) <= 2
    # ranks within the sources are those of a plain sort, so fractional ranks ascend along the shards
    digest = lambda i: hashlib.md5(f"7|{'' if i is None else i}|{hashlib.md5(text[i]).hexdigest()}".encode()).hexdigest()[:10]
    order = sorted((r for r in found), key=lambda r: (r.shard, r.slot))
    for s in ("hot", "a", "b"):
        own = [digest(r.doc_id) for r in order if source[r.doc_id] == s]
        assert own == sorted(own)


def test_shards_of_rows_alike_and_without_ids(spark, monkeypatch):
    """A third of the rows alike, a third without ids: no bucket holds them all, and each row has its own slot."""
    monkeypatch.setattr("turnweave.llm.sharding.BUCKET_ROWS", 50)
    rows = [(5, "same", "en", "s", 1, "")] * 1000 + [(None, f"text {n}", "en", "s", 1, "") for n in range(1000)] + [(n, "t", "en", f"s{n % 400}", 1, "") for n in range(1000)]
    found = interleave(spark.createDataFrame(rows, SCHEMA), 7).collect()
    assert sorted(Counter(r.shard for r in found).values()) == [428] * 3 + [429] * 4
    assert len({(r.shard, r.slot) for r in found}) == 3000
    assert Counter(str(r.doc_id) for r in found) == Counter(str(r[0]) for r in rows)


def test_shards_of_few_rows(spark):
    docs, _ = table(spark, 3)
    assert interleave(docs.limit(3), 16).select("slot").distinct().count() == 1
    assert interleave(docs.where("false"), 16).count() == 0


def test_fit_meets_targets():
    rng = random.Random(3)
    cells = {(s, x, t): rng.uniform(1, 100) for s in "abc" for x in "de" for t in "fgh"}
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"d": 0.6, "e": 0.4}, {"f": 0.1, "g": 0.1, "h": 0.8}]
    fitted, worst = mixing.fit(cells, targets)
    assert worst < mixing.TOLERANCE
    for axis, target in enumerate(targets):
        for value, share in target.items():
            assert abs(sum(w for k, w in fitted.items() if k[axis] == value) / sum(fitted.values()) - share) < 1e-6


@pytest.mark.parametrize("targets", [None, {"source": {"hot": 0.2, "a": 0.8}}])
def test_mix(spark, targets):
    docs, rows = table(spark)
    small = mixing.mix(docs, targets=targets, name="m").select("doc_id", "mix", "m.*").collect()
    large = mixing.mix(docs, targets=targets, driver_cells=0, name="m").select("doc_id", "mix", "m.*").collect()
    assert len(small) == len(large) == len(rows)
    assert Counter(r.mix for r in small) == Counter(r[5] for r in rows)  # the table's own column of a clashing name
    assert mixing.mix(docs, targets=targets).columns == [*docs.columns, "mix_"]
    key = lambda r: (str(r.doc_id), r.weight)
    for a, b in zip(sorted(small, key=key), sorted(large, key=key)):
        assert abs(a.weight - b.weight) < 1e-8 * a.weight and a.copies == b.copies
    assert max(r.probability for r in small) == 1.0 and all(r.sampled for r in small if r.probability == 1.0)
    expected, sampled = sum(r.tokens * r.probability for r in small), sum(r.tokens for r in small if r.sampled)
    assert abs(expected - sampled) < 0.1 * expected
    assert mixing.mix(docs.where("false")).count() == 0


@pytest.mark.parametrize("driver_cells", [0, 1000])
def test_targets_of_zero_absent_and_contradicting(spark, driver_cells):
    rows = [(i, "x" * (40 + i % 7), "en" if i % 3 else "de", "ab"[i % 2], 1) for i in range(600)] + [(900, None, "fr", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, weight int")
    axes = lambda: {"source": F.col("source"), "lang": F.col("lang")}

    def shares(targets, axis, **more):
        found = mixing.mix(docs, axes(), targets, driver_cells=driver_cells, **more).select("source", "lang", "mix.*").collect()
        assert len(found) == len(rows) and all(r.weight >= 0 for r in found)
        sums = Counter()
        for r in found:
            sums[r[axis]] += r.weight * r.tokens
        return {k: v / sum(sums.values()) for k, v in sums.items()}, found

    got, found = shares({"source": {"a": 1.0, "b": 0.0, "c": 0.0}, "lang": {"en": 1.0, "de": 1.0, "fr": 0.0}}, "source", strict=True)
    assert abs(got["a"] - 1) < 1e-6 and got["b"] == 0 and all(r.copies == 0 and not r.sampled for r in found if r.source == "b")
    got, _ = shares({"source": {"a": 3.0, "b": 1.0, "nowhere": 6.0, None: 2.0}}, "source", sweeps=3)
    assert abs(got["a"] / got["b"] - 3) < 0.1
    assert mixing._complete({"a": 4.0, "b": 2.0, "c": 4.0}, {"b": 0.0}, 1.0) == {"a": 0.5, "b": 0.0, "c": 0.5}
    # all of c is in French, so neither can have its share while the other has another one
    contradiction = {"source": {"a": 0.5, "b": 0.5, "c": 0.0}, "lang": {"en": 0.4, "de": 0.4, "fr": 0.2}}
    with pytest.warns(UserWarning, match="apart after 2 sweeps"):
        shares(contradiction, "source", sweeps=2)
    with pytest.raises(ValueError, match="apart"):
        shares(contradiction, "source", sweeps=2, strict=True)
    for bad in ({"source": {"a": -1.0}}, {"source": {"a": float("nan")}}, {"colour": {"a": 1.0}}, {"source": {"a": 0.0, "b": 0.0, "c": 0.0}}):
        with pytest.raises(ValueError):
            shares(bad, "source")


def test_topics_are_words(spark):
    rows = [(n, f"{'apple' if n % 20 == 0 else 'xx'} Banana{'' if n % 12 else ' BANANA'} {'apples' if n % 25 == 0 else ''} every", "") for n in range(300)]
    rows = [(n, t if n % 12 == 0 or n % 25 == 0 or n % 20 == 0 else "every", s) for n, t, s in rows] + [(None, None, ""), (-1, "", ""), (-2, "apple apples apples pineapple", "")] + [(-9 - n, "élans élans apple", "") for n in range(9)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, source string, lang string")
    words = mixing.topic_words(docs)
    lists = [re.findall("[a-zé]{5,}", (t or "").lower()) for _, t, _ in rows]
    df = Counter(w for x in lists for w in set(x))
    assert {"apple", "apples", "élans"} <= set(words)
    assert words == sorted((w for w, n in df.items() if 0.01 * len(rows) <= n <= 0.1 * len(rows)), key=lambda w: (-df[w], w))[: mixing.TOPICS]
    assert mixing.topic_words(docs, topics=1) == words[:1] and mixing.topic_words(docs, topics=None) == words
    found = {r.doc_id: r.topic for r in docs.select("doc_id", mixing.topic(F.col("text"), words).alias("topic")).collect()}
    for (i, _, _), own in zip(rows, lists):
        times = [(-own.count(w), n, w) for n, w in enumerate(words) if w in own]
        assert found[i] == (min(times)[2] if times else "other")
    assert mixing.mix(docs.where("text IS NULL")).first()["mix"]["copies"] == 1


def test_one_rare_row_does_not_thin_out_the_rest(spark):
    rng = random.Random(14)
    rows = [(i, "x" * rng.randint(600, 3000), rng.choice(["en", "en", "de"]), rng.choice("aab")) for i in range(3000)]
    docs = lambda more: spark.createDataFrame(rows + more, "doc_id bigint, text string, lang string, source string")
    kept = {}
    for more in ([], [(9000, "rare", "en", "once")], [(9000, None, None, None)]):
        found = mixing.mix(docs(more)).select("doc_id", "source", "mix.*").collect()
        own = [r for r in found if r.doc_id < 9000]
        kept[str(more)] = sum(r.sampled for r in own) / len(own)
        total = sum(r.tokens for r in found)
        assert abs(sum(r.tokens * r.weight for r in found) - total) < 1e-6 * total
        assert abs(sum(r.tokens * r.copies for r in found) - total) < 0.03 * total
        assert all(int(r.weight) <= r.copies <= int(r.weight) + 1 and r.sampled == (r.copies > 0) for r in found)
        assert all(r.probability == min(1.0, r.weight) for r in found)
        for r in found:
            if r.doc_id == 9000:
                assert r.weight > 2 and r.copies >= 2
        again = Counter(r.doc_id for r in mixing.repeated(mixing.mix(docs(more))).collect())
        assert again == {r.doc_id: r.copies for r in found if r.copies}
    assert min(kept.values()) > 0.9 and max(kept.values()) - min(kept.values()) < 0.02


def test_pieces_lie_at_borders_of_code_points(spark):
    rng = random.Random(8)
    texts = [None, "", "abcd", "abcde", "\U0001f600" * 9, *("".join(rng.choices("aé水\U0001f600", k=rng.randint(0, 90))) for _ in range(200))]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id bigint, text string")
    for longest in (4, 7, 32):
        for r in docs.select("text", packing.pieces(F.col("text"), longest).alias("p")).collect():
            text = r.text or ""
            cut = [text[p.start : p.start + p.chars] for p in r.p]
            assert "".join(cut) == text and [len(c.encode()) for c in cut] == [p.bytes for p in r.p]
            assert all(p.bytes <= longest for p in r.p) and all(p.bytes > longest - 4 for p in r.p[:-1])


def test_packed_bins(spark):
    rng = random.Random(5)
    rows = [(i, "xé" * rng.choice([0, 1, 300, 2000, 9000, 60000]), "k") for i in range(400)] + [(None, None, None), (None, "no id", None), (7, "dup", ""), (7, "dup", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bin string")
    packed = packing.pack(docs)
    found = packed.collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        bins[r.pack_group, r.bin].append(r)
        pieces[r.doc_id].append(r)
    for held in bins.values():
        held.sort(key=lambda r: (r.bin_offset, r.bytes))
        total, capacity = sum(r.bytes for r in held), held[0].capacity
        assert {(r.bin_bytes, r.capacity) for r in held} == {(total, capacity)}
        assert capacity == min(c for c in packing.LENGTHS if c >= total)
        assert all(a.bin_offset + a.bytes == b.bin_offset for a, b in zip(held, held[1:])) and held[0].bin_offset == 0
    assert sorted(r.copy for r in found if r.doc_id == 7 and r.bytes == 3) == [1, 2]
    # several lengths cost no more than the longest alone, and best fit wastes little
    alone = packing.Packer()
    for size in sorted((r.bytes for r in found), reverse=True):
        alone.put(size)
    assert sum(packing.cost(b[0].capacity) for b in bins.values()) <= sum(map(packing.cost, alone.downsized()))
    # bins can be built, and hold each text once, whole
    told = packing.with_texts(packed, docs)
    whole = defaultdict(str)
    for r in sorted(told.collect(), key=lambda r: r.piece):
        assert len(r.text) == r.chars and len(r.text.encode()) == r.bytes
        whole[r.doc_id, r.text_hash, r.copy] += r.text
    assert sorted(whole.values()) == sorted(r[1] or "" for r in rows)
    built = {(r.pack_group, r.bin): r for r in packing.bin_texts(told).collect()}
    assert set(built) == set(bins)
    assert all(sum(len(t.encode()) for t in b.texts) == bins[k][0].bin_bytes <= b.capacity for k, b in built.items())
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_equal_rows_are_dealt_over_groups(spark):
    found = packing.pack(spark.range(120_000).select(F.lit(3).cast("bigint").alias("doc_id"), F.lit("one text").alias("text")))
    sizes = [r["count"] for r in found.groupBy("pack_group").count().collect()]
    assert len(sizes) == 6 and sum(sizes) == 120_000 and max(sizes) < 22_000


def test_best_fit_against_a_scan():
    rng = random.Random(6)
    packer, rooms = packing.Packer(fill=0.8), []
    for _ in range(2000):
        size = min(packing.LENGTHS[-1], int(rng.expovariate(1 / 3600)))
        fitting = [r for r in rooms if r >= size]
        n = len(packer.filled)
        b = packer.put(size)
        if fitting:
            assert b < n
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - size)
        else:
            assert b == n
            rooms.append(packer.capacity[b] - size)
        rooms = [r for r in rooms if r > 0]
