import random
from collections import Counter
from pathlib import Path

import corpus_pipeline as cp
from tests.llm.test_near_dedup import brute, edited
from tests.llm.test_quality_pii_license import measured
from turnweave.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, mix string, lost int, ledger string, stays bigint, digest string"


def rows():
    rng = random.Random(21)
    vocabulary = [f"Word{n}" for n in range(500)]
    out = []
    for n in range(25):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([10, 60, 200])))
        for _ in range(rng.randint(1, 4)):
            out.append((len(out), edited(rng, base, rng.choice([0, 0, 0.01])), "en", f"s{n % 3}", 1, "m", 1, f"l{len(out)}", 7, "d"))
    return out + [(900, out[0][1].upper(), "en", None, None, None, None, None, None, None), (901, None, None, None, None, None, None, None, None, None), (902, "", None, None, 0, "", 0, "", 0, "")]


def test_stages_against_brute_force(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    ids = lambda frame: sorted(str(r.doc_id) for r in frame.collect())
    kept = rows()
    good = cp.quality_rules(spark, docs, "")
    kept = [r for r in kept if (m := measured(r[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    assert good.columns == docs.columns and ids(good) == sorted(str(r[0]) for r in kept)
    last = {}
    for r in kept:
        last[r[1].lower()] = max(r, last.get(r[1].lower(), r))
    exact = cp.exact_duplicates(spark, good, "")
    kept = list(last.values())
    assert exact.columns == docs.columns and ids(exact) == sorted(str(r[0]) for r in kept)
    near = cp.near_duplicates(spark, exact, "")
    classes = brute(kept)
    assert near.columns == docs.columns and ids(near) == sorted(str(i) for i, c in classes.items() if i == c)
    mixed = cp.mixing_weights(spark, near, "")
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(near)) and mixed.count() > 0
    # columns that are named as the operators' own keep their values
    whole = {r[0]: r for r in rows()}
    for stage in (good, exact, near, mixed):
        assert all(tuple(r) == whole[r.doc_id] for r in stage.collect())
    copies = Counter(str(r.doc_id) for r in mixed.collect())
    packed = cp.best_fit_packing(spark, mixed, "").collect()
    assert Counter(str(r.doc_id) for r in packed if r.piece == 0) == copies
    assert all(r.text == whole[r.doc_id][1][r.start : r.start + r.chars] for r in packed)


def test_run_is_its_stages(spark, tmp_path):
    """The whole run gives what brute force gives for each stage in turn, but for the draw of the mixture."""
    spark.createDataFrame([r[:5] for r in rows()], ", ".join(SCHEMA.split(", ")[:5])).write.parquet(str(tmp_path / "documents.parquet"))
    found = cp.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows() if (m := measured(r[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    last = {}
    for r in kept:
        last[r[1].lower()] = max(r, last.get(r[1].lower(), r))
    left = {i: t for i, t, *_ in last.values()}
    left = {i: left[i] for i, c in brute(list(last.values())).items() if i == c}
    docs = spark.createDataFrame([r[:5] for r in rows() if r[0] in left], ", ".join(SCHEMA.split(", ")[:5]))
    copies = {r.doc_id: r.mix.copies for r in mixing.mix(docs).collect() if r.mix.copies}
    assert Counter(r.doc_id for r in found if r.piece == 0) == copies
    for i, n in copies.items():
        own = sorted((r.copy, r.piece, r.text) for r in found if r.doc_id == i)
        assert "".join(t for _, _, t in own) == left[i] * n
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert [sorted(p.name for p in f.iterdir()) for f in Path(folder).glob("corpus-*")] == [["3_mixing"]]


def test_repeated_and_missing_ids(spark):
    odd = [(i, t, "", "", 1, "", 1, "", 1, "") for i, t in ((1, "a"), (1, "a"), (1, "b"), (None, "A"), (None, "c"), (2, "B"))]
    found = cp.exact_duplicates(spark, spark.createDataFrame(odd, SCHEMA), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in found) == [("1", "a"), ("2", "B"), ("None", "c")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
