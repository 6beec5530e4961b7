import random

import pytest

from turnweave.operators.overlap import assign_speakers, overlap_pairs
from turnweave.plans.transcripts import labelled
from turnweave.sources import stored
from turnweave.sources.schemas import SEGMENTS, TURNS


def recordings(spark, first, last):
    rng = random.Random(first)
    at = lambda: rng.randint(0, 400) / 4
    segments = [(f"r{n}", i, a, a + rng.randint(-1, 40) / 4, f"t{i}") for n in range(first, last) for i in range(rng.randint(0, 12)) for a in [at()]]
    turns = [(f"r{n}", i, a, a + rng.randint(-1, 90) / 4, rng.choice("ABC")) for n in range(first, last) for i in range(rng.randint(0, 9)) for a in [at()]]
    return spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(turns, TURNS)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture
def tables(spark, tmp_path):
    names = ["kept_segments", "kept_turns"]
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    yield names, str(tmp_path)
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_labels_without_a_shuffle(spark, tables):
    names, folder = tables
    sides = recordings(spark, 0, 60)
    for side, name in zip(sides, names):
        stored.keep(side, name, 5, f"{folder}/{name}")
    own = stored.session(spark)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    segments, turns = (stored.kept(own, name) for name in names)
    for found, wanted in ((assign_speakers(segments, turns), assign_speakers(*sides)), (labelled(segments, turns), labelled(*sides)), (overlap_pairs(segments, turns), overlap_pairs(*sides))):
        assert found.columns == wanted.columns and rows(found) == rows(wanted)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"  # the user's session is as it was


def test_recordings_added_later(spark, tables):
    names, folder = tables
    old, new = recordings(spark, 0, 20), recordings(spark, 20, 40)
    for first, second, name in zip(old, new, names):
        stored.keep(first, name, 3, f"{folder}/{name}")
        stored.keep(second, name, 3, append=True)
    own = stored.session(spark)
    found = assign_speakers(*(stored.kept(own, name) for name in names))
    assert rows(found) == sorted(rows(assign_speakers(*old)) + rows(assign_speakers(*new)))
    with pytest.raises(Exception, match="already exists"):
        stored.keep(old[0], names[0], 3, f"{folder}/{names[0]}")
    with pytest.raises(Exception, match="[Bb]ucket"):
        stored.keep(old[0], names[0], 4, append=True)


def test_empty_tables_and_clashing_names(spark, tables):
    names, folder = tables
    segments, turns = recordings(spark, 0, 5)
    stored.keep(segments, names[0], 2, f"{folder}/{names[0]}")
    stored.keep(turns.where("false"), names[1], 2, f"{folder}/{names[1]}")
    own = stored.session(spark)
    found = assign_speakers(*(stored.kept(own, name) for name in names))
    assert {r.speaker for r in found.collect()} == {"UNKNOWN"} and found.count() == segments.count()
    with pytest.raises(ValueError, match="recording"):
        stored.keep(segments.withColumn("recording", segments.rec), "other", 2)
