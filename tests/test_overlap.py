import random

import pytest

from turnweave.operators import overlap
from turnweave.operators.overlap import assign_speakers, candidates, overlap_pairs
from turnweave.plans.transcripts import labelled, plain
from turnweave.sources.schemas import SEGMENTS, TURNS

CASES = {
    "largest": ((0, 10), [("A", 0, 4), ("B", 3, 10)], "B"),
    "tie": ((0, 10), [("A", 0, 5), ("B", 5, 10)], "A"),
    "tie by order": ((0, 10), [("B", 5, 10), ("A", 0, 5)], "B"),
    "touching": ((5, 6), [("A", 0, 5)], "UNKNOWN"),
    "empty segment": ((3, 3), [("A", 0, 10)], "UNKNOWN"),
    "inverted turn": ((0, 10), [("A", 8, 2)], "UNKNOWN"),
    "single turn": ((0, 10), [("A", 0, 3), ("B", 3, 7), ("A", 7, 10)], "B"),
    "unlabelled competes": ((0, 10), [("UNKNOWN", 0, 6), ("A", 6, 10)], "UNKNOWN"),
    "no turns": ((0, 10), [], "UNKNOWN"),
    "unsorted": ((0, 10), [("B", 6, 10), ("A", 0, 5)], "A"),
    "null speaker": ((0, 10), [(None, 0, 6), ("A", 6, 10)], "UNKNOWN"),
    "no fallback": ((4, 5), [("A", 0, 3), ("B", 6, 9)], "UNKNOWN"),
    "inverted segment": ((10, 0), [("A", 0, 10)], "UNKNOWN"),
    "longest": ((0, 1e15), [("A", 0, 5), ("B", 5, 1e14), ("C", -1e300, 3)], "B"),
    "longer still": ((-1e300, 1e300), [("A", 0, 5), ("B", -1.7e308, -1e299), ("C", 1e300, 1.7e308)], "B"),
    "held by the longest": ((0, 1), [("A", 0, 0.5), ("B", -1e300, 1.7e308)], "B"),
    "held whole by a later one too": ((2, 4), [("A", 2, 3.9), ("B", 1, 9), ("C", 2, 4)], "B"),
    "as much by rounding": ((0, 1e16), [("A", 0.25, 1e16), ("B", 0, 1e16)], "A"),
    "negative": ((-2, 3), [("A", -2, 0), ("B", 0, 3)], "B"),
}


def frames(spark, recordings):
    segments = [(rec, i, float(a), float(b), f"t{i}") for rec, (segs, _) in recordings.items() for i, (a, b) in enumerate(segs)]
    turns = [(rec, i, float(a), float(b), s) for rec, (_, ts) in recordings.items() for i, (s, a, b) in enumerate(ts)]
    return spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(turns, TURNS)


def nested_loop(segs, turns):
    out = []
    for a, b in segs:
        shared = [(min(b, e) - max(a, s), -i) for i, (_, s, e) in enumerate(turns)]
        best = max(shared, default=(0, 0))
        out.append((turns[-best[1]][0] or "UNKNOWN") if best[0] > 0 else "UNKNOWN")
    return out


@pytest.mark.parametrize("width", [16.0, 0.25])
def test_cases(spark, width):
    segments, turns = frames(spark, {name: ([seg], ts) for name, (seg, ts, _) in CASES.items()})
    found = {r.rec: r.speaker for r in assign_speakers(segments, turns, width).collect()}
    assert found == {name: label for name, (_, _, label) in CASES.items()}


@pytest.mark.parametrize("width", [16.0, 0.5, 1e-300, 1e300])
def test_random_intervals(spark, width):
    rng = random.Random(5)
    quarter = lambda: rng.randint(-40, 80) / 4
    recordings = {}
    for n in range(40):
        segs = [(a, a + rng.randint(-2, 24) / 4) for a in (quarter() for _ in range(rng.randint(0, 6)))]
        turns = [(rng.choice("ABC"), a, a + rng.randint(-2, 30) / 4) for a in (quarter() for _ in range(rng.randint(0, 7)))]
        recordings[f"r{n}"] = segs, turns
    segments, turns = frames(spark, recordings)
    found = {(r.rec, r.pos): r.speaker for r in assign_speakers(segments, turns, width).collect()}
    assert found == {(rec, i): s for rec, (segs, ts) in recordings.items() for i, s in enumerate(nested_loop(segs, ts))}


def test_plan_has_equality_key_and_no_python(spark):
    segments, turns = frames(spark, {"r": ([(0, 1)], [("A", 0, 1)])})
    for frame in (overlap_pairs(segments, turns), assign_speakers(segments, turns), labelled(segments, turns)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("NestedLoop", "Cartesian", "Python", "Arrow"))


def test_lines(spark):
    segments, turns = frames(spark, {"r": ([(0, 15), (15, 17), (3661, 3662)], [("SPEAKER_03", 0, 17)])})
    assert [r.line for r in plain(segments).orderBy("pos").collect()] == ["00:00 t0", "00:15 t1", "1:01:01 t2"]
    assert [r.line for r in labelled(segments, turns).orderBy("pos").collect()] == ["[SPEAKER_03] 00:00 t0", "[SPEAKER_03] 00:15 t1", "[UNKNOWN] 1:01:01 t2"]


def exact_pairs(segs, turns):
    return {(i, k) for i, (a, b) in enumerate(segs) for k, (_, s, e) in enumerate(turns) if min(b, e) - max(a, s) > 0}


@pytest.mark.parametrize("width", [16.0, 0.25])
def test_pairs_of_any_size_meet_once(spark, width):
    rng = random.Random(9)
    sizes = [0, 0.25, 1, 15.9, 16, 33, 1e4, 1.6e7, 1.7e7, 1e9, 1e15, 1e300]
    time = lambda: rng.choice([-1, 1]) * rng.choice(sizes) * rng.choice([1, 1, 0.5, 0.999, 3])
    recordings = {f"r{n}": ([(time(), time()) for _ in range(12)], [(rng.choice("ABC"), time(), time()) for _ in range(12)]) for n in range(25)}
    segments, turns = frames(spark, recordings)
    found = [(r.rec, r.pos, r.t_pos) for r in overlap_pairs(segments, turns, width).collect()]
    assert len(found) == len(set(found)) and set(found) == {(rec, *p) for rec, sides in recordings.items() for p in exact_pairs(*sides)}
    speakers = {(r.rec, r.pos): r.speaker for r in assign_speakers(segments, turns, width).collect()}
    assert speakers == {(rec, i): s for rec, sides in recordings.items() for i, s in enumerate(nested_loop(*sides))}


def test_cells_make_up_an_interval(spark):
    rng = random.Random(4)
    rows = [(a, a + rng.choice([-1, 0, 1, 2, 3, 7, 8, 100, 4096, 10**6])) for a in (rng.randrange(1 << 20) for _ in range(300))] + [(0, (1 << 22) - 1)]
    found = spark.createDataFrame(rows, "a bigint, b bigint").selectExpr("a", "b", f"{overlap._cover('a', 'b')} AS cells").collect()
    for r in found:
        spans = sorted((c["node"] << c["level"], (c["node"] + 1) << c["level"]) for c in r.cells)
        assert len(spans) <= max(1, 2 * max(1, r.b - r.a + 1).bit_length())
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert (spans[0][0], spans[-1][1]) == (r.a, r.b + 1) if r.b >= r.a else not spans


def test_later_times_have_no_lower_cells(spark):
    times = sorted({s * m * 2.0**e for s in (-1, 1) for e in range(-1070, 1024, 3) for m in (1, 1.3, 1.9999999)} | {0.0, 16 * 2.0**20, 16 * (2.0**20 - 1), 1.7976931348623157e308})
    frame = spark.createDataFrame([(t,) for t in times], "t double").selectExpr("t", f"{overlap._cell('t', 16.0)} AS c")
    cells = [r.c for r in frame.orderBy("t").collect()]
    assert cells == sorted(cells) and cells[0] >= 0 and cells[-1] < 1 << overlap.LEVELS


def test_turns_over_whole_segments_are_not_paired(spark):
    """20,000 turns over each of 20,000 segments would be 400,000,000 pairs."""
    n = 20_000
    for segs, turns, wanted in (
        ("1000.0 + id / 1000D", "-cast(id AS double)", "S19999"),  # all turns start in earlier cells
        ("id / 100000D + 0.000001D", "id / 100000D", "concat('S', pos)"),  # in one cell: a segment is held by turns up to its own
    ):
        segments = spark.range(n).selectExpr("'r' AS rec", "cast(id AS int) AS pos", f"{segs} AS start", f"{segs} + 0.000001D AS end", "'' AS text")
        turns_ = spark.range(n).selectExpr("'r' AS rec", f"cast({n} - id AS int) AS pos", f"{turns} AS start", "1e6 AS end", "concat('S', id) AS speaker")
        assert candidates(segments, turns_).count() <= 20 * n
        assert assign_speakers(segments, turns_).where(f"speaker <> {wanted if '(' in wanted else repr(wanted)}").count() == 0
