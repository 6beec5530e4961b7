import hashlib
import random

import pytest

from turnweave.llm import exact_dedup as ed

UPPER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, text string, keep_id int, digest string"


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    return {k: (max((i for i in ids if i is not None), default=None), len(ids)) for k, ids in groups.items()}


def check(spark, rows):
    found = ed.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    wanted = brute(rows)
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in wanted.items()}
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    for r in found:
        assert (r.keep_id, r.group_size) == by_digest[r.text_sha256]
    assert sum(r.kept for r in found) == len(wanted)


def test_edge_rows(spark):
    rows = [(1, "Aé", 0, ""), (2, "aé", 0, ""), (3, "aÉ", 0, ""), (4, None, 0, None), (5, "", None, ""), (5, "", 0, ""), (None, "x", 0, ""), (None, "x", 0, ""), (7, "X", 0, ""), (8, "z" * 300_000, 0, ""), (9, "Z" * 300_000, 0, "")]
    check(spark, rows)
    check(spark, [(None, "only", 0, ""), (None, "only", 0, "")])


def test_empty_table(spark):
    assert ed.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_groups(spark):
    rng = random.Random(1)
    check(spark, [(i, rng.choice(["a", "A", "b" * rng.randint(0, 5), f"t{rng.randint(0, 60)}", "hot"]), 0, "") for i in range(600)])


@pytest.mark.parametrize("budget", [1, 100, 10_000])
def test_recursion_into_scratch_files(budget):
    rng = random.Random(2)
    rows = []
    for i in range(500):
        content = bytes([rng.randint(97, 99)]) * rng.randint(0, 40)
        rows.append((hashlib.sha256(content).digest(), content, i, 1))
    wanted = {}
    for d, _, i, n in rows:
        k, c = wanted.get(d, (-1, 0))
        wanted[d] = max(k, i), c + n
    found = list(ed.grace(rows, budget))
    assert len(found) == len(wanted) and {d: (k, n) for d, k, n in found} == wanted


def test_budget_counts_entries_of_short_texts():
    """What a table holds is bounded by the budget, also where the contents are next to nothing."""
    import tracemalloc

    rows = ((hashlib.sha256(b"%d" % i).digest(), b"%d" % i, i, 1) for i in range(60_000))
    tracemalloc.start()
    assert sum(1 for _ in ed.grace(rows, 1 << 20)) == 60_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20


def test_table_compares_contents():
    table = ed.ContentTable(4)
    for n in range(100):
        table.add(bytes(24) + n.to_bytes(8, "big"), b"%d" % n, n, 1)
    assert len(table) == 100
    with pytest.raises(ValueError):
        table.add(bytes(24) + (5).to_bytes(8, "big"), b"other", 1, 1)
