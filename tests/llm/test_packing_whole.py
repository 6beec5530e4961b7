"""The whole result of packing against a plain version: a list of bins, looked through for each piece and expectation."""

import random
from collections import defaultdict

import pytest

from turnweave.llm import packing


def plain(pieces, lengths):
    """(bin, capacity, offset, bytes held) of each piece of a group, in the order in which it is packed."""
    cost = lambda c: packing.OVERHEAD + c + c * c / packing.ATTENTION
    cheapest = None
    for fill in packing.EXPECTED_FILLS:
        bins, placed = [], []
        for turn, size in enumerate(pieces):
            fitting = [b for b in bins if b["length"] - b["held"] >= size]
            if fitting:
                # the fullest that holds it; of equal ones the one filled last
                chosen = min(fitting, key=lambda b: (b["length"] - b["held"], -b["turn"]))
            else:
                fits = [c for c in sorted(lengths) if c >= size]
                per_byte = lambda c: cost(c) / max(1.0, size + fill * (c - size))
                chosen = {"no": len(bins), "length": max(lengths) if fill is None else min(fits, key=lambda c: (per_byte(c), c)), "held": 0}
                bins.append(chosen)
            placed.append((chosen["no"], chosen["held"]))
            chosen["held"] += size
            chosen["turn"] = turn
        final = [min(c for c in lengths if c >= b["held"]) for b in bins]
        total = sum(map(cost, final))
        if cheapest is None or total < cheapest[0]:
            cheapest = total, [(no, final[no], at, bins[no]["held"]) for no, at in placed], fill
    return cheapest[1], cheapest[2]


@pytest.mark.parametrize("lengths", [packing.LENGTHS, (16, 64, 100), (64,)])
def test_whole_result(spark, monkeypatch, lengths):
    monkeypatch.setattr(packing, "GROUP_PIECES", 60)
    rng = random.Random(len(lengths))
    top = max(lengths)
    rows = [(n, "é" * int(rng.expovariate(3 / top)) + "x" * rng.randint(0, 9)) for n in range(300)]
    rows += [(n, "y" * (3 * top + n % 5)) for n in range(300, 306)] + [(7, "same")] * 4 + [(None, "no id"), (None, None), (306, ""), (307, None)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), lengths=lengths).collect()
    # pieces are those of a plain cut: as long as fits, at borders of code points
    wanted = []
    for _, text in rows:
        whole, at = (text or "").encode(), 0
        while True:
            end = min(len(whole), at + top)
            while end < len(whole) and whole[end] & 0xC0 == 0x80:
                end -= 1
            wanted.append(end - at)
            at = end
            if at >= len(whole):
                break
    assert sorted(r.bytes for r in found) == sorted(wanted)
    groups = defaultdict(list)
    for r in found:
        groups[r.pack_group].append(r)
    assert len(groups) > 3
    for held in groups.values():
        held.sort(key=lambda r: (-r.bytes, r.doc_id is None, r.doc_id or 0, r.text_hash, r["copy"], r.piece))
        assert [(r.bin, r.capacity, r.bin_offset, r.bin_bytes) for r in held] == plain([r.bytes for r in held], lengths)[0]


def test_the_cheapest_expectation_wins():
    """Groups are packed under the expectation that is cheapest for them, of equal ones the first; several win here."""
    rng, won = random.Random(40), set()
    for _ in range(150):
        mean = rng.choice([100, 800, 3000, 12000])
        sizes = sorted((min(packing.LENGTHS[-1], int(rng.expovariate(1 / mean))) for _ in range(rng.randint(1, 60))), reverse=True)
        result, fill = plain(sizes, packing.LENGTHS)
        assert packing.pack_group(sizes) == result
        won.add(fill)
    assert won >= {0.0, 0.95, None}
