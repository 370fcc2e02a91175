"""Maximal repeat groups with all their places, and the arrays beneath, against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest

from geostrata.llm import suffix_dedup as sd


def plain_covered(raws, least):
    starts = defaultdict(list)
    for k, raw in enumerate(raws):
        for i in range(len(raw) - least + 1):
            starts[raw[i : i + least]].append((k, i))
    return {(k, i + j) for found in starts.values() if len(found) > 1 for k, i in found for j in range(least)}


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(150), prose(70)
    near = passage.replace("a", "e", 3)
    return [passage, f"{prose(30)} {passage} {prose(20)}", f"{prose(9)} {passage[40:500]} {other}", other + passage[:450], near, near, "ab" * 400, "ab" * 300, "", None, prose(200), f"{other} {prose(3)} {other}", *[prose(4) + " " + passage[10:330] + " " + prose(40) for _ in range(12)]]


@pytest.mark.parametrize("block", [2048, 3])
def test_groups_list_all_places_and_cover_what_goes(spark, block):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    raws = [(t or "").encode() for _, t in rows]
    groups = defaultdict(list)
    for r in sd.repeat_groups(df, block=block).collect():
        groups[r.group, r.length].append((r.doc_id, r.start))
    assert len({g for g, _ in groups}) == len(groups)
    covered = set()
    for (_, length), places in groups.items():
        assert length >= 200 and len(places) > 1 and len(set(places)) == len(places)
        found = {raws[k][i : i + length] for k, i in places}
        assert len(found) == 1 and len(piece := found.pop()) == length
        everywhere = {(k, i) for k, raw in enumerate(raws) for i in range(len(raw) - length + 1) if raw[i : i + length] == piece}
        assert everywhere == set(places)
        covered |= {(k, i + j) for k, i in places for j in range(length)}
    assert covered == plain_covered(raws, 200)
    removed = {(r.doc_id, x) for r in sd.remove_repeats(df, block=block).collect() for s in r.removed for x in range(s.start, s.end)}
    assert removed == covered


def test_arrays_have_right_order_and_prefixes():
    rng = random.Random(3)
    seed = bytes(rng.randrange(256) for _ in range(300))
    fragments = [seed[:260], seed[20:290], b"x" * 230, b"x" * 210, bytes([0]) * 220, seed[:200] + b"other", seed]
    array = sd.SuffixArray(fragments, 200)
    suffixes = [fragments[o][s:] for o, s in zip(array.owner.tolist(), array.starts.tolist(), strict=True)]
    assert len(suffixes) == sum(len(f) - 199 for f in fragments) and [x[:200] for x in suffixes] == sorted(x[:200] for x in suffixes)
    for k in range(1, len(suffixes)):
        a, b = suffixes[k - 1], suffixes[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert array.prefix[k] == n


def test_maximal_repeats_by_comparing_all():
    """Of an array's entries: sets that share a prefix, as long as possible, and differ to the left."""
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(3)]
    fragments = sorted({b"".join(rng.choice(parts) for _ in range(4))[rng.randrange(25) :] for _ in range(9)})
    least, times = 80, np.array([1 + (k % 5 == 0) for k in range(len(fragments))])
    array = sd.SuffixArray(fragments, least)
    entries = [(o, s) for o, s in zip(array.owner.tolist(), array.starts.tolist(), strict=True)]
    found = {(length, frozenset(entries[a:b])) for length, a, b in sd.maximal_repeats(array, least, times).tolist()}
    expected = set()
    for o, s in entries:
        for length in range(least, len(fragments[o]) - s + 1):
            piece = fragments[o][s : s + length]
            places = [(p, i) for p, i in entries if fragments[p][i : i + length] == piece]
            rights = {fragments[p][i + length : i + length + 1] or p for p, i in places}
            lefts = {fragments[p][i - 1 : i] if i else (p,) for p, i in places}
            if len(places) > 1 and (len(rights) > 1 or any(len(fragments[p]) == i + length for p, i in places)) and (len(lefts) > 1 or any(i == 0 for _, i in places)):
                expected.add((length, frozenset(places)))
    expected |= {(len(f), frozenset({(k, 0)})) for k, f in enumerate(fragments) if times[k] > 1 and all(fragments[p][i : i + len(f)] != f for p, i in entries if p != k)}
    assert found == expected and len(found) > 5


def test_long_texts_over_a_segment(spark, monkeypatch):
    """A repeat over the seam of two segments, and arrays that are flushed in between."""
    monkeypatch.setattr(sd, "ARRAY_BYTES", 500)
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = noise(900)
    rows = [(1, noise(sd.SEGMENT - 400) + passage + noise(300)), (2, noise(50) + passage), (3, passage[100:]), (4, "clean " + noise(5000))]
    found = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: [(sd.SEGMENT - 400, sd.SEGMENT + 500)], 2: [(50, 950)], 3: [(0, 800)], 4: []}


def test_repeated_rows_ties_and_null_keys(spark):
    text = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(1, text, "x")] * 2 + [(None, text, "y"), (None, None, "z"), (2, "short", "x")], "doc_id long, text string, gram string")
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in sd.remove_repeats(df).collect())
    n = len(text)
    assert found == sorted([("1", n, n, 1)] * 2 + [("None", n, n, 1), ("None", 0, 0, 0), ("2", 5, 0, 0)])
    assert sd.repeat_groups(df.limit(0)).count() == 0
