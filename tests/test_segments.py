"""Segments with fallbacks and resumption, and pairs of sequences, against plain code."""

import random
from itertools import combinations

from weft.operators import intervals, sequences


def test_segments_lose_no_place(spark):
    rng = random.Random(1)
    places = [(k, p) for k in range(5) for p in range(1, rng.randrange(5, 30))]
    proposals = [(k, lo, lo + rng.randrange(-2, 6)) for k in range(5) for lo in (rng.randrange(1, 30) for _ in range(5))]
    begun = [(0, p, 1 if p < 3 else 2) for p in range(1, 5)]
    done = {(k, p): s for k, p, s in begun}
    want = dict(done)
    for k in range(5):
        groups = {}
        for p in (p for kk, p in places if kk == k and (k, p) not in done):
            over = [(lo, -hi) for kk, lo, hi in proposals if kk == k and lo <= p <= hi]
            groups.setdefault(min(over) if over else ("own", p), []).append(p)
        for n, own in enumerate(sorted(groups.values()), 1):
            want |= {(k, p): n + (2 if k == 0 else 0) for p in own}
    t = spark.createDataFrame(places, "k int, p int")
    found = intervals.segmented(t, spark.createDataFrame(proposals, "k int, lo int, hi int"), "k", "p", spark.createDataFrame(begun, "k int, p int, segment int"))
    assert {(r.k, r.p): r.segment for r in found.collect()} == want


def test_segments_without_proposals(spark):
    t = spark.createDataFrame([(1, 3), (1, 9), (2, 1)], "k int, p int")
    found = intervals.segmented(t, spark.createDataFrame([], "k int, lo int, hi int"), "k", "p")
    assert sorted(map(tuple, found.collect())) == [(1, 3, 1), (1, 9, 2), (2, 1, 1)]


def test_diagnosis_counts_all_pairs(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice("abc") for _ in range(rng.randrange(0, 5))], rng.choice("xy")) for k in range(3) for _ in range(25)]
    want = {}
    for k in range(3):
        for (_, a, s), (_, b, t) in combinations([r for r in rows if r[0] == k], 2):
            short, long = sorted((len(a), len(b)))
            n = sequences.common_length(a, b)
            x, y = bool(short) and n / short >= sequences.least_share(long), bool(long) and n >= 0.5 * long
            at = want.setdefault((k, "both" if x and y else "shorter" if x else "longer" if y else "neither"), [0, 0])
            at[0] += 1
            at[1] += s != t
    found = sequences.diagnosed(spark.createDataFrame(rows, "k int, a array<string>, s string"), "k", "a", "s").collect()
    assert {(r.k, r.kind): [r.pairs, r.across] for r in found} == want
