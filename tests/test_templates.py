"""Skeletons, places, variants and phases of templates against plain code over the same groups."""

import random
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from weft.catalog import corpus
from weft.operators import sequences, templates


def is_part(part, whole):
    it = iter(whole)
    return all(x in it for x in part)


def made(seed=1):
    rng = random.Random(seed)
    rows = []
    for key in range(6):
        for day in range(rng.randrange(1, 9)):
            a = [rng.choice("abcde") for _ in range(rng.randrange(0, 7))]
            rows.append((key, day, a, [[rng.choice(["x", "y", "z"]) for _ in range(rng.randrange(3))] for _ in a], [s for s in sorted(set(a)) if s == "a"]))
    return rows


SCHEMA = "k int, day int, a array<string>, tags array<array<string>>, cores array<string>"


def nested(rows):
    """Templates by definition, from the groups that sequences.agglomerated gives."""
    out = {}
    for key, own in groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        own = list(own)
        runs = [[(s, len(g), t[0][1]) for s, g, t in ((s, list(g), None) for s, g in groupby(zip(r[2], r[3], strict=True), key=lambda x: x[0])) for t in [g]] for r in own]
        groups = sequences.agglomerated([[x[0] for x in r] for r in runs], [r[4] for r in own], times=[[x[1] for x in r] for r in runs])
        for n, g in enumerate(groups):
            at = [[] for _ in g.symbols]
            for i in sorted(g.members + g.attached):
                for p, (s, times, tags) in zip(sequences.positions([x[0] for x in runs[i]], g.symbols), runs[i], strict=True):
                    if p is not None:
                        at[p].append((own[i][1], times, list(dict.fromkeys(tags)), s in own[i][4]))
            beats = []
            for symbol, times, ways in zip(g.symbols, g.times, at, strict=True):
                often = Counter(t for w in ways for t in w[2])
                signature = {t for t, c in often.items() if c >= max(1, (len(ways) + 1) // 2)}
                alike = lambda w: round(len(set(w[2]) & signature) / len(set(w[2]) | signature), 6) if set(w[2]) | signature else 0.0  # noqa: B023, E731
                ways.sort(key=lambda w: (not w[3], -alike(w), w[0]))
                beats.append((symbol + (f"×{times}" if times > 1 else ""), sorted(signature), ways))
            size, phases = len(beats), {}
            for i, b in enumerate(beats):
                phases.setdefault(min(3, i // (size // 4)) if size >= 4 else min(3, i * 4 // size), []).append(b)
            out[key, n] = (len(g.members + g.attached), g.symbols, [(templates.PHASES[p], phases[p]) for p in sorted(phases)])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_are_their_definition(spark, seed):
    rows = made(seed)
    found = templates.templates(templates.members(spark.createDataFrame(rows, SCHEMA).repartition(3), "k", "day", "a", "tags", "cores"), "k", "day").collect()
    got = {(r.k, r.cluster): (r.members, r.skeleton, [(p.phase, [(b.beat, b.signature, [tuple(v) for v in b.variants]) for b in p.beats]) for p in r.phases or []]) for r in found}
    assert got == nested(rows) and len(found) == len(got)
    assert any(m > 2 for m, _, _ in got.values())
    pages = {(r.k, r.cluster): r.report for r in templates.rendered(templates.templates(templates.members(spark.createDataFrame(rows, SCHEMA), "k", "day", "a", "tags", "cores"), "k", "day"), "k").collect()}
    for (k, n), (size, skeleton, phases) in got.items():
        page = [f"## {k}-{n + 1}", f"{size} × {' → '.join(skeleton) or '—'}"]
        for phase, beats in phases:
            ways = ["；".join(f"**{src}**{'*' if core else ''}{'：' + '、'.join(tags) if tags else ''}" for src, _, tags, core in w) or "—" for _, _, w in beats]
            page += [f"### {phase}", "\n".join(f"- **{b}** → {w}" for (b, _, _), w in zip(beats, ways, strict=True))]
        assert pages[k, n] == "\n\n".join(page)


def test_registered_templates_hold_every_day(spark):
    found = corpus.skeleton_templates(spark, DATA).collect()
    days = corpus._day_members(spark, DATA).collect()
    assert sum(r.members for r in found) == len(days)
    whole = {(r.user_id, r.cluster): r for r in found}
    for d in days:
        t = whole[d.user_id, d.cluster]
        assert is_part([b.symbol for b in d.beats], t.skeleton) and all(t.skeleton[b.at] == b.symbol for b in d.beats)
    n = sum(len(d.beats) for d in days)
    assert sum(len(b.variants) for r in found for p in r.phases for b in p.beats) == n


def test_phases(spark):
    for n, want in ((1, [0]), (2, [0, 2]), (3, [0, 1, 2]), (4, [0, 1, 2, 3]), (6, [0, 1, 2, 3, 3, 3]), (9, [0, 0, 1, 1, 2, 2, 3, 3, 3])):
        assert [r.p for r in spark.range(n).orderBy("id").select(templates.phase(F.col("id"), F.lit(n)).alias("p")).collect()] == want


def test_keys_are_folded_by_the_batch(spark):
    """No Python call for each key, and tags and nulls come through as they are."""
    rows = [(k, d, ["a", "a", "b"] if d else None, [["x"], ["y"], [None]] if d else None, ["a"] if d else []) for k in range(300) for d in range(2)]
    found = templates.members(spark.createDataFrame(rows, SCHEMA), "k", "day", "a", "tags", "cores")
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.where("k = 7").orderBy("day").collect()
    assert found.count() == 600 and [(r.cluster, r.attached, r.skeleton, r.repeats) for r in got] == [(0, False, [], []), (1, False, ["a", "b"], [2, 1])]
    assert [tuple(b) for b in got[1].beats] == [(0, "a", 2, ["x"]), (1, "b", 1, [None])]


def test_common_and_merged_of_any_length():
    rng = random.Random(8)
    for n in [0, 1, 3, 8, 19, 30, 70] * 6:
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(n + 1))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        assert sequences.common_length(a, b) == table[0][0]
        whole, times = sequences.merged(a, b, [2] * len(a))
        assert len(whole) == len(a) + len(b) - table[0][0] and is_part(a, whole) and is_part(b, whole) and len(times) == len(whole)
        i = j = 0
        for s in whole:  # a's symbol goes first wherever that is as short
            both, own = i < len(a) and j < len(b) and a[i] == b[j], i < len(a) and table[i + 1][j] == table[i][j]
            i, j = i + (both or own), j + (both or not own)
            assert s == (a[i - 1] if both or own else b[j - 1])
