"""Layers of a prompt against a plain fold: must lines, quotas, fallbacks, one budget."""

import random

from weft.plans import layers


def plainly(rows, layer, key):
    own = [r for r in rows if r[0] == key and r[4]]
    must, rest = [r for r in own if r[1]], [r for r in own if not r[1]]
    relevant = sorted((r for r in rest if (r[2] or 0) > 0), key=lambda r: (-r[2], r[3]))[: layer.most]
    taken = sorted(must, key=lambda r: r[3]) + (relevant or sorted(rest, key=lambda r: r[3])[: layer.fallback])
    return "\n".join([layer.title, *(r[4] for r in taken)]) if taken else None


def test_prompts(spark):
    rng = random.Random(1)
    make = lambda n: [(k, rng.random() < 0.15, rng.choice([None, 0.0, 0.0, 0.5, 1.0]) if k % 3 else 0.0, i, "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 60))) or None) for k in range(12) for i in range(rng.randrange(n))]
    tables = [make(9), make(30), make(3)]
    schema = "k int, must boolean, relevance double, place int, line string"
    own = [layers.Layer(n, f"[{n}]", spark.createDataFrame(t, schema).repartition(2), p, o, most, 2) for n, t, p, o, most in zip("xyz", tables, (1, 9, 5), (3, 1, 2), (2, 6, 4), strict=True)]
    found = {r.k: r for r in layers.prompt(own, "k", 300, 40).collect()}
    keys = {k for k in range(12) if any(plainly(t, x, k) for t, x in zip(tables, own, strict=True))}
    assert set(found) == keys
    for k in keys:
        left, parts, decisions = 300, [], {}
        for t, x in sorted(zip(tables, own, strict=True), key=lambda p: -p[1].priority):
            if text := plainly(t, x, k):
                n = len(text) if len(text) <= left else left if left >= 40 else 0
                decisions[x.name] = "kept" if n == len(text) else "cut" if n else "dropped"
                left -= n
                if n:
                    parts.append((x.order, text[:n]))
        assert found[k].prompt == "\n\n".join(p for _, p in sorted(parts)) and found[k].decisions == decisions
