"""Eviction, absences, alias chains, logs and drift against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from weft import storage
from weft.operators import aliases, budget, gaps, replay


def kept_plainly(groups, most):
    """groups: name -> sizes. Names and sizes that stay."""
    groups = {g: list(s) for g, s in groups.items()}
    while sum(map(sum, groups.values())) > most:
        victim = max(groups, key=lambda g: sum(groups[g]))
        if len(groups[victim]) <= 1:
            break
        groups[victim].pop()
    return groups


def test_eviction_is_the_greedy_fold(spark):
    rng = random.Random(1)
    requests = {k: {g: [rng.choice([0, 1, 5, 5, 9, 40]) for _ in range(rng.randrange(1, 7))] for g in range(rng.randrange(1, 6))} for k in range(60)}
    rows = [(k, g, i, n) for k, gs in requests.items() for g, sizes in gs.items() for i, n in enumerate(sizes)]
    table = spark.createDataFrame(rows, "k int, g int, i int, n int").repartition(3)
    for most in (0, 20, 60, 10_000):
        found = {(r.k, r.g, r.i) for r in budget.evicted(table, "k", "g", "i", "n", most).where("not evicted").collect()}
        assert found == {(k, g, i) for k, gs in requests.items() for g, sizes in kept_plainly(gs, most).items() for i in range(len(sizes))}


def test_absences_with_quotas(spark):
    rng = random.Random(2)
    users = [(u, u % 3, rng.choice([None, rng.randrange(50)])) for u in range(12)]
    events = [(rng.randrange(12), rng.randrange(3), rng.randrange(60), e) for e in range(400)]
    people, table = spark.createDataFrame(users, "u int, book int, last int"), spark.createDataFrame(events, "u int, book int, at int, e int").repartition(4)
    own = gaps.first_behind(people, table.select("u", "at", "e"), "u", "last", ["at", "e"], 4)
    whole = gaps.group_digest(people, table.select("book", "at", "e"), "u", "book", "last", ["at", "e"], 7)
    none = own.where("false")
    found = {r.u: r for r in gaps.material(people, {"hints": none, "own": own, "digest": whole}, "u", "e").collect()}
    for u, book, last in users:
        later = sorted((at, e, x, b) for x, b, at, e in events if last is None or at > last)
        mine, digest = [e for _, e, x, _ in later if x == u][:4], [e for _, e, _, b in later if b == book][:7]
        r = found[u]
        assert (r.hints, r.own, r.digest) == ([], mine, digest) and r.priority == ("own" if mine else "digest" if digest else "fallback")


def chased(pairs):
    hosts = {}
    for a, h in pairs:
        if a is not None and h is not None and a != h:
            hosts.setdefault(a, set()).add(h)
    out = {}
    for a, own in hosts.items():
        seen, at = [], a
        while at in hosts and len(hosts[at]) == 1 and at not in seen:
            seen.append(at)
            at = next(iter(hosts[at]))
        if len(own) > 1:
            out[a] = a, 0, "conflict"
        elif at in seen:
            out[a] = min(seen[seen.index(at) :]), None, "cycle"
        else:
            out[a] = at, len(seen), "merged"
    return out


def test_alias_chains_conflicts_and_cycles(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)] + [(200, 201), (201, 202), (202, 200), (203, 200), (204, 203), (None, 1), (1, None), (300, 300), (301, 300), (301, 300)]
    found = aliases.closure(spark.createDataFrame(pairs, "alias long, host long").repartition(3)).collect()
    assert {r.alias: (r.root, r.hops, r.status) for r in found} == chased(pairs) and len(found) == len(chased(pairs))
    assert {r.status for r in found} == {"merged", "conflict", "cycle"}


def test_long_chains_and_hubs_take_few_rounds(spark):
    chain = spark.range(1, 10_001).select(F.col("id").alias("alias"), (F.col("id") - 1).alias("host"))
    hub = spark.range(20_000, 60_000).select(F.col("id").alias("alias"), F.lit(10_000).cast("long").alias("host"))
    found = aliases.closure(chain.union(hub))
    assert found.where("root = 0 and status = 'merged'").count() == 50_000
    assert found.agg(F.max("hops")).first()[0] == 10_001


def test_closure_stores_few_tables(spark, monkeypatch):
    """Each table costs the driver a write: cycles end as soon as chains of their length, and no round stores what is settled."""
    sizes = []
    monkeypatch.setattr(aliases.storage, "stored", lambda df, name, f=storage.stored: sizes.append(df.count()) or f(df, name))
    ring = [(i, (i + 1) % 16) for i in range(16)] + [(100, 3), (101, 100)]
    chains = [(1000 + 10 * i + k, 999 + 10 * i + k) for i in range(200) for k in range(1, 4)]
    found = aliases.closure(spark.createDataFrame(ring + chains, "alias long, host long")).collect()
    assert {r.alias: (r.root, r.hops, r.status) for r in found} == chased(ring + chains)
    assert len(sizes) <= 7 and sizes[-1] < 30


def test_alias_closure_of_nothing(spark):
    assert aliases.closure(spark.createDataFrame([], "alias string, host string")).count() == 0


def history(spark, steps=300):
    rng = random.Random(4)
    base = {k: (rng.randrange(9), f"t{k}") for k in range(20)}
    now, log, states = dict(base), [], [dict(base)]
    for seq in range(1, steps + 1):
        k = rng.randrange(40)
        before = now.pop(k, None)
        after = None if before and rng.random() < 0.3 else (rng.randrange(9), rng.choice([f"t{k}", f"moved{seq}", None]))
        if after:
            now[k] = after
        log.append((seq, k, before, after))
        states.append(dict(now))
    schema = "seq long, k long, before struct<a:long,t:string>, after struct<a:long,t:string>"
    table = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], "k long, a long, t string")
    return table(base), spark.createDataFrame(log, schema).repartition(4), states, table


def as_dict(df):
    return {r.k: (r.a, r.t) for r in df.collect()}


@pytest.mark.parametrize("upto", [0, 1, 150, 299, 300])
def test_undo_of_any_prefix_is_the_earlier_table(spark, upto):
    base, log, states, table = history(spark)
    assert as_dict(replay.applied(base, log, "k")) == states[-1] and as_dict(replay.applied(base, log, "k", upto)) == states[upto]
    rows = replay.undone(table(states[-1]), log, "k", upto)
    assert rows.where("state = 'conflict'").count() == 0 and as_dict(replay.table_of(rows)) == states[upto]


def test_what_others_changed_is_a_conflict(spark):
    base, log, states, table = history(spark, 60)
    touched = sorted({r.k for r in log.where("seq > 30").collect()})
    there = [k for k in touched if k in states[-1]]
    now = dict(states[-1])
    now[there[0]] = (77, "other")
    del now[there[1]]
    found = {r.k: r for r in replay.undone(table(now), log, "k", 30).collect()}
    assert {k for k, r in found.items() if r.state == "conflict"} == set(there[:2])
    assert found[there[0]].a == 77 and not found[there[1]].there
    assert all((found[k].a, found[k].t) == states[30][k] for k in touched[2:] if k in states[30] and k not in there[:2])


def test_drift(spark):
    approved = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (3, "B", "x")], "id int, action string, d string")
    again = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "A", "x")], "id int, action string, d string")
    assert sorted(map(tuple, replay.drift(approved, again, ["id", "action"], "d").collect())) == [(1, "A", "ready"), (2, "A", "changed"), (3, "A", "unapproved"), (3, "B", "settled")]
