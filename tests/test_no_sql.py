"""Registered queries without SQL against brute force over the smallest tables."""

import json
import re
from collections import defaultdict
from difflib import SequenceMatcher

import duckdb
import pytest

from tests.conftest import DATA
from weft import catalog, registry  # noqa: F401
from weft.streaming import guard


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{DATA}/{name}.parquet'").fetchall()


@pytest.fixture
def run(spark):
    return lambda name: registry.QUERIES[name](spark, DATA).collect()


def test_chunk_pack(run):
    got = defaultdict(dict)
    for r in run("chunk_pack"):
        got[r.doc_id][r.chunk_no] = r.chunk
    for doc_id, text in table("documents", "doc_id, text"):
        parts = [p.strip() for p in (text or "").split("\n") if p.strip()]
        chunks = [got[doc_id][i] for i in range(len(got[doc_id]))]
        assert "".join(chunks).replace("\n", "") == "".join(parts) and all(len(c) <= 500 for c in chunks)
        for a, b in zip(chunks, chunks[1:], strict=False):  # the next paragraph, or its first piece, had no room
            assert len(a) + 1 + len(b.split("\n")[0]) > 500 or len(a) == 500


def test_token_batches(run):
    turns = defaultdict(list)
    for conv, turn, n in sorted(table("conversations", "conv_id, turn, floor(length(text) * 0.7)::INT")):
        turns[conv].append((turn, n))
    want = {}
    for conv, own in turns.items():
        batches = [[]]
        for turn, n in own:
            if batches[-1] and (len(batches[-1]) == 5 or sum(x for _, x in batches[-1]) + n > 400):
                batches.append([])
            batches[-1].append((turn, n))
        want |= {(conv, t): i for i, b in enumerate(batches) for t, _ in b}
    assert {(r.conv_id, r.turn): r.batch for r in run("token_batches")} == want


def test_budget_plan(run):
    turns = defaultdict(list)
    for conv, turn, n in table("conversations", "conv_id, turn, length(text)"):
        turns[conv].append((turn != 0, -(turn * 7 % 11), turn, n))
    want = {}
    for conv, own in turns.items():
        left = 600
        for _, _, turn, n in sorted(own):
            taken = n if n <= left else left if left >= 200 else 0
            want[conv, turn] = taken
            left -= taken
    assert {(r.conv_id, r.name): r.taken for r in run("budget_plan")} == want


def test_repair_partition(run):
    spans = defaultdict(list)
    for r in run("repair_partition"):
        spans[r.o_custkey].append((r.lo, r.hi))
    assert set(spans) == {x for (x,) in table("orders", "DISTINCT o_custkey")}
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == 2600 and all(a[1] + 1 == b[0] for a, b in zip(own, own[1:], strict=False)) and all(a <= b for a, b in own)
    begins = defaultdict(set)
    for k, d in table("orders", "o_custkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))"):
        begins[k].add(d)
    assert all(lo == 0 or lo in begins[k] or any(d < lo <= d + 61 for d in begins[k]) for k, own in spans.items() for lo, _ in own)


def symbols():
    out = defaultdict(list)
    for user, ts, event, kind in table("events", "user_id, ts, event_id, event_type"):
        out[user].append((ts, event, kind))
    return {u: [k for *_, k in sorted(own)] for u, own in out.items()}


def common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j] + (x == y), best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_sequence_align(run):
    of, got = symbols(), run("sequence_align")
    assert {r.user_id for r in got} == {u for u in of if u % 2 == 0 and u + 1 in of}
    for r in got:
        a, b = of[r.user_id], of[r.user_id + 1]
        n, short, long = common(a, b), min(len(a), len(b)), max(len(a), len(b))
        assert r.common == n and len(r.merged) == len(a) + len(b) - n and common(a, r.merged) == len(a)
        assert [r.merged[i] for i in r["at"]] == b and all(x < y for x, y in zip(r["at"], r["at"][1:], strict=False))
        least = 0.65 if long < 5 else 0.7 if long < 10 else 0.85
        assert r.mergeable == (n >= least * short and n >= 0.5 * long and len(r.merged) <= 15)


def test_sequence_clusters(run):
    days = defaultdict(list)
    for user, day, ts, event, kind in table("events", "user_id, CAST(ts AS DATE), ts, event_id, event_type"):
        days[user, day].append((ts, event, kind))
    got = run("sequence_clusters")
    assert {(r.user_id, r.day) for r in got} == set(days)
    members = defaultdict(list)
    for r in got:
        members[r.user_id, r.cluster].append([k for *_, k in sorted(days[r.user_id, r.day])])
    for own in members.values():
        if len(own) == 2:
            short, long = sorted(map(len, own))
            assert common(*own) >= (0.65 if long < 5 else 0.7 if long < 10 else 0.85) * short
    assert any(len(own) > 1 for own in members.values())


def test_repeated_tail(run):
    want = {}
    for doc_id, text in table("documents", "doc_id, text"):
        parts = [p for p in (text or "").split("\n") if p.strip()]
        n = 0
        while len(parts) >= 6 and n < len(parts) - 1:
            p = parts[len(parts) - 1 - n]
            if len(p.strip()) < 20 or not any(abs(len(p) - len(q)) <= 0.4 * max(len(p), len(q)) and len(set(p) & set(q)) >= 0.3 * len(set(p) | set(q)) and SequenceMatcher(None, p, q, autojunk=False).ratio() > 0.8 for q in parts[: len(parts) - 1 - n]):
                break
            n += 1
        want[doc_id] = n if n >= 3 else 0
    assert {r.doc_id: r.n_cut for r in run("repeated_tail")} == want


def test_notice_tail(run):
    strong, weak = re.compile(r"(?i)licen[sc]ed under"), re.compile(r"(?i)copyright|rights reserved|https?://")
    want = {}
    for doc_id, text in table("documents", "doc_id, text"):
        parts = (text or "").split("\n")
        fits = [n for n in range(min(12, len(parts)) + 1) if all(len(x) <= 120 and (not x.strip() or strong.search(x) or weak.search(x)) for x in parts[len(parts) - n :]) and sum(map(len, parts[len(parts) - n :])) <= 300]
        most = max(n for n in fits if all(m in fits for m in range(n)))
        want[doc_id] = most if any(strong.search(x) for x in parts[len(parts) - most :]) else 0
    assert {r.doc_id: r.n_tail for r in run("notice_tail")} == want


def test_style_scores(run):
    rules = [(r"[#*$%&|<>]{2,}", 5.0), (r"\b[A-Z]{2,}(?:[ !]+[A-Z]{2,}){2,}", 5.0), (r"\b(\w+) \1\b", 2.0), (r"[^.!?\n]{400,}", 0.5)]
    texts = dict(table("documents", "doc_id, coalesce(text, '')"))
    got = run("style_scores")
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        t = texts[r.doc_id]
        taken, n, weight = [False] * len(t), 0, 0.0
        for pattern, w in rules:
            for m in re.finditer(pattern, t):
                if not any(taken[m.start() : m.end()]):
                    taken[m.start() : m.end()] = [True] * (m.end() - m.start())
                    n, weight = n + 1, weight + w
        points = max(0.0, 100 - 2.2 * weight / max(len(t) / 1000, 0.5))
        assert r.issues == n and abs(r.score - points) < 1e-9 and r.grade == ("A" if points >= 90 else "B" if points >= 75 else "C" if points >= 55 else "D")


def test_lifecycle_threads(run):
    actions = defaultdict(list)
    for user, event, kind, props in table("events", "user_id, event_id, event_type, props"):
        k = json.loads(props or "{}").get("k")
        actions[user].append((event, {"purchase": "resolve", "click": "bury"}.get(kind, "hint"), f"Item {'?' if k is None else k}"))
    got = defaultdict(list)
    for r in run("lifecycle_threads"):
        got[r.user_id].append(r)
    for user, own in actions.items():
        opened = {e for e, action, _ in own if action == "bury"}
        for r in got[user]:
            assert r.status in ("done", "pending", "none") and (r.opened is None) == (r.status == "none") and (r.closed is None) == (r.status != "done")
            assert r.opened is None or r.opened in opened and (r.closed is None or r.closed > r.opened)
        assert sum(r.hints + r.orphans + (r.closed is not None) for r in got[user]) <= len(own)
        assert {r.what for r in got[user]} <= {what for *_, what in own}


def test_repetition_guard(run):
    want = {}
    for doc_id, text in table("documents", "doc_id, text"):
        window = ""
        for n, chunk in enumerate(text.split("\n") if text is not None else [], 1):
            window = (window + chunk)[-600:]
            head, tail = window[: 2 * len(window) // 3], window[2 * len(window) // 3 :]
            same = max(k for k in range(len(tail) + 1) if tail[:k] in head)
            said = [s.strip() for s in re.split(r"[.!?。！？\n]", window)]
            stopped = same >= guard.LEAST and same >= guard.SHARE * max(1, len(chunk)) or any(len(s) >= 12 and said.count(s) >= 3 for s in said)
            want[doc_id] = (n, stopped)
            if stopped:
                break
    assert {r.stream_id: (r.chunks, r.stopped) for r in run("repetition_guard")} == want
