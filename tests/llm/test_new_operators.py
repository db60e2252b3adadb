"""Filter audit, whitening and online packing against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_operators import SCHEMA, made
from weft.llm import audit, common, online, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    base = [(i, t, [None, "", "en", "de"][i % 4], "s", 0, "x") for i, t, *_ in made()]
    odd = [(None, base[0][1], "en", None, 0, None), (None, base[0][1], "en", None, 0, None), base[2], base[2], (500, "A" * 50 + " " + "b " * 120, "de", None, 0, None), (501, "UP CASE " * 60, None, None, 0, None)]
    return base + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def audited_plainly(rows, labels):
    """Each order applied filter by filter to the documents themselves."""
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": re.search(r"[#$%&*|]", t) is not None, "E": doc_id is not None and first.get(t, doc_id) < doc_id}
        parts.setdefault(lang or "", []).append((fails, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for part, own in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                fail = sum(x[0][f] for x in own)
                out[part, order, step] = [len(left), len(gone), fail - len(gone), sum(x[0][f] and sum(x[0].values()) == 1 for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shapley[part, f] += len(gone)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_is_every_order_applied(spark, docs, rows):
    rng = random.Random(2)
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 70, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = [tuple(r) for r in audit.audited(docs, table).collect()]
    assert len(found) == len(set(found)) == 600 * 3 and set(found) == audited_plainly(rows, labels)


def test_audit_of_nothing_and_without_labels(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(docs.limit(0), labels).count() == 0
    assert {tuple(r) for r in audit.audited(docs, labels).collect()} == audited_plainly(rows, [])


def test_many_parts_are_counted_like_few(spark):
    rng = random.Random(5)
    rows = [(f"p{rng.randrange(300)}", rng.randrange(8), rng.random() < 0.5) for _ in range(2000)] + [(None, None, None)]
    counts = audit.prefix_counts(spark.createDataFrame(rows, "part string, fails int, good boolean").repartition(3), 3, ["good"])
    want = Counter()
    for part, fails, good in rows:
        for s in range(8):
            want[part or "", s, "kept"] += not (fails or 0) & s
            want[part or "", s, "good"] += bool(good) and not (fails or 0) & s
    found = counts.collect()
    assert len(found) == 8 * len({r[0] for r in rows})
    assert all(r.kept == want[r.part, r.prefix, "kept"] and r.good == want[r.part, r.prefix, "good"] for r in found)


def vectors(n=400, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.2
    good = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [], 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] + [0.0] * (dim - 1), 1), (904, [None] * dim, 1), (905, [1.0, 2.0], 1)]
    return good + [good[7], (None, good[9][1], 2)], bad


def whitened_plainly(good, most=8):
    x = np.floor(1024 * np.array([v for _, v, _ in good]))
    n, c = len(x), x - x.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    whole = [[int(a) + 100_000 for a in r] for r in x]
    s = [sum(col) for col in zip(*whole, strict=True)]
    return [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in whole], c @ v[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_whitening_is_that_of_the_covariance(spark, parts):
    good, bad = vectors()
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label int").repartition(parts)
    found = whitening.whitened(table).toPandas()
    deviations, white, explained = whitened_plainly(good)
    assert len(found) == 8 * len(good) and set(found.n) == {len(good)}
    key = [(-1 if r[0] is None else r[0]) for r in good]
    for k in range(8):
        own = found[found.component == k + 1]
        got = sorted((-1 if np.isnan(i) else int(i), d, w) for i, d, w in zip(own.vec_id.astype(float), own.deviation, own.whitened, strict=True))
        want = sorted(zip(key, deviations, white[:, k], strict=True))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        a, b = np.array([g[2] for g in got]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert np.allclose(own.explained, explained[k], rtol=1e-12)
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-12


def test_merging_loses_no_dimension():
    x = np.random.default_rng(1).normal(size=(50, 6)) * [1e6, 1, 1e-3, 5, 1e3, 1] + 1e5
    whole = whitening.state_of(x)
    for cut in ([1, 2], [25], [1, 3, 49]):
        state = None
        for part in np.split(x, cut):
            state = whitening.merged(state, whitening.state_of(part)) if state else whitening.state_of(part)
        assert state[0] == 50 and np.allclose(state[1], whole[1], rtol=1e-13)
        assert np.allclose(np.linalg.svd(state[2])[1], np.linalg.svd(whole[2])[1], rtol=1e-7)
        assert np.allclose(np.linalg.svd(state[2])[1][:4], np.linalg.svd(whole[2])[1][:4], rtol=1e-12)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>, label int"
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], schema)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(5)], schema)
    assert whitening.whitened(same).count() == whitening.whitened(same.limit(0)).count() == whitening.whitened(same.limit(1)).count() == 0
    found = whitening.whitened(line).toPandas()
    assert set(found.component) == {1} and len(found) == 5 and found.explained[0] == pytest.approx(1) and found.identity_error[0] < 1e-12
    with pytest.raises(Exception, match="no exact whole number"):
        whitening.whitened(spark.createDataFrame([(1, [1e30, 0.0], 0), (2, [0.0, 0.0], 0)], schema)).count()


def test_deviations_beyond_a_long_are_null():
    y, sums = np.array([[1.0, 2.0], [3e15, 0.0]]), np.array([10, 20])
    assert whitening._deviations(y, 10, sums) == [0, None]
    assert whitening._deviations(y[:1], 10, sums) == [0]


def held_by(found, rows, tokenizer, capacity):
    """Checks that every id is in one piece, and sequences are gapless and full or a power of two; returns their lengths."""
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[doc_id, len(ids)] += 1
    by, sequences = {}, {}
    for r in found:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(want)
    for key, pieces in by.items():
        starts = Counter()
        for p in pieces:
            assert p.length > 0
            starts.update(range(p.start, p.start + p.length))
        assert all(starts[i] == want[key] for i in range(key[1])) and len(starts) == key[1]
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        sizes.append(at)
    return sizes


@pytest.mark.parametrize(("parts", "capacity", "windows", "fan_in"), [(1, 4096, 32, 16), (9, 256, 4, 2), (5, 64, 1, 3)])
def test_online_packing_holds_each_id_once(spark, docs, rows, parts, capacity, windows, fan_in):
    tokenizer = Tokenizer.from_file(common.vocabulary())
    found = online.packed_online(docs.repartition(parts), capacity=capacity, windows=windows, fan_in=fan_in).collect()
    sizes = held_by(found, rows, tokenizer, capacity)
    assert all(n & (n - 1) == 0 for n in sizes)  # the capacity is one too: no padding at all
    assert sum(n < capacity for n in sizes) <= capacity.bit_length()
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in found:
        if r.doc_id is not None:
            ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_online_packing_of_nothing(spark, docs):
    assert online.packed_online(docs.limit(0)).count() == 0


def test_windows_are_bounded_and_best_fit():
    rng = random.Random(7)
    state, most, done = online.OpenWindows(100, 5), 0, []
    lengths = [rng.randrange(1, 160) for _ in range(2000)]
    for i, n in enumerate(lengths):
        done += state.place((i, 0, n, bytes(4 * n)))
        most = max(most, len(state.rooms))
    left = state.leave()
    assert most == 5 and all(sum(len(p[3]) for p in w) == 400 for w in done)
    assert sum(len(p[3]) for w in done + left for p in w) == 4 * sum(lengths)
    best = online.OpenWindows(100, 5)
    for n in (60, 70, 30):  # 30 goes where it leaves no room
        got = list(best.place((n, 0, n, bytes(4 * n))))
    assert [[p[0] for p in w] for w in got] == [[70, 30]]


def test_poured_windows_end_at_powers_of_two():
    for sizes in ([], [5], [90, 3], [99, 50, 20, 20, 11], [64, 36], [1] * 7):
        left = [[(i, 0, n, bytes(4 * n))] for i, n in enumerate(sorted(sizes, reverse=True))]
        out = [sum(len(p[3]) for p in w) // 4 for w in online.poured(left, 100)]
        assert sum(out) == sum(sizes) and all(n == 100 or n & (n - 1) == 0 for n in out)
        assert sorted(out, reverse=True) == [100] * (sum(sizes) // 100) + [1 << b for b in range(6, -1, -1) if sum(sizes) % 100 >> b & 1]
