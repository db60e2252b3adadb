"""Nulls, repeated rows, empty tables, clashing columns, hostile inputs: a defined result for each operator and stage."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import DATA
from weft.llm import bitpack, common, html, packing, quality, sharding, simhash, tiff, tokencount

ROWS = [(1, "a few words that are here", "s"), (1, "a few words that are here", "s"), (None, "a few words that are here", None), (None, None, None), (2, "", "s"), (3, "x" * 3000, "t")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


@pytest.mark.parametrize("run", [packing.packed_documents, tokencount.document_tokens, bitpack.packed_ids, tiff.payload_documents, simhash.near_duplicates, sharding.sharded_documents])
def test_repeated_and_null_ids(odd, run):
    got = Counter(r.doc_id for r in run(odd).collect())
    assert got == Counter(r[0] for r in ROWS)


def test_long_words_are_not_kept():
    encode = common.WordEncoder(common.vocabulary())
    long = "ab" * 5000
    assert encode([long, f"{long} a", "a"]) == [encode([long])[0], encode([long])[0] + encode(["a"])[0], encode(["a"])[0]]
    assert all(len(w) <= common.CACHED_CHARS for w in encode.kept)


def test_long_flat_files_are_read_in_records(spark, tmp_path):
    (tmp_path / "flat").mkdir()
    ids = np.array([random.Random(3).randrange(6) for _ in range(91)], "<u2")
    ids.tofile(tmp_path / "flat" / "long.bin")
    np.array([5, 5], "<u2").tofile(tmp_path / "flat" / "short.bin")
    read = lambda whole: sorted(map(tuple, tokencount.count_tokens(tokencount.flat_blocks(spark, f"file://{tmp_path}/flat", 2, 10, whole), 5).collect()))
    assert read(20) == read(1000)
    np.zeros(3, "u1").tofile(tmp_path / "flat" / "odd.bin")
    with pytest.raises(ValueError, match="whole ids"):
        read(20)


def test_hard_lengths_are_packed_better_than_best_fit(spark):
    """Three items fill each bin of a best packing; best fit by falling length misses most of these bins."""
    rng = random.Random(1)
    lengths = []
    for _ in range(60):
        a = rng.randrange(380, 490)
        b = rng.randrange(250, (1000 - a) // 2 + 1)
        lengths += [a, b, 1000 - a - b]
    plain = packing.best_fit(sorted(range(180), key=lambda i: -lengths[i]), lengths, [], 1000)
    items = common.stored(spark.createDataFrame(list(enumerate(lengths)), "uid long, length int"), "test-items")
    alone = packing.pack(items, 1000, block_items=60, islands=1, epochs=1, generations=0).toPandas()
    got = packing.pack(items, 1000, block_items=60, islands=3, epochs=2, generations=60).toPandas()
    assert len(got) == 180 and got.uid.nunique() == 180
    fill = got.assign(length=[lengths[i] for i in got.uid]).groupby("sequence_id").length.sum()
    assert fill.max() <= 1000 and 60 <= len(fill) < alone.sequence_id.nunique() < len(plain)


def test_deep_pages_take_linear_time():
    began = time.process_time()
    for page in ("<div>" * 100_000 + "deep", "<div>x" * 20_000, "<div>" * 20_000 + "<li>y" * 20_000, "<b>" * 50_000 + "</i>" * 50_000 + "z"):
        assert html.Page(page).texts
    assert time.process_time() - began < 15


def _by_hand(pages, least_pages, least_share):
    """Templates by going through all pairs of a subtree and a page."""
    found = []
    for i, (host, page) in enumerate(pages):
        p = html.Page(page)
        found.append((host, p, tuple(t for t, use in zip(p.texts, html.Page.chosen(p.kinds, p.marked), strict=True) if use)))
    out = []
    for host, p, _ in found:
        gone = []
        for h, above, apart in zip(p.hashes, p.parents, p.apart, strict=True):
            template = False
            for same in (lambda q: True, lambda q: q.layout == p.layout):  # noqa: B023
                group = [(q, t) for other, q, t in found if other == host and same(q)]
                on = {t for q, t in group if any(x == h and a == apart for x, a in zip(q.hashes, q.apart, strict=True))}
                template |= len(on) >= max(least_pages, 0 if apart else least_share * len({t for _, t in group}))
            gone.append(h != 0 and template or above >= 0 and gone[above])
        left = [k for k, w in enumerate(p.within) if w < 0 or not gone[w]]
        use = html.Page.chosen([p.kinds[k] for k in left], p.marked)
        out.append(("\n".join(p.texts[k] for k, u in zip(left, use, strict=True) if u), len(p.texts) - len(left)))
    return out


def test_templates_against_brute_force(spark):
    rng = random.Random(6)
    menus = [f"<ul class='m'>{''.join(f'<li>{rng.choice('abcd')} {i}' for i in range(3))}</ul>" for _ in range(3)]
    boxes = [f"<div class='q{i}'><p>Quoted passage {i}</p></div>" for i in range(3)]
    pages = []
    for i in range(60):
        body = f"<nav>{rng.choice(menus)}</nav><div><h2>Item {i}</h2><p>{rng.choice('xyz') * 5} {i}</p></div>" + "".join(b for b in boxes if rng.random() < 0.7)
        pages.append((f"h{rng.randrange(2)}.example", f"<article>{body}</article>" if i % 3 == 0 else body))
    pages += [pages[0]] * 5
    rows = [(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for share in (0.4, 0.75):
        got = {r.page_id: (r.text, r.template_blocks) for r in html.main_text(table, 10, share).collect()}
        assert [got[i] for i in range(len(pages))] == _by_hand(pages, 10, share)
    few = html.MOST_TEMPLATES
    try:
        html.MOST_TEMPLATES = -1  # by joins
        assert {r.page_id: (r.text, r.template_blocks) for r in html.main_text(table, 10, 0.75).collect()} == got
    finally:
        html.MOST_TEMPLATES = few


def test_stages_keep_columns_of_any_name(spark):
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    rows = [(i, text(i // 2), "s", f"u{i}", i, "f", 1, 2) for i in range(8)] + [(None, None, None, None, None, None, None, None)]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string, source string, uid string, size int, found string, times int, n_words int"), "test-docs")
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns and stage(spark, docs.limit(0), DATA).count() == 0
        assert {tuple(r) for r in got.collect()} <= set(rows)
    kept = [r.uid for r in P.STAGES[1][1](spark, docs, DATA).collect()]
    assert sorted(map(str, kept)) == ["None", "u0", "u2", "u4", "u6"]
    assert P.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0


def test_threshold_counts_rows():
    scores, good = np.array([0.9, 0.8, 0.5]), np.array([False, True, True])
    assert quality.threshold(scores, good, 0.5, rows=[5, 1, 9]) == pytest.approx(0.85)


def test_near_copies_in_the_given_tables(spark):
    """Links of the stage against plain Jaccard over all pairs of the smallest table's different texts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("text is not null").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    ids = [i for i, _ in rows]
    similar = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in similar:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = simhash.deduplicated(docs, radius=None).select(F.collect_set("doc_id")).first()[0]
    assert similar and sorted(got) == sorted({find(i) for i in ids})


@pytest.mark.parametrize(("leaf", "sample"), [(64, 8192), (4, 512), (1, 64)])
def test_learned_trees_lose_no_pair(spark, monkeypatch, leaf, sample):
    """Deep trees, with leaves that grow on beyond the sample, over random and skewed fingerprints."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    rng = random.Random(leaf)
    values = {rng.getrandbits(64) for _ in range(1500)} | {rng.getrandbits(64) & 0xFF00FF00FF00FF00 | 0x1234 for _ in range(500)}
    for x in list(values)[:400]:
        values |= {x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(3)}
    near = set()
    for x in values:
        for i in range(64):
            for j in range(i, 64):
                y = x ^ 1 << i ^ (1 << j if j > i else 0)
                if x < y and y in values:
                    near.add((x, y))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    got = [tuple(r) for r in simhash.links(prints).collect()]
    assert len(got) == len(set(got)) and {frozenset(p) for p in got} == {frozenset(map(signed, p)) for p in near} and len(near) > 500
    a = np.array(sorted(values), np.uint64)
    for tree in simhash.trees_of(prints, 2, 2):
        row, where, visit = tree.places(a)
        assert sorted(row[visit == 0]) == list(range(len(a))) and len(row) <= 14 * len(a)
        assert not len(tree.vantage) or all(int(v) in values or v == 0 for v in tree.vantage)
        assert np.bincount(np.unique(where[visit == 0], return_inverse=True)[1]).max() < len(a) / 4


def test_counts_of_many_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(30))) for i in range(40)], "uid long, text string")
    once = simhash.rareness(docs.repartition(1), 5)
    monkeypatch.setattr(simhash, "MOST_TASKS", 3)
    assert simhash.rareness(docs.repartition(10), 5) == once and len(once) == simhash.BUCKETS and any(once)
