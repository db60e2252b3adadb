"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import binascii
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import bitpack, common, html, mixing, packing, quality, sharding, simhash, tiff, tokencount, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid2 string"


def made(n=60, seed=1):
    """Texts of a few words to thousands, with exact and near copies, symbols, nulls and empty ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randrange(2, 11))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))) for _ in range(n)]
    texts += [texts[0], texts[0].upper(), texts[1] + " more", None, "", " \t\n", "one", "<|endoftext|> a#b", "x " * 6000, "a\x1cb c d", "😀 " * 40]
    texts += [" ".join(w if i != 50 else "changed" for i, w in enumerate(t.split(" "))) for t in texts[:n] if t.count(" ") > 150]
    return [(i, t, "en", [None, "b", "a", "a", "a"][i % 5], 0, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(common.vocabulary())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_is_the_tokenizer(tokenizer, rows):
    texts = [r[1] or "" for r in rows] + ["Don't stop, it's 3.14! (a+b)=c", "ﬁ Å é é ≮", "a<|endoftext|>b", "A'll B'S", "tab\tand\rreturn\x0b."]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert common.encoder(common.vocabulary())(texts) == want


def test_packing(spark, docs, empty, rows, tokenizer):
    got = packing.packed_documents(docs, capacity=512).toPandas()
    want = {}
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 512)):
            want[doc_id, piece] = (at, len(ids[at : at + 512]), crc(ids[at : at + 512]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 512 and list(own.offset) == [0, *own.length.cumsum()[:-1]]
    assert got.sequence_id.nunique() <= 1.05 * -(-got.length.sum() // 512) + 1
    assert packing.packed_documents(empty).count() == 0


def test_crossover_keeps_every_item_once():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 100) for _ in range(80)]
    a, b = (packing.best_fit(rng.sample(range(80), 80), lengths, [], 100) for _ in range(2))
    child = packing.crossover(a, b, lengths, 100, rng)
    assert sorted(i for x in child for i in x) == list(range(80)) and all(sum(lengths[i] for i in x) <= 100 for x in child)


PAGE = "page_id long, url string, html string, payload string, uid string"


def test_warc(spark, tmp_path):
    big, other = "<p>" + "é" * 60, "<p>" + "z" * 120
    rows = [(5, "u", big, "", ""), (2, "u", big, "", ""), (9, None, other, "", ""), (7, "u", "s", "", ""), (8, "u", "s", "", ""), (1, "u", None, "", ""), (3, "a\r\nb", big, "", ""), (2, "u", big, "", ""), (None, "u", other, "", "")]
    pages = spark.createDataFrame(rows, PAGE)
    got = sorted(warc.archived_pages(pages).collect(), key=str)
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, len((h or "").encode()), sha(h)) for p, _, h, _, _ in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter({(2, "response", None): 1, (2, "revisit", 2): 1, (3, "revisit", 2): 1, (5, "revisit", 2): 1, (7, "response", None): 1, (8, "response", None): 1, (1, "response", None): 1, (9, "response", None): 1, (None, "revisit", 9): 1})
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in warc.read_archive(spark, path).withColumn("record", warc.record_bytes()).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)$", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and len(body) == n + 4 and body.endswith(b"\r\n\r\n")
    warc.export_warc(spark, path, f"file://{tmp_path}/warc")
    members = sorted(spark.read.parquet(f"file://{tmp_path}/warc").collect(), key=lambda r: r.offset)
    file = b"".join(bytes(r.member) for r in members)
    wanted = Counter(bytes(r.record) for r in warc.rebuilt(warc.read_archive(spark, path)).collect())
    assert len(members) == len(rows) and Counter(gzip.decompress(file[r.offset : r.offset + r.length]) for r in members) == wanted
    assert {r.url for r in warc.read_archive(spark, path).collect()} == {"u", None, "a%0D%0Ab"}
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_damaged_archive_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    spark.createDataFrame([("00", 1, bytearray(b"x"))], "payload_digest string, copies long, payload binary").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="not what its digest says"):
        warc.payloads(spark, path).collect()
    header = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\n"
    records = spark.createDataFrame([(1, "response", "u", hashlib.sha256(b"x").hexdigest(), None, header, bytearray(b"x")), (2, "response", "u", "00", None, header, bytearray(b"x"))], "page_id long, record_type string, url string, payload_digest string, refers_to string, header string, payload binary")
    assert warc.rebuilt(records.where("page_id = 1")).first().block_bytes == 1
    with pytest.raises(Exception, match="not what its header says"):
        warc.rebuilt(records).collect()


def test_sharding(spark, docs, empty, rows):
    got = sharding.sharded_documents(docs).toPandas()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == {i: (len((t or "").encode()) + 1, binascii.crc32((t or "").encode())) for i, t, *_ in rows}
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    moved = got[got["shard"] != got.grown_shard]
    assert set(moved.grown_shard) <= {8} and set(got["shard"]) <= set(range(8))
    again = sharding.sharded_documents(docs, shards=9).toPandas()
    assert dict(zip(again.doc_id, again["shard"], strict=True)) == dict(zip(got.doc_id, got.grown_shard, strict=True))
    twice = spark.createDataFrame([(None, None), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sharding.sharded_documents(twice).groupBy("doc_id").agg({"shard": "max", "slot": "count"}).count() == 2
    assert sharding.sharded_documents(empty).count() == 0


def test_shard_weights(spark):
    n = spark.range(20_000).select(sharding.rendezvous(sharding.F.col("id"), [1.0, 3.0, 0.0]).alias("s")).groupBy("s").count()
    got = {r.s: r["count"] for r in n.collect()}
    assert set(got) == {0, 1} and 0.72 < got[1] / 20_000 < 0.78
    with pytest.raises(ValueError):
        sharding.rendezvous(sharding.F.lit(1), [0.0])


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty, rows):
    rng = random.Random(5)
    more = [(1000 + i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) + ("###" if i % 5 == 0 else "") for _ in range(80)) + "\nend", "en", "a", 0, "") for i in range(400)]
    all_ = docs.unionByName(spark.createDataFrame([*more, (None, "a b\na b\n\na b", "en", "a", 0, "")], SCHEMA))
    labels = spark.createDataFrame([(1000 + i, 0 if i % 5 == 0 else 1, 0) for i in range(300)] + [(1001, 0, 0), (99_999, 1, 0), (None, 1, 0), (1002, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.verdicts(all_, labels).toPandas()
    assert len(got) == len(rows) + 401
    want = {i: brute_statistics(t) for i, t, *_ in [*rows, *more]}
    for r in got[got.doc_id.notna()].itertuples():
        s = want[int(r.doc_id)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 10 or 100 * s[4] > 20 * s[0]) and not (r.base_failed and r.kept)
    held_out = got[got.doc_id >= 1300]
    bad = held_out.doc_id % 5 == 0
    assert not held_out.kept[bad].any() and held_out.kept[~bad].mean() > 0.95
    kept = quality.kept_documents(all_, labels)
    assert kept.columns == all_.columns and kept.count() == got.kept.sum()
    none = quality.verdicts(docs, labels.limit(0)).toPandas()
    assert (none.kept == ~none.base_failed).all() and none.anomaly.isna().all()
    assert quality.verdicts(empty, labels).count() == 0


def test_threshold_limits_lost_good_rows():
    scores = np.array([0.9, 0.8, 0.7, 0.6, 0.5])
    assert quality.threshold(scores, np.array([False, False, True, False, True]), 0.0) == pytest.approx(0.75)
    assert quality.threshold(scores, np.array([True] * 5)) == float("inf")
    assert quality.threshold(scores, np.array([True, False, False, False, False]), 0.0) == float("inf")


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 3000, 40_000])
def test_tiff_codecs(n):
    rng = random.Random(n)
    for data in (bytes(rng.randrange(256) for _ in range(n)), bytes(rng.choice(b"ab") for _ in range(n)), b"x" * n):
        for c in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
            assert tiff.unpack(tiff.pack(data, c), c) == data


def test_tiff_pages(spark):
    pages = [np.random.default_rng(i).integers(0, 256, s, dtype=np.uint8) for i, s in enumerate([(1, 1), (50, 70), (64, 33)])]
    for c in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        for predictor in (1, 2):
            for tile in (0, 16):
                back = list(tiff.read_pages(tiff.write_pages(pages, c, predictor, 10, tile)))
                assert len(back) == 3 and all((x.samples[:, :, 0] == y).all() for x, y in zip(back, pages, strict=True))
    good = tiff.write_pages(pages)
    for bad in (b"", b"II", b"XX*\0\0\0\0\0", good[:-20], b"II*\0\x08\0\0\0\x00\x00\x08\0\0\0"):
        with pytest.raises(ValueError):
            list(tiff.read_pages(bad))
    files = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray())], "id int, media binary")
    got = tiff.page_rows(files).orderBy("page").collect()
    assert [(r.id, r.page, r.page_rows, r.page_columns) for r in got] == [(1, 0, 1, 1), (1, 1, 50, 70), (1, 2, 64, 33)]
    assert bytes(got[1].pixels) == pages[1].tobytes()
    with pytest.raises(ValueError):
        tiff.page_rows(files.withColumnRenamed("id", "page"))
    damaged = spark.createDataFrame([(1, bytearray(b"II*\0")), (2, bytearray(good))], "id int, media binary")
    got = tiff.page_rows(damaged).collect()
    assert [(r.id, r.page, r.error is None) for r in got] == [(1, None, False), (2, 0, True), (2, 1, True), (2, 2, True)]
    media = damaged.select(F.col("id").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n_bytes"), "media")
    assert [(r.doc_id, r.payload_bytes) for r in tiff.media_features(media).orderBy("doc_id").collect()] == [(1, None), (2, sum(x.size for x in pages))]


def test_big_endian_sixteen_bit():
    import struct

    pixels = np.array([[1, 300], [70, 65535]], ">u2").tobytes()
    tags = [(256, 3, 1, 2 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 1, 8), (277, 3, 1, 1 << 16), (278, 3, 1, 2 << 16), (279, 4, 1, 8)]
    data = b"MM\0*" + struct.pack(">I", 16) + pixels + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0"
    assert next(tiff.read_pages(data)).samples[:, :, 0].tolist() == [[1, 300], [70, 65535]]


def test_tiff_documents(docs, empty, rows):
    got = tiff.payload_documents(docs).toPandas().set_index("doc_id")
    for i, t, *_ in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len(got) == len(rows) and got.media_sha256.nunique() == len({(r[1] or "") for r in rows})
    assert tiff.payload_documents(empty).count() == 0


def test_mixing(docs, empty, rows):
    got = mixing.taken_words(docs).toPandas()
    assert dict(zip(got.doc_id, got["size"], strict=True)) == {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    source = {r[0]: r[3] or "" for r in rows}
    got["source"] = got.doc_id.map(source)
    sizes = got.groupby("source")["size"].sum()
    order = sorted(sizes.index, key=lambda s: (s == "", s))
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), 1.5 * sizes.sum()
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    for s, own in got.groupby("source"):
        assert own.target.iloc[0] == pytest.approx(target[s]) and own.source_size.iloc[0] == sizes[s]
        assert abs(own.taken.sum() - target[s]) <= 1 and (own.taken <= 2 * own["size"]).all()
    whole = lambda d: sorted(map(str, mixing.taken_words(d).collect()))
    assert whole(docs) == whole(docs.repartition(1)) == whole(docs.orderBy("text").repartition(5))
    more = docs.selectExpr("*", "'u' as uid", "1L as size", "'c' as times", "0 as __copy")
    mixed = mixing.mixed_documents(more)
    assert mixed.columns == more.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert all(abs(times[r.doc_id] - r.taken / r["size"]) <= 0.5 for _, r in got.iterrows() if r["size"]) and all(times[i] == 1 for i in got.doc_id[got["size"] == 0])
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.taken_words(empty).count() == 0
    assert mixing.taken_words(docs.where("text is null or trim(text) = ''")).toPandas().taken.sum() == 0


def test_mix_is_spread_evenly(spark):
    sources = spark.createDataFrame([("a", 60_000, 60_000), ("b", 30_000, 30_000), (None, 10_000, 10_000)], "source string, source_size long, goal long")
    got = mixing.schedule(sources, 100).toPandas().sort_values("slot")
    assert {k if isinstance(k, str) else None: n for k, n in got.source.value_counts(dropna=False).items()} == {"a": 600, "b": 300, None: 100}
    for at in range(0, 1000, 100):
        assert abs((got.source.iloc[at : at + 100] == "a").sum() - 60) <= 4
    for _, own in got.groupby("source", dropna=False):
        assert sorted(own["rank"]) == list(range(len(own)))


def test_separator_scan(spark, docs, empty, rows, tokenizer, tmp_path):
    plain = Tokenizer.from_file(common.vocabulary())
    plain.encode_special_tokens = True
    want = {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}
    got = tokencount.document_tokens(docs).toPandas()
    assert dict(zip(got.doc_id, got.n_tokens, strict=True)) == want
    for block in (1, 7, 1000):  # documents over many blocks
        path = f"file://{tmp_path}/{block}"
        tokencount.write_flat(docs, path, common.vocabulary(), 49_407, block)
        found = tokencount.count_tokens(spark.read.parquet(path).select("file", "block", "ids"), 49_407).toPandas()
        assert sorted(found.n_tokens) == sorted(want.values()) and found.ended.all()
        for _, own in found.sort_values("ordinal").groupby("file"):
            assert list(own.ordinal) == list(range(len(own))) and list(own.start) == [0, *(own.n_tokens + 1).cumsum()[:-1]]
    (tmp_path / "flat").mkdir()
    np.array([1, 9, 9, 5, 7], "<u2").tofile(tmp_path / "flat" / "a.bin")
    tail = tokencount.count_tokens(tokencount.flat_blocks(spark, f"file://{tmp_path}/flat", 2, 2), 9).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens, r.ended) for r in tail] == [(0, 1, True), (2, 0, True), (3, 2, False)]
    assert tokencount.document_tokens(empty).count() == 0


def brute_print(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, empty, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(r[1]) for r in rows]
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{p:016x}" for p in prints]
    want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert [got[i].component_id for i in range(len(rows))] == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("radius", "parts", "mask"), [(2, 2, 2), (3, 2, 1), (7, 4, 1), (0, 4, 2)])
def test_trees_lose_no_pair(spark, radius, parts, mask):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for x in base:
        for _ in range(8):
            y = x
            for b in rng.sample(range(64), rng.randrange(1, radius + 3)):
                y ^= 1 << b
            values.add(y)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = {(min(r), max(r)) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), radius, parts, mask).collect()}
    m = (1 << 64) - 1
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & m).bit_count() <= radius}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 101), (105, 101), (7, 7)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 21)}, 101: 100, 105: 100}


def test_near_duplicate_stage(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(7)) for _ in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(150)]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for i in rng.sample(range(150), 2):
                copy[i] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[0], None, "", "only four words here", "ONLY four words  here"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    table = common.stored(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "uid long, text string"), "test-docs")
    prints = {r.uid: r.fingerprint for r in simhash.word_fingerprints(table).collect()}
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    near = [(i, j) for i, j in similar if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= 7]
    assert len(near) >= 0.9 * len(similar)
    want = roots(len(texts), near)
    got = {r.uid: r.group for r in simhash.near_duplicate_groups(table).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = simhash.deduplicated(table.withColumnRenamed("uid", "doc_id"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == ["doc_id", "text"]


def test_near_duplicates_beyond_the_fingerprints(spark):
    """Copies with an added passage are far apart in fingerprints; large ones, and many of a kind, are found all the same."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(7))
    passage, texts = [word() for _ in range(40)], []
    for i in range(60):
        base = [word() for _ in range(rng.choice((12, 30, 150, 400)))]
        more = [word() for _ in range(len(base) // 5)]
        texts += [" ".join(x) for x in (base, base + more, more + base, base[: len(base) * 9 // 10] + more[: len(base) // 12], base + passage if i % 2 else passage)]
    texts += [" ".join([*passage, word()]) for _ in range(40)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    table = common.stored(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "uid long, text string"), "test-docs")
    prints = {r.uid: r.fingerprint for r in simhash.word_fingerprints(table).collect()}
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = [(i, j) for i, j in similar if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() > 7]
    assert len(far) >= 50
    got = {r.uid: r.group for r in simhash.near_duplicate_groups(table, radius=None).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), similar)


@pytest.mark.parametrize("most", [3, 512])
def test_sharing_loses_no_pair(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_SHARERS", most)
    rng = random.Random(most)
    base = [str(rng.random()) for _ in range(60)]
    texts = [" ".join(base[: rng.randrange(45, 61)] + [str(rng.random()) for _ in range(rng.randrange(8))]) for _ in range(60)]
    table = common.stored(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "uid long, text string"), "test-docs")
    labels = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(60)], "uid long, label long")
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    want = {(j, i) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (i % 7 if i % 3 else 0) != (j % 7 if j % 3 else 0)}
    got = {(min(r), max(r)) for r in simhash.sharing(simhash.prefixes(table, 5, 0.8), labels, 0.8).collect()}
    assert len(want) > 100 and got >= want


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    data = bitpack.pack_bits(ids, width)
    assert len(data) == -(-1001 * width // 8)
    for start, n in ((0, 1001), (5, 1), (1000, 1), (333, 444), (7, 0)):
        assert (bitpack.unpack_bits(data, width, start, n) == ids[start : start + n]).all()
    assert bitpack.width_of(49_408) == 16 and bitpack.width_of(1) == 1 and bitpack.width_of(50_257) == 16
    if width < 32:
        with pytest.raises(ValueError):
            bitpack.pack_bits(np.array([1 << width], np.uint32), width)


def test_packed_ids(spark, docs, empty, rows, tokenizer, tmp_path):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitpack.packed_ids(docs).collect()}
    at = 0
    for i, t, *_ in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (at, len(ids), crc(ids))
        at += len(ids)
    path = f"file://{tmp_path}/ids"
    bitpack.write_ids(docs, path, common.vocabulary(), 100_000, 2, block_ids=300)  # 17 bits, many blocks
    one = {r.doc_id: r.ids for r in bitpack.read_documents(spark, path).collect()}
    assert one[0] == [*tokenizer.encode(rows[0][1], add_special_tokens=False).ids, 2] and len(one) == len(rows)
    assert bitpack.packed_ids(empty).count() == 0


def test_html_rules():
    page = '<body><nav>menu</nav><div class="ad">x</div><article><h1>T &amp; t</h1><p>one<b>two</b>\n three<br>four<p>five<div class="share-box">no</div><ul><li>i<li>j</ul><form>f</form><script>"</p>"</script><!-- c --></article><div class=comments>c</div>'
    assert [t for t, _ in html.blocks_of(page)] == ["T & t", "onetwo three four", "five", "i", "j"]
    assert [t for t, _ in html.blocks_of("<p>a<p>b<div>c<span>d</span>e</div>tail &lt;x&gt;&nbsp;y")] == ["a", "b", "cde", "tail <x> y"]
    assert [t for t, _ in html.blocks_of("<main><p>in</p><aside>no</aside></main><p>out")] == ["in"]
    assert html.blocks_of("") == [] and html.blocks_of("<script>never closed") == [] and [t for t, _ in html.blocks_of("a < b")] == ["a < b"]
    assert len(html.blocks_of("<div>" * 3000 + "deep")) == 1


def test_html_templates(spark):
    share = '<div class="box2"><p>Read more of our stories every day.</p></div>'
    page = lambda i: f"<html><body><div><p>Story {i} {'tells of its own matter ' * 3}</p>{share}</div></body></html>"
    rows = [(i, f"https://Big.example.com/{i}", page(i), "h", 1) for i in range(30)]
    rows += [(100 + i, f"http://small.example.com/{i}", page(i), "h", 1) for i in range(3)]
    rows += [(200 + i, "http://copies.example.com/", page(7), "h", 1) for i in range(25)]
    rows += [(300, None, page(1), "h", 1), (301, "x", None, "h", 1), (302, "http://big.example.com/e", "", "h", 1), (0, "https://Big.example.com/0", page(0), "h", 1)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, uid int")).toPandas()
    assert len(got) == len(rows) and (got.n_chars == got.text.str.len()).all()
    story = lambda i: f"Story {i} tells of its own matter tells of its own matter tells of its own matter"
    text = dict(zip(got.page_id, got.text, strict=True))
    assert all(text[i] == story(i) for i in range(30))
    assert text[100] == f"{story(0)}\nRead more of our stories every day." and text[300].endswith("every day.")
    assert text[200].startswith(story(7)) and text[301] == "" and text[302] == ""
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
