"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints. Each word shingle's XXH64 votes on 64 bits; a bit is 1 if more than half of the shingles set it.

Trees. If two fingerprints differ in at most 2 bits, then one half (32 bits) of them differs in at most 1; in at most
7 bits, then one quarter does. Each such part has a tree, learned from a bounded sample (class Tree). A node looks at
the fingerprint through a mask of a few of the part's bits and splits by the Hamming distance, under that mask, from its
vantage point, a fingerprint of the sample; radii are learned from the sample too. A distance under a mask obeys the
triangle inequality, and the masks of a tree's levels are disjoint, so along a path the differences of distances add up
to no more than the distance of the halves. Hence a query within 1 visits the leaf of its own path, and at each node
whose next radius is within 1 the leaf beyond; all other branches are pruned. The pair's fingerprint in the inner ring
visits the other's leaf, so each link is met in one direction.

A leaf is a shuffle key: leaves are the shards, boundary overlaps are the visitors' rows (a few for each fingerprint
and tree; their number grows with the logarithm of the data), and the exact test of all 64 bits is a condition of the
join. Copies are one fingerprint each, so a group of any size is one row in the trees.

Components. Links between fingerprints are contracted by alternating large-star and small-star steps, each a grouped
minimum and a join, stored in the shared folder, until nothing changes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common

SEED = 42
#: Fingerprints that trees are learned from at most, those of a node that radii are learned from at least, and
#: fingerprints that a leaf should hold.
SAMPLE, LEARNT_FROM, LEAF = 8192, 16, 64
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 15


def fingerprint(text: bytes, words: int) -> int:
    """The SimHash of a text's shingles of `words` words; A-Z count as a-z. Fewer words: of the whole; none: 0."""
    parts = text.lower().split()  # of bytes: ASCII letters and the six ASCII white-space bytes
    if not parts:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return h64(b" ".join(parts), SEED)
    if words == 3:
        shingles = map(b"%b %b %b".__mod__, zip(parts, parts[1:], parts[2:], strict=False))
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    n = len(parts) - words + 1
    hashes = np.fromiter((h64(s, SEED) for s in shingles), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id (long), fingerprint (long, two's complement) of every row; a null text has fingerprint 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.sliced(frames):
            prints = np.array([fingerprint((x or "").encode(), words) for x in frame.text], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "fingerprint": prints})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, fingerprint long")


def _rings(counts: np.ndarray) -> np.ndarray:
    """The ring of each distance: neighbouring distances together until a ring and what is left have a fifth of the rows."""
    out, ring, held, left = np.zeros(len(counts), np.int8), 0, 0, counts.sum()
    least = counts.sum() / 5
    for d, n in enumerate(counts.tolist()):
        out[d] = ring
        held, left = held + n, left - n
        if held >= least and left >= least:
            ring, held = ring + 1, 0
    return out


class Tree:
    """A vantage-point tree over one part of the bits, learned from a sample of the fingerprints.

    A node's vantage point is that of a few fingerprints of the sample in it which spreads the others best over its
    rings; the rings' radii are from their distances. A node is a leaf when it should hold at most LEAF of all `total`
    fingerprints, or no more of the sample to learn from; it then goes on with its last vantage point for as many
    levels (`more`) as it needs, a ring for each distance.
    """

    def __init__(self, sample: np.ndarray, total: int, part: int, parts: int, mask: int):
        self.part, self.parts, self.mask = part, parts, mask
        wide = 64 // parts
        self.levels = wide // mask
        self.masks = [np.uint64(((1 << mask) - 1) << (part * wide + k * mask)) for k in range(self.levels)]
        same = sum((math.comb(mask, d) / 2**mask) ** 2 for d in range(mask + 1))  # two random fingerprints' chance to share a ring
        nodes: list[tuple] = []
        todo = [(sample, 0, np.uint64(0))]
        for own, level, vantage in todo:  # grows meanwhile
            expected = total * len(own) / max(1, len(sample))
            if level == self.levels or expected <= LEAF or len(own) < LEARNT_FROM:
                needs = math.ceil(math.log(expected / LEAF) / math.log(1 / same)) if expected > LEAF else 0
                nodes.append((own[0] if len(own) else vantage, -1, np.zeros(mask + 1, np.int8), level, min(self.levels - level, needs)))
                continue
            tried = [(v, np.bincount(np.bitwise_count((own ^ v) & self.masks[level]), minlength=mask + 1)) for v in own[:4]]
            vantage, counts = min(tried, key=lambda x: int((x[1] ** 2).sum()))
            rings = _rings(counts)
            nodes.append((vantage, len(todo), rings, level, 0))
            at = rings[np.bitwise_count((own ^ vantage) & self.masks[level])]
            todo += [(own[at == r], level + 1, vantage) for r in range(int(rings[-1]) + 1)]
        vantage, child, rings, depth, more = zip(*nodes, strict=True)
        self.vantage, self.child, self.rings = np.array(vantage, np.uint64), np.array(child), np.array(rings)
        self.depth, self.more = np.array(depth), np.array(more)

    def places(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of prints, leaves, and visit (0: lives there) of all leaves that each lives in or visits.

        A fingerprint that differs by one bit of this part has another distance in one level at most, by 1. If that is
        in the next ring, it is in the leaf that is reached from there with the own bits in all other levels.
        """
        row, node, visit = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64)
        for level in range(self.levels):
            on = np.flatnonzero(self.child[node] >= 0)
            on = on[self.depth[node[on]] == level]
            if not len(on):
                break
            here = node[on]
            d = np.bitwise_count((prints[row[on]] ^ self.vantage[here]) & self.masks[level]).astype(np.int64)
            ring = self.rings[here, d].astype(np.int64)
            beyond = self.rings[here, np.minimum(d + 1, self.mask)].astype(np.int64)
            over = (beyond > ring) & (visit[on] == 0)
            node[on] = self.child[here] + ring
            row, node = np.append(row, row[on][over]), np.append(node, (self.child[here] + beyond)[over])
            visit = np.append(visit, np.ones(over.sum(), np.int64))
        base, code = self.mask + 1, np.zeros(len(row), np.int64)
        for j in range(int(self.more.max())):
            on = np.flatnonzero(self.more[node] > j)
            level = self.depth[node[on]] + j
            d = np.bitwise_count((prints[row[on]] ^ self.vantage[node[on]]) & np.array(self.masks)[level]).astype(np.int64)
            over = (d < self.mask) & (visit[on] == 0)
            code[on] += d * base**j
            row, node = np.append(row, row[on][over]), np.append(node, node[on][over])
            code, visit = np.append(code, code[on][over] + base**j), np.append(visit, np.ones(over.sum(), np.int64))
        return row, (node * base**self.levels + code) * self.parts + self.part, visit


def trees_of(prints: DataFrame, parts: int, mask: int) -> list[Tree]:
    """A tree for each part of the bits, learned from the SAMPLE fingerprints of smallest hash, and an eighth at most."""
    total = prints.count()
    rows = prints.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(max(1, min(SAMPLE, total // 8))).collect()  # bounded
    sample = np.array([r.fingerprint for r in rows], np.int64).view(np.uint64)
    return [Tree(sample, total, part, parts, mask) for part in range(parts)]


def walk(prints: DataFrame, parts: int, mask: int, homes: bool = False) -> DataFrame:
    """The rows of prints (fingerprint and others), once for each leaf of each tree that they live in or visit.

    Adds leaf (long; the tree's number is part of it) and visit (0: lives there). A level's mask has `mask` bits. With
    `homes`, only the leaves that they live in.
    """
    trees = trees_of(prints, parts, mask)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.sliced(frames, 5000):
            values = frame.fingerprint.to_numpy(np.int64).view(np.uint64)
            for tree in trees:
                row, leaf, visit = tree.places(values)
                if homes:
                    row, leaf, visit = row[visit == 0], leaf[visit == 0], visit[visit == 0]
                yield frame.iloc[row].assign(leaf=leaf, visit=visit)

    fields = prints.select("*", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("visit")).schema
    return prints.mapInPandas(run, fields)


def links(prints: DataFrame, radius: int = 2, parts: int = 2, mask: int = 2) -> DataFrame:
    """a, b: all pairs of the different values of prints.fingerprint at most `radius` bits apart, each once.

    A pair that meets in several trees is taken from the first of them. With `parts` trees, one part of a pair's bits differs in at most radius / parts bits; that must be 0 or 1. If
    prints have a column `label`, pairs of equal labels are left out.
    """
    if not 0 <= radius < 2 * parts or 64 % (parts * mask):
        raise ValueError("a part's share of the radius must be below 2, and masks must divide the parts")
    walked = common.stored(walk(prints.repartition(common.fanout(prints.sparkSession), "fingerprint"), parts, mask), "tree-places")
    as_ = lambda df, name: df.select("leaf", *(["visit"] if name == "a" else []), F.col("fingerprint").alias(name), *([F.col("label").alias(f"label_{name}")] if "label" in prints.columns else []))
    differ, wide = F.col("a").bitwiseXOR(F.col("b")), 64 // parts
    near = F.bit_count(differ) <= radius
    once = (F.col("visit") > 0) | (F.col("a") < F.col("b"))
    own = F.pmod("leaf", F.lit(parts))
    for part in range(parts):  # a pair is left to the first tree in whose bits it differs by one at most
        bits = F.bit_count(F.shiftrightunsigned(differ, part * wide).bitwiseAND(F.lit((1 << wide) - 1)))
        once = once & F.when(own == part, bits <= 1).when(own > part, bits > 1).otherwise(True)
    apart = F.col("label_a") != F.col("label_b") if "label" in prints.columns else F.lit(True)
    return as_(walked, "a").join(as_(walked.where("visit = 0"), "b"), "leaf").where(near & once & apart).select("a", "b")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction of edges (u, v), u > v, each once; the result is of the same form."""
    if large:
        arms = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = arms.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = arms.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of edges (a, b) that is not its own root; stored."""
    at = common.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    for turn in range(100):
        for large in (True, False):
            last, at = at, common.stored(_star(at, large), "stars")
            common.discard(last)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            found = at.withColumnsRenamed({"u": "node", "v": "root"})
            found.stored_at = at.stored_at
            return found
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs; its other columns are not read.

    Documents are linked where their fingerprints differ in at most `radius` bits; component_id is the smallest
    doc_id of all that links reach. Texts without words (and null ones) have fingerprint 0, linked like any other.
    Repeated rows are all returned. A component with null doc_ids only has a null component_id.
    """
    prints = common.stored(fingerprints(docs, words), "prints")
    groups = common.stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "print-groups")
    linked = components(links(groups, radius))
    rooted = groups.join(linked, groups.fingerprint == linked.node, "left").select("fingerprint", "least", "copies", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    # a root of many fingerprints is many rows of this join's one side: deal them out
    named = common.salted_join(rooted, least.where("size > 1"), "root", "fingerprint")
    named = named.select("fingerprint", F.coalesce("component_id", "least").alias("component_id"), "copies", "least").where("copies > 1 or not component_id <=> least")
    # documents whose fingerprint is no one else's and that are linked to none, or are the least themselves, need no row here
    out = common.salted_join(prints, named.select("fingerprint", "component_id", F.lit(True).alias("known")), "fingerprint", "doc_id")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: Shorter words are in most texts of a language and tell little; they count where there are no longer ones.
LEAST_BYTES = 5
#: Buckets of hashes in which shingles are counted, and buckets in one row of counts.
BUCKETS, ROW = 1 << 20, 1 << 12


def shingles(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of all word shingles; of fewer words, of the whole."""
    return _shingles((text or "").encode().lower().split(), words)


def _shingles(parts: list[bytes], words: int) -> np.ndarray:
    spans = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) > words else [b" ".join(parts)]
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, spans), np.uint32))


#: Tasks whose counts are summed in one step; those of more tasks in two.
MOST_TASKS = 512


def rareness(docs: DataFrame, words: int) -> bytes:
    """A byte for each bucket of shingle hashes: eight times the binary logarithm of the shingles in it, over all rows.

    Each task gives its counts in blocks of buckets, which are summed block by block.
    """
    lanes = math.isqrt(tasks) if (tasks := docs.rdd.getNumPartitions()) > MOST_TASKS else 1

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.forget_words()
        n = np.zeros(BUCKETS, np.int64)
        for frame in common.sliced(frames, 2000):
            if len(frame):
                n += np.bincount(np.concatenate([shingles(text, words) for text in frame.text]) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        yield pd.DataFrame({"block": range(BUCKETS // ROW), "lane": TaskContext.get().partitionId() % lanes, "counts": [x.astype("<u4").tobytes() for x in n.reshape(-1, ROW)]})

    def total(counts: pd.Series) -> np.ndarray:
        return sum(np.frombuffer(x, "<u4" if len(x) == 4 * ROW else "<i8").astype(np.int64) for x in counts)

    def lane(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[:1].assign(counts=[total(frame.counts).astype("<i8").tobytes()])

    def levels(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": frame.block[:1], "levels": [(8 * np.log2(np.maximum(total(frame.counts), 1))).astype(np.uint8).tobytes()]})

    with common.writing(docs.sparkSession):
        held = docs.select("text").mapInPandas(count, "block int, lane int, counts binary")
        if lanes > 1:
            held = held.groupBy("block", "lane").applyInPandas(lane, held.schema)
        found = held.groupBy("block").applyInPandas(levels, "block int, levels binary").collect()
    of = {r.block: bytes(r.levels) for r in found}
    return b"".join(of.get(i, bytes(ROW)) for i in range(BUCKETS // ROW))


def features(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """uid, digest (of the words, A-Z as a-z), fingerprint (of the set of longer words), n (distinct shingles), m0, m1
    (parities of the shingles in 128 places), central (how common the shingles are), prefix (hashes, the rarest first).

    A text that differs in a few words from another has most of its words, so the fingerprint of their set is a few
    bits away, where that of its shingles would be many. Two sets with a Jaccard similarity of at least `similarity`
    share one of the first n - ceil(similarity * n) + 1 shingles of each, in any order that is the same for all texts.
    Rare ones first: counts only make it short work.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(rareness(docs, words))

    def one(text: str | None) -> tuple:
        parts = (text or "").encode().lower().split()
        chosen = {x for x in parts if len(x) >= LEAST_BYTES} or set(parts)
        if chosen:
            hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in chosen), np.uint64, len(chosen))
            votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            fingerprint = int(np.packbits(votes * 2 > len(chosen), bitorder="little").view("<i8")[0])
        else:
            fingerprint = 0
        found = _shingles(parts, words)
        n = len(found)
        level = np.frombuffer(ranks.value, np.uint8)[found & np.uint32(BUCKETS - 1)].astype(np.uint64)
        first = np.sort(level << np.uint64(32) | found)[: n - math.ceil(similarity * n - 1e-9) + 1]
        odd = np.bincount(found * np.uint32(2654435761) >> np.uint32(25), minlength=128) & 1
        m0, m1 = np.packbits(odd.astype(np.uint8)).view("<i8")
        return xxhash.xxh3_128_digest(b" ".join(parts)), fingerprint, n, int(m0), int(m1), float(level.mean()), first.astype(np.uint32).view(np.int32)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.forget_words()
        names = ["digest", "fingerprint", "n", "m0", "m1", "central", "prefix"]
        for frame in common.sliced(frames, 500):
            found = pd.DataFrame([one(text) for text in frame.text], columns=names)
            found.insert(0, "uid", frame.uid.to_numpy())
            yield found

    return docs.select("uid", "text").mapInPandas(run, "uid long, digest binary, fingerprint long, n int, m0 long, m1 long, central double, prefix array<int>")


def word_fingerprints(docs: DataFrame) -> DataFrame:
    """uid, digest, fingerprint (see features)."""
    return features(docs, 5, 0.8).select("uid", "digest", "fingerprint")


def prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """uid, n, m0, m1, prefix (see features)."""
    return features(docs, words, similarity).select("uid", "n", "m0", "m1", "prefix")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """uid, shingles (sorted, distinct), n (how many), parities (of the shingles in 4096 places)."""

    def one(text: str | None) -> tuple[np.ndarray, int, np.ndarray]:
        found = shingles(text, words)
        odd = np.bincount(found * np.uint32(2654435761) >> np.uint32(20), minlength=4096) & 1
        return found.view(np.int32), len(found), np.packbits(odd.astype(np.uint8)).view("<i8")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.sliced(frames, 500):
            found = pd.DataFrame([one(text) for text in frame.text], columns=["shingles", "n", "parities"])
            found.insert(0, "uid", frame.uid.to_numpy())
            yield found

    return docs.select("uid", "text").mapInPandas(run, "uid long, shingles array<int>, n int, parities array<long>")


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b: uids) whose texts' shingle sets have a Jaccard similarity of at least `similarity`; stored.

    Parities of the sets in 4096 places rule out most others before sets are joined: each differing parity is a shingle
    of one text only.
    """
    pairs = common.stored(pairs.distinct(), "near-pairs")
    ends = common.stored(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "near-ends")
    sets = common.stored(shingle_sets(common.few_or_joined(docs, ends, "uid", "left_semi"), words), "near-sets")
    end = lambda name, *columns: sets.select(F.col("uid").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))
    unlike = F.aggregate(F.zip_with("parities_a", "parities_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sizes = F.col("n_a") + F.col("n_b")
    may = sizes - unlike >= sizes * (2 * similarity / (1 + similarity)) - 2e-6
    likely = common.stored(pairs.join(end("a", "n", "parities"), "a").join(end("b", "n", "parities"), "b").where(may).select("a", "b"), "near-likely")
    both = likely.join(end("a", "shingles"), "a").join(end("b", "shingles"), "b")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    found = common.stored(both.where(shared >= F.lit(similarity) * (F.size("shingles_a") + F.size("shingles_b") - shared)).select("a", "b"), "near-links")
    common.discard(pairs, ends, sets, likely)
    return found


def _bits_apart(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def may_be_similar(similarity: float) -> Column:
    """A bound over n_a, m0_a, m1_a and n_b, m0_b, m1_b that no similar pair breaks: the ratio of the sizes, and the
    shingles of one text only, of which there are at least as many as parities differ."""
    sizes = F.col("n_a") + F.col("n_b")
    unlike = _bits_apart(F.col("m0_a"), F.col("m0_b")) + _bits_apart(F.col("m1_a"), F.col("m1_b"))
    return (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-6) & (sizes - unlike >= sizes * (2 * similarity / (1 + similarity)) - 2e-6)


#: Bits between the fingerprints of texts and leaf centres that are tested first.
FIRST_RADIUS = 12


def _centres(texts: DataFrame, similarity: float, radius: int, parts: int, mask: int) -> DataFrame:
    """a, b: each text of texts (uid, fingerprint, n, m0, m1, central) with two centres of each leaf that it lives in:
    the one with the most common shingles, and one by hash.

    In a large group of near copies, the text that the others were made from has the shingles that most of them have,
    so most are linked to it, with a few rows each.
    """
    own = ["uid", "fingerprint", "n", "m0", "m1"]
    homes = common.stored(walk(texts.select(*own, "central").repartition(common.fanout(texts.sparkSession), "uid"), parts, mask, homes=True).drop("visit"), "near-homes")
    best = lambda order: F.max(F.struct(order.alias("order"), *own))
    leaves = homes.groupBy("leaf").agg(F.count("*").alias("size"), F.array(best(F.col("central")), best(F.xxhash64("uid").cast("double"))).alias("centres")).where("size > 1")
    centres = leaves.select("leaf", F.explode(F.array_distinct(F.transform("centres", lambda c: F.struct(*(c[x].alias(f"{x}_b") for x in own)))))).select("leaf", "col.*")
    pairs = homes.select("leaf", *(F.col(x).alias(f"{x}_a") for x in own)).join(centres, "leaf")
    near = (F.col("uid_a") != F.col("uid_b")) & (_bits_apart(F.col("fingerprint_a"), F.col("fingerprint_b")) <= radius)
    found = common.stored(pairs.where(near & may_be_similar(similarity)).select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b")), "near-first")
    common.discard(homes)
    return found


#: Rows up to which a shingle's pairs are made in one row; rows on either side of the others' join that one key holds;
#: earlier shared shingles of a text that a row there has.
FEW_SHARERS, MOST_SHARERS, EARLIER = 8, 512, 64


def _within(x: Callable[[str], Column], y: Callable[[str], Column], similarity: float) -> Column:
    """Two bounds on rows (label, n, at) of a shingle that no similar pair of different labels breaks at its first common
    shingle: the ratio of sizes, and what both can share from this shingle on."""
    sizes = F.least(x("n"), y("n")) >= F.greatest(x("n"), y("n")) * similarity - 1e-6
    rest = F.least(x("n") - x("at"), y("n") - y("at")) >= (x("n") + y("n")) * (similarity / (1 + similarity)) - 1e-6
    return (x("label") != y("label")) & sizes & rest


def sharing(prefixed: DataFrame, labels: DataFrame, similarity: float, radius: int | None = None) -> DataFrame:
    """a, b (uids, a < b; stored): pairs of different labels (uid, label), with all of at least `similarity`.

    With a radius, only pairs whose fingerprints (a column of labels) are at most so many bits apart.

    Only shingles with several labels make rows. The pairs of a shingle with a few rows are made in one row. Of the rows
    of others, those of its commonest label need no pairs among themselves: the rest meet all, dealt out over several
    keys, and a pair is left to its first common shingle, unless EARLIER others lie between. Conditions are bounds that
    no similar pair breaks: see _within and may_be_similar.
    """
    named = common.stored(prefixed.join(labels, "uid"), "near-named")
    rows = named.select("uid", "label", "n", F.posexplode("prefix").alias("at", "token"))
    several = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("total")).where("low <> high").select("token", "total")
    found = common.stored(rows.join(several, "token"), "near-sharers")
    few = found.where(F.col("total") <= FEW_SHARERS).groupBy("token").agg(F.collect_list(F.struct("uid", "label", "n", "at")).alias("list"))
    others = lambda x, i: F.filter(F.slice("list", i + 2, FEW_SHARERS), lambda y: _within(lambda c: x[c], lambda c: y[c], similarity))
    few = few.select(F.explode(F.flatten(F.transform("list", lambda x, i: F.transform(others(x, i), lambda y: F.struct(F.least(x["uid"], y["uid"]).alias("a"), F.greatest(x["uid"], y["uid"]).alias("b")))))).alias("x")).select("x.*")
    tried = common.stored(few.unionByName(_often_shared(found.where(F.col("total") > FEW_SHARERS), named, similarity)).distinct(), "near-tried")
    columns = ["n", "m0", "m1", *(() if radius is None else ("fingerprint",))]
    end = lambda x: named.select(F.col("uid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    near = F.lit(True) if radius is None else _bits_apart(F.col("fingerprint_a"), F.col("fingerprint_b")) <= radius
    pairs = common.stored(tried.join(end("a"), "a").join(end("b"), "b").where(may_be_similar(similarity) & near).select("a", "b"), "near-sharing")
    common.discard(named, found, tried)
    return pairs


def _often_shared(found: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b) of the shingles of found (uid, label, n, at, token), which have many rows each."""
    own_columns = ("uid", "label", "n", "m0", "m1")
    each = found.groupBy("token", "label").agg(F.count("*").alias("c"))
    chunks = lambda n: F.ceil(n / MOST_SHARERS).cast("int")
    shared = each.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("total"), F.max("c").alias("most"))
    shared = common.stored(shared.select("token", "main", chunks(F.col("total")).alias("all_chunks"), chunks(F.col("total") - F.col("most")).alias("other_chunks")), "near-shared")
    # a text's own shared shingles, in order, in one row: never more than its prefix
    lists = found.select("uid", "at", "token").join(shared, "token").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "token", "main", "all_chunks", "other_chunks"))).alias("list"))
    lists = lists.join(named.select(*own_columns), "uid").select(*own_columns, F.col("list.token").alias("tokens"), F.posexplode("list").alias("k", "x"))
    before = F.slice("tokens", F.greatest(F.col("k") - EARLIER + 1, F.lit(1)), F.least("k", F.lit(EARLIER)))
    sharers = common.stored(lists.select(*own_columns, "x.*", (F.col("label") == F.col("x.main")).alias("is_main"), before.alias("before")).drop("main"), "near-lists")
    own = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = (*own_columns, "at", "before")
    a = sharers.where("not is_main").select("token", own("other_chunks").alias("ca"), every("all_chunks").alias("cb"), *(F.col(x).alias(f"{x}_a") for x in sides))
    b = sharers.select("token", every("other_chunks").alias("ca"), own("all_chunks").alias("cb"), "is_main", *(F.col(x).alias(f"{x}_b") for x in sides))
    within = _within(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"), similarity)
    once = F.col("is_main") | (F.col("uid_a") < F.col("uid_b"))
    pairs = a.join(b, ["token", "ca", "cb"]).where(within & once & may_be_similar(similarity) & ~F.arrays_overlap("before_a", "before_b"))
    return pairs.select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b"))


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int | None = 7) -> DataFrame:
    """uid, group (the smallest uid of its near-duplicate group) of every row of docs (uid long, unique; text; stored).

    Rows are linked if their word shingles' Jaccard similarity is at least `similarity` and, unless radius is None,
    their word sets' fingerprints are at most `radius` bits apart; groups are what links connect. Copies are one text.
    The fingerprints' trees come first: texts are tested with two centres of each leaf, which links most of a large
    group. Then all pairs of texts still apart that share a rare shingle, which similar texts do, are candidates. All
    are verified on whole texts. Null texts and those without words are copies of each other; an empty table gives an
    empty one.
    """
    rows = common.stored(features(docs, words, similarity), "near-features")
    one = F.min(F.struct("uid", "fingerprint", "n", "m0", "m1", "central"))
    texts = common.stored(rows.groupBy("digest").agg(one.alias("x"), F.count("*").alias("copies")).select("digest", "x.*", "copies"), "near-texts")
    tried = _centres(texts, similarity, FIRST_RADIUS if radius is None else radius, 4, 2)
    links = verified(tried, docs, words, similarity)
    joined = components(links)
    label = common.stored(texts.join(joined, texts.uid == joined.node, "left").select("uid", "fingerprint", F.coalesce("root", "uid").alias("label")), "near-labels")
    common.discard(tried, links, joined)
    tried = sharing(rows.select("uid", "n", "m0", "m1", "prefix"), label, similarity, radius)
    links = verified(tried, docs, words, similarity)
    common.discard(tried)
    ends = label.select("uid", "label")
    between = links.join(ends.withColumnsRenamed({"uid": "a", "label": "x"}), "a").join(ends.withColumnsRenamed({"uid": "b", "label": "y"}), "b")
    joined = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # a group of many texts is many rows of this join's one side: deal them out
    roots = common.salted_join(label, joined.withColumnRenamed("node", "label"), "label", "uid").select("uid", F.coalesce("root", "label").alias("group"))
    roots = common.stored(texts.select("digest", "uid", "copies").join(roots, "uid"), "near-roots")
    common.discard(links, label, joined, texts)
    # rows whose text is only theirs, and first rows of a text, need none of the text's rows here
    own = roots.where("group <> uid").select("uid", "group")
    others = common.salted_join(rows.select("uid", "digest"), roots.where("copies > 1").select("digest", F.col("group").alias("of")), "digest", "uid")
    found = common.stored(others.join(own, "uid", "left").select("uid", F.coalesce("of", "group", "uid").alias("group")), "near-groups")
    common.discard(rows, roots)
    return found


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int | None = 7) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id (nulls last). All columns stay.

    With a radius of None, similarity alone decides. Of rows equal in doc_id and text any one stays. Null texts and
    those without words are one group. An empty table gives an empty one; a column `uid` of docs is not touched.
    """
    uid = common.spare(docs, "uid")
    rows = common.stored(docs.withColumn(uid, F.monotonically_increasing_id()), "near-docs")
    slim = rows.select(F.col(uid).alias("uid"), "text")
    groups = near_duplicate_groups(slim, words, similarity, radius)
    ranked = groups.join(rows.select(F.col(uid).alias("uid"), "doc_id"), "uid")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
    ranked = common.stored(ranked.select("uid", "group", order.alias("order")), "near-ranked")
    several = ranked.groupBy("group").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = common.stored(common.salted_join(ranked, several.select("group", F.col("first.uid").alias("stays")), "group", "uid", "inner").where("uid <> stays").select(F.col("uid").alias(uid)), "near-gone")
    common.discard(groups, ranked)
    return common.few_or_joined(rows, gone, uid, "left_anti").drop(uid)


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents."""
    return near_duplicates(common.documents(spark, sf_dir))
