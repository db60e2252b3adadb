"""Texts that share a fingerprint without being like its first text."""

import random

from weft.llm import common, simhash


def test_pairs_beside_the_first_text_of_a_fingerprint(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(7)) for _ in range(120)]
    first, second = rng.sample(words, 120), rng.sample(words, 120)
    texts = [first, second, [*second[:118], second[119], second[118]], [*second[:60], "of", *second[60:]], rng.sample(words, 120)]
    table = common.stored(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "uid long, text string"), "test-docs")
    assert len({r.fingerprint for r in simhash.word_fingerprints(table).collect()}) == 1
    assert {r.uid: r.group for r in simhash.near_duplicate_groups(table).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4}
