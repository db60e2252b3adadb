"""The pipeline's stages one after the other: what each keeps, and that the result is packed whole."""

from collections import Counter

import __spark_entry__
import corpus_pipeline as P
from tests.conftest import DATA
from weft.llm import common, quality


def test_stages(spark):
    docs = common.documents(spark, DATA)
    columns = docs.columns
    verdict = {r.doc_id: r.kept for r in quality.verdicts(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    sizes = []
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = common.stored(stage(spark, docs, DATA), "test-stage")
        assert docs.columns == columns
        after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert all(before[i] == t for i, t in after)  # whole texts
        sizes.append(Counter(i for i, _ in after))
        if name == "quality rules":
            assert set(sizes[-1]) == {i for i in before if verdict[i]}
        if name == "near-duplicate removal":
            assert max(sizes[-1].values()) == 1 and len({t for _, t in after}) == len(after)
        if name == "source mixing":
            assert max(sizes[-1].values()) <= 2
    packed = P.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert Counter(packed[packed.piece == 0].doc_id) == sizes[-1]
    assert (packed.groupby("sequence_id").length.sum() <= 4096).all()


def test_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
