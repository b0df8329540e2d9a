"""The pipeline's stages against brute force on the driver's small tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from chronolens.llm import packing
from chronolens.llm.common import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, sf), "stage")
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes), name
        seen.append({r["doc_id"]: r["text"] for r in kept.collect()})
        assert set(seen[-1]) <= set(seen[-2] if len(seen) > 1 else before)
    quality, language, near, repeats = seen
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    bad = [i for i in before if labels.get(i) == 0]
    assert sum(i in quality for i in bad) <= 0.2 * len(bad)
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in language for i in good) >= 0.97 * len(good)
    # one of each text stays, the first
    first = {}
    for i in sorted(language):
        first.setdefault(language[i], i)
    assert len(set(near.values())) == len(near) and set(near) <= set(first.values())
    # no string of 200 bytes is left twice
    strings = [t.encode()[s : s + 200] for t in repeats.values() for s in range(len(t.encode()) - 199)]
    assert len(strings) - len(set(strings)) <= 0.001 * len(strings)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert {p["doc_id"] for p in pieces} == set(repeats)
    for i in repeats:
        own = [p for p in pieces if p["doc_id"] == i]
        assert sum(p["length"] for p in own) == own[0]["doc_tokens"]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count()


def test_packing_drops_no_partners(spark, sf):
    """The graph that the packing stage walks is the same whether its min-hashes count as hot or not."""
    docs = table(spark, sf, "documents")
    features = written(packing._features(packing._keyed(docs)), "features")
    items = features.groupBy("item").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    few, many = ({r["item"]: (list(r["near"]), list(r["share"])) for r in packing._nearest(items, hot).collect()} for hot in (3, 100_000))
    assert few == many
