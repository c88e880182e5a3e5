import random

import corpus_pipeline as P
from loomgraph.llm import substring_dedup
from tests.llm.conftest import words
from tests.llm.test_simhash import brute_groups, prints_of, whole_groups


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, before = docs, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), first.schema)
        assert docs.columns == first.columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    assert substring_dedup.without_repeats(docs).filter("n_removed > 0").count() <= 1
    packed = P.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in packed) == sorted(r.doc_id for r in docs.collect())
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, packed))


def test_odd_tables(spark, odd, clash, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows, other columns and empty tables go through every stage and the whole run."""
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (8, 0, 0), (10, 0, 0)], "doc_id bigint, quality int, toxic int")
    for name, table in (("clash", clash), ("none", none), ("lean", odd.select("doc_id", "text"))):
        sf = str(tmp_path / name)
        table.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, f in P.STAGES[:-1] if name == "clash" else ():
            assert f(spark, docs, sf).columns == docs.columns, stage
        out = P.run(spark, sf).collect()
        ids = [r.doc_id for r in out]
        assert len(ids) == len(set(ids)) and not {3, 4, 5, 6} & set(ids), "copies, null and empty texts are gone"
        assert bool(ids) == (name != "none")


def test_near_links_without_a_common_anchor(spark, make):
    """The near stage keeps one of each component of all pairs within the threshold, also of pairs that no block brings together."""
    rng, rows = random.Random(12), []
    for _ in range(60):
        body = words(rng, 120)
        for share in (0, 8, 9, 10):
            rows.append((len(rows), " ".join(w if rng.randrange(100) >= share else f"new{rng.randrange(10**6)}" for w in body)))
    want = whole_groups(prints_of([t for _, t in rows])[0])
    assert (want != brute_groups(rows)).sum() > 5, "anchors alone don't find these"
    got = dict(P.STAGES)["near"](spark, make(rows), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want.tolist()))
