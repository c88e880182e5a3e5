import numpy as np
import pytest

from loomgraph.llm import graph_index as G


def brute(ids, vectors, k):
    out = {}
    for i, v in zip(ids, vectors):
        d = np.sqrt(((vectors.astype(np.float64) - v.astype(np.float64)) ** 2).sum(axis=1))
        near = sorted((float(x), j) for x, j in zip(d, ids) if j != i)
        out[i] = near[:k]
    return out


@pytest.mark.parametrize("shard_rows", [100_000, 500])
def test_recall_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32)) * 2
    vectors = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 32))).astype(np.float32)
    vectors[1400:] = vectors[:100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in G.nearest(df, shard_rows=shard_rows).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.distance, r.neighbor_id))
    want = brute(list(range(1500)), vectors, G.K)
    assert len(got) == 1500 and all([x[0] for x in sorted(v)] == list(range(1, 11)) for v in got.values())
    hits = sum(len({x[2] for x in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits >= 0.95 * 10 * 1500
    for i in range(100):
        assert min(got[i])[1:] == (0.0, 1400 + i)


def test_stated_queries_against_all_rows(spark):
    """A third of all rows have one vector; queries are some of the rows, answers come from all."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 8)).astype(np.float32)
    vectors[600:] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in G.nearest(df, shard_rows=200, queries="vec_id % 100 = 0").orderBy("rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbor_id)
    want = brute(list(range(900)), vectors, G.K)
    assert sorted(got) == list(range(0, 900, 100))
    assert sum(len(set(got[i]) & {j for _, j in want[i]}) for i in got) >= 0.9 * 90
    assert got[0] == list(range(600, 610)) and got[600] == [0, *range(601, 610)] and got[800] == [0, *range(600, 609)]
    assert G.nearest(df, queries="vec_id < 0").count() == 0


def test_large_finite_vectors(spark):
    rows = [(1, [1e19, 0.0]), (2, [1e19, 1e19]), (3, [3e38, 0.0]), (4, [2e19, 0.0]), (5, [float("inf"), 0.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in G.nearest(df, k=2).orderBy("rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbor_id)
    v = np.array([x for i, x in rows if i != 5], np.float32)
    want = {i: [j for _, j in near] for i, near in brute([1, 2, 3, 4, 6], v, 2).items()}
    assert got == want


def test_prune_drops_what_a_kept_neighbour_covers():
    a = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2]], np.float32)
    kept = G.prune(a, np.array([0]), np.array([[3, 2, 1, 1, -1]]), 4, 1.2)
    assert kept.tolist() == [[1, 3, -1, -1]]


def test_odd(spark):
    rows = [
        (1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [3.0, 4.0]),
        (None, [0.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [-0.0, 0.0]), (9, [5.0, 5.0]),
    ]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "vec_id bigint, embedding array<float>, shard int, dim int, id int")
    got = {}
    for r in G.nearest(df).orderBy("rank").collect():
        got.setdefault(r.vec_id, []).append((r.neighbor_id, r.distance))
    assert got[1] == [(2, 0.0), (9, 0.0), (7, 5.0), (9, 50**0.5)]
    assert set(got) == {1, 2, 7, 9, None} and got[None][0] == (1, 1.0) and all(n is not None for v in got.values() for n, _ in v)
    assert all(n != 9 for n, _ in got[9])
    assert G.nearest(df.limit(0)).count() == 0 == G.nearest(df.limit(0), queries="vec_id > 0").count()
    assert G.nearest(df.filter("vec_id IN (3, 4)")).count() == 0
