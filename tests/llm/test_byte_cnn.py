import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import byte_cnn as C

LABELS = "doc_id bigint, quality int, toxic int"


def naive_score(model, text):
    """The network as it is defined, one filter position after the other."""
    ids, room = list(text), -(-max(len(text), 1) // C.STRIDE) * C.STRIDE + C.STRIDE
    ids += [C.PAD] * (room - len(ids))
    positions = room // C.STRIDE - 1
    y = np.stack([model["embed"][ids[p * C.STRIDE : p * C.STRIDE + C.WIDTH]].ravel() @ model["w"] for p in range(positions)])
    halves = [y[i : i + C.HALF].max(axis=0) for i in range(0, positions, C.HALF)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    chunk = np.maximum(np.stack(chunks) + model["b"], 0)
    feats = np.concatenate((chunk.max(axis=0), chunk.mean(axis=0), chunk.min(axis=0)))
    hidden = np.maximum(feats @ model["h"] + model["hb"], 0)
    return 1 / (1 + np.exp(-(hidden @ model["v"] + model["vb"])[0]))


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def test_scores_against_the_definition():
    rng = np.random.default_rng(0)
    model = C._initial(rng)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 3, 4, 9, 255, 256, 257, 700, 5000)]
    got = C.score(model, *joined(texts))
    assert np.allclose(got, [naive_score(model, t) for t in texts], atol=1e-4)


def test_a_long_text_in_blocks(monkeypatch):
    model = C._initial(np.random.default_rng(2))
    rng = np.random.default_rng(3)
    for n in (1024, 1025, 1027, 1028, 1029, 2048, 2500, 5003):
        text = bytes(rng.integers(0, 256, n, dtype=np.uint8))
        whole = C.score(model, *joined([text]))
        monkeypatch.setattr(C, "BLOCK_BYTES", 1024)
        assert np.allclose(C.score(model, *joined([text])), whole, atol=1e-6), n
        monkeypatch.undo()


def test_memory_for_50_mb():
    import tracemalloc

    model = C._initial(np.random.default_rng(2))
    data = np.random.default_rng(4).integers(0, 256, 50_000_000).astype(np.uint8)
    tracemalloc.start()
    C.score(model, data, np.array([0, len(data)]))
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_memory_for_a_batch_of_texts():
    """Executors have room for some tens of MB beside the batch, however many texts it has."""
    import tracemalloc

    model = C._initial(np.random.default_rng(2))
    letters = np.random.default_rng(4).integers(97, 123, 8_000_000).astype(np.uint8).tobytes().decode()
    for size in (2000, 200_000, 8_000_000):
        batch = pa.RecordBatch.from_arrays([pa.array([letters[i : i + size] for i in range(0, len(letters), size)])], ["text"])
        tracemalloc.start()
        assert len(next(C._score_rows(model, 0, 0.5, False)(iter([batch])))) == len(batch)
        assert tracemalloc.get_traced_memory()[1] < 60e6, size
        tracemalloc.stop()


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    model = {k: v.astype(np.float64) for k, v in C._initial(rng).items()}
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (200, 900, 1500)]
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.2, 0.3])

    def loss():
        data, starts = joined(texts)
        p = np.array([naive_score(model, t) for t in texts])
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()

    g = C._gradients(model, *joined(texts), target, weight)
    for name in ("v", "vb", "hb", "b", "h", "w", "embed"):
        flat, grad = model[name].reshape(-1), g[name].reshape(-1)
        picked = range(min(6, len(flat))) if len(flat) < 100 else np.argsort(-np.abs(grad))[:6]
        for i in picked:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / 2e-5, rel=0.05, abs=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    got = C.quality_scores(docs, train).join(held, "doc_id").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.95 * len(good)
    assert sum(not r.keep for r in bad) >= 0.8 * len(bad)


def test_odd(spark, odd, clash, none):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (8, 0, 0), (8, 1, 0), (10, 0, 0), (None, 1, 0), (2, None, None), (9, 7, 0), (3, 1, 0)], LABELS)
    for docs in (odd, clash):
        got = C.quality_scores(docs, labels).collect()
        assert len(got) == docs.count()
        assert {(r.quality_p, r.keep) for r in got if r.doc_id in (4, 5)} == {(0.0, False)}
        assert {(r.quality_p, r.keep) for r in got if r.doc_id == 3} == {(None, False)}
        kept = C.keep_good(docs, labels)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
        unlabelled = C.quality_scores(docs, labels.limit(0)).collect()
        assert {(r.quality_p, r.keep) for r in unlabelled if r.doc_id != 3 and r.doc_id is not None} == {(None, True)}
    assert C.quality_scores(none, labels).count() == 0
    assert C.fit(odd, labels.filter("quality = 1")) is None
