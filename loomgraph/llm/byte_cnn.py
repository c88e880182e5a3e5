"""Quality classifier: a convolutional network over bytes, trained and run in numpy.

Each byte has a learned vector; filters of 8 bytes move over the text in steps of 4. Their outputs are max-pooled over
chunks of 512 bytes that overlap by half and cover the whole text, however long; the chunks' features are combined
(maximum, mean and minimum) and a small layer gives one probability. Training takes a bounded sample of labelled rows
(``MAX_TRAIN`` rows of at most ``MAX_ROW_BYTES``, ``MAX_TRAIN_BYTES`` in all) and runs in one task, which sends back the network
alone; scoring reads every byte of every row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_views

#: At most so many labelled rows train the network: those whose ids hash lowest.
MAX_TRAIN = 5000
#: Of these, texts of at most so many bytes, and so many bytes altogether, in the order of the hashes.
MAX_ROW_BYTES, MAX_TRAIN_BYTES = 1 << 20, 64 << 20
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 4, 32, 16
HALF = 64  # filter positions in half a chunk: 256 bytes
PAD = 256
#: Bytes that are convolved at once, of several texts or of a long one, at some 110 bytes of memory for each; a multiple of half a chunk's.
BLOCK_BYTES = 1 << 18
THRESHOLD = 0.5


def padded(data: np.ndarray, starts: np.ndarray, unit: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as indices, each row padded to whole ``unit`` and one step more; starts of the rows in filter positions."""
    lengths = np.diff(starts)
    room = -(-np.maximum(lengths, 1) // unit) * unit + STRIDE
    begin = np.concatenate(([0], np.cumsum(room)))
    out = np.full(begin[-1], PAD, np.int16)
    out[np.arange(len(data)) + np.repeat(begin[:-1] - starts[:-1], lengths)] = data
    return out, begin // STRIDE


def _convolve(model: dict, ids: np.ndarray) -> np.ndarray:
    x = model["embed"][ids].reshape(-1, STRIDE * EMBED)
    y = x @ model["w"][: STRIDE * EMBED]
    y[:-1] += (x @ model["w"][STRIDE * EMBED :])[1:]
    return y


def pooled(model: dict, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of each filter in each half chunk, and where the rows' halves begin; a single long row is taken in blocks."""
    if len(starts) == 2 and len(data) > BLOCK_BYTES:
        tops = []
        for a in range(0, len(data), BLOCK_BYTES):
            rest = data[a : a + BLOCK_BYTES + STRIDE]
            tops.append(_block(model, rest) if len(data) - a > BLOCK_BYTES else pooled(model, rest, np.array([0, len(rest)]))[0])
        top = np.concatenate(tops)
        return top, np.array([0, len(top)])
    ids, begin = padded(data, starts)
    y = _convolve(model, ids)
    counts = np.diff(begin) - 1  # a row's last step only completes its last filter
    halves = -(-counts // HALF)
    first = np.concatenate(([0], np.cumsum(halves)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], halves)
    at = np.repeat(begin[:-1], halves) + within * HALF
    y[begin[1:] - 1] = -np.inf
    return np.maximum.reduceat(y, at, axis=0), first


def _block(model: dict, data: np.ndarray) -> np.ndarray:
    """The same for a block inside a row: ``BLOCK_BYTES``, and behind them what its last filter reaches."""
    ids, _ = padded(data, np.array([0, len(data)]))
    steps = BLOCK_BYTES // STRIDE
    return np.maximum.reduceat(_convolve(model, ids)[:steps], np.arange(0, steps, HALF), axis=0)


def _chunks(top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two halves of each chunk (the same one where a row has a single half), and where the rows' chunks begin."""
    halves = np.diff(first)
    counts = np.maximum(halves - 1, 1)
    start = np.concatenate(([0], np.cumsum(counts)))
    left = np.repeat(first[:-1], counts) + np.arange(start[-1]) - np.repeat(start[:-1], counts)
    right = np.minimum(left + 1, np.repeat(first[1:], counts) - 1)
    return left, right, start


def _head(model: dict, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(feats @ model["h"] + model["hb"], 0)
    return hidden, hidden @ model["v"] + model["vb"]


def score(model: dict, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Probability of good quality for each row."""
    top, first = pooled(model, data, starts)
    left, right, start = _chunks(top, first)
    chunk = np.maximum(np.maximum(top[left], top[right]) + model["b"], 0)
    most = np.maximum.reduceat(chunk, start[:-1], axis=0)
    mean = np.add.reduceat(chunk, start[:-1], axis=0) / np.diff(start)[:, None]
    least = np.minimum.reduceat(chunk, start[:-1], axis=0)
    _, logit = _head(model, np.concatenate((most, mean, least), axis=1))
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -60, 60)))


def _initial(rng: np.random.Generator) -> dict:
    f = np.float32
    return {
        "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(f),
        "w": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f),
        "b": np.zeros(FILTERS, f),
        "h": rng.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)).astype(f),
        "hb": np.zeros(HIDDEN, f),
        "v": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(f),
        "vb": np.zeros(1, f),
    }


def _gradients(model: dict, data: np.ndarray, starts: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted log loss; only the positions that won a maximum carry any back to the filters."""
    ids, begin = padded(data, starts, HALF * STRIDE)
    y = _convolve(model, ids)
    filled = -(-np.maximum(np.diff(starts), 1) // STRIDE)
    y[np.arange(len(y)) - np.repeat(begin[:-1], np.diff(begin)) >= np.repeat(filled, np.diff(begin))] = -np.inf  # as in scoring
    halves = (np.diff(begin) - 1) // HALF
    first = np.concatenate(([0], np.cumsum(halves)))
    at = np.repeat(begin[:-1], halves) + (np.arange(first[-1]) - np.repeat(first[:-1], halves)) * HALF
    blocks = y[at[:, None] + np.arange(HALF)]
    win = blocks.argmax(axis=1)
    top = np.take_along_axis(blocks, win[:, None, :], 1)[:, 0]
    left, right, start = _chunks(top, first)
    from_left = top[left] >= top[right]
    chunk = np.maximum(np.where(from_left, top[left], top[right]) + model["b"], 0)
    counts = np.diff(start)
    row = np.repeat(np.arange(len(counts)), counts)
    most = np.maximum.reduceat(chunk, start[:-1], axis=0)
    mean = np.add.reduceat(chunk, start[:-1], axis=0) / counts[:, None]
    least = np.minimum.reduceat(chunk, start[:-1], axis=0)
    feats = np.concatenate((most, mean, least), axis=1)
    hidden, logit = _head(model, feats)
    d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) * weight).astype(np.float32)
    g = {"v": hidden.T @ d, "vb": d.sum(keepdims=True)}
    dh = d[:, None] * model["v"] * (hidden > 0)
    g |= {"h": feats.T @ dh, "hb": dh.sum(axis=0)}
    df = dh @ model["h"].T
    dc = (df[:, FILTERS : 2 * FILTERS] / counts[:, None])[row]
    for won, part in ((chunk == most[row], df[:, :FILTERS]), (chunk == least[row], df[:, 2 * FILTERS :])):
        dc += won * (part / np.add.reduceat(won.astype(np.float32), start[:-1], axis=0))[row]
    dc *= chunk > 0
    g["b"] = dc.sum(axis=0)
    dt = np.zeros_like(top)
    np.add.at(dt, left, dc * from_left)
    np.add.at(dt, right, dc * ~from_left)
    half, filt = np.nonzero(dt)
    value = dt[half, filt]
    place = (at[half] + win[half, filt])[:, None] * STRIDE + np.arange(WIDTH)
    window = ids[place]
    gw = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
    np.add.at(gw, filt, value[:, None] * model["embed"][window].reshape(len(half), -1))
    g["w"] = gw.T
    ge = np.zeros_like(model["embed"])
    np.add.at(ge, window.ravel(), (value[:, None] * model["w"].T[filt]).reshape(-1, EMBED))
    g["embed"] = ge
    return g


def train(texts: list[bytes], labels: list[int], epochs: int = 6, batch: int = 16, rate: float = 0.005, seed: int = 5) -> dict | None:
    """A network for P(label = 1), with both classes weighted alike; None unless both occur."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    model = _initial(rng)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    t = 0
    steps = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i : i + batch]
            data = np.frombuffer(b"".join(texts[k] for k in pick), np.uint8)
            starts = np.concatenate(([0], np.cumsum([len(texts[k]) for k in pick])))
            grads, t = _gradients(model, data, starts, y[pick], share[pick] / len(pick)), t + 1
            pace = rate * (1 - t / (steps + 1))
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                model[k] -= (pace * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, limit_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """``doc_id, body, quality``: whole texts and labels of a bounded number of labelled rows, chosen by the hash of their ids."""
    marked = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("body")).filter(F.octet_length("body") <= MAX_ROW_BYTES)
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("body").alias("body"), F.min("quality").alias("quality"))
    before = F.sum(F.octet_length("body")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < limit_bytes).drop("before")


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["doc_id"], r["body"], r["quality"]) for batch in batches for r in batch.to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> dict | None:
    """Trains in one task, on rows that :func:`training_rows` bounds; the network has about 8,000 numbers."""
    got = training_rows(docs, labels, limit).coalesce(1).mapInArrow(_train_rows, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


def _score_rows(model: dict | None, text_at: int, threshold: float, whole: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_at)
            out = np.full(len(batch), np.nan)
            for i, j, data, starts, _ in text_views(text, BLOCK_BYTES):
                if model is not None:
                    out[i:j] = np.where(np.diff(starts) > 0, score(model, data, starts), 0.0)
            null = text.is_null().to_numpy(zero_copy_only=False)
            keep = ~null & (np.round(out, 6) >= threshold if model is not None else True)
            if whole:
                yield batch.filter(pa.array(keep))
            else:
                p = pa.array(np.round(out, 6), pa.float64(), mask=np.isnan(out) | null)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], p, pa.array(keep)], [*batch.schema.names[1:], "quality_p", "keep"])

    return rows


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_TRAIN) -> DataFrame:
    """For each row of ``docs``: ``doc_id, quality_p, keep``.

    ``keep`` is ``quality_p >= threshold``. An empty text has probability 0. A null text has none (null) and isn't kept.
    Without labelled rows of both classes there is no network: probabilities are null and all rows with a text are
    kept. Labels with null or other values are passed over; of repeated labels the least counts. A very long text is scored
    in blocks, every byte of it. Repeated rows are scored each; an empty table gives an empty result; further columns of any
    name are ignored.
    """
    base = docs.select(F.col("text").cast("string").alias("text"), "doc_id")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality_p double, keep boolean"
    return base.mapInArrow(_score_rows(fit(docs, labels, limit), 0, threshold, False), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_scores` keeps, with all their columns, whatever their names; one pass, nothing is joined.

    Rows with a null or an empty text go, unless no network could be trained: then only null texts do. Repeated rows are
    judged each; an empty table gives an empty result.
    """
    return docs.mapInArrow(_score_rows(fit(docs, labels, limit), docs.columns.index("text"), threshold, True), docs.schema)
