"""Exact deduplication over content-defined chunk recipes.

Texts are cut where a rolling hash of the last bytes matches a mask, so equal texts have equal chunks. Chunks are
deduplicated once, by digest *and* bytes; a digest is taken as identifier only if no two different chunks share it, else
a longer one is tried. From then on a document is its ordered list of identifiers (16 bytes for about 1 KB of text), and
only those lists are shuffled and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_rows, keep_one, materialise, segment_positions, text_and_keys, text_views, with_keys

WINDOW = 16
MIN_BYTES, MEAN_BITS, MAX_BYTES = 256, 10, 8192
_GEAR = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)
_MULT = 0x9E3779B97F4A7C15


def _xxh(chunk) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _blake(chunk) -> bytes:
    return hashlib.blake2b(chunk, digest_size=32).digest()


DIGESTS: tuple[tuple[Callable, int], ...] = ((_xxh, 16), (_blake, 32))


def cut_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of all chunks of the rows in ``data``, row ends included; an empty row has no chunk."""
    if not len(data):
        return np.zeros(0, np.int64)
    rolling, step, power = _GEAR[data], 1, _MULT
    while step < WINDOW:
        rolling[step:] += rolling[:-step] * np.uint64(power)
        step, power = step * 2, power * power % 2**64
    inner = segment_positions(starts) >= WINDOW - 1
    marks = np.flatnonzero(inner & ((rolling >> np.uint64(40)) & np.uint64((1 << MEAN_BITS) - 1) == 0)) + 1
    ends: list[int] = []
    lo = np.searchsorted(marks, starts[:-1], "right")
    hi = np.searchsorted(marks, starts[1:], "left")
    for at, end, i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), lo.tolist(), hi.tolist()):
        if end == at:
            continue
        for m in marks[i:j].tolist() if end - at > MIN_BYTES else ():
            while m - at > MAX_BYTES:
                at += MAX_BYTES
                ends.append(at)
            if m - at >= MIN_BYTES:
                ends.append(m)
                at = m
        while end - at > MAX_BYTES:
            at += MAX_BYTES
            ends.append(at)
        if end > at:
            ends.append(end)
    return np.array(ends, np.int64)


def _chunk_rows(digest: Callable, width: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, starts, _ in text_views(batch.column(0)):
                ends = cut_points(data, starts)
                if not len(ends):
                    continue
                view, begin = memoryview(data), 0
                ids = []
                for e in ends.tolist():
                    ids.append(digest(view[begin:e]))
                    begin = e
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                bodies = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), bodies], ["h", "chunk"])

    return rows


def _recipe_rows(digest: Callable, width: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes: list[bytes | None] = []
            for _, _, data, starts, nulls in text_views(batch.column(0)):
                ends = cut_points(data, starts)
                view, begin, ids = memoryview(data), 0, []
                for e in ends.tolist():
                    ids.append(digest(view[begin:e]))
                    begin = e
                upto = np.searchsorted(ends, starts, "right")
                whole = b"".join(ids)
                recipes += [None if gone else whole[a * width : b * width] for a, b, gone in zip(upto[:-1].tolist(), upto[1:].tolist(), nulls.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(recipes, pa.binary()), *batch.columns[1:]], ["same", *batch.schema.names[1:]])

    return rows


def verified_digest(docs: DataFrame, text: str = "text", digests=DIGESTS) -> tuple[Callable, int]:
    """The first digest under which every identifier stands for one content in all of ``docs``."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    for digest, width in digests:
        chunks = texts.mapInArrow(_chunk_rows(digest, width), "h binary, chunk binary").distinct()
        if chunks.groupBy("h").count().filter("count > 1").isEmpty():
            return digest, width
    raise ValueError("every digest has collisions; add a longer one to DIGESTS")


def recipes(docs: DataFrame, digests=DIGESTS) -> DataFrame:
    """For each row ``same`` (its list of verified identifiers as bytes; null for a null text), ``doc_id, th``.

    They are written, since they are read more than once and texts should be cut only once for them.
    """
    digest, width = verified_digest(docs, digests=digests)
    return materialise(text_and_keys(docs).mapInArrow(_recipe_rows(digest, width), with_keys(docs, "same binary")), "recipes")


def exact_duplicates(docs: DataFrame, digests=DIGESTS) -> DataFrame:
    """For each row of ``docs``: ``doc_id, keeper_id, n_copies, keep``.

    Rows with byte-equal texts form a group; ``keeper_id`` is its least doc_id (null ids come last), ``n_copies`` its rows,
    and ``keep`` is true for exactly one row, of that id. Empty texts are equal to one another. A null text equals
    nothing: such a row is its own keeper with one copy. Repeated rows (same id and text) count each, and one is kept.
    A very long text is cut whole; its recipe is about a 64th of it. An empty table gives an empty result; further columns
    of any name are ignored.
    """
    return group_rows(recipes(docs, digests), "n_copies")


def drop_exact_duplicates(docs: DataFrame, digests=DIGESTS) -> DataFrame:
    """``docs`` with one row of each group of :func:`exact_duplicates`, all columns kept as they are.

    Of repeated rows (same id and text) the one whose remaining columns sort first stays. Null texts all stay.
    """
    return keep_one(docs, recipes(docs, digests), "exact")
