"""Packing of examples into bins under limits on tokens, segments and loss-bearing tokens at once.

Vector bin packing by the dot-product heuristic: a bin is open, and of all examples that still fit the one goes in whose
vector has the largest dot product with the bin's remaining room, each dimension weighted by its mean demand; when
nothing fits, the bin is closed. Examples are dealt by hash into groups of about ``GROUP``, which are packed apart from
each other, so that only ids and three numbers are shuffled and no task grows with the corpus; each group leaves at
most one badly filled bin or so for hundreds of good ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vocabulary import encoder

#: Most tokens, segments and loss-bearing tokens in a bin.
LIMITS = (4096, 32, 3072)
#: The same for plain documents, where every token bears loss.
DOCUMENT_LIMITS = (8192, 64, 8192)
GROUP = 8192
#: Tokens that end each example.
SEPARATORS = 1
_BIN_BITS = 24


def pack_group(vectors: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each row of ``vectors``; rows over a limit come last, in bins of their own."""
    n, cap = len(vectors), np.array(limits, np.int64)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    fits = (vectors <= cap).all(axis=1)
    kinds, kind = np.unique(-vectors[fits], axis=0, return_inverse=True)
    kinds, members = -kinds, np.flatnonzero(fits)[np.argsort(kind.ravel(), kind="stable")]
    left = np.bincount(kind.ravel(), minlength=len(kinds))
    upto = np.cumsum(left)
    share = kinds / np.maximum(cap, 1)
    weight = (share * left[:, None]).sum(axis=0) / max(1, left.sum())
    now = 0
    while left.any():
        if (left == 0).mean() > 0.3:
            live = left > 0
            kinds, share, left, upto = kinds[live], share[live], left[live], upto[live]
        room, place = cap.copy(), 0
        while True:
            can = (left > 0) & (kinds[:, 0] <= room[0]) & (kinds[:, 1] <= room[1]) & (kinds[:, 2] <= room[2])
            value = np.where(can, share @ (weight * room / np.maximum(cap, 1)), -1.0)
            best = int(value.argmax())
            if value[best] < 0:
                break
            at = members[upto[best] - left[best]]
            left[best] -= 1
            bins[at], places[at] = now, place
            room -= kinds[best]
            place += 1
        now += 1
    over = np.flatnonzero(~fits)
    bins[over] = now + np.arange(len(over))
    return bins, places


def _pack_rows(limits: tuple[int, int, int], size: int):
    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("n_loss", "descending"), ("id", "ascending")])
        vectors = np.stack([table.column(c).to_numpy() for c in ("n_tokens", "n_segments", "n_loss")], axis=1).astype(np.int64).reshape(-1, 3)
        parts = -(-len(vectors) // size)  # more than one where ids repeat so often that the hash can't part them
        bins, places, base = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64), 0
        for k in range(parts):
            b, p = pack_group(vectors[k::parts], limits)
            bins[k::parts], places[k::parts] = b + base, p
            base += int(b.max()) + 1
        over = (vectors > np.array(limits)).any(axis=1)
        return pa.table(
            [table.column("id"), pa.array((key[0].as_py() << _BIN_BITS) + bins), pa.array(places), *(table.column(c) for c in ("n_tokens", "n_segments", "n_loss")), pa.array(over)],
            ["id", "bin_id", "position", "n_tokens", "n_segments", "n_loss", "oversize"],
        )

    return packed


def pack(examples: DataFrame, id_col: str, limits: tuple[int, int, int] = LIMITS, group: int = GROUP) -> DataFrame:
    """From ``<id_col>, n_tokens, n_segments, n_loss``: the same with ``bin_id, position, oversize`` for each row.

    An example over a limit by itself stays whole in a bin of its own and is marked ``oversize``. A null number counts
    as 0, a null id is an id like others, and repeated rows are packed each. Ties go to the larger vector, then to the
    lower id. An empty table gives an empty result; further columns are ignored.
    """
    numbers = [F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in ("n_tokens", "n_segments", "n_loss")]
    rows = examples.select(F.col(id_col).alias("id"), *numbers)
    total = examples.count()
    groups = max(1, -(-total // group))
    dealt = rows.withColumn("lot", F.pmod(F.xxhash64("id", "n_tokens", "n_loss"), F.lit(groups)))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, bin_id bigint, position bigint, n_tokens bigint, n_segments bigint, n_loss bigint, oversize boolean"
    return dealt.groupBy("lot").applyInArrow(_pack_rows(limits, 2 * group), schema).withColumnRenamed("id", id_col)


def _count_rows(raw: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(raw).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], [*batch.schema.names[1:], "n_tokens"])

    return rows


def document_examples(docs: DataFrame, raw: bytes, separators: int = SEPARATORS) -> DataFrame:
    """``doc_id, n_tokens, n_segments, n_loss`` for each row: whole texts, one segment each, every token bears loss."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select(F.col("text").cast("string"), "doc_id").mapInArrow(_count_rows(raw), f"doc_id {kind}, n_tokens bigint")
    n = F.col("n_tokens") + separators
    return counted.select("doc_id", n.alias("n_tokens"), F.lit(1).cast("bigint").alias("n_segments"), n.alias("n_loss"))


def conversation_examples(turns: DataFrame, raw: bytes, separators: int = SEPARATORS) -> DataFrame:
    """``conv_id, n_tokens, n_segments, n_loss`` for each conversation: one segment, the assistant's tokens bear loss.

    Each turn, repeated ones too, adds its tokens and the separators; turns with a null conv_id form one conversation,
    and a null text or role adds no tokens or no loss.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    base = turns.select(F.col("text").cast("string"), "conv_id", F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    counted = base.mapInArrow(_count_rows(raw), f"conv_id {kind}, loss boolean, n_tokens bigint")
    n = F.col("n_tokens") + separators
    return counted.groupBy("conv_id").agg(
        F.sum(n).alias("n_tokens"), F.lit(1).cast("bigint").alias("n_segments"), F.sum(F.when(F.col("loss"), n).otherwise(0)).alias("n_loss")
    )


def pack_conversations(turns: DataFrame, raw: bytes, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """:func:`pack` over :func:`conversation_examples`."""
    return pack(materialise(conversation_examples(turns, raw), "examples"), "conv_id", limits)


def pack_documents(docs: DataFrame, raw: bytes, limits: tuple[int, int, int] = DOCUMENT_LIMITS) -> DataFrame:
    """:func:`pack` over :func:`document_examples`."""
    return pack(materialise(document_examples(docs, raw), "examples"), "doc_id", limits)
