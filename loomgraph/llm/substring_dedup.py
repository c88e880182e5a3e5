"""Removal of passages that repeat anywhere in the corpus, with a count-min prefilter.

A window is ``WINDOW`` words in a row. Pass one: each unit of about 4 MB of text makes a sparse count-min sketch of its
windows (two rows of cells) and sends it, cut by ranges of cells, to the merging tasks; a merged range answers every unit
with one bit for each of its cells: does it hold two or more? So no task ever holds the whole sketch, and both what is
sent and what is held grow in proportion to the text. Pass two: a unit reads its answers, and only windows whose cells all
say "two or more" are sent on, under two independent 64-bit hashes (of independent hashes of their words), to be grouped. Counts of a sketch are never too low, so no
repeated window is lost; a unit that finds no answer under its content hash sends all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import broadcast_if_small, fresh, materialise, mix, table_path, text_and_keys, text_views, words_of

WINDOW = 50
UNIT_BYTES = 4 << 20
#: Rows of the sketch, cells for each window of the corpus in each row, and windows for each range of cells.
DEPTH, SPARE, RANGE_WINDOWS = 2, 4, 4 << 20
_SPACE = np.array([b not in b" \t\n\r\f" for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SALTS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def windows(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place among the row's words, and two hashes of each window of whole words, made from independent hashes of its words."""
    row, words, _ = words_of(data, starts, _SPACE, 2)
    n = len(row)
    first = np.searchsorted(row, row, "left") if n else row
    at = np.flatnonzero(row[: n - window + 1] == row[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    one = np.ones(1, np.uint64)
    up = np.multiply.accumulate(np.concatenate((one, np.full(n, _BASE, np.uint64))))
    down = np.multiply.accumulate(np.concatenate((one, np.full(n, _INVERSE, np.uint64))))
    out = []
    for word, salt in zip(words, _SALTS):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(word ^ np.uint64(salt)) * up[:n])))
        out.append(mix((sums[at + window] - sums[at]) * down[at]))
    return row[at], (at - first[at]), out[0], out[1]


def _cells(h1: np.ndarray, h2: np.ndarray, depth: int, bits: int) -> np.ndarray:
    return mix(h1 + np.uint64(depth) * h2) >> np.uint64(64 - bits)


def _unit(data: np.ndarray, starts: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(data, seed=xxhash.xxh3_64_intdigest(starts)) >> 1


def _own(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of a unit, ascending, and whether it has them once or more often."""
    cells = np.sort(cells)
    new = np.concatenate(([True], cells[1:] != cells[:-1]))
    at = np.flatnonzero(new)
    return cells[at], np.diff(np.append(at, len(cells))) > 1


def _sketch_rows(window: int, bits: int, range_bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)
        for batch in batches:
            for _, _, data, starts, _ in text_views(batch.column(0), UNIT_BYTES):
                _, _, h1, h2 = windows(data, starts, window)
                if not len(h1):
                    continue
                unit, part, row, body = _unit(data, starts), [], [], []
                for d in range(DEPTH):
                    cells, often = _own(_cells(h1, h2, d, bits))
                    top = cells >> np.uint64(bits - range_bits)
                    cuts = np.concatenate(([0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(cells)]))
                    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        inner = cells[i:j] - (top[i] << np.uint64(bits - range_bits))
                        gaps = np.diff(inner, prepend=np.uint64(0)).astype(np.uint32)
                        raw = gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.packbits(often[i:j]).tobytes()
                        part.append(d << range_bits | int(top[i]))
                        row.append(j - i)
                        body.append(squeeze.compress(raw))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([unit] * len(part), pa.int64()), pa.array(row, pa.int32()), pa.array(body, pa.binary())], ["part", "unit", "n", "body"])

    return rows


def merge(size: int):
    """Merges the sketches of one range, and answers each with its cells' "two or more" bits."""

    def answer(table: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.uint8)
        expand = zstandard.ZstdDecompressor()
        held = []
        for n, body in zip(table.column("n").to_pylist(), table.column("body").to_pylist()):
            raw = np.frombuffer(expand.decompress(body), np.uint8)
            gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
            cells = np.cumsum(gaps, dtype=np.int64)
            often = np.unpackbits(raw[4 * n :], count=n)
            counts[cells] = np.minimum(2, counts[cells] + 1 + often)
            held.append(cells)
        bits = [np.packbits(counts[cells] > 1).tobytes() for cells in held]
        return pa.table([table.column("unit"), table.column("part"), table.column("n"), pa.array(bits, pa.binary())], ["unit", "part", "n", "bits"])

    return answer


def _answers(path: str, bucket: int, unit: int) -> list[dict]:
    fs, inner = pafs.FileSystem.from_uri(path)
    folder = f"{inner}/bucket={bucket}"
    if fs.get_file_info(folder).type == pafs.FileType.NotFound:
        return []
    return pq.read_table(folder, filesystem=fs, partitioning=None, filters=[("unit", "==", unit)]).to_pylist()


def _flags(h1: np.ndarray, h2: np.ndarray, found: list[dict], bits: int) -> np.ndarray:
    """Which windows may repeat, from the answers to a unit; all, if these aren't complete."""
    flags = np.ones(len(h1), bool)
    by_part = sorted({r["part"]: r for r in found}.values(), key=lambda r: r["part"])
    said = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in by_part]
    says = np.concatenate(said).astype(bool) if said else np.zeros(0, bool)
    at = 0
    for d in range(DEPTH):
        cells = _cells(h1, h2, d, bits)
        own, _ = _own(cells)
        if at + len(own) > len(says):
            return np.ones(len(h1), bool)
        flags &= says[at : at + len(own)][np.searchsorted(own, cells)]
        at += len(own)
    return flags if at == len(says) else np.ones(len(h1), bool)


def _window_rows(window: int, bits: int, path: str, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            gone = ids.is_null().to_numpy(zero_copy_only=False)
            _, rank = np.unique(ids.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
            rank = np.where(gone, len(ids), rank)
            for i, j, data, starts, _ in text_views(batch.column(0), UNIT_BYTES):
                row, place, h1, h2 = windows(data, starts, window)
                if not len(h1):
                    continue
                unit = _unit(data, starts)
                keep = np.flatnonzero(_flags(h1, h2, _answers(path, unit % buckets, unit), bits))
                if not len(keep):
                    continue
                row, h1, h2 = row[keep] + i, h1[keep].view(np.int64), h2[keep].view(np.int64)
                at = th[row] << 32 | place[keep]
                by = np.lexsort((at, rank[row], h2, h1))
                h1, h2, row, at = h1[by], h2[by], row[by], at[by]
                again = np.zeros(len(by), bool)
                again[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
                head = np.maximum.accumulate(np.where(again, 0, np.arange(len(by))))
                same = (rank[row] == rank[row[head]]) & (at == at[head])
                send = ~(again & same)  # a repeated row stands where the first one does
                mask = again[send]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[send], mask=mask), pa.array(h2[send], mask=mask), ids.take(pa.array(row[send])), pa.array(at[send])], ["h1", "h2", "doc_id", "at"]
                )

    return rows


def runs(places: np.ndarray, window: int) -> list[int]:
    """Begins and ends of the runs of words that windows at ``places`` cover."""
    at = np.unique(places)
    cut = np.flatnonzero(np.diff(at) > window) + 1
    begin, last = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))]
    return np.stack((begin, last + window), axis=1).ravel().tolist()


def _run_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = [runs(values[i:j], window) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["id", "th", "cut"])

    return rows


def repeated_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, th, cut`` for each document with words to cut: ``th`` are 32 bits of its text's hash, ``cut`` begins and ends of runs of words."""
    spark = docs.sparkSession
    keyed = text_and_keys(docs)
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = SPARE * max(total // 6, 1024)
    bits = max(16, (cells - 1).bit_length())
    range_bits = max(0, bits - (SPARE * RANGE_WINDOWS - 1).bit_length())
    buckets = max(1, total // (16 * UNIT_BYTES))
    sketches = keyed.mapInArrow(_sketch_rows(window, bits, range_bits), "part bigint, unit bigint, n int, body binary")
    answered = sketches.groupBy("part").applyInArrow(merge(1 << (bits - range_bits)), "unit bigint, part bigint, n int, bits binary")
    answered = answered.withColumn("bucket", F.pmod("unit", F.lit(buckets)))
    path = table_path(spark, "answers")
    answered.repartition("bucket").sortWithinPartitions("bucket", "unit").write.partitionBy("bucket").option("parquet.block.size", 1 << 20).parquet(path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = keyed.mapInArrow(_window_rows(window, bits, path, buckets), f"h1 bigint, h2 bigint, doc_id {kind}, at bigint")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at")
    known = found.filter("h1 IS NULL").select("doc_id", "at")
    first = F.min(key).over(Window.partitionBy("h1", "h2"))
    other = found.filter("h1 IS NOT NULL").withColumn("first", first).filter(key > F.col("first")).select("doc_id", "at")
    later = known.unionByName(other)
    places = later.groupBy("doc_id", F.shiftright("at", 32).alias("th")).agg(F.collect_list(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("places"))
    return places.mapInArrow(_run_rows(window), f"id {kind}, th bigint, cut array<int>")


def _cut_rows(text_at: int, counted: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lists = batch.column(text_at), batch.column(batch.num_columns - 1)
            bodies, removed = text.to_pylist() if lists.null_count < len(lists) else None, np.zeros(len(batch), np.int64)
            for k in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                bodies[k], removed[k] = cut_words(bodies[k], lists[k].as_py())
            out = text if bodies is None else pa.array(bodies, text.type)
            columns = [out if k == text_at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], [*batch.schema.names[:-1], counted])

    return rows


def cut_words(text: str, cut: list[int]) -> tuple[str, int]:
    """``text`` without the words of the runs ``cut`` and the white space before each of them; how many words these were."""
    raw = text.encode()
    inside = _SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    ends = np.flatnonzero(edge == -1)
    keep, at, n = [], 0, 0
    for a, b in zip(cut[::2], cut[1::2]):
        keep.append(raw[at : ends[a - 1] if a else 0])
        at, n = ends[b - 1], n + b - a
    return b"".join([*keep, raw[at:]]).decode(), n


def _cut(docs: DataFrame, window: int, counted: str) -> DataFrame:
    cuts = materialise(repeated_runs(docs, window), "cuts")
    own, did, th, cut = fresh([*docs.columns, counted], "_own", "_did", "_th", "_cut")
    cuts_ = broadcast_if_small(cuts).select(F.col("id").alias(did), F.col("th").alias(th), F.col("cut").alias(cut))
    marked = docs.withColumn(own, F.shiftright(F.shiftleft(F.xxhash64("text"), 32), 32))
    joined = marked.join(cuts_, F.col("doc_id").eqNullSafe(F.col(did)) & (F.col(own) == F.col(th)) & F.col("text").isNotNull(), "left")
    schema = StructType([*docs.schema.fields, StructField(counted, LongType())])
    return joined.select(*docs.columns, cut).mapInArrow(_cut_rows(docs.columns.index("text"), counted), schema)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of ``docs``: ``doc_id, text, n_removed``, with the words gone that repeat an earlier passage.

    Words are runs of bytes other than white space. Of equal windows of ``window`` words the first in order of doc_id
    (null ids last), of the text's hash for rows with equal ids, and of place stays; of all later ones, in the same
    document too, every word goes with the white space before it. Rows equal in id and text count as one and are cut
    alike. A null or empty text, or one of fewer words, stays as it is. A very long text is read whole, in one unit, with
    some tens of bytes of memory for each of its own. An empty table gives an empty result; further columns of any name are
    ignored.
    """
    return _cut(docs.select("doc_id", F.col("text").cast("string").alias("text")), window, "n_removed")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the texts of :func:`without_repeats`; all rows and other columns stay as they are."""
    (counted,) = fresh(docs.columns, "n_removed")
    return _cut(docs, window, counted).drop(counted)
