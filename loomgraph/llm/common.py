"""Tables in the shared folder, sized broadcasts, row identity and byte views of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of at most so many bytes on disk is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes of text that numpy works on at once.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset in local mode, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(spark.sparkContext, "_loomgraph_dir", None)
        if named is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = spark.sparkContext._loomgraph_dir = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return named.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it from there."""
    spark = df.sparkSession
    path = table_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for t in tables:
        path = t._loomgraph_path
        hadoop = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table_bytes(table: DataFrame) -> int:
    spark = table.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._loomgraph_path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def broadcast_if_small(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a written table whose measured size allows it; else leave the join to a shuffle."""
    return F.broadcast(table) if table_bytes(table) <= limit else table


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``taken``."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out


def text_and_keys(docs: DataFrame) -> DataFrame:
    """``text``, and what stands for a row: ``doc_id`` and a hash ``th`` of the text. Rows equal in both repeat a document."""
    return docs.select(F.col("text").cast("string").alias("text"), "doc_id", F.xxhash64("text").alias("th"))


def with_keys(docs: DataFrame, columns: str) -> str:
    """A schema of ``columns`` and then those of :func:`text_and_keys` but the text."""
    return f"{columns}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint"


def group_rows(rows: DataFrame, size: str) -> DataFrame:
    """From ``same, doc_id, th`` (a null ``same`` equals nothing): ``doc_id, keeper_id, <size>, keep`` for each row.

    The keeper has the least doc_id, nulls last, then the least text hash; ``keep`` is true for one row of each group.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    groups = rows.filter("same IS NOT NULL").groupBy(F.col("same").alias("group")).agg(F.min(order).alias("first"), F.count("*").alias("total"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("same", "doc_id", "th").orderBy(F.lit(1))))
    alone = F.col("same").isNull()
    return ranked.join(groups, F.col("same") == F.col("group"), "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keeper_id"),
        F.coalesce("total", F.lit(1).cast("bigint")).alias(size),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("rn") == 1))).alias("keep"),
    )


def keep_one(docs: DataFrame, rows: DataFrame, tag: str) -> DataFrame:
    """``docs`` without the rows that are not the keeper of their group in ``rows`` (``same, doc_id, th``).

    Only rows that have to go, or that are repeated, are listed and joined; texts move only if that list is large.
    """
    th, did, th2, first, rank = fresh(docs.columns, "_th", "_did", "_th2", "_first", "_rank")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    each = rows.filter("same IS NOT NULL").groupBy("same", "doc_id", "th").agg(F.count("*").alias("m"))
    least = each.groupBy(F.col("same").alias("group")).agg(F.min(order).alias("keeper"), F.sum("m").alias("total")).filter("total > 1")
    act = each.join(least, F.col("same") == F.col("group")).select(
        F.col("doc_id").alias(did), F.col("th").alias(th2), (order == F.col("keeper")).alias(first), "m"
    )
    act = act.select(did, th2, F.col("m").alias(rank), F.when(F.col(first), F.lit(True)).otherwise(F.lit(False)).alias(first))
    act = materialise(act.filter(~F.col(first) | (F.col(rank) > 1)).drop(rank), tag)
    marked = docs.withColumn(th, F.xxhash64("text")).join(
        broadcast_if_small(act), F.col("doc_id").eqNullSafe(F.col(did)) & (F.col(th) == F.col(th2)) & F.col("text").isNotNull(), "left"
    )
    single = marked.filter(F.col(first).isNull()).select(docs.columns)
    others = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    several = marked.filter(F.col(first)).withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", th).orderBy(*others or [F.lit(1)])))
    return single.unionByName(several.filter(F.col(rank) == 1).select(docs.columns))


def text_views(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column: (first row, row after the last, bytes, row starts with the end appended, null mask).

    A slice holds at least one whole row, however long; starts count from the slice's first byte.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    nulls = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + limit, "right")) - 1)
        yield i, j, raw[starts[i] : starts[j]], starts[i : j + 1] - starts[i], nulls[i:j]
        i = j


def segment_positions(starts: np.ndarray) -> np.ndarray:
    """For each byte, its place in its row."""
    lengths = np.diff(starts)
    return np.arange(starts[-1], dtype=np.int64) - np.repeat(starts[:-1], lengths)


#: Words of up to so many bytes are hashed in numpy, by sums of bytes times powers of two odd bases; longer ones by xxhash.
SHORT_WORD = 256
#: Bytes of words that are hashed at once, at some 50 bytes of memory for each.
WORDS_AT_ONCE = 1 << 17
_POWERS = np.stack([np.multiply.accumulate(np.full(SHORT_WORD, base, np.uint64)) for base in (0x100000001B3, 0x9E6C63D0876A9A47)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, starts: np.ndarray, inside: np.ndarray, kinds: int = 1, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashes (``kinds`` rows of independent 64-bit ones) and first byte of each word.

    ``inside`` says of each byte value whether it belongs to words. With ``wide`` every character of three or four bytes is
    a word of its own, since the scripts that have them mostly put no spaces between words.
    """
    within = inside[data]
    first = within.copy()
    first[1:] &= ~within[:-1]
    if wide and len(data) and data.max() >= 0xE0:
        lead = (data & 0xC0) != 0x80
        of = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
        big = data[of] >= 0xE0
        first |= within & lead & (big | np.concatenate(([False], big[:-1])))
    heads = starts[:-1][np.diff(starts) > 0]
    first[heads] = within[heads]
    begin = np.flatnonzero(first)
    hashes = np.zeros((kinds, len(begin)), np.uint64)
    if not len(begin):
        return np.zeros(0, np.int64), hashes, begin
    lengths = np.add.reduceat(within, begin, dtype=np.int64)
    short = np.minimum(lengths, SHORT_WORD)
    ends, i = np.cumsum(short), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + WORDS_AT_ONCE, "right")))
        size = short[i:j]
        own = np.cumsum(size) - size
        place = np.arange(own[-1] + size[-1]) - np.repeat(own, size)
        value = data[place + np.repeat(begin[i:j], size)].astype(np.uint64) + np.uint64(1)
        for k in range(kinds):
            hashes[k, i:j] = mix(np.add.reduceat(_POWERS[k][place] * value, own) + lengths[i:j].astype(np.uint64))
        i = j
    view = memoryview(np.ascontiguousarray(data))
    for w in np.flatnonzero(lengths > SHORT_WORD).tolist():
        whole = xxhash.xxh3_128_intdigest(view[begin[w] : begin[w] + lengths[w]])
        hashes[:, w] = [whole & (2**64 - 1), whole >> 64][:kinds]
    return np.searchsorted(starts, begin, "right") - 1, hashes, begin
