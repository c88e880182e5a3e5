"""Range partitioning by sampled splitters, for shards of a target size.

A record enters the sample with a chance proportional to its size, so that equal numbers of samples stand for equal
amounts of bytes; every ``OVERSAMPLE``-th sample in key order is a splitter. Records go to the range of their key, the
ranges are measured exactly, and a range that is still too large (one hot key, say) is subdivided by a hash of its
records. Chances come from hashes, so a run can be repeated.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField,
    StructType, TimestampType,
)

from .common import fresh, materialise

TARGET_BYTES = 64 << 20
#: Samples for each shard, and how much larger than the target a range may be before it is subdivided.
OVERSAMPLE, SLACK = 64, 1.5
#: Bytes that a record counts besides its text.
RECORD_BYTES = 64


def sort_key(columns: list[Column]) -> Column:
    """Bytes that sort as the columns do, one after the other, nulls first; strings by their UTF-8."""
    parts = []
    for c in columns:
        # zero bytes inside a value are escaped, so that no value runs into the next column
        body = F.replace(c.cast("string"), F.lit("\x00"), F.lit("\x00\x01"))
        parts.append(F.when(c.isNull(), F.lit("\x01")).otherwise(F.concat(F.lit("\x02"), body, F.lit("\x00\x00"))))
    return F.encode(reduce(lambda a, b: F.concat(a, b), parts), "utf-8")


def number_key(c: Column) -> Column:
    """A whole number as a string of fixed width that sorts as the number does."""
    return F.when(c < 0, F.concat(F.lit("0"), F.lpad((c.cast("decimal(38,0)") + F.lit("1" + "0" * 19).cast("decimal(38,0)")).cast("string"), 20, "0"))).otherwise(
        F.concat(F.lit("1"), F.lpad(c.cast("string"), 20, "0"))
    )


def float_key(c: Column) -> Column:
    """A double as a string that sorts as the number does: its sign, its decimal exponent and its digits, for negative ones
    all turned round. -0.0 equals 0.0; NaN comes last, after infinity, as in Spark's own order."""
    written = F.format_string("%.17e", F.abs(c.cast("double")))  # the shortest digits that tell a double from all others, and zeros
    exponent = F.lpad((F.substring_index(written, "e", -1).try_cast("int") + 500).cast("string"), 3, "0")
    body = F.concat(exponent, F.replace(F.substring_index(written, "e", 1), F.lit("."), F.lit("")))
    infinite = F.abs(c) == float("inf")
    return (
        F.when(F.isnan(c), F.lit("5"))
        .when(infinite, F.when(c > 0, F.lit("4")).otherwise(F.lit("0")))
        .when(c == 0, F.lit("2"))
        .when(c > 0, F.concat(F.lit("3"), body))
        .otherwise(F.concat(F.lit("1"), F.translate(body, "0123456789", "9876543210")))
    )


def decimal_key(c: Column, precision: int, scale: int) -> Column:
    """A decimal as a string of fixed width that sorts as the number does."""
    body = F.to_char(F.abs(c), F.lit("0" * max(1, precision - scale) + ("." + "0" * scale if scale else "")))
    return F.when(c < 0, F.concat(F.lit("0"), F.translate(body, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), body))


def ordered_key(name: str, kind: DataType) -> Column:
    """The column as a string that sorts as its values do; a kind that has no such form is an error."""
    c = F.col(name)
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return number_key(c)
    if isinstance(kind, (FloatType, DoubleType)):
        return float_key(c)
    if isinstance(kind, DecimalType):
        return decimal_key(c, kind.precision, kind.scale)
    if isinstance(kind, BooleanType):
        return c.cast("int").cast("string")
    if isinstance(kind, DateType):
        return number_key(F.unix_date(c).cast("bigint"))
    if isinstance(kind, TimestampType):
        return number_key(F.unix_micros(c))
    if isinstance(kind, BinaryType):
        return F.hex(c)
    if isinstance(kind, StringType):
        return c
    raise TypeError(f"can't order ranges of {name}, which is {kind.simpleString()}")


def _keyed(docs: DataFrame, keys: list[str]) -> Column:
    return sort_key([ordered_key(k, docs.schema[k].dataType) for k in keys])


def splitters(sample: DataFrame, shards: int, oversample: int = OVERSAMPLE) -> list[bytes]:
    """Up to ``shards - 1`` keys that cut the sample (``key``) into equal parts; equal keys are never parted.

    Positions come from counts of range-partitioned parts, so no task sees the whole sample. The splitters come to the
    driver and go to all workers: one key for each ``TARGET_BYTES`` of the corpus.
    """
    if shards < 2:
        return []
    parts = max(1, shards * oversample // 100_000)
    ordered = materialise(sample.repartitionByRange(parts, "key").select("key", F.spark_partition_id().alias("part")), "sample")
    sizes = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    if not total:
        return []
    before = F.create_map(*(F.lit(x) for p in offsets for x in (p, offsets[p])))[F.col("part")]
    at = F.row_number().over(Window.partitionBy("part").orderBy("key")) + before - 1
    cut = ordered.select("key", (at * shards / F.lit(total)).cast("bigint").alias("q"), F.when(at > 0, ((at - 1) * shards / F.lit(total)).cast("bigint")).otherwise(0).alias("p"))
    return sorted({bytes(r["key"]) for r in cut.filter("q > p").select("key").collect()})


def _range_rows(packed: bytes, key_at: int, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, parts = pickle.loads(packed)
        count = np.ones(len(cuts) + 1, np.int64)
        count[list(parts)] = list(parts.values())
        first = np.cumsum(count) - count
        for batch in batches:
            at = np.array([bisect_right(cuts, k) for k in batch.column(key_at).to_pylist()], np.int64)
            added = [pa.array(at), pa.array(count[at]), pa.array(first[at])][: len(names)]
            columns = [c for k, c in enumerate(batch.columns) if k != key_at]
            yield pa.RecordBatch.from_arrays([*columns, *added], [*(n for k, n in enumerate(batch.schema.names) if k != key_at), *names])

    return rows


def shard(docs: DataFrame, keys: tuple[str, ...] = ("source", "doc_id"), target: int = TARGET_BYTES, oversample: int = OVERSAMPLE, slack: float = SLACK) -> DataFrame:
    """``docs`` with ``shard`` (from 0, in key order) and ``shard_part``, moved so that a shard's records lie together.

    Ranges hold whole keys, nulls first. A range over ``slack * target`` bytes is subdivided into parts of about
    ``target`` by a hash of id and text; ``shard_part`` is 0 in others. Repeated rows stay in one part; a record larger
    than the target makes its part as large as itself. Sizes are bytes of text (a null text has none) and
    ``RECORD_BYTES`` for each record. Keys may be whole numbers, floats (NaN last), decimals, booleans, dates, timestamps,
    strings and bytes; others are a TypeError. A very long text moves whole. If a column is called ``shard`` or ``shard_part``, the new ones get a ``_`` more. An
    empty table gives an empty result.
    """
    names = fresh(docs.columns, "shard", "shard_part")
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + RECORD_BYTES
    chance = F.xxhash64(F.lit(11), *keys, "doc_id", F.col("text"))
    key = _keyed(docs, list(keys))
    total = docs.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    shards = max(1, -(-total // target))
    step = max(1.0, total / (shards * oversample))
    # one sample for each whole step of a record's size, and one more with the chance of the rest
    unit = F.pmod(chance, F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor(size / F.lit(step)) + (unit < (size / F.lit(step)) % 1).cast("int")).cast("int")
    sample = docs.select(key.alias("key"), times.alias("times")).filter("times > 0").select("key", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("one"))
    cuts = splitters(sample, shards, oversample)
    lean = docs.select(key.alias("key"), size.cast("bigint").alias("size"))
    lean = lean.mapInArrow(_range_rows(pickle.dumps((cuts, {})), 0, ["range", "part"]), "size bigint, range bigint, part bigint")
    measured = [(r["range"], r["bytes"]) for r in lean.groupBy("range").agg(F.sum("size").alias("bytes")).collect()]
    parts = {k: -(-b // target) for k, b in measured if b > slack * target}
    carried, first = fresh([*docs.columns, *names], "_key", "_first")
    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in (*names, first))])
    placed = docs.withColumn(carried, key).mapInArrow(_range_rows(pickle.dumps((cuts, parts)), len(docs.columns), [*names, first]), schema)
    ident = F.xxhash64(F.lit(12), "doc_id", F.col("text"))
    tasks = len(cuts) + 1 - len(parts) + sum(parts.values())
    placed = placed.withColumn(names[1], F.pmod(ident, F.col(names[1])))
    placed = placed.withColumn(first, (F.col(first) + F.col(names[1])).cast("int"))
    return placed.repartitionById(tasks, F.col(first)).drop(first)
