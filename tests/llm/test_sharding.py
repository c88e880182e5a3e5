from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import sharding as H


def order(v):
    return tuple((x is not None, x if x is not None else 0) for x in v)


def check(docs, keys=("source", "doc_id"), target=4000, **how):
    got = H.shard(docs, keys, target=target, **how)
    rows = got.withColumn("_p", F.spark_partition_id()).collect()
    assert len(rows) == docs.count()
    ranges, sizes, places = defaultdict(list), defaultdict(int), defaultdict(set)
    shard, part = got.columns[-2:]
    for r in rows:
        ranges[r[shard]].append(order(tuple(r[k] for k in keys)))
        sizes[r[shard], r[part]] += len((r.text or "").encode()) + H.RECORD_BYTES
        places[r["_p"]].add((r[shard], r[part]))
    last = None
    for k in sorted(ranges):  # ranges don't overlap, and whole keys lie in one
        assert last is None or last < min(ranges[k])
        last = max(ranges[k])
    assert all(len(p) == 1 for p in places.values()), "a task has one shard"
    return sizes


def test_even_shards_with_a_hot_key(make, spark, rng):
    rows = [(i, "x" * rng.randrange(10, 400), "en", "hot" if i % 2 else f"s{i % 7}", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, make([]).schema)
    sizes = check(docs, target=40_000)
    assert max(sizes.values()) <= 2 * 40_000
    by_source = check(docs, keys=("source",), target=40_000)
    assert max(by_source.values()) <= 2 * 40_000, "the hot key is subdivided"


def test_keys_of_all_kinds_sort(spark):
    rows = [(i, "t" * 50, t, s, 0) for i, (t, s) in enumerate([(None, "a"), ("", "b"), ("a\0b", "c"), ("a", "d"), ("é", "e"), ("ab", None)] * 30)]
    docs = spark.createDataFrame([(-i if i % 3 else i, *r) for i, *r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    check(docs, keys=("doc_id",), target=1500)
    check(docs, keys=("lang", "source", "doc_id"), target=1500)


def test_numbers_of_all_kinds_against_sorted_rows(spark, rng):
    """Shards in order hold the rows as a sort of all rows has them, cut at whole keys."""
    import datetime
    from decimal import Decimal

    doubles = [-1.0, -3.0, 0.5, 1e10, 10.0, 100.0, 2.0, -0.0, 0.0, 1e-300, -1e300, float("inf"), float("-inf"), 5e-324, 0.1 + 0.2, 0.3, None]
    rows = []
    for i in range(600):
        d = rng.choice([*doubles, rng.uniform(-1e6, 1e6), rng.gauss(0, 1) * 10 ** rng.randrange(-20, 20)])
        m = rng.choice([None, Decimal(rng.randrange(-(10**9), 10**9)).scaleb(-4), Decimal("0.0001"), Decimal("-0.0001")])
        rows.append((i, "t" * 40, d, m, datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(90_000)), rng.random() < 0.5, bytes([rng.randrange(256), 0, 7]), None if d is None else float(i % 7 - 3)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, a double, m decimal(20,4), day date, flag boolean, raw binary, f float")
    for key in ("a", "m", "day", "flag", "raw", "f"):
        got = H.shard(docs, (key,), target=6000, slack=100.0).collect()
        flat = [[r[key] for r in got if r.shard == k] for k in sorted({r.shard for r in got})]
        own = lambda v: (v is not None, bytes(v) if key == "raw" and v is not None else v if v is not None else 0)
        want = sorted((r[key] for r in docs.collect()), key=own)
        assert [own(v) for part in flat for v in sorted(part, key=own)] == [own(v) for v in want], key
        assert len(flat) > 1, key
        assert all(own(max(x, key=own)) < own(min(y, key=own)) for x, y in zip(flat, flat[1:])), key
    wide = spark.createDataFrame([(i, "t" * 50, Decimal(v)) for i, v in enumerate(["-9" + "9" * 30, "0.0000001", "-0.0000001", "9" * 31, "0", "12", "2"] * 20)], "doc_id bigint, text string, m decimal(38,7)")
    got = H.shard(wide, ("m",), target=1200, slack=100.0).groupBy("shard").agg(F.min("m"), F.max("m")).orderBy("shard").collect()
    assert len(got) > 2 and all(x[2] < y[1] for x, y in zip(got, got[1:]))
    nan = spark.createDataFrame([(i, "t" * 40, float("nan") if i % 2 else float("inf")) for i in range(200)], "doc_id bigint, text string, a double")
    got = H.shard(nan, ("a",), target=3000, slack=100.0)
    assert [r[1] for r in got.groupBy("shard").agg(F.min(F.isnan("a"))).orderBy("shard").collect()] == [False, True]
    with pytest.raises(TypeError):
        H.shard(docs.withColumn("list", F.array("a")), ("list",))


def test_odd(odd, clash, none):
    check(odd)
    got = H.shard(clash, target=4000)
    assert got.columns[: len(clash.columns)] == clash.columns and got.columns[-2:] == ["shard_", "shard_part_"] and got.count() == clash.count()
    assert H.shard(none).count() == 0
    assert {r.shard for r in H.shard(odd).select("shard").collect()} == {0}
