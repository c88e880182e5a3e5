"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

In a shard, vectors are inserted in batches: a greedy beam search over the graph so far proposes neighbours, of which
relaxed distance pruning keeps those that no kept one lies much closer to; edges back are added and pruned alike. A query
runs a beam search in every shard and the shards' findings are merged. Every row is indexed; which rows are queries, the
caller says.

Equal vectors are one vertex with a list of ids: the lowest ones, as many as any answer can need, chosen before anything is
shuffled, so that a vector that a third of all rows have is no burden. Graphs and queries are written to the shared folder. A
search task takes blocks of queries and some of the shards, keeps the best of what it finds as it goes, and the number of
tasks is bounded; nothing but lists of pairs and the findings is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table_path

#: Rows of a shard, and of a block of queries.
SHARD_ROWS, BLOCK_ROWS = 16384, 4096
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 32, 64, 128, 1.2
#: Vertices that every search begins from, vertices expanded at once, and queries searched at once.
ENTRIES, EXPAND, AT_ONCE = 32, 4, 256
K = 10
#: Search tasks for each core, at most.
TASKS_A_CORE = 8
#: From this size on squares may overflow 32 bits; a shard with such elements is built and searched in 64.
LARGE = 1e15


def distances(a: np.ndarray, norms: np.ndarray, rows: np.ndarray, q: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Squared distance of vectors ``rows`` of ``a`` to queries ``of``, without the queries' own norm."""
    return norms[rows] - 2 * np.einsum("ij,ij->i", a[rows], q[of])


def beam_search(a: np.ndarray, norms: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (-1 for none) and shifted squared distances of each query's beam, nearest first.

    ``graph`` has one row more than there are vertices, all -1.
    """
    n, count = len(a), len(q)
    beam = min(beam, n)
    ids = np.full((count, beam), -1, np.int64)
    dist = np.full((count, beam), np.inf, a.dtype)
    done = np.zeros((count, beam), bool)
    seen = np.zeros((count, n), bool)
    rows, new = np.repeat(np.arange(count), len(entries)), np.tile(entries, count)
    while len(rows):
        seen[rows, new] = True
        d = distances(a, norms, new, q, rows)
        begin = np.searchsorted(rows, np.arange(count + 1))
        width = int(np.diff(begin).max())
        at = np.arange(len(rows)) - begin[rows]
        more_ids, more = np.full((count, width), -1, np.int64), np.full((count, width), np.inf, a.dtype)
        more_ids[rows, at], more[rows, at] = new, d
        ids, dist = np.concatenate((ids, more_ids), axis=1), np.concatenate((dist, more), axis=1)
        done = np.concatenate((done, np.zeros((count, width), bool)), axis=1)
        best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        ids, dist, done = (np.take_along_axis(x, best, 1) for x in (ids, dist, done))
        open_ = np.where(done | (ids < 0), np.inf, dist)
        step = min(EXPAND, beam)
        pick = np.argpartition(open_, step - 1, axis=1)[:, :step]
        live = np.isfinite(np.take_along_axis(open_, pick, 1))
        np.put_along_axis(done, pick, True, 1)
        near = graph[np.where(live, np.take_along_axis(ids, pick, 1), n)].reshape(count, -1)
        near = np.sort(near, axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        rows, at = np.nonzero(fresh)
        new = near[rows, at]
        unseen = ~seen[rows, new]
        rows, new = rows[unseen], new[unseen]
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def prune(a: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each of ``points`` up to ``degree`` of its candidates (-1 for none): the nearest first, and each drops those that lie ``relax`` times closer to it."""
    valid = (candidates >= 0) & (candidates != points[:, None])
    own = a[points][:, None, :]
    c = a[np.where(valid, candidates, 0)]
    d = np.where(valid, ((c - own) ** 2).sum(axis=2), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d, valid = (np.take_along_axis(x, order, 1) for x in (candidates, d, valid))
    valid[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    c = np.take_along_axis(c, order[:, :, None], 1)
    norm = (c * c).sum(axis=2)
    pair = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * (c @ c.transpose(0, 2, 1)), 0)
    out = np.full((len(points), degree), -1, np.int64)
    alive, each = valid.copy(), np.arange(len(points))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, k] = candidates[each, first][some]
        alive &= relax * relax * pair[each, first] > d
        alive[each, first] = False
    return out


def build(a: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray]:
    """The graph over the rows of ``a`` (with a last row of -1) and its entries; equal rows must have been merged."""
    n = len(a)
    rng = np.random.default_rng(3)
    order = rng.permutation(n)
    graph = np.full((n + 1, degree), -1, np.int64)
    filled = np.zeros(n, np.int64)
    norms = (a * a).sum(axis=1)
    centre = int(((a - a.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    order = np.concatenate(([centre], order[order != centre])).astype(np.int64)[:n]
    entries, at = order[:ENTRIES], 0
    while at < n:
        batch = order[at : at + max(ENTRIES, min(AT_ONCE, at // 4))]
        if at:
            found, _ = beam_search(a, norms, graph, entries, a[batch], beam)
        else:
            found = np.tile(batch, (len(batch), 1))
        kept = prune(a, batch, found, degree, relax)
        graph[batch] = kept
        filled[batch] = (kept >= 0).sum(axis=1)
        row, col = np.nonzero(kept >= 0)
        src, dst = batch[row], kept[row, col]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        targets, begin, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(begin, count)
        room = np.repeat(filled[targets] + count <= degree, count)
        graph[dst[room], filled[dst[room]] + place[room]] = src[room]
        fits = filled[targets] + count <= degree
        filled[targets[fits]] += count[fits]
        full = np.flatnonzero(~fits)
        full = full[np.argsort(count[full], kind="stable")]
        i = 0
        while i < len(full):
            j = i + 1
            while j < len(full) and (j + 1 - i) * (degree + count[full[j]]) ** 2 <= 2_000_000:
                j += 1
            part, width = full[i:j], int(count[full[j - 1]])
            extra = np.full((len(part), width), -1, np.int64)
            r = np.repeat(np.arange(len(part)), count[part])
            c = np.arange(len(r)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            extra[r, c] = src[np.repeat(begin[part], count[part]) + c]
            new = prune(a, targets[part], np.concatenate((graph[targets[part]], extra), axis=1), degree, relax)
            graph[targets[part]] = new
            filled[targets[part]] = (new >= 0).sum(axis=1)
            i = j
        at += len(batch)
    return graph, entries


def _matrix(lists: pa.ChunkedArray | pa.Array, dtype=np.float32) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = len(lists)
    return np.ascontiguousarray(lists.flatten().to_numpy().astype(dtype).reshape(n, -1)) if n else np.zeros((0, 0), dtype)


def _roomy(vectors: np.ndarray) -> np.ndarray:
    return vectors.astype(np.float64) if vectors.size and np.abs(vectors).max() > LARGE else vectors


def _vertices(table: pa.Table) -> tuple[np.ndarray, list[list]]:
    """The distinct vectors and the ids of each, ascending."""
    vectors, at = np.unique(_matrix(table.column("v")), axis=0, return_inverse=True)
    ids: list[set] = [set() for _ in range(len(vectors))]
    for k, x in zip(at.ravel().tolist(), table.column("id").to_pylist()):
        if x is not None:
            ids[k].add(x)
    return vectors, [sorted(s) for s in ids]


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))


def _build_rows(id_type: pa.DataType):
    def rows(key: tuple, table: pa.Table) -> pa.Table:
        vectors, ids = _vertices(table)
        graph, entries = build(_roomy(vectors))
        first = np.zeros(len(vectors), bool)
        first[entries] = True
        n = len(vectors)
        return pa.table(
            {
                "dim": pa.array([key[0].as_py()] * n, pa.int32()),
                "shard": pa.array([key[1].as_py()] * n, pa.int32()),
                "vertex": pa.array(np.arange(n)),
                "ids": pa.array(ids, pa.list_(id_type)),
                "v": _lists(vectors),
                "near": _lists(graph[:-1].astype(np.int32)),
                "entry": pa.array(first),
            }
        )

    return rows


def _folder(path: str, dim: int, kind: str, number: int, columns: list[str]) -> pa.Table:
    fs, inner = pafs.FileSystem.from_uri(path)
    return pq.read_table(f"{inner}/dim={dim}/{kind}={number}", filesystem=fs, partitioning=None, columns=columns)


@lru_cache(2)
def _graph(path: str, dim: int, shard: int) -> tuple[np.ndarray, list[list], np.ndarray, np.ndarray]:
    table = _folder(path, dim, "shard", shard, ["vertex", "ids", "v", "near", "entry"]).sort_by("vertex")
    vectors = _matrix(table.column("v"))
    near = _matrix(table.column("near"), np.int64)
    graph = np.concatenate((near, np.full((1, near.shape[1]), -1, np.int64)))
    return vectors, table.column("ids").to_pylist(), graph, np.flatnonzero(table.column("entry").to_numpy())


@lru_cache(2)
def _queries(path: str, dim: int, block: int) -> tuple[np.ndarray, pa.Array, list]:
    table = _folder(path, dim, "block", block, ["number", "id", "v"]).sort_by("number")
    return _matrix(table.column("v")), table.column("number"), table.column("id").to_pylist()


def search(vectors: np.ndarray, ids: list[list], graph: np.ndarray, entries: np.ndarray, q: np.ndarray, own: list, k: int, beam: int) -> list[list[tuple]]:
    """The ``k`` nearest ids of each query but its own, as (distance, id), nearest first, the lower id of equals."""
    a = _roomy(vectors)
    norms = (a * a).sum(axis=1)
    out = []
    for i in range(0, len(q), AT_ONCE):
        some = q[i : i + AT_ONCE]
        found, _ = beam_search(a, norms, graph, entries, some.astype(a.dtype), max(beam, k + 1))
        exact = np.sqrt(((vectors[np.maximum(found, 0)].astype(np.float64) - some[:, None, :].astype(np.float64)) ** 2).sum(axis=2))
        exact[found < 0] = np.inf
        for r in range(len(some)):
            best: list[tuple] = []
            for c in np.lexsort((found[r], exact[r])).tolist():
                if found[r, c] < 0 or len(best) >= k and exact[r, c] > best[k - 1][0]:
                    break
                best += [(float(exact[r, c]), x) for x in ids[found[r, c]] if x != own[i + r]]
            out.append(sorted(best)[:k])
    return out


def _search_rows(graphs: str, asked: str, k: int, beam: int, id_type: pa.DataType):
    pair = pa.list_(pa.struct([("d", pa.float64()), ("id", id_type)]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, shards in zip(*(c.to_pylist() for c in batch.columns)):
                q, numbers, own = _queries(asked, dim, block)
                best: list[list[tuple]] = [[] for _ in own]
                for shard in shards:
                    for r, found in enumerate(search(*_graph(graphs, dim, shard), q, own, k, beam)):
                        best[r] = sorted(best[r] + found)[:k]
                m = len(own)
                out = [[{"d": d, "id": x} for d, x in b] for b in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * m, pa.int32()), pa.array([block] * m, pa.int32()), numbers.combine_chunks(), pa.array(own, id_type), pa.array(out, pair)],
                    ["dim", "block", "number", "own", "found"],
                )

    return rows


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS, queries: Column | str | None = None
) -> DataFrame:
    """For each query its ``k`` nearest others among all rows of ``vectors``: ``<id_col>, rank`` (from 1), ``neighbor_id, distance``.

    ``queries`` is a condition on the rows that says which of them are queries (null counts as no); without it all are.
    Distances are Euclidean; ties go to the lower id, and rows with equal vectors are each other's neighbours at distance
    0. Vectors meet only those of their length. A vector that is null or empty, or has a null, NaN or infinite element, has
    no neighbours and is none's; any finite one counts, however large. Rows equal in id and vector count as one; of one id
    with several vectors each is a query, and none finds its own id. A row with a null id is a query but is never found. An
    empty table gives an empty result; further columns are ignored, and texts play no part. The search is approximate:
    recall against brute force is tested to be at least 0.9. Work grows with queries times shards: of several billion rows,
    take larger shards.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    id_type = pa.string() if kind == "string" else {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.int64())
    asks = F.lit(True) if queries is None else F.coalesce(F.expr(queries) if isinstance(queries, str) else queries, F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"), asks.alias("asks"))
    infinite = F.lit(float("inf"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    rows = rows.filter(sound).select("id", F.transform("v", lambda x: x + F.lit(0.0).cast("float")).alias("v"), "asks").withColumn("dim", F.size("v"))
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}
    out_schema = f"`{id_col}` {kind}, rank int, neighbor_id {kind}, distance double"
    if not any(q for _, q in sizes.values()):
        return spark.createDataFrame([], out_schema)

    def counted(column: str, of: int, most: int) -> Column:
        each = F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, max(1, -(-n[of] // most)))))
        return F.pmod(F.xxhash64("v") if column == "shard" else F.xxhash64("id", "v"), F.element_at(each, F.col("dim"))).cast("int").alias(column)

    # of equal vectors the lowest k + 1 ids are enough, since a query may have to leave out its own
    lowest = F.row_number().over(Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last()))
    kept = rows.select("id", "v", "dim").distinct().withColumn("n", lowest).filter(F.col("n") <= k + 1).select("dim", counted("shard", 0, shard_rows), "id", "v")
    schema = f"dim int, shard int, vertex bigint, ids array<{kind}>, v array<float>, near array<int>, entry boolean"
    graphs, asked = table_path(spark, "graphs"), table_path(spark, "queries")
    kept.groupBy("dim", "shard").applyInArrow(_build_rows(id_type), schema).write.partitionBy("dim", "shard").parquet(graphs)
    wanted = rows.filter("asks").select("id", "v", "dim").distinct().select("dim", counted("block", 1, BLOCK_ROWS), F.monotonically_increasing_id().alias("number"), "id", "v")
    wanted.repartition("dim", "block").write.partitionBy("dim", "block").parquet(asked)
    blocks = spark.read.parquet(asked).select(F.col("dim").cast("int"), F.col("block").cast("int")).distinct()
    shards = spark.read.schema(schema).parquet(graphs).select("dim", "shard").distinct()
    count_b, count_s = blocks.count(), shards.count()
    tasks = max(1, TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    together = max(1, -(-count_b * count_s // tasks))  # shards that a task takes one after the other
    lots = shards.groupBy("dim", F.floor(F.col("shard") / together).alias("lot")).agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    pairs = blocks.join(lots, "dim").select("dim", "block", "shards")
    spread = pairs.repartitionByRange(min(tasks, count_b * count_s), "dim", F.col("shards")[0], "block")
    shape = f"dim int, block int, number bigint, own {kind}, found array<struct<d:double,id:{kind}>>"
    found = spread.mapInArrow(_search_rows(graphs, asked, k, beam, id_type), shape)
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k)
    best = found.groupBy("dim", "block", "number").agg(F.first("own").alias("own"), merged.alias("found"))
    flat = best.select("own", F.posexplode("found").alias("at", "x"))
    return flat.select(F.col("own").alias(id_col), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.d").alias("distance"))
