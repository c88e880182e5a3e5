"""Bounded walks over the graph: nodes and edges at their least depth.

A walk passes through edges of every type; ``rel_types`` selects afterwards, by the last hop. That is the defined
behaviour; ``typed_frontier=True`` follows edges of those types alone.

Only least depths are asked for, so each node is expanded once, at the depth where it is first reached: an edge f -> t first
appears one below f. A level reads the edges of its frontier and no others: a small frontier goes into the scan as IN, where
the layout by source (or by target, see ``Graph.incoming``) lets it skip the rest; a larger one is joined, broadcast only if its
written size is small. What a level finds is written to the shared folder. ``engine="cte"`` runs one recursive query instead
(for small depths).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.plans.schema import SYMBOL_COLUMNS
from loomgraph.storage import sized, written

TRACE_TYPES = ("CALLS", "IMPORTS")
BLAST_TYPES = ("CALLS", "IMPORTS", "REFERENCES")
_ROWS = "from_id string, symbol_id string, depth int, rel_type string"


#: A frontier of up to so many nodes is kept on the driver and pushed into the scan.
PUSHED = 256


def oriented(graph: Graph, direction: str, types=None) -> list[DataFrame]:
    """``src, dst, type`` of the edges in the direction of the walk; ``both`` has each edge either way round, any other word means out."""

    def known(edges: DataFrame, src: str, dst: str) -> DataFrame:
        edges = edges.filter("target_id <> '' AND source_id <> ''")
        edges = edges.filter(F.col("type").isin(*types)) if types else edges
        return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "type")

    out = known(graph.relationships, "source_id", "target_id")
    if direction not in ("in", "both"):
        return [out]
    laid = graph.incoming() if callable(graph.incoming) else graph.incoming
    back = known(graph.relationships if laid is None else laid, "target_id", "source_id")
    return [back] if direction == "in" else [out, back]


def walk_rows(graph: Graph, start: str, direction: str = "out", depth: int = 3, rel_types=None, typed_frontier: bool = False, engine: str = "loop") -> DataFrame:
    """``from_id, symbol_id, depth, rel_type`` of every hop at its least depth, all types; rows of the last level may repeat."""
    spark = graph.spark
    sides = oriented(graph, direction, rel_types if typed_frontier else None)
    if depth <= 0:
        return spark.createDataFrame([], _ROWS)
    if engine == "cte":
        return _recursive(spark, reduce(DataFrame.unionByName, sides), start, depth)
    few: list[str] | None = [start]  # the frontier, while it is small
    past: set[str] | None = {start}  # all nodes so far, while there are few
    frontier, size, seen, levels = None, 0, None, []
    for d in range(1, depth + 1):
        asked = [e.filter(F.col("src").isin(few)) if few is not None else e.join(sized(frontier, size), "src") for e in sides]
        hop = reduce(DataFrame.unionByName, asked).select(F.col("src").alias("from_id"), F.col("dst").alias("symbol_id"), F.lit(d).alias("depth"), F.col("type").alias("rel_type"))
        if d == depth:  # the last level has no frontier after it, so it stays lazy
            levels.append(hop)
            break
        hop, _ = written(hop.distinct(), "hop")
        levels.append(hop)
        reached = hop.select(F.col("symbol_id").alias("src")).distinct()
        if past is not None:
            got = [r.src for r in reached.limit(PUSHED + len(past) + 1).collect()]
            if len(got) <= PUSHED + len(past):
                few = [x for x in got if x not in past]
                past |= set(few)
                if not few:
                    break
                if len(past) <= 4 * PUSHED:
                    continue
                seen, past = spark.createDataFrame([(x,) for x in past], "node string"), None
                continue
            seen, past = spark.createDataFrame([(x,) for x in past], "node string"), None
        frontier, size = written(reached.join(seen, F.col("src") == F.col("node"), "left_anti"), "frontier")
        got = [r.src for r in frontier.limit(PUSHED + 1).collect()]
        if not got:
            break
        few = got if len(got) <= PUSHED else None
        seen = seen.unionByName(frontier.select(F.col("src").alias("node")))
    return reduce(DataFrame.unionByName, levels)


def _recursive(spark, edges: DataFrame, start: str, depth: int) -> DataFrame:
    """The recursion goes over nodes alone, once each a level, since edges to hot nodes would make it join these again and again;
    the hops are then the edges out of what is reached. Its limit of rows, meant for endless ones, is lifted: depth ends it."""
    if depth > 90:
        raise ValueError("the recursive query is for depths up to 90; use the loop")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        walk = spark.sql(
            """
            WITH RECURSIVE walk(node, depth) AS (
                SELECT :start, 0
                UNION ALL
                SELECT DISTINCT e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.src = w.node WHERE w.depth < :depth - 1)
            SELECT node, min(depth) AS depth FROM walk GROUP BY node
            """,
            args={"start": start, "depth": depth},
            edges=edges.select("src", "dst"),
        )
        reached, size = written(walk, "recursion")  # while the limit is lifted
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
    hops = edges.join(sized(reached, size), F.col("src") == F.col("node"))
    return hops.select(F.col("src").alias("from_id"), F.col("dst").alias("symbol_id"), (F.col("depth") + 1).alias("depth"), F.col("type").alias("rel_type"))


def _selected(rows: DataFrame, rel_types) -> DataFrame:
    return rows.filter(F.col("rel_type").isin(*rel_types)) if rel_types else rows


def _nodes(graph: Graph, rows: DataFrame, start: str) -> DataFrame:
    first = rows.filter(F.col("symbol_id") != start).groupBy("symbol_id").agg(F.min(F.struct("depth", "rel_type", "from_id")).alias("first"))
    joined = first.join(graph.symbols, F.col("symbol_id") == F.col("id"))
    return joined.select(*SYMBOL_COLUMNS, F.col("first.depth").alias("depth"), F.col("first.rel_type").alias("via"))


def walk(graph: Graph, start: str, rel_types=None, direction: str = "out", depth: int = 3, **how) -> DataFrame:
    """Symbols reached, without the start: their columns, least ``depth``, and ``via``, the type of that hop."""
    return _nodes(graph, _selected(walk_rows(graph, start, direction, depth, rel_types, **how), rel_types), start)


def walk_edges(graph: Graph, start: str, rel_types=None, direction: str = "out", depth: int = 3, **how) -> DataFrame:
    """``source_id, target_id, type, depth`` of the edges walked, in their true direction (in that of the walk for ``both``)."""
    return _edges(graph, _selected(walk_rows(graph, start, direction, depth, rel_types, **how), rel_types), direction)


def _edges(graph: Graph, rows: DataFrame, direction: str) -> DataFrame:
    source, target = ("symbol_id", "from_id") if direction == "in" else ("from_id", "symbol_id")
    edges = rows.groupBy(F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.col("rel_type").alias("type")).agg(F.min("depth").alias("depth"))
    ids = graph.symbols.select(F.col("id").alias("known"))
    edges = edges.join(ids, F.col("source_id") == F.col("known"), "left_semi")
    return edges.join(ids, F.col("target_id") == F.col("known"), "left_semi").select("source_id", "target_id", "type", "depth")


@dataclass(frozen=True)
class TraceResult:
    """The root's row, and the nodes and edges of a walk as DataFrames."""

    root: dict
    nodes: DataFrame
    edges: DataFrame
    direction: str


def walk_graph(graph: Graph, start: str, rel_types=None, direction: str = "out", depth: int = 3, **how) -> TraceResult | None:
    """Nodes and edges of one walk; None if there is no such symbol."""
    root = graph.symbols.filter(F.col("id") == start).first()
    if root is None:
        return None
    rows, _ = written(_selected(walk_rows(graph, start, direction, depth, rel_types, **how), rel_types), "walk")
    return TraceResult(root.asDict(), _nodes(graph, rows, start), _edges(graph, rows, direction), direction)


def trace(graph: Graph, start: str, depth: int = 5, rel_types=None, **how) -> DataFrame:
    return walk(graph, start, rel_types or TRACE_TYPES, "out", depth, **how)


def trace_graph(graph: Graph, start: str, depth: int = 5, rel_types=None, **how) -> TraceResult | None:
    return walk_graph(graph, start, rel_types or TRACE_TYPES, "out", depth, **how)


def blast_radius(graph: Graph, start: str, depth: int = 3, rel_types=None, **how) -> DataFrame:
    return walk(graph, start, rel_types or BLAST_TYPES, "in", depth, **how)


def blast_radius_graph(graph: Graph, start: str, depth: int = 3, rel_types=None, **how) -> TraceResult | None:
    return walk_graph(graph, start, rel_types or BLAST_TYPES, "in", depth, **how)
