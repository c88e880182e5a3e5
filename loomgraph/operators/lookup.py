"""Point and name lookups, and one-hop joins of edges with their other ends.

Functions take one id, or a DataFrame with a column ``id``: then everything is answered for all of them in one join, and
the result has the asked id in ``for_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.plans.schema import SYMBOL_COLUMNS


def all_files(graph: Graph) -> DataFrame:
    return graph.files.orderBy("path", "id")


def all_symbols(graph: Graph) -> DataFrame:
    return graph.symbols.orderBy("qualified_name", "id")


def all_symbol_names(graph: Graph) -> DataFrame:
    return graph.symbols.select("id", "name", "qualified_name")


def unresolved_relationships(graph: Graph) -> DataFrame:
    return graph.relationships.filter((F.col("target_id") == "") | (F.col("resolution") == "unresolved"))


def get_file(graph: Graph, file_id: str) -> DataFrame:
    return graph.files.filter(F.col("id") == file_id)


def get_symbol(graph: Graph, symbol_id: str) -> DataFrame:
    return graph.symbols.filter(F.col("id") == symbol_id)


get_symbol_by_id = get_definition = get_symbol


def contains_pattern(column: Column | str, text: str) -> Column:
    """LIKE '%text%' without regard to ASCII case: % and _ in the text are wildcards, a backslash is itself."""
    column = F.col(column) if isinstance(column, str) else column
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


def find_by_name(graph: Graph, name: str, exact: bool = False) -> DataFrame:
    hit = F.col("name") == name if exact else contains_pattern("name", name)
    return graph.symbols.filter(hit).orderBy("qualified_name", "id")


def find_by_qualified_name(graph: Graph, name: str) -> DataFrame:
    return graph.symbols.filter((F.col("qualified_name") == name) | contains_pattern("qualified_name", name))


def _asked(edges: DataFrame, column: str, ids: str | DataFrame) -> DataFrame:
    if isinstance(ids, str):
        return edges.filter(F.col(column) == ids).withColumn("for_id", F.col(column))
    return edges.join(ids.select(F.col("id").alias("for_id")).distinct(), F.col(column) == F.col("for_id"))


def relationships_from(graph: Graph, ids: str | DataFrame, kind: str | None = None) -> DataFrame:
    """Edges out of the symbols, unresolved ones too."""
    edges = graph.relationships if kind is None else graph.relationships.filter(F.col("type") == kind)
    return _asked(edges, "source_id", ids)


def relationships_to(graph: Graph, ids: str | DataFrame, kind: str | None = None) -> DataFrame:
    edges = graph.relationships if kind is None else graph.relationships.filter(F.col("type") == kind)
    return _asked(edges, "target_id", ids)


def _joined(graph: Graph, edges: DataFrame, end: str) -> DataFrame:
    """Symbols at one end of edges, one row for each edge, with the edge's columns as ``rel_*``; ends that don't exist drop out."""
    rel = edges.select(
        "for_id", F.col(end).alias("_end"), F.col("id").alias("rel_id"), F.col("type").alias("rel_type"), F.col("resolution").alias("rel_resolution"),
        F.col("source_location.line").alias("rel_line"), F.col("metadata").alias("rel_metadata"),
    )
    return rel.join(graph.symbols, F.col("_end") == F.col("id")).select("for_id", *SYMBOL_COLUMNS, "rel_id", "rel_type", "rel_resolution", "rel_line", "rel_metadata")


def callers(graph: Graph, ids: str | DataFrame) -> DataFrame:
    return _joined(graph, relationships_to(graph, ids, "CALLS"), "source_id")


def callees(graph: Graph, ids: str | DataFrame) -> DataFrame:
    return _joined(graph, relationships_from(graph, ids, "CALLS").filter("target_id <> ''"), "target_id")


def references(graph: Graph, ids: str | DataFrame) -> DataFrame:
    return _joined(graph, relationships_to(graph, ids, "REFERENCES"), "source_id")


def implementations(graph: Graph, ids: str | DataFrame) -> DataFrame:
    """Sources of IMPLEMENTS and of EXTENDS edges, the former first; one that has both comes twice."""
    edges = _asked(graph.relationships.filter(F.col("type").isin("IMPLEMENTS", "EXTENDS")), "target_id", ids)
    return _joined(graph, edges, "source_id").orderBy("for_id", F.desc("rel_type"), "qualified_name", "id", "rel_id")


def importers(graph: Graph, ids: str | DataFrame) -> DataFrame:
    return _joined(graph, relationships_to(graph, ids, "IMPORTS"), "source_id")


def imports(graph: Graph, ids: str | DataFrame) -> DataFrame:
    """IMPORTS edges as they are, with ``target``: the name asked for, else the target's id, else '?'."""
    shown = F.coalesce(F.col("metadata")["target_name"], F.when(F.col("target_id") != "", F.col("target_id")), F.lit("?"))
    return relationships_from(graph, ids, "IMPORTS").withColumn("target", shown)


def children(graph: Graph, ids: str | DataFrame) -> DataFrame:
    return _joined(graph, relationships_from(graph, ids, "CONTAINS").filter("target_id <> ''"), "target_id")


def parents(graph: Graph, ids: str | DataFrame) -> DataFrame:
    return _joined(graph, relationships_to(graph, ids, "CONTAINS"), "source_id")


def with_files(graph: Graph, symbols: DataFrame) -> DataFrame:
    """Adds ``file_path`` and ``file_name``, '?' where the file is missing."""
    files = graph.files.select(F.col("id").alias("_file"), F.col("path").alias("_path"))
    joined = symbols.join(files, F.col("file_id") == F.col("_file"), "left")
    path = F.coalesce("_path", F.lit("?"))
    return joined.withColumn("file_path", path).withColumn("file_name", F.element_at(F.split(path, "/"), -1)).drop("_file", "_path")
