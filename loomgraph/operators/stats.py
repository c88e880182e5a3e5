"""Counts over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph

TOTALS = ("files", "symbols", "relationships", "unresolved_relationships")


def kind_counts(graph: Graph) -> DataFrame:
    return graph.symbols.groupBy("kind").agg(F.count("*").alias("n"))


def type_counts(graph: Graph) -> DataFrame:
    return graph.relationships.groupBy("type").agg(F.count("*").alias("n"))


def _totals(df: DataFrame, column: str, whole: str, prefix: str, extra: str | None = None) -> DataFrame:
    """``metric, n`` of a table in one pass: all rows, rows for each value, and ``extra``, the rows without a target."""
    grouped = df.rollup(column).agg(F.grouping_id().alias("all"), F.count("*").alias("n"), F.count_if(F.col("target_id") == "").alias("lost") if extra else F.lit(0).alias("lost"))
    pair = lambda metric, n: F.struct(metric.alias("metric"), n.alias("n"))
    total = [pair(F.lit(whole), F.col("n")), *([pair(F.lit(extra), F.col("lost"))] if extra else [])]
    each = F.array(pair(F.concat(F.lit(prefix), F.lower(column)), F.col("n")))
    return grouped.select(F.inline(F.when(F.col("all") == 1, F.array(*total)).otherwise(each)))


def stats(graph: Graph) -> DataFrame:
    """``metric, n``: the totals (0 for an empty table), then ``symbols_<kind>`` and ``rel_<type>``; unresolved are those without a target."""
    none = graph.spark.createDataFrame([(m, 0) for m in TOTALS], "metric string, n bigint")
    files = graph.files.agg(F.count("*").alias("n")).select(F.lit("files").alias("metric"), "n")
    found = files.unionByName(_totals(graph.symbols, "kind", "symbols", "symbols_"))
    found = found.unionByName(_totals(graph.relationships, "type", "relationships", "rel_", "unresolved_relationships"))
    return none.unionByName(found).groupBy("metric").agg(F.sum("n").alias("n"))


def stats_dict(graph: Graph) -> dict[str, int]:
    """The same on the driver, in order: totals, kinds, types."""
    got = {r.metric: r.n for r in stats(graph).collect()}
    rest = sorted(k for k in got if k.startswith("symbols_")) + sorted(k for k in got if k.startswith("rel_"))
    return {k: got[k] for k in (*TOTALS, *rest)}
