"""Scored symbol search: exact and dotted-suffix rules first, likeness for what they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.fuzzy import may_reach, ratio_udf
from loomgraph.operators.graph import Graph
from loomgraph.operators.lookup import contains_pattern
from loomgraph.plans.schema import SYMBOL_COLUMNS


def _rules(query: str) -> list[tuple]:
    """(condition, score, step): the first that holds counts."""
    low, name, full = query.lower(), F.lower("name"), F.lower("qualified_name")
    rules = [(F.col("qualified_name") == query, 1.0, 1), (F.col("name") == query, 0.95, 2)]
    if "." in query:
        return [*rules, (full == low, 1.0, 3), (full.endswith("." + low), 0.90, 3), (full.contains(low), 0.75, 3)]
    like = contains_pattern("name", query)
    return [*rules, (like & (name == low), 0.85, 4), (like & full.endswith("." + low), 0.80, 5), (like & name.contains(low), 0.60, 6)]


def ladder(graph: Graph, query: str) -> DataFrame:
    """All symbols with ``score`` and ``step`` of the rules, null where none holds."""
    rules = _rules(query.strip())
    pick = lambda k: F.coalesce(*(F.when(r[0], F.lit(r[k])) for r in rules))
    return graph.symbols.select(*SYMBOL_COLUMNS, pick(1).alias("score"), pick(2).cast("int").alias("step"))


def find_symbol(graph: Graph, query: str, limit: int = 20, fuzzy: bool = True) -> DataFrame:
    """Symbols with ``score, step, raw``, best first, at most ``limit``.

    Order: score, step, likeness, qualified name, id. A blank query finds nothing. ``fuzzy=False`` leaves out likeness.
    """
    query = query.strip()
    scored = ladder(graph, query)
    if not query:
        return scored.withColumn("raw", F.lit(None).cast("double")).limit(0)
    found = scored.filter("score IS NOT NULL").withColumn("raw", F.lit(None).cast("double"))
    if fuzzy:
        low = query.lower()
        rest = scored.filter("score IS NULL").filter(may_reach(low, F.col("name"), F.col("qualified_name")))
        rest = rest.withColumn("r", ratio_udf(low)("name", "qualified_name")).filter("r.score IS NOT NULL")
        step = F.when(F.col("r.raw") >= 0.80, F.lit(7)).otherwise(F.lit(8))
        found = found.unionByName(rest.select(*SYMBOL_COLUMNS, F.col("r.score").alias("score"), step.alias("step"), F.col("r.raw").alias("raw")))
    return found.orderBy(F.desc("score"), "step", F.desc_nulls_last("raw"), "qualified_name", "id").limit(limit)


def resolve_symbol(graph: Graph, query: str, choose=None) -> str | None:
    """The id that a query stands for.

    One match is taken, and so is a best one of at least 0.85 that leads by 0.10 or more (in floating point: 0.95 leads
    0.85 by less). Else ``choose`` gets the first ten rows and returns a number from 1, by default 1; 0 means the last match,
    and anything that isn't a number of a match gives None.
    """
    rows = find_symbol(graph, query).select("id", "kind", "qualified_name", "score").collect()
    if not rows:
        return None
    if len(rows) == 1 or (rows[0].score >= 0.85 and rows[0].score - rows[1].score >= 0.10):
        return rows[0].id
    try:
        return rows[int(choose(rows[:10]) if choose else 1) - 1].id
    except (ValueError, IndexError, TypeError):
        return None
