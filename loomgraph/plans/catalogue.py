"""Queries of the graph operators over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import render
from loomgraph.operators import graph as graphs
from loomgraph.operators import ingest, lookup, resolve, search, stats, traverse
from loomgraph.plans import generated
from loomgraph.plans.derived import SQL_TABLES, stored_graph

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

PLACE = ("id", "name", "qualified_name", "kind", "file_id", "start_line", "end_line", "parent_id")
_PLACE = ", ".join(f"s.{c}" for c in PLACE)


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of a graph as query, with the SELECT that gives the same over the derived tables."""

    def add(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(stored_graph(spark, sf_dir))

        run.__name__ = key
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = SQL_TABLES + sql
        return f

    return add


@query("SELECT id, path FROM files")
def all_files(g):
    return lookup.all_files(g).select("id", "path")


@query(f"SELECT {_PLACE} FROM symbols s")
def all_symbols(g):
    return lookup.all_symbols(g).select(*PLACE)


@query("SELECT id, name, qualified_name FROM symbols")
def all_symbol_names(g):
    return lookup.all_symbol_names(g)


@query("SELECT id, source_id, target_name FROM relationships WHERE target_id = '' OR resolution = 'unresolved'")
def unresolved(g):
    return lookup.unresolved_relationships(g).select("id", "source_id", F.col("metadata")["target_name"].alias("target_name"))


@query("SELECT id, path FROM files WHERE id = 'file:n3'")
def get_file(g):
    return lookup.get_file(g, "file:n3").select("id", "path")


@query(f"SELECT {_PLACE} FROM symbols s WHERE id = 'part:7'")
def get_symbol(g):
    return lookup.get_symbol(g, "part:7").select(*PLACE)


@query(f"SELECT {_PLACE} FROM symbols s WHERE name = 'red widget'")
def find_by_name_exact(g):
    return lookup.find_by_name(g, "red widget", exact=True).select(*PLACE)


@query(f"SELECT {_PLACE} FROM symbols s WHERE name ILIKE '%BLUE_b%'")
def find_by_name_like(g):
    return lookup.find_by_name(g, "BLUE_b").select(*PLACE)


@query(f"SELECT {_PLACE} FROM symbols s WHERE qualified_name = 'asia.nation_2' OR qualified_name ILIKE '%asia.nation_2%'")
def find_by_qname(g):
    return lookup.find_by_qualified_name(g, "asia.nation_2").select(*PLACE)


@query("SELECT id, source_id, target_id, type FROM relationships WHERE source_id = 'supplier:5'")
def relationships_from(g):
    return lookup.relationships_from(g, "supplier:5").select("id", "source_id", "target_id", "type")


@query("SELECT id, source_id, target_id, type FROM relationships WHERE target_id = 'part:7' AND type = 'IMPORTS'")
def relationships_to(g):
    return lookup.relationships_to(g, "part:7", "IMPORTS").select("id", "source_id", "target_id", "type")


def _hop(condition: str, end: str) -> str:
    return f"SELECT {_PLACE}, r.id AS rel_id FROM relationships r JOIN symbols s ON r.{end} = s.id WHERE {condition}"


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*PLACE, "rel_id")


@query(_hop("r.type = 'CALLS' AND r.target_id = 'supplier:5'", "source_id"))
def callers(g):
    return _rows(lookup.callers(g, "supplier:5"))


@query(_hop("r.type = 'CALLS' AND r.source_id = 'customer:7'", "target_id"))
def callees(g):
    return _rows(lookup.callees(g, "customer:7"))


@query(_hop("r.type = 'REFERENCES' AND r.target_id = 'part:7'", "source_id"))
def references(g):
    return _rows(lookup.references(g, "part:7"))


@query(
    "SELECT s.id, s.qualified_name, r.type AS rel_type FROM relationships r JOIN symbols s ON r.source_id = s.id "
    "WHERE r.type IN ('IMPLEMENTS', 'EXTENDS') AND r.target_id = (SELECT min(target_id) FROM relationships WHERE type = 'EXTENDS')"
)
def implementations(g):
    first = g.relationships.filter("type = 'EXTENDS'").agg(F.min("target_id").alias("id"))
    return lookup.implementations(g, first).select("id", "qualified_name", "rel_type")


@query(_hop("r.type = 'IMPORTS' AND r.target_id = 'part:7'", "source_id"))
def importers(g):
    return _rows(lookup.importers(g, "part:7"))


@query("SELECT id, coalesce(target_name, nullif(target_id, ''), '?') AS target, resolution FROM relationships WHERE type = 'IMPORTS' AND source_id = 'supplier:5'")
def imports(g):
    return lookup.imports(g, "supplier:5").select("id", "target", "resolution")


@query(_hop("r.type = 'CONTAINS' AND r.source_id = 'nation:3'", "target_id"))
def children(g):
    return _rows(lookup.children(g, "nation:3"))


@query(_hop("r.type = 'CONTAINS' AND r.target_id = 'supplier:5'", "source_id"))
def parents(g):
    return _rows(lookup.parents(g, "supplier:5"))


@query("SELECT r.target_id AS for_id, s.id, r.id AS rel_id FROM relationships r JOIN symbols s ON r.source_id = s.id WHERE r.type = 'CALLS' AND r.target_id IN (SELECT id FROM symbols WHERE kind = 'INTERFACE')")
def callers_of_all(g):
    return lookup.callers(g, g.symbols.filter("kind = 'INTERFACE'")).select("for_id", "id", "rel_id")


@query("SELECT s.id, coalesce(f.path, '?') AS file_path FROM symbols s LEFT JOIN files f ON s.file_id = f.id")
def symbols_with_files(g):
    return lookup.with_files(g, g.symbols).select("id", "file_path")


_LADDER = """
, scored AS (
    SELECT id, qualified_name, {score} AS score, {step} AS step FROM symbols)
SELECT id, qualified_name, CAST(score AS DOUBLE) AS score, CAST(step AS INT) AS step FROM scored WHERE score IS NOT NULL
ORDER BY score DESC, step, qualified_name, id LIMIT 20"""


def _case(rules: list[tuple[str, float, int]], k: int) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k]}" for r in rules) + " END"


def _ladder(rules: list[tuple[str, float, int]]) -> str:
    return _LADDER.format(score=_case(rules, 1), step=_case(rules, 2))


@query(_ladder([("qualified_name = 'Red Widget'", 1.0, 1), ("name = 'Red Widget'", 0.95, 2), ("lower(name) = 'red widget'", 0.85, 4),
                ("name ILIKE '%Red Widget%' AND lower(qualified_name) LIKE '%.red widget'", 0.8, 5), ("lower(name) LIKE '%red widget%'", 0.6, 6)]))
def find_ladder(g):
    return search.find_symbol(g, " Red Widget ", fuzzy=False).select("id", "qualified_name", "score", "step")


@query(_ladder([("qualified_name = 'ECONOMY.red widget'", 1.0, 1), ("name = 'ECONOMY.red widget'", 0.95, 2), ("lower(qualified_name) = 'economy.red widget'", 1.0, 3),
                ("lower(qualified_name) LIKE '%.economy.red widget'", 0.9, 3), ("lower(qualified_name) LIKE '%economy.red widget%'", 0.75, 3)]))
def find_ladder_dotted(g):
    return search.find_symbol(g, "ECONOMY.red widget", fuzzy=False).select("id", "qualified_name", "score", "step")


@query()
def find_fuzzy(g):
    return search.find_symbol(g, "Suplier#00000005").select("id", "qualified_name", "score", "step", "raw")


#: Least depths: each vertex is expanded once, so the SQL may use the plain recursion with set semantics.
_WALK = """
, known_edges AS (SELECT DISTINCT source_id AS a, target_id AS b, type FROM relationships WHERE target_id <> ''),
edges AS ({edges}),
walk(from_id, symbol_id, depth, rel_type) AS (
    SELECT CAST(NULL AS VARCHAR), '{start}', 0, CAST(NULL AS VARCHAR)
    UNION
    SELECT w.symbol_id, e.dst, w.depth + 1, e.type FROM walk w JOIN edges e ON e.src = w.symbol_id WHERE w.depth < {depth}),
hops AS (SELECT * FROM walk WHERE depth > 0 AND {types})
"""
_OUT, _IN = "SELECT a AS src, b AS dst, type FROM known_edges", "SELECT b AS src, a AS dst, type FROM known_edges"
_NODES = f"""
, firsts AS (
    SELECT symbol_id, depth, rel_type, row_number() OVER (PARTITION BY symbol_id ORDER BY depth, rel_type, from_id) AS n FROM hops WHERE symbol_id <> '{{start}}')
SELECT {_PLACE}, CAST(depth AS INT) AS depth, rel_type AS via FROM firsts JOIN symbols s ON symbol_id = s.id WHERE n = 1"""
_EDGES = """
, found AS (SELECT {source} AS source_id, {target} AS target_id, rel_type AS type, CAST(min(depth) AS INT) AS depth FROM hops GROUP BY 1, 2, 3)
SELECT * FROM found WHERE source_id IN (SELECT id FROM symbols) AND target_id IN (SELECT id FROM symbols)"""


def _types(types) -> str:
    return f"rel_type IN ({', '.join(repr(t) for t in types)})" if types else "true"


def _walk_sql(start: str, direction: str, depth: int, types=None, edges: bool = False) -> str:
    way = {"in": _IN, "both": f"{_OUT} UNION {_IN}"}.get(direction, _OUT)
    ends = {"source": "symbol_id", "target": "from_id"} if direction == "in" else {"source": "from_id", "target": "symbol_id"}
    tail = _EDGES.format(**ends) if edges else _NODES.format(start=start)
    return _WALK.format(edges=way, start=start, depth=depth, types=_types(types)) + tail


def _reached(df: DataFrame) -> DataFrame:
    return df.select(*PLACE, "depth", "via")


@query(_walk_sql("nation:3", "out", 3))
def walk_out(g):
    return _reached(traverse.walk(g, "nation:3"))


@query(_walk_sql("nation:3", "out", 3), name="walk_out_recursive")
def _walk_out_recursive(g):
    return _reached(traverse.walk(g, "nation:3", engine="cte"))


@query(_walk_sql("part:7", "in", 3, ["CALLS", "CONTAINS"]))
def walk_in(g):
    return _reached(traverse.walk(g, "part:7", ["CALLS", "CONTAINS"], "in"))


@query(_walk_sql("supplier:5", "both", 2))
def walk_both(g):
    return _reached(traverse.walk(g, "supplier:5", direction="both", depth=2))


@query(_walk_sql("nation:3", "out", 3, ["IMPORTS"], edges=True))
def walk_edges(g):
    return traverse.walk_edges(g, "nation:3", ["IMPORTS"])


@query(_walk_sql("part:7", "in", 3, edges=True))
def walk_edges_in(g):
    return traverse.walk_edges(g, "part:7", direction="in")


@query(_walk_sql("customer:7", "out", 5, traverse.TRACE_TYPES))
def trace(g):
    return _reached(traverse.trace(g, "customer:7"))


@query(_walk_sql("part:7", "in", 3, traverse.BLAST_TYPES))
def blast_radius(g):
    return _reached(traverse.blast_radius(g, "part:7"))


@query("""
SELECT 'files' AS metric, count(*) AS n FROM files
UNION ALL SELECT 'symbols', count(*) FROM symbols
UNION ALL SELECT 'relationships', count(*) FROM relationships
UNION ALL SELECT 'unresolved_relationships', count(*) FROM relationships WHERE target_id = ''
UNION ALL SELECT 'symbols_' || lower(kind), count(*) FROM symbols GROUP BY kind
UNION ALL SELECT 'rel_' || lower(type), count(*) FROM relationships GROUP BY type""", name="stats")
def _stats(g):
    return stats.stats(g)


@query("SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def kind_counts(g):
    return stats.kind_counts(g)


@query("SELECT type, count(*) AS n FROM relationships GROUP BY type")
def rel_counts(g):
    return stats.type_counts(g)


_RESOLVE = """
, asked AS (SELECT id, target_name AS wanted FROM relationships WHERE (target_id = '' OR resolution = 'unresolved') AND target_name <> ''),
wants AS (SELECT DISTINCT wanted FROM asked),
exact AS (SELECT qualified_name, max(id) AS exact_id FROM symbols GROUP BY qualified_name),
close AS (
    SELECT wanted, id, row_number() OVER (PARTITION BY wanted ORDER BY length(qualified_name), qualified_name, id) AS n
    FROM wants JOIN (
        SELECT id, qualified_name, unnest(list_distinct(list_append(list_transform(range(2, len(string_split(qualified_name, '.')) + 1), lambda i: array_to_string(list_slice(string_split(qualified_name, '.'), i, 1000), '.')), name))) AS tail FROM symbols) ON tail = wanted),
resolved AS (
    SELECT asked.id, coalesce(exact_id, close.id) AS target_id, CASE WHEN exact_id IS NOT NULL THEN 'resolved' ELSE 'probable' END AS resolution
    FROM asked LEFT JOIN exact ON wanted = exact.qualified_name LEFT JOIN close ON close.wanted = asked.wanted AND n = 1
    WHERE coalesce(exact_id, close.id) IS NOT NULL)
"""


@query(_RESOLVE + "SELECT * FROM resolved")
def resolve_cross_file(g):
    return resolve.resolve(g)


@query(_RESOLVE + "SELECT r.id, r.source_id, coalesce(x.target_id, r.target_id) AS target_id, r.type, coalesce(x.resolution, r.resolution) AS resolution FROM relationships r LEFT JOIN resolved x USING (id)")
def resolved_relationships(g):
    return resolve.resolved_graph(g).relationships.select("id", "source_id", "target_id", "type", "resolution")


@query("SELECT id, source_id, target_id, type FROM relationships WHERE source_id IN (SELECT id FROM symbols)")
def export_edges(g):
    return render.exported_relationships(g).select("id", "source_id", "target_id", "type")


@query("SELECT id, path, CASE WHEN id LIKE 'file:n%' THEN 'changed' ELSE '' END AS content_hash FROM files UNION ALL SELECT 'new:1', '/src/new.py', 'changed'")
def upsert_files(g):
    old = g.files.withColumn("content_hash", F.lit(""))
    new = old.filter("id LIKE 'file:n%'").withColumn("id", F.concat(F.lit("again:"), "id"))
    extra = old.filter("id = 'file:n0'").withColumn("id", F.lit("new:1")).withColumn("path", F.lit("/src/new.py"))
    return graphs.upsert_files(old, new.unionByName(extra).withColumn("content_hash", F.lit("changed"))).select("id", "path", "content_hash")


@query("SELECT id, source_id, CASE WHEN id LIKE 'lost|1|%' THEN 'part:1' ELSE target_id END AS target_id, CASE WHEN id LIKE 'lost|1|%' THEN 'probable' ELSE resolution END AS resolution FROM relationships")
def update_relationships(g):
    new = g.relationships.filter("id LIKE 'lost|1|%'").select("id", F.lit("part:1").alias("target_id"), F.lit("probable").alias("resolution"))
    return graphs.update_relationships(g.relationships, new).select("id", "source_id", "target_id", "resolution")


@query("SELECT s.id, CASE WHEN s.parent_id = 'nation:3' THEN NULL ELSE s.parent_id END AS parent_id FROM symbols s WHERE file_id <> 'file:n3'")
def delete_files(g):
    return graphs.delete_files(g, g.files.filter("id = 'file:n3'").select("id")).symbols.select("id", "parent_id")


@query(
    _walk_sql("nation:3", "out", 2, edges=True).replace("SELECT * FROM found", "SELECT '  node_' || source_id || ' -> node_' || target_id || ' [label=\"' || type || '\", color=\"' || "
    "CASE type WHEN 'CALLS' THEN '#1976D2\", style=\"solid' WHEN 'IMPORTS' THEN '#7B1FA2\", style=\"dashed' WHEN 'REFERENCES' THEN '#616161\", style=\"dotted' WHEN 'CONTAINS' THEN '#BDBDBD\", style=\"dotted' END || '\"];' AS line FROM found")
)
def dot_lines(g):
    return render.dot_edge_lines(traverse.walk_edges(g, "nation:3", depth=2))


@query(_walk_sql("nation:3", "out", 2, edges=True).replace("SELECT * FROM found", "SELECT '  node_' || source_id || ' -- ' || type || ' --> node_' || target_id AS line FROM found"))
def mermaid_lines(g):
    return render.mermaid_edge_lines(traverse.walk_edges(g, "nation:3", depth=2))


#: One level below a vertex, in the order in which renderings list nodes and edges.
_DRAWN = """
, hops AS (SELECT DISTINCT target_id, type FROM relationships WHERE source_id = 'nation:3' AND target_id <> '' AND target_id IN (SELECT id FROM symbols)),
nodes AS (SELECT s.id, s.qualified_name AS q, s.kind AS k, min(type) AS via FROM hops JOIN symbols s ON s.id = target_id GROUP BY ALL),
root AS (SELECT id, qualified_name AS q, kind AS k FROM symbols WHERE id = 'nation:3'),
lines(part, n, line) AS ({}),
numbered AS (SELECT row_number() OVER (ORDER BY part, n) AS number, line FROM lines)
SELECT number, line FROM numbered"""
_NODE_ORDER, _EDGE_ORDER = "row_number() OVER (ORDER BY via, q, nodes.id)", "row_number() OVER (ORDER BY type, target_id)"


def _drawing(g):
    return render.Drawing(g, traverse.walk_graph(g, "nation:3", depth=1))


def _document(g, text: str) -> DataFrame:
    """The lines of a rendering that is made on the driver, of a walk that its depth bounds."""
    return g.spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "number bigint, line string")


@query(_DRAWN.format(
    f"""SELECT 1, 1, q || ' [' || k || ']' FROM root
    UNION ALL SELECT 2, {_EDGE_ORDER}, CASE WHEN {_EDGE_ORDER} = (SELECT count(*) FROM hops) THEN chr(92) ELSE '|' END || '-- --[' || type || ']--> ' || q || ' [' || k || ']' FROM hops JOIN nodes ON target_id = id"""
))
def tree_document(g):
    return _document(g, render.ascii_tree(_drawing(g)))


@query(_DRAWN.format(
    f"""SELECT 1, 1, 'graph LR'
    UNION ALL SELECT 2, 1, '  node_' || id || '["' || q || '<br/>(' || k || ')"]:::rootClass' FROM root
    UNION ALL SELECT 3, {_NODE_ORDER}, '  node_' || id || '["' || q || '<br/>(' || k || ')"]' FROM nodes
    UNION ALL SELECT 4, {_EDGE_ORDER}, '  node_nation:3 -- ' || type || ' --> node_' || target_id FROM hops
    UNION ALL SELECT 5, 1, '  classDef rootClass fill:#0288D1,stroke:#01579B,stroke-width:2px,color:#fff'"""
))
def mermaid_document(g):
    return _document(g, render.mermaid(_drawing(g)))


_FILL = "CASE k WHEN 'CLASS' THEN '#E1F5FE' WHEN 'INTERFACE' THEN '#E8EAF6' WHEN 'MODULE' THEN '#F3E5F5' END"
_DOT_NODE = "'  node_' || id || ' [label=\"' || q || chr(92) || 'n[' || k || ']\", fillcolor=\"' || " + _FILL + " || '\", "


@query(_DRAWN.format(
    f"""SELECT 1, 1, 'digraph CodeGraph {{{{' UNION ALL SELECT 1, 2, '  rankdir="LR";'
    UNION ALL SELECT 1, 3, '  node [shape="box", style="rounded,filled", fontname="Helvetica", fontsize=10];'
    UNION ALL SELECT 1, 4, '  edge [fontname="Helvetica", fontsize=9];' UNION ALL SELECT 1, 5, ''
    UNION ALL SELECT 2, 1, {_DOT_NODE}color="#0288D1", penwidth=2.0];' FROM root
    UNION ALL SELECT 3, {_NODE_ORDER}, {_DOT_NODE}color="#B0BEC5", penwidth=1.0];' FROM nodes
    UNION ALL SELECT 4, 0, ''
    UNION ALL SELECT 4, {_EDGE_ORDER}, '  node_nation:3 -> node_' || target_id || ' [label="' || type || '", color="#BDBDBD", style="dotted"];' FROM hops
    UNION ALL SELECT 5, 1, '}}}}'""".replace("{{", "{").replace("}}", "}")
))
def dot_document(g):
    return _document(g, render.dot(_drawing(g)))


@query("SELECT r.source_id AS for_id, s.id, r.id AS rel_id FROM relationships r JOIN symbols s ON r.target_id = s.id WHERE r.type = 'CALLS' AND s.id NOT LIKE '%7' AND r.source_id IN (SELECT id FROM symbols WHERE kind = 'CLASS' AND id NOT LIKE '%7')")
def callees_where_some_are_missing(g):
    left = graphs.Graph(g.files, g.symbols.filter("NOT endswith(id, '7')"), g.relationships)
    return lookup.callees(left, left.symbols.filter("kind = 'CLASS'")).select("for_id", "id", "rel_id")


def source_query(sql: str):
    """Registers a function of generated source files."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = generated.SQL + sql
        return f

    return add


def _analysis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = generated.generated_files(spark, sf_dir)
    return files, ingest.analyze(files)


@source_query(
    "SELECT substr(path, 5) AS path, 'python' AS language, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size_bytes, m AS module FROM made "
    "UNION ALL SELECT DISTINCT '/' || n || '/__init__.py', 'python', sha256(''), CAST(0 AS BIGINT), n || '.__init__' FROM made"
)
def discovered_files(spark, sf_dir):
    found = generated.scanned_files(spark, sf_dir)
    return found.select(F.substring("relative", 5, 10_000).alias("path"), "language", "content_hash", "size_bytes", "module")


@source_query("SELECT * FROM symbols")
def analyzed_symbols(spark, sf_dir):
    _, found = _analysis(spark, sf_dir)
    each = found.select("path", F.inline("symbols"), F.map_from_arrays(F.col("symbols.id"), F.col("symbols.qualified_name")).alias("names"))
    return each.select("path", "name", "qualified_name", "kind", "start_line", "end_line", "signature", "docstring", "is_async", F.try_element_at("names", F.col("parent_id")).alias("parent"))


@source_query("SELECT * FROM edges")
def analyzed_edges(spark, sf_dir):
    _, found = _analysis(spark, sf_dir)
    each = found.select("path", F.inline("relationships"), F.map_from_arrays(F.col("symbols.id"), F.col("symbols.qualified_name")).alias("names"))
    name = lambda c: F.coalesce(F.try_element_at("names", F.col(c)), F.lit(""))
    return each.select(
        "path", "type", name("source_id").alias("source"), name("target_id").alias("target"), "resolution", F.col("source_location.line").alias("line"),
        F.col("source_location.col").alias("col"), F.col("metadata")["target_name"].alias("wanted"), F.col("metadata")["call_text"].alias("call_text"),
    )


@source_query("SELECT type, resolution, count(*) AS n FROM edges WHERE type = 'CALLS' GROUP BY ALL")
def in_file_calls(spark, sf_dir):
    _, found = _analysis(spark, sf_dir)
    return found.select(F.inline("relationships")).filter("type = 'CALLS'").groupBy("type", "resolution").agg(F.count("*").alias("n"))


@source_query(
    "SELECT (SELECT count(*) FROM made) AS files_analyzed, (SELECT count(*) FROM symbols) AS symbols_extracted, (SELECT count(*) FROM edges) AS relationships_extracted, CAST(0 AS BIGINT) AS errors"
)
def index_totals(spark, sf_dir):
    _, found = _analysis(spark, sf_dir)
    return found.agg(
        F.count_if(F.col("error").isNull()).alias("files_analyzed"), F.sum(F.size("symbols").cast("bigint")).alias("symbols_extracted"),
        F.sum(F.size("relationships").cast("bigint")).alias("relationships_extracted"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


@source_query("SELECT qualified_name, start_line, end_line, array_to_string(list_slice(string_split(text, chr(10)), start_line, end_line), chr(10)) AS body FROM symbols JOIN made USING (path)")
def source_slice(spark, sf_dir):
    files, found = _analysis(spark, sf_dir)
    slices = ingest.source_slices(found.select(F.inline("symbols")), files, keep=("qualified_name",))
    return slices.select("qualified_name", "start_line", "end_line", F.array_join("lines", "\n").alias("body"))
