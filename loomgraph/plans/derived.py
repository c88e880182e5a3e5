"""A code-like graph derived from the star schema, to run the graph operators on large tables without source code.

Regions are packages, nations modules, customers classes, suppliers interfaces and parts functions. Customers call the
suppliers of what they ordered, suppliers import parts, and so on; returned lines give unresolved imports that name
their target fully, by a suffix, or not at all.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.storage import written


def _symbol(df: DataFrame, **columns) -> DataFrame:
    fixed = {"language": F.lit("python"), "signature": F.lit(""), "docstring": F.lit(""), "is_async": F.lit(False)}
    return df.select(*(v.alias(k) for k, v in {**columns, **fixed}.items()))


def _edge(df: DataFrame, kind: str, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
    """Distinct edges between (prefix, key column): keys are told apart before they become longer ids."""
    one = df.select(F.col(source[1]).alias("a"), F.col(target[1]).alias("b")).distinct()
    return one.select(_id(source[0], "a").alias("source_id"), _id(target[0], "b").alias("target_id"), F.lit(kind).alias("type"))


def _id(prefix: str, column):
    return F.concat(F.lit(f"{prefix}:"), F.col(column) if isinstance(column, str) else column)


def derived_graph(spark: SparkSession, sf_dir: str) -> Graph:
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    region, nation, part, lines = read["region"], read["nation"], read["part"], read["lineitem"]
    placed = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    files = region.select(_id("file", F.concat(F.lit("r"), F.col("r_regionkey"))).alias("id"), F.concat(F.lit("/src/"), F.lower("r_name"), F.lit("/__init__.py")).alias("path")).unionByName(
        placed.select(_id("file", F.concat(F.lit("n"), F.col("n_nationkey"))).alias("id"), F.concat(F.lit("/src/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit(".py")).alias("path"))
    )
    files = files.select(
        "id", "path", F.lit("python").alias("language"), F.sha2("path", 256).alias("content_hash"), F.length("path").cast("bigint").alias("size_bytes"), F.lit(None).cast("timestamp").alias("indexed_at")
    )
    module = F.concat_ws(".", "r_name", "n_name")
    line = lambda key: ((F.col(key) % 1000) + 1).cast("int")
    symbols = [
        _symbol(region, id=_id("region", "r_regionkey"), name=F.col("r_name"), qualified_name=F.col("r_name"), kind=F.lit("PACKAGE"),
                file_id=_id("file", F.concat(F.lit("r"), F.col("r_regionkey"))), start_line=F.lit(1), end_line=F.lit(1), parent_id=F.lit(None).cast("string")),
        _symbol(placed, id=_id("nation", "n_nationkey"), name=F.col("n_name"), qualified_name=module, kind=F.lit("MODULE"),
                file_id=_id("file", F.concat(F.lit("n"), F.col("n_nationkey"))), start_line=F.lit(1), end_line=F.lit(1000), parent_id=_id("region", "r_regionkey")),
    ]
    for table, p, kind in (("customer", "c", "CLASS"), ("supplier", "s", "INTERFACE")):
        key = f"{p}_{'cust' if p == 'c' else 'supp'}key"
        owned = read[table].join(F.broadcast(placed), F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        symbols.append(
            _symbol(owned, id=_id(table, key), name=F.col(f"{p}_name"), qualified_name=F.concat_ws(".", module, f"{p}_name"), kind=F.lit(kind),
                    file_id=_id("file", F.concat(F.lit("n"), F.col("n_nationkey"))), start_line=line(key), end_line=line(key) + 4, parent_id=_id("nation", "n_nationkey"))
        )
    symbols.append(
        _symbol(part, id=_id("part", "p_partkey"), name=F.col("p_name"), qualified_name=F.concat_ws(".", "p_brand", "p_type", "p_name"), kind=F.lit("FUNCTION"),
                file_id=_id("file", F.concat(F.lit("n"), F.col("p_partkey") % 25)), start_line=line("p_partkey"), end_line=line("p_partkey") + 4, parent_id=F.lit(None).cast("string"))
    )
    every = symbols[0]
    for s in symbols[1:]:
        every = every.unionByName(s)
    sold = lines.join(read["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    brand = part.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("first"))
    kind = part.groupBy("p_type").agg(F.min("p_partkey").alias("first"))
    edges = [
        _edge(nation, "CONTAINS", ("region", "n_regionkey"), ("nation", "n_nationkey")),
        _edge(read["customer"], "CONTAINS", ("nation", "c_nationkey"), ("customer", "c_custkey")),
        _edge(read["supplier"], "CONTAINS", ("nation", "s_nationkey"), ("supplier", "s_suppkey")),
        _edge(sold, "CALLS", ("customer", "o_custkey"), ("supplier", "l_suppkey")),
        _edge(lines, "IMPORTS", ("supplier", "l_suppkey"), ("part", "l_partkey")),
        _edge(sold.filter("l_returnflag = 'A'"), "REFERENCES", ("customer", "o_custkey"), ("part", "l_partkey")),
        _edge(part.join(F.broadcast(brand), "p_brand").filter("p_partkey <> first"), "EXTENDS", ("part", "p_partkey"), ("part", "first")),
        _edge(part.join(F.broadcast(kind), "p_type").filter("p_partkey <> first"), "IMPLEMENTS", ("part", "p_partkey"), ("part", "first")),
    ]
    known = edges[0]
    for e in edges[1:]:
        known = known.unionByName(e)
    known = known.select(
        F.concat_ws("|", "type", "source_id", "target_id").alias("id"), "source_id", "target_id", "type",
        F.lit("resolved").alias("resolution"), F.lit(None).cast("string").alias("target_name"),
    )
    back = lines.filter("l_returnflag = 'R'").join(part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") == 1, F.concat_ws(".", "p_brand", "p_type", "p_name")).when(F.col("l_linenumber") == 2, F.concat_ws(".", "p_type", "p_name"))
    name = name.when(F.col("l_linenumber") == 3, F.col("p_name")).otherwise(F.concat(F.lit("missing."), F.col("l_linenumber")))
    lost = back.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name.alias("target_name")).distinct()
    lost = lost.select(
        F.concat_ws("|", F.lit("lost"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), _id("supplier", "l_suppkey").alias("source_id"), F.lit("").alias("target_id"), F.lit("IMPORTS").alias("type"),
        F.lit("unresolved").alias("resolution"), "target_name",
    )
    rels = known.unionByName(lost).select(
        "id", "source_id", "target_id", "type", F.lit(None).cast("struct<file_id:string,line:int,col:int>").alias("source_location"), "resolution",
        F.when(F.col("target_name").isNotNull(), F.create_map(F.lit("target_name"), F.col("target_name"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    return Graph(files, every, rels)


#: Bytes of line items on disk for each part that the edges are stored in, where the session's number of partitions is less.
LINE_BYTES_A_PART = 16 << 20


def _ranged(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """Sorted parts by ranges of the keys, more of them as the tables grow."""
    n = size // LINE_BYTES_A_PART
    few = n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(*keys) if few else df.repartitionByRange(n, *keys)).sortWithinPartitions(*keys)


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The derived graph, written once for each application: edges by type and source, and, once a walk asks for it, by target."""
    known = spark.sparkContext.__dict__.setdefault("_loomgraph_graphs", {})
    if sf_dir not in known:
        g = derived_graph(spark, sf_dir)
        keep = lambda df, tag: written(df, tag)[0]
        size = int(spark.read.parquet(f"{sf_dir}/lineitem.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        symbols = keep(g.symbols.repartitionByRange("id").sortWithinPartitions("id"), "symbols")
        edges = keep(_ranged(g.relationships, size, "type", "source_id"), "relationships")

        @cache
        def incoming() -> DataFrame:
            """Without the unresolved edges: they lead nowhere, and their empty target would bring all of them into one task."""
            return keep(_ranged(edges.filter("target_id <> ''"), size, "target_id", "type"), "incoming")

        known[sf_dir] = Graph(keep(g.files, "files"), symbols, edges, incoming)
    return known[sf_dir]


#: The same graph for SQL; ``relationships`` has ``target_name`` for the metadata.
SQL_TABLES = """
WITH RECURSIVE placed AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
files AS (
    SELECT 'file:r' || r_regionkey AS id, '/src/' || lower(r_name) || '/__init__.py' AS path FROM region
    UNION ALL SELECT 'file:n' || n_nationkey, '/src/' || lower(r_name) || '/' || lower(n_name) || '.py' FROM placed),
symbols AS (
    SELECT 'region:' || r_regionkey AS id, r_name AS name, r_name AS qualified_name, 'PACKAGE' AS kind, 'file:r' || r_regionkey AS file_id, 1 AS start_line, 1 AS end_line, CAST(NULL AS VARCHAR) AS parent_id FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, n_name, r_name || '.' || n_name, 'MODULE', 'file:n' || n_nationkey, 1, 1000, 'region:' || r_regionkey FROM placed
    UNION ALL SELECT 'customer:' || c_custkey, c_name, r_name || '.' || n_name || '.' || c_name, 'CLASS', 'file:n' || n_nationkey, CAST(c_custkey % 1000 + 1 AS INT), CAST(c_custkey % 1000 + 5 AS INT), 'nation:' || n_nationkey FROM customer JOIN placed ON c_nationkey = n_nationkey
    UNION ALL SELECT 'supplier:' || s_suppkey, s_name, r_name || '.' || n_name || '.' || s_name, 'INTERFACE', 'file:n' || n_nationkey, CAST(s_suppkey % 1000 + 1 AS INT), CAST(s_suppkey % 1000 + 5 AS INT), 'nation:' || n_nationkey FROM supplier JOIN placed ON s_nationkey = n_nationkey
    UNION ALL SELECT 'part:' || p_partkey, p_name, p_brand || '.' || p_type || '.' || p_name, 'FUNCTION', 'file:n' || p_partkey % 25, CAST(p_partkey % 1000 + 1 AS INT), CAST(p_partkey % 1000 + 5 AS INT), NULL FROM part),
sold AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
known AS (
    SELECT 'region:' || n_regionkey AS source_id, 'nation:' || n_nationkey AS target_id, 'CONTAINS' AS type FROM nation
    UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS' FROM customer
    UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS' FROM supplier
    UNION SELECT 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'CALLS' FROM sold
    UNION SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'IMPORTS' FROM lineitem
    UNION SELECT 'customer:' || o_custkey, 'part:' || l_partkey, 'REFERENCES' FROM sold WHERE l_returnflag = 'A'
    UNION SELECT 'part:' || p_partkey, 'part:' || first, 'EXTENDS' FROM part JOIN (SELECT p_brand, arg_min(p_partkey, {'a': p_retailprice, 'b': p_partkey}) AS first FROM part GROUP BY p_brand) USING (p_brand) WHERE p_partkey <> first
    UNION SELECT 'part:' || p_partkey, 'part:' || first, 'IMPLEMENTS' FROM part JOIN (SELECT p_type, min(p_partkey) AS first FROM part GROUP BY p_type) USING (p_type) WHERE p_partkey <> first),
relationships AS (
    SELECT type || '|' || source_id || '|' || target_id AS id, source_id, target_id, type, 'resolved' AS resolution, CAST(NULL AS VARCHAR) AS target_name FROM known
    UNION ALL
    SELECT DISTINCT 'lost|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey, 'supplier:' || l_suppkey, '', 'IMPORTS', 'unresolved',
           CASE l_linenumber WHEN 1 THEN p_brand || '.' || p_type || '.' || p_name WHEN 2 THEN p_type || '.' || p_name WHEN 3 THEN p_name ELSE 'missing.' || l_linenumber END
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')
"""
