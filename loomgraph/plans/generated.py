"""Source files generated from the star schema, one for each customer, to run ingestion at any scale, and their graph in SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.schema import stable_id
from loomgraph.sources.tree import source_files
from loomgraph.storage import shared_folder

#: A file's text as expression over ``k`` (the customer), ``n`` (its nation's name), ``nk`` (its number) and ``s`` (its segment);
#: Spark and DuckDB both read it. Lines are numbered by their place in the list.
LINES = [
    "'import json'", "'from ' || n || '.base import Base'", "''", "'LIMIT = ' || k", "''", "''", "'class Customer' || k || '(Base):'",
    "'    \"\"\"Segment ' || s || '.\"\"\"'", "''", "'    region = ' || nk", "''", "'    def total(self, rate=0.1) -> float:'", "'        return self.scale(rate)'",
    "''", "'    ' || CASE WHEN k % 2 = 0 THEN 'async ' ELSE '' END || 'def scale(self, x):'", "'        return round(x)'", "''", "''",
    "'def make_' || k || '():'", "'    return Customer' || k || '()'",
]
TEXT = "concat_ws(chr(10), " + ", ".join(LINES) + ", '')"
#: Files that a task makes, and works on after that.
FILES_A_PART = 2_000
_SOURCE = "SELECT c_custkey AS k, lower(n_name) AS n, n_nationkey AS nk, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey"


def generated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, path, language, module, text`` and what else a scan gives."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    base = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    base = base.select(F.col("c_custkey").alias("k"), F.lower("n_name").alias("n"), F.col("n_nationkey").alias("nk"), F.col("c_mktsegment").alias("s"))
    base = base.repartition(-(-customer.count() // FILES_A_PART) or 1, "k")  # the table is small, its files are not
    files = base.select(F.expr("'/gen/' || n || '/c' || k || '.py'").alias("path"), F.lit("python").alias("language"), F.expr("n || '.c' || k").alias("module"), F.expr(TEXT).alias("text"))
    return files.select(stable_id(F.lit("file"), F.col("path")).alias("id"), "*", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("bigint").alias("size_bytes"))


def _write(place: str, body: bytes) -> None:
    with open(place, "wb") as f:
        f.write(body)


def _write_rows(root: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folders = set()  # what is once in a folder is written once by a task
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                place = root + path
                folder = os.path.dirname(place)
                if folder not in folders:
                    folders.add(folder)
                    os.makedirs(folder + "/build", exist_ok=True)
                    _write(folder + "/__init__.py", b"")
                    _write(folder + "/build/skipped.py", b"x = 1\n")
                _write(place, text.encode())
                _write(place[:-3] + ".txt", b"no source")
                _write(place[:-3] + "_latin.py", b"# \xe9\n")
            yield pd.DataFrame({"n": [len(batch)]})

    return rows


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files written to a tree in the shared folder, among others that a scan leaves out, and scanned there;
    ``relative`` is the path below the tree. The folder has to be mounted on all executors."""
    root = f"{shared_folder(spark).removeprefix('file://')}/tree-{uuid.uuid4().hex}"
    generated_files(spark, sf_dir).select("path", "text").mapInPandas(_write_rows(root), "n bigint").agg(F.sum("n")).collect()
    return source_files(spark, root).withColumn("relative", F.substring("path", len(root) + 1, 10_000))


#: Symbols and edges of each file, from what the text says.
SQL = f"""
WITH base AS ({_SOURCE}),
made AS (SELECT *, '/gen/' || n || '/c' || k || '.py' AS path, n || '.c' || k AS m, 'Customer' || k AS cls, {TEXT} AS text FROM base),
scoped AS (SELECT *, m || '.c' || k AS p FROM made),
symbols AS (
    SELECT path, 'c' || k || '.py' AS name, path AS qualified_name, 'FILE' AS kind, 1 AS start_line, 1 AS end_line, '' AS signature, '' AS docstring, false AS is_async, CAST(NULL AS VARCHAR) AS parent FROM scoped
    UNION ALL SELECT path, 'LIMIT', m || '.LIMIT', 'CONSTANT', 4, 4, '', '', false, path FROM scoped
    UNION ALL SELECT path, cls, p || '.' || cls, 'CLASS', 7, 16, '', 'Segment ' || s || '.', false, path FROM scoped
    UNION ALL SELECT path, 'region', p || '.' || cls || '.region', 'FIELD', 10, 10, '', '', false, p || '.' || cls FROM scoped
    UNION ALL SELECT path, 'total', p || '.' || cls || '.total', 'METHOD', 12, 13, '(self, rate=0.1) -> float', '', false, p || '.' || cls FROM scoped
    UNION ALL SELECT path, 'scale', p || '.' || cls || '.scale', 'METHOD', 15, 16, '(self, x)', '', k % 2 = 0, p || '.' || cls FROM scoped
    UNION ALL SELECT path, 'make_' || k, p || '.make_' || k, 'FUNCTION', 19, 20, '()', '', false, path FROM scoped),
edges AS (
    SELECT path, 'CONTAINS' AS type, parent AS source, qualified_name AS target, 'resolved' AS resolution, start_line AS line, 0 AS col, CAST(NULL AS VARCHAR) AS wanted, CAST(NULL AS VARCHAR) AS call_text FROM symbols WHERE parent IS NOT NULL
    UNION ALL SELECT path, 'IMPORTS', path, '', 'unresolved', 1, 0, 'json', NULL FROM scoped
    UNION ALL SELECT path, 'IMPORTS', path, '', 'unresolved', 2, 0, n || '.base.Base', NULL FROM scoped
    UNION ALL SELECT path, 'EXTENDS', p || '.' || cls, '', 'unresolved', NULL, NULL, 'Base', NULL FROM scoped
    UNION ALL SELECT path, 'CALLS', p || '.' || cls || '.total', '', 'unresolved', 13, 15, NULL, 'self.scale' FROM scoped
    UNION ALL SELECT path, 'CALLS', p || '.' || cls || '.scale', '', 'unresolved', 16, 15, NULL, 'round' FROM scoped
    UNION ALL SELECT path, 'CALLS', p || '.make_' || k, p || '.' || cls, 'probable', 20, 11, NULL, cls FROM scoped)
"""
