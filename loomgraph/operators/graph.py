"""The graph as three DataFrames, and a store of it in versioned Parquet tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.schema import FILES, RELATIONSHIPS, SCHEMA_VERSION, SYMBOLS, normalise_symbols
from loomgraph.storage import hadoop_path, swap

TABLES = {"files": FILES, "symbols": SYMBOLS, "relationships": RELATIONSHIPS}


@dataclass(frozen=True)
class Graph:
    """``files``, ``symbols`` (vertices) and ``relationships`` (directed edges; a target of '' is unresolved).

    ``incoming`` may be a copy of the relationships that have a target, laid out by target, for walks against the edges; or a
    function that gives it, for a copy that is only made when it is asked for.
    """

    files: DataFrame
    symbols: DataFrame
    relationships: DataFrame
    incoming: DataFrame | Callable[[], DataFrame] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.symbols.sparkSession

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(*(spark.createDataFrame([], schema) for schema in TABLES.values()))


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files by path: a known path keeps its id and takes everything else from ``new``; others are added."""
    latest = new.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("indexed_at"), F.desc("id")))).filter("rn = 1").drop("rn")
    kept = old.join(latest.select("path"), "path", "left_anti").select(old.columns)
    known = old.select(F.col("path"), F.col("id").alias("old_id"))
    changed = latest.join(known, "path", "left").withColumn("id", F.coalesce("old_id", "id")).select(old.columns)
    return kept.unionByName(changed)


def insert_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose id ``old`` lacks are added, once each."""
    return old.unionByName(new.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti").select(old.columns))


def merge_results(graph: Graph, found: Graph) -> Graph:
    """The graph with analysis results added.

    A file that is indexed again under a known path keeps its old id; symbols that carry another id for it are an error in
    a store that enforces keys, so here they are moved to the kept id.
    """
    files = upsert_files(graph.files, found.files)
    moved = found.files.select("path", F.col("id").alias("given")).join(graph.files.select("path", F.col("id").alias("kept")), "path").filter("given <> kept").select("given", "kept")
    symbols = found.symbols.join(moved, F.col("file_id") == F.col("given"), "left").withColumn("file_id", F.coalesce("kept", "file_id")).select(found.symbols.columns)
    return Graph(files, insert_new(graph.symbols, symbols), insert_new(graph.relationships, found.relationships))


def update_relationships(relationships: DataFrame, updates: DataFrame) -> DataFrame:
    """Sets target and resolution from ``id, target_id, resolution``; ids that don't occur change nothing."""
    new = updates.select(F.col("id").alias("_id"), F.col("target_id").alias("_target"), F.col("resolution").alias("_resolution"))
    joined = relationships.join(new, F.col("id") == F.col("_id"), "left")
    joined = joined.withColumn("target_id", F.coalesce("_target", "target_id")).withColumn("resolution", F.coalesce("_resolution", "resolution"))
    return joined.select(relationships.columns)


def update_relationship(relationships: DataFrame, rel_id: str, target_id: str, resolution: str) -> DataFrame:
    """The same for one edge."""
    hit = F.col("id") == rel_id
    return relationships.withColumn("target_id", F.when(hit, F.lit(target_id)).otherwise(F.col("target_id"))).withColumn(
        "resolution", F.when(hit, F.lit(resolution)).otherwise(F.col("resolution"))
    )


def delete_files(graph: Graph, ids: DataFrame) -> Graph:
    """Removes files (``id``) and, with them, their symbols; children of removed symbols lose their parent, edges stay."""
    files = graph.files.join(ids.select("id"), "id", "left_anti").select(graph.files.columns)
    gone = graph.symbols.join(ids.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("gone"))
    left = graph.symbols.join(gone, F.col("id") == F.col("gone"), "left_anti")
    orphaned = left.join(gone, F.col("parent_id") == F.col("gone"), "left")
    parent = F.when(F.col("gone").isNull(), F.col("parent_id"))
    return Graph(files, orphaned.withColumn("parent_id", parent).select(graph.symbols.columns), graph.relationships)


class GraphStore:
    """Tables under one folder. Every change writes a new version and then points to it by renaming a file over the old
    pointer, so readers never see half a change. The two versions before the current one stay, for readers that began on them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.initialize()

    def initialize(self) -> None:
        """Creates empty tables and the schema version where there are none."""
        if self._meta() is None:
            self._commit(Graph.empty(self.spark), 0)

    def _meta(self) -> dict | None:
        p, fs = hadoop_path(self.spark, f"{self.path}/meta.json")
        if not fs.exists(p):
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/meta.json").collect()))

    def _commit(self, graph: Graph, version: int) -> None:
        for name in TABLES:
            table = getattr(graph, name)
            if name == "relationships":
                table = table.repartitionByRange("type", "source_id").sortWithinPartitions("type", "source_id")  # min-max statistics prune both
            table.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        p, fs = hadoop_path(self.spark, f"{self.path}/meta.json")
        new, _ = hadoop_path(self.spark, f"{self.path}/_meta-{uuid.uuid4().hex}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"schema_version": SCHEMA_VERSION, "version": version}).encode()))
        out.close()
        swap(self.spark, new, p)
        for old in range(max(0, version - 2)):
            q, _ = hadoop_path(self.spark, f"{self.path}/v{old}")
            fs.delete(q, True)

    def schema_version(self) -> str | None:
        meta = self._meta()
        return meta and meta.get("schema_version")

    def graph(self) -> Graph:
        version = (self._meta() or {}).get("version", 0)
        return Graph(*(self.spark.read.schema(schema).parquet(f"{self.path}/v{version}/{name}") for name, schema in TABLES.items()))

    def replace(self, graph: Graph) -> None:
        self._commit(graph, (self._meta() or {}).get("version", -1) + 1)

    def store(self, found: Graph) -> None:
        """Adds analysis results."""
        symbols = normalise_symbols(found.symbols)
        self.replace(merge_results(self.graph(), Graph(found.files, symbols, found.relationships)))

    def clear(self) -> None:
        """Empties the three tables; the schema version stays."""
        self.replace(Graph.empty(self.spark))

    def update(self, updates: DataFrame) -> None:
        g = self.graph()
        self.replace(Graph(g.files, g.symbols, update_relationships(g.relationships, updates)))

    def close(self) -> None:
        self.spark.catalog.clearCache()


def find_store(start: Path, folder: str = ".loomgraph") -> Path | None:
    """The nearest folder of that name in ``start`` or a folder above it."""
    at = start.resolve()
    for place in (at, *at.parents):
        if (place / folder / "meta.json").exists():
            return place / folder
    return None
