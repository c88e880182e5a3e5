"""From source files to the graph: analysis in parallel, storing, and resolution across files."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomgraph.operators.graph import Graph, GraphStore, delete_files, merge_results, update_relationships
from loomgraph.operators.resolve import resolve, suffix_keys
from loomgraph.plans.schema import RELATIONSHIPS, SYMBOLS, normalise_symbols
from loomgraph.sources.python_parser import Parsed, parse
from loomgraph.sources.tree import FILES_A_TASK, source_files
from loomgraph.storage import written

_STRUCT = lambda columns: "struct<" + ", ".join(":".join(c.split(" ", 1)) for c in columns) + ">"
_SYMBOL = _STRUCT(SYMBOLS.split(", "))
_RELATIONSHIP = (
    "struct<id:string,source_id:string,target_id:string,type:string,source_location:struct<file_id:string,line:int,col:int>,"
    "resolution:string,metadata:map<string,string>>"
)
#: Files whose rows a task holds at once.
FILES_AT_ONCE = 200
ANALYSIS = f"path string, symbols array<{_SYMBOL}>, relationships array<{_RELATIONSHIP}>, error string"


class LanguageAnalyzer(ABC):
    """Turns one text into rows, without any input or output of its own."""

    languages: tuple[str, ...] = ()

    @abstractmethod
    def analyze(self, file_id: str, path: str, module: str, text: str) -> Parsed: ...


class PythonAnalyzer(LanguageAnalyzer):
    languages = ("python",)

    def analyze(self, file_id: str, path: str, module: str, text: str) -> Parsed:
        return parse(file_id, path, module, text)


def analyze(files: DataFrame, analyzers: tuple[LanguageAnalyzer, ...] = (PythonAnalyzer(),)) -> DataFrame:
    """``path, symbols, relationships, error`` for each file whose language has an analyzer; what one raises is its file's error.

    A task analyses a partition of ``files`` as it is, so the caller sees to it that these hold few enough files."""
    by_language = {lang: a for a in analyzers for lang in a.languages}

    schema = to_arrow_schema(StructType.fromDDL(ANALYSIS))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                out = []
                for f in batch.slice(at, FILES_AT_ONCE).to_pylist():
                    try:
                        p = by_language[f["language"]].analyze(f["id"], f["path"], f["module"], f["text"])
                    except Exception as e:  # one file must not end the run; it is reported
                        p = Parsed(error=f"{f['path']}: {e}")
                    edges = [{**r, "metadata": None if r.get("metadata") is None else list(r["metadata"].items())} for r in p.relationships]
                    out.append((f["path"], p.symbols, edges, p.error))
                yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*out), schema.types)], schema=schema)

    known = files.filter(F.col("language").isin(*by_language))
    return known.select("id", "path", "language", "module", "text").mapInArrow(rows, ANALYSIS)


def analyzed_graph(files: DataFrame, analysis: DataFrame) -> Graph:
    """The three tables of written analysis results."""
    table = files.select("id", "path", "language", "content_hash", "size_bytes", F.current_timestamp().alias("indexed_at"))
    symbols = normalise_symbols(analysis.select(F.inline("symbols")))
    return Graph(table, symbols, analysis.select(F.inline("relationships")))


@dataclass(frozen=True)
class IndexStats:
    files_discovered: int = 0
    files_analyzed: int = 0
    symbols_extracted: int = 0
    relationships_extracted: int = 0
    relationships_resolved: int = 0
    errors: list[str] = field(default_factory=list)


def _names(symbols: DataFrame) -> DataFrame:
    """All names under which edges may ask for the symbols."""
    return suffix_keys(symbols).select("key").unionByName(symbols.select(F.col("qualified_name").alias("key"))).distinct()


def with_changes(before: Graph, found: Graph, removed: DataFrame | None = None) -> Graph:
    """The graph with files of ``found`` in the place of what it had under their paths, and without the files ``removed`` (``id``).

    Edges that name their target are asked for again where a symbol of that name has come, gone or changed, so the result is
    that of indexing everything anew. Ids hold no line numbers; other edges into symbols that stay remain as they are.
    """
    stale = before.files.join(found.files.select("path"), "path", "left_semi").select("id")
    stale = stale if removed is None else stale.unionByName(removed.select("id")).distinct()
    old = before.symbols.join(stale.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(before.symbols.columns)
    kept = delete_files(before, stale)
    edges = kept.relationships.join(old.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(before.relationships.columns)
    merged = merge_results(Graph(kept.files, kept.symbols, edges), found)
    touched = _names(old.unionByName(found.symbols.select(old.columns))).withColumnRenamed("key", "_touched")
    lost = old.select(F.col("id").alias("_lost")).join(merged.symbols.select("id"), F.col("_lost") == F.col("id"), "left_anti")
    edges = merged.relationships.join(touched, F.col("metadata")["target_name"] == F.col("_touched"), "left").join(lost, F.col("target_id") == F.col("_lost"), "left")
    again = F.col("_touched").isNotNull() | F.col("_lost").isNotNull()
    edges = edges.withColumn("target_id", F.when(again, F.lit("")).otherwise(F.col("target_id"))).withColumn("resolution", F.when(again, F.lit("unresolved")).otherwise(F.col("resolution")))
    return Graph(merged.files, merged.symbols, edges.select(before.relationships.columns))


def commit_resolved(store: GraphStore, graph: Graph) -> int:
    """Resolves what can be, stores the graph in one change, and says how many edges found a target."""
    updates, _ = written(resolve(graph), "resolved")
    store.replace(Graph(graph.files, graph.symbols, update_relationships(graph.relationships, updates)))
    return updates.count()


def index(store: GraphStore, root: str, clear: bool = True, progress: Callable[[str, int, int], None] | None = None, incremental: bool = False) -> IndexStats:
    """Indexes a tree into ``store``, in one change of it.

    ``progress(path, number, total)`` is called for each file when its results are there. ``incremental`` analyses only
    files whose path or content hash is new, puts them in the place of what the graph had of them, drops files of the tree
    that are no longer there, and ends with the graph that a full index gives; it implies ``clear=False``.
    """
    spark: SparkSession = store.spark
    files, _ = written(source_files(spark, root), "files")
    discovered = files.count()
    before = store.graph() if incremental or not clear else Graph.empty(spark)
    removed = None
    if incremental:
        under = F.col("path").startswith(os.path.abspath(root).rstrip("/") + "/")
        removed = before.files.filter(under).join(files.select("path"), "path", "left_anti").select("id")
        files, _ = written(files.join(before.files.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select(files.columns), "changed")
    analysis, _ = written(analyze(files.repartition(-(-discovered // FILES_A_TASK) or 1, "id")), "analysis")  # as read, one part may hold all files
    totals = analysis.agg(
        F.count_if(F.col("error").isNull()).alias("ok"), F.sum(F.size("symbols")).alias("symbols"), F.sum(F.size("relationships")).alias("relationships")
    ).first()
    if progress:
        for k, r in enumerate(analysis.select("path").toLocalIterator(), 1):
            progress(r.path, k, discovered)
    found = analyzed_graph(files, analysis)
    resolved = commit_resolved(store, with_changes(before, found, removed) if incremental else merge_results(before, found))
    errors = [r.error for r in analysis.filter("error IS NOT NULL").select("error").orderBy("error").collect()]
    return IndexStats(discovered, totals.ok or 0, totals.symbols or 0, totals.relationships or 0, resolved, errors)


@dataclass(frozen=True)
class SourceRange:
    file_path: str
    start_line: int
    end_line: int
    lines: list[str]


def get_source(graph: Graph, symbol_id: str) -> SourceRange | None:
    """The lines of a symbol, read from its file again; None if the symbol or the file is missing."""
    from pathlib import Path

    row = graph.symbols.filter(F.col("id") == symbol_id).join(graph.files.select(F.col("id").alias("f"), "path"), F.col("file_id") == F.col("f")).first()
    if row is None:
        return None
    try:
        lines = Path(row.path).read_text("utf-8", errors="replace").splitlines()
    except OSError:
        return None
    return SourceRange(row.path, row.start_line, row.end_line, lines[max(0, row.start_line - 1) : min(len(lines), row.end_line)])


def source_slices(symbols: DataFrame, texts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, file_path, start_line, end_line, lines`` for all symbols at once, from ``id, path, text`` of files; and what else
    of the symbols is to be kept."""
    lines = F.split(F.regexp_replace("text", r"\n$", ""), "\n", -1)
    t = texts.select(F.col("id").alias("file"), F.col("path").alias("file_path"), lines.alias("_lines"))
    joined = symbols.join(t.hint("merge"), F.col("file_id") == F.col("file"))  # the planner's guess of texts' size may be far too low
    start = F.greatest(F.lit(1), F.col("start_line"))
    count = F.greatest(F.lit(0), F.col("end_line") - start + 1)
    return joined.select("id", "file_path", "start_line", "end_line", F.slice("_lines", start, count).alias("lines"), *keep)
