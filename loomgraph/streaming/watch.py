"""Continuous indexing: a stream of changed source files keeps a graph up to date.

The stream carries ``path, module, text`` (any source: a queue, or Parquet files that a watcher drops). Each micro-batch is
analysed like a batch, takes the place of what the graph had of its files, and is resolved against the whole graph. State is
the store itself, so the stream needs no watermark; a batch that is run again gives the same graph, since ids are hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.graph import GraphStore
from loomgraph.operators.ingest import analyze, analyzed_graph, commit_resolved, with_changes
from loomgraph.plans.schema import stable_id
from loomgraph.storage import written


def as_files(changes: DataFrame) -> DataFrame:
    """Rows of files with the ids and hashes that a scan of the tree would give; of several for one path any one is taken."""
    text = F.col("text")
    return changes.filter(text.isNotNull() & F.col("path").isNotNull()).dropDuplicates(["path"]).select(
        stable_id(F.lit("file"), F.col("path")).alias("id"), "path", F.lit("python").alias("language"), F.sha2(text, 256).alias("content_hash"),
        F.octet_length(text).cast("bigint").alias("size_bytes"), "module", "text",
    )


def apply_changes(store: GraphStore, changes: DataFrame) -> None:
    """Analyses the changed files and puts them in the place of their former versions."""
    files, _ = written(as_files(changes), "changes")
    if files.isEmpty():
        return
    analysis, _ = written(analyze(files), "analysis")
    commit_resolved(store, with_changes(store.graph(), analyzed_graph(files, analysis)))


def index_stream(store: GraphStore, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream; ``trigger`` is that of ``writeStream.trigger``, by default everything there is and then an end."""
    stream = changes.writeStream.foreachBatch(lambda batch, _: apply_changes(store, batch)).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()
