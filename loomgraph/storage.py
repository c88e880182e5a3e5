"""Written tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes on disk is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only where that is unset in local mode, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or getattr(context, "_loomgraph_folder", None)
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = context._loomgraph_folder = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return named.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def swap(spark: SparkSession, new, old) -> None:
    """Renames a file over another one in one step."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, old, how)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder and read from there, which cuts its lineage; and its bytes on disk."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = hadoop_path(spark, path)
    return spark.read.schema(df.schema).parquet(path), fs.getContentSummary(p).getLength()


def sized(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast of a side whose measured size allows it."""
    return F.broadcast(df) if size <= limit else df
