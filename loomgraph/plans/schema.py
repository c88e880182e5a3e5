"""Tables of the graph, its enumerated domains, and ids that a rerun gives again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1"

SYMBOL_KINDS = ("FILE", "MODULE", "PACKAGE", "CLASS", "INTERFACE", "FUNCTION", "METHOD", "VARIABLE", "CONSTANT", "FIELD")
RELATIONSHIP_TYPES = ("CONTAINS", "IMPORTS", "CALLS", "REFERENCES", "EXTENDS", "IMPLEMENTS", "OVERRIDES")
LANGUAGES = ("python", "unknown")
RESOLUTIONS = ("resolved", "probable", "unresolved")

FILES = "id string, path string, language string, content_hash string, size_bytes bigint, indexed_at timestamp"
SYMBOLS = (
    "id string, name string, qualified_name string, kind string, language string, file_id string, "
    "start_line int, end_line int, signature string, parent_id string, docstring string, is_async boolean"
)
LOCATION = "struct<file_id:string,line:int,col:int>"
RELATIONSHIPS = (
    f"id string, source_id string, target_id string, type string, source_location {LOCATION}, resolution string, metadata map<string,string>"
)

SYMBOL_COLUMNS = [part.split()[0] for part in SYMBOLS.split(", ")]


def stable_id(*parts: Column) -> Column:
    """A SHA-256 of the parts, so that retries and reruns agree."""
    return F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256)


def location(file_id: Column, line: Column, col: Column) -> Column:
    """Null unless there is a file and a line other than 0; a missing column is 0."""
    known = file_id.isNotNull() & (file_id != "") & F.coalesce(line, F.lit(0)).cast("int").cast("boolean")
    return F.when(known, F.struct(file_id.alias("file_id"), line.cast("int").alias("line"), F.coalesce(col, F.lit(0)).cast("int").alias("col")))


def check_domains(symbols: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same tables, failing at run time on a kind, type or resolution outside its domain."""

    def within(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
        bad = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null"))))
        return df.withColumn(column, F.when(F.col(column).isin(*domain), F.col(column)).otherwise(bad))

    relationships = within(within(relationships, "type", RELATIONSHIP_TYPES), "resolution", RESOLUTIONS)
    return within(symbols, "kind", SYMBOL_KINDS), relationships


def normalise_symbols(df: DataFrame) -> DataFrame:
    """Typed columns in order; a null signature or docstring is empty, a null flag false."""
    empty = {"signature", "docstring"}
    casts = [part.split() for part in SYMBOLS.split(", ")]
    out = []
    for name, kind in casts:
        c = F.col(name).cast(kind)
        if name in empty:
            c = F.coalesce(c, F.lit(""))
        if name == "is_async":
            c = F.coalesce(c, F.lit(False))
        out.append(c.alias(name))
    return df.select(out)
