"""A data source of source trees: ``spark.read.format("source_tree").load(folder)``.

The built-in file sources pass over names that begin with ``_`` or ``.``, so ``__init__.py`` would be lost. The driver only
lists names, folder by folder, and keeps them packed; files are read, hashed and decoded by the tasks. A file that isn't UTF-8
or can't be read gives no row. The folder has to be one that every executor sees.
"""

from __future__ import annotations

import hashlib
import io
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.plans.schema import stable_id

SUFFIXES = {".py": "python", ".pyi": "python"}
SKIPPED_FILES = {".DS_Store", "Thumbs.db"}
SKIPPED_FOLDERS = {
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "node_modules",
    ".venv", "venv", "env", ".env", "dist", "build", ".loomgraph", ".eggs",
}
SCHEMA = "ordinal bigint, path string, language string, content_hash string, size_bytes bigint, module string, text string"
#: Files for each task; a tree that would take more than MANY_TASKS of these gives each more, up to MOST_A_TASK.
FILES_A_TASK, MANY_TASKS, MOST_A_TASK = 200, 1_000, 4_000
#: Rows and bytes of text (about) that a task hands on at once.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def language_of(name: str) -> str:
    return SUFFIXES.get(os.path.splitext(name)[1].lower(), "unknown")


def skips_folder(name: str) -> bool:
    return name in SKIPPED_FOLDERS or name.endswith(".egg-info")


def walk_tree(root: str, languages: tuple[str, ...] = ("python",)) -> Iterator[tuple[str, list[str]]]:
    """Folders and their files in order: those of a folder by name, then its folders by name."""
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(f for f in folders if not skips_folder(f))
        yield folder, sorted(f for f in files if f not in SKIPPED_FILES and language_of(f) in languages)


def list_tree(root: str, languages: tuple[str, ...] = ("python",)) -> list[str]:
    return [os.path.join(folder, f) for folder, files in walk_tree(root, languages) for f in files]


def packages(folder: Path, known: dict[Path, list[str]]) -> list[str]:
    """Names of the packages that a module in the folder lies in, the outermost first; ``known`` remembers folders."""
    if folder not in known:
        inside = folder != folder.parent and (folder / "__init__.py").exists()
        known[folder] = [*packages(folder.parent, known), folder.name] if inside else []
    return known[folder]


def module_name(path: str, known: dict[Path, list[str]] | None = None) -> str:
    """Dotted name of a module: its stem, after the names of the packages that it lies in."""
    p = Path(path)
    return ".".join([*packages(p.parent, {} if known is None else known), p.stem if p.suffix == ".py" else p.name])


def read_file(path: str) -> tuple[bytes, str] | None:
    """Bytes, and text with all line ends made \\n; None unless it is readable UTF-8."""
    try:
        raw = Path(path).read_bytes()
        return raw, io.TextIOWrapper(io.BytesIO(raw), "utf-8").read()
    except (OSError, UnicodeDecodeError):
        return None


class _Files(InputPartition):
    """Files from the number ``first`` on, as folders with their packed names."""

    def __init__(self, first: int, parts: list[tuple[str, bytes]]):
        super().__init__(first)
        self.first, self.parts = first, parts

    def paths(self) -> Iterator[str]:
        for folder, names in self.parts:
            for name in zlib.decompress(names).split(b"\0"):
                yield os.path.join(folder, os.fsdecode(name))


class _Reader(DataSourceReader):
    def __init__(self, root: str, languages: tuple[str, ...], size: int | None):
        self.root, self.languages, self.size = root, languages, size

    def partitions(self) -> list[InputPartition]:
        root = os.path.abspath(self.root)
        if os.path.isfile(root):
            found = [(os.path.dirname(root), [os.path.basename(root)] if language_of(root) in self.languages else [])]
        else:
            found = walk_tree(root, self.languages)
        step, total, parts = min(self.size or FILES_A_TASK, FILES_A_TASK), 0, []
        for folder, names in found:  # a part has up to ``step`` files of one folder
            for i in range(0, len(names), step):
                some = names[i : i + step]
                parts.append((total, len(some), (folder, zlib.compress(b"\0".join(map(os.fsencode, some)), 1))))
                total += len(some)
        size = self.size or min(max(FILES_A_TASK, -(-total // MANY_TASKS)), MOST_A_TASK)
        out, room = [], 0
        for first, n, part in parts:
            if n > room:
                out.append(_Files(first, []))
                room = size
            out[-1].parts.append(part)
            room -= n
        return out or [_Files(0, [])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows, size, known = [], 0, {}
        for k, path in enumerate(partition.paths(), partition.first):
            got = read_file(path)
            if got is None:
                continue
            raw, text = got
            rows.append((k, path, language_of(path), hashlib.sha256(raw).hexdigest(), len(raw), module_name(path, known), text))
            size += len(raw)
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [c.split() for c in SCHEMA.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(values, kinds[kind]) for (_, kind), values in zip(columns, zip(*rows))], [name for name, _ in columns])


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        languages = tuple(x.strip() for x in self.options.get("languages", "python").split(","))
        size = self.options.get("files_a_task")
        return _Reader(self.options["path"], languages, int(size) if size else None)


def source_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files of a tree (or one file, whatever folder it lies in) with their texts and ids."""
    spark.dataSource.register(SourceTree)
    files = spark.read.format("source_tree").options(**options).load(os.path.abspath(root))
    return files.withColumn("id", stable_id(F.lit("file"), F.col("path")))
