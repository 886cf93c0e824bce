"""Files of a checkout as a Spark data source, a guarded clone, and strict JSON."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.functions.text import SUPPORTED, content_hash, extension, language, redact_bytes

MAX_BYTES = 10 * 1024 * 1024


def listed(root: str) -> list[str]:
    """Relative paths of supported files, sorted: no dot folders, no links, none over the size limit."""
    out = []
    for top, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and not os.path.islink(os.path.join(top, d))]
        for n in names:
            p = os.path.join(top, n)
            if not os.path.islink(p) and os.path.splitext(n)[1].lower() in SUPPORTED and os.path.getsize(p) <= MAX_BYTES:
                out.append(os.path.relpath(p, root).replace(os.sep, "/"))
    return sorted(out)


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, size: int):
        self.root, self.size = root, size

    def partitions(self):
        paths = listed(self.root)
        return [_Paths(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for p in partition.paths:
            try:
                yield p, (Path(self.root) / p).read_bytes()
            except OSError:
                continue  # unreadable files are skipped


class RepositoryFiles(DataSource):
    """format("repository_files").load(root): path, content. The folder must be reachable from every executor.

    Unlike binaryFile it keeps names that start with an underscore and files without bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("filesPerPartition", 500)))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, extension, language, content (redacted), hash, size; ordered by path within partitions."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    spark.dataSource.register(RepositoryFiles)
    raw = spark.read.format("repository_files").load(root)
    p, c = F.col("path"), F.col("content")
    return raw.select("path", extension(p).alias("extension"), language(p).alias("language"), redact_bytes(c).alias("content"), content_hash(c).alias("hash"), F.octet_length(c).alias("size"))


def clone(url: str, target: str, workspace: str, timeout: int = 300) -> str:
    """Shallow clone without hooks into a new folder strictly inside the workspace; a failure removes only that folder."""
    root, dest = Path(workspace).resolve(), Path(target).resolve()
    if root == dest or root not in dest.parents or dest.exists():
        raise ValueError("the destination must be new and inside the workspace")
    try:
        subprocess.run(["git", "-c", "core.hooksPath=/dev/null", "clone", "--depth", "1", "--no-tags", "--", url, str(dest)], check=True, capture_output=True, timeout=timeout, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    except (subprocess.SubprocessError, OSError):
        shutil.rmtree(dest, ignore_errors=True)
        raise
    return str(dest)


def clone_and_scan(spark: SparkSession, url: str, target: str, workspace: str) -> DataFrame:
    """A failed scan keeps the clone; its path is in the error."""
    where = clone(url, target, workspace)
    try:
        return scan(spark, where)
    except Exception as e:
        raise RuntimeError(f"scan of {where} failed") from e


def strict_json(text: str):
    """JSON without repeated keys, NaN or infinities."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ValueError("a key occurs twice")
        return dict(items)

    def constant(x):
        raise ValueError(f"{x} is no JSON number")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, symbols, edges) of a graph document."""
    doc = spark.read.option("multiLine", True).json(path)
    return tuple(doc.select(F.explode(c).alias("x")).select("x.*") for c in ("files", "symbols", "edges"))


def import_golden(spark: SparkSession, path: str, into: str) -> None:
    """A graph document into tables (files, symbols, edges) partitioned by repository: what its repositories had before is replaced, so importing twice changes nothing.

    Symbols and edges are those of the repository of their file, and of their source symbol.
    """
    from sparkloom.operators.writes import replace_partition

    files, symbols, edges = golden(spark, path)
    owner = files.select(F.col("id").alias("file_id"), "repository_id")
    symbols = symbols.join(owner, "file_id")
    edges = edges.join(symbols.select(F.col("id").alias("source_symbol_id"), "repository_id"), "source_symbol_id")
    for name, rows in (("files", files), ("symbols", symbols), ("edges", edges)):
        replace_partition(rows, f"{into}/{name}", "repository_id")


def export_golden(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, json: the graph document in order of ids."""
    parts = [df.agg(F.array_sort(F.collect_list(F.struct(*sorted(df.columns, key=lambda c: (c != "id", c))))).alias(n)) for n, df in (("files", files), ("symbols", symbols), ("edges", edges))]
    out = parts[0].crossJoin(parts[1]).crossJoin(parts[2])
    return out.select(F.to_json(F.struct("files", "symbols", "edges")).alias("json"))
