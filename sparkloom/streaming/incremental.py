"""Incremental maintenance and churn over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators.graph import closure, dirty_paths


def update(old: DataFrame, new: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, affected): changed paths, and all paths to resolve again. dependencies: path, needs (old and new together)."""
    changes = dirty_paths(old, new).persist()
    return changes, closure(dependencies, changes.select("path"))


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Least difference of two edge sets: src, dst, kind, change, confidence."""
    key = ["src", "dst", "kind"]
    both = old.select(*key, F.col("confidence").alias("a"), F.lit(1).alias("x")).join(new.select(*key, F.col("confidence").alias("b"), F.lit(1).alias("y")), key, "full_outer")
    change = F.when(F.col("x").isNull(), "INSERT").when(F.col("y").isNull(), "DELETE").when(~F.col("a").eqNullSafe(F.col("b")), "UPDATE")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*key, "change", F.col("b").alias("confidence"))


def windowed_churn(events: DataFrame, days: int = 90, slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Commits, distinct authors (approximate: state stays bounded) and bug fixes of each path in sliding windows. events: path, ts, author, bugfix."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", slide), "path").agg(F.count("*").alias("commit_count"), F.approx_count_distinct("author").alias("authors"), F.count_if("bugfix").alias("bugfix_commits"))


#: Deltas after which they and the base are put together.
COMPACT = 20


def inventory_stream(spark: SparkSession, folder: str, state: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """Follow Parquet inventories (path, hash, seen long) that land in a folder; `state` holds the latest hash of each path.

    A micro-batch writes its own paths only, as a delta; readers merge the deltas behind the last base. Every `compact`
    deltas a new base is written and what it replaces is removed, but for the base before. A batch that is run
    again writes the same delta.
    """
    rows = spark.readStream.schema(INVENTORY).parquet(folder)

    def merge(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        _newest(batch).write.mode("overwrite").parquet(f"{state}/delta={n}")
        base, deltas = _parts(own, state)
        if len(deltas) >= compact:
            latest_state(own, state).write.mode("overwrite").parquet(f"{state}/base={n}")
            _drop(own, state, [f"delta={d}" for d in deltas if d <= n] + [f"base={b}" for b in _complete(own, state, "base") if base is not None and b < base])

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


INVENTORY = "path string, hash string, seen long"


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.max_by("hash", "seen").alias("hash"), F.max("seen").alias("seen"))


def latest_state(spark: SparkSession, state: str) -> DataFrame | None:
    """The latest hash of each path: the last complete base and the complete deltas behind it."""
    base, deltas = _parts(spark, state)
    folders = [f"{state}/delta={d}" for d in deltas] + ([f"{state}/base={base}"] if base is not None else [])
    return _newest(spark.read.schema(INVENTORY).parquet(*folders)) if folders else None


def _parts(spark: SparkSession, state: str) -> tuple[int | None, list[int]]:
    base = max(_complete(spark, state, "base"), default=None)
    return base, [d for d in _complete(spark, state, "delta") if base is None or d > base]


def _complete(spark: SparkSession, state: str, kind: str) -> list[int]:
    """Numbers of complete folders of a kind, listed through Hadoop's file system so that any store works."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(state)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{kind}=")]
    return sorted(int(n.getName().partition("=")[2]) for n in names if fs.exists(path(n, "_SUCCESS")))


def _drop(spark: SparkSession, state: str, names: list[str]) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for n in names:
        p = path(f"{state}/{n}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
