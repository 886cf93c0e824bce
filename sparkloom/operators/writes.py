"""Sinks: deterministic ids, first-wins inserts, replaced partitions, published runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.schema import SYMBOL_KINDS, check_edges, require_none


def with_ids(rows: DataFrame, id_col: str, *key: str) -> DataFrame:
    """Ids from a hash of the key: the same on every run and without a global order; equal keys are rejected."""
    require_none(rows.groupBy(*key).count().where("count > 1"), "two rows of one key")
    return rows.withColumn(id_col, F.xxhash64(*key).bitwiseAND(F.lit((1 << 62) - 1)))


def insert_symbols(batch: DataFrame, ordinal: str, after: int = 0) -> DataFrame:
    """The batch with symbol_id: `after` and then 1, 2, ... in the order of its input (ordinal). Unknown kinds, missing names and a repeated ordinal are rejected."""
    require_none(batch.where(~F.col("kind").isin(*SYMBOL_KINDS) | F.col("kind").isNull() | F.col("name").isNull()), "a symbol without a name or of an unknown kind")
    require_none(batch.groupBy(ordinal).count().where("count > 1"), "two rows of one place")
    return ranked(batch, F.col(ordinal).asc(), name="symbol_id", kind="long").withColumn("symbol_id", F.col("symbol_id") + F.lit(after))


def insert_chunks(drafts: DataFrame, symbols: DataFrame, embedder=None) -> DataFrame:
    """Chunks of drafts (path, local_key, text) whose symbol is known (path, local_key, symbol_id), with an id of their own; others are skipped.

    With an embedder each chunk gets its vector.
    """
    from sparkloom.operators.evidence import embed

    known = symbols.select("path", "local_key", "symbol_id")
    out = drafts.join(known, ["path", "local_key"]).withColumn("chunk_id", F.xxhash64("symbol_id", "text").bitwiseAND(F.lit((1 << 62) - 1)))
    return out if embedder is None else embed(out, embedder)


def replace_git_stats(stats: DataFrame, path: str) -> None:
    """The statistics of the repositories that `stats` has, in place of those stored; counts that don't go together are rejected."""
    from sparkloom.operators.churn import broken_stats

    require_none(stats.where(F.col("repository_id").isNull() | F.col("path").isNull()), "statistics without a repository or a path")
    require_none(broken_stats(stats), "statistics that don't go together")
    require_none(stats.groupBy("repository_id", "path").count().where("count > 1"), "a path occurs twice")
    replace_partition(stats, path, "repository_id")


def append_feedback(rows: DataFrame, repositories: DataFrame, path: str) -> None:
    """Feedback on known repositories: repository_id, analysis_key, action, created_at."""
    require_none(rows.where(~F.col("action").isin(*FEEDBACK) | F.col("action").isNull() | F.col("analysis_key").isNull()), "feedback without a key or of an unknown kind")
    require_none(rows.join(repositories.select(F.col("id").alias("repository_id")), "repository_id", "left_anti"), "feedback on an unknown repository")
    append(rows.select("repository_id", "analysis_key", "action", "created_at"), path)


def append_analyses(rows: DataFrame, path: str) -> None:
    """Analyses with their report: a level and a score together or neither, a score in [0, 1]."""
    require_none(rows.where(F.col("report").isNull() | (F.col("risk_level").isNull() != F.col("risk_score").isNull()) | ~F.coalesce(F.col("risk_score").between(0.0, 1.0), F.lit(True))), "an analysis whose parts don't go together")
    append(rows.select("id", "repository_id", "pr_url", "risk_level", "risk_score", "report", "created_at"), path)


# What feedback says.
FEEDBACK = ("accepted", "dismissed", "not_useful")


def first_wins(batch: DataFrame, ordinal: str, *key: str) -> DataFrame:
    """The row of the least ordinal of each key, merged map-side."""
    rest = [c for c in batch.columns if c not in key]
    return batch.groupBy(*key).agg(F.min_by(F.struct(*rest), ordinal).alias("r")).select(*key, "r.*")


def new_edges(batch: DataFrame, stored: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Edges of a batch to insert: first of each (src, dst, kind), without those stored already."""
    return first_wins(batch, ordinal, "src", "dst", "kind").join(stored.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")


def replace_partition(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that `rows` has (delete and insert at once)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def persist_graph(files: DataFrame, symbols: DataFrame, edges: DataFrame, path: str) -> None:
    """A fresh snapshot folder; refuses one that exists, dangling ends and duplicates."""
    check_edges(edges)
    ids = symbols.select(F.col("symbol_id").alias("src"))
    require_none(edges.join(ids, "src", "left_anti"), "an edge's source is missing")
    require_none(edges.join(ids.withColumnRenamed("src", "dst"), "dst", "left_anti"), "an edge's target is missing")
    for name, df in (("files", files), ("symbols", symbols), ("edges", edges)):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def canonical(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges under labels that don't depend on ids, for comparison of graphs."""
    label = F.concat_ws("::", "path", F.coalesce("qualname", "name"), "kind")
    nodes = symbols.join(files.select("file_id", "path"), "file_id").withColumn("label", label)
    ends = nodes.select("symbol_id", "label")
    e = edges.join(ends.withColumnsRenamed({"symbol_id": "src", "label": "source"}), "src").join(ends.withColumnsRenamed({"symbol_id": "dst", "label": "target"}), "dst")
    return nodes.select("label", "start_line", "end_line"), e.select("source", "target", "kind", "confidence")


def digest(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row: a digest of the rows as a set with repeats, whatever their order.

    Each row is hashed where it lies; the digests' eight parts of 32 bits are summed map-side and the sums hashed with
    the number of rows. `order` is kept for callers that name one and doesn't matter.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    part = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = rows.select(row.alias("_h")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(8)])
    return sums.select(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in sums.columns]), 256).alias("digest"))


def delete_repository(files: DataFrame, symbols: DataFrame, edges: DataFrame, repository_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, symbols, edges) without a repository: its files, their symbols, and every edge that touches one of those."""
    gone = files.where(F.col("repository_id") == repository_id).select("file_id")
    lost = symbols.join(gone, "file_id", "left_semi").select("symbol_id")
    kept = edges.join(lost.withColumnRenamed("symbol_id", "src"), "src", "left_anti").join(lost.withColumnRenamed("symbol_id", "dst"), "dst", "left_anti").select(*edges.columns)
    return files.where(~F.col("repository_id").eqNullSafe(repository_id)), symbols.join(gone, "file_id", "left_anti"), kept


def write_evaluation(report: DataFrame, rows: DataFrame, path: str) -> None:
    """A report (one row) as JSON and its rows as CSV with a header, in a fresh folder: what exists isn't overwritten."""
    report.coalesce(1).write.mode("errorifexists").json(f"{path}/impact-results.json")
    rows.select(*EVALUATED).write.mode("errorifexists").option("header", True).csv(f"{path}/impact-results.csv")


# Columns of the written rows, in order.
EVALUATED = ("case_id", "category", "prediction_status", "label_status", "tp", "fp", "fn", "precision", "recall", "f1")


def ranked(rows: DataFrame, *order, name: str = "rank", kind: str = "int") -> DataFrame:
    """Rows numbered from 1 in a total order, without a task that holds all: ranges of the order are numbered each, behind the count of those before."""
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_n", nth).join(F.broadcast(bases), "_part").withColumn(name, (F.col("_base") + F.col("_n")).cast(kind)).drop("_part", "_n", "_base")


def publish(items: DataFrame, runs: DataFrame, repository_id: int, snapshot_id: int) -> tuple[DataFrame, DataFrame]:
    """(run, ranked items) to append; both empty if this digest was published already. Ranks from 1."""
    mark = digest(items).withColumns({"repository_id": F.lit(repository_id).cast("long"), "snapshot_id": F.lit(snapshot_id).cast("long")})
    run = mark.join(runs.select("repository_id", "snapshot_id", "digest"), ["repository_id", "snapshot_id", "digest"], "left_anti")
    run = run.withColumn("run_id", F.xxhash64("repository_id", "snapshot_id", "digest"))
    nth = ranked(items, F.desc_nulls_last("score"), F.col("symbol_id").asc(), F.col("category").asc())
    return run, nth.crossJoin(F.broadcast(run.select("run_id")))
