"""Scoping: symbols of a repository, edges with both ends in it, plain lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.schema import ContractError, positive, require_none, valid_confidence

#: Symbols and edges that a graph may have before it is refused.
MAX_NODES, MAX_EDGES = 100_000, 500_000


class BudgetExceeded(RuntimeError):
    """More than a cap allows: it fails rather than return a part."""


def within(rows: DataFrame, cap: int | None, what: str) -> DataFrame:
    """The rows, or an error if there are more than the cap; one more than the cap is read at most, without a cap none."""
    if cap is not None and rows.limit(cap + 1).count() > cap:
        raise BudgetExceeded(f"over {cap} {what}")
    return rows


def repo_symbols(symbols: DataFrame, files: DataFrame, repository_id: int) -> DataFrame:
    """Symbols with their path; files are the narrow side and filtered before the join."""
    own = files.where(F.col("repository_id") == repository_id).select("file_id", "path")
    return symbols.join(own, "file_id")


def scoped_edges(edges: DataFrame, scoped: DataFrame, kinds=None) -> DataFrame:
    """Edges with both ends among scoped symbols; foreign ends never leak."""
    ids = scoped.select("symbol_id")
    own = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    own = own.join(ids.withColumnRenamed("symbol_id", "src"), "src", "left_semi")
    return own.join(ids.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi").select(*edges.columns)


def repo_graph(symbols: DataFrame, files: DataFrame, edges: DataFrame, repository_id: int, max_nodes: int | None = MAX_NODES, max_edges: int | None = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of a repository; a graph over either cap is refused, not cut. A cap of None: a graph of any size."""
    for cap, name, most in ((max_nodes, "max_nodes", 1_000_000), (max_edges, "max_edges", 2_000_000)):
        if cap is not None:
            positive(cap, name, most)
    own = within(repo_symbols(symbols, files, repository_id), max_nodes, "symbols")
    return own, within(scoped_edges(edges, own), max_edges, "edges")


def snapshot_graph(snapshots: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, repository_id: int, snapshot_id: int, models: DataFrame | None = None, max_nodes: int | None = MAX_NODES, max_edges: int | None = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of one ready snapshot of a repository: both ends of an edge lie in that snapshot.

    snapshots: id, repository_id, status. models: symbol_id of verified models; symbols get is_database_model, and a
    model that isn't in the snapshot is an error, as is a snapshot that doesn't exist or isn't ready. Caps: see repo_graph().
    """
    positive(repository_id, "repository_id"), positive(snapshot_id, "snapshot_id")
    mine = snapshots.where((F.col("id") == snapshot_id) & (F.col("repository_id") == repository_id) & (F.col("status") == "ready"))
    if mine.isEmpty():
        raise ContractError(f"snapshot {snapshot_id} of repository {repository_id} doesn't exist or isn't ready")
    own, links = repo_graph(symbols, files.where(F.col("snapshot_id") == snapshot_id), edges, repository_id, max_nodes, max_edges)
    if models is None:
        return own.withColumn("is_database_model", F.lit(False)), links
    known = models.select("symbol_id").distinct()
    require_none(known.join(own, "symbol_id", "left_anti"), "a model lies outside of the snapshot")
    return own.join(known.withColumn("is_database_model", F.lit(True)), "symbol_id", "left").withColumn("is_database_model", F.coalesce("is_database_model", F.lit(False))), links


def skipped_confidences(scoped: DataFrame) -> DataFrame:
    """One row, skipped: edges of unknown or invalid confidence."""
    return scoped.agg(F.count_if(~valid_confidence()).alias("skipped"))


def symbol_filter(symbols: DataFrame, files: DataFrame, repository_id=None, file_id=None, kind=None, name=None) -> DataFrame:
    """Conjunction of the given conditions only, ordered by id."""
    out = symbols if repository_id is None else repo_symbols(symbols, files, repository_id).drop("path")
    for col, value in (("file_id", file_id), ("kind", kind), ("name", name)):
        if value is not None:
            out = out.where(F.col(col) == value)
    return out.orderBy("symbol_id")


def substring_search(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Case-insensitive part of name, qualname or path, in order of id. % and _ of the query stand for themselves."""
    hit, part = F.lit(False), re.sub(r"([\\%_])", r"\\\1", query)
    for c in ("name", "qualname", "path"):
        hit |= F.coalesce(F.col(c).ilike(f"%{part}%"), F.lit(False))
    out = symbols.where(hit)
    return (out if kind is None else out.where(F.col("kind") == kind)).orderBy("symbol_id").limit(limit)


def exact_search(chunks: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Name or qualname equals the query; qualname matches first, then chunk id."""
    hits = chunks.where((F.col("name") == query) | (F.col("qualname") == query))
    return hits.orderBy(F.when(F.col("qualname") == query, 0).otherwise(1), "chunk_id").limit(limit)


def neighbours(edges: DataFrame, symbols: DataFrame, symbol_id: int, direction: str = "both", kinds=None) -> DataFrame:
    """One hop: out, in, or both (out then in, duplicates kept)."""
    own = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out = own.where(F.col("src") == symbol_id).select(F.lit("out").alias("direction"), "edge_id", "kind", F.col("dst").alias("symbol_id"))
    back = own.where(F.col("dst") == symbol_id).select(F.lit("in").alias("direction"), "edge_id", "kind", F.col("src").alias("symbol_id"))
    found = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return found.join(symbols.select("symbol_id", "name", F.col("kind").alias("symbol_kind")), "symbol_id")


def line_ranges(lines: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """Maximal runs of line numbers (gaps and islands)."""
    own = lines.select(*by, line).distinct()
    island = F.col(line) - F.row_number().over(Window.partitionBy(*by).orderBy(line))
    return own.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(line).alias("first_line"), F.max(line).alias("last_line")).drop("_i")


def counts(edges: DataFrame) -> DataFrame:
    """One row: edges, and those skipped for an unknown or invalid confidence."""
    return edges.agg(F.count("*").alias("edges"), F.count_if(~valid_confidence()).alias("skipped"))


def status_histogram(edges: DataFrame) -> DataFrame:
    """kind, exact, inferred, other, unresolved: edges of each kind by what their confidence says of how they were resolved."""
    c = F.col("confidence")
    named = F.when(c == 1, "exact").when(c == 0.5, "inferred").when(valid_confidence(), "other").otherwise("unresolved")
    return edges.groupBy("kind").agg(*[F.count_if(named == n).alias(n) for n in ("exact", "inferred", "other", "unresolved")])


def changed_reach(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, tested, exposures of changed symbols (symbol_id): whether a test is linked, and how many endpoints expose them."""
    tested = edges.where("kind = 'TESTED_BY'").select(F.col("src").alias("symbol_id"), F.lit(True).alias("tested")).distinct()
    exposed = edges.where("kind = 'EXPOSES'").groupBy(F.col("dst").alias("symbol_id")).agg(F.count("*").alias("exposures"))
    out = changed.select("symbol_id").join(tested, "symbol_id", "left").join(exposed, "symbol_id", "left")
    return out.select("symbol_id", F.coalesce("tested", F.lit(False)).alias("tested"), F.coalesce("exposures", F.lit(0)).alias("exposures"))


def repository_rows(repositories: DataFrame, snapshots: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """What the service says of each repository: id, name, url, status and snapshot of its newest snapshot (null if none), its files and symbols."""
    newest = latest_by(snapshots.select("repository_id", F.col("id").alias("snapshot_id"), "status"), ["repository_id"], "snapshot_id")
    per = files.join(symbols.groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left").groupBy("repository_id").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbol_count"))
    named = repositories.select(F.col("id").alias("repository_id"), F.col("full_name").alias("name"), F.col("remote_url").alias("url"))
    out = named.join(newest, "repository_id", "left").join(per, "repository_id", "left")
    return out.select(F.col("repository_id").alias("id"), "name", "url", "status", "snapshot_id", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"))


def latest_by(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of the greatest `order` for each key: one shuffle, merged map-side."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def innermost(lines: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owners, gaps): each line's narrowest symbol that holds it; a tie or none is a gap.

    lines: file_id, line. spans: file_id, symbol_id, start_line, end_line, width. Spans are cut at
    buckets of 64 lines, so that the range join is an equi-join on (file, bucket).
    """
    buckets = spans.withColumn("_b", F.explode(F.sequence((F.col("start_line") / 64).cast("int"), (F.col("end_line") / 64).cast("int"))))
    own = lines.withColumn("_b", (F.col("line") / 64).cast("int"))
    met = own.join(buckets, ["file_id", "_b"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = met.groupBy("file_id", "line").agg(F.min(F.struct("width", "symbol_id")).alias("b"), F.min("width").alias("w"))
    ties = met.join(best.select("file_id", "line", "w"), ["file_id", "line"]).where("width = w").groupBy("file_id", "line").count()
    owners = best.join(ties.where("count = 1"), ["file_id", "line"]).select("file_id", "line", F.col("b.symbol_id").alias("symbol_id"))
    gaps = ties.where("count > 1").select("file_id", "line", F.lit("AMBIGUOUS_LINE_OWNER").alias("code"))
    none = lines.join(best.select("file_id", "line"), ["file_id", "line"], "left_anti").select("file_id", "line", F.lit("MODULE_LEVEL_CHANGE").alias("code"))
    return owners, gaps.union(none)


def classify_hit(name: Column, path: Column, snippet: Column) -> Column:
    """Endpoint, documentation or symbol, by name, path and snippet."""
    verb = F.upper(F.split_part(name, F.lit(" "), F.lit(1))).isin("GET", "POST", "PUT", "DELETE", "PATCH")
    route = F.coalesce(snippet.contains("@app.") | snippet.contains("@router."), F.lit(False))
    doc = F.coalesce(F.lower(path).endswith(".md") | F.lower(path).startswith("docs/") | F.lower(path).contains("readme"), F.lit(False))
    return F.when(F.coalesce(verb, F.lit(False)) | route, "endpoint").when(doc, "documentation").otherwise("symbol")


def equal_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with the side; empty if the two hold the same rows."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
