"""Fixed relations, vocabularies and write-time checks of the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds, statuses and defaults of the data model.
SYMBOL_KINDS = ("module", "class", "function", "method", "parameter", "variable", "endpoint")
EDGE_KINDS = ("CALLS", "IMPORTS", "INHERITS", "EXPOSES", "USES", "TESTED_BY")
SNAPSHOT_STATUSES = ("pending", "indexing", "ready", "failed")
WALK_KINDS = ("CALLS", "INHERITS")
WALKABLE_KINDS = ("CALLS", "INHERITS", "USES", "IMPORTS")
BLAST_KINDS = ("CALLS", "INHERITS", "USES")

RELATIONS = {
    "repositories": "id long, full_name string, remote_url string",
    "repository_snapshots": "id long, repository_id long, commit_sha string, index_version string, status string, error_message string, created_at timestamp, indexed_at timestamp",
    "files": "file_id long, repository_id long, snapshot_id long, path string, language string",
    "symbols": "symbol_id long, file_id long, name string, qualname string, kind string, start_line int, end_line int, complexity int, docstring string, is_test boolean",
    "edges": "edge_id long, src long, dst long, kind string, confidence double",
    "chunks": "chunk_id long, symbol_id long, repository_id long, text string, embedding array<float>, name_tokens array<string>, body_tokens array<string>",
    "git_stats": "repository_id long, path string, commit_count long, distinct_authors long, last_modified_at timestamp, bugfix_commits long, bugfix_frequency double",
    "recommendation_runs": "run_id long, repository_id long, snapshot_id long, digest string, gaps array<struct<symbol_id:long,code:string>>",
    "recommendation_items": "run_id long, rank int, symbol_id long, category string, score double",
    "pr_analyses": "id long, repository_id long, pr_url string, risk_level string, risk_score double, report string, created_at timestamp",
    "pr_impact_feedback": "repository_id long, analysis_key string, action string, created_at timestamp",
}


class ContractError(ValueError):
    """A relation breaks a rule of the data model."""


def valid_confidence(c: str = "confidence"):
    """Finite and in [0, 1]; false for null and NaN, so unknown is never zero."""
    return F.coalesce(F.col(c).between(0.0, 1.0) & ~F.isnan(c), F.lit(False))


def require_none(bad: DataFrame, what: str) -> None:
    """Raise if there is a row that breaks a rule; reads at most one."""
    if (row := bad.limit(1).first()) is not None:
        raise ContractError(f"{what}: {row.asDict()}")


def check_edges(edges: DataFrame) -> None:
    require_none(edges.where(~F.col("kind").isin(*EDGE_KINDS)), "unknown edge kind")
    require_none(edges.where(F.col("confidence").isNotNull() & ~valid_confidence()), "confidence outside [0, 1]")
    require_none(edges.groupBy("src", "dst", "kind").count().where("count > 1"), "an edge occurs twice")


def positive(value, name: str, most: int | None = None) -> int:
    """A positive int (no bool), at most `most`."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 1 or (most is not None and value > most):
        raise ValueError(f"{name} must be an integer from 1" + (f" to {most}" if most else ""))
    return value


def query_text(value, most: int = 4096) -> str:
    if not isinstance(value, str) or len(value) > most:
        raise ValueError(f"a query is a string of at most {most} characters")
    return value.strip()
