"""Commits and the paths they touch, from git, as frames. Runs on the driver; shallow clones are refused."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import is_bugfix
from sparkloom.operators.churn import author_key

MAX_COMMITS, MAX_PATHS, TIMEOUT = 20_000, 100_000, 60


class GitLogError(RuntimeError):
    """No complete history can be given."""


def _git(root: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, timeout=TIMEOUT).stdout.decode("utf-8", "replace")
    except (subprocess.SubprocessError, OSError) as e:
        raise GitLogError(str(e)) from e


def history(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(tracked: path; commits: sha, path, ts, author, bugfix) of non-merge commits reachable from HEAD."""
    if _git(root, "rev-parse", "--is-shallow-repository").strip() != "false":
        raise GitLogError("the history is shallow")
    tracked = [p for p in _git(root, "ls-files", "-z").split("\0") if p]
    if len(tracked) > MAX_PATHS:
        raise GitLogError("too many files")
    rows, n = [], 0
    for entry in _git(root, "log", "--no-merges", "--no-renames", "--name-only", "-z", "--format=%x01%H%x00%ct%x00%ae%x00%an%x00%s%x00").split("\x01")[1:]:
        sha, ts, email, name, subject, *paths = entry.split("\0")
        n += 1
        if n > MAX_COMMITS:
            raise GitLogError("too many commits")
        rows += [(sha, p.lstrip("\n"), int(ts), email, name, subject) for p in paths if p.strip("\n")]
    raw = spark.createDataFrame(rows, "sha string, path string, seconds long, email string, name string, subject string")
    commits = raw.select("sha", "path", F.timestamp_seconds("seconds").alias("ts"), author_key(F.col("email"), F.col("name")).alias("author"), is_bugfix(F.col("subject")).alias("bugfix"))
    return spark.createDataFrame([(p,) for p in tracked], "path string"), commits
