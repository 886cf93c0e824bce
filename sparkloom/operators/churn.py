"""Git churn of each path in a window that ends at as_of, both ends inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def churn(paths: DataFrame, commits: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """paths: path. commits: path, ts, author, bugfix. Every path has a row; commits after as_of don't count.

    One shuffle by path with map-side sums; distinct authors in the same aggregate.
    """
    end = as_of
    start = end - F.make_dt_interval(F.lit(days))
    past = commits.where(F.col("ts") <= end)
    inside = F.col("ts") >= start
    per = past.groupBy("path").agg(
        F.count_if(inside).alias("commit_count"), F.count_distinct(F.when(inside, F.col("author"))).alias("distinct_authors"), F.count_if(inside & F.col("bugfix")).alias("bugfix_commits"), F.max("ts").alias("last_modified_at")
    )
    out = paths.select("path").distinct().join(per, "path", "left").na.fill(0, ["commit_count", "distinct_authors", "bugfix_commits"])
    rate = F.when(F.col("commit_count") > 0, F.col("bugfix_commits") / F.col("commit_count")).otherwise(F.lit(0.0))
    return out.withColumn("bugfix_frequency", F.round(rate, 9))


def author_key(email: Column, name: Column) -> Column:
    """Lower-cased e-mail, or the name where there is none."""
    return F.coalesce(F.nullif(F.lower(F.trim(email)), F.lit("")), F.lower(F.trim(name)))


def broken_stats(stats: DataFrame) -> DataFrame:
    """Rows that break the relation's checks."""
    return stats.where((F.col("commit_count") < 0) | (F.col("distinct_authors") > F.col("commit_count")) | (F.col("bugfix_commits") > F.col("commit_count")) | ~F.col("bugfix_frequency").between(0.0, 1.0))
