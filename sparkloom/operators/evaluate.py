"""Evaluation: set metrics, macro and micro F1, recall at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def set_counts(predicted: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """tp, fp, fn of each case. predicted, truth: case, item."""
    p, t = predicted.select(by, "item").distinct().withColumn("_p", F.lit(1)), truth.select(by, "item").distinct().withColumn("_t", F.lit(1))
    both = p.join(t, [by, "item"], "full_outer")
    return both.groupBy(by).agg(F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 with conventions: nothing predicted and nothing true is right; predictions without truth are wrong."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    empty_truth, empty_pred = (tp + fn) == 0, (tp + fp) == 0
    precision = F.when(empty_pred, F.when(empty_truth, 1.0).otherwise(0.0)).otherwise(F.try_divide(tp, tp + fp))
    recall = F.when(empty_truth, F.lit(1.0)).otherwise(F.try_divide(tp, tp + fn))
    f1 = F.when(empty_truth & empty_pred, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))
    return counts.withColumns({"precision": F.round(precision, 9), "recall": F.round(recall, 9), "f1": F.round(f1, 9)})


def overall(cases: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """macro_f1 (mean over cases; a case without a row counts as empty on both sides) and micro_f1 (pooled)."""
    every = metrics(cases.select(by).distinct().join(counts, by, "left").na.fill(0, ["tp", "fp", "fn"]))
    tp, fp, fn = (F.sum(c).cast("double") for c in ("tp", "fp", "fn"))
    return every.agg(F.round(F.avg("f1"), 9).alias("macro_f1"), F.round(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(1.0)), 9).alias("micro_f1"), F.count("*").alias("cases"))


def recall_at(ranked: DataFrame, truth: DataFrame, k: int, by: str = "query") -> DataFrame:
    """Mean share of each query's truth among its first k. ranked: query, item, score; truth: query, item, never empty for a query."""
    top = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "item"))).where(F.col("_n") <= k)
    hit = top.select(by, "item", F.lit(1).alias("_h"))
    per = truth.select(by, "item").distinct().join(hit, [by, "item"], "left").groupBy(by).agg((F.count("_h") / F.count("*")).alias("r"))
    return per.agg(F.round(F.avg("r"), 9).alias("recall"), F.count("*").alias("queries"))
