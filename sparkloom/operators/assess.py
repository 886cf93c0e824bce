"""Compositions: a change's assessment, published recommendations, evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import evaluate, recommend, risk
from sparkloom.schema import require_none


def assess(hits: DataFrame, changes: DataFrame, diff_lines: DataFrame, flags: DataFrame, by: str = "change_id") -> DataFrame:
    """Risk of each change: features, bounds, level, summary and report.

    hits: by, side, score, sensitive, model, endpoint. changes: see change_features(). diff_lines: by,
    kind. flags: by, blast_incomplete, sensitivity_incomplete, unmeasured (booleans). A full-strength
    sensitivity stays even when its classification is incomplete.
    """
    mass = risk.blast_mass(hits, [by]).select(by, F.col("blast_radius").alias("_b"))
    signal = hits.groupBy(by).agg(F.max(risk.sensitivity(F.col("sensitive"), F.col("model"), F.col("endpoint"))).alias("_s"))
    parts = risk.change_features(changes, [by])
    size = risk.changed_lines(diff_lines, [by]).select(by, F.col("size").alias("_z"), "changed_lines")
    x = flags.join(mass, by, "left").join(signal, by, "left").join(parts, by, "left").join(size, by, "left")
    s = F.coalesce("_s", F.lit(0.0))
    x = x.withColumn("blast_radius", F.when(F.col("blast_incomplete") | F.col("unmeasured"), None).otherwise(F.coalesce("_b", F.lit(0.0))))
    x = x.withColumn("sensitivity", F.when((F.col("sensitivity_incomplete") | F.col("unmeasured")) & (s < 1.0), None).otherwise(s))
    for c in ("test_gap", "contract_changes", "complexity_delta"):
        x = x.withColumn(c, F.when(F.col("unmeasured"), None).otherwise(F.col(c)))
    x = x.withColumn("size", F.when(F.col("unmeasured"), None).otherwise(F.coalesce("_z", F.lit(0.0))))
    return risk.report(risk.score(x)).drop("_b", "_s", "_z")


def latest_publication(snapshots: DataFrame, runs: DataFrame, items: DataFrame, repository_id: int, k: int = 10) -> DataFrame:
    """First k items of the newest run of the newest ready snapshot, with `current`: whether the stored score is what its features give."""
    ready = snapshots.where((F.col("repository_id") == repository_id) & (F.col("status") == "ready")).agg(F.max("id").alias("snapshot_id"))
    run = runs.join(ready, "snapshot_id").where(F.col("repository_id") == repository_id).agg(F.max("run_id").alias("run_id"))
    rows = items.join(F.broadcast(run), "run_id").where(F.col("rank") <= k)
    again = recommend.prioritise(rows.withColumnRenamed("score", "stored")).withColumn("current", F.col("stored").eqNullSafe(F.col("score")))
    return again.drop("score").withColumnRenamed("stored", "score").orderBy("rank")


def check_dataset(cases: DataFrame) -> None:
    """Unique cases and requests, 40-digit revisions, at least one changed file, known statuses; raises on the first rule that breaks."""
    require_none(cases.groupBy("case_id").count().where("count > 1"), "a case occurs twice")
    require_none(cases.groupBy("repository", "pr_number").count().where("count > 1"), "a request occurs twice")
    require_none(cases.where(~(F.col("base_sha").rlike("^[0-9a-f]{40}$") & F.col("head_sha").rlike("^[0-9a-f]{40}$"))), "a revision isn't 40 hex digits")
    require_none(cases.where(F.size("changed_files") == 0), "a case without changed files")
    require_none(cases.where(~F.col("files.status").isin("complete", "partial")), "an unknown label status")


def changed_files_baseline(cases: DataFrame) -> DataFrame:
    """The predictor that says a change affects what it changes."""
    return cases.select("case_id", F.col("changed_files").alias("files"), F.array().cast("array<string>").alias("tests"), F.lit("ok").alias("status"))


def evaluation_report(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row a case: counts and metrics of its files. Missing or failed predictions recall nothing; partial labels have no precision.

    cases: case_id, files (struct of status, paths). predictions: case_id, files, status.
    """
    p = cases.select("case_id", F.col("files.status").alias("labels"), F.array_distinct("files.paths").alias("_t")).join(predictions.select("case_id", F.array_distinct("files").alias("_p"), F.col("status").alias("_s")), "case_id", "left")
    p = p.withColumn("status", F.coalesce("_s", F.lit("missing")))
    ok = F.col("status") == "ok"
    tp = F.when(ok, F.size(F.array_intersect("_t", "_p"))).otherwise(F.lit(0))
    p = p.select("case_id", "labels", "status", tp.alias("tp"), F.when(ok, F.size(F.array_except("_p", "_t"))).otherwise(F.lit(0)).alias("fp"), (F.size("_t") - tp).alias("fn"))
    m = evaluate.metrics(p)
    partial = F.col("labels") == "partial"
    failed = F.col("status") != "ok"
    m = m.withColumn("precision", F.when(partial | failed, None).otherwise(F.col("precision"))).withColumn("recall", F.when(failed, 0.0).otherwise(F.col("recall")))
    return m.withColumn("f1", F.when(partial, None).when(failed, 0.0).otherwise(F.col("f1"))).withColumn("fp", F.when(partial, None).otherwise(F.col("fp")))


def check_predictions(predictions: DataFrame, cases: DataFrame) -> None:
    """Predictions of known cases, one each, on the cases' revisions; a failed one has an error and claims nothing, another has none."""
    require_none(predictions.groupBy("case_id").count().where("count > 1"), "a case is predicted twice")
    require_none(predictions.join(cases, "case_id", "left_anti"), "a prediction of an unknown case")
    sha = cases.select("case_id", F.col("base_sha").alias("_b"), F.col("head_sha").alias("_h"))
    require_none(predictions.join(sha, "case_id").where("NOT (base_sha <=> _b AND head_sha <=> _h)").select("case_id"), "a prediction of other revisions")
    require_none(predictions.where(~F.coalesce(F.col("status").isin("ok", "failed"), F.lit(False))), "an unknown prediction status")
    claims = (F.size("files") > 0) | (F.size("tests") > 0)
    require_none(predictions.where((F.col("status") == "failed") & (claims | (F.trim(F.coalesce("error", F.lit(""))) == ""))), "a failed prediction that claims paths or has no error")
    require_none(predictions.where((F.col("status") == "ok") & F.col("error").isNotNull()), "a prediction with an error that isn't failed")


#: What is predicted of a change.
CATEGORIES = ("files", "tests")


def impact_rows(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row a case and category: counts, metrics and the known paths that were missed; all unknown where the label is.

    cases: case_id, and files and tests (struct of status, paths). predictions: case_id, status, files, tests.
    """
    parts = None
    for category in CATEGORIES:
        rows = evaluation_report(cases.select("case_id", F.col(category).alias("files")), predictions.select("case_id", F.col(category).alias("files"), "status"))
        said = predictions.where("status = 'ok'").select("case_id", F.col(category).alias("_p"))
        known = cases.select("case_id", F.col(f"{category}.paths").alias("_t")).join(said, "case_id", "left")
        missed = known.select("case_id", F.array_sort(F.array_except("_t", F.coalesce("_p", F.array().cast("array<string>")))).alias("missing_known"))
        unknown = F.col("labels") == "unknown"
        own = rows.join(missed, "case_id").select("case_id", F.lit(category).alias("category"), F.col("status").alias("prediction_status"), F.col("labels").alias("label_status"), *[F.when(~unknown, F.col(c)).alias(c) for c in ("tp", "fp", "fn", "precision", "recall", "f1", "missing_known")])
        parts = own if parts is None else parts.union(own)
    return parts


def impact_aggregates(rows: DataFrame) -> DataFrame:
    """category, complete_label_cases, successful_cases, macro_f1, micro_f1, micro_precision, micro_recall, tp, fp, fn over cases with complete labels.

    Missing and failed predictions score no macro F1; micro F1 without any count is 1 if all complete cases were predicted, else unknown.
    """
    every = F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string"))
    sums = {k: F.coalesce(F.sum(k), F.lit(0)) for k in ("tp", "fp", "fn")}
    n, good = F.count("case_id"), F.count_if(F.col("prediction_status") == "ok")
    per = every.join(rows.where("label_status = 'complete'"), "category", "left").groupBy("category").agg(n.alias("complete_label_cases"), good.alias("successful_cases"), F.round(F.avg("f1"), 9).alias("macro_f1"), *[v.alias(k) for k, v in sums.items()])
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    whole = F.when((F.col("complete_label_cases") > 0) & (F.col("complete_label_cases") == F.col("successful_cases")), 1.0)
    micro = {"micro_f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), whole), "micro_precision": F.try_divide(tp, tp + fp), "micro_recall": F.try_divide(tp, tp + fn)}
    return per.select("category", "complete_label_cases", "successful_cases", "macro_f1", *[F.round(v, 9).alias(k) for k, v in micro.items()], "tp", "fp", "fn")
