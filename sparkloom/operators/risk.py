"""Change risk: features with unknowns kept unknown, a weighted interval, report and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights, caps, cut points, costs.
WEIGHTS = {"blast_radius": 0.30, "sensitivity": 0.20, "test_gap": 0.20, "contract_changes": 0.15, "complexity_delta": 0.10, "size": 0.05}
BLAST_CAP, COMPLEXITY_CAP, LINES_CAP = 50.0, 10.0, 500.0
LEVELS = ((0.25, "LOW"), (0.50, "MEDIUM"), (0.75, "HIGH"))
COSTS = {"BODY_CHANGED": 0.0, "ADDED": 0.5, "REMOVED": 1.0, "SIGNATURE_CHANGED": 1.0}


def score(features: DataFrame) -> DataFrame:
    """Add lower_bound, upper_bound, score, risk_level, status, missing. Null features widen the interval and are never made up."""
    lower = sum((F.coalesce(F.col(k).cast("decimal(18,9)") * F.lit(w).cast("decimal(3,2)"), F.lit(0).cast("decimal(21,11)")) for k, w in WEIGHTS.items()), F.lit(0).cast("decimal(21,11)"))
    gone = sum((F.when(F.col(k).isNull(), F.lit(w).cast("decimal(3,2)")).otherwise(F.lit(0).cast("decimal(3,2)")) for k, w in WEIGHTS.items()), F.lit(0).cast("decimal(3,2)"))
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in WEIGHTS]))
    out = features.withColumn("_l", lower).withColumn("_g", gone).withColumn("missing", missing)
    whole = F.size("missing") == 0
    level = None
    for top, name in LEVELS:
        level = F.when(F.col("_l") < F.lit(str(top)).cast("decimal(3,2)"), name) if level is None else level.when(F.col("_l") < F.lit(str(top)).cast("decimal(3,2)"), name)
    out = out.withColumn("lower_bound", F.col("_l").cast("double")).withColumn("upper_bound", (F.col("_l") + F.col("_g")).cast("double"))
    return out.withColumn("score", F.when(whole, F.col("_l").cast("double"))).withColumn("risk_level", F.when(whole, level.otherwise("CRITICAL"))).withColumn("status", F.when(whole, "COMPLETE").otherwise("INCOMPLETE")).drop("_l", "_g")


def blast_mass(hits: DataFrame, by: list[str], side: str = "side") -> DataFrame:
    """Sum of weights a side, the greater of the sides, over its cap."""
    per = hits.groupBy(*by, side).agg(F.sum("score").alias("m"))
    return per.groupBy(*by).agg(F.round(F.max("m"), 9).alias("blast_mass"), F.round(F.least(F.lit(1.0), F.max("m") / BLAST_CAP), 9).alias("blast_radius"))


def sensitivity(is_sensitive: Column, is_model: Column, is_endpoint: Column) -> Column:
    """The strongest signal; use under max()."""
    return F.when(is_sensitive, 1.0).when(is_model, 0.8).when(is_endpoint, 0.6).otherwise(0.0)


def change_features(changes: DataFrame, by: list[str]) -> DataFrame:
    """changes: classification, status (test gap), old and new complexity, kind. One row a group.

    test_gap: share without a known test among those to which it applies; null if one is unknown.
    complexity_delta: greatest increase; removed 0, added from 0; null if a measure is missing.
    """
    cost = F.element_at(F.create_map(*[F.lit(x) for kv in COSTS.items() for x in kv]), F.col("classification"))
    callable_ = F.col("kind").isin("function", "method")
    old = F.when(F.col("classification") == "ADDED", F.lit(0)).otherwise(F.col("old_complexity"))
    rise = F.when(~callable_, 0).when(F.col("classification") == "REMOVED", 0).otherwise(F.greatest(F.lit(0), F.col("new_complexity") - old))
    rise = F.when(callable_ & (F.col("classification") != "REMOVED") & (F.col("new_complexity").isNull() | old.isNull()), None).otherwise(rise)
    applies = F.count_if(F.col("status").isin("LINKED", "NO_KNOWN_TEST_LINK"))
    unlinked = F.count_if(F.col("status") == "NO_KNOWN_TEST_LINK")
    unknown = F.count_if(F.coalesce(F.col("status") == "UNKNOWN", F.lit(True))) > 0
    return changes.withColumn("_r", rise).groupBy(*by).agg(
        F.round(F.when(unknown, None).otherwise(F.when(applies > 0, unlinked / applies).otherwise(F.lit(0.0))), 9).alias("test_gap"),
        F.round(F.avg(cost), 9).alias("contract_changes"),
        F.round(F.when(F.count_if(F.col("_r").isNull()) == 0, F.least(F.lit(1.0), F.max("_r") / COMPLEXITY_CAP)), 9).alias("complexity_delta"),
    )


def changed_lines(diff_lines: DataFrame, by: list[str]) -> DataFrame:
    """Added and removed rows, over their cap."""
    n = F.count_if(F.col("kind").isin("+", "-"))
    return diff_lines.groupBy(*by).agg(n.alias("changed_lines"), F.round(F.least(F.lit(1.0), n / LINES_CAP), 9).alias("size"))


def report(scored: DataFrame) -> DataFrame:
    """Contributions, bounds and a sentence, as JSON."""
    parts = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.round(F.col(k) * w, 9))])
    text = F.when(F.col("status") == "COMPLETE", F.format_string("Risk %.2f (%s).", "score", "risk_level")).otherwise(F.format_string("Risk between %.2f and %.2f; unknown: %s.", "lower_bound", "upper_bound", F.array_join("missing", ", ")))
    return scored.withColumn("summary", text).withColumn("report", F.to_json(F.struct("status", "score", "risk_level", "lower_bound", "upper_bound", parts.alias("contributions"), "summary")))


# The sentences of a summary, with the figures they cite.
SENTENCES = {
    "risk": ("Pull request analysis concluded with %s risk (score: %s, status: %s).", ("level_text", "score_text", "risk_status")),
    "diff": ("Diff modifies %d lines across %d files (%d symbols modified).", ("changed_lines_count", "files_changed_count", "modified_symbols_count")),
    "reach": ("Downstream ripple traversal identified %d impacted symbols and %d affected API endpoints.", ("impacted_symbols_count", "affected_endpoints_count")),
    "untested": ("%d modified production callables lack direct static test coverage.", ("untested_modified_symbols_count",)),
    "tested": ("All modified production callables have linked static test associations.", ()),
    "complexity": ("Maximum detected callable cyclomatic complexity increase is +%d.", ("maximum_complexity_increase",)),
    "gaps": ("Assessment contains %d unmeasured boundary gap(s).", ("gaps_count",)),
}


def executive_summary(facts: DataFrame) -> DataFrame:
    """Add `summary` and `cited` (the figures that the sentences rest on). facts: risk_level, risk_score, risk_status, lower_bound,
    upper_bound, the counts that the sentences name, maximum_complexity_increase, gaps_count.

    A score that isn't known shows its bounds, two digits each; sentences without an occasion are left out.
    """
    bounds = F.format_string("[%.2f-%.2f] (incomplete)", "lower_bound", "upper_bound")
    shown = F.when(F.col("risk_score").isNotNull(), F.format_string("%.2f", "risk_score")).when(F.col("lower_bound").isNotNull() & F.col("upper_bound").isNotNull(), bounds).otherwise("incomplete")
    rows = facts.withColumn("score_text", shown).withColumn("level_text", F.coalesce("risk_level", F.lit("None")))
    said = {k: F.format_string(text, *cols) if cols else F.lit(text) for k, (text, cols) in SENTENCES.items()}
    lines = [said["risk"], said["diff"], said["reach"], F.when(F.col("untested_modified_symbols_count") > 0, said["untested"]).otherwise(said["tested"]), F.when(F.col("maximum_complexity_increase") > 0, said["complexity"]), F.when(F.col("gaps_count") > 0, said["gaps"])]
    cited = ("risk_level", "risk_score", "files_changed_count", "changed_lines_count", "impacted_symbols_count", "affected_endpoints_count", "untested_modified_symbols_count")
    out = rows.withColumn("summary", F.concat_ws(" ", *lines))
    return out.select(*facts.columns, "summary", F.struct(*cited).alias("cited"))


def ungrounded(reports: DataFrame, text: str, facts: str, least: int = 10) -> DataFrame:
    """Rows whose text has a whole number above `least` that isn't among its facts (array of long)."""
    said = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(?<![\d.])(\d+)(?![\d.])")), lambda x: x.cast("long"))
    return reports.withColumn("unknown_numbers", F.array_except(F.filter(said, lambda x: x > least), F.col(facts))).where(F.size("unknown_numbers") > 0)


def quick_risk(changed: Column) -> Column:
    """The thin service's figure: min(0.02 + 0.003 * lines, 0.75), two digits."""
    return F.round(F.least(F.lit(0.02) + changed * 0.003, F.lit(0.75)), 2)
