"""Recommendations: detectors, features, priority, rationale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.schema import valid_confidence

# Thresholds of the detectors.
FAN_IN, COMPLEXITY, CONFIDENCE = 5, 10, 0.5


def fan_in(symbols: DataFrame, edges: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """symbol_id, fan_in, callers: distinct callers that are known not to be tests nor endpoints, without self calls."""
    callers = symbols.where(~F.col("is_test") & (F.col("kind") != "endpoint")).select(F.col("symbol_id").alias("src"))
    calls = edges.where((F.col("kind") == "CALLS") & (F.col("src") != F.col("dst")) & valid_confidence() & (F.col("confidence") >= least))
    own = calls.join(callers, "src", "left_semi").select("src", "dst").distinct()
    return own.groupBy(F.col("dst").alias("symbol_id")).agg(F.count("*").alias("fan_in"), F.array_sort(F.collect_list("src")).alias("callers"))


def handlers(symbols: DataFrame, edges: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """endpoint, n, handler: handlers of each endpoint, the handler where there is exactly one."""
    ends = symbols.where("kind = 'endpoint'").select(F.col("symbol_id").alias("src"))
    calls = edges.where((F.col("kind") == "CALLS") & (F.col("src") != F.col("dst")) & valid_confidence() & (F.col("confidence") >= least))
    linked = calls.join(ends, "src", "left_semi").groupBy("src").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("h"))
    return ends.join(linked, "src", "left").select(F.col("src").alias("endpoint"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("h")).alias("handler"))


def detect(symbols: DataFrame, edges: DataFrame, links_complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """(findings: symbol_id, category, measured; gaps: symbol_id, code)."""
    known = symbols.where(F.col("kind").isin("function", "method"))
    tested = edges.where("kind = 'TESTED_BY'").select(F.col("src").alias("symbol_id")).distinct().withColumn("_tested", F.lit(True))
    plain = known.where(~F.col("is_test")).join(fan_in(symbols, edges).select("symbol_id", "fan_in"), "symbol_id", "left").join(tested, "symbol_id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    hot = plain.where((F.col("fan_in") >= FAN_IN) & F.col("_tested").isNull())
    complex_ = plain.where(F.col("complexity") >= COMPLEXITY)
    ends = handlers(symbols, edges).join(symbols.select(F.col("symbol_id").alias("handler"), F.col("kind").alias("_hk"), "docstring", "documentation_known"), "handler", "left")
    callable_ = F.col("_hk").isin("function", "method")
    undocumented = ends.where((F.col("n") == 1) & callable_ & F.col("documentation_known") & (F.trim(F.coalesce("docstring", F.lit(""))) == ""))
    found = complex_.select("symbol_id", F.lit("COMPLEXITY_HOTSPOT").alias("category"), F.col("complexity").cast("long").alias("measured"))
    found = found.union(undocumented.select(F.col("endpoint").alias("symbol_id"), F.lit("API_DOC_GAP"), F.lit(None).cast("long")))
    if links_complete:
        found = found.union(hot.select("symbol_id", F.lit("UNTESTED_HOTSPOT"), F.col("fan_in").cast("long")))
    gap = F.when(F.col("n") != 1, "ENDPOINT_HANDLER_UNKNOWN").when(~F.coalesce(callable_, F.lit(False)), "ENDPOINT_HANDLER_INVALID").when(~F.coalesce("documentation_known", F.lit(False)), "DOCUMENTATION_UNKNOWN")
    gaps = known.where("is_test IS NULL").select("symbol_id", F.lit("TEST_ROLE_UNKNOWN").alias("code"))
    gaps = gaps.union(plain.where("complexity IS NULL").select("symbol_id", F.lit("COMPLEXITY_UNKNOWN")))
    gaps = gaps.union(ends.select(F.col("endpoint").alias("symbol_id"), gap.alias("code")).where("code IS NOT NULL"))
    if not links_complete:
        gaps = gaps.union(hot.select("symbol_id", F.lit("TEST_LINKS_INCOMPLETE")))
    return found, gaps


def features(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Impact, likelihood, effort and confidence of each finding, in closed form, to four digits.

    findings may have `related` (array of symbols): the fan-in of an untested hotspot that wasn't measured is their number, and
    one below 1 counts as their number or 5, whichever is greater.
    """
    s = symbols.select("symbol_id", "complexity", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    x = findings.join(s, "symbol_id", "left")
    zero_is = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(float(d)))
    related = F.coalesce(F.size("related"), F.lit(0)).cast("double") if "related" in findings.columns else F.lit(0.0)
    m = F.coalesce(F.col("measured").cast("double"), related)
    m = F.when(m < 1, F.greatest(related, F.lit(5.0))).otherwise(m)
    over = F.greatest(F.lit(0.0), F.coalesce(F.col("measured").cast("double"), F.col("complexity").cast("double"), F.lit(10.0)) - 10.0)
    known = F.coalesce("complexity", F.lit(0))
    # Bases, steps and bounds of each category.
    by = {
        "UNTESTED_HOTSPOT": (5.0 + F.greatest(F.lit(0.0), F.least(F.lit(5.0), (m - 5.0) * 0.5)), F.least(F.lit(0.95), F.lit(0.7) + F.least(F.lit(0.2), m * 0.02) + F.when(known >= 10, 0.05).otherwise(0.0)), F.lit(1.0) + F.least(F.lit(3.0), zero_is("complexity", 4) * 0.15) + F.least(F.lit(2.0), zero_is("lines", 20) * 0.02), 0.95),
        "COMPLEXITY_HOTSPOT": (4.0 + F.least(F.lit(6.0), over * 0.4), F.least(F.lit(0.95), 0.55 + F.least(F.lit(0.4), over * 0.03)), 2.0 + F.least(F.lit(6.0), over * 0.3), 0.95),
        "API_DOC_GAP": (F.lit(4.5), F.lit(0.65), F.lit(1.0), 0.9),
    }
    other = (F.lit(3.0), F.lit(0.5), F.lit(2.0), 0.8)

    def pick(i: int):
        out = None
        for k, v in by.items():
            value = v[i] if i < 3 else F.lit(v[i])
            out = F.when(F.col("category") == k, value) if out is None else out.when(F.col("category") == k, value)
        return F.round(out.otherwise(other[i] if i < 3 else F.lit(other[i])), 4)

    return x.select("symbol_id", "category", "measured", pick(0).alias("impact"), pick(1).alias("likelihood"), pick(2).alias("effort"), pick(3).alias("confidence"))


def prioritise(scored: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """score = impact * likelihood / max(0.5, effort) * confidence * multiplier, to four digits; null if a part is unknown."""
    if not 0 <= multiplier < float("inf"):
        raise ValueError("the multiplier must be finite and not negative")
    return scored.withColumn("score", F.round(F.col("impact") * F.col("likelihood") / F.greatest(F.lit(0.5), F.col("effort")) * F.col("confidence") * multiplier, 4))


def in_context(findings: DataFrame, evidence: DataFrame, symbols: DataFrame) -> DataFrame:
    """Findings with the evidence of their category and symbol and the symbol's own columns; what has none stays, with nulls.

    findings: symbol_id, category. evidence: symbol_id, category, measured, related. Evidence of another finding is never
    taken by its place; of several rows for one finding the last by `measured` counts.
    """
    own = evidence.groupBy("symbol_id", "category").agg(F.max(F.struct("measured", "related")).alias("e"))
    met = findings.drop("measured", "related").withColumnRenamed("category", "_c").withColumnRenamed("symbol_id", "_s")
    met = met.join(own, F.col("_s").eqNullSafe(F.col("symbol_id")) & (F.col("_c") == F.col("category")), "left").drop("symbol_id", "category")
    met = met.select(F.col("_s").alias("symbol_id"), F.col("_c").alias("category"), *[c for c in met.columns if c not in ("_s", "_c", "e")], "e.measured", "e.related")
    return met.join(symbols.select("symbol_id", "name", F.col("kind").alias("symbol_kind"), "complexity"), "symbol_id", "left")


def ordered(scored: DataFrame) -> DataFrame:
    """Publication order: score (null last), symbol, category."""
    return scored.orderBy(F.desc_nulls_last("score"), "symbol_id", "category")


def rationale(scored: DataFrame) -> DataFrame:
    """A deterministic sentence with the features it cites."""
    facts = F.create_map(*[x for c in ("impact", "likelihood", "effort", "confidence", "score") for x in (F.lit(c), F.col(c))])
    text = F.format_string("%s: impact %.2f, likelihood %.2f, effort %.2f, confidence %.2f give priority %.4f.", "category", "impact", "likelihood", "effort", "confidence", "score")
    return scored.withColumn("facts", facts).withColumn("rationale", text)
