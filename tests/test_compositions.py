from __future__ import annotations

import json

import pytest

from sparkloom.operators import assess, changes, evidence
from sparkloom.schema import ContractError
from sparkloom.sources import pysource


def test_symbol_chunks_keep_the_source(spark):
    src = "class A:\n    def m(self):\n        return '---'\n"
    files = spark.createDataFrame([("a.py", bytearray(src.encode()))], "path string, content binary")
    rows = evidence.split_chunk(evidence.symbol_chunks(pysource.parse_files(files))).collect()
    assert {r.qualname for r in rows} == {"A", "A.m"} and all(r.intact for r in rows)
    body = {r.qualname: (r.body, r.first_line) for r in rows}
    assert body["A"] == (src, 1) and body["A.m"] == ("    def m(self):\n        return '---'\n", 2)


def test_expanded_search_and_pack(spark):
    chunks = evidence.retrieval.search_columns(spark.createDataFrame([(10, 1, "alpha", "m.alpha", "a.py", "first", [1.0, 0.0]), (20, 2, "beta", None, "b.py", "uses ```alpha```", [0.0, 1.0])], "chunk_id long, symbol_id long, name string, qualname string, path string, text string, embedding array<float>"))
    symbols = spark.createDataFrame([(i, "function") for i in (1, 2, 3)], "symbol_id long, kind string")
    edges = spark.createDataFrame([(1, 3, 1, "CALLS", 1.0)], "edge_id long, src long, dst long, kind string, confidence double")
    context, gaps = evidence.expanded_search(chunks, symbols, edges, "alpha", [1.0, 0.0], "callers")
    assert [r.symbol_id for r in context.orderBy("seed_rank", "nth").collect()] == [1, 2] and [r.symbol_id for r in gaps.collect()] == [3]
    pack = evidence.evidence_pack(context)
    one = evidence.serialise(pack).first()
    assert one.cited == {"E1": 1, "E2": 2} and [x["cite"] for x in json.loads(one.json)] == ["E1", "E2"]
    assert "````\n" in {r.cite: r.rendered for r in evidence.render(pack).collect()}["E2"]


def test_assessment_keeps_unknowns(spark):
    hits = spark.createDataFrame([(1, "base", 1.0, False, False, True), (2, "base", 1.0, True, False, False)], "change_id long, side string, score double, sensitive boolean, model boolean, endpoint boolean")
    ch = spark.createDataFrame([(1, "BODY_CHANGED", "NO_KNOWN_TEST_LINK", "function", 1, 3), (2, "ADDED", "UNKNOWN", "function", None, None)], "change_id long, classification string, status string, kind string, old_complexity int, new_complexity int")
    lines = spark.createDataFrame([(1, "-"), (1, "+"), (2, "+")], "change_id long, kind string")
    flags = spark.createDataFrame([(1, False, False, False), (2, True, True, False)], "change_id long, blast_incomplete boolean, sensitivity_incomplete boolean, unmeasured boolean")
    got = {r.change_id: r for r in assess.assess(hits, ch, lines, flags).collect()}
    assert got[1].score == pytest.approx(0.3 * 0.02 + 0.2 * 0.6 + 0.2 * 1 + 0.1 * 0.2 + 0.05 * 0.004) and got[1].status == "COMPLETE"
    assert got[2].score is None and got[2].sensitivity == 1.0 and set(got[2].missing) == {"blast_radius", "test_gap", "complexity_delta"}


def test_evaluation_report(spark):
    cases = spark.createDataFrame([("a", ("complete", ["x", "y"])), ("b", ("partial", ["x"])), ("c", ("complete", ["x"]))], "case_id string, files struct<status:string,paths:array<string>>")
    predictions = spark.createDataFrame([("a", ["x", "z"], "ok"), ("b", ["x"], "ok")], "case_id string, files array<string>, status string")
    got = {r.case_id: (r.status, r.precision, r.recall, r.f1) for r in assess.evaluation_report(cases, predictions).collect()}
    assert got == {"a": ("ok", 0.5, 0.5, 0.5), "b": ("ok", None, 1.0, None), "c": ("missing", None, 0.0, 0.0)}


def test_dataset_rules(spark):
    cols = "case_id string, repository string, pr_number int, base_sha string, head_sha string, changed_files array<string>, files struct<status:string>"
    good = ("a", "r", 1, "a" * 40, "b" * 40, ["x"], ("complete",))
    assess.check_dataset(spark.createDataFrame([good], cols))
    for bad in ([good, good], [(*good[:3], "zz", *good[4:])], [(*good[:5], [], good[6])]):
        with pytest.raises(ContractError):
            assess.check_dataset(spark.createDataFrame(bad, cols))


def test_families_spread_until_stable(spark):
    classes = spark.createDataFrame([(1, "X"), (2, None), (3, None), (4, "Y"), (5, None)], "class_id long, family string")
    bases = spark.createDataFrame([(2, 1), (3, 2), (5, 3), (5, 4)], "class_id long, base_id long")
    assert {r.class_id: r.family for r in changes.families(classes, bases).collect()} == {1: "X", 2: "X", 3: "X", 4: "Y"}


def test_predictions_are_checked(spark):
    cols = "case_id string, base_sha string, head_sha string, status string, files array<string>, tests array<string>, error string"
    cases = spark.createDataFrame([("a", "1" * 40, "2" * 40)], "case_id string, base_sha string, head_sha string")
    good = ("a", "1" * 40, "2" * 40, "ok", ["x"], [], None)
    assess.check_predictions(spark.createDataFrame([good], cols), cases)
    assess.check_predictions(spark.createDataFrame([(*good[:3], "failed", [], [], "why")], cols), cases)
    for bad in ([good, good], [("b", *good[1:])], [("a", "3" * 40, *good[2:])], [(*good[:3], "late", *good[4:])], [(*good[:3], "failed", ["x"], [], "why")], [(*good[:3], "failed", [], [], " ")], [(*good[:6], "why")]):
        with pytest.raises(ContractError):
            assess.check_predictions(spark.createDataFrame(bad, cols), cases)


def test_aggregates_of_nothing(spark):
    rows = spark.createDataFrame([("a", "files", "missing", "complete", 0, 0, 0, None, 0.0, 0.0)], "case_id string, category string, prediction_status string, label_status string, tp int, fp int, fn int, precision double, recall double, f1 double")
    got = {r.category: (r.complete_label_cases, r.macro_f1, r.micro_f1, r.micro_precision) for r in assess.impact_aggregates(rows).collect()}
    assert got == {"files": (1, 0.0, None, None), "tests": (0, None, None, None)}
    done = rows.replace("missing", "ok").na.fill(1.0, ["f1"])
    assert {r.category: r.micro_f1 for r in assess.impact_aggregates(done).collect()}["files"] == 1.0
