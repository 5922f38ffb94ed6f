"""Literal values of features and scores."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import catalog
from ledgerline.operators import features as fe

STANDARD = {
    "Aktywa": 1000.0, "Aktywa_B": 400.0, "Aktywa_B_I": 100.0, "Aktywa_B_II": 150.0, "Aktywa_B_III": 50.0, "Pasywa_A": 500.0, "Pasywa_B": 500.0, "Pasywa_B_II": 200.0, "Pasywa_B_III": 300.0,
    "RZiS.A": 2000.0, "RZiS.B": 1500.0, "RZiS.C": 500.0, "RZiS.F": 120.0, "RZiS.I": 80.0, "RZiS.L": 50.0, "CF.A_II_1": 20.0,
}


def wide(spark, values):
    rows = [("r", "s", t, v, 1) for t, v in values.items()]
    return fe.report_values(spark.createDataFrame(rows, "report_id string, section string, tag_path string, value_current double, extraction_version int"))


def computed(spark, values):
    return {r.feature_definition_id: r for r in fe.compute_features(wide(spark, values)).collect()}


def test_standard_report(spark):
    got = computed(spark, STANDARD)
    want = {"roa": 0.05, "roe": 0.1, "current_ratio": 1.333333, "quick_ratio": 1.0, "debt_ratio": 0.5, "x1_maczynska": 0.2, "x3_poznanski": 0.7, "x1_poznan": 0.1, "log_total_assets": 6.907755}
    assert {k: got[k].value for k in want} == want and len(got) == 38 and all(r.is_valid for r in got.values())


@pytest.mark.parametrize(
    ("change", "feature", "error"),
    [
        ({"Pasywa_B": None}, "debt_ratio", "missing_tag:Pasywa_B"), ({"Aktywa": 0.0}, "roa", "division_by_zero"), ({"Pasywa_B": 0.0}, "x1_maczynska", "computation_returned_null"),
        ({"Pasywa_B": 0.0, "CF.A_II_1": None}, "x1_maczynska", "missing_tag:CF.A_II_1"), ({"Aktywa": -5.0}, "log_total_assets", "computation_returned_null"),
    ],
)
def test_errors(spark, change, feature, error):
    got = computed(spark, {k: v for k, v in (STANDARD | change).items() if v is not None})[feature]
    assert (got.value, got.is_valid, got.error_message) == (None, False, error)


def test_optional_tags_count_as_zero(spark):
    got = computed(spark, {k: v for k, v in STANDARD.items() if k not in ("Aktywa_B_I", "CF.A_II_1", "Pasywa_B_II")})
    assert (got["quick_ratio"].value, got["x1_maczynska"].value, got["x3_poznanski"].value) == (1.333333, 0.16, 0.5)


def scored(spark, model, *values):
    m = catalog.MODELS[model]
    frame = spark.createDataFrame([("r", *values)], "report_id string, " + ", ".join(f"{f} double" for f in m.coefficients))
    return fe.score(frame, m).first()


@pytest.mark.parametrize(
    ("model", "values", "score", "risk", "label"),
    [
        ("maczynska_1994_v1", (0.5, 2.0, 0.1, 0.1, 0.1, 1.0), 2.54, "low", 0), ("maczynska_1994_v1", (-1.0, 1.0, -0.1, -0.1, 0.1, 0.5), -2.84, "critical", 1), ("maczynska_1994_v1", (0.2, 1.0, 0.0, 0.0, 0.0, 0.0), 0.38, "high", 1),
        ("poznanski_2004_v1", (0.1, 5.0, 0.5, 0.1), 8.7441, "medium", 0), ("poznanski_2004_v1", (0.1, 1.0, 0.5, 0.1), 2.3921, "low", 0), ("prusak_p1_v1", (0.2, 0.5, 0.5, 0.0), 0.01345, "medium", 0),
    ],
)
def test_scores(spark, model, values, score, risk, label):
    r = scored(spark, model, *values)
    assert (r.raw_score, r.risk_category, r.classification) == (pytest.approx(score, abs=1e-6), risk, label)


def test_warning_and_contributions(spark):
    r = scored(spark, "poznanski_2004_v1", 0.1, 5.0, 0.5, 0.1)
    assert r.warnings == ["WARNING_NON_LINEAR_LIQUIDITY"]
    assert r.feature_contributions == pytest.approx({"_intercept": -2.368, "x1_poznanski": 0.3562, "x2_poznanski": 7.94, "x3_poznanski": 2.144, "x4_poznanski": 0.6719})


def test_missing_feature_is_not_scored(spark):
    m = catalog.MODELS["poznan_2000_v1"]
    frame = spark.createDataFrame([("r", 0.1, None, 0.2, 0.3)], "report_id string, " + ", ".join(f"{f} double" for f in m.coefficients))
    assert fe.score(frame, m).count() == 0


def test_own_feature_and_model(spark):
    fe.register_feature("own_gap", ["Aktywa"], lambda v: v("Aktywa") - v("Pasywa_B"))
    try:
        assert computed(spark, STANDARD)["own_gap"].value == 500.0
    finally:
        catalog.FEATURES.pop()
        fe.CUSTOM.pop("own_gap")


def test_a_registered_model_scores_with_the_others(spark):
    """V2: scoring takes every registered model, in the same pass."""
    from ledgerline.operators import flow

    model = catalog.LinearModel("own_v1", "own", {"roa": 2.0, "debt_ratio": -1.0}, 0.5, ((0, "low", 0), (None, "high", 1)))
    catalog.register_linear_model(model)
    try:
        features = spark.createDataFrame([("a", "roa", 0.5, True, 1), ("a", "debt_ratio", 0.25, True, 1), ("a", "roa", 0.75, True, 2), ("b", "roa", 0.1, True, 1), ("b", "debt_ratio", 9.0, False, 1), ("c", "roa", -1.0, True, 1), ("c", "debt_ratio", 0.0, True, 1)], "report_id string, feature_definition_id string, value double, is_valid boolean, computation_version int")
        reports = spark.createDataFrame([("a", "k1"), ("b", "k2")], "id string, krs string")
        scored = spark.createDataFrame([], "model_id string, report_id string")
        new = flow.score_reports(features, reports, scored, models=[model])
        assert {(r.report_id, r.raw_score, r.risk_category, r.classification, r.code) for r in new.collect()} == {("a", 1.75, "high", 1, None), ("c", -1.5, "low", 0, "missing_report")}
        asked = spark.createDataFrame([("a",), ("b",), ("d",)], "report_id string")
        answers = flow.score_reports(features, reports, scored, asked, models=[model])
        assert {(r.report_id, r.code) for r in answers.collect()} == {("a", None), ("b", "missing_feature"), ("d", "missing_report")}
        assert [tuple(r) for r in flow.run_summary(answers).collect()] == [("own_v1", 1, 2, "completed_with_errors", "missing_feature:1,missing_report:1")]
    finally:
        del catalog.MODELS["own_v1"]


def longest_method(spark, capsys, df):
    """Bytes of the longest method that Spark generates for df; the JVM compiles none above 8000."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        df.select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))


def test_unfolding_all_features_is_code_that_the_jvm_compiles(spark, capsys):
    """It was a method of its own formula for each feature, which is interpreted."""
    stored = wide(spark, STANDARD).repartition(2).withColumn("source", F.lit(1))
    assert longest_method(spark, capsys, fe.compute_features(stored)) < 8000


def test_items_meet_in_hashed_buffers(spark):
    """Only a row a section is sorted; they all were."""
    items = spark.createDataFrame([("r", "s", "Aktywa", 1.0, 1)], "report_id string, section string, tag_path string, value_current double, extraction_version int")
    plan = fe.report_values(items)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate(key") > plan.rindex("SortAggregate(key")


def test_last_section_then_newest_extraction_counts(spark):
    rows = [("r", "A", "Aktywa", 1.0, 9), ("r", "B", "Aktywa", 2.0, 1), ("r", "B", "Aktywa", 3.0, 2), ("r", "A", "Pasywa_A", 4.0, 1), ("r", "B", "Pasywa_A", None, 1), ("r", None, "Pasywa_B", 5.0, 1), ("s", "A", "other", 6.0, 7)]
    items = spark.createDataFrame(rows, "report_id string, section string, tag_path string, value_current double, extraction_version int")
    got = fe.report_values(items, source="source").collect()
    assert [(r.report_id, r.Aktywa, r.Pasywa_A, r.Pasywa_B, r.source) for r in got] == [("r", 3.0, None, 5.0, 9)]
    assert [(r.Aktywa, r.Pasywa_A) for r in fe.report_values(items).collect()] == [(3.0, None)]


def test_rounding_is_that_of_round(spark):
    values = [0.0000005, -0.0000005, 1.0000005, 2.5e-7, -1e-9, 123456.7890125, 1e13 + 0.1234567, -7.0000015, float("nan"), float("inf"), None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(fe._rounded(F.col("x")).cast("string").alias("a"), F.round("x", 6).cast("string").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_other_definitions(spark):
    defined = [("d", "difference", "Aktywa", "Pasywa_A", []), ("r", "raw_value", "RZiS.L", None, []), ("n", "raw_value", None, None, []), ("u", "what", None, None, []), ("c", "custom", None, None, ["Aktywa"]), ("q", "ratio", "Aktywa", None, []), ("g", "raw_value", "Gone", None, [])]
    got = {r.feature_definition_id: (r.value, r.error_message) for r in fe.compute_features(wide(spark, STANDARD), defined).collect()}
    assert got == {"d": (500.0, None), "r": (50.0, None), "n": (None, "missing_formula"), "u": (None, "unknown_logic:what"), "c": (None, "no_custom_function:c"), "q": (None, "missing_formula"), "g": (None, "missing_tag:Gone")}


def test_all_models_at_once_are_each_model(spark, capsys):
    """One formula for all, in code that the JVM compiles; it was evaluated expression by expression."""
    ids = sorted({f for m in catalog.MODELS.values() for f in m.coefficients})
    rows = [(str(r), *[None if r == 3 and i % 5 == 0 else ((r * 7 + i * 3) % 11 - 4) / 3 + (5.0 if r == 4 else 0.0) for i in range(len(ids))]) for r in range(12)]
    frame = spark.createDataFrame(rows, "report_id string, " + ", ".join(f"{f} double" for f in ids))
    all_ = fe.score_all(frame)
    told = lambda df: {(r.report_id, r.model_id): (r.raw_score, r.classification, r.risk_category, r.feature_contributions, r.warnings) for r in df.collect()}
    each = [fe.score(frame, m) for m in catalog.MODELS.values()]
    want = {k: v for df in each for k, v in told(df).items()}
    assert told(all_) == want and all_.columns == each[0].columns and 40 < len(want) < 60 and any(v[4] for v in want.values())
    plan = all_._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and longest_method(spark, capsys, fe.score_all(frame.repartition(2))) < 8000
