import json

import pytest

from tabscope import profile
from tabscope.operators import findings, logs, plotdata, quality
from tabscope.operators.profile import Profile
from tabscope.operators.target import classify_target
from tests.conftest import by


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(300).selectExpr(
        "id % 50 + IF(id % 2 = 0, 0, 40) AS amount", "(id * 31) % 97 AS score",
        "IF(id % 3 = 0, NULL, id % 7) AS gaps", "ELT(id % 3 + 1, 'a', 'b', 'c') AS s",
        "IF(id % 2 = 0, 'no', 'yes') AS target",
    )


def test_all_results(table):
    out = profile(table, duplicates=0)
    sections = [r["section"] for r in out["findings"].select("section", "section_no").distinct()
                .orderBy("section_no").collect()]
    assert sections == findings.SECTIONS
    assert out["target"].first()["column"] == "target"
    assert by(out["class_distribution"], "class")["yes"]["pct"] == 50.0
    for name, df in out.items():
        assert df.columns, name
        df.collect()


def test_without_target(table):
    out = profile(table, no_target=True)
    got = {r["section"] for r in out["findings"].select("section").distinct().collect()}
    assert "associations" not in got and "target" not in got
    assert "feature_associations" not in out


def test_regression_profile(spark):
    df = spark.range(120).selectExpr("id AS size", "id % 7 AS rooms", "id * 1000.0D + id % 3 AS price")
    out = profile(df)
    assert out["target"].first()["problem_type"] == "regression"
    assert out["feature_target_correlation"].filter("place = 1").first()["feature"] == "size"


@pytest.mark.parametrize("missing, code", [(0, "complete"), (2, "minor_missing"), (60, "much_missing")])
def test_completeness(spark, missing, code):
    df = spark.range(100).selectExpr(f"IF(id < {missing}, NULL, id % 9) AS a", "id % 11 AS b")
    p = Profile(df, duplicates=0)
    rows = findings.conclusion_findings(p, quality.run_quality_rules(p, [])).collect()
    assert rows[0]["code"] == code and "all_checks_passed" in {r["code"] for r in rows}


def test_recommendations_and_limits(table):
    p = Profile(table, classify_target(table, "target"), duplicates=0)
    flags = quality.run_quality_rules(p)
    rows = findings.recommendation_findings(p, flags).collect()
    urgent = [r for r in rows if r["code"] == "missing_values"]
    assert [(r["column"], r["severity"]) for r in urgent] == [("gaps", "HIGH PRIORITY")]
    limits = {r["code"] for r in findings.limitation_findings(p, flags).collect()}
    assert {"few_rows", "over_20_pct_missing", "univariate_and_bivariate_only"} <= limits


def test_facts_cover_all_sections(table):
    p = Profile(table, classify_target(table, "target"), duplicates=0)
    sections = {r["section"] for r in findings.fact_table(p).select("section").distinct().collect()}
    assert {"missing", "statistics", "histogram", "correlation", "categorical", "quality",
            "target_rates", "target"} <= sections


def test_plot_kinds(table):
    target = classify_target(table, "target")
    for kind in plotdata.KINDS:
        rows = plotdata.plot_data(table, kind, target, encoded=["amount", "score"])
        assert rows.count() > 0, kind
    with pytest.raises(ValueError):
        plotdata.plot_data(table, "pie")


def test_phase_timings(spark):
    spans = spark.createDataFrame(
        [("file_load", 23.7), ("chat", 84210.5), ("agent.Loader", 12340.0), (None, 1.0), ("chat", None)],
        "phase string, duration_ms double",
    )
    got = {(r["section"], r["phase"]): r["duration_ms"] for r in logs.phase_timings(spans).collect()}
    assert got[("total", "total")] == pytest.approx(84235.2)
    assert got[("agent", "Loader")] == 12340.0 and got[("phase", "unknown")] == 1.0
    none = logs.phase_timings(spans.limit(0)).collect()
    assert [(r["section"], r["duration_ms"]) for r in none] == [("total", 0.0)]


def test_usage_cost(spark):
    usage = spark.createDataFrame(
        [("A", "m", 1000, 500), ("A", "m", 1000, 500), ("B", "free", 9, 9)],
        "agent string, model string, prompt_tokens long, completion_tokens long",
    )
    prices = spark.createDataFrame([("m", 0.5, 2.0)], "model string, prompt_price double, completion_price double")
    got = {(r["agent"], r["model"]): r["cost"] for r in logs.usage_cost(usage, prices).collect()}
    assert got == {("A", "m"): 3.0, ("A", None): 3.0, ("B", "free"): 0.0, ("B", None): 0.0, (None, None): 3.0}


def test_profile_is_json_friendly(table):
    rows = profile(table, no_target=True)["flags"].toJSON().collect()
    assert all("rule" in json.loads(r) for r in rows)
