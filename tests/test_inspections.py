"""Canonicalisation, metrics, risk, trend and alerts on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from auditgrain.functions.config import AlertRules, RiskConfig
from auditgrain.operators import alerts as A
from auditgrain.operators import metrics as M
from auditgrain.operators import normalize as N
from auditgrain.operators import risk as K
from auditgrain.operators import rollup as R
from auditgrain.operators import trend as T

SCHEMA = (
    "inspection_id string, inspection_year int, inspection_date date, classification string, citation_indicator int, "
    "observation_count int, observation_text string, site_key string, company_key string, company_name string, site_name string, "
    "fei_number string, country string, product_type string"
)


def record(i, day, label, cited, count, text, site="s1"):
    d = date.fromisoformat(day) if day else None
    return (i, d.year if d else None, d, label, cited, count, text, site, "acme", "Acme", "Plant", site, "US", "Drugs")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_unknown_is_not_zero(spark):
    df = frame(spark, record("a", "2024-01-05", "OAI", 1, 4, "audit trail disabled"), record("b", "2024-02-05", None, None, None, None))
    row = M.portfolio_metrics(df, "2024-12-31").first()
    assert (row.citation_known, row.citation_rate, row.oai_rate, row.average_observations) == (1, 1.0, 1.0, 4.0)
    assert (row.Unknown, row.total_inspections) == (1, 2)
    nothing = M.portfolio_metrics(df.filter("inspection_id = 'b'"), "2024-12-31").first()
    assert nothing.citation_rate is None and nothing.oai_rate is None and nothing.average_observations is None


def test_recurrence_counts_inspections_not_rows(spark):
    text = "Audit trail missing"
    df = frame(spark, record("a", "2024-01-05", "OAI", 1, 1, text), record("a", "2024-01-05", "OAI", 1, 1, text), record("b", "2024-03-05", "OAI", 1, 1, text))
    row = M.theme_recurrence(df).filter("theme = 'Data Integrity'").first()
    assert (row["count"], row.repeat_count) == (2, 1)
    with pytest.raises(ValueError):
        M.theme_recurrence(df, group_by="text")


def test_risk_factors_and_missing_evidence(spark):
    rows = [
        record("a", "2022-05-01", "OAI", 1, 5, "audit trail disabled"), record("b", "2023-05-01", "VAI", 0, 1, "audit trail gaps"),
        record("c", "2024-05-01", "NAI", 1, None, None), record("x", None, None, None, None, None, "s2"),
    ]
    got = {r.site_key: r for r in K.risk_score(frame(spark, *rows), ["site_key"], "2024-12-31").collect()}
    assert got["s2"].score is None and got["s2"].band == "INSUFFICIENT DATA" and len(got["s2"].missing_factors) == 6
    factors = {c.name: c.factor for c in got["s1"].components}
    latest_adverse = (date(2024, 12, 31) - date(2024, 5, 1)).days
    expected = {
        "citation_history": round(2 / 3, 6), "classification_history": round((1 + 0.4) / 3, 6), "recurring_deficiencies": round(1 / 3, 6),
        "recency": round(1 - latest_adverse / 730, 6), "severity": 0.6, "negative_trend": 1.0,
    }
    assert factors == pytest.approx(expected)
    raw = round(2 / 3, 6) * 25 + 1.4 / 3 * 25 + 20 / 3 + (1 - latest_adverse / 730) * 10 + 6 + 10
    assert got["s1"].score == pytest.approx(round(raw, 2)) and got["s1"].coverage_pct == 100.0
    shuffled = K.risk_score(frame(spark, *rows[::-1]), ["site_key"], "2024-12-31").filter("site_key = 's1'").first()
    assert shuffled.score == got["s1"].score


def test_risk_config_is_checked():
    with pytest.raises(ValueError):
        RiskConfig(weights={"recency": 1.0})
    with pytest.raises(ValueError):
        RiskConfig(moderate=70, high=60)


def test_trend_has_no_future_leakage(spark):
    early = [record("a", "2022-05-01", "NAI", 0, 1, None), record("b", "2023-05-01", "NAI", 0, 1, None)]
    late = record("z", "2024-05-01", "OAI", 1, 5, "falsified")
    before = {r.inspection_year: r.score for r in T.risk_trend(frame(spark, *early), ["site_key"], "2024-06-30").collect()}
    after = {r.inspection_year: r for r in T.risk_trend(frame(spark, *early, late), ["site_key"], "2024-06-30").collect()}
    assert {y: after[y].score for y in (2022, 2023)} == before
    assert after[2024].score > after[2023].score and after[2024].partial_year and not after[2023].partial_year


def test_all_alert_codes(spark):
    rows = [record(f"p{i}", f"2023-0{i}-01", "NAI", 0, 1, "audit trail") for i in (1, 2, 3)]
    rows += [record(f"q{i}", f"2024-0{i}-01", "OAI", 1, 5, "audit trail was falsified") for i in (1, 2, 3)]
    rules = AlertRules()
    got = A.alert_evidence(frame(spark, *rows), "2024-06-30", rules=rules).groupBy("code").agg(F.count("*").alias("n"))
    counts = {r.code: r.n for r in got.collect()}
    assert counts == {
        A.HIGH_RISK: 6, A.REPEATED_OAI: 3, A.RATE_INCREASE: 6, A.RECURRING_THEME: 6, A.NEW_SEVERE: 1,
    }


def test_theme_change_is_null_without_text(spark):
    df = frame(spark, record("a", "2022-05-01", "NAI", 0, 1, None), record("b", "2023-05-01", "NAI", 0, 1, "training gaps"))
    row = T.theme_change(df).filter("theme = 'Training'").first()
    assert (row.start_count, row.end_count, row.change) == (None, 1, None)


def test_canonicalize_splits_every_row_once(spark):
    columns = ["Inspection ID", "Company", "Inspection Date", "Classification", "Observations", "row"]
    rows = [
        ("1", " Acme  Corp ", "2024-01-05", "Official Action Indicated", "3", 2), ("1", "Acme Corp", "2024-01-05", "OAI", "3", 3),
        ("2", "Beta", "01/31/2024", "pending", "2.5", 4), ("3", "Gamma", "2024-02-30", "", "", 5), ("4", "Delta", "2030-01-01", "VAI", "1", 6),
        ("", "Echo", "2024-03-01 10:00:00", "nai", "0", 7), ("6", "", "2024-01-01", "NAI", "1", 8),
    ]
    mapping = {
        "inspection_id": "Inspection ID", "company_name": "Company", "inspection_date": "Inspection Date",
        "classification": "Classification", "observation_count": "Observations",
    }
    out = N.canonicalize(spark.createDataFrame(rows, columns), mapping, "2024-12-31", "row")
    valid = {r.source_row: r for r in out["valid"].collect()}
    reasons = {r.source_row: r.rejection_reason for r in out["rejected"].collect()}
    assert set(valid) == {2, 7} and [r.source_row for r in out["duplicates"].collect()] == [3]
    assert valid[2].company_name == "Acme Corp" and valid[2].classification == "OAI" and valid[7].inspection_id.startswith("DERIVED-")
    assert reasons == {
        4: "Invalid observation count", 5: "Invalid date", 6: "Future inspection date", 8: "Missing identity",
    }
    q = out["quality"].first()
    assert q.total_records == q.valid_records + q.rejected_records + q.duplicate_records == 7
    assert q.unknown_classifications == 1 and "country" in q.missing_columns
    with pytest.raises(ValueError):
        N.apply_mapping(spark.createDataFrame(rows, columns), {"country": "Country"}, "row")


def test_filters(spark):
    df = frame(spark, record("a", "2022-05-01", None, 0, 1, "50% off"), record("b", "2023-05-01", "NAI", 0, 1, "500 off", "s2"))
    ids = lambda d: [r.inspection_id for r in d.collect()]
    assert ids(N.filter_inspections(df, classification="Unknown", company=" ACME ")) == ["a"]
    assert ids(N.filter_site(df, "s2")) == ["b"] and sorted(ids(N.filter_site(df, "Plant"))) == ["a", "b"]
    assert ids(N.search_literal(df, "50%", ["observation_text"])) == ["a"]
    with pytest.raises(ValueError):
        N.filter_inspections(df, colour="red")


def test_rollup_keeps_one_row_and_worst_class(spark):
    projects = spark.createDataFrame(
        [(1, "i1", "f", "Acme", None, None, "US", 2024, date(2024, 1, 5), "NAI", "No", "Drugs", "P1"),
         (2, "i1", "f", "Acme", None, None, "US", 2024, date(2024, 1, 5), "OAI", "Yes", "Devices", "P1")],
        "source_row int, id string, fei string, company string, city string, state string, country string, fiscal_year int, date date, "
        "classification string, posted string, project string, product string",
    )
    cites = spark.createDataFrame(
        [(i, "i1", "f", date(2024, 1, 5), "Drugs", "R", f"short {i}", None if i == 2 else f"long {i}") for i in (1, 2, 3)],
        "source_row int, id string, fei string, date date, program string, reference string, short string, long string",
    )
    row = R.roll_up_projects(projects, cites, "2024-12-31").first()
    assert (row.classification, row.posted_citation_indicator, row.source_project_rows, row.available_citation_count) == ("OAI", 1, 2, 3)
    assert row.project_area == "Devices | Drugs" and row.observation_text == "long 1\n\nshort 2\n\nlong 3" and row.citation_indicator is None
    many = spark.range(12_000).select(
        F.col("id").cast("int").alias("source_row"), F.lit("i1").alias("id"), F.lit("f").alias("fei"), F.lit(date(2024, 1, 5)).alias("date"),
        F.lit("Drugs").alias("program"), F.lit("R").alias("reference"), F.lit("").alias("short"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("long"),
    )
    whole = R.roll_up_projects(projects, many, "2024-12-31").first()
    assert whole.available_citation_count == 12_000 and whole.observation_text.split("\n\n") == [f"t{i}" for i in range(12_000)]
    assert len(R.nest_evidence(projects, many).first().citation_evidence) == 12_000
    assert R.citation_texts(cites).count() == 3


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).select(F.col("id").cast("string").alias("x"))
    one = R.dataset_fingerprint(a.orderBy("x"), ["x"]).first()
    assert one == R.dataset_fingerprint(a.orderBy(F.desc("x")), ["x"]).first()
    assert one != R.dataset_fingerprint(a.unionByName(a), ["x"]).first()
