"""Registered queries against their oracles on the smallest tables, one or two per family."""

import datetime
import decimal
import math

import duckdb
import pytest

from auditgrain.plans.registry import load_all

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
PICKED = [
    "src4_load_annual", "prj8_rejection_reason", "set2_canonicalize", "agg3_quality_report", "joi1_roll_up_projects", "joi2_validate_rollup",
    "agg5_source_audit", "agg1_portfolio_metrics", "agg2_annual_metrics", "rsk4_rank_entities", "trd2_risk_trend", "trd6_chart_facts",
    "alr6_site_alerts", "qc6_linear_forecast", "set6_dedupe_observations", "agg10_observation_theme_metrics", "agg15_observation_insights",
    "win5_apply_reviews", "tag3_classify_observation", "tag6_tag_rubric", "tag7_verify_tags", "joi10_match_entity_mentions",
    "joi11_text_similarity_join", "rtr1_chunk_documents", "rtr2_vector_search", "rtr4_fulltext_search", "rtr4_fulltext_phrase", "rtr4_fulltext_either", "rtr4_fulltext_without", "rtr4_fulltext_stems", "rtr5_hybrid_search", "rtr3_keyword_search", "rtr8_admit_documents", "tag13_lsh_signatures", "tag12_group_part_texts", "rsk7_entity_profile", "joi1_rollup_record", "sem1_metric_query_page", "win2_recency_rank", "prj19_redact_json_keys", "evl1_grounding_check",
    "sem1_metric_query_risk",
]


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return round(float(v), 5)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_oracle(spark, small, oracle, name):
    q = load_all()[name]
    df = q.plan(spark, small)
    columns = sorted(df.columns)
    result = oracle.execute(q.sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == want


def test_every_survey_family_is_registered():
    ids = {q.survey_id for q in load_all().values()}
    sizes = {"SRC": 7, "SNK": 6, "PRJ": 21, "JOI": 12, "AGG": 20, "TRD": 6, "ALR": 6, "SEM": 2, "QC": 10, "WIN": 7, "SRT": 4, "SET": 8,
             "TAG": 13, "RTR": 8, "EVL": 6}
    want = {f"{family}-{i}" for family, n in sizes.items() for i in range(1, n + 1)} | {f"RSK-{i}" for i in range(2, 8)}
    assert want <= ids
