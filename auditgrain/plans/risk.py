"""Metrics, risk, trend, comparison and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditgrain.operators import alerts as A
from auditgrain.operators import metrics as M
from auditgrain.operators import risk as K
from auditgrain.operators import trend as T
from auditgrain.operators import tagging as G
from auditgrain.plans.base import ALERTS, AS_OF, PARTS, any_word, inspections, theme_list, with_views
from auditgrain.plans.registry import query

CLASSES_SQL = """sum(CASE WHEN classification = 'OAI' THEN 1 ELSE 0 END)::BIGINT AS "OAI", sum(CASE WHEN classification = 'VAI' THEN 1 ELSE 0 END)::BIGINT AS "VAI",
  sum(CASE WHEN classification = 'NAI' THEN 1 ELSE 0 END)::BIGINT AS "NAI", sum(CASE WHEN classification IS NULL THEN 1 ELSE 0 END)::BIGINT AS "Unknown",
  count(classification) AS classification_known,
  round(sum(CASE WHEN classification = 'OAI' THEN 1.0 ELSE 0 END)::DOUBLE / nullif(count(classification), 0), 6) AS oai_rate"""


def metrics_sql(by: str = "", where: str = "TRUE") -> str:
    return f"""SELECT {by + ',' if by else ''} count(*) AS total_inspections, sum(citation_indicator)::BIGINT AS citation_positive, count(citation_indicator) AS citation_known,
  round(sum(citation_indicator)::DOUBLE / nullif(count(citation_indicator), 0), 6) AS citation_rate, {CLASSES_SQL},
  round(sum(observation_count)::DOUBLE / nullif(count(observation_count), 0), 6) AS average_observations, count(observation_count) AS observations_known,
  round(count(inspection_date)::DOUBLE / nullif(count(DISTINCT inspection_year), 0), 6) AS inspection_frequency,
  sum(CASE WHEN DATE '2001-06-30' - inspection_date BETWEEN 0 AND 365 THEN 1 ELSE 0 END)::BIGINT AS recent_inspections,
  count(inspection_date) AS dated_inspections, count(DISTINCT site_key) AS unique_sites,
  sum(posted_citation_indicator)::BIGINT AS posted_citation_inspections, sum(available_citation_count)::BIGINT AS available_citation_rows
FROM inspections WHERE {where} {'GROUP BY ' + by if by else ''}"""


@query("AGG-1", "portfolio_metrics", with_views("inspections", metrics_sql()))
def _(spark, d):
    return M.portfolio_metrics(inspections(spark, d), AS_OF)


@query("AGG-1", "portfolio_metrics_by_company", with_views("inspections", metrics_sql("company_key, product_type")))
def _(spark, d):
    return M.portfolio_metrics(inspections(spark, d), AS_OF, ["company_key", "product_type"])


ANNUAL_SQL = f"SELECT *, inspection_year = 2001 AS partial_year FROM ({metrics_sql('inspection_year')})"


@query("AGG-2", "annual_metrics", with_views("inspections", ANNUAL_SQL))
def _(spark, d):
    return M.annual_metrics(inspections(spark, d), AS_OF)


@query("AGG-7", "annual_class_counts", with_views("inspections", "SELECT inspection_year, classification, count(*) AS inspection_count FROM inspections GROUP BY ALL"))
def _(spark, d):
    return M.annual_class_counts(inspections(spark, d))


MEMBERS = [("members", f"SELECT *, unnest({theme_list('lower(observation_text)', PARTS)}) AS theme FROM inspections")]


@query("AGG-9", "theme_recurrence", with_views("inspections", """SELECT theme, coalesce(site_key, 'Unknown') AS "group", count(DISTINCT inspection_id) AS count,
  greatest(count(DISTINCT inspection_id) - 1, 0) AS repeat_count FROM members GROUP BY ALL""", MEMBERS))
def _(spark, d):
    return M.theme_recurrence(inspections(spark, d), PARTS, "site_key")


@query("AGG-9", "theme_members", with_views("inspections", """SELECT DISTINCT theme, CAST(inspection_year AS VARCHAR) AS "group", inspection_id FROM members""", MEMBERS))
def _(spark, d):
    return M.theme_members(inspections(spark, d), PARTS, "inspection_year")


# ---------------------------------------------------------------------------------------- risk

_FLAGS = ", ".join(
    f"sum(CASE WHEN {any_word('lower(observation_text)', w)} THEN 1 ELSE 0 END) AS t{i}" for i, w in enumerate(PARTS.themes.values())
)
_MOST = "greatest(" + ", ".join(f"t{i}" for i in range(len(PARTS.themes))) + ")"


def factors_sql(key: str, source: str = "inspections", as_of: str = "DATE '2001-06-30'") -> list[tuple[str, str]]:
    """Oracle chain for risk by `key`, ending in `risk`."""
    return [
        ("yearly_rates", f"""SELECT {key}, inspection_year, round(sum(citation_indicator)::DOUBLE / count(citation_indicator), 6) AS r,
            row_number() OVER (PARTITION BY {key} ORDER BY inspection_year DESC) AS rn FROM {source} GROUP BY {key}, inspection_year HAVING count(citation_indicator) > 0"""),
        ("steps", f"SELECT {key}, max(CASE WHEN rn = 1 THEN r END) - max(CASE WHEN rn = 2 THEN r END) AS step FROM yearly_rates GROUP BY {key}"),
        ("totals", f"""SELECT {key}, count(*) AS total, round(sum(citation_indicator)::DOUBLE / nullif(count(citation_indicator), 0), 6) AS cite_rate,
            sum(CASE WHEN classification = 'OAI' THEN 1 ELSE 0 END) AS oai, sum(CASE WHEN classification = 'VAI' THEN 1 ELSE 0 END) AS vai, count(classification) AS known,
            round(sum(observation_count)::DOUBLE / nullif(count(observation_count), 0), 6) AS mean_obs, count(observation_text) AS texts,
            sum(CASE WHEN classification IS NOT NULL OR citation_indicator IS NOT NULL THEN 1 ELSE 0 END) AS dated_known,
            max(CASE WHEN classification IN ('OAI', 'VAI') OR citation_indicator = 1 THEN inspection_date END) AS adverse, {_FLAGS} FROM {source} GROUP BY {key}"""),
        ("factors", f"""SELECT t.*, cite_rate AS f1, (oai + 0.4::DOUBLE * vai) / nullif(known, 0)::DOUBLE AS f2,
            CASE WHEN texts > 0 THEN least(1.0::DOUBLE, greatest({_MOST} - 1, 0) / 3.0::DOUBLE) END AS f3,
            CASE WHEN dated_known > 0 THEN CASE WHEN adverse IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - ({as_of} - adverse) / 730.0::DOUBLE) END END AS f4,
            CASE WHEN mean_obs IS NOT NULL THEN least(1.0::DOUBLE, mean_obs / 5.0::DOUBLE) END AS f5,
            CASE WHEN step IS NOT NULL THEN greatest(0.0::DOUBLE, step) END AS f6 FROM totals t LEFT JOIN steps USING ({key})"""),
        ("weighted", """SELECT *, CAST(CASE WHEN f1 IS NULL THEN 0 ELSE 25 END + CASE WHEN f2 IS NULL THEN 0 ELSE 25 END + CASE WHEN f3 IS NULL THEN 0 ELSE 20 END
            + CASE WHEN f4 IS NULL THEN 0 ELSE 10 END + CASE WHEN f5 IS NULL THEN 0 ELSE 10 END + CASE WHEN f6 IS NULL THEN 0 ELSE 10 END AS DOUBLE) AS available FROM factors"""),
        ("scored", """SELECT *, CASE WHEN available > 0 THEN coalesce(f1 * 25.0::DOUBLE * 100 / available, 0) + coalesce(f2 * 25.0::DOUBLE * 100 / available, 0) + coalesce(f3 * 20.0::DOUBLE * 100 / available, 0)
            + coalesce(f4 * 10.0::DOUBLE * 100 / available, 0) + coalesce(f5 * 10.0::DOUBLE * 100 / available, 0) + coalesce(f6 * 10.0::DOUBLE * 100 / available, 0) END AS raw FROM weighted"""),
        ("risk", """SELECT *, round(raw, 2) AS score, CASE WHEN raw IS NULL THEN 'INSUFFICIENT DATA' WHEN raw >= 80 THEN 'CRITICAL' WHEN raw >= 60 THEN 'HIGH' WHEN raw >= 30 THEN 'MODERATE' ELSE 'LOW' END AS band,
            round(available / 100.0 * 100, 2) AS coverage_pct, concat_ws(',', CASE WHEN f1 IS NULL THEN 'citation_history' END, CASE WHEN f2 IS NULL THEN 'classification_history' END,
            CASE WHEN f3 IS NULL THEN 'recurring_deficiencies' END, CASE WHEN f4 IS NULL THEN 'recency' END, CASE WHEN f5 IS NULL THEN 'severity' END, CASE WHEN f6 IS NULL THEN 'negative_trend' END) AS missing FROM scored"""),
    ]


def site_summary(spark, d):
    return K.entity_summary(inspections(spark, d), "site", AS_OF, taxonomy=PARTS)


@query("RSK-2", "risk_score", with_views("inspections", """SELECT site_key, total, score, band, coverage_pct, missing, round(f3, 6) AS recurring_factor,
  round(f4 * 10.0::DOUBLE * 100 / available, 2) AS recency_points FROM risk""", factors_sql("site_key")))
def _(spark, d):
    risk = K.risk_score(inspections(spark, d), ["site_key"], AS_OF, taxonomy=PARTS)
    part = lambda i, f: F.get("components", F.lit(i)).getField(f)
    return risk.select(
        "site_key", "total", "score", "band", "coverage_pct", F.array_join("missing_factors", ",").alias("missing"),
        part(2, "factor").alias("recurring_factor"), part(3, "points").alias("recency_points"),
    )


NAMED_SQL = """SELECT company_key, max(inspection_date) AS d, arg_max(company_name, inspection_date) AS company_name,
  string_agg(DISTINCT country, ', ' ORDER BY country) AS country FROM inspections GROUP BY company_key"""


@query("RSK-3", "entity_summary", with_views("inspections", """
SELECT 'company' AS kind, company_key AS entity_key, company_name, country, total AS inspections, score, band, coverage_pct FROM risk JOIN named USING (company_key)
UNION ALL SELECT 'site', site_key, company_name, country, n, NULL, NULL, NULL FROM (SELECT site_key, first(company_name ORDER BY inspection_date DESC, inspection_id) AS company_name,
  string_agg(DISTINCT country, ', ' ORDER BY country) AS country, count(*) AS n FROM inspections GROUP BY site_key)""", [("named", NAMED_SQL), *factors_sql("company_key")]))
def _(spark, d):
    columns = ["kind", "entity_key", "company_name", "country", "inspections"]
    measures = ["score", "band", "coverage_pct"]
    company = K.entity_summary(inspections(spark, d), "company", AS_OF, taxonomy=PARTS).select(*columns, *measures)
    site = site_summary(spark, d)
    return company.unionByName(site.select(*columns, *[F.lit(None).cast(company.schema[m].dataType).alias(m) for m in measures]))


@query("RSK-4", "rank_entities", with_views("inspections", """SELECT site_key AS entity_key, score, band, count(*) OVER () AS total_rows FROM risk WHERE band = 'MODERATE'
ORDER BY score DESC NULLS LAST, site_key LIMIT 25 OFFSET 10""", factors_sql("site_key")))
def _(spark, d):
    return K.rank_entities(site_summary(spark, d), band="MODERATE", limit=25, offset=10).select("entity_key", "score", "band", "total_rows")


@query("RSK-5", "top_risk_drivers", with_views("inspections", """SELECT entity_key, driver_rank, factor, points FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY points DESC, factor) AS driver_rank FROM (
SELECT site_key AS entity_key, unnest(['citation_history', 'classification_history', 'recurring_deficiencies', 'recency', 'severity', 'negative_trend']) AS factor,
 unnest([round(f1 * 25.0::DOUBLE * 100 / available, 2), round(f2 * 25.0::DOUBLE * 100 / available, 2), round(f3 * 20.0::DOUBLE * 100 / available, 2), round(f4 * 10.0::DOUBLE * 100 / available, 2),
 round(f5 * 10.0::DOUBLE * 100 / available, 2), round(f6 * 10.0::DOUBLE * 100 / available, 2)]) AS points FROM risk) WHERE points IS NOT NULL) WHERE driver_rank <= 3""", factors_sql("site_key")))
def _(spark, d):
    return K.top_risk_drivers(site_summary(spark, d), 3)


@query("AGG-20", "risk_distribution", with_views("inspections", """SELECT band, count(site_key) AS entities FROM (SELECT unnest(['LOW', 'MODERATE', 'HIGH', 'CRITICAL', 'INSUFFICIENT DATA']) AS band)
LEFT JOIN risk USING (band) GROUP BY band""", factors_sql("site_key")))
def _(spark, d):
    return K.risk_distribution(K.risk_score(inspections(spark, d), ["site_key"], AS_OF, taxonomy=PARTS))


PAIR = "('household nation_3', 'machinery nation_7')"
PAIR_VIEW = [("pair", f"SELECT * FROM inspections WHERE company_key IN {PAIR}")]


@query("RSK-6", "compare_entities", with_views("inspections", f"""SELECT company_key, 'risk' AS what, band AS label, score AS value FROM risk
UNION ALL SELECT company_key, 'recurrence', theme, count(DISTINCT inspection_id) FROM (SELECT *, unnest({theme_list('lower(observation_text)', PARTS)}) AS theme FROM pair) GROUP BY company_key, theme
UNION ALL SELECT company_key, 'inspections', CAST(inspection_year AS VARCHAR), count(*) FROM pair GROUP BY ALL""", [*PAIR_VIEW, *factors_sql("company_key", "pair")]))
def _(spark, d):
    parts = K.compare_entities(inspections(spark, d), "company_key", ["household nation_3", "machinery nation_7"], AS_OF, taxonomy=PARTS)
    risk = parts["risk"].select("company_key", F.lit("risk").alias("what"), F.col("band").alias("label"), F.col("score").alias("value"))
    recurrence = parts["recurrence"].select("company_key", F.lit("recurrence").alias("what"), F.col("theme").alias("label"), F.col("count").cast("double").alias("value"))
    years = parts["trend"].select(
        "company_key", F.lit("inspections").alias("what"), F.col("inspection_year").cast("string").alias("label"), F.col("total_inspections").cast("double").alias("value")
    )
    return risk.unionByName(recurrence).unionByName(years)


# --------------------------------------------------------------------------------------- trend

_CH = ", ".join(
    f"""round(CAST(b."{m}" - a."{m}" AS DOUBLE){' * 100' if m.endswith('_rate') else ''}, 6) AS "{m}{'_percentage_point_change' if m.endswith('_rate') else '_change'}\""""
    for m in T.CHANGE_METRICS
)


@query("TRD-1", "period_change", with_views("inspections", f"""SELECT a.inspection_year AS previous_year, b.inspection_year AS latest_year, b.partial_year,
  (SELECT arg_max(inspection_year, total_inspections) FROM annual_m) AS highest_volume_year, {_CH}
FROM annual_m a JOIN annual_m b ON b.inspection_year = (SELECT max(inspection_year) FROM annual_m) AND a.inspection_year = b.inspection_year - 1""", [("annual_m", ANNUAL_SQL)]))
def _(spark, d):
    return T.period_change(M.annual_metrics(inspections(spark, d), AS_OF))


YEARS = [
    ("cuts", """SELECT DISTINCT site_key AS s, inspection_year AS y, least(make_date(inspection_year, 12, 31), DATE '2001-06-30') AS cutoff FROM inspections"""),
    ("history", """SELECT i.*, s || '/' || CAST(y AS VARCHAR) AS sy, s, y, cutoff FROM cuts JOIN inspections i ON i.site_key = s AND i.inspection_date <= cutoff"""),
]
_TREND_CHAIN = factors_sql("sy", "history", "cut")
_TREND_CHAIN = [
    (n, s.replace("FROM totals t LEFT JOIN steps USING (sy)", "FROM (SELECT totals.*, c.cutoff AS cut FROM totals JOIN (SELECT DISTINCT sy, cutoff FROM history) c USING (sy)) t LEFT JOIN steps USING (sy)"))
    for n, s in _TREND_CHAIN
]
TREND_SQL = """SELECT c.s AS site_key, c.y AS inspection_year, m.total_inspections, m.citation_rate, m.oai_rate, m.recurring_themes, c.cutoff < make_date(c.y, 12, 31) AS partial_year,
  r.score, coalesce(r.band, 'INSUFFICIENT DATA') AS band FROM cuts c LEFT JOIN risk r ON r.sy = c.s || '/' || CAST(c.y AS VARCHAR)
JOIN (SELECT site_key, inspection_year, count(*) AS total_inspections, round(sum(citation_indicator)::DOUBLE / nullif(count(citation_indicator), 0), 6) AS citation_rate,
  round(sum(CASE WHEN classification = 'OAI' THEN 1.0 ELSE 0 END)::DOUBLE / nullif(count(classification), 0), 6) AS oai_rate,
  array_to_string(""" + theme_list("lower(string_agg(observation_text, ' '))", PARTS) + """, ',') AS recurring_themes
  FROM inspections GROUP BY ALL) m ON m.site_key = c.s AND m.inspection_year = c.y"""


ONE = "SELECT * FROM inspections WHERE company_key = 'household nation_3'"
#: The entity's history at each of its years, and, as year 0, all of it.
ONE_HISTORY = [
    ("one", ONE),
    ("cuts", "SELECT DISTINCT inspection_year AS y, least(make_date(inspection_year, 12, 31), DATE '2001-06-30') AS cutoff FROM one UNION ALL SELECT 0, DATE '2001-06-30'"),
    ("history", "SELECT i.*, CAST(y AS VARCHAR) AS sy, y, cutoff FROM cuts JOIN one i ON y = 0 OR i.inspection_date <= cutoff"),
]


@query("RSK-7", "entity_profile", with_views("inspections", f"""SELECT 'risk' AS what, band AS label, score AS value FROM risk WHERE sy = '0'
UNION ALL SELECT 'trend', CAST(c.y AS VARCHAR) || ' ' || coalesce(r.band, 'INSUFFICIENT DATA'), r.score FROM cuts c LEFT JOIN risk r ON r.sy = CAST(c.y AS VARCHAR) WHERE c.y > 0
UNION ALL SELECT 'recurrence', theme, count(DISTINCT inspection_id) FROM (SELECT *, unnest({theme_list('lower(observation_text)', PARTS)}) AS theme FROM one) GROUP BY theme
UNION ALL SELECT 'record', inspection_id, inspection_year FROM one""", [*ONE_HISTORY, *_TREND_CHAIN]))
def _(spark, d):
    profile = K.entity_profile(inspections(spark, d), "company_key", "household nation_3", AS_OF, taxonomy=PARTS)
    part = lambda name, label, value: profile[name].select(F.lit(name).alias("what"), label.cast("string").alias("label"), F.col(value).cast("double").alias("value"))
    year = F.concat_ws(" ", F.col("inspection_year").cast("string"), "band")
    records = part("records", F.col("inspection_id"), "inspection_year").withColumn("what", F.lit("record"))
    return part("risk", F.col("band"), "score").unionByName(part("trend", year, "score")).unionByName(part("recurrence", F.col("theme"), "count")).unionByName(records)


@query("TRD-2", "risk_trend", with_views("inspections", TREND_SQL, [*YEARS, *_TREND_CHAIN]))
def _(spark, d):
    trend = T.risk_trend(inspections(spark, d), ["site_key"], AS_OF, taxonomy=PARTS)
    return trend.withColumn("recurring_themes", F.array_join("recurring_themes", ",")).select(
        "site_key", "inspection_year", "total_inspections", "citation_rate", "oai_rate", "recurring_themes", "partial_year", "score", "band"
    )


@query("TRD-5", "risk_change", with_views("inspections", f"""SELECT site_key, count(*) AS years, arg_min(score, inspection_year) AS first_score, arg_max(score, inspection_year) AS last_score,
  CASE WHEN count(*) >= 2 THEN round(arg_max(score, inspection_year) - arg_min(score, inspection_year), 2) END AS risk_change_points
FROM (SELECT * FROM ({TREND_SQL}) WHERE score IS NOT NULL) GROUP BY site_key""", [*YEARS, *_TREND_CHAIN]))
def _(spark, d):
    trend = T.risk_trend(inspections(spark, d), ["site_key"], AS_OF, taxonomy=PARTS)
    return T.risk_change(trend.filter(F.col("score").isNotNull()), ["site_key"])


@query("TRD-3", "theme_change", with_views("inspections", f"""SELECT theme, 1995 AS start_year, 2001 AS end_year, a AS start_count, b AS end_count, b - a AS change FROM (
SELECT theme, count(DISTINCT CASE WHEN inspection_year = 1995 THEN inspection_id END) AS a, count(DISTINCT CASE WHEN inspection_year = 2001 THEN inspection_id END) AS b
FROM members GROUP BY theme)""", MEMBERS))
def _(spark, d):
    return T.theme_change(inspections(spark, d), taxonomy=PARTS)


@query("TRD-6", "chart_facts", with_views("inspections", """SELECT (SELECT max(inspection_year) FROM annual_m) AS latest_year, l.total_inspections AS latest_inspections, TRUE AS latest_partial,
  l.oai_rate AS latest_oai_rate, 2000 AS complete_year, 1999 AS previous_complete_year, b.total_inspections - a.total_inspections AS complete_change,
  CASE greatest(p."NAI", p."VAI", p."OAI") WHEN p."NAI" THEN 'NAI' WHEN p."VAI" THEN 'VAI' ELSE 'OAI' END AS leading_class, greatest(p."NAI", p."VAI", p."OAI") AS leading_count,
  round(greatest(p."NAI", p."VAI", p."OAI")::DOUBLE / p.total_inspections, 6) AS leading_share,
  (SELECT count(*) FROM risk WHERE band = 'HIGH') AS high_sites, (SELECT count(*) FROM risk WHERE band = 'CRITICAL') AS critical_sites, (SELECT count(*) FROM risk) AS all_sites
FROM annual_m l, annual_m a, annual_m b, portfolio p WHERE l.inspection_year = 2001 AND a.inspection_year = 1999 AND b.inspection_year = 2000""",
    [("annual_m", ANNUAL_SQL), ("portfolio", metrics_sql()), *factors_sql("site_key")]))
def _(spark, d):
    df = inspections(spark, d)
    bands = K.risk_distribution(K.risk_score(df, ["site_key"], AS_OF, taxonomy=PARTS))
    return T.chart_facts(M.annual_metrics(df, AS_OF), M.portfolio_metrics(df, AS_OF), bands)


# -------------------------------------------------------------------------------------- alerts

@query("ALR-1", "alert_high_risk", with_views("inspections", "SELECT site_key AS entity_key, score, band FROM risk WHERE band IN ('HIGH', 'CRITICAL')", factors_sql("site_key")))
def _(spark, d):
    return A.alert_high_risk(site_summary(spark, d)).select("entity_key", "score", "band")


@query("ALR-2", "alert_repeated_oai", with_views("inspections", "SELECT site_key, count(*) AS oai_inspections FROM inspections WHERE classification = 'OAI' GROUP BY site_key HAVING count(*) >= 2"))
def _(spark, d):
    return A.alert_repeated_oai(inspections(spark, d), 2)


LAST_TWO = [
    ("yr", """SELECT site_key, inspection_year AS y, count(citation_indicator) AS known, round(sum(citation_indicator)::DOUBLE / nullif(count(citation_indicator), 0), 6) AS rate,
      row_number() OVER (PARTITION BY site_key ORDER BY inspection_year DESC) AS rn FROM inspections GROUP BY site_key, inspection_year"""),
    ("two", """SELECT a.site_key, a.y AS previous_year, b.y AS latest_year, a.known AS previous_known, b.known AS latest_known, a.rate AS previous_rate, b.rate AS latest_rate
      FROM yr a JOIN yr b ON a.site_key = b.site_key AND a.rn = 2 AND b.rn = 1"""),
]


@query("ALR-3", "alert_rate_increase", with_views("inspections", "SELECT * FROM two WHERE previous_known >= 2 AND latest_known >= 2 AND latest_rate - previous_rate >= 0.2", LAST_TWO))
def _(spark, d):
    return A.alert_rate_increase(inspections(spark, d), 2, 0.2)


@query("ALR-4", "alert_recurring_theme", with_views("inspections", "SELECT site_key, count(DISTINCT inspection_id) AS theme_inspections FROM members WHERE theme = 'Promotion' GROUP BY site_key HAVING count(DISTINCT inspection_id) >= 3", MEMBERS))
def _(spark, d):
    return A.alert_recurring_theme(inspections(spark, d), "Promotion", 3, PARTS)


SEVERE = f"observation_text IS NOT NULL AND ({any_word('lower(observation_text)', PARTS.rule_critical)} OR {any_word('lower(observation_text)', PARTS.rule_high)})"
LATEST = ("latest", f"""SELECT site_key, inspection_date AS latest_date, sum(CASE WHEN {SEVERE} THEN 1 ELSE 0 END)::BIGINT AS severe_inspections FROM inspections
  WHERE (site_key, inspection_date) IN (SELECT site_key, max(inspection_date) FROM inspections GROUP BY site_key) GROUP BY ALL""")


@query("ALR-5", "alert_new_severe", with_views("inspections", "SELECT * FROM latest WHERE DATE '2001-06-30' - latest_date BETWEEN 0 AND 365 AND severe_inspections > 0", [LATEST]))
def _(spark, d):
    return A.alert_new_severe(inspections(spark, d), AS_OF, 365, PARTS)


EVIDENCE_SQL = f"""
SELECT 'HIGH_RISK_SITE' AS code, site_key, inspection_id FROM inspections WHERE site_key IN (SELECT site_key FROM risk WHERE band IN ('HIGH', 'CRITICAL'))
UNION ALL SELECT 'REPEATED_OAI', site_key, inspection_id FROM inspections WHERE classification = 'OAI' AND site_key IN (SELECT site_key FROM risk WHERE oai >= 2)
UNION ALL SELECT 'CITATION_RATE_INCREASE', i.site_key, inspection_id FROM inspections i JOIN two USING (site_key) WHERE previous_known >= 1 AND latest_known >= 1
  AND latest_rate - previous_rate >= 0.2 AND inspection_year IN (previous_year, latest_year) AND citation_indicator IS NOT NULL
UNION ALL SELECT 'RECURRING_DATA_INTEGRITY', site_key, inspection_id FROM members WHERE theme = 'Promotion' AND site_key IN (SELECT site_key FROM members WHERE theme = 'Promotion' GROUP BY site_key HAVING count(DISTINCT inspection_id) >= 3)
UNION ALL SELECT 'NEW_HIGH_SEVERITY_SIGNAL', i.site_key, inspection_id FROM inspections i JOIN latest l ON l.site_key = i.site_key AND inspection_date = latest_date
  WHERE DATE '2001-06-30' - latest_date BETWEEN 0 AND 365 AND {SEVERE}"""
ALERT_CHAIN = [*MEMBERS, *LAST_TWO, LATEST, *factors_sql("site_key")]


@query("ALR-6", "site_alerts", with_views("inspections", f"SELECT code, site_key, count(*) AS evidence_count FROM ({EVIDENCE_SQL}) GROUP BY ALL", ALERT_CHAIN))
def _(spark, d):
    return A.site_alerts(inspections(spark, d), AS_OF, rules=ALERTS, taxonomy=PARTS).select("code", "site_key", "evidence_count")


@query("ALR-6", "alert_evidence", with_views("inspections", EVIDENCE_SQL, ALERT_CHAIN))
def _(spark, d):
    return A.alert_evidence(inspections(spark, d), AS_OF, rules=ALERTS, taxonomy=PARTS).select("code", "site_key", "inspection_id")


@query("ALR-6", "top_site_alerts", with_views("inspections", f"""SELECT code, site_key, count(*) AS evidence_count FROM ({EVIDENCE_SQL})
WHERE site_key IN (SELECT site_key FROM risk ORDER BY score DESC NULLS LAST, site_key LIMIT 20) GROUP BY ALL""", ALERT_CHAIN))
def _(spark, d):
    out = A.top_site_alerts(inspections(spark, d), site_summary(spark, d), AS_OF, rules=ALERTS, taxonomy=PARTS)
    return out.select("code", "site_key", "evidence_count")


@query("TAG-1", "tag_themes", with_views("inspections", f"SELECT inspection_id, array_to_string(coalesce({theme_list('lower(observation_text)', PARTS)}, []), ',') AS themes FROM inspections"))
def _(spark, d):
    return G.tag_themes(inspections(spark, d), PARTS).select("inspection_id", F.array_join("themes", ",").alias("themes"))


@query("TAG-2", "rule_analysis", with_views("inspections", f"""SELECT inspection_id, coalesce(t[1], 'Unclassified') AS theme, CASE WHEN len(t) > 0 THEN 'Quality and compliance' ELSE 'Unclassified' END AS category,
  CASE WHEN {any_word('lower(observation_text)', PARTS.rule_critical)} THEN 'Critical' WHEN {any_word('lower(observation_text)', PARTS.rule_high)} THEN 'High' WHEN len(t) > 0 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN len(t) > 0 THEN 0.65 ELSE 0.2 END AS confidence FROM (SELECT *, {theme_list('lower(observation_text)', PARTS)} AS t FROM inspections WHERE observation_text IS NOT NULL)"""))
def _(spark, d):
    df = inspections(spark, d).filter(F.col("observation_text").isNotNull())
    return G.rule_analysis(df, PARTS).select("inspection_id", "theme", "category", "severity", "confidence")
