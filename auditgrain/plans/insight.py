"""Metric layer queries."""

from __future__ import annotations


from auditgrain.operators.semantic import MetricSpec, metric_query, scope_evidence
from auditgrain.plans.base import AS_OF, PARTS, inspections, label_reviews, stored_index, with_views
from auditgrain.plans.observations import DECIDED
from auditgrain.plans.registry import query
from auditgrain.plans.risk import factors_sql


@query("SEM-1", "metric_query", with_views("inspections", """SELECT country, inspection_year AS year, count(*) AS total_inspections, round(sum(citation_indicator)::DOUBLE / nullif(count(citation_indicator), 0), 6) AS citation_rate,
  sum(CASE WHEN classification = 'OAI' THEN 1 ELSE 0 END)::BIGINT AS oai_count, round(sum(CASE WHEN classification = 'OAI' THEN 1.0 ELSE 0 END)::DOUBLE / nullif(count(classification), 0), 6) AS oai_rate,
  count(DISTINCT site_key) AS unique_sites, sum(available_citation_count)::BIGINT AS posted_citations FROM inspections WHERE product_type = 'MACHINERY' AND inspection_year >= 1997 GROUP BY ALL"""))
def _(spark, d):
    spec = MetricSpec(
        ["total_inspections", "citation_rate", "oai_count", "oai_rate", "unique_sites", "posted_citations"], ["country", "year"],
        {"product_type": "MACHINERY", "start_year": 1997}, limit=1000,
    )
    return metric_query(spec, inspections(spark, d))


@query("SEM-1", "metric_query_risk", with_views("inspections", """SELECT company_key AS company, n AS total_inspections, high AS high_risk_sites, critical AS critical_risk_sites, score AS risk_score FROM (
  SELECT i.company_key, count(*) AS n, count(DISTINCT CASE WHEN s.band = 'HIGH' THEN i.site_key END) AS high, count(DISTINCT CASE WHEN s.band = 'CRITICAL' THEN i.site_key END) AS critical
  FROM inspections i JOIN site_risk s ON s.site_key = i.site_key GROUP BY i.company_key) JOIN risk USING (company_key)""", [
    *[(f"s_{n}", s) if n != "risk" else ("site_risk", s) for n, s in [
        (n, s.replace("FROM totals t LEFT JOIN steps", "FROM s_totals t LEFT JOIN s_steps").replace("FROM yearly_rates", "FROM s_yearly_rates").replace("FROM factors", "FROM s_factors")
         .replace("FROM weighted", "FROM s_weighted").replace("FROM scored", "FROM s_scored")) for n, s in factors_sql("site_key")]],
    *factors_sql("company_key")]))
def _(spark, d):
    spec = MetricSpec(["total_inspections", "high_risk_sites", "critical_risk_sites", "risk_score"], ["company"], limit=1000)
    return metric_query(spec, inspections(spark, d), as_of=AS_OF, taxonomy=PARTS).drop("risk_level")


@query("SEM-1", "metric_query_observations", with_views("idx reviews", """SELECT dataset, severity, count(*) AS observation_count, (SELECT count(*) FROM (SELECT theme FROM idx j WHERE j.grain = 'inspection' AND j.dataset = i.dataset AND j.severity = i.severity AND theme <> 'Unclassified'
  GROUP BY theme HAVING count(DISTINCT inspection_id) > 1)) AS recurring_themes, count(CASE WHEN observation_id NOT IN (SELECT observation_id FROM decided) THEN 1 END) AS review_required_count
FROM idx i WHERE grain = 'inspection' GROUP BY dataset, severity""", [DECIDED]))
def _(spark, d):
    index = stored_index(spark, d)
    spec = MetricSpec(["observation_count", "recurring_themes", "review_required_count"], ["dataset", "severity"], grain="observation", limit=1000)
    return metric_query(spec, inspections(spark, d), index, label_reviews(spark, d, index))


@query("SEM-1", "metric_query_page", with_views("inspections", """SELECT company_key AS company, inspection_year AS year, count(*) AS total_inspections, count(*) OVER () AS total_groups FROM inspections
GROUP BY ALL ORDER BY company_key NULLS LAST, inspection_year NULLS LAST LIMIT 30 OFFSET 40"""))
def _(spark, d):
    spec = MetricSpec(["total_inspections"], ["company", "year"], limit=30, offset=40)
    return metric_query(spec, inspections(spark, d), with_total=True)


@query("SEM-2", "scope_evidence", with_views("inspections", """SELECT inspection_id, company_name, site_key, classification, inspection_date, substring(coalesce(observation_text, ''), 1, 1200) AS quote FROM inspections
WHERE classification = 'OAI' ORDER BY inspection_year DESC, inspection_id LIMIT 10 OFFSET 20"""))
def _(spark, d):
    return scope_evidence(inspections(spark, d), {"classification": "OAI"}, 10, 20)


