"""Roll-up of many grains, audits and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditgrain.operators import rollup as R
from auditgrain.plans.base import (
    AS_OF, annual, citations, faulty_citations, faulty_projects, inspections, project_rows, projects, with_views,
)
from auditgrain.plans.registry import query

ROLLED_SQL = """
SELECT p.id AS inspection_id, p.fei AS fei_number, p.company AS company_name, p.date AS inspection_date,
  CASE p.rank WHEN 2 THEN 'OAI' WHEN 1 THEN 'VAI' ELSE 'NAI' END AS classification, p.project_area, p.product_type, p.posted_citation_indicator,
  p.source_project_rows, coalesce(c.n, 0) AS available_citation_count, c.observation_text, 'FEI ' || p.fei || ' · Location unavailable' AS site_name,
  CAST(DATE '2001-06-30' - p.date AS INTEGER) AS inspection_recency
FROM (SELECT id, min(fei) AS fei, min(company) AS company, min(date) AS date,
        max(CASE classification WHEN 'OAI' THEN 2 WHEN 'VAI' THEN 1 ELSE 0 END) AS rank,
        string_agg(DISTINCT project, ' | ' ORDER BY project) AS project_area, string_agg(DISTINCT product, ' | ' ORDER BY product) AS product_type,
        max(CASE posted WHEN 'Yes' THEN 1 ELSE 0 END) AS posted_citation_indicator, count(*) AS source_project_rows FROM project_rows GROUP BY id) p
LEFT JOIN (SELECT id, count(*) AS n, string_agg(coalesce(long, short), chr(10) || chr(10) ORDER BY source_row) AS observation_text FROM citations GROUP BY id) c USING (id)"""


def rolled(spark, d):
    """Both sides come from one view of five tables. Its rows lie by id, so that neither side is shuffled to be grouped."""
    rows = project_rows(spark, d, by_id=True)
    return R.roll_up_projects(projects(rows), citations(rows), AS_OF)


@query("JOI-1", "roll_up_projects", with_views("project_rows citations", ROLLED_SQL))
def _(spark, d):
    return rolled(spark, d).select(
        "inspection_id", "fei_number", "company_name", "inspection_date", "classification", "project_area", "product_type",
        "posted_citation_indicator", "source_project_rows", "available_citation_count", "observation_text", "site_name", "inspection_recency",
    )


def _record_sql(fields: str, source: str) -> str:
    return f"SELECT id, list({{{', '.join(f'{f!r}: {f}' for f in fields.split())}}} ORDER BY source_row) AS rows FROM {source} GROUP BY id"


@query("JOI-1", "rollup_record", with_views("project_rows citations", """SELECT p.id AS inspection_id, array_to_string(areas, ',') AS project_areas, array_to_string(types, ',') AS product_types,
array_to_string(list_transform(p.rows, lambda r: r.project || ':' || r.classification || ':' || r.source_row), ';') AS project_classifications,
to_json({'inspection_rows': p.rows, 'citation_rows': coalesce(c.rows, [])})::VARCHAR AS source_record
FROM p LEFT JOIN c USING (id) JOIN (SELECT id, list(DISTINCT project ORDER BY project) AS areas, list(DISTINCT product ORDER BY product) AS types FROM project_rows GROUP BY id) USING (id)""", [
    ("narrow", "SELECT *, NULL::VARCHAR AS city, NULL::VARCHAR AS state FROM (SELECT * EXCLUDE (city, state) FROM (SELECT NULL AS city, NULL AS state, * FROM project_rows))"),
    ("p", _record_sql("source_row city classification company country date fei fiscal_year posted product project state", "narrow")),
    ("c", _record_sql("source_row date fei long program reference short", "citations")),
]))
def _(spark, d):
    record = lambda r: F.concat_ws(":", r["project_area"], r["classification"], r["source_row"])
    return rolled(spark, d).select(
        "inspection_id", F.array_join("project_areas", ",").alias("project_areas"), F.array_join("product_types", ",").alias("product_types"),
        F.array_join(F.transform("project_classifications", record), ";").alias("project_classifications"), "source_record",
    )


@query("JOI-2", "validate_rollup", with_views("faulty_projects faulty_citations", """
SELECT id, 'Conflicting FEI/date' AS violation FROM faulty_projects GROUP BY id HAVING count(DISTINCT date) > 1 OR count(DISTINCT fei) > 1
UNION ALL SELECT id, 'Future inspection date' FROM faulty_projects GROUP BY id HAVING max(date) > DATE '2001-06-30'
UNION ALL SELECT DISTINCT id, 'Unknown source classification' FROM faulty_projects WHERE classification = 'PENDING'
UNION ALL SELECT DISTINCT c.id, 'Citation identity mismatch' FROM faulty_citations c
  LEFT JOIN (SELECT id, min(fei) AS f, min(date) AS d FROM faulty_projects GROUP BY id) p ON p.id = c.id WHERE c.fei IS DISTINCT FROM p.f OR c.date IS DISTINCT FROM p.d"""))
def _(spark, d):
    rows = project_rows(spark, d)
    return R.validate_rollup(faulty_projects(rows), faulty_citations(rows), AS_OF)


@query("JOI-3", "orphan_citations", with_views("faulty_citations inspections", """SELECT source_row, id, fei FROM faulty_citations c
WHERE NOT EXISTS (SELECT 1 FROM inspections i WHERE i.inspection_id = c.id AND i.fei_number = c.fei AND i.inspection_date = c.date)"""))
def _(spark, d):
    known = inspections(spark, d).select(
        F.col("inspection_id").alias("id"), F.col("fei_number").alias("fei"), F.col("inspection_date").alias("date")
    )
    return R.orphan_citations(faulty_citations(project_rows(spark, d)), known).select("source_row", "id", "fei")


@query("JOI-4", "matched_citations", with_views("faulty_citations inspections", """SELECT count(*) AS matched_rows, count(DISTINCT c.id) AS matched_inspections
FROM faulty_citations c WHERE EXISTS (SELECT 1 FROM inspections i WHERE i.inspection_id = c.id AND i.fei_number = c.fei AND i.inspection_date = c.date)"""))
def _(spark, d):
    known = inspections(spark, d).select(
        F.col("inspection_id").alias("id"), F.col("fei_number").alias("fei"), F.col("inspection_date").alias("date")
    )
    return R.matched_citations(faulty_citations(project_rows(spark, d)), known)


@query("AGG-4", "rollup_quality", with_views("project_rows citations", """
SELECT (SELECT count(*) FROM project_rows) AS total_records, count(*) AS valid_records, (SELECT count(*) FROM project_rows) - count(*) AS merged_project_rows,
  count(*) AS missing_citation_flag, sum(CASE WHEN observation_text IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_observation_text,
  sum(CASE WHEN classification = 'NAI' THEN 1 ELSE 0 END)::BIGINT AS "class_NAI", sum(CASE WHEN classification = 'OAI' THEN 1 ELSE 0 END)::BIGINT AS "class_OAI",
  sum(posted_citation_indicator)::BIGINT AS posted_citation_inspections,
  round(100 * (1 - (3 * count(*) + sum(CASE WHEN observation_text IS NULL THEN 1 ELSE 0 END)) / CAST(count(*) * 14 AS DOUBLE)), 2) AS data_completeness_pct
FROM rolled""", [("rolled", ROLLED_SQL)]))
def _(spark, d):
    rows = project_rows(spark, d)
    return R.rollup_quality(projects(rows), rolled(spark, d)).select(
        "total_records", "valid_records", "merged_project_rows", "missing_citation_flag", "missing_observation_text", "class_NAI", "class_OAI",
        "posted_citation_inspections", "data_completeness_pct",
    )


@query("AGG-5", "source_audit", with_views("faulty_projects citations annual", """
SELECT section, label, measure, value FROM (
SELECT 'inspections' AS section, '' AS label, unnest(['rows', 'inspections', 'sites', 'min_date', 'max_date']) AS measure, unnest([CAST(count(*) AS VARCHAR),
  CAST(count(DISTINCT id) AS VARCHAR), CAST(count(DISTINCT fei) AS VARCHAR), CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR)]) AS value FROM faulty_projects
UNION ALL SELECT 'inspections', '', 'conflicting_ids', CAST(count(*) AS VARCHAR) FROM (SELECT id FROM faulty_projects GROUP BY id HAVING count(DISTINCT fei) > 1 OR count(DISTINCT date) > 1)
UNION ALL SELECT 'inspections', '', 'multi_class_ids', CAST(count(*) AS VARCHAR) FROM (SELECT id FROM faulty_projects GROUP BY id HAVING count(DISTINCT classification) > 1)
UNION ALL SELECT 'classification', classification, 'n', CAST(count(*) AS VARCHAR) FROM faulty_projects GROUP BY classification
UNION ALL SELECT 'posted', posted, 'n', CAST(count(*) AS VARCHAR) FROM faulty_projects GROUP BY posted
UNION ALL SELECT 'duplicate_examples', id, unnest(['n', 'classifications', 'projects']), unnest([CAST(n AS VARCHAR), c, p]) FROM (
  SELECT id, count(*) AS n, string_agg(DISTINCT classification, ',' ORDER BY classification) AS c, string_agg(DISTINCT project, ',' ORDER BY project) AS p
  FROM faulty_projects GROUP BY id HAVING count(*) > 1 ORDER BY n DESC, id LIMIT 5)
UNION ALL SELECT 'citations', '', unnest(['rows', 'inspections']), unnest([CAST(count(*) AS VARCHAR), CAST(count(DISTINCT id) AS VARCHAR)]) FROM citations
UNION ALL SELECT 'duplicate_citations', '', 'extras', CAST(coalesce(sum(n - 1), 0) AS VARCHAR) FROM (
  SELECT count(*) AS n FROM citations GROUP BY id, fei, date, program, reference, short, long HAVING count(*) > 1)
UNION ALL SELECT 'annual', CAST(year AS VARCHAR), unnest(['citation_categories', 'frequency_sum']), unnest([CAST(count(*) AS VARCHAR), CAST(CAST(sum(frequency) AS BIGINT) AS VARCHAR)]) FROM annual GROUP BY year)"""))
def _(spark, d):
    rows = project_rows(spark, d)
    return R.source_audit(faulty_projects(rows), citations(rows), annual(spark, d))


@query("AGG-6", "reconcile", with_views("project_rows", """
SELECT 'inspections' AS "check", count(DISTINCT id) AS expected, count(DISTINCT id) AS actual, TRUE AS passed FROM project_rows
UNION ALL SELECT 'distinct_ids', count(DISTINCT id), count(DISTINCT id), TRUE FROM project_rows
UNION ALL SELECT 'project_rows', count(*) + 1, count(*), FALSE FROM project_rows
UNION ALL SELECT 'citation_rows', count(*), count(*), TRUE FROM project_rows"""))
def _(spark, d):
    rows = project_rows(spark, d)
    ids = rows.agg(F.countDistinct("id")).scalar()
    n = rows.agg(F.count("*")).scalar()
    # One expectation is wrong on purpose: it must fail.
    return R.reconcile(rolled(spark, d), {"inspections": ids, "distinct_ids": ids, "project_rows": n + 1, "citation_rows": n})


FINGERPRINT_SQL = """SELECT count(*) AS rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {sums})) AS fingerprint FROM (
  SELECT sha256(concat_ws('|', {columns})) AS h FROM {table})"""


def fingerprint_sql(table: str, columns: str) -> str:
    sums = ", ".join(f"CAST(sum(CAST('0x' || substring(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))
    return FINGERPRINT_SQL.format(sums=sums, columns=columns, table=table)


@query("AGG-19", "dataset_fingerprint", with_views("inspections", fingerprint_sql(
    "inspections", "inspection_id, company_name, CAST(inspection_date AS VARCHAR), coalesce(classification, '<null>'), coalesce(observation_text, '<null>')")))
def _(spark, d):
    return R.dataset_fingerprint(
        inspections(spark, d), ["inspection_id", "company_name", "inspection_date", "classification", "observation_text"]
    )
