"""Observation corpus, index, aggregates and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditgrain.operators import browse as B
from auditgrain.operators import observations as O
from auditgrain.operators import ranking as P
from auditgrain.operators import reviews as V
from auditgrain.operators import tagging as G
from auditgrain.operators import trend as T
from auditgrain.plans.base import (
    PARTS, annual, label_reviews, labelled_index, observation_sources, stored_index, table, theme_list, with_views,
)
from auditgrain.plans.registry import query
from auditgrain.session import fresh_path, steps_dropped
from auditgrain.sources import writers


@query("SET-3", "quarantine_observations", with_views("obs_checked", "SELECT source_file, source_row, dataset, reason FROM obs_checked WHERE reason IS NOT NULL"))
def _(spark, d):
    return O.quarantine_observations(observation_sources(spark, d))[1].select("source_file", "source_row", "dataset", "reason")


@query("SET-4", "dedupe_texts", r"""SELECT DISTINCT sha256(t) AS hash, t AS text FROM (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def _(spark, d):
    return O.dedupe_texts(table(spark, d, "documents"))


@query("SET-5", "resolve_identity", with_views("obs_keyed", "SELECT source_row, iid AS inspection_id, identity_conflict, first_company AS existing_company FROM obs_keyed"))
def _(spark, d):
    accepted = O.quarantine_observations(observation_sources(spark, d))[0]
    return O.resolve_identity(accepted).select(
        "source_row", "inspection_id", "identity_conflict", "existing_company"
    )


@query("SET-6", "dedupe_observations", with_views("observations", "SELECT observation_id, hash, dataset, grain, inspection_id, company, site, year, frequency, occurrences FROM observations"))
def _(spark, d):
    return O.build_corpus(observation_sources(spark, d))["observations"].select(
        "observation_id", "hash", "dataset", "grain", "inspection_id", "company", "site", "year", "frequency", "occurrences"
    )


@query("SET-6", "observation_origins", with_views("obs_identified", "SELECT DISTINCT obs_id AS observation_id, source_file, source_row FROM obs_identified"))
def _(spark, d):
    return O.build_corpus(observation_sources(spark, d))["origins"]


@query("SET-7", "corpus_quality", with_views("observations obs_checked obs_texts", """
SELECT 'totals' AS section, unnest(['total_records', 'valid_records', 'invalid_records', 'empty_text_rows']) AS label, unnest([count(*), count(*) - count(reason), count(reason),
  sum(CASE WHEN reason = 'Empty or nontext observation' THEN 1 ELSE 0 END)::BIGINT]) AS n FROM obs_checked
UNION ALL SELECT 'totals', unnest(['identity_conflicts', 'variant_conflicts', 'total_inspections']), unnest([sum(CASE WHEN identity_conflict THEN 1 ELSE 0 END)::BIGINT,
  sum(CASE WHEN variant_conflict THEN 1 ELSE 0 END)::BIGINT, count(DISTINCT iid)]) FROM obs_identified
UNION ALL SELECT 'totals', unnest(['total_observations', 'duplicate_observation_rows']), unnest([count(*), sum(occurrences - 1)::BIGINT]) FROM observations
UNION ALL SELECT 'totals', 'unique_observation_texts', count(*) FROM obs_texts
UNION ALL SELECT 'datasets', dataset || '/' || grain, count(*) FROM observations GROUP BY ALL"""))
def _(spark, d):
    sources = observation_sources(spark, d)
    return O.corpus_quality(sources, O.build_corpus(sources))


@query("SET-8", "conflicts", with_views("obs_identified", """
SELECT 'identity' AS kind, inspection_id AS identity, concat_ws('|', coalesce(first_fei, ''), coalesce(first_date, ''), coalesce(first_company, '')) AS existing,
  concat_ws('|', coalesce(fei, ''), coalesce(date, ''), coalesce(company, '')) AS incoming, source_row FROM obs_identified WHERE identity_conflict
UNION ALL SELECT 'variant', obs_id, first_hash || '|' || first_dataset, hash || '|' || dataset, source_row FROM obs_identified WHERE variant_conflict"""))
def _(spark, d):
    return O.build_corpus(observation_sources(spark, d))["conflicts"].drop("source_file")


@query("TAG-9", "tag_run", with_views("idx", "SELECT observation_id, hash, theme, severity, confidence, ai_generated, fallback FROM idx"))
def _(spark, d):
    return labelled_index(spark, d).select("observation_id", "hash", "theme", "severity", "confidence", "ai_generated", "fallback")


@query("JOI-6", "build_browse_index", with_views("idx", "SELECT observation_id, inspection_id, dataset, grain, company, site, year, theme, severity, severity_rank FROM idx"))
def _(spark, d):
    return labelled_index(spark, d).select(
        "observation_id", "inspection_id", "dataset", "grain", "company", "site", "year", "theme", "severity", "severity_rank"
    )


@query("PRJ-20", "severity_rank", with_views("idx", "SELECT severity, severity_rank, count(*) AS n FROM idx GROUP BY ALL"))
def _(spark, d):
    return stored_index(spark, d, "severity").groupBy("severity", G.severity_rank(F.col("severity")).alias("severity_rank")).agg(F.count("*").alias("n"))


@query("PRJ-14", "filter_observations", with_views("idx reviews", """SELECT 'scope' AS what, observation_id FROM idx WHERE grain = 'inspection' AND theme = 'Gadgets' AND severity = 'High' AND year BETWEEN 1996 AND 1999 AND dataset = 'real'
UNION ALL SELECT 'open', observation_id FROM idx WHERE grain = 'annual_template' AND product = 'Brand#3' AND observation_id NOT IN (SELECT observation_id FROM (
  SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY revision DESC) AS rn FROM reviews) WHERE rn = 1 AND action IN ('Approve', 'Modify'))"""))
def _(spark, d):
    index = stored_index(spark, d, "run_id", "observation_id", "hash", "dataset", "grain", "year", "product", "theme", "severity")
    a = B.filter_observations(index, theme="Gadgets", severity="High", start_year=1996, end_year=1999, dataset="real", company="")
    decided = V.latest_review(label_reviews(spark, d, index)).filter(F.col("action").isin(*V.DECIDED))
    b = B.filter_observations(index, decided, grain="annual_template", product="Brand#3", review_required=True)
    return a.select(F.lit("scope").alias("what"), "observation_id").unionByName(b.select(F.lit("open").alias("what"), "observation_id"))


DECIDED = ("decided", """SELECT run_id, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, observation_id ORDER BY revision DESC) AS rn FROM reviews) WHERE rn = 1 AND action IN ('Approve', 'Modify')""")


@query("JOI-7", "needs_review", with_views("idx", "SELECT observation_id, theme FROM (SELECT *, CAST('0x' || left(hash, 2) AS INTEGER) AS digit FROM idx) WHERE NOT (digit % 6 = 1 OR (digit % 3 <> 0 AND digit % 2 = 0))"))
def _(spark, d):
    # the last review of every sixth hash modifies, of the others an even one approves
    index = stored_index(spark, d, "run_id", "observation_id", "hash", "theme")
    return V.needs_review(index, label_reviews(spark, d, index)).select("observation_id", "theme")


@query("JOI-8", "similar_observations", with_views("idx", """SELECT observation_id, inspection_id FROM idx WHERE grain = 'annual_template' AND hash = sha256('hot anvil promo')
AND observation_id <> (SELECT min(observation_id) FROM idx WHERE grain = 'annual_template' AND hash = sha256('hot anvil promo')) ORDER BY observation_id LIMIT 20"""))
def _(spark, d):
    index = stored_index(spark, d, "run_id", "observation_id", "hash", "inspection_id", "grain", "group_id")
    asked = index.filter((F.col("grain") == "annual_template") & (F.col("hash") == F.sha2(F.lit("hot anvil promo"), 256))).agg(F.min("observation_id"))
    return B.similar_observations(index, asked.scalar()).select("observation_id", "inspection_id")


@query("JOI-9", "related_inspections", with_views("idx", """SELECT observation_id, group_id, dataset, related_inspections FROM idx JOIN (SELECT group_id, dataset, count(DISTINCT inspection_id) AS related_inspections FROM idx GROUP BY ALL) USING (group_id, dataset)"""))
def _(spark, d):
    return B.related_inspections(stored_index(spark, d, "observation_id", "inspection_id", "dataset", "group_id"))


SEV = ", ".join(f"""sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END)::BIGINT AS "{s}\"""" for s in G.SEVERITIES)


def theme_metrics_sql(extra: str = "", limit: int = 200) -> str:
    keys = f"theme{', ' + extra if extra else ''}"
    return f"""SELECT *, count(*) OVER () AS total_groups FROM (SELECT {keys}, count(*) AS observation_count, count(DISTINCT inspection_id) AS inspection_count, count(DISTINCT site) AS unique_sites,
  sum(frequency)::BIGINT AS frequency_sum, {SEV}, coalesce(round(greatest(count(DISTINCT inspection_id) - 1, 0)::DOUBLE / nullif(count(DISTINCT inspection_id), 0), 6), 0) AS recurrence_score
  FROM idx GROUP BY {keys}) ORDER BY observation_count DESC, {keys} LIMIT {limit}"""


@query("AGG-10", "observation_theme_metrics", with_views("idx", theme_metrics_sql()))
def _(spark, d):
    return B.observation_theme_metrics(stored_index(spark, d, "inspection_id", "site", "frequency", "theme", "severity"))


@query("AGG-10", "observation_theme_metrics_by_company", with_views("idx", theme_metrics_sql("company", 50)))
def _(spark, d):
    return B.observation_theme_metrics(stored_index(spark, d, "inspection_id", "company", "site", "frequency", "theme", "severity"), "company", 50)


@query("AGG-11", "severity_index", with_views("idx", """SELECT round(avg(CASE WHEN severity <> 'Unclassified' AND left(hash, 1) < '8' THEN CASE severity WHEN 'Low' THEN 0.25 WHEN 'Medium' THEN 0.5 WHEN 'High' THEN 0.75 ELSE 1.0 END END)::DOUBLE, 6) AS severity_index,
  count(CASE WHEN severity <> 'Unclassified' AND left(hash, 1) < '8' THEN 1 END) AS severity_observations FROM idx"""))
def _(spark, d):
    # Half of the hash space counts as model-generated here.
    return B.severity_index(stored_index(spark, d, "hash", "severity").withColumn("ai_generated", F.substring("hash", 1, 1) < "8"))


@query("AGG-12", "run_statistics", with_views("idx", """SELECT count(*) AS total, count(DISTINCT hash) AS unique_texts, count(DISTINCT inspection_id) AS inspections, count(DISTINCT group_id) AS groups, 0 AS ai, count(*) AS rules, 0 AS fallbacks,
  sum(CASE WHEN theme = 'Unclassified' THEN 1 ELSE 0 END)::BIGINT AS unclassified, round(avg(confidence)::DOUBLE, 6) AS mean_confidence, sum(CASE WHEN severity = 'High' THEN 1 ELSE 0 END)::BIGINT AS high_severity,
  sum(CASE WHEN severity = 'Critical' THEN 1 ELSE 0 END)::BIGINT AS critical_severity, count(*) - count(DISTINCT hash) AS duplicate_text_occurrences FROM idx"""))
def _(spark, d):
    return B.run_statistics(stored_index(spark, d, "hash", "inspection_id", "group_id", "theme", "severity", "confidence", "ai_generated", "fallback"))


@query("AGG-13", "group_summary", with_views("idx", """SELECT group_id, count(*) AS observation_count, count(DISTINCT hash) AS unique_texts, count(DISTINCT inspection_id) AS inspection_count, count(DISTINCT company) AS companies,
  count(DISTINCT site) AS sites, min(observation_id) AS representative_id FROM idx GROUP BY group_id"""))
def _(spark, d):
    return B.group_summary(stored_index(spark, d, "observation_id", "hash", "inspection_id", "company", "site", "group_id"))


def section_sql(name: str, label: str, where: str = "TRUE") -> str:
    return f"SELECT '{name}' AS section, CAST({label} AS VARCHAR) AS label, count(*) AS observations, count(DISTINCT inspection_id) AS inspections FROM idx WHERE {label} IS NOT NULL AND {where} GROUP BY {label}"


@query("AGG-14", "workspace_summary", with_views("idx", " UNION ALL ".join([
    "SELECT 'all' AS section, 'all' AS label, count(*) AS observations, count(DISTINCT inspection_id) AS inspections FROM idx",
    section_sql("theme", "theme"), section_sql("year", "year"), section_sql("severity", "severity"), section_sql("dataset", "dataset"),
    "SELECT 'recurring_themes', 'all', count(*), NULL FROM (SELECT theme FROM idx WHERE theme <> 'Unclassified' GROUP BY theme HAVING count(DISTINCT inspection_id) > 1)",
    "SELECT 'sites', 'all', count(DISTINCT site), NULL FROM idx"])))
def _(spark, d):
    return B.workspace_summary(stored_index(spark, d, "inspection_id", "dataset", "site", "year", "theme", "severity"))


@query("AGG-15", "observation_insights", with_views("idx reviews", " UNION ALL ".join([
    "SELECT 'all' AS section, 'all' AS label, count(*) AS observations, count(DISTINCT inspection_id) AS inspections FROM idx",
    section_sql("year", "year"), section_sql("severity", "severity"),
    section_sql("theme", "theme", "theme <> 'Unclassified'") + " HAVING count(DISTINCT inspection_id) > 1", section_sql("site", "site") + " HAVING count(DISTINCT inspection_id) > 1",
    "SELECT 'recurring', 'all', count(*), sum(n - 1)::BIGINT FROM (SELECT count(DISTINCT inspection_id) AS n FROM idx WHERE theme <> 'Unclassified' GROUP BY theme HAVING count(DISTINCT inspection_id) > 1)",
    "SELECT 'review_required', 'all', count(*), NULL FROM idx ANTI JOIN decided USING (run_id, observation_id)"]), [DECIDED]))
def _(spark, d):
    index = stored_index(spark, d, "run_id", "observation_id", "hash", "inspection_id", "site", "year", "theme", "severity")
    return B.observation_insights(index, V.needs_review(index, label_reviews(spark, d, index)))


@query("TRD-4", "theme_change_observations", with_views("idx", """SELECT theme, 1996 AS start_year, 2000 AS end_year, a AS start_inspections, b AS end_inspections, b - a AS change FROM (SELECT theme,
  count(DISTINCT CASE WHEN year = 1996 THEN inspection_id END) AS a, count(DISTINCT CASE WHEN year = 2000 THEN inspection_id END) AS b FROM idx WHERE year IN (1996, 2000) GROUP BY theme)"""))
def _(spark, d):
    return T.theme_change_observations(stored_index(spark, d, "inspection_id", "year", "theme"), 1996, 2000)


# ------------------------------------------------------------------------- summaries and sinks

def tags_and_reviews(spark, d):
    """Rubric-like tags per observation and reviews that change some of them."""
    index = stored_index(spark, d, "observation_id", "inspection_id", "company", "site", "theme", "severity")
    digit = F.conv(F.substring(F.sha2("observation_id", 256), 1, 2), 16, 10).cast("int")
    tags = index.select(
        "observation_id", "inspection_id", "company", "site", F.when(F.col("theme") == "Unclassified", "Unclassified").otherwise("Quality").alias("category"),
        "severity", F.when(F.col("theme") == "Unclassified", F.array().cast("array<string>")).otherwise(F.array("theme", F.lit("Any"))).alias("themes"),
    )
    reviews = tags.filter(digit % 4 == 0).select(
        "observation_id", F.lit("Quality").alias("category"), F.when(digit % 8 == 0, "Low").otherwise(F.col("severity")).alias("severity"),
        F.array(F.lit("Any"), F.lit("Reviewed")).alias("themes"),
    )
    return tags, reviews


TAGS = [
    ("tags0", """SELECT observation_id, inspection_id, company, site, CASE WHEN theme = 'Unclassified' THEN 'Unclassified' ELSE 'Quality' END AS category, severity,
      CASE WHEN theme = 'Unclassified' THEN []::VARCHAR[] ELSE [theme, 'Any'] END AS themes, CAST('0x' || left(sha256(observation_id), 2) AS INTEGER) AS digit FROM idx"""),
    ("reviewed", """SELECT observation_id, 'Quality' AS category, CASE WHEN digit % 8 = 0 THEN 'Low' ELSE severity END AS severity, ['Any', 'Reviewed'] AS themes FROM tags0 WHERE digit % 4 = 0"""),
    ("final", """SELECT t.observation_id, inspection_id, company, site, coalesce(r.category, t.category) AS category, coalesce(r.severity, t.severity) AS severity, coalesce(r.themes, t.themes) AS themes
      FROM tags0 t LEFT JOIN reviewed r USING (observation_id)"""),
]
SUMMARY_SQL = """SELECT 'category' AS section, category AS label, NULL AS site, count(DISTINCT observation_id) AS observations, NULL AS inspections FROM final GROUP BY category
UNION ALL SELECT 'severity', severity, NULL, count(DISTINCT observation_id), NULL FROM final GROUP BY severity
UNION ALL SELECT 'recurrence', theme, site, count(DISTINCT observation_id), count(DISTINCT inspection_id) FROM (SELECT *, unnest(themes) AS theme FROM final) GROUP BY theme, company, site"""


@query("AGG-16", "tag_summaries", with_views("idx", SUMMARY_SQL, TAGS))
def _(spark, d):
    out = B.tag_summaries(*tags_and_reviews(spark, d))
    shape = lambda df, s, label, site, n: df.select(
        F.lit(s).alias("section"), F.col(label).alias("label"), site.cast("string").alias("site"), "observations", n.cast("long").alias("inspections")
    )
    none = F.lit(None)
    return shape(out["categories"], "category", "category", none, none).unionByName(
        shape(out["severities"], "severity", "severity", none, none)
    ).unionByName(shape(out["recurrence"], "recurrence", "theme", F.col("site"), F.col("inspections")))


@query("SNK-6", "export_summaries", with_views("idx", f"SELECT label, site, observations FROM ({SUMMARY_SQL})", TAGS))
def _(spark, d):
    path = fresh_path(spark, "summaries")
    writers.export_summaries(B.tag_summaries(*tags_and_reviews(spark, d)), path)
    read = lambda name: spark.read.csv(f"{path}/{name}", header=True)
    shape = lambda df, label, site: df.select(F.col(label).alias("label"), site.alias("site"), F.col("observations").cast("long"))
    none = F.lit(None).cast("string")
    return shape(read("categories"), "category", none).unionByName(shape(read("severities"), "severity", none)).unionByName(
        shape(read("recurrence"), "theme", F.col("site"))
    )


@query("SNK-3", "export_tags_jsonl", with_views("idx", "SELECT observation_id, theme, severity, inspection_id FROM idx"))
def _(spark, d):
    path = fresh_path(spark, "tags")
    writers.export_tags_jsonl(stored_index(spark, d, "observation_id", "theme", "severity", "inspection_id"), path)
    return spark.read.schema("observation_id string, theme string, severity string, inspection_id string").json(path)


@query("AGG-17", "benchmark_summary", with_views("annual", f"""SELECT 'trend' AS section, CAST(year AS VARCHAR) AS label, count(*) AS categories, sum(frequency)::BIGINT AS frequency FROM scope GROUP BY year
UNION ALL SELECT 'total', 'all', count(*), sum(frequency)::BIGINT FROM scope WHERE year = 1998
UNION ALL SELECT 'theme', theme, count(*), sum(frequency)::BIGINT FROM (SELECT *, unnest(CASE WHEN len(t) > 0 THEN t ELSE ['Unclassified'] END) AS theme FROM (
  SELECT *, {theme_list('lower(long)', PARTS)} AS t FROM scope WHERE year = 1998)) GROUP BY theme""", [
    ("scope", "SELECT * FROM annual WHERE contains(lower(short || ' ' || long || ' ' || reference), 'small')")]))
def _(spark, d):
    return B.benchmark_summary(annual(spark, d), 1998, search="Small", taxonomy=PARTS)


@query("AGG-18", "control_totals", with_views("annual", "SELECT year, sum(frequency)::BIGINT AS control_total, year AS source_row FROM annual GROUP BY year"))
def _(spark, d):
    # Summary sheets: one row per program, and a total row with empty cells in front.
    per_year = annual(spark, d).groupBy("year").agg(F.sum("frequency").cast("string").alias("total"))
    programs = annual(spark, d).select("year", F.array(F.col("program"), F.col("frequency").cast("string")).alias("cells"), F.lit(0).alias("source_row"))
    totals = per_year.select("year", F.array(F.lit(None).cast("string"), F.lit("Actual Total in System"), F.lit(None).cast("string"), F.col("total")).alias("cells"), F.col("year").alias("source_row"))
    return B.control_totals(programs.unionByName(totals))


@query("SRT-1", "page", with_views("inspections", "SELECT inspection_id, inspection_year, count(*) OVER () AS total_rows FROM inspections ORDER BY inspection_year DESC, inspection_id LIMIT 40 OFFSET 100"))
def _(spark, d):
    from auditgrain.plans.base import inspections

    rows = inspections(spark, d).select("inspection_id", "inspection_year")
    return P.page(rows, [F.col("inspection_year").desc(), F.col("inspection_id")], 40, 100)


@query("SRT-2", "browse", with_views("idx", """SELECT observation_id, severity_rank, total_rows FROM (SELECT observation_id, severity_rank, count(*) OVER () AS total_rows FROM idx ORDER BY severity_rank DESC, observation_id LIMIT 25 OFFSET 50)
UNION ALL SELECT observation_id, severity_rank, total_rows FROM (SELECT observation_id, severity_rank, count(*) OVER () AS total_rows FROM idx ORDER BY company NULLS LAST, observation_id LIMIT 25)"""))
def _(spark, d):
    index = stored_index(spark, d, "observation_id", "company", "severity_rank")
    a = B.browse(index, "severity", "desc", 25, 50).select("observation_id", "severity_rank", "total_rows")
    return a.unionByName(B.browse(index, "facility", "asc", 25).select("observation_id", "severity_rank", "total_rows"))


@query("SRT-2", "browse_stored", with_views("idx", """SELECT observation_id, severity_rank, total_rows FROM (SELECT observation_id, severity_rank, count(*) OVER () AS total_rows FROM idx ORDER BY severity_rank DESC, observation_id LIMIT 40 OFFSET 9000)
UNION ALL SELECT observation_id, severity_rank, total_rows FROM (SELECT observation_id, severity_rank, count(*) OVER () AS total_rows FROM idx ORDER BY company NULLS LAST, observation_id LIMIT 25)"""))
def _(spark, d):
    orders = [("severity", "desc"), ("facility", "asc")]
    with steps_dropped(spark, len(orders)):
        index = B.store_index(stored_index(spark, d), orders)
    a, b = B.stored_page(index, "severity", "desc", 40, 9000), B.stored_page(index, "facility", "asc", 25)
    return a.unionByName(b).select("observation_id", "severity_rank", "total_rows")


@query("AGG-10", "company_theme_metrics", with_views("idx", theme_metrics_sql().replace("FROM idx", "FROM (SELECT * FROM idx WHERE grain = 'inspection' AND company = 'HOUSEHOLD NATION_3')")))
def _(spark, d):
    with steps_dropped(spark):
        index = B.store_index(stored_index(spark, d), []).rows
    return B.observation_theme_metrics(B.filter_observations(index, company="HOUSEHOLD NATION_3"))


@query("SRT-3", "benchmark_rows", with_views("annual", "SELECT year, cite_id, frequency, count(*) OVER () AS total_rows FROM annual ORDER BY frequency DESC, year, cite_id, program LIMIT 25 OFFSET 25"))
def _(spark, d):
    return B.benchmark_rows(annual(spark, d), 25, 25).select("year", "cite_id", "frequency", "total_rows")


# ------------------------------------------------------------------------------------- reviews

LABEL_REVIEWS = ("label_reviews", """SELECT 'run-1' AS run_id, CAST(doc_id AS VARCHAR) AS observation_id, 1 AS revision, CASE quality WHEN 1 THEN 'Approve' ELSE 'Reject' END AS action FROM labels
UNION ALL SELECT 'run-1', CAST(doc_id AS VARCHAR), 2, 'Modify' FROM labels WHERE toxic = 1""")


def doc_reviews(spark, d):
    labels = table(spark, d, "labels")
    base = [F.lit("run-1").alias("run_id"), F.col("doc_id").cast("string").alias("observation_id")]
    first = labels.select(*base, F.lit(1).alias("revision"), F.when(F.col("quality") == 1, "Approve").otherwise("Reject").alias("action"))
    return first.unionByName(labels.filter("toxic = 1").select(*base, F.lit(2).alias("revision"), F.lit("Modify").alias("action")))


@query("WIN-3", "latest_review", with_views("", "SELECT run_id, observation_id, revision, action FROM label_reviews QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY revision DESC) = 1", [LABEL_REVIEWS]))
def _(spark, d):
    return V.latest_review(doc_reviews(spark, d))


@query("WIN-4", "review_history", with_views("", """SELECT run_id, observation_id, revision, action FROM label_reviews WHERE observation_id = (SELECT min(observation_id) FROM label_reviews WHERE revision = 2) ORDER BY revision DESC""", [LABEL_REVIEWS]))
def _(spark, d):
    reviews = doc_reviews(spark, d)
    target = reviews.filter("revision = 2").agg(F.min("observation_id")).first()[0]
    return V.review_history(reviews, "run-1", target or "")


@query("WIN-5", "apply_reviews", with_views("", """
SELECT i.observation_id, i.arrival, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN i.action = 'Modify' AND i.theme IS NULL THEN 'invalid'
  WHEN i.revision = c.cur AND i.arrival = 1 THEN 'accepted'
  WHEN i.revision = c.cur + 1 AND i.arrival = 3 AND NOT (i.action = 'Modify' AND i.theme IS NULL) AND f.observation_id IS NOT NULL THEN 'accepted' ELSE 'conflict' END AS status
FROM incoming i LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents) d ON d.doc_id = i.observation_id
JOIN cur c ON c.observation_id = i.observation_id
LEFT JOIN (SELECT i2.observation_id FROM incoming i2 JOIN cur c2 USING (observation_id) WHERE i2.arrival = 1 AND i2.revision = c2.cur) f ON f.observation_id = i.observation_id""", [
    LABEL_REVIEWS,
    ("cur", "SELECT observation_id, max(revision) AS cur FROM label_reviews GROUP BY observation_id UNION ALL SELECT 'missing-' || observation_id, 0 FROM label_reviews WHERE revision = 2"),
    ("incoming", """SELECT observation_id, 1 AS arrival, CASE WHEN CAST(observation_id AS INTEGER) % 3 = 0 THEN 1 ELSE cur END AS revision, 'Approve' AS action, CAST(NULL AS VARCHAR) AS theme FROM cur WHERE observation_id NOT LIKE 'missing%'
      UNION ALL SELECT observation_id, 2, cur, 'Reject', NULL FROM cur WHERE observation_id NOT LIKE 'missing%' AND CAST(observation_id AS INTEGER) % 3 = 1
      UNION ALL SELECT observation_id, 3, cur + 1, 'Modify', CASE WHEN CAST(observation_id AS INTEGER) % 5 <> 0 THEN 'Gadgets' END FROM cur WHERE observation_id NOT LIKE 'missing%'
      UNION ALL SELECT observation_id, 1, 0, 'Approve', NULL FROM cur WHERE observation_id LIKE 'missing%'"""),
]))
def _(spark, d):
    current = doc_reviews(spark, d)
    state = current.groupBy("run_id", "observation_id").agg(F.max("revision").alias("cur"))
    number = F.col("observation_id").cast("int")
    shape = lambda df, arrival, revision, action, theme: df.select(
        "run_id", "observation_id", F.lit(arrival).alias("arrival"), revision.cast("int").alias("revision"), F.lit(action).alias("action"),
        theme.cast("string").alias("theme"), F.lit("High").alias("severity"),
    )
    none, cur = F.lit(None), F.col("cur")
    missing = current.filter("revision = 2").withColumn("observation_id", F.concat(F.lit("missing-"), "observation_id"))
    incoming = (
        shape(state, 1, F.when(number % 3 == 0, 1).otherwise(cur), "Approve", none)
        .unionByName(shape(state.filter(number % 3 == 1), 2, cur, "Reject", none))
        .unionByName(shape(state, 3, cur + 1, "Modify", F.when(number % 5 != 0, "Gadgets")))
        .unionByName(shape(missing, 1, F.lit(0), "Approve", none))
    )
    index = table(spark, d, "documents").select(F.lit("run-1").alias("run_id"), F.col("doc_id").cast("string").alias("observation_id"))
    return V.apply_reviews(incoming, current, index, PARTS).select("observation_id", "arrival", "status")
