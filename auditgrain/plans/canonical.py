"""Sources, sinks, normalisation, duplicates and quality over the raw inspection view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrain.operators import normalize as N
from auditgrain.operators import rollup as R
from auditgrain.plans.base import (
    AS_OF, annual, citations, inspections, observation_sources, project_rows, projects, table, with_views,
)
from auditgrain.plans.registry import query
from auditgrain.session import fresh_path, materialize
from auditgrain.sources import readers, writers

MAPPING = {
    "inspection_id": "Inspection ID", "fei_number": "FEI", "company_name": "Company", "site_name": "Site",
    "inspection_date": "Inspection Date", "country": "Country", "product_type": "Product", "inspection_type": "Inspection Type",
    "classification": "Classification", "citation_flag": "Citation", "observation_count": "Observations",
    "project_area": "Project Area", "observation_text": "Observation Text", "fiscal_year": "Fiscal Year",
}


def raw_inspections(spark: SparkSession, d: str) -> DataFrame:
    """Inspections as source strings, with bad dates, counts, classes, missing ids and repeated rows."""
    k = F.col("inspection_id").cast("long")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    iso = F.date_format("inspection_date", "yyyy-MM-dd")
    written = F.when(k % 3 == 0, iso).when(k % 3 == 1, F.date_format("inspection_date", "MM/dd/yyyy")).otherwise(
        F.concat(iso, F.lit(" 00:00:00"))
    )
    phrase = (
        F.when(F.col("classification") == "OAI", "Official Action Indicated").when(F.col("classification") == "VAI", "vai")
        .when(F.col("classification") == "NAI", "No Action Indicated").otherwise("")
    )
    copies = F.when((k % 50 == 0) & (k % 61 != 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return inspections(spark, d).select(
        F.when(k % 61 == 0, " ").otherwise(F.col("inspection_id")).alias("Inspection ID"), text("fei_number").alias("FEI"),
        F.when(k % 73 == 0, F.replace(F.col("company_name"), F.lit(" "), F.lit("  "))).otherwise(F.col("company_name")).alias("Company"),
        text("site_name").alias("Site"), F.when(k % 97 == 0, "2001-02-30").otherwise(written).alias("Inspection Date"),
        text("country").alias("Country"), text("product_type").alias("Product"), text("inspection_type").alias("Inspection Type"),
        F.when(k % 83 == 0, "PENDING").otherwise(phrase).alias("Classification"),
        F.when(F.col("citation_indicator") == 1, "Yes").when(F.col("citation_indicator") == 0, "n").otherwise("").alias("Citation"),
        F.when(k % 89 == 0, "-1").when(k % 79 == 0, "2.5").otherwise(text("observation_count")).alias("Observations"),
        text("project_area").alias("Project Area"), text("observation_text").alias("Observation Text"), text("fiscal_year").alias("Fiscal Year"),
        F.explode(copies).alias("copy"), k.alias("k"),
    ).withColumn("src", F.col("k") * 2 + 2 + F.col("copy")).drop("copy", "k")


RAW_SQL = """
SELECT CASE WHEN k % 61 = 0 THEN NULL ELSE inspection_id END AS given_id, fei_number, company_name, company_key, site_name,
  CASE WHEN k % 97 = 0 THEN NULL ELSE inspection_date END AS inspection_date, k % 97 = 0 AS bad_date, country, product_type, inspection_type,
  CASE WHEN k % 83 = 0 THEN NULL ELSE classification END AS classification, k % 83 = 0 AS unknown_class,
  CASE citation_indicator WHEN 1 THEN 'Yes' WHEN 0 THEN 'n' END AS citation_flag, citation_indicator,
  CASE WHEN k % 89 = 0 THEN -1 WHEN k % 79 = 0 THEN 2 ELSE observation_count END AS observation_count,
  k % 89 = 0 OR k % 79 = 0 AS bad_count, project_area, observation_text, CAST(fiscal_year AS VARCHAR) AS fiscal_year,
  k * 2 + 2 + copy AS source_row
FROM inspections, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR (k % 50 = 0 AND k % 61 <> 0)"""
TYPED_SQL = """
SELECT *, coalesce(given_id, 'DERIVED-' || sha256(concat_ws('|', fei_number, company_name, site_name, coalesce(CAST(inspection_date AS VARCHAR), '<null>'),
    country, product_type, inspection_type, coalesce(classification, '<null>'), coalesce(citation_flag, '<null>'),
    coalesce(CAST(observation_count AS VARCHAR), '<null>'), project_area, coalesce(observation_text, '<null>'), fiscal_year))) AS inspection_id,
  concat_ws('; ', CASE WHEN bad_date THEN 'Invalid date' END, CASE WHEN inspection_date > DATE '2001-06-30' THEN 'Future inspection date' END,
    CASE WHEN bad_count THEN 'Invalid observation count' END) AS rejection_reason FROM raw"""
RANKED_SQL = "SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY source_row) AS duplicate_rank FROM typed"
CANON = [("raw", RAW_SQL), ("typed", TYPED_SQL), ("ranked", RANKED_SQL)]


def canon(body: str) -> str:
    return with_views("inspections", body, CANON)


def typed(spark: SparkSession, d: str) -> DataFrame:
    return N.type_rows(N.apply_mapping(raw_inspections(spark, d), MAPPING, "src"), AS_OF)


# ------------------------------------------------------------------------------------- sources

@query("SRC-1", "read_strings", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 00:00:00' AS o_orderdate, o_orderpriority FROM orders""")
def _(spark, d):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    return readers.read_strings(spark, f"{d}/orders.parquet", columns=cols)


@query("SRC-1", "read_strings_csv", with_views("inspections", """SELECT inspection_id, company_name, coalesce(observation_text, '') AS observation_text,
  coalesce(classification, '') AS classification FROM inspections"""))
def _(spark, d):
    path = fresh_path(spark, "raw-csv")
    inspections(spark, d).select("inspection_id", "company_name", "observation_text", "classification").write.csv(path, header=True, escape='"')
    return readers.read_strings(spark, path, "csv")


@query("SRC-2", "nested_payload", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return readers.read_nested_payload(spark, f"{d}/events.parquet", "props", "k long").select("event_id", "event_type", "k")


@query("SRC-3", "explode_source_rows", with_views("project_rows citations", """
SELECT p.id AS inspection_id, count(DISTINCT p.source_row) AS project_rows, count(DISTINCT c.source_row) AS citation_rows,
  min(p.project) AS first_project, max(c.reference) AS last_reference
FROM project_rows p JOIN citations c ON p.id = c.id GROUP BY p.id"""))
def _(spark, d):
    rows = project_rows(spark, d, by_id=True)
    left, right = readers.explode_source_rows(R.nest_evidence(projects(rows), citations(rows)))
    a = left.groupBy("inspection_id").agg(F.count("*").alias("project_rows"), F.min("project").alias("first_project"))
    b = right.groupBy("inspection_id").agg(F.count("*").alias("citation_rows"), F.max("reference").alias("last_reference"))
    return a.join(b, "inspection_id")


@query("SRC-4", "load_annual", with_views("annual", """SELECT year, program, cite_id, reference, short, long, frequency
FROM annual WHERE pk % 13 <> 0 AND pk % 17 <> 0 AND pk % 19 <> 0"""))
def _(spark, d):
    pk = F.col("pk")
    cells = F.array(
        "program", F.when(pk % 17 != 0, F.col("cite_id")), "reference", "short", "long",
        F.when(pk % 13 == 0, "n/a").otherwise(F.col("frequency").cast("string")),
    )
    sheet = annual(spark, d).select("year", F.when(pk % 19 == 0, F.slice(cells, 1, 5)).otherwise(cells).alias("fields"))
    return readers.load_annual(sheet)


@query("SRC-5", "normalize_observations", with_views("annual", """
SELECT 'additional' AS dataset, CASE WHEN pk % 4 = 0 THEN 'inspection' ELSE 'annual_template' END AS grain,
  CASE WHEN pk % 4 = 0 THEN cite_id END AS inspection_id, CASE WHEN pk % 6 = 0 THEN short ELSE long END AS text,
  CASE WHEN pk % 13 = 0 THEN NULL ELSE frequency END AS frequency, year, CASE WHEN pk % 13 = 0 THEN 'Invalid frequency' END AS invalid_reason FROM annual"""))
def _(spark, d):
    pk = F.col("pk")
    file = annual(spark, d).select(
        F.when(pk % 6 == 0, "").otherwise(F.col("long")).alias("observation_text"), F.col("short").alias("Long Description"),
        F.when(pk % 4 == 0, F.col("cite_id")).otherwise("").alias("Inspection ID"),
        F.when(pk % 26 == 0, "-3").when(pk % 13 == 0, "1.5").otherwise(F.col("frequency").cast("string")).alias("Frequency"),
        F.col("year").cast("string").alias("Fiscal Year"), (F.col("year") * 10_000_000 + pk).alias("row"),
    )
    return readers.normalize_observations(file, "annual-file", "row").select(
        "dataset", "grain", "inspection_id", "text", "frequency", "year", "invalid_reason"
    )


@query("SRC-6", "observations_from_inspections", with_views("inspections citations", """
SELECT i.inspection_id, CASE WHEN c.id IS NULL THEN i.observation_text ELSE coalesce(c.long, c.short) END AS text,
  CASE WHEN c.id IS NULL THEN 'inspection_text' ELSE c.reference END AS reference, c.source_row, i.company_name AS company, i.fiscal_year AS year
FROM inspections i LEFT JOIN (SELECT * FROM citations WHERE CAST(id AS BIGINT) % 4 <> 0) c ON c.id = i.inspection_id"""))
def _(spark, d):
    cites = citations(project_rows(spark, d)).withColumnRenamed("id", "inspection_id")
    # Every fourth inspection keeps no citation, so that its own text is used.
    cites = cites.filter(F.col("inspection_id").cast("long") % 4 != 0)
    out = readers.observations_from_inspections(inspections(spark, d), cites, "real", "inspections")
    return out.select("inspection_id", "text", "reference", "source_row", "company", "year")


@query("SRC-7", "union_sources", with_views("obs_sources", """SELECT dataset, grain, priority, count(*) AS n, count(inspection_id) AS with_inspection,
  CAST(sum(frequency) AS BIGINT) AS frequency, CAST(sum(length(text)) AS BIGINT) AS characters FROM obs_sources GROUP BY ALL"""))
def _(spark, d):
    return observation_sources(spark, d).groupBy("dataset", "grain", "priority").agg(
        F.count("*").alias("n"), F.count("inspection_id").alias("with_inspection"), F.sum("frequency").alias("frequency"),
        F.sum(F.length("text")).alias("characters"),
    )


# --------------------------------------------------------------------------------------- sinks

@query("SNK-1", "write_parquet", with_views("inspections", "SELECT inspection_id, inspection_date, classification, observation_count FROM inspections"))
def _(spark, d):
    path = fresh_path(spark, "inspections")
    writers.write_parquet(inspections(spark, d).select("inspection_id", "inspection_date", "classification", "observation_count"), path)
    return spark.read.parquet(path)


QUALITY_SQL = """SELECT count(*) AS total_records, sum(CASE WHEN duplicate_rank = 1 AND rejection_reason = '' THEN 1 ELSE 0 END)::BIGINT AS valid_records,
  sum(CASE WHEN duplicate_rank = 1 AND rejection_reason <> '' THEN 1 ELSE 0 END)::BIGINT AS rejected_records,
  sum(CASE WHEN duplicate_rank > 1 THEN 1 ELSE 0 END)::BIGINT AS duplicate_records,
  (count(*) - count(inspection_date))::BIGINT AS missing_inspection_date, (count(*) - count(classification))::BIGINT AS missing_classification,
  (count(*) - count(citation_flag))::BIGINT AS missing_citation_flag, (count(*) - count(observation_count))::BIGINT AS missing_observation_count,
  (count(*) - count(observation_text))::BIGINT AS missing_observation_text, sum(CASE WHEN bad_date THEN 1 ELSE 0 END)::BIGINT AS invalid_dates,
  sum(CASE WHEN unknown_class THEN 1 ELSE 0 END)::BIGINT AS unknown_classifications,
  round(100 * (1 - (5 * count(*) - count(inspection_date) - count(classification) - count(citation_flag) - count(observation_count) - count(observation_text))
    / CAST(count(*) * 14 AS DOUBLE)), 2) AS data_completeness_pct FROM ranked"""
QUALITY_COLUMNS = [
    "total_records", "valid_records", "rejected_records", "duplicate_records", "missing_inspection_date", "missing_classification",
    "missing_citation_flag", "missing_observation_count", "missing_observation_text", "invalid_dates", "unknown_classifications",
    "data_completeness_pct",
]


@query("SNK-2", "write_quality", canon(QUALITY_SQL))
def _(spark, d):
    path = fresh_path(spark, "quality")
    writers.write_quality(N.quality_report(N.duplicate_rank(materialize(typed(spark, d), "typed"))), path)
    return spark.read.json(path).select(*QUALITY_COLUMNS)


@query("SNK-4", "export_csv_safe", with_views("inspections", """
SELECT inspection_id, CASE WHEN left(note, 1) IN ('=', '+', '-', '@') THEN '''' || note ELSE note END AS note FROM (
  SELECT inspection_id, CASE WHEN k % 4 = 0 THEN '=' WHEN k % 4 = 1 THEN '-' WHEN k % 4 = 2 THEN 'x=' ELSE '@' END || company_name || CASE WHEN k % 3 = 0 THEN ' "q", \\' || chr(10) || 'x\\"' ELSE '' END AS note FROM inspections)"""))
def _(spark, d):
    k = F.col("inspection_id").cast("long") % 4
    note = F.concat(F.when(k == 0, "=").when(k == 1, "-").when(k == 2, "x=").otherwise("@"), F.col("company_name"), F.when(F.col("inspection_id").cast("long") % 3 == 0, ' "q", \\\nx\\"').otherwise(""))
    path = fresh_path(spark, "csv")
    writers.export_csv_safe(inspections(spark, d).select("inspection_id", note.alias("note")), path)
    return readers.read_strings(spark, path, "csv")


@query("SNK-5", "save_evidence", with_views("inspections", """
SELECT 'answer-1' AS analysis_id, 'OAI' AS scope, inspection_id FROM inspections WHERE classification = 'OAI'
UNION ALL SELECT 'answer-2', '1997', inspection_id FROM inspections WHERE inspection_year = 1997"""))
def _(spark, d):
    path, df = fresh_path(spark, "evidence"), inspections(spark, d)
    writers.save_evidence(N.filter_inspections(df, classification="OAI").select("inspection_id"), "answer-1", path, {"scope": "OAI"})
    writers.save_evidence(N.filter_inspections(df, year=1997).select("inspection_id"), "answer-2", path, {"scope": "1997"})
    return spark.read.schema("inspection_id string, scope string, analysis_id string").parquet(path)


# --------------------------------------------------------------------------------- projections

@query("PRJ-1", "apply_mapping", canon("SELECT coalesce(given_id, ' ') AS inspection_id, fei_number, source_row, coalesce(citation_flag, '') AS citation_flag FROM raw"))
def _(spark, d):
    return N.apply_mapping(raw_inspections(spark, d), MAPPING, "src").select("inspection_id", "fei_number", "source_row", "citation_flag")


@query("PRJ-2", "blank_to_null", canon("SELECT source_row, given_id AS inspection_id, citation_flag, observation_text FROM raw"))
def _(spark, d):
    return N.blank_to_null(N.apply_mapping(raw_inspections(spark, d), MAPPING, "src")).select(
        "source_row", "inspection_id", "citation_flag", "observation_text"
    )


TYPED_QUERIES = [
    ("PRJ-3", "normalize_company", ["company_name", "company_key"]),
    ("PRJ-4", "normalize_classification", ["classification"]),
    ("PRJ-5", "parse_date", ["inspection_date"]),
    ("PRJ-6", "parse_count", ["observation_count"]),
    ("PRJ-7", "parse_flag", ["citation_indicator"]),
    ("PRJ-8", "rejection_reason", ["rejection_reason"]),
    ("PRJ-9", "derive_id", ["inspection_id"]),
]
for _id, _name, _cols in TYPED_QUERIES:
    query(_id, _name, canon(f"SELECT source_row, {', '.join(_cols)} FROM typed"))(
        lambda spark, d, cols=tuple(_cols): typed(spark, d).select("source_row", *cols)
    )


@query("PRJ-10", "site_key", canon("""SELECT source_row, coalesce(CASE WHEN source_row % 4 <> 0 THEN fei_number END,
  company_key || ' | ' || CASE WHEN source_row % 8 = 0 THEN 'unspecified' ELSE site_name END) AS site_key FROM typed"""))
def _(spark, d):
    row = F.col("source_row")
    some = typed(spark, d).withColumns({
        "fei_number": F.when(row % 4 != 0, F.col("fei_number")), "site_name": F.when(row % 8 != 0, F.col("site_name")),
    })
    return some.select("source_row", N.site_key().alias("site_key"))


@query("PRJ-11", "calendar_features", canon("""SELECT source_row, CAST(year(inspection_date) AS INTEGER) AS inspection_year,
  CAST(month(inspection_date) AS INTEGER) AS inspection_month, CAST(DATE '2001-06-30' - inspection_date AS INTEGER) AS inspection_recency,
  CASE WHEN classification IS NOT NULL THEN CAST(classification = 'OAI' AS INTEGER) END AS "OAI_indicator",
  CASE WHEN classification IS NOT NULL THEN CAST(classification = 'VAI' AS INTEGER) END AS "VAI_indicator",
  upper(left(country, 1)) || lower(substring(country, 2)) AS country, upper(left(product_type, 1)) || lower(substring(product_type, 2)) AS product_type FROM typed"""))
def _(spark, d):
    return N.calendar_features(typed(spark, d), AS_OF).select(
        "source_row", "inspection_year", "inspection_month", "inspection_recency", "OAI_indicator", "VAI_indicator", "country", "product_type"
    )


@query("PRJ-12", "filter_inspections", with_views("inspections", """SELECT inspection_id, classification, inspection_year FROM inspections
WHERE company_key = 'household nation_3' AND classification IS NULL AND inspection_year BETWEEN 1996 AND 2000
UNION ALL SELECT inspection_id, classification, inspection_year FROM inspections
WHERE country = 'NATION_7' AND classification = 'OAI' AND inspection_date BETWEEN DATE '1997-02-01' AND DATE '1999-03-31' AND inspection_type = '1-URGENT'"""))
def _(spark, d):
    df = inspections(spark, d)
    a = N.filter_inspections(df, company="  HOUSEHOLD Nation_3 ", classification="Unknown", start_year=1996, end_year=2000, site="")
    b = N.filter_inspections(
        df, country="NATION_7", classification="OAI", start_date="1997-02-01", end_date="1999-03-31", inspection_type="1-URGENT"
    )
    return a.unionByName(b).select("inspection_id", "classification", "inspection_year")


@query("PRJ-13", "filter_site", with_views("inspections", """SELECT 'key' AS asked, inspection_id FROM inspections WHERE site_key = '17'
UNION ALL SELECT 'name', inspection_id FROM inspections WHERE site_name = 'Customer#000000017'"""))
def _(spark, d):
    df = inspections(spark, d)
    a = N.filter_site(df, "17").select(F.lit("key").alias("asked"), "inspection_id")
    return a.unionByName(N.filter_site(df, "Customer#000000017").select(F.lit("name").alias("asked"), "inspection_id"))


@query("PRJ-15", "search_literal", """SELECT doc_id, lang FROM documents WHERE contains(lower(text), lower('ToKen = "')) OR contains(lower(source), lower('ToKen = "'))
UNION ALL SELECT doc_id, 'percent' FROM documents WHERE contains(lower(text), '%%%')""")
def _(spark, d):
    docs = table(spark, d, "documents")
    a = N.search_literal(docs, 'ToKen = "', ["text", "source"]).select("doc_id", "lang")
    return a.unionByName(N.search_literal(docs, "%%%", ["text"]).select("doc_id", F.lit("percent").alias("lang")))


@query("PRJ-16", "narrow_projection", with_views("inspections", """SELECT inspection_id, company_key, site_key, fei_number, country, product_type, classification,
  project_area, inspection_year, company_name, site_name, inspection_date, inspection_type, citation_indicator, observation_count, observation_text,
  posted_citation_indicator, available_citation_count, TRUE AS reconciled FROM inspections"""))
def _(spark, d):
    df = inspections(spark, d)
    narrow = N.narrow_projection(df)
    return narrow.withColumn("reconciled", N.reconcile_counts(df, narrow).select("reconciled").scalar())


@query("PRJ-17", "program_alias", """SELECT p_partkey, CASE p_brand WHEN 'Brand#2' THEN 'Brand#1' WHEN 'Brand#3' THEN 'House' ELSE p_brand END AS program FROM part""")
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", N.program_alias(F.col("p_brand"), {"Brand#2": "Brand#1", "Brand#3": "House"}).alias("program")
    )


@query("PRJ-21", "distinct_names", with_views("inspections", """SELECT DISTINCT company_name AS name FROM inspections
UNION ALL SELECT DISTINCT CASE p_brand WHEN 'Brand#2' THEN 'Brand#1' ELSE p_brand END FROM part"""))
def _(spark, d):
    names = N.distinct_names(inspections(spark, d), "company_name").withColumnRenamed("company_name", "name")
    programs = table(spark, d, "part").select(N.program_alias(F.col("p_brand"), {"Brand#2": "Brand#1"}).alias("name"))
    return names.unionByName(N.distinct_names(programs, "name"))


# -------------------------------------------------------------------- duplicates, splits, quality

@query("WIN-1", "duplicate_rank", canon("SELECT inspection_id, source_row, duplicate_rank FROM ranked"))
def _(spark, d):
    return N.duplicate_positions(typed(spark, d)).select("inspection_id", "source_row", "duplicate_rank")


@query("WIN-2", "recency_rank", with_views("inspections", """SELECT site_key, inspection_id,
  row_number() OVER (PARTITION BY site_key ORDER BY day DESC NULLS LAST, inspection_id) AS inspection_rank
FROM (SELECT *, CASE WHEN k % 13 <> 0 THEN inspection_date END AS day FROM inspections)"""))
def _(spark, d):
    df = inspections(spark, d).withColumn(
        "inspection_date", F.when(F.col("inspection_id").cast("long") % 13 != 0, F.col("inspection_date"))
    )
    return N.recency_rank(df).select("site_key", "inspection_id", "inspection_rank")


@query("SET-1", "split_valid", canon("""SELECT inspection_id, source_row, CASE WHEN duplicate_rank > 1 THEN 'duplicate' WHEN rejection_reason <> '' THEN 'rejected' ELSE 'valid' END AS part FROM ranked"""))
def _(spark, d):
    parts = N.split_valid(N.duplicate_rank(materialize(typed(spark, d), "typed")))
    named = [p.select("inspection_id", "source_row", F.lit(n).alias("part")) for p, n in zip(parts, ("valid", "rejected", "duplicate"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("SET-2", "canonicalize", canon("""
SELECT inspection_id, site_key, company_name, classification, inspection_year, observation_count, citation_indicator, site_inspection_count,
  row_number() OVER (PARTITION BY site_key ORDER BY inspection_date DESC NULLS LAST, inspection_id) AS inspection_rank
FROM (SELECT *, fei_number AS site_key, CAST(year(inspection_date) AS INTEGER) AS inspection_year,
  count(*) OVER (PARTITION BY fei_number) AS site_inspection_count FROM ranked WHERE duplicate_rank = 1 AND rejection_reason = '')"""))
def _(spark, d):
    valid = N.canonicalize(raw_inspections(spark, d), MAPPING, AS_OF, "src")["valid"]
    return valid.select(
        "inspection_id", "site_key", "company_name", "classification", "inspection_year", "observation_count", "citation_indicator",
        "site_inspection_count", "inspection_rank",
    )


@query("JOI-5", "attach_site_counts", with_views("inspections", "SELECT inspection_id, count(*) OVER (PARTITION BY site_key) AS site_inspection_count FROM inspections"))
def _(spark, d):
    return N.attach_site_counts(inspections(spark, d)).select("inspection_id", "site_inspection_count")


@query("AGG-3", "quality_report", canon(QUALITY_SQL))
def _(spark, d):
    return N.canonicalize(raw_inspections(spark, d), MAPPING, AS_OF, "src")["quality"].select(*QUALITY_COLUMNS)


@query("AGG-8", "profile_table", with_views("inspections", """
SELECT 'site_name' AS "column", (SELECT count(*) FROM x WHERE trim(coalesce(site_name, '')) = '')::BIGINT AS missing, n, ids, rep FROM s
UNION ALL SELECT 'observation_text', (SELECT count(*) FROM x WHERE trim(coalesce(observation_text, '')) = ''), n, ids, rep FROM s
UNION ALL SELECT 'company_name', (SELECT count(*) FROM x WHERE trim(coalesce(company_name, '')) = ''), n, ids, rep FROM s""", [
    ("x", """SELECT * FROM (SELECT CASE WHEN k % 9 = 0 THEN '  ' ELSE site_name END AS site_name, CASE WHEN k % 63 = 0 THEN NULL ELSE observation_text END AS observation_text,
      CASE WHEN k % 9 = 0 THEN '' ELSE company_name END AS company_name FROM inspections)
      WHERE trim(coalesce(site_name, '')) <> '' OR trim(coalesce(observation_text, '')) <> '' OR trim(coalesce(company_name, '')) <> ''"""),
    ("s", "SELECT count(*) AS n, count(DISTINCT company_name) AS ids, count(company_name) - count(DISTINCT company_name) AS rep FROM x"),
]).replace("n, ids, rep", "n AS nonblank_rows, ids AS distinct_ids, rep AS repeated_id_rows"))
def _(spark, d):
    k = F.col("inspection_id").cast("long")
    df = inspections(spark, d).select(
        F.when(k % 9 == 0, "  ").otherwise(F.col("site_name")).alias("site_name"),
        F.when(k % 63 != 0, F.col("observation_text")).alias("observation_text"),
        F.when(k % 9 == 0, "").otherwise(F.col("company_name")).alias("company_name"),
    )
    return R.profile_table(df, "company_name")
