"""Inspection-shaped views over the given tables, once as Spark plans and once as oracle CTEs.

Every row of the tables is used. The tables hold no nulls, so missing values are derived from keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrain.functions.config import AlertRules, MetricRule
from auditgrain.functions.taxonomy import Taxonomy
from auditgrain.operators.browse import build_browse_index
from auditgrain.operators.observations import build_corpus
from auditgrain.operators.tagging import tag_run
from auditgrain.session import materialize, steps_dropped
from auditgrain.sources.readers import union_sources

AS_OF = "2001-06-30"

PARTS = Taxonomy(
    themes={
        "Fasteners": ["bolt", "rod"], "Gadgets": ["gizmo", "widget"], "Tooling": ["anvil", "gear"],
        "Thermal": ["hot ", "cold "], "Promotion": ["promo"],
    },
    rule_critical=("hot anvil",), rule_high=("old rod", "new gear"),
    critical=("hot anvil", "hot gizmo"), high=("old rod", "new gear", "large widget"), low_all=("small", "economy"),
    negations=("blue bolt",), severity_negations=("large anvil",),
    category_of_theme={"Fasteners": "Hardware", "Gadgets": "Devices", "Tooling": "Hardware", "Thermal": "Process"},
    rubric_critical=("hot anvil",), rubric_high=("old rod", "new gear"), rubric_low_all=("small", "economy"),
    rubric_medium=("standard", "medium"), rubric_negation_pattern=r"\b(blue bolt|red plate)\b", version="parts-1",
)
PROSE = Taxonomy(
    themes={"Motion": ["tion", "movement"], "Origin": ["from ", "origin"], "Thing": ["thing", "shan"], "Secret": ["token ="]},
    critical=("token =", "hehe"), high=("erth", "ment"), low_all=("the ", "of "), negations=("the of",),
    severity_negations=("thethe",), instruction_pattern=r"(?i)ignore (?:all )?previous|in the|en la",
    category_of_theme={"Motion": "Dynamics", "Origin": "Dynamics", "Secret": "Security"},
    rubric_critical=("token =",), rubric_high=("erth",), rubric_low_all=("the ", "of "), rubric_medium=("ment",),
    rubric_negation_pattern=r"\b(the of|de la)\b", version="prose-1",
)
ALERTS = AlertRules(recurring_theme="Promotion", recurring_theme_count=3, minimum_yearly_known_flags=1, citation_rate_increase=0.2)
RULES = {"f_share": MetricRule(0.30, "Share of closed orders"), "p_share": MetricRule(0.35, "Share of pending orders")}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------------------------------- Spark

def _source_row() -> Column:
    whole = lambda c, m=1: F.round(F.col(c) * m).cast("long")
    return F.concat_ws(
        "-", "l_linenumber", "l_partkey", "l_suppkey", whole("l_quantity"), whole("l_extendedprice", 100),
        whole("l_discount", 100), whole("l_tax", 100), F.date_format("l_shipdate", "yyyy-MM-dd"),
    )


def project_rows(spark: SparkSession, d: str, by_id: bool = False) -> DataFrame:
    """One row per lineitem: a project outcome and the citation text that goes with it.

    `by_id` is for those who group the rows by id: orders are met last and by their id as text, so that
    rows of an id lie together. It shuffles the parts' texts with the lines, which others need not.
    """
    l, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    # an order meets its customer once, not with every line
    placed = o.join(c.join(n, c.c_nationkey == n.n_nationkey), o.o_custkey == c.c_custkey)
    if by_id:
        joined = l.join(p, l.l_partkey == p.p_partkey).join(placed, l.l_orderkey.cast("string") == o.o_orderkey.cast("string"))
    else:
        joined = l.join(placed, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    label = F.when(F.col("l_returnflag") == "N", "NAI").when(F.col("l_returnflag") == "R", "VAI").otherwise("OAI")
    day = F.to_date("o_orderdate")
    return joined.select(
        _source_row().alias("source_row"), F.col("l_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("fei"), F.concat_ws(" ", "c_mktsegment", "n_name").alias("company"),
        F.col("n_name").alias("country"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("state"),
        F.year(day).alias("fiscal_year"), day.alias("date"), label.alias("classification"),
        F.when(F.col("l_linestatus") == "F", "Yes").otherwise("No").alias("posted"),
        F.col("p_brand").alias("project"), F.col("p_type").alias("product"),
        F.concat_ws(" ", F.col("p_name"), F.lower("p_type")).alias("long_text"), F.col("p_name").alias("short_text"),
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("pk"),
    )


PROJECT_COLUMNS = [
    "source_row", "id", "fei", "company", "city", "state", "country", "fiscal_year", "date", "classification", "posted",
    "project", "product",
]


def projects(rows: DataFrame) -> DataFrame:
    return rows.select(*PROJECT_COLUMNS)


def citations(rows: DataFrame) -> DataFrame:
    """The same rows as citations; every fifth part has no long description."""
    return rows.select(
        "source_row", "id", "fei", "date", F.col("project").alias("program"), F.concat(F.lit("REF-"), F.col("product")).alias("reference"),
        F.col("short_text").alias("short"), F.when(F.col("pk") % 5 != 0, F.col("long_text")).alias("long"),
    )


def faulty_projects(rows: DataFrame) -> DataFrame:
    """Negative control: conflicting dates and unknown classes for some keys."""
    shift = (F.col("k") % 97 == 0) & (F.col("line") % 2 == 0)
    return projects(rows.withColumns({
        "date": F.when(shift, F.date_add("date", 1)).otherwise(F.col("date")),
        "classification": F.when(F.col("pk") % 83 == 0, "PENDING").otherwise(F.col("classification")),
    }))


def faulty_citations(rows: DataFrame) -> DataFrame:
    """Negative control: some citations name another site."""
    return citations(rows.withColumn("fei", F.when(F.col("k") % 101 == 0, F.concat(F.lit("X"), "fei")).otherwise(F.col("fei"))))


def inspections(spark: SparkSession, d: str) -> DataFrame:
    """One row per order, in canonical columns."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    lines = l.join(p, l.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("posted"),
        F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", F.col("p_name"), F.lower("p_type")))), ". ").alias("texts"),
    )
    joined = (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .join(lines, o.o_orderkey == lines.l_orderkey, "left")
    )
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    company = F.concat_ws(" ", "c_mktsegment", "n_name")
    label = F.when(F.col("o_orderstatus") == "F", "OAI").when(F.col("o_orderstatus") == "P", "VAI").otherwise("NAI")
    return joined.select(
        k.cast("string").alias("inspection_id"), F.col("o_custkey").cast("string").alias("fei_number"),
        company.alias("company_name"), F.lower(company).alias("company_key"), F.col("c_name").alias("site_name"),
        F.col("o_custkey").cast("string").alias("site_key"), day.alias("inspection_date"), F.year(day).alias("inspection_year"),
        F.year(day).alias("fiscal_year"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("product_type"),
        F.col("o_orderpriority").alias("inspection_type"), F.when(k % 11 != 0, label).alias("classification"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")).alias("citation_indicator"),
        F.when(k % 5 != 0, F.col("lines").cast("int")).alias("observation_count"),
        F.concat(F.lit("Area "), (F.col("o_custkey") % 10).cast("string")).alias("project_area"),
        F.when(k % 7 != 0, F.col("texts")).alias("observation_text"),
        F.col("posted").alias("posted_citation_indicator"), F.col("lines").cast("int").alias("available_citation_count"),
    )


def annual(spark: SparkSession, d: str) -> DataFrame:
    """Yearly frequency of every part: the annual templates."""
    l, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    return joined.groupBy(F.year("o_orderdate").alias("year"), "p_partkey", "p_brand", "p_name", "p_type").agg(
        F.count("*").alias("frequency")
    ).select(
        "year", F.col("p_brand").alias("program"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("cite_id"),
        F.concat(F.lit("REF-"), F.col("p_type")).alias("reference"), F.col("p_name").alias("short"),
        F.concat_ws(" ", F.col("p_name"), F.lower("p_type")).alias("long"), "frequency",
        F.col("p_partkey").alias("pk"),
    )


OBS = [
    "dataset", "grain", "inspection_id", "observation_id", "text", "reference", "frequency", "company", "site", "fei", "date",
    "year", "product", "inspection_type", "source_file", "source_row", "invalid_reason",
]


def _obs(df: DataFrame, **columns: Column) -> DataFrame:
    types = {"frequency": "long", "year": "int"}
    return df.select(*[
        columns.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in OBS
    ])


def observation_sources(spark: SparkSession, d: str) -> DataFrame:
    """Citations, annual templates and documents as one stream of observations, with faults built in."""
    rows = project_rows(spark, d)
    k, line = F.col("k"), F.col("line")
    cited = _obs(
        rows, dataset=F.lit("real"), grain=F.lit("inspection"), inspection_id=F.col("id"),
        text=F.when((k % 103 == 0) & (line == 1), F.lit("  ")).otherwise(F.col("long_text")),
        reference=F.col("project"), company=F.when((k % 97 == 0) & (line == 7), F.upper(F.lit("other maker"))).otherwise(F.col("company")),
        site=F.col("fei"), fei=F.col("fei"), date=F.col("date"), year=F.col("fiscal_year"), product=F.col("product"),
        inspection_type=F.col("posted"),
        source_file=F.when((k % 107 == 0) & (line == 2), F.lit("")).otherwise(F.lit("citations")), source_row=F.col("source_row"),
    )
    yearly = _obs(
        annual(spark, d), dataset=F.lit("annual"), grain=F.lit("annual_template"), text=F.col("long"), reference=F.col("reference"),
        frequency=F.col("frequency"), year=F.col("year"), product=F.col("program"), source_file=F.lit("annual"),
        source_row=F.concat_ws("-", "year", "cite_id"),
    )
    prose = _obs(
        table(spark, d, "documents"), dataset=F.lit("additional"), grain=F.lit("inspection"), text=F.col("text"),
        # Some ids are used twice with different texts: variants.
        observation_id=F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("DOC-"), F.floor(F.col("doc_id") / 20).cast("string"))),
        reference=F.col("lang"), site=F.col("source"), source_file=F.lit("documents"), source_row=F.col("doc_id"),
    )
    return union_sources([cited, yearly, prose])


def labelled_index(spark: SparkSession, d: str, run_id: str = "run-1") -> DataFrame:
    """Corpus -> tags -> browsing index, groups being exact copies of a text."""
    corpus = build_corpus(observation_sources(spark, d), audited=False)
    # tags and assignments both come of the texts
    run = tag_run(corpus["observations"], materialize(corpus["texts"], "texts", "zstd"), run_id, taxonomy=PARTS)
    return build_browse_index(corpus["observations"], run["members"], run["assignments"], run["tags"])


def stored_index(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The browsing index, built from the tables and written once for the query that asks; its steps leave the disk.

    A query may name the columns that it reads, and no others are written.
    """
    with steps_dropped(spark):
        return materialize(labelled_index(spark, d).select(*columns or ["*"]), "index", "zstd", ("observation_id",))


def label_reviews(spark: SparkSession, d: str, index: DataFrame) -> DataFrame:
    """Reviews of every observation whose part of the hash says so: up to two revisions each."""
    digit = F.conv(F.substring("hash", 1, 2), 16, 10).cast("int")
    first = index.filter(digit % 3 != 0).select(
        "run_id", "observation_id", F.lit(1).alias("revision"),
        F.when(digit % 2 == 0, "Approve").otherwise("Reject").alias("action"),
    )
    second = index.filter(digit % 6 == 1).select(
        "run_id", "observation_id", F.lit(2).alias("revision"), F.lit("Modify").alias("action")
    )
    return first.unionByName(second)


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """Monthly order counts per segment and region, and per segment and nation."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    )
    month = F.date_format("o_orderdate", "yyyy-MM")
    both = F.explode(F.array(
        F.struct(F.col("r_name").alias("site"), F.lit("f_share").alias("metric"), F.lit("F").alias("s")),
        F.struct(F.col("n_name").alias("site"), F.lit("p_share").alias("metric"), F.lit("P").alias("s")),
    ))
    return joined.select(F.col("c_mktsegment").alias("study"), month.alias("month"), "o_orderstatus", both.alias("m")).groupBy(
        "study", F.col("m.site").alias("site"), "month", F.col("m.metric").alias("metric")
    ).agg(
        F.sum((F.col("o_orderstatus") == F.col("m.s")).cast("long")).alias("numerator"), F.count("*").alias("denominator")
    )


# --------------------------------------------------------------------------------------- oracle

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_word(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {quoted(w)})" for w in words) + ")" if words else "FALSE"


def all_words(low: str, words) -> str:
    return "(" + " AND ".join(f"contains({low}, {quoted(w)})" for w in words) + ")"


def theme_list(low: str, taxonomy: Taxonomy) -> str:
    """Oracle list of themes in taxonomy order."""
    items = ", ".join(f"CASE WHEN {any_word(low, words)} THEN {quoted(t)} END" for t, words in taxonomy.themes.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "project_rows": ((), """
SELECT concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity) AS BIGINT), CAST(round(l_extendedprice*100) AS BIGINT),
         CAST(round(l_discount*100) AS BIGINT), CAST(round(l_tax*100) AS BIGINT), strftime(l_shipdate, '%Y-%m-%d')) AS source_row,
       CAST(l_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS fei, c_mktsegment || ' ' || n_name AS company,
       n_name AS country, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(o_orderdate AS DATE) AS date,
       CASE l_returnflag WHEN 'N' THEN 'NAI' WHEN 'R' THEN 'VAI' ELSE 'OAI' END AS classification,
       CASE l_linestatus WHEN 'F' THEN 'Yes' ELSE 'No' END AS posted, p_brand AS project, p_type AS product,
       p_name || ' ' || lower(p_type) AS long_text, p_name AS short_text, l_orderkey AS k, l_linenumber AS line, l_partkey AS pk
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "citations": (("project_rows",), """
SELECT source_row, id, fei, date, project AS program, 'REF-' || product AS reference, short_text AS short,
       CASE WHEN pk % 5 <> 0 THEN long_text END AS long FROM project_rows"""),
    "faulty_projects": (("project_rows",), """
SELECT source_row, id, fei, company, country, fiscal_year,
       CASE WHEN k % 97 = 0 AND line % 2 = 0 THEN CAST(date + INTERVAL 1 DAY AS DATE) ELSE date END AS date,
       CASE WHEN pk % 83 = 0 THEN 'PENDING' ELSE classification END AS classification, posted, project, product FROM project_rows"""),
    "faulty_citations": (("project_rows",), """
SELECT source_row, id, CASE WHEN k % 101 = 0 THEN 'X' || fei ELSE fei END AS fei, date, project AS program,
       'REF-' || product AS reference, short_text AS short, CASE WHEN pk % 5 <> 0 THEN long_text END AS long FROM project_rows"""),
    "order_lines": ((), """
SELECT l_orderkey, count(*) AS lines, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS posted,
       string_agg(DISTINCT p_name || ' ' || lower(p_type), '. ' ORDER BY p_name || ' ' || lower(p_type)) AS texts
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"""),
    "inspections": (("order_lines",), """
SELECT CAST(o_orderkey AS VARCHAR) AS inspection_id, CAST(o_custkey AS VARCHAR) AS fei_number,
       c_mktsegment || ' ' || n_name AS company_name, lower(c_mktsegment || ' ' || n_name) AS company_key, c_name AS site_name,
       CAST(o_custkey AS VARCHAR) AS site_key, CAST(o_orderdate AS DATE) AS inspection_date,
       CAST(year(o_orderdate) AS INTEGER) AS inspection_year, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
       n_name AS country, c_mktsegment AS product_type, o_orderpriority AS inspection_type,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'OAI' WHEN o_orderstatus = 'P' THEN 'VAI' ELSE 'NAI' END AS classification,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS citation_indicator,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(lines AS INTEGER) END AS observation_count,
       'Area ' || CAST(o_custkey % 10 AS VARCHAR) AS project_area,
       CASE WHEN o_orderkey % 7 <> 0 THEN texts END AS observation_text,
       posted AS posted_citation_indicator, CAST(lines AS INTEGER) AS available_citation_count, o_orderkey AS k
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN order_lines ON o_orderkey = l_orderkey"""),
    "annual": ((), """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, p_brand AS program, 'C' || CAST(p_partkey AS VARCHAR) AS cite_id,
       'REF-' || p_type AS reference, p_name AS short, p_name || ' ' || lower(p_type) AS long, count(*) AS frequency, p_partkey AS pk
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY year(o_orderdate), p_partkey, p_brand, p_name, p_type"""),
    "obs_sources": (("project_rows", "annual"), r"""
SELECT 'real' AS dataset, 'inspection' AS grain, id AS inspection_id, CAST(NULL AS VARCHAR) AS observation_id,
       CASE WHEN k % 103 = 0 AND line = 1 THEN '  ' ELSE long_text END AS text, project AS reference, CAST(NULL AS BIGINT) AS frequency,
       CASE WHEN k % 97 = 0 AND line = 7 THEN 'OTHER MAKER' ELSE company END AS company, fei AS site, fei, CAST(date AS VARCHAR) AS date,
       fiscal_year AS year, product, posted AS inspection_type,
       CASE WHEN k % 107 = 0 AND line = 2 THEN '' ELSE 'citations' END AS source_file, source_row, 0 AS priority FROM project_rows
UNION ALL
SELECT 'annual', 'annual_template', NULL, NULL, long, reference, frequency, NULL, NULL, NULL, NULL, year, program, NULL,
       'annual', CAST(year AS VARCHAR) || '-' || cite_id, 1 FROM annual
UNION ALL
SELECT 'additional', 'inspection', NULL, CASE WHEN doc_id % 10 = 0 THEN 'DOC-' || CAST(doc_id // 20 AS VARCHAR) END, text, lang, NULL,
       NULL, source, NULL, NULL, NULL, NULL, NULL, 'documents', CAST(doc_id AS VARCHAR), 2 FROM documents"""),
    "obs_checked": (("obs_sources",), r"""
SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean,
       CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 'Empty or nontext observation'
            WHEN source_file = '' THEN 'Missing source identity' END AS reason FROM obs_sources"""),
    "obs_identity": (("obs_checked",), """
SELECT a.*, f.fei AS first_fei, f.date AS first_date, f.company AS first_company,
       coalesce(lower(a.fei) <> lower(f.fei), FALSE) OR coalesce(a.date <> f.date, FALSE) OR coalesce(lower(a.company) <> lower(f.company), FALSE) AS identity_conflict
FROM (SELECT * FROM obs_checked WHERE reason IS NULL) a
LEFT JOIN (SELECT inspection_id, fei, date, company FROM obs_checked WHERE reason IS NULL AND inspection_id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY inspection_id ORDER BY priority, TRY_CAST(source_row AS BIGINT) NULLS LAST, source_row) = 1) f USING (inspection_id)"""),
    "obs_keyed": (("obs_identity",), """
SELECT *, sha256(clean) AS hash,
       CASE WHEN identity_conflict THEN inspection_id || '-CONFLICT-' ||
            left(sha256(concat_ws('|', coalesce(fei, ''), coalesce(date, ''), coalesce(company, ''))), 12) ELSE inspection_id END AS iid
FROM obs_identity"""),
    "obs_ids": (("obs_keyed",), """
SELECT *, coalesce(observation_id, 'OBS-' || left(sha256(concat_ws('|', coalesce(iid, source_file || '#' || source_row),
       coalesce(reference, ''), hash, grain)), 32)) AS oid FROM obs_keyed"""),
    "obs_identified": (("obs_ids",), """
SELECT a.*, a.hash <> f.hash OR a.iid IS DISTINCT FROM f.iid OR a.dataset <> f.dataset AS variant_conflict,
       f.hash AS first_hash, f.dataset AS first_dataset,
       CASE WHEN a.hash <> f.hash OR a.iid IS DISTINCT FROM f.iid OR a.dataset <> f.dataset
            THEN a.oid || '-VAR-' || left(sha256(concat_ws('|', a.hash, coalesce(a.iid, ''), a.dataset)), 12) ELSE a.oid END AS obs_id
FROM obs_ids a JOIN (SELECT oid, hash, iid, dataset FROM obs_ids
     QUALIFY row_number() OVER (PARTITION BY oid ORDER BY priority, TRY_CAST(source_row AS BIGINT) NULLS LAST, source_row) = 1) f USING (oid)"""),
    "observations": (("obs_identified",), """
SELECT obs_id AS observation_id, hash, dataset, grain, iid AS inspection_id, company, site, year, product, inspection_type, frequency,
       clean, count(*) OVER (PARTITION BY obs_id) AS occurrences FROM obs_identified
QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY priority, TRY_CAST(source_row AS BIGINT) NULLS LAST, source_row) = 1"""),
    "measurements": ((), """
SELECT c_mktsegment AS study, r_name AS site, strftime(o_orderdate, '%Y-%m') AS month, 'f_share' AS metric,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS numerator, count(*) AS denominator
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL
UNION ALL
SELECT c_mktsegment, n_name, strftime(o_orderdate, '%Y-%m'), 'p_share',
       CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT), count(*)
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""),
}


def sentence_tags(source: str, text: str, taxonomy: Taxonomy) -> list[tuple[str, str]]:
    """Oracle CTE chain (name, sql) that classifies `text` of `source`; the last one is `classified`."""
    low = "lower(s)"
    words = [(t, w) for t, ws in taxonomy.themes.items() for w in ws]
    instruction = taxonomy.instruction_pattern.replace("(?i)", "")
    first_theme = "CASE " + " ".join(f"WHEN contains(low, {quoted(w)}) THEN {quoted(t)}" for t, w in words) + " END"
    first_word = "CASE " + " ".join(f"WHEN contains(low, {quoted(w)}) THEN {quoted(w)}" for t, w in words) + " END"
    unique = list(dict.fromkeys(w for _, w in words))
    keywords = "list_filter([" + ", ".join(f"CASE WHEN contains(low, {quoted(w)}) THEN {quoted(w)} END" for w in unique) + "], lambda x: x IS NOT NULL)[1:20]"
    q = "lower(quote)"
    critical = f"(NOT {any_word(q, taxonomy.severity_negations)} AND {any_word(q, taxonomy.critical)})"
    high = f"(NOT {any_word(q, taxonomy.severity_negations)} AND ({any_word(q, taxonomy.critical)} OR {any_word(q, taxonomy.high)}))"
    return [
        ("cls_hit", f"""SELECT *, list_filter(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
            lambda s: {any_word(low, unique)} AND NOT {any_word(low, taxonomy.negations)} AND NOT regexp_matches(s, {quoted(instruction)}, 'i'))[1] AS hit FROM {source}"""),
        ("cls_low", "SELECT *, lower(hit) AS low FROM cls_hit"),
        ("cls_word", f"SELECT *, {first_theme} AS first_theme, {first_word} AS first_word FROM cls_low"),
        ("cls_quote", "SELECT *, substring(hit, greatest(strpos(low, first_word) - 101, 0) + 1, 900) AS quote FROM cls_word"),
        ("classified", f"""SELECT *, coalesce(first_theme, 'Unclassified') AS theme,
            CASE WHEN hit IS NULL THEN 'Unclassified' ELSE 'Quality and compliance' END AS category,
            CASE WHEN hit IS NULL THEN 'Unclassified' WHEN {critical} THEN 'Critical' WHEN {high} THEN 'High'
                 WHEN {all_words('low', taxonomy.low_all)} THEN 'Low' ELSE 'Medium' END AS severity,
            CASE WHEN hit IS NULL THEN 0.1 ELSE 0.55 END AS confidence,
            CASE WHEN hit IS NULL THEN substring({text}, 1, 900) ELSE quote END AS evidence_quote,
            CASE WHEN hit IS NULL THEN '' ELSE array_to_string({keywords}, ',') END AS keywords FROM cls_quote"""),
    ]


_INDEX_CHAIN = sentence_tags("obs_texts", "clean", PARTS)
CTES["obs_texts"] = (("obs_identified",), "SELECT DISTINCT hash, clean FROM obs_identified")
for _i, (_name, _sql) in enumerate(_INDEX_CHAIN):
    CTES[f"ix_{_name}"] = (
        ("obs_texts",) if _i == 0 else (f"ix_{_INDEX_CHAIN[_i - 1][0]}",),
        _sql if _i == 0 else _sql.replace(f"FROM {_INDEX_CHAIN[_i - 1][0]}", f"FROM ix_{_INDEX_CHAIN[_i - 1][0]}"),
    )
CTES["idx"] = (("observations", "ix_classified"), """
SELECT 'run-1' AS run_id, o.observation_id, o.hash, o.inspection_id, o.dataset, o.grain, o.company, o.site, o.year, o.product,
       o.inspection_type, o.frequency, o.hash AS group_id, c.theme, c.severity,
       CASE c.severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS severity_rank,
       c.confidence, FALSE AS ai_generated, FALSE AS fallback
FROM observations o JOIN ix_classified c USING (hash)""")
CTES["reviews"] = (("idx",), """
SELECT run_id, observation_id, 1 AS revision, CASE WHEN d % 2 = 0 THEN 'Approve' ELSE 'Reject' END AS action
FROM (SELECT *, CAST('0x' || left(hash, 2) AS INTEGER) AS d FROM idx) WHERE d % 3 <> 0
UNION ALL
SELECT run_id, observation_id, 2, 'Modify' FROM (SELECT *, CAST('0x' || left(hash, 2) AS INTEGER) AS d FROM idx) WHERE d % 6 = 1""")


def with_views(names: str, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Oracle query: the named views and what they need, extra CTEs, then the body."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, sql = CTES[name]
        for n in needs:
            add(n)
        done[name] = sql.strip()

    for name in names.split():
        add(name)
    for name, sql in extra or []:
        done[name] = sql.strip()
    clauses = ",\n".join(f"{n} AS MATERIALIZED (\n{s}\n)" for n, s in done.items())
    return f"WITH {clauses}\n{body.strip()}" if clauses else body.strip()
