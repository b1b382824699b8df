"""Grounding and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditgrain.operators import evaluation as E
from auditgrain.operators import routing as R
from auditgrain.operators.metrics import annual_metrics
from auditgrain.plans.base import AS_OF, inspections, table, with_views
from auditgrain.plans.observations import TAGS, tags_and_reviews
from auditgrain.plans.registry import query
from auditgrain.plans.retrieval import VECTORS, centroids, vector_chunks
from auditgrain.plans.risk import ANNUAL_SQL
from auditgrain.plans.tagging import ROUTED, _route_sql


@query("EVL-1", "grounding_check", """SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS unknown_citations, CASE WHEN o_orderkey % 10 IN (3, 4) THEN 1 ELSE 0 END AS unsupported_numbers,
  o_orderkey % 10 NOT IN (3, 4) AS grounded FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    # Evidence writes the amount with separators; the answer without. Some answers cite nothing known or invent a number.
    evidence = o.select(k.alias("source_id"), F.concat(F.lit("Total "), F.format_number(F.round(F.col("o_totalprice") * 100).cast("long"), 0), F.lit(" cents.")).alias("text"))
    answers = o.select(k.alias("answer_id"), F.concat(F.lit("The order sums to "), F.when(k % 10 == 4, F.concat(cents, F.lit("7"))).otherwise(cents), F.lit(" cents")).alias("text"))
    cites = o.select(k.alias("answer_id"), F.when(k % 10 == 3, -k - 1).otherwise(k).alias("source_id"))
    return E.grounding_check(answers, cites, evidence)


EVAL = [*VECTORS,
        ("results", "SELECT query_id, 'vector' AS mode, chunk_id, label, rank FROM vec_hits UNION ALL SELECT query_id, 'reversed', chunk_id, label, 16 - rank FROM vec_hits"),
        ("top5", "SELECT *, row_number() OVER (PARTITION BY query_id, mode ORDER BY rank, chunk_id) AS position FROM results QUALIFY position <= 5"),
        ("golds", "SELECT query_id, count(*) AS gold FROM (SELECT label AS query_id FROM embeddings UNION ALL SELECT -1) GROUP BY query_id"),
        ("scored", """SELECT g.query_id, m.mode, g.gold, count(t.chunk_id) AS retrieved, count(CASE WHEN label = g.query_id THEN 1 END) AS hits, min(CASE WHEN label = g.query_id THEN position END) AS first_hit
            FROM golds g CROSS JOIN (SELECT DISTINCT mode FROM results) m LEFT JOIN top5 t ON t.query_id = g.query_id AND t.mode = m.mode GROUP BY ALL"""),
        ("rates", "SELECT query_id, mode, coalesce(round(hits::DOUBLE / nullif(retrieved, 0), 6), 0) AS precision, round(hits::DOUBLE / gold, 6) AS recall, coalesce(round(1.0::DOUBLE / first_hit, 6), 0) AS reciprocal_rank FROM scored")]


@query("EVL-2", "retrieval_eval", with_views("", "SELECT mode, count(precision) AS queries, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(reciprocal_rank), 4) AS reciprocal_rank FROM rates GROUP BY mode", EVAL))
def _(spark, d):
    from auditgrain.operators.retrieval import vector_search

    hits = vector_search(centroids(spark, d), vector_chunks(spark, d), 15)
    results = hits.select("query_id", F.lit("vector").alias("mode"), F.col("chunk_id").alias("document_id"), "rank").unionByName(
        hits.select("query_id", F.lit("reversed").alias("mode"), F.col("chunk_id").alias("document_id"), (16 - F.col("rank")).alias("rank"))
    )
    gold = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("document_id"))
    # one query has gold and no result at all
    gold = gold.unionAll(spark.range(1).select(F.lit(-1).cast("long"), F.col("id")))
    return E.retrieval_eval(results, gold)


@query("EVL-3", "numeric_agreement", with_views("inspections", """SELECT (SELECT count(*) FROM annual_m) AS expected, (SELECT count(*) FROM annual_m) - 1 AS equal,
  round(((SELECT count(*) FROM annual_m) - 1)::DOUBLE / (SELECT count(*) FROM annual_m), 6) AS agreement""", [("annual_m", ANNUAL_SQL)]))
def _(spark, d):
    df = inspections(spark, d)
    actual = annual_metrics(df, AS_OF).select("inspection_year", F.col("citation_known").alias("value"))
    expected = df.groupBy("inspection_year").agg(F.sum(F.when(F.col("citation_indicator").isNotNull(), 1).otherwise(0)).alias("value"))
    # One year is expected wrongly: a negative control.
    return E.numeric_agreement(actual, expected.withColumn("value", F.col("value") + (F.col("inspection_year") == 1997).cast("int")), ["inspection_year"])


@query("EVL-3", "evidence_grounding", with_views("inspections", """SELECT count(*) AS records, sum(CASE WHEN k % 17 = 0 THEN 0 ELSE 1 END)::BIGINT AS grounded,
  round(sum(CASE WHEN k % 17 = 0 THEN 0 ELSE 1 END)::DOUBLE / count(*), 6) AS grounding FROM inspections"""))
def _(spark, d):
    source = inspections(spark, d)
    altered = source.withColumn(
        "company_name", F.when(F.col("inspection_id").cast("long") % 17 == 0, F.concat("company_name", F.lit("!"))).otherwise(F.col("company_name"))
    )
    return E.evidence_grounding(altered, source, "inspection_id", ["company_name", "classification", "inspection_date", "observation_text"])


@query("EVL-3", "scope_correctness", with_views("inspections", "SELECT inspection_id, NOT (k % 9 = 0 AND classification IS NOT NULL) AS scope_correct FROM inspections"))
def _(spark, d):
    asked = inspections(spark, d).select("inspection_id", "classification", "inspection_year")
    applied = asked.withColumn("classification", F.when(F.col("inspection_id").cast("long") % 9 != 0, F.col("classification")))
    return E.scope_correctness(applied, asked, "inspection_id", ["classification", "inspection_year"])


DIMENSIONS = ["relevance", "groundedness", "completeness", "safety"]


@query("EVL-4", "judge_decision", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, overall, CASE WHEN overall >= 80 AND g >= 7 AND s >= 7 THEN 'PASS' WHEN overall >= 60 THEN 'REVISION_REQUIRED' ELSE 'FAIL' END AS decision FROM (
  SELECT *, round((r + g + c + s) / 4 * 10, 2) AS overall FROM (SELECT *, (l_quantity % 11) AS r, (l_partkey % 11)::DOUBLE AS g, (l_suppkey % 5 + 6)::DOUBLE AS c, (l_linenumber + 3)::DOUBLE AS s FROM lineitem))""")
def _(spark, d):
    scores = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") % 11).alias("relevance"), (F.col("l_partkey") % 11).cast("double").alias("groundedness"),
        (F.col("l_suppkey") % 5 + 6).cast("double").alias("completeness"), (F.col("l_linenumber") + 3).cast("double").alias("safety"),
    )
    return E.judge_decision(scores, DIMENSIONS).drop(*DIMENSIONS)


@query("EVL-5", "tag_accuracy", with_views("idx", """SELECT count(*) AS reviewed, round(avg(CASE WHEN t.category = r.category THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS category_accuracy,
  round(avg(CASE WHEN t.severity = r.severity THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS severity_accuracy, round(sum(len(list_intersect(t.themes, r.themes)))::DOUBLE / sum(len(t.themes)), 6) AS theme_precision,
  round(sum(len(list_intersect(t.themes, r.themes)))::DOUBLE / sum(len(r.themes)), 6) AS theme_recall FROM tags0 t JOIN reviewed r USING (observation_id)""", TAGS))
def _(spark, d):
    return E.tag_accuracy(*tags_and_reviews(spark, d))


@query("EVL-6", "routing_eval", with_views("", """SELECT t AS expected_target, count(*) AS queries, round(avg(CASE WHEN target = expected THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS routing_accuracy,
  round(avg(p), 6) AS precision, round(avg(r), 6) AS recall FROM (SELECT *, unnest([expected, 'ALL']) AS t FROM (SELECT *, CASE role WHEN 'user' THEN 'EvidenceAgent' WHEN 'system' THEN 'DataAnalyticsAgent' ELSE 'InspectionAssessmentAgent' END AS expected,
  CASE WHEN turn % 2 = 0 THEN (turn % 5) / 4.0::DOUBLE END AS p, CASE WHEN turn % 2 = 0 THEN (turn % 3) / 2.0::DOUBLE END AS r FROM routed)) GROUP BY t""", [
    ("asked", "SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN 'count of ' WHEN conv_id % 3 = 1 THEN 'quality of ' ELSE '' END || text AS text FROM conversations"),
    ("hits", _route_sql("asked", "text")), ROUTED]))
def _(spark, d):
    k = F.col("conv_id") % 3
    asked = table(spark, d, "conversations").withColumn("text", F.concat(F.when(k == 0, "count of ").when(k == 1, "quality of ").otherwise(""), "text"))
    routed = R.route_text(asked).withColumns({
        "expected_target": F.when(F.col("role") == "user", "EvidenceAgent").when(F.col("role") == "system", "DataAnalyticsAgent").otherwise("InspectionAssessmentAgent"),
        "precision": F.when(F.col("turn") % 2 == 0, F.col("turn") % 5 / 4.0), "recall": F.when(F.col("turn") % 2 == 0, F.col("turn") % 3 / 2.0),
    })
    return E.routing_eval(routed)


