"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

The inspection view and the browsing index are built first (timed as `etl_inspections` and
`tagging_run`) and stored, as a service would keep them; the other queries read the stored tables.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrain.functions.expressions import squeeze
from auditgrain.operators import alerts, browse, fulltext, grouping, metrics, normalize, qc, retrieval, risk, rollup, tagging, trend
from auditgrain.operators.observations import dedupe_texts
from auditgrain.plans import base
from auditgrain.plans.retrieval import centroids, hybrid_tables, passages, texts, vector_chunks
from auditgrain.session import local_session, materialize


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    shared = tempfile.TemporaryDirectory(prefix="auditgrain-bench-")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "auditgrain-bench", shared.name)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, build) -> DataFrame | None:
        start = time.perf_counter()
        out = build()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    def stored(name: str, build) -> DataFrame:
        start = time.perf_counter()
        out = materialize(build(), name)
        times[name] = round(time.perf_counter() - start, 3)
        return out

    spark.range(1000).selectExpr("sum(id)").collect()
    df = stored("etl_inspections", lambda: base.inspections(spark, d))
    index = stored("tagging_run", lambda: base.labelled_index(spark, d))
    as_of, parts = base.AS_OF, base.PARTS

    timed("dashboard_aggregate", lambda: metrics.portfolio_metrics(df, as_of))
    timed("year_filtered_dashboard", lambda: metrics.portfolio_metrics(normalize.filter_inspections(df, year=1998), as_of))
    timed("annual_metrics", lambda: metrics.annual_metrics(df, as_of))
    summary = stored("entity_summary", lambda: risk.entity_summary(df, "site", as_of, taxonomy=parts))
    timed("ranked_sites", lambda: risk.rank_entities(summary, limit=25))
    timed("risk_trend", lambda: trend.risk_trend(df, ["site_key"], as_of, taxonomy=parts))
    timed("site_alerts", lambda: alerts.site_alerts(df, as_of, rules=base.ALERTS, taxonomy=parts))
    timed("unfiltered_recurrence", lambda: metrics.theme_recurrence(df, parts, "site_key"))
    timed("observation_summary", lambda: browse.workspace_summary(index))
    pages = browse.store_index(index, [("severity", "desc")])
    timed("observation_page", lambda: browse.stored_page(pages, "severity", "desc", 25, 25))
    timed("observation_search", lambda: normalize.search_literal(base.table(spark, d, "documents"), 'token = "', ["text"]))
    timed("company_theme_metrics", lambda: browse.observation_theme_metrics(
        browse.filter_observations(pages.rows, company="HOUSEHOLD NATION_3"), "theme"))
    rows = base.project_rows(spark, d)

    def rolled() -> DataFrame:
        both = materialize(rows, "project-rows")
        return rollup.roll_up_projects(base.projects(both), base.citations(both), as_of).drop("project_classifications", "source_record")

    timed("roll_up_projects", rolled)
    timed("qc_forecast", lambda: qc.linear_forecast(qc.rate_history(base.measurements(spark, d), "2001-08-01"), "2001-08-01"))

    unique = materialize(dedupe_texts(rows.select(F.col("long_text").alias("text"))), "texts")
    themes = tagging.classify_observation(unique, parts).select("hash", "theme")
    timed("grouping_run", lambda: grouping.group_texts(grouping.lexical_vector(unique, {}, [], []), themes, 0.78))
    docs = base.table(spark, d, "documents")
    key = lambda c: tagging.cache_key(c, "rules", "deterministic", "v", "p")
    cache = materialize(dedupe_texts(docs).select(key(F.col("text")).alias("cache_key")), "cache")
    timed("second_run_cached", lambda: tagging.incremental_untagged(dedupe_texts(docs), cache, "rules", "deterministic", "v", "p"))
    timed("classify_documents", lambda: tagging.classify_observation(docs.select("doc_id", squeeze("text").alias("text")), base.PROSE))
    timed("chunk_documents", lambda: retrieval.chunk_documents(docs)[0])
    timed("vector_search", lambda: retrieval.vector_search(centroids(spark, d), vector_chunks(spark, d), 10))
    timed("keyword_search", lambda: retrieval.keyword_search(passages(spark, d), texts(spark, d), 5))
    timed("fulltext_search", lambda: fulltext.fulltext_search(passages(spark, d), texts(spark, d), 10, plain=True))
    timed("hybrid_search", lambda: retrieval.hybrid_search(*hybrid_tables(spark, d), 5, {"half": "low"}, plain=True))

    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d)}))
    spark.stop()
    shared.cleanup()


if __name__ == "__main__":
    main()
