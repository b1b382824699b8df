"""Quality measurement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditgrain.operators import qc as Q
from auditgrain.plans.base import RULES, measurements, table, with_views
from auditgrain.plans.registry import query
from auditgrain.plans.rollup import fingerprint_sql

NOW = "2001-08-01"
EARLY = "1995-06-15"

HISTORY = ("history", "SELECT *, numerator::DOUBLE / denominator AS rate FROM measurements WHERE month < '2001-08'")
LATEST = ("latest", "SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY study, site, metric ORDER BY month DESC) = 1")
BREACH = ("breach", "SELECT *, CASE metric WHEN 'f_share' THEN 0.3 ELSE 0.35 END AS threshold FROM latest WHERE rate > CASE metric WHEN 'f_share' THEN 0.3::DOUBLE ELSE 0.35::DOUBLE END")
LINE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {sy} / {n} + CASE WHEN {n} > 1 THEN ({siy} - ({n} - 1) / 2.0::DOUBLE * {sy}) / ({n} * ({n} * {n} - 1) / 12.0::DOUBLE) ELSE 0 END * ({at} - ({n} - 1) / 2.0::DOUBLE)))"
W = "PARTITION BY study, site, metric ORDER BY month"


def forecast_chain(history: str) -> list[tuple[str, str]]:
    prior = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return [
        ("stepped", f"SELECT *, CAST(row_number() OVER ({W}) - 1 AS DOUBLE) AS i, CAST(left(month, 4) AS INTEGER) * 12 + CAST(right(month, 2) AS INTEGER) - 1 AS m, lag(rate) OVER ({W}) AS prev FROM {history}"),
        ("running", f"SELECT *, m - lag(m) OVER ({W}) AS gap, sum(rate) {prior} AS sy, sum(i * rate) {prior} AS siy FROM stepped"),
        ("tested", f"""SELECT study, site, metric, count(CASE WHEN i >= 3 THEN 1 END) AS backtest_folds,
            avg(CASE WHEN i >= 3 THEN abs({LINE.format(n='i', sy='sy', siy='siy', at='i')} - rate) END) AS linear_mae, avg(CASE WHEN i >= 3 THEN abs(prev - rate) END) AS last_value_mae,
            count(*) AS complete_months, max(m) AS e, sum(CASE WHEN gap <> 1 THEN 1 ELSE 0 END) AS gaps, sum(rate) AS sy, sum(i * rate) AS siy, arg_max(rate, m) AS last, max(month) AS training_end
            FROM running GROUP BY study, site, metric"""),
        ("judged", """SELECT *, CASE WHEN complete_months < 6 THEN 'insufficient_history' WHEN gaps > 0 THEN 'missing_periods' ELSE 'exploratory' END AS status FROM tested"""),
        ("chosen", """SELECT *, CASE WHEN status = 'exploratory' THEN CASE WHEN linear_mae < last_value_mae THEN 'linear_trend' ELSE 'last_value' END END AS method FROM judged"""),
        ("projected", f"""SELECT *, CASE WHEN h IS NOT NULL THEN CASE method WHEN 'linear_trend' THEN {LINE.format(n='complete_months::DOUBLE', sy='sy', siy='siy', at='(complete_months - 1 + h)')} ELSE last END END AS v,
            CASE method WHEN 'linear_trend' THEN linear_mae ELSE last_value_mae END AS err FROM (SELECT *, unnest(CASE WHEN status = 'exploratory' THEN [1, 2, 3] ELSE [NULL] END) AS h FROM chosen)"""),
    ]


FORECAST_SQL = """SELECT study, site, metric, status, method, training_end, complete_months, backtest_folds,
  CASE WHEN h IS NOT NULL THEN lpad(CAST((e + h) // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST((e + h) % 12 + 1 AS VARCHAR), 2, '0') END AS month, round(v, 6) AS rate,
  CASE WHEN v IS NOT NULL THEN round(greatest(0.0::DOUBLE, v - err), 6) END AS error_low, CASE WHEN v IS NOT NULL THEN round(least(1.0::DOUBLE, v + err), 6) END AS error_high,
  CASE WHEN status = 'exploratory' THEN e < {now} - 1 END AS stale_history FROM projected"""
NOW_MONTH, EARLY_MONTH = 2001 * 12 + 7, 1995 * 12 + 5


def history(spark, d, as_of=NOW):
    return Q.rate_history(measurements(spark, d), as_of)


@query("QC-1", "validate_measurements", with_views("measurements", """SELECT study, site, month, metric, concat_ws('; ', CASE WHEN bad = 0 THEN 'study length' END, CASE WHEN bad = 1 THEN 'month' END,
  CASE WHEN bad = 2 THEN 'metric' END, CASE WHEN bad = 3 THEN 'numerator' END, CASE WHEN bad = 4 THEN 'numerator exceeds denominator' END) AS reason FROM marked""", [
    ("marked", """SELECT CASE WHEN b = 0 THEN '' ELSE study END AS study, site, CASE WHEN b = 1 THEN left(month, 5) || '13' ELSE month END AS month, CASE WHEN b = 2 THEN 'other' ELSE metric END AS metric, b AS bad
        FROM (SELECT *, (numerator * 7 + denominator) % 11 AS b FROM measurements)""")]))
def _(spark, d):
    b = (F.col("numerator") * 7 + F.col("denominator")) % 11
    marked = measurements(spark, d).select(
        F.when(b == 0, "").otherwise(F.col("study")).alias("study"), "site",
        F.when(b == 1, F.concat(F.substring("month", 1, 5), F.lit("13"))).otherwise(F.col("month")).alias("month"),
        F.when(b == 2, "other").otherwise(F.col("metric")).alias("metric"),
        F.when(b == 3, "1.5").when(b == 4, (F.col("denominator") + 1).cast("string")).otherwise(F.col("numerator").cast("string")).alias("numerator"),
        "denominator",
    )
    return Q.validate_measurements(marked, list(RULES)).select("study", "site", "month", "metric", "reason")


@query("QC-2", "dedupe_measurements", with_views("measurements", """SELECT study, site, month, metric, numerator, denominator,
  CASE WHEN denominator % 5 = 0 THEN 2 WHEN denominator % 7 = 0 THEN 2 ELSE 1 END AS copies, denominator % 5 <> 0 AND denominator % 7 = 0 AS conflict FROM measurements"""))
def _(spark, d):
    m = measurements(spark, d)
    twice = m.filter(F.col("denominator") % 5 == 0)
    other = m.filter((F.col("denominator") % 5 != 0) & (F.col("denominator") % 7 == 0)).withColumn("numerator", F.col("numerator") + 1)
    return Q.dedupe_measurements(m.unionByName(twice).unionByName(other))


@query("QC-3", "measurement_snapshot", with_views("measurements", f"""SELECT string_agg(DISTINCT study, ',' ORDER BY study) AS studies, min(month) AS min_month, max(month) AS max_month, count(*) AS records,
  (SELECT left(fingerprint, 24) FROM ({fingerprint_sql('measurements', "'real', study, site, month, metric, CAST(numerator AS VARCHAR), CAST(denominator AS VARCHAR)")})) AS snapshot_id FROM measurements"""))
def _(spark, d):
    return Q.measurement_snapshot(measurements(spark, d))


@query("QC-4", "rate_history", with_views("measurements", """SELECT study, site, month, metric, numerator, denominator, round(rate, 6) AS rate,
  (SELECT count(*) FROM measurements WHERE month >= '2001-08') AS excluded_rows FROM history""", [HISTORY]))
def _(spark, d):
    return history(spark, d).withColumn("rate", F.round("rate", 6))


@query("QC-5", "threshold_breach", with_views("measurements", "SELECT study, site, metric, month, round(rate, 6) AS rate, threshold FROM breach", [HISTORY, LATEST, BREACH]))
def _(spark, d):
    return Q.threshold_breach(history(spark, d), RULES).select("study", "site", "metric", "month", F.round("rate", 6).alias("rate"), "threshold")


@query("QC-6", "linear_forecast", with_views("measurements", FORECAST_SQL.format(now=NOW_MONTH), [HISTORY, *forecast_chain("history")]))
def _(spark, d):
    return Q.linear_forecast(history(spark, d), NOW)


@query("QC-6", "linear_forecast_early", with_views("measurements", FORECAST_SQL.format(now=EARLY_MONTH), [
    ("history", HISTORY[1].replace("2001-08", "1995-06")), *forecast_chain("history")]))
def _(spark, d):
    return Q.linear_forecast(history(spark, d, EARLY), EARLY)


@query("QC-7", "backtest", with_views("measurements", "SELECT study, site, metric, backtest_folds, round(linear_mae, 6) AS linear_mae, round(last_value_mae, 6) AS last_value_mae FROM tested", [HISTORY, *forecast_chain("history")]))
def _(spark, d):
    return Q.backtest(history(spark, d)).select(
        "study", "site", "metric", "backtest_folds", F.round("linear_mae", 6).alias("linear_mae"), F.round("last_value_mae", 6).alias("last_value_mae")
    )


SOON = ("soon", """SELECT study, site, metric, min(month) AS first_breach_month, max(CASE metric WHEN 'f_share' THEN 0.3 ELSE 0.35 END) AS threshold FROM forecast
  WHERE month >= '2001-08' AND rate > CASE metric WHEN 'f_share' THEN 0.3::DOUBLE ELSE 0.35::DOUBLE END
  AND (study, site, metric) NOT IN (SELECT (study, site, metric) FROM breach) GROUP BY study, site, metric""")
SIGNAL_CHAIN = [HISTORY, LATEST, BREACH, *forecast_chain("history"), ("forecast", FORECAST_SQL.format(now=NOW_MONTH)), SOON]


@query("QC-8", "forecast_breach", with_views("measurements", "SELECT study, site, metric, first_breach_month, threshold FROM soon", SIGNAL_CHAIN))
def _(spark, d):
    h = history(spark, d)
    return Q.forecast_breach(Q.linear_forecast(h, NOW), h, RULES, NOW)


SIGNALS = ("signals", "SELECT study, site, metric FROM breach UNION ALL SELECT study, site, metric FROM soon")
PATTERNS = ("patterns", "SELECT study, metric, count(DISTINCT site) AS site_count FROM signals GROUP BY study, metric HAVING count(DISTINCT site) > 1")


@query("QC-9", "cross_site_patterns", with_views("measurements", "SELECT DISTINCT study, metric, site, site_count FROM patterns JOIN signals USING (study, metric)", [*SIGNAL_CHAIN, SIGNALS, PATTERNS]))
def _(spark, d):
    return Q.cross_site_members(Q.qc_signals(history(spark, d), RULES, NOW))


REVIEWS = ("order_reviews", """SELECT o_orderkey AS event_seq, o_orderstatus AS dataset_id, c_mktsegment AS study, n_name AS site, 'p_share' AS metric
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")


@query("QC-10", "signal_events", with_views("measurements", """SELECT dataset_id, event_rank, event_seq, study, site, 'known' AS outcome FROM (
  SELECT r.*, row_number() OVER (PARTITION BY dataset_id ORDER BY event_seq DESC) AS event_rank FROM order_reviews r JOIN breach b USING (study, site, metric)) WHERE event_rank <= 200
UNION ALL SELECT dataset_id, NULL, event_seq, NULL, NULL, 'unknown' FROM order_reviews WHERE (study, site, metric) NOT IN (SELECT (study, site, metric) FROM breach)""",
    [HISTORY, LATEST, BREACH, REVIEWS]))
def _(spark, d):
    name = F.concat_ws("|", "study", "site", "metric").alias("signal_id")
    signals = Q.threshold_breach(history(spark, d), RULES).select(name, "study", "site")
    # Every order reviews the signal of its customer's segment and nation; many have none.
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    reviews = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderkey").alias("event_seq"), F.col("o_orderstatus").alias("dataset_id"),
        F.concat_ws("|", "c_mktsegment", "n_name", F.lit("p_share")).alias("signal_id"),
    )
    events, unknown = Q.signal_events(signals, reviews)
    known = events.select("dataset_id", "event_rank", "event_seq", "study", "site", F.lit("known").alias("outcome"))
    return known.unionByName(unknown.select(
        "dataset_id", F.lit(None).cast("int").alias("event_rank"), "event_seq", F.lit(None).cast("string").alias("study"),
        F.lit(None).cast("string").alias("site"), F.lit("unknown").alias("outcome"),
    ))
