"""Monthly quality measurements: validation, duplicates, thresholds, forecasts and audit events.

After `dedupe_measurements` a series has one row per calendar month, so windows per series stay
small whatever the input size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditgrain.functions.config import MetricRule
from auditgrain.functions.expressions import month_index, month_label, reasons
from auditgrain.operators.ranking import top_k
from auditgrain.operators.rollup import dataset_fingerprint

KEY = ["study", "site", "month", "metric"]
SERIES = ["study", "site", "metric"]


def validate_measurements(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Adds `reason`: empty for a valid record. Counts may arrive as text."""
    number = lambda c: F.col(c).cast("string").try_cast("long")
    length = lambda c: F.coalesce(F.length(c).between(1, 100), F.lit(False))
    month = F.col("month")
    month_ok = F.coalesce(
        month.rlike(r"^\d{4}-\d{2}$") & F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd")).isNotNull(),
        F.lit(False),
    )
    n, d = number("numerator"), number("denominator")
    return df.withColumn("reason", F.array_join(reasons(
        (~length("study"), "study length"), (~length("site"), "site length"), (~month_ok, "month"),
        (~F.coalesce(F.col("metric").isin(*metrics), F.lit(False)), "metric"),
        (F.coalesce(n < 0, F.lit(True)), "numerator"), (F.coalesce(d <= 0, F.lit(True)), "denominator"),
        (F.coalesce(n > d, F.lit(False)), "numerator exceeds denominator"),
    ), "; "))


def dedupe_measurements(df: DataFrame) -> DataFrame:
    """One row per key with `copies` and `conflict` (same key, other counts).

    Conflicting keys keep their lowest counts and are flagged; the caller decides to reject.
    """
    value = F.struct("numerator", "denominator")
    return df.groupBy(*KEY).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("copies")
    ).select(*KEY, "_lo.numerator", "_lo.denominator", "copies", (F.col("_lo") != F.col("_hi")).alias("conflict"))


def measurement_snapshot(df: DataFrame, kind: str = "real") -> DataFrame:
    """Content id, studies, month range and record count. The same content gives the same id."""
    print_of = dataset_fingerprint(df.withColumn("_kind", F.lit(kind)), ["_kind", *KEY, "numerator", "denominator"])
    facts = df.agg(
        F.array_join(F.sort_array(F.collect_set("study")), ",").alias("studies"), F.min("month").alias("min_month"),
        F.max("month").alias("max_month"), F.count("*").alias("records"),
    )
    return facts.withColumn("snapshot_id", F.substring(print_of.select("fingerprint").scalar(), 1, 24))


def rate_history(df: DataFrame, as_of: str) -> DataFrame:
    """Rates of complete months only, with the number of rows left out."""
    this_month = as_of[:7]
    excluded = df.filter(F.col("month") >= this_month).agg(F.count("*")).scalar()
    return df.filter(F.col("month") < this_month).select(
        *KEY, "numerator", "denominator",
        (F.col("numerator").cast("double") / F.col("denominator")).alias("rate"), excluded.alias("excluded_rows"),
    )


def _thresholds(rules: Mapping[str, MetricRule]) -> Column:
    out = F.lit(None).cast("double")
    for name, rule in rules.items():
        out = F.when(F.col("metric") == name, F.lit(float(rule.threshold))).otherwise(out)
    return out


def latest_month(history: DataFrame) -> DataFrame:
    """The newest row of every series."""
    rest = [c for c in history.columns if c not in SERIES]
    return history.groupBy(*SERIES).agg(F.max_by(F.struct(*rest), "month").alias("_r")).select(*SERIES, "_r.*")


def threshold_breach(history: DataFrame, rules: Mapping[str, MetricRule]) -> DataFrame:
    """Series whose latest rate is strictly above the limit of its metric."""
    return latest_month(history).withColumn("threshold", _thresholds(rules)).filter(F.col("rate") > F.col("threshold"))


def _line(n: Column, sum_y: Column, sum_iy: Column, at: Column) -> Column:
    """Least-squares line through (0, y0) … (n-1, yn-1), read at `at`, clipped to [0, 1]."""
    mean_x = (n - 1) / F.lit(2.0)
    spread = n * (n * n - 1) / F.lit(12.0)
    slope = F.when(n > 1, (sum_iy - mean_x * sum_y) / spread).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum_y / n + slope * (at - mean_x)))


def backtest(history: DataFrame) -> DataFrame:
    """Expanding one-step tests from three points on: mean error of the line and of the last value.

    Closed-form least squares over running sums; no per-series loop.
    """
    ordered = Window.partitionBy(*SERIES).orderBy("month")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    steps = history.withColumn("_i", (F.row_number().over(ordered) - 1).cast("double"))
    steps = steps.withColumn("_iy", F.col("_i") * F.col("rate"))
    steps = steps.withColumns({
        "_sy": F.sum("rate").over(before), "_siy": F.sum("_iy").over(before), "_last": F.lag("rate").over(ordered),
    })
    tested = F.col("_i") >= 3
    line = _line(F.col("_i"), F.col("_sy"), F.col("_siy"), F.col("_i"))
    return steps.groupBy(*SERIES).agg(
        F.count(F.when(tested, 1)).alias("backtest_folds"),
        F.avg(F.when(tested, F.abs(line - F.col("rate")))).alias("linear_mae"),
        F.avg(F.when(tested, F.abs(F.col("_last") - F.col("rate")))).alias("last_value_mae"),
    )


def linear_forecast(
    history: DataFrame, as_of: str, horizon: int = 3, min_months: int = 6
) -> DataFrame:
    """One row per series and projected month; series that cannot be projected give one status row.

    The trend is used only where it beat the last value in the backtest; the band is that method's
    past error. Gaps are never filled.
    """
    ordered = Window.partitionBy(*SERIES).orderBy("month")
    indexed = history.withColumns({
        "_m": month_index(F.col("month")), "_i": (F.row_number().over(ordered) - 1).cast("double"),
    }).withColumn("_gap", F.col("_m") - F.lag("_m").over(ordered))
    stats = indexed.groupBy(*SERIES).agg(
        F.count("*").alias("complete_months"), F.max("_m").alias("_end"),
        F.sum(F.when(F.col("_gap") != 1, 1).otherwise(0)).alias("_gaps"),
        F.sum("rate").alias("_sy"), F.sum(F.col("_i") * F.col("rate")).alias("_siy"),
        F.max_by("rate", "_m").alias("_last"), F.max("month").alias("training_end"),
    )
    joined = stats.join(backtest(history), SERIES)
    status = (
        F.when(F.col("complete_months") < min_months, "insufficient_history")
        .when(F.col("_gaps") > 0, "missing_periods").otherwise("exploratory")
    )
    ready = F.col("status") == "exploratory"
    trend = F.col("linear_mae") < F.col("last_value_mae")
    end = date.fromisoformat(as_of)
    joined = joined.withColumn("status", status).withColumns({
        "method": F.when(ready, F.when(trend, "linear_trend").otherwise("last_value")),
        "stale_history": F.when(ready, F.col("_end") < end.year * 12 + end.month - 2),
    })
    steps = F.when(ready, F.sequence(F.lit(1), F.lit(horizon))).otherwise(F.array(F.lit(None).cast("int")))
    points = joined.withColumn("h", F.explode(steps))
    n = F.col("complete_months").cast("double")
    value = F.when(
        F.col("method") == "linear_trend", _line(n, F.col("_sy"), F.col("_siy"), n - 1 + F.col("h"))
    ).otherwise(F.col("_last"))
    error = F.when(F.col("method") == "linear_trend", F.col("linear_mae")).otherwise(F.col("last_value_mae"))
    points = points.withColumns({"_v": F.when(F.col("h").isNotNull(), value), "_e": error})
    known = F.col("_v").isNotNull()
    return points.select(
        *SERIES, "status", "method", "stale_history", "training_end", "complete_months", "backtest_folds",
        month_label(F.col("_end") + F.col("h")).alias("month"), F.round("_v", 6).alias("rate"),
        F.when(known, F.round(F.greatest(F.lit(0.0), F.col("_v") - F.col("_e")), 6)).alias("error_low"),
        F.when(known, F.round(F.least(F.lit(1.0), F.col("_v") + F.col("_e")), 6)).alias("error_high"),
    )


def forecast_breach(forecast: DataFrame, history: DataFrame, rules: Mapping[str, MetricRule], as_of: str) -> DataFrame:
    """Series projected above their limit from this month on, unless they breach it already."""
    above = forecast.withColumn("threshold", _thresholds(rules)).filter(
        (F.col("month") >= as_of[:7]) & (F.col("rate") > F.col("threshold"))
    ).groupBy(*SERIES).agg(F.min("month").alias("first_breach_month"), F.max("threshold").alias("threshold"))
    return above.join(threshold_breach(history, rules).select(*SERIES), SERIES, "left_anti")


def qc_signals(history: DataFrame, rules: Mapping[str, MetricRule], as_of: str) -> DataFrame:
    """Current and projected breaches in one schema."""
    now = threshold_breach(history, rules).select(*SERIES, F.lit("threshold_breach").alias("reason"), "month", "threshold")
    later = forecast_breach(linear_forecast(history, as_of), history, rules, as_of).select(*SERIES, "threshold")
    latest = latest_month(history).select(*SERIES, "month")
    soon = later.join(latest, SERIES).select(*SERIES, F.lit("forecast_threshold").alias("reason"), "month", "threshold")
    return now.unionByName(soon)


def cross_site_patterns(signals: DataFrame) -> DataFrame:
    """Study and metric flagged at more than one site: how many sites."""
    sites = signals.groupBy("study", "metric").agg(F.countDistinct("site").alias("site_count"))
    return sites.filter(F.col("site_count") > 1)


def cross_site_members(signals: DataFrame) -> DataFrame:
    """The flagged sites of every cross-site pattern, as rows."""
    return signals.select("study", "metric", "site").distinct().join(
        cross_site_patterns(signals), ["study", "metric"]
    ).orderBy("study", "metric", "site")


def signal_events(
    signals: DataFrame, reviews: DataFrame, dataset: str = "dataset_id", limit: int = 200
) -> tuple[DataFrame, DataFrame]:
    """(latest events per dataset with their signal, reviews of unknown signals)."""
    known = reviews.join(signals, "signal_id", "inner")
    unknown = reviews.join(signals.select("signal_id"), "signal_id", "left_anti")
    return top_k(known, [dataset], [F.col("event_seq").desc()], limit, "event_rank"), unknown
