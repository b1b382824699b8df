"""Yearly trends without future leakage, period changes and chart facts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditgrain.functions.config import RiskConfig
from auditgrain.functions.expressions import contains_any, count_if, known_ratio
from auditgrain.functions.taxonomy import RISK_TAXONOMY, Taxonomy, theme_flags
from auditgrain.operators.metrics import CLASSES, is_partial
from auditgrain.operators.risk import SUMS, score_totals, theme_columns, yearly_facts


def risk_trend(
    df: DataFrame, keys: Sequence[str], as_of: str, cfg: RiskConfig | None = None,
    taxonomy: Taxonomy = RISK_TAXONOMY, theme: str | None = None, start: int | None = None, end: int | None = None,
) -> DataFrame:
    """Per entity and year: that year's counts, and the risk of all history up to the year's cut-off.

    History is a running sum over the (entity, year) totals, so records are read once and never
    multiplied by the number of years. The cut-off is the earlier of Dec-31 and `as_of`.
    """
    if start and end and start > end:
        raise ValueError("start year must not exceed end year")
    cfg = cfg or RiskConfig()
    if theme:
        df = df.filter(contains_any(F.lower("observation_text"), taxonomy.themes[theme]))
    df = df.filter(F.col("inspection_year").isNotNull())
    limit = F.lit(date.fromisoformat(as_of))
    # Two facts per year: all of the year's records, and those on or before as_of (history).
    parts = df.withColumn("_past", F.col("inspection_date").isNotNull() & (F.col("inspection_date") <= limit))
    facts = yearly_facts(parts, [*keys, "_past"], taxonomy)
    themes = list(theme_columns(taxonomy).values())
    year = facts.groupBy(*keys, "inspection_year").agg(
        *[F.sum(c).alias(f"cur_{c}") for c in SUMS],
        *[F.sum(c).alias(f"cur_{c}") for c in themes],
        *[F.coalesce(F.sum(F.when(F.col("_past"), F.col(c))), F.lit(0)).alias(c) for c in (*SUMS, *themes)],
        F.max(F.when(F.col("_past"), F.col("adverse_day"))).alias("adverse_day"),
    )
    ordered = Window.partitionBy(*keys).orderBy("inspection_year")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rate = known_ratio(F.col("cite_pos"), F.col("cite_known"))
    history = year.withColumn("_rate", rate)
    history = history.withColumn("_step", F.col("_rate") - F.last("_rate", ignorenulls=True).over(before))
    history = history.withColumns({
        "trend": F.last("_step", ignorenulls=True).over(upto),
        "adverse_day": F.max("adverse_day").over(upto),
        **{c: F.sum(c).over(upto) for c in (*SUMS, *themes)},
    })
    dec31 = F.make_date("inspection_year", F.lit(12), F.lit(31))
    cutoff = F.least(dec31, limit)
    recurring = F.array_compact(F.array(*[
        F.when(F.col(f"cur_{c}") > 0, F.lit(t)) for t, c in theme_columns(taxonomy).items()
    ]))
    known = F.col("cur_oai") + F.col("cur_vai") + F.col("cur_nai")
    history = history.withColumns({
        "cutoff": cutoff,
        "total_inspections": F.col("cur_total"),
        "citation_rate": known_ratio(F.col("cur_cite_pos"), F.col("cur_cite_known")),
        "oai_rate": known_ratio(F.col("cur_oai"), known),
        "average_observations": known_ratio(F.col("cur_obs_sum"), F.col("cur_obs_known")),
        "recurring_themes": recurring,
        "partial_year": cutoff < dec31,
    })
    keep = [
        *keys, "inspection_year", "total_inspections", "citation_rate", "oai_rate", "average_observations",
        "recurring_themes", "partial_year",
    ]
    scored = score_totals(history, keep, F.col("cutoff"), cfg, taxonomy, details=False)
    if start:
        scored = scored.filter(F.col("inspection_year") >= start)
    if end:
        scored = scored.filter(F.col("inspection_year") <= end)
    return scored


def risk_change(trend: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last minus first score; null if there is one year only or either score is null."""
    points = trend.groupBy(*keys).agg(
        F.count("*").alias("years"),
        F.min_by("score", "inspection_year").alias("first_score"),
        F.max_by("score", "inspection_year").alias("last_score"),
    )
    change = F.when(F.col("years") >= 2, F.round(F.col("last_score") - F.col("first_score"), 2))
    return points.withColumn("risk_change_points", change)


CHANGE_METRICS = ("total_inspections", "citation_rate", "oai_rate", *CLASSES)


def period_change(annual: DataFrame) -> DataFrame:
    """Deltas between the last two periods, rates as percentage points; the busiest year.

    `annual` has one row per year, so ordering it is trivial at any input size.
    """
    row = F.struct("inspection_year", "partial_year", *CHANGE_METRICS)
    last_two = annual.agg(
        F.slice(F.sort_array(F.collect_list(row), asc=False), 1, 2).alias("p"),
        F.max_by("inspection_year", F.struct(F.col("total_inspections"), -F.col("inspection_year"))).alias("highest_volume_year"),
    ).filter(F.size("p") == 2)
    b, a = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    out = []
    for name in CHANGE_METRICS:
        is_rate = name.endswith("_rate")
        delta = (b[name] - a[name]) * (100 if is_rate else 1)
        out.append(F.round(delta.cast("double"), 6).alias(name + ("_percentage_point_change" if is_rate else "_change")))
    return last_two.select(
        a["inspection_year"].alias("previous_year"), b["inspection_year"].alias("latest_year"),
        b["partial_year"].alias("partial_year"), "highest_volume_year", *out,
    )


def theme_change(
    df: DataFrame, first: int | None = None, last: int | None = None, taxonomy: Taxonomy = RISK_TAXONOMY
) -> DataFrame:
    """Theme counts in the first and last year; null where that year has no text at all.

    The year table is tiny, so both years are picked from it without a join.
    """
    flags = theme_flags(F.col("observation_text"), taxonomy)
    columns = theme_columns(taxonomy)
    yearly = df.filter(F.col("inspection_year").isNotNull()).groupBy("inspection_year").agg(
        count_if(F.length("observation_text") > 0).alias("texts"),
        *[count_if(flags[t]).alias(c) for t, c in columns.items()],
    )
    facts = F.struct("inspection_year", "texts", *columns.values())
    pick = lambda y, agg: agg if y is None else F.max(F.when(F.col("inspection_year") == y, facts))
    ends = yearly.agg(
        pick(first, F.min_by(facts, "inspection_year")).alias("a"),
        pick(last, F.max_by(facts, "inspection_year")).alias("b"),
    )
    count = lambda side, c: F.when(F.col(f"{side}.texts") > 0, F.col(f"{side}.{c}"))
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("theme"),
            (F.lit(first) if first is not None else F.col("a.inspection_year")).alias("start_year"),
            (F.lit(last) if last is not None else F.col("b.inspection_year")).alias("end_year"),
            count("a", c).alias("start_count"), count("b", c).alias("end_count"),
            (count("b", c) - count("a", c)).alias("change"),
        ) for t, c in columns.items()
    ])
    return ends.select(F.explode(rows).alias("r")).select("r.*").orderBy(F.col("change").desc_nulls_last(), "theme")


def theme_change_observations(index: DataFrame, first: int, last: int) -> DataFrame:
    """Distinct inspections per theme in two years; a theme absent from a year counts 0."""
    pairs = index.filter(F.col("year").isin(first, last)).select("theme", "year", "inspection_id").distinct()
    counts = pairs.groupBy("theme").agg(
        F.count(F.when(F.col("year") == first, F.col("inspection_id"))).alias("start_inspections"),
        F.count(F.when(F.col("year") == last, F.col("inspection_id"))).alias("end_inspections"),
    )
    return counts.select(
        "theme", F.lit(first).alias("start_year"), F.lit(last).alias("end_year"), "start_inspections", "end_inspections",
        (F.col("end_inspections") - F.col("start_inspections")).alias("change"),
    ).orderBy(F.col("change").desc(), "theme")


def chart_facts(annual: DataFrame, metrics: DataFrame, bands: DataFrame) -> DataFrame:
    """The facts behind the charts, from tables of one row per year, one row, and five rows.

    The change compares the last two complete years only; the leading class keeps ties.
    """
    row = F.struct("inspection_year", "total_inspections", "oai_rate", "partial_year")
    years = annual.agg(
        F.max_by(row, "inspection_year").alias("latest"),
        F.slice(F.sort_array(F.collect_list(F.when(~F.col("partial_year"), row)), asc=False), 1, 2).alias("done"),
    )
    labels = ("NAI", "VAI", "OAI", "Unknown")
    most = F.greatest(*[F.col(c) for c in labels])
    leading = metrics.select(
        F.array_join(F.array_compact(F.array(*[F.when(F.col(c) == most, F.lit(c)) for c in labels])), " / ").alias("leading_class"),
        most.alias("leading_count"),
        known_ratio(most, F.col("total_inspections")).alias("leading_share"),
    )
    risk = bands.agg(
        F.sum(F.when(F.col("band") == "HIGH", F.col("entities"))).alias("high_sites"),
        F.sum(F.when(F.col("band") == "CRITICAL", F.col("entities"))).alias("critical_sites"),
        F.sum("entities").alias("all_sites"),
    )
    now, then = F.get("done", F.lit(0)), F.get("done", F.lit(1))
    return years.select(
        F.col("latest.inspection_year").alias("latest_year"),
        F.col("latest.total_inspections").alias("latest_inspections"),
        F.col("latest.partial_year").alias("latest_partial"),
        F.col("latest.oai_rate").alias("latest_oai_rate"),
        now["inspection_year"].alias("complete_year"), then["inspection_year"].alias("previous_complete_year"),
        (now["total_inspections"] - then["total_inspections"]).alias("complete_change"),
        *[leading.select(c).scalar().alias(c) for c in leading.columns],
        *[risk.select(c).scalar().alias(c) for c in risk.columns],
    )


__all__ = [
    "chart_facts", "is_partial", "period_change", "risk_change", "risk_trend", "theme_change", "theme_change_observations",
]
