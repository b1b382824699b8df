"""Site alerts. Flags come from per-site aggregates; evidence is kept as one row per inspection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.functions.config import AlertRules, RiskConfig
from auditgrain.functions.expressions import contains_any, count_if, known_ratio
from auditgrain.functions.taxonomy import RISK_TAXONOMY, Taxonomy
from auditgrain.operators.risk import entity_totals, rank_entities, score_totals, theme_columns, yearly_facts
from auditgrain.operators.tagging import rule_severity

# --- fixed values -------------------------------------------------------------------------------
HIGH_RISK = "HIGH_RISK_SITE"
REPEATED_OAI = "REPEATED_OAI"
RATE_INCREASE = "CITATION_RATE_INCREASE"
RECURRING_THEME = "RECURRING_DATA_INTEGRITY"
NEW_SEVERE = "NEW_HIGH_SEVERITY_SIGNAL"
# --- end of fixed values ------------------------------------------------------------------------


def alert_high_risk(summary: DataFrame) -> DataFrame:
    """Entities in the HIGH or CRITICAL band."""
    return summary.filter(F.col("band").isin("HIGH", "CRITICAL"))


def alert_repeated_oai(df: DataFrame, n: int = 2) -> DataFrame:
    """Sites with at least n OAI inspections."""
    counts = df.filter(F.col("classification") == "OAI").groupBy("site_key").agg(F.count("*").alias("oai_inspections"))
    return counts.filter(F.col("oai_inspections") >= n)


def _last_two_years(facts: DataFrame) -> DataFrame:
    """Citation totals of the last two observed years, per site; one row per site and year comes in."""
    row = F.struct(F.col("inspection_year").alias("y"), F.col("cite_pos").alias("pos"), F.col("cite_known").alias("known"))
    years = facts.groupBy("site_key").agg(
        F.slice(F.sort_array(F.collect_list(F.when(F.col("inspection_year").isNotNull(), row)), asc=False), 1, 2).alias("_y")
    )
    b, a = F.get("_y", F.lit(0)), F.get("_y", F.lit(1))
    return years.filter(F.size("_y") == 2).select(
        "site_key", a["y"].alias("previous_year"), b["y"].alias("latest_year"),
        a["known"].alias("previous_known"), b["known"].alias("latest_known"),
        known_ratio(a["pos"], a["known"]).alias("previous_rate"), known_ratio(b["pos"], b["known"]).alias("latest_rate"),
    )


def alert_rate_increase(df: DataFrame, min_known: int = 3, delta: float = 0.2) -> DataFrame:
    """Sites whose citation rate rose by delta or more between their last two observed years."""
    facts = df.groupBy("site_key", "inspection_year").agg(
        F.sum(F.coalesce("citation_indicator", F.lit(0))).alias("cite_pos"),
        F.count("citation_indicator").alias("cite_known"),
    )
    two = _last_two_years(facts)
    return two.filter(
        (F.col("previous_known") >= min_known) & (F.col("latest_known") >= min_known)
        & (F.col("latest_rate") - F.col("previous_rate") >= delta)
    )


def alert_recurring_theme(df: DataFrame, theme: str, n: int = 2, taxonomy: Taxonomy = RISK_TAXONOMY) -> DataFrame:
    """Sites where the named theme occurs in at least n distinct inspections."""
    hit = df.filter(contains_any(F.lower("observation_text"), taxonomy.themes[theme]))
    counts = hit.groupBy("site_key").agg(F.countDistinct("inspection_id").alias("theme_inspections"))
    return counts.filter(F.col("theme_inspections") >= n)


def _latest_severe(df: DataFrame, as_of: str, days: int, taxonomy: Taxonomy) -> DataFrame:
    severe = (F.length("observation_text") > 0) & rule_severity(F.col("observation_text"), taxonomy).isin("High", "Critical")
    per_day = df.filter(F.col("inspection_date").isNotNull()).groupBy("site_key", "inspection_date").agg(
        count_if(severe).alias("_severe")
    )
    latest = per_day.groupBy("site_key").agg(
        F.max("inspection_date").alias("latest_date"), F.max_by("_severe", "inspection_date").alias("severe_inspections")
    )
    age = F.datediff(F.lit(date.fromisoformat(as_of)), F.col("latest_date"))
    return latest.filter(age.between(0, days) & (F.col("severe_inspections") > 0))


def alert_new_severe(df: DataFrame, as_of: str, days: int = 365, taxonomy: Taxonomy = RISK_TAXONOMY) -> DataFrame:
    """Sites whose latest inspection date is recent and carries a High or Critical text signal."""
    return _latest_severe(df, as_of, days, taxonomy)


def alert_flags(
    df: DataFrame, as_of: str, cfg: RiskConfig | None = None, rules: AlertRules | None = None,
    taxonomy: Taxonomy = RISK_TAXONOMY,
) -> DataFrame:
    """One row per site that raises any alert, from one pass of (site, year) totals."""
    cfg, rules = cfg or RiskConfig(), rules or AlertRules()
    facts = yearly_facts(df, ["site_key"], taxonomy)
    theme = theme_columns(taxonomy)[rules.recurring_theme]
    totals = entity_totals(facts, ["site_key"], taxonomy)
    scored = score_totals(
        totals, ["site_key", F.col("oai").alias("oai_inspections"), F.col(theme).alias("theme_inspections")],
        F.lit(date.fromisoformat(as_of)), cfg, taxonomy, details=False,
    )
    severe = _latest_severe(df, as_of, rules.new_observation_days, taxonomy)
    flags = scored.join(_last_two_years(facts), "site_key", "left").join(severe, "site_key", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    flagged = flags.select(
        "site_key", "latest_date", "previous_year", "latest_year",
        F.col("band").isin("HIGH", "CRITICAL").alias("is_high"),
        (F.col("oai_inspections") >= rules.repeated_oai_count).alias("is_oai"),
        yes(
            (F.col("previous_known") >= rules.minimum_yearly_known_flags)
            & (F.col("latest_known") >= rules.minimum_yearly_known_flags)
            & (F.col("latest_rate") - F.col("previous_rate") >= rules.citation_rate_increase)
        ).alias("is_rate"),
        (F.col("theme_inspections") >= rules.recurring_theme_count).alias("is_theme"),
        F.col("severe_inspections").isNotNull().alias("is_new"),
    )
    return flagged.filter(F.col("is_high") | F.col("is_oai") | F.col("is_rate") | F.col("is_theme") | F.col("is_new"))


def alert_evidence(
    df: DataFrame, as_of: str, cfg: RiskConfig | None = None, rules: AlertRules | None = None,
    taxonomy: Taxonomy = RISK_TAXONOMY,
) -> DataFrame:
    """The inspections behind every alert: (code, site_key, company_name, site_name, inspection_id, as_of)."""
    rules = rules or AlertRules()
    flags = alert_flags(df, as_of, cfg, rules, taxonomy)
    joined = df.join(flags, "site_key")
    text = F.col("observation_text")
    cases: list[tuple[str, Column]] = [
        (HIGH_RISK, F.col("is_high")),
        (REPEATED_OAI, F.col("is_oai") & (F.col("classification") == "OAI")),
        (RATE_INCREASE, F.col("is_rate") & F.col("inspection_year").isin(F.col("previous_year"), F.col("latest_year"))
         & F.col("citation_indicator").isNotNull()),
        (RECURRING_THEME, F.col("is_theme") & contains_any(F.lower(text), taxonomy.themes[rules.recurring_theme])),
        (NEW_SEVERE, F.col("is_new") & (F.col("inspection_date") == F.col("latest_date")) & (F.length(text) > 0)
         & rule_severity(text, taxonomy).isin("High", "Critical")),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in cases]))
    return joined.select(
        F.explode(codes).alias("code"), "site_key", "company_name", "site_name", "inspection_id", F.lit(as_of).alias("as_of")
    )


def site_alerts(
    df: DataFrame, as_of: str, cfg: RiskConfig | None = None, rules: AlertRules | None = None,
    taxonomy: Taxonomy = RISK_TAXONOMY,
) -> DataFrame:
    """One row per (site, alert code) with how many inspections support it."""
    rows = alert_evidence(df, as_of, cfg, rules, taxonomy)
    return rows.groupBy("code", "site_key", "as_of").agg(
        F.min_by(F.struct("company_name", "site_name"), "inspection_id").alias("_n"), F.count("*").alias("evidence_count")
    ).select("code", "site_key", "_n.company_name", "_n.site_name", "evidence_count", "as_of")


def top_site_alerts(df: DataFrame, summary: DataFrame, as_of: str, limit: int = 20, **options) -> DataFrame:
    """Alerts of the highest-risk sites only."""
    top = rank_entities(summary, limit=limit).select(F.col("entity_key").alias("site_key"))
    return site_alerts(df.join(F.broadcast(top), "site_key", "left_semi"), as_of, **options)
