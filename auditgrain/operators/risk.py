"""Explainable weighted risk over six factors, each null when its evidence is missing.

Records are first reduced to (entity, year) totals with map-side combine, then merged per entity.
No entity's records are ever gathered: the second step sees at most one row per year.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.functions.config import BANDS, FACTORS, RiskConfig
from auditgrain.functions.expressions import compute_once, count_if, known_ratio
from auditgrain.functions.taxonomy import RISK_TAXONOMY, Taxonomy, theme_flags
from auditgrain.operators.ranking import page

SUMS = ("total", "cite_pos", "cite_known", "oai", "vai", "nai", "obs_sum", "obs_known", "texts", "dated_known")


def theme_columns(taxonomy: Taxonomy) -> dict[str, str]:
    return {name: f"theme_{i}" for i, name in enumerate(taxonomy.names)}


def yearly_facts(df: DataFrame, keys: Sequence[str], taxonomy: Taxonomy = RISK_TAXONOMY) -> DataFrame:
    """Additive facts per (entity, year). The input has one row per inspection."""
    day, label, cited = F.col("inspection_date"), F.col("classification"), F.col("citation_indicator")
    text = F.col("observation_text")
    known = day.isNotNull() & (label.isNotNull() | cited.isNotNull())
    adverse = known & (F.coalesce(label.isin("OAI", "VAI"), F.lit(False)) | F.coalesce(cited == 1, F.lit(False)))
    flags = theme_flags(text, taxonomy)
    return df.groupBy(*keys, "inspection_year").agg(
        F.count("*").alias("total"),
        F.sum(F.coalesce(cited, F.lit(0))).cast("long").alias("cite_pos"),
        F.count(cited).alias("cite_known"),
        *[count_if(label == c).alias(c.lower()) for c in ("OAI", "VAI", "NAI")],
        F.sum(F.coalesce(F.col("observation_count"), F.lit(0))).cast("long").alias("obs_sum"),
        F.count("observation_count").alias("obs_known"),
        count_if(F.length(text) > 0).alias("texts"),
        count_if(known).alias("dated_known"),
        F.max(F.when(adverse, day)).alias("adverse_day"),
        *[count_if(flags[t]).alias(c) for t, c in theme_columns(taxonomy).items()],
    )


def entity_totals(facts: DataFrame, keys: Sequence[str], taxonomy: Taxonomy = RISK_TAXONOMY) -> DataFrame:
    """Merge the yearly facts per entity and find the last change of the citation rate."""
    rate = F.when(F.col("cite_known") > 0, known_ratio(F.col("cite_pos"), F.col("cite_known")))
    dated = F.when(
        F.col("inspection_year").isNotNull() & (F.col("cite_known") > 0),
        F.struct(F.col("inspection_year").alias("y"), rate.alias("r")),
    )
    merged = facts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.max("adverse_day").alias("adverse_day"),
        *[F.sum(c).alias(c) for c in theme_columns(taxonomy).values()],
        F.sort_array(F.collect_list(dated), asc=False).alias("_rates"),
    )
    newest, previous = F.get("_rates", F.lit(0)), F.get("_rates", F.lit(1))
    return merged.withColumn("trend", newest.getField("r") - previous.getField("r")).drop("_rates")


def _most_repeats(taxonomy: Taxonomy) -> Column:
    counts = [F.col(c) for c in theme_columns(taxonomy).values()]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return F.greatest(most - 1, F.lit(0))


def factor_columns(as_of: Column, cfg: RiskConfig, taxonomy: Taxonomy) -> dict[str, Column]:
    known_class = F.col("oai") + F.col("vai") + F.col("nai")
    age = F.datediff(as_of, F.col("adverse_day"))
    mean_count = known_ratio(F.col("obs_sum"), F.col("obs_known"))
    one, zero = F.lit(1.0), F.lit(0.0)
    return {
        "citation_history": known_ratio(F.col("cite_pos"), F.col("cite_known")),
        "classification_history": (F.col("oai") + F.lit(cfg.vai_factor) * F.col("vai"))
        / F.nullif(known_class.cast("double"), zero),
        "recurring_deficiencies": F.when(
            F.col("texts") > 0, F.least(one, _most_repeats(taxonomy) / F.lit(float(cfg.recurrence_target)))
        ),
        "recency": F.when(
            F.col("dated_known") > 0,
            F.when(F.col("adverse_day").isNull(), zero).otherwise(
                F.greatest(zero, one - age / F.lit(float(cfg.recency_days)))
            ),
        ),
        "severity": F.when(mean_count.isNotNull(), F.least(one, mean_count / F.lit(float(cfg.observation_cap)))),
        "negative_trend": F.when(F.col("trend").isNotNull(), F.greatest(zero, F.col("trend"))),
    }


def score_totals(
    totals: DataFrame, keep: Sequence[str], as_of: Column, cfg: RiskConfig, taxonomy: Taxonomy, details: bool = True
) -> DataFrame:
    """Score, band on the unrounded score, coverage, missing factors and components."""
    staged = compute_once(totals, {f"f_{k}": c for k, c in factor_columns(as_of, cfg, taxonomy).items()})
    weight = {k: F.lit(float(cfg.weights[k])) for k in FACTORS}
    factor = {k: F.col(f"f_{k}") for k in FACTORS}
    available = reduce(
        lambda a, b: a + b, [F.when(factor[k].isNotNull(), weight[k]).otherwise(F.lit(0.0)) for k in FACTORS]
    )
    staged = compute_once(staged, {"_available": available})
    base = F.nullif(F.col("_available"), F.lit(0.0))
    part = {k: factor[k] * weight[k] * 100 / base for k in FACTORS}
    raw = F.when(
        base.isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(part[k], F.lit(0.0)) for k in FACTORS])
    )
    staged = compute_once(staged, {"_raw": raw})
    band = (
        F.when(F.col("_raw").isNull(), BANDS[4])
        .when(F.col("_raw") >= cfg.critical, BANDS[3])
        .when(F.col("_raw") >= cfg.high, BANDS[2])
        .when(F.col("_raw") >= cfg.moderate, BANDS[1])
        .otherwise(BANDS[0])
    )
    out = [
        F.round("_raw", 2).alias("score"), band.alias("band"),
        F.round(F.col("_available") / float(sum(cfg.weights.values())) * 100, 2).alias("coverage_pct"),
    ]
    if details:
        out += [
            F.array_compact(F.array(*[F.when(factor[k].isNull(), F.lit(k)) for k in FACTORS])).alias("missing_factors"),
            F.array(*[
                F.struct(
                    F.lit(k).alias("name"), weight[k].alias("weight"), F.round(factor[k], 6).alias("factor"),
                    F.round(part[k], 2).alias("points"),
                ) for k in FACTORS
            ]).alias("components"),
        ]
    return staged.select(*keep, *out)


def risk_score(
    df: DataFrame, keys: Sequence[str], as_of: str, cfg: RiskConfig | None = None, taxonomy: Taxonomy = RISK_TAXONOMY
) -> DataFrame:
    """Risk per entity. With no keys: one row for the whole input."""
    cfg = cfg or RiskConfig()
    totals = entity_totals(yearly_facts(df, keys, taxonomy), keys, taxonomy)
    return score_totals(totals, [*keys, "total"], F.lit(date.fromisoformat(as_of)), cfg, taxonomy)


ENTITY_KEYS = {"site": "site_key", "company": "company_key"}


def entity_summary(
    df: DataFrame, kind: str, as_of: str, cfg: RiskConfig | None = None, taxonomy: Taxonomy = RISK_TAXONOMY
) -> DataFrame:
    """Risk per site or company with the names of its latest-dated record and its countries."""
    key = ENTITY_KEYS[kind]
    risk = risk_score(df, [key], as_of, cfg, taxonomy).withColumnRenamed("total", "inspections")
    # Latest date first, then the lowest id; undated records sort last.
    newest = F.struct(F.coalesce(-F.unix_date("inspection_date"), F.lit(2**31 - 1)), "inspection_id")
    named = df.groupBy(key).agg(
        F.min_by(F.struct("company_name", "site_name", "fei_number"), newest).alias("_latest"),
        F.array_join(F.sort_array(F.collect_set(F.nullif(F.col("country"), F.lit("")))), ", ").alias("country"),
    )
    site_only = (lambda c: F.col(c)) if kind == "site" else (lambda c: F.lit(None).cast("string"))
    return named.join(risk, key).select(
        F.lit(kind).alias("kind"), F.col(key).alias("entity_key"), "_latest.company_name",
        site_only("_latest.site_name").alias("site_name"), site_only("_latest.fei_number").alias("fei_number"),
        "country", "inspections", "score", "band", "coverage_pct", "missing_factors", "components",
    )


def rank_entities(
    summary: DataFrame, band: str | None = None, search: str | None = None, company: str | None = None,
    limit: int = 200, offset: int = 0,
) -> DataFrame:
    """Highest score first, unscored last, then key; with the total that matches."""
    if band:
        summary = summary.filter(F.col("band") == band)
    if company:
        summary = summary.filter(F.col("company_name") == company)
    if search:
        summary = summary.filter(F.contains(F.lower("company_name"), F.lower(F.lit(search))))
    return page(summary, [F.col("score").desc_nulls_last(), F.col("entity_key")], limit, offset)


def top_risk_drivers(summary: DataFrame, n: int = 3, key: str = "entity_key") -> DataFrame:
    """The n components with most points per entity. At most six per row, so sorted in the row."""
    ranked = F.array_sort(
        F.filter("components", lambda c: c["points"].isNotNull()),
        lambda a, b: F.when(a["points"] > b["points"], -1).when(a["points"] < b["points"], 1)
        .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0),
    )
    return summary.select(key, F.posexplode(F.slice(ranked, 1, n)).alias("pos", "c")).select(
        key, (F.col("pos") + 1).alias("driver_rank"), F.col("c.name").alias("factor"), F.col("c.points").alias("points")
    )


def risk_distribution(summary: DataFrame) -> DataFrame:
    """Entities per band, every band present."""
    counts = summary.agg(*[count_if(F.col("band") == b).alias(b) for b in BANDS])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("entities")) for b in BANDS])).alias("r")
    ).select("r.*")


def compare_entities(
    df: DataFrame, key: str, names: Sequence[str], as_of: str, cfg: RiskConfig | None = None,
    taxonomy: Taxonomy = RISK_TAXONOMY,
) -> Mapping[str, DataFrame]:
    """Risk, yearly trend and recurrence of the named entities side by side."""
    from auditgrain.operators.metrics import theme_members
    from auditgrain.operators.trend import risk_trend

    scope = df.filter(F.col(key).isin(*names))
    recurrence = (
        theme_members(scope.withColumn("company_name", F.col(key)), taxonomy, "company_name")
        .groupBy(F.col("group").alias(key), "theme").agg(F.count("*").alias("count"))
    )
    return {
        "risk": risk_score(scope, [key], as_of, cfg, taxonomy),
        "trend": risk_trend(scope, [key], as_of, cfg, taxonomy),
        "recurrence": recurrence,
    }


def entity_profile(
    df: DataFrame, key: str, name: str, as_of: str, cfg: RiskConfig | None = None, taxonomy: Taxonomy = RISK_TAXONOMY
) -> Mapping[str, DataFrame]:
    """Risk, trend, recurrence and records of one entity."""
    return {
        **compare_entities(df, key, [name], as_of, cfg, taxonomy),
        "records": df.filter(F.col(key) == name).orderBy(F.col("inspection_year").desc_nulls_last(), "inspection_id"),
    }
