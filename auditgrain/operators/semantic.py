"""A declarative metric layer: named metrics and dimensions over one grain at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.functions.config import RiskConfig
from auditgrain.functions.expressions import count_if, known_ratio
from auditgrain.functions.taxonomy import RISK_TAXONOMY, Taxonomy
from auditgrain.operators.browse import filter_observations
from auditgrain.operators.normalize import filter_inspections
from auditgrain.operators.reviews import needs_review
from auditgrain.operators.risk import risk_score
from auditgrain.operators.tagging import SEVERITIES, UNCLASSIFIED
from auditgrain.session import materialize

# --- fixed values: metric, dimension and filter names ---------------------------------------------
INSPECTION_METRICS = [
    "total_inspections", "citation_positive_inspections", "citation_rate", "posted_citations", "nai_count", "vai_count",
    "oai_count", "oai_rate", "unique_sites", "risk_score", "risk_band", "high_risk_sites", "critical_risk_sites",
]
OBSERVATION_METRICS = [
    "recurring_themes", "recurrence_count", "observation_count", "severity_distribution", "review_required_count",
]
INSPECTION_DIMENSIONS = {
    "year": "inspection_year", "inspection_date": "inspection_date", "company": "company_key", "site": "site_key",
    "FEI": "fei_number", "country": "country", "product": "product_type", "inspection_type": "inspection_type",
    "classification": "classification", "risk_band": "band",
}
OBSERVATION_DIMENSIONS = {
    "year": "year", "company": "company", "site": "site", "product": "product", "inspection_type": "inspection_type",
    "theme": "theme", "severity": "severity", "semantic_group": "group_id", "dataset": "dataset", "grain": "grain",
}
OBSERVATION_ONLY_FILTERS = {"theme", "severity", "semantic_group", "dataset", "grain"}
INSPECTION_ONLY_FILTERS = {
    "country", "product_type", "project_area", "classification", "inspection_type", "start_date", "end_date", "risk_band",
}
SHARED_FILTERS = {"company", "site", "fei_number", "year", "start_year", "end_year"}
# --- end of fixed values ------------------------------------------------------------------------
RISK_METRICS = {"risk_score", "risk_band", "high_risk_sites", "critical_risk_sites"}


@dataclass(frozen=True)
class MetricSpec:
    metrics: Sequence[str]
    dimensions: Sequence[str] = ()
    filters: Mapping[str, object] = field(default_factory=dict)
    grain: str = "inspection"
    limit: int | None = None
    offset: int = 0

    def __post_init__(self) -> None:
        if not self.metrics or len(self.dimensions) > 5:
            raise ValueError("give at least one metric and at most five dimensions")
        if self.grain not in ("inspection", "observation"):
            raise ValueError("unknown grain")
        obs = self.grain == "observation"
        names = OBSERVATION_METRICS if obs else INSPECTION_METRICS
        for m in self.metrics:
            if m not in INSPECTION_METRICS + OBSERVATION_METRICS:
                raise ValueError(f"unknown metric: {m}")
            if m not in names:
                raise ValueError(f"{m} belongs to the other grain")
        for d in self.dimensions:
            if d not in (OBSERVATION_DIMENSIONS if obs else INSPECTION_DIMENSIONS):
                raise ValueError(f"unsupported dimension: {d}")
        used = {k for k, v in self.filters.items() if v is not None}
        if used - SHARED_FILTERS - OBSERVATION_ONLY_FILTERS - INSPECTION_ONLY_FILTERS:
            raise ValueError("unknown filter")
        if used & (INSPECTION_ONLY_FILTERS if obs else OBSERVATION_ONLY_FILTERS):
            raise ValueError("that filter belongs to the other grain")
        if "year" in used and used & {"start_year", "end_year"}:
            raise ValueError("use year or a year range, not both")
        for lo, hi in (("start_year", "end_year"), ("start_date", "end_date")):
            if lo in used and hi in used and self.filters[lo] > self.filters[hi]:
                raise ValueError("invalid range")
        if (self.limit is not None and self.limit < 1) or self.offset < 0:
            raise ValueError("invalid page")


def _inspection_columns(posted: bool) -> dict[str, list[Column]]:
    label = F.col("classification")
    n = lambda c: count_if(label == c)
    known = count_if(label.isin("OAI", "VAI", "NAI"))
    cited = F.sum("citation_indicator")
    return {
        "total_inspections": [F.count("*").alias("total_inspections")],
        "citation_positive_inspections": [cited.cast("long").alias("citation_positive_inspections")],
        "citation_rate": [known_ratio(cited, F.count("citation_indicator")).alias("citation_rate")],
        "posted_citations": [
            (F.sum("available_citation_count").cast("long") if posted else F.lit(None).cast("long")).alias("posted_citations")
        ],
        "nai_count": [n("NAI").alias("nai_count")],
        "vai_count": [n("VAI").alias("vai_count")],
        "oai_count": [n("OAI").alias("oai_count")],
        "oai_rate": [known_ratio(n("OAI"), known).alias("oai_rate")],
        "unique_sites": [F.countDistinct("site_key").alias("unique_sites")],
    }


def _page(df: DataFrame, spec: MetricSpec, keys: Sequence[str], with_total: bool) -> DataFrame:
    order = [F.col(k).asc_nulls_last() for k in keys]
    if with_total:
        df = materialize(df, "groups")  # counted and paged from one evaluation
        df = df.withColumn("total_groups", df.agg(F.count("*")).scalar())
    out = (df.orderBy(*order) if order else df).offset(spec.offset)
    return out if spec.limit is None else out.limit(spec.limit)


def metric_query(
    spec: MetricSpec, inspections: DataFrame, index: DataFrame | None = None, reviews: DataFrame | None = None,
    as_of: str | None = None, cfg: RiskConfig | None = None, taxonomy: Taxonomy = RISK_TAXONOMY, with_total: bool = False,
) -> DataFrame:
    """Evaluate a spec: one row per combination of its dimensions, on request with `total_groups`, those before paging."""
    if spec.grain == "observation":
        return _observation_query(spec, index, reviews, with_total)
    filters = dict(spec.filters)
    band = filters.pop("risk_band", None)
    df = filter_inspections(inspections, **filters)
    keys = list(spec.dimensions)
    columns = {d: INSPECTION_DIMENSIONS[d] for d in keys}
    risk = RISK_METRICS & set(spec.metrics)
    if band or "risk_band" in keys or risk & {"high_risk_sites", "critical_risk_sites"}:
        sites = risk_score(df, ["site_key"], _day(as_of), cfg, taxonomy).select("site_key", F.col("band"))
        df = df.join(sites, "site_key", "left")
        if band:
            df = df.filter(F.col("band") == band)
    df = df.withColumns({f"_{d}": F.col(c) for d, c in columns.items()}) if columns else df
    available = _inspection_columns("available_citation_count" in df.columns)
    aggregates = [c for m in spec.metrics if m in available for c in available[m]]
    for name, level in (("high_risk_sites", "HIGH"), ("critical_risk_sites", "CRITICAL")):
        if name in risk:
            aggregates.append(F.countDistinct(F.when(F.col("band") == level, F.col("site_key"))).alias(name))
    groups = [F.col(f"_{d}").alias(d) for d in keys]
    out = df.groupBy(*groups).agg(*(aggregates or [F.count("*").alias("total_inspections")]))
    if risk & {"risk_score", "risk_band"}:
        temporary = [f"_{d}" for d in keys]
        scored = risk_score(df, temporary, _day(as_of), cfg, taxonomy).select(
            *[F.col(t).alias(f"r{t}") for t in temporary], F.col("score").alias("risk_score"),
            F.col("band").alias("risk_level"),
        )
        same = F.lit(True)
        for d in keys:
            same = same & F.col(d).eqNullSafe(F.col(f"r_{d}"))
        # Without dimensions both sides are one row.
        out = out.join(scored, same).drop(*[f"r{t}" for t in temporary]) if keys else out.select(
            "*", scored.select("risk_score").scalar().alias("risk_score"), scored.select("risk_level").scalar().alias("risk_level")
        )
    return _page(out, spec, keys, with_total)


def _day(as_of: str | None) -> str:
    if as_of is None:
        raise ValueError("risk metrics need as_of")
    return date.fromisoformat(as_of).isoformat()


def _observation_query(spec: MetricSpec, index: DataFrame | None, reviews: DataFrame | None, with_total: bool) -> DataFrame:
    if index is None:
        raise ValueError("observation metrics need the browsing index")
    filters = dict(spec.filters)
    if "semantic_group" in filters:
        filters["group_id"] = filters.pop("semantic_group")
    scope = filter_observations(index, **filters)
    keys = list(spec.dimensions)
    groups = [F.col(OBSERVATION_DIMENSIONS[d]).alias(d) for d in keys]
    simple = []
    if "observation_count" in spec.metrics:
        simple.append(F.count("*").alias("observation_count"))
    if "severity_distribution" in spec.metrics:
        simple += [count_if(F.col("severity") == s).alias(f"severity_{s.lower()}") for s in SEVERITIES]
    out = scope.groupBy(*groups).agg(*(simple or [F.count("*").alias("observation_count")]))

    def attach(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
        if not keys:
            return left.select("*", *[right.select(n).scalar().alias(n) for n in names])
        renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *names)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        return left.join(renamed, same, "left").drop(*[f"_r_{k}" for k in keys])

    if {"recurring_themes", "recurrence_count"} & set(spec.metrics):
        pairs = scope.filter(F.col("theme") != UNCLASSIFIED).select(
            *groups, F.col("theme").alias("_theme"), "inspection_id"
        ).distinct()
        per_theme = pairs.groupBy(*keys, "_theme").agg(F.count("inspection_id").alias("_n"))
        counts = per_theme.groupBy(*keys).agg(
            count_if(F.col("_n") > 1).alias("recurring_themes"),
            F.sum(F.greatest(F.col("_n") - 1, F.lit(0))).alias("recurrence_count"),
        )
        out = attach(out, counts, [m for m in ("recurring_themes", "recurrence_count") if m in spec.metrics])
    if "review_required_count" in spec.metrics:
        if reviews is None:
            raise ValueError("review_required_count needs reviews")
        left = needs_review(scope, reviews).groupBy(*groups).agg(F.count("*").alias("review_required_count"))
        out = attach(out, left, ["review_required_count"])
    for name in ("recurring_themes", "recurrence_count", "review_required_count"):
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    return _page(out, spec, keys, with_total)


def scope_evidence(df: DataFrame, filters: Mapping[str, object], limit: int = 10, offset: int = 0, quote: int = 1200) -> DataFrame:
    """The newest records of a scope with an opening quote, in a stable order."""
    scope = filter_inspections(df, **filters)
    return scope.orderBy(F.col("inspection_year").desc_nulls_last(), "inspection_id").offset(offset).limit(limit).select(
        "inspection_id", "company_name", "site_key", "classification", "inspection_date",
        F.substring(F.coalesce("observation_text", F.lit("")), 1, quote).alias("quote"),
    )
