"""Known-denominator rates, class counts and theme recurrence."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.functions.expressions import count_if, known_ratio
from auditgrain.functions.taxonomy import RISK_TAXONOMY, Taxonomy, theme_array

CLASSES = ("OAI", "VAI", "NAI")
OPTIONAL_COUNTS = ("posted_citation_indicator", "available_citation_count")


def portfolio_metrics(df: DataFrame, as_of: str, by: Sequence[str] = ()) -> DataFrame:
    """Totals and rates over known denominators, in one aggregate.

    Only sites need an exact distinct count; the observed years are gathered as a small set, so the
    plan has one distinct and no row expansion.
    """
    day = F.col("inspection_date")
    end = F.lit(date.fromisoformat(as_of))
    age = F.datediff(end, day)
    for name in OPTIONAL_COUNTS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("int"))
    sums = df.groupBy(*by).agg(
        F.count("*").alias("total_inspections"),
        F.sum("citation_indicator").cast("long").alias("citation_positive"),
        F.count("citation_indicator").alias("citation_known"),
        *[count_if(F.col("classification") == c).alias(c) for c in CLASSES],
        count_if(F.col("classification").isNull()).alias("Unknown"),
        F.sum("observation_count").cast("long").alias("observation_sum"),
        F.count("observation_count").alias("observations_known"),
        F.countDistinct("site_key").alias("unique_sites"),
        F.count(day).alias("dated_inspections"),
        F.size(F.collect_set(F.when(day.isNotNull(), F.col("inspection_year")))).alias("dated_years"),
        count_if(age.between(0, 365)).alias("recent_inspections"),
        F.sum("posted_citation_indicator").cast("long").alias("posted_citation_inspections"),
        F.sum("available_citation_count").cast("long").alias("available_citation_rows"),
    )
    known = F.col("OAI") + F.col("VAI") + F.col("NAI")
    return sums.select(
        *by, "total_inspections", "citation_positive", "citation_known",
        known_ratio(F.col("citation_positive"), F.col("citation_known")).alias("citation_rate"),
        *CLASSES, "Unknown", known.alias("classification_known"),
        known_ratio(F.col("OAI"), known).alias("oai_rate"),
        known_ratio(F.col("observation_sum"), F.col("observations_known")).alias("average_observations"),
        "observations_known",
        known_ratio(F.col("dated_inspections"), F.col("dated_years")).alias("inspection_frequency"),
        "recent_inspections", "dated_inspections", "unique_sites",
        "posted_citation_inspections", "available_citation_rows",
    )


def is_partial(year: Column, as_of: str) -> Column:
    """The reporting year is partial unless the cut-off is its last day."""
    end = date.fromisoformat(as_of)
    return (year == F.lit(end.year)) & F.lit((end.month, end.day) != (12, 31))


def annual_metrics(df: DataFrame, as_of: str) -> DataFrame:
    yearly = portfolio_metrics(df.filter(F.col("inspection_year").isNotNull()), as_of, ["inspection_year"])
    return yearly.withColumn("partial_year", is_partial(F.col("inspection_year"), as_of))


def annual_class_counts(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("inspection_date").isNotNull())
        .groupBy("inspection_year", "classification").agg(F.count("*").alias("inspection_count"))
    )


RECURRENCE_GROUPS = ("inspection_year", "company_name", "site_key", "country", "product_type")


def theme_members(df: DataFrame, taxonomy: Taxonomy = RISK_TAXONOMY, group_by: str | None = None) -> DataFrame:
    """Distinct (theme, group, inspection) rows: the evidence ids behind the recurrence counts.

    Kept as rows, since one theme may cover a third of all inspections and would not fit an array.
    """
    if group_by is not None and group_by not in RECURRENCE_GROUPS:
        raise ValueError("unsupported recurrence grouping")
    group = (
        F.coalesce(F.nullif(F.col(group_by).cast("string"), F.lit("")), F.lit("Unknown"))
        if group_by else F.lit("All")
    )
    return df.select(
        F.explode(theme_array(F.col("observation_text"), taxonomy)).alias("theme"),
        group.alias("group"), "inspection_id",
    ).distinct()


def theme_recurrence(df: DataFrame, taxonomy: Taxonomy = RISK_TAXONOMY, group_by: str | None = None) -> DataFrame:
    """Distinct inspections per (theme, group) and how many of them repeat the theme."""
    counts = theme_members(df, taxonomy, group_by).groupBy("theme", "group").agg(F.count("*").alias("count"))
    return counts.withColumn("repeat_count", F.greatest(F.col("count") - 1, F.lit(0))).orderBy(
        F.col("count").desc(), "theme", "group"
    )
