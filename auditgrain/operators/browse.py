"""The browsing index over tagged observations, its filters, pages and aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.functions.expressions import count_if, known_ratio
from auditgrain.functions.taxonomy import RISK_TAXONOMY, SEVERITY_WEIGHTS, Taxonomy, theme_array
from auditgrain.operators.ranking import page
from auditgrain.operators.tagging import SEVERITIES, UNCLASSIFIED, severity_rank
from auditgrain.session import materialize

INDEX_COLUMNS = [
    "run_id", "observation_id", "hash", "inspection_id", "dataset", "grain", "company", "site", "year", "product",
    "inspection_type", "frequency", "group_id", "theme", "severity", "severity_rank", "confidence",
    "ai_generated", "fallback",
]


def build_browse_index(observations: DataFrame, members: DataFrame, assignments: DataFrame, tags: DataFrame) -> DataFrame:
    """Narrow, denormalised index. Tags meet assignments first: both are per unique text.

    What comes of it is written before observations meet it: while texts are few, no observation is
    shuffled. Members that carry the columns of their observations, as those of `tag_run` do, are not
    looked up by id.
    """
    labelled = assignments.join(
        tags.select("cache_key", "theme", "severity", "confidence", "ai_generated", "fallback"), "cache_key"
    ).drop("cache_key")
    if "group_id" not in labelled.columns:
        labelled = labelled.withColumn("group_id", F.col("hash"))
    labelled = materialize(labelled, "labelled", "zstd")
    if set(observations.columns) <= set(members.columns):
        joined = members.filter(F.col("observation_id").isNotNull()).join(labelled, ["run_id", "hash"])
    else:
        joined = observations.join(labelled, "hash").join(members, ["run_id", "observation_id"])
    return joined.withColumn("severity_rank", severity_rank(F.col("severity"))).select(*INDEX_COLUMNS)


def filter_observations(index: DataFrame, reviewed: DataFrame | None = None, **filters: object) -> DataFrame:
    """Scope of an observation question. The grain defaults to `inspection`; empty values are ignored.

    `review_required` needs `reviewed`: the (run_id, observation_id) pairs already decided.
    """
    equal = {
        "company": "company", "site": "site", "year": "year", "dataset": "dataset", "grain": "grain", "product": "product",
        "inspection_type": "inspection_type", "observation_id": "observation_id", "theme": "theme", "severity": "severity",
        "group_id": "group_id",
    }
    filters = {"grain": "inspection", **filters}
    start, end = filters.pop("start_year", None), filters.pop("end_year", None)
    review = filters.pop("review_required", None)
    if start and end and start > end:
        raise ValueError("invalid year range")
    for name, value in filters.items():
        if name not in equal:
            raise ValueError(f"unsupported observation filter: {name}")
        if value is not None and value != "":
            index = index.filter(F.col(equal[name]) == F.lit(value))
    if start is not None:
        index = index.filter(F.col("year") >= start)
    if end is not None:
        index = index.filter(F.col("year") <= end)
    if review is not None:
        if reviewed is None:
            raise ValueError("review_required needs the reviewed observations")
        index = index.join(reviewed.select("run_id", "observation_id"), ["run_id", "observation_id"],
                           "left_anti" if review else "left_semi")
    return index


SORTS = {"date": "year", "facility": "company", "theme": "theme", "severity": "severity_rank", "inspection": "inspection_id"}


def browse_order(sort: str = "date", direction: str = "desc") -> list[Column]:
    if sort not in SORTS or direction not in ("asc", "desc"):
        raise ValueError("unsupported sort")
    first = F.col(SORTS[sort])
    return [first.desc_nulls_first() if direction == "desc" else first.asc_nulls_last(), F.col("observation_id")]


def browse(index: DataFrame, sort: str = "date", direction: str = "desc", limit: int = 25, offset: int = 0) -> DataFrame:
    return page(index, browse_order(sort, direction), limit, offset)


@dataclass(frozen=True)
class StoredIndex:
    """A browsing index written for reading: rows clustered by company, and pages by each stored order.

    `pages` has, for each order, the rows in ranges of it and how many every range holds, in order.
    """

    rows: DataFrame
    pages: Mapping[tuple[str, str], tuple[DataFrame, Sequence[tuple[int, int]]]]
    total: int


def store_index(index: DataFrame, orders: Sequence[tuple[str, str]] = (("date", "desc"),), ranges: int | None = None) -> StoredIndex:
    """Write an index once for many questions.

    Each order is a copy in ranges of that order, one folder a range, with the sizes of the ranges, as many
    as there are partitions, kept beside it: a page reads the ranges it lies in. One copy is in ranges of the
    company, so that files of other companies are skipped by their statistics: that of the facilities, where
    it is asked for, else one of its own. What a copy shuffles leaves the disks before the next one is made.
    """
    spark = index.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    company = ("facility", "asc")
    rows, pages = None, {}
    if company not in orders:
        order = browse_order(*company)
        rows = materialize(index.repartitionByRange(n, *order).sortWithinPartitions(*order), "index-company", "zstd")
    for sort, direction in orders:
        order = browse_order(sort, direction)
        dealt = index.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
        held = materialize(dealt, f"index-{sort}-{direction}", "zstd", folders=["_range"])
        pages[sort, direction] = (held, [(r["_range"], r["count"]) for r in held.groupBy("_range").count().orderBy("_range").collect()])
    if rows is None:
        rows = pages[company][0].drop("_range")
    total = sum(c for _, c in next(iter(pages.values()))[1]) if pages else rows.count()
    return StoredIndex(rows, pages, total)


def stored_page(stored: StoredIndex, sort: str = "date", direction: str = "desc", limit: int = 25, offset: int = 0, most: int = 1000) -> DataFrame:
    """The page that `browse` gives, read from the ranges it lies in."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError("invalid page")
    if (sort, direction) not in stored.pages:
        raise ValueError("order is not stored")
    held, sizes = stored.pages[sort, direction]
    wanted, before, skipped = [], 0, 0
    for part, size in sizes:
        if before + size > offset and before < offset + limit:
            wanted.append(part)
            skipped = skipped if len(wanted) > 1 else before
        before += size
    near = held.filter(F.col("_range").isin(wanted) if wanted else F.lit(False)).drop("_range")
    return near.orderBy(*browse_order(sort, direction)).offset(max(0, offset - skipped)).limit(limit).withColumn("total_rows", F.lit(stored.total).cast("long"))


def similar_observations(index: DataFrame, observation_id: str | Column, limit: int = 20) -> DataFrame:
    """Other observations in the same text group and grain, by id; the id may be a scalar of another plan."""
    target = index.filter(F.col("observation_id") == observation_id).select("run_id", "group_id", "grain").limit(1)
    return (
        index.filter(F.col("observation_id") != observation_id)
        .join(F.broadcast(target), ["run_id", "group_id", "grain"], "left_semi")
        .orderBy("observation_id").limit(limit)
    )


def related_inspections(index: DataFrame) -> DataFrame:
    """Per observation: how many distinct inspections share its text group and dataset."""
    counts = index.groupBy("group_id", "dataset").agg(F.countDistinct("inspection_id").alias("related_inspections"))
    return index.select("observation_id", "group_id", "dataset").join(counts, ["group_id", "dataset"])


METRIC_GROUPS = ("theme", "year", "company", "site", "product", "inspection_type")


def observation_theme_metrics(index: DataFrame, group_by: str = "theme", limit: int | None = 200, most: int = 1000) -> DataFrame:
    """Counts, distinct inspections and sites, severity pivot and recurrence score per theme and group.

    Rows are first merged per (group, inspection, site), so the two exact distinct counts run over
    far fewer rows than the corpus has. Without a limit all groups come back, unordered and without their total.
    """
    if group_by not in METRIC_GROUPS or (limit is not None and not 1 <= limit <= most):
        raise ValueError("invalid grouping or limit")
    keys = ["theme"] if group_by == "theme" else ["theme", group_by]
    merged = index.groupBy(*keys, "inspection_id", "site").agg(
        F.count("*").alias("_n"), F.sum("frequency").alias("_f"),
        *[count_if(F.col("severity") == s).alias(f"_{s}") for s in SEVERITIES],
    )
    grouped = merged.groupBy(*keys).agg(
        F.sum("_n").alias("observation_count"), F.countDistinct("inspection_id").alias("inspection_count"),
        F.countDistinct("site").alias("unique_sites"), F.sum("_f").alias("frequency_sum"),
        *[F.sum(f"_{s}").alias(s) for s in SEVERITIES],
    )
    n = F.col("inspection_count")
    scored = grouped.withColumn("recurrence_score", F.coalesce(known_ratio(F.greatest(n - 1, F.lit(0)), n), F.lit(0.0)))
    if limit is None:
        return scored
    groups = materialize(scored, "groups")  # counted and ordered from one aggregation
    return (
        groups.orderBy(F.col("observation_count").desc(), *[F.col(k).asc_nulls_last() for k in keys])
        .limit(limit).withColumn("total_groups", groups.agg(F.count("*")).scalar())
    )


def severity_index(index: DataFrame) -> DataFrame:
    """Mean severity weight over model-generated, classified rows only; null when there are none."""
    weight = F.lit(None).cast("double")
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == name, F.lit(value)).otherwise(weight)
    scored = F.when(F.col("ai_generated") & (F.col("severity") != UNCLASSIFIED), weight)
    return index.agg(F.round(F.avg(scored), 6).alias("severity_index"), F.count(scored).alias("severity_observations"))


def run_statistics(index: DataFrame) -> DataFrame:
    """Totals of a run in one row. Each distinct count shuffles its own values only, merged before they leave a task."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    total = F.sum(F.lit(1)).cast("long")
    stats = index.agg(
        total.alias("total"), F.countDistinct("hash").alias("unique_texts"),
        F.countDistinct("inspection_id").alias("inspections"), F.countDistinct("group_id").alias("groups"),
        n(F.col("ai_generated")).alias("ai"), n(~F.col("ai_generated")).alias("rules"), n(F.col("fallback")).alias("fallbacks"),
        n(F.col("theme") == UNCLASSIFIED).alias("unclassified"), F.round(F.sum("confidence") / total, 6).alias("mean_confidence"),
        n(F.col("severity") == "High").alias("high_severity"), n(F.col("severity") == "Critical").alias("critical_severity"),
    )
    return stats.withColumn("duplicate_text_occurrences", F.col("total") - F.col("unique_texts"))


def group_summary(index: DataFrame) -> DataFrame:
    """Per text group: observations, distinct texts, inspections, companies and sites, lowest id."""
    merged = index.groupBy("group_id", "hash", "inspection_id", "company", "site").agg(
        F.count("*").alias("_n"), F.min("observation_id").alias("_id")
    )
    return merged.groupBy("group_id").agg(
        F.sum("_n").alias("observation_count"), F.countDistinct("hash").alias("unique_texts"),
        F.countDistinct("inspection_id").alias("inspection_count"), F.countDistinct("company").alias("companies"),
        F.countDistinct("site").alias("sites"), F.min("_id").alias("representative_id"),
    ).orderBy(F.col("observation_count").desc(), "group_id")


def _sections(index: DataFrame, sections: Sequence[tuple[str, Column]], extra: Sequence[str] = ()) -> DataFrame:
    """(section, label, observations, inspections) for several groupings from one merged pass.

    Rows are merged per combination of labels and inspection first; only then is each merged row
    repeated once per section.
    """
    names = [f"_l{i}" for i in range(len(sections))]
    merged = index.groupBy(
        *[label.cast("string").alias(n) for n, (_, label) in zip(names, sections, strict=True)], "inspection_id"
    ).agg(F.count("*").alias("_n"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("section"), F.col(n).alias("label")) for n, (s, _) in zip(names, sections, strict=True)
    ]))
    spread = merged.select("inspection_id", "_n", rows.alias("r")).select("r.*", "inspection_id", "_n")
    return spread.filter(F.col("label").isNotNull()).groupBy("section", "label").agg(
        F.sum("_n").alias("observations"), F.countDistinct("inspection_id").alias("inspections")
    )


def workspace_summary(index: DataFrame) -> DataFrame:
    """Headline counts and the theme, year, severity and dataset tables in one long result."""
    tables = _sections(index, [
        ("all", F.lit("all")), ("theme", F.col("theme")), ("year", F.col("year")), ("severity", F.col("severity")),
        ("dataset", F.col("dataset")),
    ])
    recurring = tables.agg(
        count_if((F.col("section") == "theme") & (F.col("inspections") > 1) & (F.col("label") != UNCLASSIFIED)).alias("n")
    ).select(F.lit("recurring_themes").alias("section"), F.lit("all").alias("label"), F.col("n").alias("observations"),
             F.lit(None).cast("long").alias("inspections"))
    sites = index.agg(F.countDistinct("site").alias("n")).select(
        F.lit("sites").alias("section"), F.lit("all").alias("label"), F.col("n").alias("observations"),
        F.lit(None).cast("long").alias("inspections"))
    return tables.unionByName(recurring).unionByName(sites)


def observation_insights(index: DataFrame, open_reviews: DataFrame) -> DataFrame:
    """Counts, severities, yearly trend, themes and sites in more than one inspection, review backlog.

    `open_reviews` are the index rows that still need review.
    """
    tables = _sections(index, [
        ("all", F.lit("all")), ("severity", F.col("severity")), ("year", F.col("year")), ("theme", F.col("theme")),
        ("site", F.col("site")),
    ])
    several = F.col("inspections") > 1
    themes = several & (F.col("section") == "theme") & (F.col("label") != UNCLASSIFIED)
    kept = tables.filter(F.col("section").isin("all", "severity", "year") | (several & (F.col("section") == "site")) | themes)
    repeats = tables.agg(
        F.coalesce(F.sum(F.when(themes, F.col("inspections") - 1)), F.lit(0)).alias("inspections"),
        count_if(themes).alias("observations"),
    ).select(F.lit("recurring").alias("section"), F.lit("all").alias("label"), "observations", "inspections")
    backlog = open_reviews.agg(F.count("*").alias("observations")).select(
        F.lit("review_required").alias("section"), F.lit("all").alias("label"), "observations",
        F.lit(None).cast("long").alias("inspections"))
    return kept.unionByName(repeats).unionByName(backlog)


def final_tags(tags: DataFrame, reviews: DataFrame) -> DataFrame:
    """A review overrides the prediction. Both sides: category, severity, themes per observation."""
    given = reviews.select("observation_id", F.struct("category", "severity", "themes").alias("_review"))
    joined = tags.join(given, "observation_id", "left")
    use = F.coalesce("_review", F.struct("category", "severity", "themes"))
    return joined.withColumn("_tag", use).select(
        *[c for c in tags.columns if c not in ("category", "severity", "themes")], "_tag.*"
    )


def tag_summaries(tags: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """Observations per category and severity, and theme recurrence by company and site."""
    final = final_tags(tags, reviews)
    count = lambda c: final.groupBy(c).agg(F.countDistinct("observation_id").alias("observations"))
    themes = final.select("observation_id", "inspection_id", "company", "site", F.explode("themes").alias("theme"))
    merged = themes.groupBy("company", "site", "theme", "inspection_id").agg(F.countDistinct("observation_id").alias("_n"))
    recurrence = merged.groupBy("company", "site", "theme").agg(
        F.sum("_n").alias("observations"), F.count("inspection_id").alias("inspections")
    ).withColumn("repeats", F.greatest(F.col("inspections") - 1, F.lit(0)))
    return {"categories": count("category"), "severities": count("severity"), "recurrence": recurrence}


def _benchmark_scope(annual: DataFrame, program: str | None, search: str | None) -> DataFrame:
    if program:
        annual = annual.filter(F.col("program") == program)
    if search:
        text = F.lower(F.concat_ws(" ", "short", "long", "reference"))
        annual = annual.filter(F.contains(text, F.lower(F.lit(search))))
    return annual


def benchmark_summary(
    annual: DataFrame, year: int | None = None, program: str | None = None, search: str | None = None,
    taxonomy: Taxonomy = RISK_TAXONOMY,
) -> DataFrame:
    """Yearly categories and frequencies (before the year filter), then total and themes after it.

    Long result: (section, label, categories, frequency). Themes overlap; a text without a theme
    counts as Unclassified.
    """
    scope = _benchmark_scope(annual, program, search)
    chosen = scope.filter(F.col("year") == year) if year else scope
    measures = [F.count("*").alias("categories"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("frequency")]
    trend = scope.groupBy(F.col("year").cast("string").alias("label")).agg(*measures).withColumn("section", F.lit("trend"))
    total = chosen.agg(*measures).withColumns({"section": F.lit("total"), "label": F.lit("all")})
    found = theme_array(F.col("long"), taxonomy)
    themes = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNCLASSIFIED)))
    by_theme = chosen.select("frequency", F.explode(themes).alias("label")).groupBy("label").agg(*measures).withColumn(
        "section", F.lit("theme")
    )
    order = ["section", "label", "categories", "frequency"]
    return trend.select(*order).unionByName(total.select(*order)).unionByName(by_theme.select(*order))


def benchmark_rows(annual: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """Frequency descending, then year, then cite id."""
    return page(annual, [F.col("frequency").desc(), F.col("year"), F.col("cite_id"), F.col("program")], limit, offset)


def control_totals(summary_rows: DataFrame, cells: str = "cells", marker: str = "Actual Total") -> DataFrame:
    """The value beside the first filled cell that starts with the marker, per year."""
    filled = summary_rows.withColumn("_c", F.filter(cells, lambda x: x.isNotNull()))
    return filled.filter(F.startswith(F.get("_c", F.lit(0)), F.lit(marker))).select(
        "year", F.get("_c", F.lit(1)).try_cast("double").cast("long").alias("control_total"), "source_row"
    )
