"""Append-only reviews: latest decision, history, backlog and optimistic concurrency as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrain.functions.taxonomy import OBSERVATION_TAXONOMY, Taxonomy
from auditgrain.operators.folds import ordered_fold
from auditgrain.operators.tagging import SEVERITIES, UNCLASSIFIED

KEYS = ["run_id", "observation_id"]
DECIDED = ("Approve", "Modify")


def latest_review(reviews: DataFrame) -> DataFrame:
    """The highest revision per (run, observation), by a partially aggregated maximum."""
    rest = [c for c in reviews.columns if c not in KEYS]
    # rows are sorted for this maximum: ids first, as runs hardly tell them apart
    return reviews.groupBy(*reversed(KEYS)).agg(F.max_by(F.struct(*rest), "revision").alias("_r")).select(*KEYS, "_r.*")


def review_history(reviews: DataFrame, run_id: str, observation_id: str) -> DataFrame:
    return reviews.filter((F.col("run_id") == run_id) & (F.col("observation_id") == observation_id)).orderBy(
        F.col("revision").desc()
    )


def needs_review(index: DataFrame, reviews: DataFrame) -> DataFrame:
    """Observations whose latest review is neither Approve nor Modify, or that have none."""
    # of the latest review only its kind counts: a flag is aggregated by hash, whole reviews would be sorted
    decided = F.max_by(F.col("action").isin(*DECIDED), "revision")
    done = reviews.groupBy(*reversed(KEYS)).agg(decided.alias("_done")).filter("_done").select(*KEYS)
    return index.join(done, KEYS[::-1], "left_anti").select(*index.columns)


def apply_reviews(
    incoming: DataFrame, current: DataFrame, index: DataFrame, taxonomy: Taxonomy = OBSERVATION_TAXONOMY,
    arrival: str = "arrival",
) -> DataFrame:
    """Judge a batch of reviews in arrival order: `accepted`, `conflict`, `invalid` or `unknown`.

    A review is accepted when the revision it was written against is still the current one; it then
    becomes the next revision, which later reviews of the batch may follow. Reviews that arrive at once
    are taken by revision. One pass: reviews are dealt by observation and sorted there by arrival, and a
    fold over the sorted rows carries the current revision alone, so that a task holds no observation's
    reviews at once, however many there are.
    """
    known = index.select(*KEYS).distinct().withColumn("_known", F.lit(True))
    latest = current.groupBy(*KEYS).agg(F.max("revision").alias("_current"))
    modified = (F.col("action") == "Modify") & ~(
        F.coalesce(F.col("theme").isin(*taxonomy.names, UNCLASSIFIED), F.lit(False))
        & F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))
    )
    judged = incoming.join(known, KEYS, "left").join(latest, KEYS, "left").select(
        *incoming.columns, F.coalesce("_current", F.lit(0)).cast("long").alias("_current"),
        F.when(F.col("_known").isNull(), "unknown").when(modified, "invalid").alias("_known_status"),
    )
    def judge(now: int | None, revision: int | None, start: int, status: str | None) -> tuple[int, tuple[int | None, str]]:
        now = start if now is None else now
        if status is not None:
            return now, (None, status)
        return (now + 1, (now + 1, "accepted")) if revision == now else (now, (None, "conflict"))

    out = ordered_fold(judged, KEYS, [arrival, "revision"], ["revision", "_current", "_known_status"], {"new_revision": "long", "status": "string"}, judge)
    return out.select(*incoming.columns, F.col("new_revision").cast(incoming.schema["revision"].dataType).alias("new_revision"), "status")
