"""Grounding and evaluation as batch joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.functions.expressions import count_if, known_ratio

NUMBER = r"(?<!\w)\d+(?:\.\d+)?"


def numbers(c: Column | str) -> Column:
    """Distinct numbers in a text, thousands commas removed."""
    return F.array_distinct(F.regexp_extract_all(F.replace(F.col(c) if isinstance(c, str) else c, F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(0)))


def grounding_check(answers: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per answer: unknown citations, unsupported numbers and the verdict.

    `answers` (answer_id, text), `citations` (answer_id, source_id), `evidence` (source_id, text).
    Numbers are compared as rows, so an answer may cite any amount of evidence. An answer without
    citations supports no number.
    """
    cited = citations.select("answer_id", "source_id").distinct()
    unknown = cited.join(evidence.select("source_id"), "source_id", "left_anti").groupBy("answer_id").agg(
        F.count("*").alias("unknown_citations")
    )
    supply = evidence.select("source_id", F.explode(numbers("text")).alias("number"))
    support = cited.join(supply, "source_id").select("answer_id", "number").distinct()
    claims = answers.select("answer_id", F.explode(numbers("text")).alias("number"))
    missing = claims.join(support, ["answer_id", "number"], "left_anti").groupBy("answer_id").agg(
        F.count("*").alias("unsupported_numbers")
    )
    joined = answers.select("answer_id").join(unknown, "answer_id", "left").join(missing, "answer_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("answer_id", zero("unknown_citations"), zero("unsupported_numbers")).withColumn(
        "grounded", (F.col("unknown_citations") == 0) & (F.col("unsupported_numbers") == 0)
    )


def retrieval_scores(results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Per query and mode: precision, recall and reciprocal rank over the top k documents.

    `results` (query_id, mode, document_id, rank), `gold` (query_id, document_id). Every query with gold
    is scored under every mode of the results; without a hit or a result it scores 0. Queries without
    gold score null. Counting joins only: the gold set of a query may be of any size.
    """
    documents = results.groupBy("query_id", "mode", "document_id").agg(F.min("rank").alias("_r"))
    from auditgrain.operators.ranking import top_k

    best = top_k(documents, ["query_id", "mode"], [F.col("_r"), F.col("document_id")], k, "position")
    wanted = gold.select("query_id", "document_id").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("gold"))
    marked = best.join(wanted.withColumn("_hit", F.lit(True)), ["query_id", "document_id"], "left")
    scored = marked.groupBy("query_id", "mode").agg(
        F.count("*").alias("retrieved"), F.count("_hit").alias("hits"), F.min(F.when(F.col("_hit"), F.col("position"))).alias("first_hit"),
    )
    # few modes, named by the results, for every query that has gold
    modes = results.select("mode").distinct().agg(F.collect_set("mode").alias("modes"))
    asked = sizes.select("query_id", F.explode(modes.scalar()).alias("mode"))
    scored = scored.join(asked, ["query_id", "mode"], "full").join(sizes, "query_id", "left").fillna(0, ["retrieved", "hits"])
    has = F.col("gold").isNotNull()
    return scored.select(
        "query_id", "mode", "retrieved", "hits",
        F.when(has, F.coalesce(F.round(F.try_divide("hits", "retrieved"), 6), F.lit(0.0))).alias("precision"),
        F.when(has, F.round(F.col("hits") / F.col("gold"), 6)).alias("recall"),
        F.when(has, F.coalesce(F.round(1.0 / F.col("first_hit"), 6), F.lit(0.0))).alias("reciprocal_rank"),
    )


def retrieval_eval(results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Means per mode over the queries that have gold."""
    scores = retrieval_scores(results, gold, k)
    return scores.groupBy("mode").agg(
        F.count("precision").alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "reciprocal_rank")]
    )


def numeric_agreement(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Share of expected values that the actual table reproduces exactly."""
    # Coalesced inside a struct so that a present null equals an expected null, but an absent row does not.
    given = actual.select(*keys, F.struct(F.col(value).alias("v")).alias("_a"))
    joined = expected.select(*keys, F.struct(F.col(value).alias("v")).alias("_e")).join(given, list(keys), "left")
    equal = F.col("_a").isNotNull() & F.col("_a.v").eqNullSafe(F.col("_e.v"))
    return joined.agg(F.count("*").alias("expected"), count_if(equal).alias("equal")).withColumn(
        "agreement", known_ratio(F.col("equal"), F.col("expected"))
    )


def evidence_grounding(records: DataFrame, source: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Share of records whose fields all equal those of their source row."""
    origin = source.select(key, F.struct(*fields).alias("_s"))
    same = F.col("_s").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_s.{f}"))
    return records.join(origin, key, "left").agg(F.count("*").alias("records"), count_if(same).alias("grounded")).withColumn(
        "grounding", known_ratio(F.col("grounded"), F.col("records"))
    )


def scope_correctness(actual: DataFrame, expected: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per answer: is the scope that was applied the scope that was asked for?"""
    want = expected.select(key, F.struct(*fields).alias("_e"))
    same = F.col("_e").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_e.{f}"))
    return actual.join(want, key, "left").select(key, same.alias("scope_correct"))


def judge_decision(
    df: DataFrame, dimensions: Sequence[str], pass_score: float = 80, revision_score: float = 60, floor: float = 7
) -> DataFrame:
    """Overall score and verdict; groundedness and safety each need the floor to pass."""
    total = F.lit(0.0)
    for d in dimensions:
        total = total + F.col(d)
    hard = (F.col("groundedness") >= floor) & (F.col("safety") >= floor)
    scored = df.withColumn("overall", F.round(total / len(dimensions) * 10, 2))
    return scored.withColumn(
        "decision",
        F.when((F.col("overall") >= pass_score) & hard, "PASS").when(F.col("overall") >= revision_score, "REVISION_REQUIRED").otherwise("FAIL"),
    )


def tag_accuracy(predictions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Category and severity accuracy, micro theme precision and recall, on reviewed rows only."""
    truth = reviews.select("observation_id", F.struct("category", "severity", "themes").alias("_t"))
    joined = predictions.join(truth, "observation_id")
    distinct = lambda c: F.size(F.array_distinct(c))
    sums = joined.agg(
        F.count("*").alias("reviewed"),
        count_if(F.col("category") == F.col("_t.category")).alias("_c"), count_if(F.col("severity") == F.col("_t.severity")).alias("_s"),
        F.sum(F.size(F.array_intersect("themes", "_t.themes"))).alias("_tp"),
        F.sum(distinct("themes")).alias("_pred"), F.sum(distinct("_t.themes")).alias("_gold"),
    )
    return sums.select(
        "reviewed", known_ratio(F.col("_c"), F.col("reviewed")).alias("category_accuracy"),
        known_ratio(F.col("_s"), F.col("reviewed")).alias("severity_accuracy"),
        known_ratio(F.col("_tp"), F.col("_pred")).alias("theme_precision"), known_ratio(F.col("_tp"), F.col("_gold")).alias("theme_recall"),
    )


def routing_eval(routed: DataFrame, expected: str = "expected_target", actual: str = "target") -> DataFrame:
    """Share routed as expected, per expected target and over all (`ALL`), with mean precision and recall
    over the rows that have gold."""
    right = F.col(expected).eqNullSafe(F.col(actual)).cast("int")
    both = routed.withColumn("_scope", F.explode(F.array(F.col(expected), F.lit("ALL"))))
    return both.groupBy(F.col("_scope").alias("expected_target")).agg(
        F.count("*").alias("queries"), F.round(F.avg(right), 6).alias("routing_accuracy"),
        F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"),
    )
