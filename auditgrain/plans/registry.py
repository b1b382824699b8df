"""Registry of runnable queries: survey id, Spark plan and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    survey_id: str
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(survey_id: str, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under `<family>_<number>_<name>`."""

    def wrap(plan: Plan) -> Plan:
        key = f"{survey_id.lower().replace('-', '')}_{name}"
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = Query(survey_id, plan, sql)
        return plan

    return wrap


def load_all() -> dict[str, Query]:
    from auditgrain.plans import (  # noqa: F401
        canonical, evaluation, insight, measurements, observations, retrieval, risk, rollup, tagging,
    )

    return QUERIES
