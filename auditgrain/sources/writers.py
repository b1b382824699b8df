"""Sinks. Every write is distributed; nothing is collected to build a file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed value: leading characters a spreadsheet would run as a formula ------------------------
FORMULA_START = r"^[=+\-@]"
# --- end of fixed value -------------------------------------------------------------------------


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_quality(report: DataFrame, path: str) -> None:
    """The reconciliation report is one row; written as JSON."""
    report.write.mode("overwrite").json(path)


def export_tags_jsonl(tags: DataFrame, path: str, order: str = "observation_id") -> None:
    """Full tagged snapshot as gzip JSON lines, globally ordered by a range partitioned sort."""
    tags.orderBy(order).write.mode("overwrite").option("compression", "gzip").json(path)


def formula_safe(c: Column) -> Column:
    """Prefix text a spreadsheet would run as a formula with an apostrophe."""
    return F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def export_csv_safe(df: DataFrame, path: str) -> None:
    safe = [formula_safe(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").csv(path, header=True, escape='"')


def save_evidence(scope: DataFrame, analysis_id: str, path: str, facts: Mapping[str, str] | None = None) -> None:
    """Append the exact records behind an answer, with its scope and metrics, under its id."""
    out = scope.withColumn("analysis_id", F.lit(analysis_id))
    for name, value in (facts or {}).items():
        out = out.withColumn(name, F.lit(value))
    out.write.mode("append").partitionBy("analysis_id").parquet(path)


def export_summaries(summaries: Mapping[str, DataFrame], path: str) -> None:
    """One CSV folder per summary (category, severity, recurrence)."""
    for name, df in summaries.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)
