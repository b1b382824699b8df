"""Sources: string-typed files, JSON payloads, nested evidence, annual frequency tables, observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: column aliases accepted for observation files, in order of preference ---------
TEXT_ALIASES = ["observation_text", "Observation Text", "Long Description", "long"]
DATE_ALIASES = ["inspection_date", "Inspection End Date", "Inspection Date"]
FREQUENCY_ALIASES = ["frequency", "Frequency", "Frequency of Citations"]
INSPECTION_ALIASES = ["inspection_id", "Inspection ID"]
DATASET_ALIASES = ["dataset", "Dataset"]
# --- end of fixed values ------------------------------------------------------------------------

OBSERVATION_COLUMNS = [
    "dataset", "grain", "inspection_id", "observation_id", "text", "reference", "frequency",
    "company", "site", "fei", "date", "year", "product", "inspection_type",
    "source_file", "source_row", "invalid_reason",
]


#: Quotes inside a field are doubled, fields may hold line breaks, and a backslash is a character.
QUOTED = {"quote": '"', "escape": '"', "multiLine": True}


def read_strings(spark: SparkSession, path: str, fmt: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Read CSV or Parquet with every column as a string; nothing is inferred.

    For CSV the header supplies the names unless `columns` does. Missing values become empty
    strings so that the trim step alone decides what is null.
    """
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        if columns is None:
            columns = spark.read.csv(path, header=True, **QUOTED).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        df = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", **QUOTED)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
        if columns is not None:
            df = df.select(*columns)
    else:
        raise ValueError(f"unsupported format: {fmt}; use csv or parquet")
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def expand_payload(df: DataFrame, payload: str, schema: str | T.StructType) -> DataFrame:
    """Turn a JSON text column into ordinary columns."""
    parsed = F.from_json(F.col(payload), schema)
    return df.withColumn("_payload", parsed).select(*[c for c in df.columns if c != payload], "_payload.*")


def read_nested_payload(spark: SparkSession, path: str, payload: str, schema: str | T.StructType) -> DataFrame:
    """Parquet with a JSON payload column, expanded by the given schema."""
    return expand_payload(spark.read.parquet(path), payload, schema)


def explode_source_rows(
    nested: DataFrame, id_col: str = "inspection_id", projects: str = "project_evidence", citations: str = "citation_evidence"
) -> tuple[DataFrame, DataFrame]:
    """Rebuild the flat project and citation tables from nested evidence arrays."""
    project_rows = nested.select(id_col, F.explode(projects).alias("r")).select(id_col, "r.*")
    citation_rows = nested.select(id_col, F.explode(citations).alias("r")).select(id_col, "r.*")
    return project_rows, citation_rows


def load_annual(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Keep sheet rows with six or more cells, a cite id and a numeric frequency; type the frequency."""
    cell = lambda i: F.get(F.col(fields), F.lit(i))
    kept = df.filter((F.size(fields) >= 6) & cell(1).isNotNull() & cell(5).try_cast("double").isNotNull())
    names = ["program", "cite_id", "reference", "short", "long"]
    return kept.select(
        *[c for c in df.columns if c != fields],
        *[cell(i).alias(n) for i, n in enumerate(names)],
        cell(5).try_cast("double").cast("long").alias("frequency"),
    )


def _pick(df: DataFrame, names: Sequence[str]) -> Column:
    present = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def normalize_observations(df: DataFrame, origin: str, row_col: str) -> DataFrame:
    """Schema-on-read for observation files: the first non-empty alias supplies each field.

    A row with a frequency and no inspection is an annual template. A frequency that is not a
    non-negative whole number, or a file without any text column, gives an invalid reason. `row_col`
    numbers the rows of the file: rows are told apart and ordered by it.
    """
    frequency = _pick(df, FREQUENCY_ALIASES)
    number = frequency.try_cast("double")
    inspection = _pick(df, INSPECTION_ALIASES)
    bad_frequency = frequency.isNotNull() & (number.isNull() | (number < 0) | (number != F.floor(number)))
    supported = any(n in df.columns for n in TEXT_ALIASES)
    reason = (
        F.when(bad_frequency, F.lit("Invalid frequency")) if supported
        else F.lit("Unsupported observation schema")
    )
    optional = lambda *names: _pick(df, names)
    return df.select(
        F.coalesce(_pick(df, DATASET_ALIASES), F.lit("additional")).alias("dataset"),
        F.when(frequency.isNotNull() & inspection.isNull(), "annual_template").otherwise("inspection").alias("grain"),
        inspection.alias("inspection_id"),
        optional("observation_id", "Observation ID").alias("observation_id"),
        _pick(df, TEXT_ALIASES).alias("text"),
        optional("reference", "Act/CFR Number", "Reference").alias("reference"),
        F.when(~F.coalesce(bad_frequency, F.lit(False)), number.cast("long")).alias("frequency"),
        optional("company_name", "Company", "Legal Name").alias("company"),
        optional("site_key", "site_name", "Site").alias("site"),
        optional("fei_number", "FEI Number", "FEI").alias("fei"),
        _pick(df, DATE_ALIASES).alias("date"),
        optional("fiscal_year", "year", "Fiscal Year").try_cast("int").alias("year"),
        optional("product_type", "Product", "Program Area").alias("product"),
        optional("inspection_type", "Inspection Type").alias("inspection_type"),
        F.lit(origin).alias("source_file"),
        F.col(row_col).cast("string").alias("source_row"),
        reason.cast("string").alias("invalid_reason"),
    )


def observations_from_inspections(
    inspections: DataFrame, citations: DataFrame, dataset: str, origin: str
) -> DataFrame:
    """One row per citation of an inspection, or its own text where it has none.

    Citations arrive as rows (inspection_id, source_row, reference, long, short), not as an array,
    so an inspection with very many of them is spread over tasks.
    """
    base = inspections.select(
        F.lit(dataset).alias("dataset"), F.lit("inspection").alias("grain"), "inspection_id",
        F.lit(None).cast("string").alias("observation_id"),
        F.col("observation_text"),
        F.lit(None).cast("long").alias("frequency"),
        F.col("company_name").alias("company"), F.col("site_key").alias("site"),
        F.col("fei_number").alias("fei"), F.col("inspection_date").cast("string").alias("date"),
        F.col("fiscal_year").alias("year"), F.col("product_type").alias("product"),
        F.col("inspection_type"), F.lit(origin).alias("source_file"),
    )
    cites = citations.select(
        "inspection_id", F.col("source_row").alias("_row"), F.col("reference").alias("_reference"),
        F.coalesce(F.nullif(F.col("long"), F.lit("")), F.nullif(F.col("short"), F.lit(""))).alias("_text"),
        F.lit(True).alias("_cited"),
    )
    joined = base.join(cites, "inspection_id", "left")
    return joined.select(
        "dataset", "grain", "inspection_id", "observation_id",
        F.when(F.col("_cited"), F.col("_text")).otherwise(F.col("observation_text")).alias("text"),
        F.when(F.col("_cited"), F.col("_reference")).otherwise(F.lit("inspection_text")).alias("reference"),
        "frequency", "company", "site", "fei", "date", "year", "product", "inspection_type", "source_file",
        F.col("_row").alias("source_row"),
        F.lit(None).cast("string").alias("invalid_reason"),
    )


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """All normalised sources under one schema; the position in the list is the load priority."""
    if not sources:
        raise ValueError("give at least one source")
    tagged = [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def apply_mapping_columns(mapping: Mapping[str, str], canonical: Sequence[str]) -> dict[str, str]:
    """Source column of every canonical name; unmapped names stand for themselves."""
    return {name: mapping.get(name, name) for name in canonical}
