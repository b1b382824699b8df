"""Canonical inspections: mapping, typing, rejection, ids, keys, duplicates and quality."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditgrain.functions.expressions import count_if
from auditgrain.operators.ranking import range_rank, two_level_rank
from auditgrain.session import materialize
from auditgrain.sources.readers import apply_mapping_columns

# --- fixed values: canonical columns, source date formats, class phrases, flag words -------------
CANONICAL = [
    "inspection_id", "fei_number", "company_name", "site_name", "inspection_date",
    "country", "product_type", "inspection_type", "classification", "citation_flag",
    "observation_count", "project_area", "observation_text", "fiscal_year",
]
IDENTITY = ["company_name", "fei_number", "site_name"]
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss"]
CLASS_PHRASES = {
    "NAI": ["NAI", "NOACTIONINDICATED"],
    "VAI": ["VAI", "VOLUNTARYACTIONINDICATED"],
    "OAI": ["OAI", "OFFICIALACTIONINDICATED"],
}
TRUE_WORDS = ["true", "yes", "1", "y"]
FALSE_WORDS = ["false", "no", "0", "n"]
REASON_DATE = "Invalid date"
REASON_FUTURE = "Future inspection date"
REASON_COUNT = "Invalid observation count"
REASON_IDENTITY = "Missing identity"
# --- end of fixed values ------------------------------------------------------------------------


def apply_mapping(df: DataFrame, mapping: Mapping[str, str], source_row: str | None = None) -> DataFrame:
    """Rename source columns to canonical names, keep the raw row as JSON, null the missing ones."""
    unknown = set(mapping) - set(CANONICAL)
    if len(set(mapping.values())) != len(mapping):
        raise ValueError("a source column may feed only one canonical field")
    if unknown:
        raise ValueError(f"unknown canonical fields: {sorted(unknown)}")
    source = apply_mapping_columns(mapping, CANONICAL)
    if not any(source[k] in df.columns for k in IDENTITY):
        raise ValueError("map at least one of company_name, fei_number, site_name")
    pick = [
        (F.col(f"`{s}`").cast("string") if s in df.columns else F.lit(None).cast("string")).alias(name)
        for name, s in source.items()
    ]
    row = [F.col(source_row).cast("long").alias("source_row")] if source_row else []
    return df.select(*pick, *row, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("source_record"))


def blank_to_null(df: DataFrame, columns: Sequence[str] = CANONICAL) -> DataFrame:
    return df.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns})


def normalize_company(df: DataFrame) -> DataFrame:
    """Collapse blanks in the name and derive the lower-cased key."""
    name = F.regexp_replace("company_name", r"\s+", " ")
    return df.withColumns({"company_name": name, "company_key": F.lower(name)})


def normalize_classification(c: Column) -> Column:
    letters = F.upper(F.regexp_replace(c, "[^a-zA-Z]", ""))
    out = F.lit(None).cast("string")
    for code, phrases in CLASS_PHRASES.items():
        out = F.when(letters.isin(*phrases), F.lit(code)).otherwise(out)
    return out


def _digits_shape(fmt: str) -> str | None:
    """Regular expression of a purely numeric date format, or None for formats with names in them."""
    runs = re.findall(r"([A-Za-z])\1*", fmt)
    if any(r not in "yMdHms" for r in runs) or "MMM" in fmt:
        return None
    return "^" + "".join(r"\d" if ch.isalpha() else re.escape(ch) for ch in fmt) + "$"


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first format that parses strictly; never a guess.

    A text is handed to a format only when its digits and separators have that format's shape: a
    failed parse costs an exception per row, and most failures are just other formats.
    """
    tried = []
    for fmt in formats:
        parsed, shape = F.to_date(F.try_to_timestamp(c, F.lit(fmt))), _digits_shape(fmt)
        tried.append(parsed if shape is None else F.when(c.rlike(shape), parsed))
    return F.coalesce(*tried)


def parse_count(c: Column) -> Column:
    return c.try_cast("double").try_cast("int")


def parse_flag(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*TRUE_WORDS), 1).when(low.isin(*FALSE_WORDS), 0)


def rejection_reason(as_of: str) -> Column:
    """Joined reasons over raw_date, raw_count and the parsed columns; empty means valid."""
    count = F.col("observation_count")
    bad_count = F.col("raw_count").isNotNull() & (
        count.isNull() | (count < 0) | (F.col("raw_count").try_cast("double") != count)
    )
    return F.concat_ws(
        "; ",
        F.when(F.col("raw_date").isNotNull() & F.col("inspection_date").isNull(), REASON_DATE),
        F.when(F.col("inspection_date") > F.lit(date.fromisoformat(as_of)), REASON_FUTURE),
        F.when(bad_count, REASON_COUNT),
        F.when(F.coalesce(*[F.col(k) for k in IDENTITY]).isNull(), REASON_IDENTITY),
    )


def derive_id() -> Column:
    """The given id, else a digest of all other canonical values."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in CANONICAL if k != "inspection_id"]
    return F.coalesce(
        F.col("inspection_id"), F.concat(F.lit("DERIVED-"), F.sha2(F.concat_ws("|", *parts), 256))
    )


def site_key() -> Column:
    return F.coalesce(
        F.col("fei_number"),
        F.concat_ws(
            " | ", F.coalesce("company_key", F.lit("unknown")), F.coalesce("site_name", F.lit("unspecified"))
        ),
    )


def calendar_features(df: DataFrame, as_of: str) -> DataFrame:
    """Year, month, age in days, class indicators (null when unknown) and title-cased labels."""
    day = F.col("inspection_date")
    known = F.col("classification").isNotNull()
    return df.withColumns({
        "inspection_year": F.year(day),
        "inspection_month": F.month(day),
        "inspection_recency": F.datediff(F.lit(date.fromisoformat(as_of)), day),
        "OAI_indicator": F.when(known, (F.col("classification") == "OAI").cast("int")),
        "VAI_indicator": F.when(known, (F.col("classification") == "VAI").cast("int")),
        "country": F.initcap("country"),
        "product_type": F.initcap("product_type"),
    })


def type_rows(mapped: DataFrame, as_of: str) -> DataFrame:
    """All row-local steps from mapped strings to typed, keyed rows with a rejection reason."""
    df = normalize_company(blank_to_null(mapped))
    df = df.withColumns({
        "raw_classification": F.col("classification"),
        "raw_date": F.col("inspection_date"),
        "raw_count": F.col("observation_count"),
    })
    df = df.withColumns({
        "classification": normalize_classification(F.col("raw_classification")),
        "inspection_date": parse_date(F.col("raw_date")),
        "observation_count": parse_count(F.col("raw_count")),
        "citation_indicator": parse_flag(F.col("citation_flag")),
    })
    return df.withColumn("rejection_reason", rejection_reason(as_of)).withColumn("inspection_id", derive_id())


def duplicate_rank(df: DataFrame, key: str = "inspection_id", order: str = "source_row") -> DataFrame:
    """`is_duplicate`: every row but the first by source row.

    The first row is found by a partially aggregated minimum and joined back, so that one id with
    a third of all rows is never sorted inside a single task.
    """
    firsts = df.groupBy(key).agg(F.min(order).alias("_first"))
    return df.join(firsts, key).withColumn("is_duplicate", F.col(order) != F.col("_first")).drop("_first")


def duplicate_positions(df: DataFrame, key: str = "inspection_id", order: str = "source_row") -> DataFrame:
    """The full 1..n rank of each row within its id, computed in two levels."""
    return two_level_rank(df, [key], [F.floor(F.col(order) / 100000).alias("_block")], [F.col(order)], "duplicate_rank")


def split_valid(ranked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid, rejected and duplicate rows: disjoint and exhaustive; duplicate wins over rejected."""
    duplicate = F.col("is_duplicate")
    rejected = F.col("rejection_reason") != ""
    return ranked.filter(~duplicate & ~rejected), ranked.filter(~duplicate & rejected), ranked.filter(duplicate)


def attach_site_counts(df: DataFrame, key: str = "site_key") -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("site_inspection_count"))
    return df.join(counts, key, "left")


def recency_rank(df: DataFrame, key: str = "site_key") -> DataFrame:
    """Newest first per site, undated last, then id.

    A site may hold a third of all rows, and all of them undated, so rows are dealt to ranges of the
    whole order.
    """
    return range_rank(df, [key], [F.col("inspection_date").desc_nulls_last(), F.col("inspection_id")], "inspection_rank")


def quality_report(ranked: DataFrame, missing_columns: Sequence[str] = ()) -> DataFrame:
    """One-row reconciliation report, in a single pass."""
    total = F.count("*")
    missing = {k: count_if(F.col(k).isNull()) for k in CANONICAL}
    all_missing = sum((c for c in missing.values()), F.lit(0))
    duplicate = F.col("is_duplicate")
    rejected = F.col("rejection_reason") != ""
    return ranked.agg(
        total.alias("total_records"),
        count_if(~duplicate & ~rejected).alias("valid_records"),
        count_if(~duplicate & rejected).alias("rejected_records"),
        count_if(duplicate).alias("duplicate_records"),
        *[c.alias(f"missing_{k}") for k, c in missing.items()],
        count_if(F.col("raw_date").isNotNull() & F.col("inspection_date").isNull()).alias("invalid_dates"),
        count_if(F.col("raw_classification").isNotNull() & F.col("classification").isNull()).alias("unknown_classifications"),
        F.round(
            100 * (1 - all_missing.cast("double") / F.nullif(total.cast("double") * len(CANONICAL), F.lit(0.0))), 2
        ).alias("data_completeness_pct"),
        F.lit(",".join(missing_columns)).alias("missing_columns"),
    )


def canonicalize(
    df: DataFrame, mapping: Mapping[str, str], as_of: str, source_row: str
) -> dict[str, DataFrame]:
    """Source strings to valid / rejected / duplicate tables plus the quality report.

    The typed rows feed all four results, so they are parsed and written once.
    """
    source = apply_mapping_columns(mapping, CANONICAL)
    ranked = duplicate_rank(materialize(type_rows(apply_mapping(df, mapping, source_row), as_of), "typed", "zstd"))
    valid, rejected, duplicates = split_valid(ranked)
    valid = calendar_features(valid, as_of).withColumn("site_key", site_key())
    valid = recency_rank(attach_site_counts(valid))
    return {
        "valid": valid,
        "rejected": rejected,
        "duplicates": duplicates,
        "quality": quality_report(ranked, [k for k in CANONICAL if source[k] not in df.columns]),
    }


def filter_inspections(df: DataFrame, **filters: object) -> DataFrame:
    """Equality, range and type filters; empty values are ignored, unknown names are errors.

    `classification="Unknown"` means no recorded class.
    """
    equal = {
        "company": "company_key", "site": "site_key", "fei_number": "fei_number", "country": "country",
        "product_type": "product_type", "project_area": "project_area", "classification": "classification",
        "year": "inspection_year", "inspection_type": "inspection_type",
    }
    bounds = {
        "start_year": ("inspection_year", ">="), "end_year": ("inspection_year", "<="),
        "start_date": ("inspection_date", ">="), "end_date": ("inspection_date", "<="),
    }
    for name, value in filters.items():
        if name not in equal and name not in bounds:
            raise ValueError(f"unsupported inspection filter: {name}")
        if value is None or value == "":
            continue
        if name == "classification" and value == "Unknown":
            df = df.filter(F.col("classification").isNull())
        elif name in equal:
            wanted = str(value).strip().lower() if name == "company" else value
            df = df.filter(F.col(equal[name]) == F.lit(wanted))
        else:
            column, op = bounds[name]
            limit = F.lit(value).cast("date") if name.endswith("date") else F.lit(value)
            df = df.filter(F.col(column) >= limit if op == ">=" else F.col(column) <= limit)
    return df


def filter_site(df: DataFrame, site: str) -> DataFrame:
    """Rows of the site key; only when there is none, rows of that site name."""
    hit = df.filter(F.col("site_key") == site).select(F.count("*").alias("n")).scalar()
    return df.filter((F.col("site_key") == site) | ((hit == 0) & (F.col("site_name") == site)))


def search_literal(df: DataFrame, needle: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive literal substring in any column; % and _ mean themselves."""
    wanted = F.lower(F.lit(needle))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), wanted), F.lit(False))
    return df.filter(hit)


NARROW = {
    "inspection_id": T.StringType(), "company_key": T.StringType(), "site_key": T.StringType(),
    "fei_number": T.StringType(), "country": T.StringType(), "product_type": T.StringType(),
    "classification": T.StringType(), "project_area": T.StringType(), "inspection_year": T.IntegerType(),
    "company_name": T.StringType(), "site_name": T.StringType(), "inspection_date": T.DateType(),
    "inspection_type": T.StringType(), "citation_indicator": T.IntegerType(),
    "observation_count": T.IntegerType(), "observation_text": T.StringType(),
    "posted_citation_indicator": T.IntegerType(), "available_citation_count": T.IntegerType(),
}


def narrow_projection(df: DataFrame) -> DataFrame:
    """The 18 analytic columns, re-typed; absent ones become null."""
    return df.select(*[
        (F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in NARROW.items()
    ])


def reconcile_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row telling whether a projection kept every row."""
    counts = before.agg(F.count("*").alias("n_before")).select(
        "n_before", after.agg(F.count("*")).scalar().alias("n_after")
    )
    return counts.withColumn("reconciled", F.col("n_before") == F.col("n_after"))


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    name = F.col(column)
    return df.filter(name.isNotNull() & (name != "")).select(name).distinct().orderBy(column)


def program_alias(c: Column, aliases: Mapping[str, str]) -> Column:
    out = c
    for old, new in aliases.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out
