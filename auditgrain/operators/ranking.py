"""Ranks, pages and top-k that hold up when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditgrain.session import materialize


def two_level_rank(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[Column],
    fine: Sequence[Column],
    name: str,
    coarse_order: Sequence[Column] | None = None,
) -> DataFrame:
    """Exact row numbers per key without sorting a whole key in one task.

    `coarse` are aliased expressions that split a key into ordered blocks (a day, a range of row
    numbers). Rows are ranked inside (key, block); the running count of earlier blocks, computed
    on the aggregated block table, supplies the offset.
    """
    blocks = df.select("*", *coarse)
    names = [c for c in blocks.columns if c not in df.columns]
    order = list(coarse_order) if coarse_order is not None else [F.col(c) for c in names]
    sizes = blocks.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, *names).orderBy(*fine)
    ranked = blocks.withColumn("_local", F.row_number().over(inner))
    left, right = ranked.alias("l"), offsets.alias("r")
    same = F.lit(True)
    for c in [*keys, *names]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same).select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col("_local") + F.col("_offset")).cast("long").alias(name)
    )


def range_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, ranges: int | None = None) -> DataFrame:
    """Exact row numbers per key where a key, or one block of it, may own a third of all rows.

    Rows are dealt to ranges of (keys, order), whose bounds Spark samples, so a large key spans many
    tasks. A row's place in its sorted range comes with the write; its rank is that place since the
    key began there, and the rows of the key in earlier ranges, a prefix sum over (key, range).
    """
    whole = [*[F.col(k) for k in keys], *order]
    dealt = df.repartitionByRange(ranges, *whole) if ranges else df.repartitionByRange(*whole)
    placed = materialize(dealt.sortWithinPartitions(*whole).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    blocks = placed.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    left, right = placed.withColumn("_part", part).alias("l"), offsets.alias("r")
    same = F.lit(True)
    for c in [*keys, "_part"]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    rank = F.col("l._at") - F.col("r._first") + F.col("r._offset") + 1
    return left.join(right, same).select(*[F.col(f"l.{c}") for c in df.columns], rank.cast("long").alias(name))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """One page with the total beside it. The order must end in a unique key."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError("invalid page")
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total_rows", total)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key; Spark prunes each task to k rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def top_k_per_query(df: DataFrame, k: int, query: str = "query_id", score: str = "score", item: str = "chunk_id") -> DataFrame:
    return top_k(df, [query], [F.col(score).desc(), F.col(item)], k)
