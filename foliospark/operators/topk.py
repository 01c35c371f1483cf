"""Sorts, limits and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_k(df: DataFrame, n: int, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """Best n rows, overall or per partition.  The rank filter is pushed below
    the shuffle, so a partition ships n rows per task at most."""
    if not partition:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*partition).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def paginate(df: DataFrame, order: list[Column], page: int, limit: int, max_limit: int | None = None) -> DataFrame:
    """One page of rows plus ``page, limit, total, total_pages`` on each; ``limit`` on the rows is the
    size used, which ``max_limit`` may bound."""
    size = max(1, limit) if max_limit is None else min(max(1, limit), max_limit)
    page = max(1, page)
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    total = df.agg(F.count("*").alias("n")).scalar()
    return rows.select(
        "*",
        F.lit(page).alias("page"),
        F.lit(size).alias("limit"),
        total.alias("total"),
        F.greatest(F.lit(1), F.ceil(total / size)).cast("long").alias("total_pages"),
    )


def exercise_order() -> list[Column]:
    """Index first, unnumbered last, then page."""
    return [F.asc_nulls_last("pedagogical_index"), F.asc("page_number"), F.asc("chunk_id")]
