"""Ordered-sequence helpers: one partitioning by session serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SESSION = ("host", "session_id")


def in_order(order: str = "idx", keys: tuple[str, ...] = SESSION) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def so_far(order: str = "idx", keys: tuple[str, ...] = SESSION) -> WindowSpec:
    return in_order(order, keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def after(order: str = "idx", keys: tuple[str, ...] = SESSION) -> WindowSpec:
    return in_order(order, keys).rowsBetween(1, Window.unboundedFollowing)


def islands(begins: Column, order: str = "idx", keys: tuple[str, ...] = SESSION) -> Column:
    """Number of the run a row is in, where ``begins`` marks each run's first row."""
    return F.sum(F.when(begins, 1).otherwise(0)).over(so_far(order, keys))


def next_match(condition: Column, value: Column, order: str = "idx", keys: tuple[str, ...] = SESSION) -> Column:
    """The value of the next row that fits, behind this one."""
    return F.min(F.when(condition, value)).over(after(order, keys))


def forward_fill(value: Column, order: str = "idx", keys: tuple[str, ...] = SESSION) -> Column:
    return F.last(value, ignorenulls=True).over(so_far(order, keys))


def deltas(cumulative: Column, order: str = "idx", keys: tuple[str, ...] = SESSION) -> Column:
    """Growth of a running total since its last reading, never below zero."""
    before = F.last(cumulative, ignorenulls=True).over(in_order(order, keys).rowsBetween(Window.unboundedPreceding, -1))
    return F.greatest(F.lit(0), cumulative - F.coalesce(before, F.lit(0)))


def turns(is_user: Column, order: str = "ord", keys: tuple[str, ...] = SESSION) -> Column:
    """Turn of a row; a user message opens the next one, what comes before the first is turn 0."""
    return islands(is_user, order, keys)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def fill_days(df: DataFrame, last: str, days: int, day: str = "day") -> DataFrame:
    """Every day of the ``days`` up to ``last``, with the rows that are there."""
    spark = df.sparkSession
    every = spark.range(days).select(F.date_format(F.date_sub(F.lit(last).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias(day))
    return every.join(df, day, "left")
