"""Percentiles that can be stored and merged: a sketch a signal and day, and figures of any days from these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; a quantile's rank is then off by about 1.3 % of the rows at most, with chance 0.99.
SIZE, RANK_ERROR = 200, 0.0133


def sketched(rows: DataFrame, keys: list[str], value: str | Column, size: int = SIZE) -> DataFrame:
    """``keys``, n, low, high and sketch of the values that are numbers, in partial sums; keys with none give no row."""
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    some = rows.withColumn("_x", number).where("_x is not null and not isnan(_x)")
    return some.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"), F.kll_sketch_agg_double("_x", size).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of each of ``keys`` as one."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: str, share: float) -> Column:
    """The value at or below which about ``share`` of the rows lie."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def aggregates(sketches: DataFrame, keys: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """``keys``, n, min, max and quantiles of stored sketches; signals.aggregate has the exact figures."""
    shares = shares or {"median": 0.5, "p90": 0.9}
    return merged(sketches, keys).select(*keys, "n", F.col("low").alias("min"), F.col("high").alias("max"), *[quantile("sketch", s).alias(name) for name, s in shares.items()])


def add_days(sketches: DataFrame, path: str) -> None:
    """Store sketches by ``day``; the days that come replace those there."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
