"""Running values over sequences of any length: a session of ten million events is many tasks, not one.

Rows are dealt by ranges of their order.  Each part works out its running
values, its summary goes behind those of the parts before, and what comes out
corrects the part's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import durable
from .windows import SESSION

#: Summaries that are broadcast to the rows; more are joined by shuffle.
MAX_SUMMARIES = 200_000


@dataclass(frozen=True)
class Total:
    """The sum of the value from the first row up to this one, null counting as 0."""

    value: Column


@dataclass(frozen=True)
class Latest:
    """The last value that is not null, up to this row, or before it."""

    value: Column
    before: bool = False


@dataclass(frozen=True)
class Next:
    """The first value that is not null, from this row on, or behind it."""

    value: Column
    behind: bool = False


def lag(value: Column) -> Latest:
    """The value of the row before, null or not; a struct of one field, ``v``."""
    return Latest(F.struct(value.alias("v")), before=True)


def lead(value: Column) -> Next:
    """The value of the row behind, null or not; a struct of one field, ``v``."""
    return Next(F.struct(value.alias("v")), behind=True)


def scan(rows: DataFrame, keys: tuple[str, ...] = SESSION, order: tuple[str, ...] = ("ord",), parts: int | None = None, **columns: Total | Latest | Next) -> DataFrame:
    """Rows with the running values of ``columns`` within their ``keys``, by ``order``.

    The order must tell a key's rows apart; rows that it doesn't stand as they
    happen to.  ``parts`` is how many ranges there are, the number of shuffle
    partitions by default.  A null key is a key; an empty table gives no rows.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumns({f"_v_{name}": c.value for name, c in columns.items()})
    dealt = durable(named.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    group = dealt.groupBy(*keys, "_part")
    of = Window.partitionBy(*keys).orderBy("_part")
    place = F.struct(*order)
    sums, carried, local = [], {}, {}
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    back = Window.partitionBy(*keys, "_part").orderBy(*[F.desc(o) for o in order])  # a frame up to the end would be read again for each row
    for name, c in columns.items():
        value, there = F.col(f"_v_{name}"), F.col(f"_s_{name}")
        if isinstance(c, Total):
            sums.append(F.sum(value).alias(f"_s_{name}"))
            carried[name] = F.sum(there).over(of.rowsBetween(Window.unboundedPreceding, -1))
            local[name] = F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        elif isinstance(c, Latest):
            sums.append(F.max_by(value, F.when(value.isNotNull(), place)).alias(f"_s_{name}"))
            carried[name] = F.last(there, True).over(of.rowsBetween(Window.unboundedPreceding, -1))
            local[name] = F.last(value, True).over(own.rowsBetween(Window.unboundedPreceding, -1 if c.before else 0))
        else:
            sums.append(F.min_by(value, F.when(value.isNotNull(), place)).alias(f"_s_{name}"))
            carried[name] = F.first(there, True).over(of.rowsBetween(1, Window.unboundedFollowing))
            local[name] = F.last(value, True).over(back.rowsBetween(Window.unboundedPreceding, -1 if c.behind else 0))
    summaries = durable(group.agg(*sums)).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), *[c.alias(f"_c_{n}") for n, c in carried.items()])
    if summaries.limit(MAX_SUMMARIES + 1).count() <= MAX_SUMMARIES:
        summaries = F.broadcast(summaries)
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    met = dealt.withColumns({f"_l_{n}": c for n, c in local.items()}).join(summaries, same)
    out = [(F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0)) if isinstance(c, Total) else F.coalesce(f"_l_{n}", f"_c_{n}")).alias(n) for n, c in columns.items()]
    return met.select(*rows.columns, *out)


def longest_run(rows: DataFrame, begins: Column, keys: tuple[str, ...] = SESSION, order: tuple[str, ...] = ("ord",), parts: int | None = None) -> DataFrame:
    """``keys`` and the length of the longest run, where ``begins`` marks each run's first row; runs are counted by partial sums."""
    runs = scan(rows, keys, order, parts, _run=Total(begins.cast("int")))
    return runs.groupBy(*keys, "_run").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("longest"))
