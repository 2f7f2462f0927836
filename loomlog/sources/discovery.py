"""Where transcripts are, which copy of a session counts, and small tables that are read with them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plugins import register

#: Lines in which a rollout file must name its session.
HEAD_LINES = 8


def classify_root(path: str) -> str:
    """What a root is: a folder with thread tables, one with a sessions folder, or one of JSON lines."""
    if os.path.isdir(path) and any(n.startswith("state") and n.endswith(".sqlite") for n in os.listdir(path)):
        return "sqlite_home"
    return "sessions_dir" if os.path.isdir(os.path.join(path, "sessions")) else "jsonl_dir"


def list_files(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(root_rank, path, session_id, project, size, mtime) of the files below the roots; contents are not read."""
    out = None
    for rank, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?:\.events)?\.jsonl$", "")
        rows = files.select(F.lit(rank).alias("root_rank"), "path", name.alias("session_id"), F.element_at(F.split("path", "/"), -2).alias("project"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_root_wins(found: DataFrame, key: str = "session_id") -> DataFrame:
    """One row a session, from the first root that has it; the latest file of that root."""
    order = Window.partitionBy(key).orderBy("root_rank", F.desc("mtime"), "path")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest(found: DataFrame, k: int = 1) -> DataFrame:
    return found.orderBy(F.desc("mtime"), "session_id").limit(k)


def rollout_sessions(lines: DataFrame) -> DataFrame:
    """(path, session_id, meta) of rollout files (path, line, raw); files that don't name their session in the first lines are left out."""
    meta = F.when((F.get_json_object("raw", "$.type") == "session_meta") & (F.col("line") <= HEAD_LINES), F.get_json_object("raw", "$.payload"))
    rows = lines.where(F.col("line") <= HEAD_LINES).withColumn("_meta", meta)
    named = rows.groupBy("path").agg(F.min_by("_meta", F.when(F.col("_meta").isNotNull(), F.col("line"))).alias("meta")).where("meta is not null")
    return named.select("path", F.get_json_object("meta", "$.id").alias("session_id"), "meta")


def threads(spark: SparkSession, database: str) -> DataFrame:
    """The threads table of a SQLite file, latest first; read by tasks, in ranges of rows."""
    register(spark)
    return spark.read.format("sqlite").options(path=database, table="threads").load().orderBy(F.desc("updated_at"))


def spawn_edges(edges: DataFrame, threads_: DataFrame, key: str = "thread_id") -> DataFrame:
    """Threads with their parents and children, sorted arrays, of edges (parent, child)."""
    of = lambda own, other, name: edges.groupBy(F.col(own).alias(key)).agg(F.array_sort(F.collect_set(other)).alias(name))
    empty = F.array().cast("array<string>")
    df = threads_.select(key).distinct().join(of("child", "parent", "parents"), key, "left").join(of("parent", "child", "children"), key, "left")
    return df.select(key, F.coalesce(F.col("parents").cast("array<string>"), empty).alias("parents"), F.coalesce(F.col("children").cast("array<string>"), empty).alias("children"))


def raw_meta(thread: Column, imported: Column) -> Column:
    """The session's meta as JSON: the thread file's if there is one, else the import's; {} where that is no JSON."""
    chosen = F.coalesce(thread, imported)
    return F.when(F.try_parse_json(chosen).isNotNull(), chosen).otherwise("{}")


def price_rates(entries: DataFrame) -> DataFrame:
    """(key, tier, input, output, cache_read, cache_create): dollars a million tokens, of (key, entry) with dollars a token as JSON.

    Prices of cached tokens fall back to the input's; what is no number is 0.
    """
    per = lambda *names: F.coalesce(F.coalesce(*[F.get_json_object("entry", f"$.{n}") for n in names]).try_cast("double"), F.lit(0.0)) * 1_000_000
    return entries.where("key <> '_meta'").select(
        "key", F.lit(0).alias("tier"), per("input_cost_per_token").alias("input"), per("output_cost_per_token").alias("output"),
        per("cache_read_input_token_cost", "input_cost_per_token").alias("cache_read"), per("cache_creation_input_token_cost", "input_cost_per_token").alias("cache_create"),
    )


def pricing_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rates of a snapshot file, one JSON object of models; a file that is no JSON gives none."""
    text = spark.read.text(path, wholetext=True)
    return price_rates(text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "entry")))


def signal_artifacts(spark: SparkSession, folder: str, prefix: str | None = None) -> DataFrame:
    """Readings that were written as JSON lines; only those of signals with a prefix on demand, which the scan filters."""
    rows = spark.read.json(folder)
    return rows.where(F.col("signal").startswith(prefix)) if prefix else rows


def retention(found: DataFrame, now: Column, limit: float = 25.0) -> DataFrame:
    """One row: the age in days of the oldest transcript, and whether it is about to be removed."""
    age = (F.unix_micros(now) - F.unix_micros(F.min("mtime").cast("timestamp"))) / 86_400_000_000
    return found.agg(age.alias("age_days"), F.coalesce(age >= limit, F.lit(False)).alias("warn"))
