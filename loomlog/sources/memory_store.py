"""Memories as tables that grow by appends: each append touches the shards of its own memories.

The log of records and events is the truth, and is written first.  From it
come, by the shard of a memory's id, ``memory`` (its row and links), ``utility``
(sums of its rewards) and ``postings`` (the positional index), of which an
append overwrites the touched shards, and ``content`` (the memory that has a
content first) and ``evidence``, to which it adds.  An append that ends before
``applied`` names its batch leaves the log whole, as far as ``taken`` names
its batches; the next one, or ``rebuild``, makes the tables from it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.memory import clamped
from ..operators.search import postings, shard_of, write_index
from .folders import durable, exists, remove

#: Shards of the tables by memory.
SHARDS = 16
#: Ids that are broadcast to the rows of their shards; more are joined by shuffle.
MAX_IDS = 200_000
RATE = 0.2
TABLES = ("memory", "utility", "postings", "content", "evidence")
RECORD = """id string, ord long, kind string, scope string, status string, text string, when_to_use string, origin_repo string, confidence double, priority int, risk string,
q_value double, quality_avg double, created_at long, evidence array<string>"""
EVENT = "memory_id string, line long, event string, session_id string, reward double, reason string, created_at long"
_KEPT = ("kind", "scope", "status", "text", "when_to_use", "origin_repo", "confidence", "priority", "risk", "q_value", "quality_avg", "content_hash", "batch", "ord")
_MEMORY = "id string, kind string, scope string, status string, text string, when_to_use string, origin_repo string, confidence double, priority int, risk string, q_value double, quality_avg double, content_hash string, batch int, ord long, created_at long, evidence_count long, links array<string>, shard int"
_UTILITY = "memory_id string, gain double, hits long, successes long, last_used_at long, shard int"
_CONTENT = "content_hash string, id string"
_EVIDENCE = "memory_id string, ref string"


class MemoryStore:
    """A store in ``folder``; one writer at a time, any number of readers of what is applied."""

    def __init__(self, spark: SparkSession, folder: str, shards: int = SHARDS):
        self.spark, self.folder, self.shards = spark, folder, shards

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _applied(self) -> int:
        """The last batch that all tables have; -1 before the first."""
        return self._read("applied", "batch int").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def _taken(self) -> DataFrame:
        """The batches that the log has whole, and the keys they came with."""
        return self._read("taken", "batch int, key string")

    def _logged(self) -> int:
        return self._taken().agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def append(self, records: DataFrame | None = None, events: DataFrame | None = None, key: str | None = None) -> None:
        """Take in records (as RECORD, in the order of ord) and events (as EVENT, in the order of line), one batch behind those before.

        Records go to the memory that had their content first; the last record
        of a memory holds, its first created_at stays, its evidence is gathered.
        A record without an id or text, and an event without a memory, are left out.
        A batch whose ``key`` was taken before is not taken again, so a caller
        may try again with the same key.
        """
        if self._logged() > self._applied():
            self.rebuild()
        if key is not None and not self._taken().where(F.col("key") == key).isEmpty():
            return
        batch = self._logged() + 1
        records = _fitted(records, RECORD, self.spark).where("id is not null and text is not null")
        events = _fitted(events, EVENT, self.spark).where("memory_id is not null")
        records.write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")
        events.write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch}")
        self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(key).cast("string").alias("key")).write.mode("append").parquet(f"{self.folder}/taken")
        self._apply(batch, batch)

    def rebuild(self) -> None:
        """All tables from the whole log, as if it were one batch."""
        for name in (*TABLES, "applied"):
            remove(self.spark, f"{self.folder}/{name}")
        last = self._logged()
        if last >= 0:
            self._apply(0, last)

    def _apply(self, first: int, last: int) -> None:
        inside = F.col("batch").between(first, last)
        records = self._read("log", f"{RECORD}, batch int").where(inside)
        events = self._read("events", f"{EVENT}, batch int").where(inside)
        changed = self._memories(records)
        self._utility(events)
        self._postings(changed)
        self.spark.range(1).select(F.lit(last).alias("batch")).write.mode("append").parquet(f"{self.folder}/applied")

    def _placed(self, records: DataFrame) -> DataFrame:
        """Records with the id of the memory that has their content; contents that are new are noted."""
        hashed = records.withColumn("content_hash", X.content_hash(F.col("text"), F.col("scope"), F.col("kind"), F.col("origin_repo")))
        known = self._read("content", _CONTENT)
        own = hashed.groupBy("content_hash").agg(F.min_by("id", F.struct("batch", "ord", "id")).alias("id"))
        new = durable(own.join(known, "content_hash", "left_anti"))
        owners = durable(own.select("content_hash").join(known, "content_hash").unionByName(new).withColumnRenamed("id", "_own"))
        new.write.mode("append").parquet(f"{self.folder}/content")
        return hashed.join(self._some(owners), "content_hash").withColumn("id", F.col("_own")).drop("_own")

    def _some(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(MAX_IDS + 1).count() <= MAX_IDS else df

    def _touched(self, name: str, schema: str, ids: DataFrame, key: str) -> DataFrame:
        """The rows of a table in the shards that the ids are in; other shards are not read."""
        shards = [r[0] for r in ids.select(shard_of(F.col(key), self.shards)).distinct().collect()]
        return self._read(name, schema).where(F.col("shard").isin(shards))

    def _overwrite(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{self.folder}/{name}")

    def _memories(self, records: DataFrame) -> DataFrame:
        """Write the touched shards of ``memory`` and the new evidence; the ids of this batch."""
        placed = durable(self._placed(records))
        shard = shard_of(F.col("id"), self.shards).alias("shard")
        links = X.wiki_links(F.concat_ws("\n", "text", "when_to_use")).alias("links")
        count = F.size(F.coalesce("evidence", F.array().cast("array<string>"))).cast("long").alias("evidence_count")
        new = placed.select("id", *_KEPT, "created_at", count, links, shard)
        ids = durable(placed.select("id").distinct())
        if ids.isEmpty():
            return ids
        old = self._touched("memory", _MEMORY, ids, "id").select(*new.columns)
        last = F.max_by(F.struct(*_KEPT, "links"), F.struct("batch", "ord")).alias("row")
        merged = old.unionByName(new).groupBy("shard", "id").agg(last, F.min("created_at").alias("created_at"), F.sum("evidence_count").alias("evidence_count"))
        self._overwrite("memory", merged.select("id", *[F.col("row")[c].alias(c) for c in _KEPT], "created_at", "evidence_count", F.col("row")["links"].alias("links"), "shard"))
        proof = placed.select(F.col("id").alias("memory_id"), F.explode("evidence").alias("ref")).where("ref is not null").distinct()
        durable(proof.join(self._read("evidence", _EVIDENCE), ["memory_id", "ref"], "left_anti")).write.mode("append").parquet(f"{self.folder}/evidence")
        return ids

    def _utility(self, events: DataFrame) -> None:
        """Write the touched shards of ``utility``: what is gained by a memory's rewards in their order, whether it is there yet or not.

        A reward moves the value by RATE times its distance, so the rewards of
        a batch weigh what is before by (1 - RATE) ** their number.
        """
        paid = events.where("event = 'memory_rewarded' and reward is not null")
        behind = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("batch"), F.desc("line"))) - 1
        gain = clamped(F.col("reward")) * F.pow(F.lit(1 - RATE), behind) * RATE
        sums = paid.withColumn("_g", gain).groupBy("memory_id").agg(F.sum("_g").alias("gain"), F.count("*").alias("hits"), F.count_if(F.col("reward") >= 0.5).alias("successes"), F.max_by("created_at", F.struct("batch", "line")).alias("last_used_at"))
        new = durable(sums.withColumn("shard", shard_of(F.col("memory_id"), self.shards)))
        if new.isEmpty():
            return
        old = self._touched("utility", _UTILITY, new, "memory_id").select([F.col(c).alias(f"_{c}" if c not in ("memory_id", "shard") else c) for c in new.columns])
        both = old.join(new, ["memory_id", "shard"], "full")
        was = lambda c, t: F.coalesce(f"_{c}", F.lit(0).cast(t))
        now = lambda c, t: F.coalesce(c, F.lit(0).cast(t))
        merged = both.select(
            "memory_id", (was("gain", "double") * F.pow(F.lit(1 - RATE), now("hits", "long")) + now("gain", "double")).alias("gain"),
            (was("hits", "long") + now("hits", "long")).alias("hits"), (was("successes", "long") + now("successes", "long")).alias("successes"), F.coalesce("last_used_at", "_last_used_at").alias("last_used_at"), "shard",
        )
        self._overwrite("utility", merged)

    def _postings(self, ids: DataFrame) -> None:
        """Write the touched shards of ``postings``: those of the ids anew, the others as they are."""
        if ids.isEmpty():
            return
        few = self._some(ids)
        fresh = postings(self._touched("memory", _MEMORY, ids, "id").join(few, "id", "left_semi"))
        old = self._touched("postings", "id string, term string, positions array<int>, length int, shard int", ids, "id").drop("shard")
        write_index(old.join(few, "id", "left_anti").unionByName(fresh), f"{self.folder}/postings", self.shards)

    def memory(self) -> DataFrame:
        """A row a memory, with the utility that its rewards have made of its own."""
        rows = self._read("memory", _MEMORY).drop("links", "batch", "ord")
        used = self._read("utility", _UTILITY).withColumnRenamed("memory_id", "id")
        hits = F.coalesce("hits", F.lit(0).cast("long"))
        good = F.coalesce("successes", F.lit(0).cast("long"))
        q = F.coalesce("q_value", F.lit(0.5)) * F.pow(F.lit(1 - RATE), hits) + F.coalesce("gain", F.lit(0.0))
        return rows.join(used, ["id", "shard"], "left").select(*[c for c in rows.columns if c not in ("q_value", "shard")], q.alias("q_value"), hits.alias("hits"), good.alias("successes"), (hits - good).alias("failures"), "last_used_at")

    def links(self) -> DataFrame:
        return self._read("memory", _MEMORY).select(F.col("id").alias("src"), F.explode("links").alias("dst"))

    def evidence(self) -> DataFrame:
        return self._read("evidence", _EVIDENCE)

    def events(self) -> DataFrame:
        """The events of all batches, in the order of batch and line."""
        return self._read("events", f"{EVENT}, batch int").where(F.col("batch") <= self._logged())

    def index(self) -> DataFrame:
        """The positional index, for operators.search."""
        return self._read("postings", "id string, term string, positions array<int>, length int, shard int").drop("shard")

    def counts(self) -> DataFrame:
        """(table, n): how many memories, links, references and events there are, and links to no memory."""
        links = self.links()
        lost = links.join(self.memory().select(F.col("id").alias("dst")), "dst", "left_anti")
        out = None
        for name, df in (("memory", self.memory()), ("link", links), ("evidence", self.evidence()), ("event", self.events()), ("dangling", lost)):
            n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
            out = n if out is None else out.unionByName(n)
        return out


def _fitted(rows: DataFrame | None, schema: str, spark: SparkSession) -> DataFrame:
    """The columns of the schema; those that are not there are null."""
    if rows is None:
        return spark.createDataFrame([], schema)
    names = [c.strip().split(" ", 1) for c in schema.replace("\n", " ").split(",")]
    has = lambda c, t: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)
    return rows.select(*[has(c, t).alias(c) for c, t in names])
