"""Streams with state: steps of sessions, calls and their results, utility of memories.

Events may come late and more than once.  A key's events wait until the
watermark has passed them, and are then taken in their order, each once; so
what a stream gives in the end is what the batch operators give.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import predicates as P
from ..functions import text as X
from ..operators import trajectory
from ..operators.windows import SESSION
from ..sources.memory_store import MemoryStore

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = "ord long, ms long, row string"


def use_state(spark: SparkSession) -> None:
    """State with timers lies in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class InOrder(StatefulProcessor):
    """Takes a key's rows (ord, ts, ms, ...) in order, each once, when the watermark has passed them.

    ``carry`` is what a key remembers, as JSON; ``take`` gets it with the next
    row and gives the rows to put out; ``rest`` does so when no row came for
    ``idle`` milliseconds of event time.
    """

    idle: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.kept = handle.getValueState("kept", "last long, ms long, carry string")

    def start(self) -> Any:
        return {}

    def take(self, key: tuple, carry: Any, row: dict) -> list[dict]:
        raise NotImplementedError

    def rest(self, key: tuple, carry: Any) -> list[dict]:
        return []

    def _frame(self, key: tuple, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([dict(zip(SESSION, key)) | r for r in rows]).astype(object)

    def _run(self, key: tuple, watermark: int, new: list[tuple[int, int, str]]) -> list[dict]:
        rows = [*self.waiting.get(), *new] if self.waiting.exists() else new
        last, ms, text = self.kept.get() if self.kept.exists() else (None, None, None)
        carry = json.loads(text) if text else self.start()
        out, left, seen = [], [], set()
        for ord_, at, row in sorted(rows, key=lambda r: (r[1], r[0])):
            if (last is not None and ord_ <= last) or ord_ in seen:
                continue  # it came before
            if at > watermark:
                left.append((ord_, at, row))
                seen.add(ord_)
                continue
            out += self.take(key, carry, json.loads(row))
            last, ms = ord_, at
        if self.idle is not None and ms is not None and not left and ms + self.idle <= watermark:
            out += self.rest(key, carry)
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(max(at for _, at, _ in left))
        else:
            self.waiting.clear()
        if last is not None:
            self.kept.update((last, ms, json.dumps(carry)))
            if self.idle is not None and ms + self.idle > watermark:
                self.handle.registerTimer(ms + self.idle)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            at = frame["ms"]
            records = frame.drop(columns=["ts", "ms", *SESSION]).astype(object).where(frame.notna(), None).to_dict("records")
            new += [(int(r["ord"]), int(ms), json.dumps(r, default=str)) for ms, r in zip(at, records)]
        yield from self._frame(key, self._run(key, timerValues.getCurrentWatermarkInMs(), new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frame(key, self._run(key, timerValues.getCurrentWatermarkInMs(), []))

    def close(self) -> None:
        pass


class Steps(InOrder):
    """Puts out the events of a step when it closes: an action, its results, and up to three thoughts before it."""

    def __init__(self, idle: int):
        self.idle = idle

    def start(self) -> dict:
        return {"n": 0, "open": [], "thoughts": []}

    def _closed(self, carry: dict) -> list[dict]:
        out, carry["open"] = [r | {"step": carry["n"]} for r in carry["open"]], []
        return out

    def take(self, key: tuple, carry: dict, row: dict) -> list[dict]:
        role = row["role"]
        if role == "R":
            if carry["open"]:
                carry["open"].append(row)
            return []
        out = self._closed(carry)
        if role == "T":
            carry["thoughts"] = [*carry["thoughts"], row][-3:]
        else:
            carry["n"] += 1
            carry["open"], carry["thoughts"] = [*carry["thoughts"], row], []
        return out

    def rest(self, key: tuple, carry: dict) -> list[dict]:
        return self._closed(carry)


_ROLED = "host string, session_id string, ord long, event_id string, actor string, event_type string, summary string, payload string, said string, role string, step long"


def closed_steps(events: DataFrame, late: str = "1 hour", idle_seconds: int = 1800) -> DataFrame:
    """The events of steps that have closed, each step's in one micro-batch, of a stream of events with ``ts``.

    ``ts`` rises with ``ord`` in a session.  A step closes with the next action
    or thought, or when its session is idle; results that come after that are
    left out.  Rows without ts, host, session or ord are left out, too.
    """
    use_state(events.sparkSession)
    actor, kind = F.col("actor"), F.col("event_type")
    role = F.when(P.is_action(actor, kind), "A").when(P.is_thought(actor, kind), "T").when(P.is_result(actor, kind), "R")
    rows = P.with_doc(events.where("ts is not null and host is not null and session_id is not null and ord is not null"))
    rows = rows.select(*SESSION, "ord", "ts", F.unix_millis("ts").alias("ms"), "event_id", "actor", "event_type", "summary", "payload", X.event_text(P.payload(), F.col("summary")).alias("said"), role.alias("role"))
    rows = rows.where("role is not null").withWatermark("ts", late)
    return rows.groupBy(*SESSION).transformWithStateInPandas(statefulProcessor=Steps(idle_seconds * 1000), outputStructType=_ROLED, outputMode="append", timeMode="eventTime")


def write_steps(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour", idle_seconds: int = 1800):
    """A query that adds the steps of a stream of events to Parquet, a folder a micro-batch, so that one that is tried again replaces its own."""

    def write(rows: DataFrame, batch: int) -> None:
        named = rows.withColumnsRenamed({"said": "_text", "role": "_role", "step": "_step"})
        trajectory.gathered(named).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return closed_steps(events, late, idle_seconds).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


class Calls(InOrder):
    """Puts out each result with the latest call before it under the same id; and calls that no result came for."""

    def __init__(self, idle: int):
        self.idle = idle

    def start(self) -> dict:
        return {"calls": {}, "open": {}}

    def take(self, key: tuple, carry: dict, row: dict) -> list[dict]:
        call = row["call_id"]
        if row["is_call"]:
            carry["calls"][call] = carry["open"][call] = row["event_id"]
            return []
        carry["open"].pop(call, None)
        return [{"event_id": row["event_id"], "call_id": call, "call_event_id": carry["calls"].get(call)}]

    def rest(self, key: tuple, carry: dict) -> list[dict]:
        out = [{"event_id": None, "call_id": c, "call_event_id": e} for c, e in carry["open"].items()]
        carry["open"] = {}
        return out


def results_with_calls(events: DataFrame, late: str = "1 hour", idle_seconds: int = 1800) -> DataFrame:
    """(host, session_id, event_id, call_id, call_event_id) of a stream of calls and results (ord, ts, event_id, call_id, is_call).

    A result comes with the latest earlier call of its id, or none; a call that
    has no result when its session is idle comes without event_id.
    """
    use_state(events.sparkSession)
    rows = events.where("ts is not null and host is not null and session_id is not null and ord is not null and call_id is not null")
    rows = rows.select(*SESSION, "ord", "ts", F.unix_millis("ts").alias("ms"), "event_id", "call_id", "is_call").withWatermark("ts", late)
    schema = "host string, session_id string, event_id string, call_id string, call_event_id string"
    return rows.groupBy(*SESSION).transformWithStateInPandas(statefulProcessor=Calls(idle_seconds * 1000), outputStructType=schema, outputMode="append", timeMode="eventTime")


def write_utility(rewards: DataFrame, store: MemoryStore, checkpoint: str, name: str = "rewards", deduplicate: str | None = "1 day"):
    """A query that upserts the utility of memories from a stream of events (as the store's, and ``ts`` where repeats are to be told).

    Events of a memory are told apart by ``line``; one that comes again within
    ``deduplicate`` counts once.  A micro-batch that is tried again is known
    by its key.
    """
    if deduplicate:
        rewards = rewards.withWatermark("ts", deduplicate).dropDuplicatesWithinWatermark(["memory_id", "line"])
    take: Callable[[DataFrame, int], None] = lambda rows, batch: store.append(events=rows, key=f"{name}-{batch}")
    return rewards.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).outputMode("append")
