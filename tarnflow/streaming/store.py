"""The session store as a stream: upserts, turns, clears and eviction in one operator with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tarnflow.functions.text import clean_content

#: What a stream of operations has, and what the store gives out.
OPERATION = "session_id string, op string, seq long, ts timestamp, role string, content string, key string"
CHANGE = "session_id string, created_at timestamp, last_updated timestamp, session_type string, n_turns long, n_data long, status string, version long"
#: Operations. The second clear leaves the time of the last update as it is, so the session expires when it would have.
UPSERT, TURN, DATA, CLEAR_HISTORY, CLEAR_DIALOG_HISTORY = "upsert", "turn", "data", "clear_history", "clear_dialog_history"
LIVE, EVICTED = "live", "evicted"


class _Session:
    """A session while its operations are gone through: the state's value, and what is to be written of turns and data."""

    def __init__(self, created: int, updated: int, kind: str | None, turns: int, version: int, n_data: int = 0, stored: bool = False) -> None:
        self.created, self.updated, self.kind, self.turns, self.version, self.n_data = created, updated, kind, turns, version, n_data
        self.changed: dict[str, str] = {}
        self.new_turns: list[tuple] = []
        #: Whether the state holds turns and data of this session that stay.
        self.keeps_turns = self.keeps_data = stored


class Sessions(StatefulProcessor):
    """State of a session: a value (when it was created and updated, its type), a list of turns, a map of data, and a timer that
    evicts it.

    Operations of a batch go in the order of time and seq. One that comes later than the timeout after the last update finds the
    session evicted, whether the timer had fired or not, so results don't depend on how the stream is cut into batches.
    Turns, data and clears of a session that isn't there are dropped. State is read before a batch and written after it; of the data
    only keys are looked up that a batch has, as their number stands in the value. A call to the state takes a round trip.
    """

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "created long, updated long, kind string, turns long, version long, n_data long")
        self.turns = handle.getListState("turns", "role string, content string, at long")
        self.data = handle.getMapState("data", "key string", "value string")

    def _load(self) -> _Session | None:
        held = self.head.get()
        return _Session(*held, stored=True) if held is not None else None

    def _put(self, held: _Session, key: str, value: str) -> None:
        """Note data to be written; whether the session has the key already is looked up once a batch."""
        if key not in held.changed and not (held.keeps_data and held.n_data and self.data.containsKey((key,))):
            held.n_data += 1
        held.changed[key] = value

    def _save(self, before: bool, held: _Session | None) -> None:
        """Write what changed; before: whether the state holds a session."""
        if held is None:
            for state in (self.head, self.turns, self.data) if before else ():
                state.clear()
            return
        self.head.update((held.created, held.updated, held.kind, held.turns, held.version, held.n_data))
        if before and not held.keeps_turns:
            self.turns.clear()
        if held.new_turns:
            self.turns.appendList(held.new_turns)
        if before and not held.keeps_data:
            self.data.clear()
        for k, v in held.changed.items():
            self.data.updateValue((k,), (v,))

    def _change(self, key: tuple, held: _Session, status: str) -> tuple:
        held.version += 1
        return key[0], held.created, held.updated, held.kind, held.turns, held.n_data, status, held.version

    def _frame(self, changes: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(changes, columns=[c.split()[0] for c in CHANGE.split(", ")])
        for c in ("created_at", "last_updated"):
            out[c] = pd.to_datetime(out[c], unit="us")
        return out

    def _expires(self, held: _Session) -> int:
        """The first millisecond at which the session has been idle for longer than the timeout."""
        return held.updated // 1000 + self.timeout_ms + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        held, out = self._load(), []
        before = held is not None
        for op, ts, role, content, name in zip(batch["op"], batch["ts"], batch["role"], batch["content"], batch["key"]):
            at = ts.value // 1000
            if held and at // 1000 >= self._expires(held):
                out.append(self._change(key, held, EVICTED))
                held = None
            if op == UPSERT:
                held = held or _Session(at, at, None, 0, 0)
                held.updated, held.kind = at, content
            elif held and op == TURN:
                held.new_turns.append((role, content, at))
                held.updated, held.turns = at, held.turns + 1
            elif held and op == DATA:
                self._put(held, name, content)
                held.updated = at
            elif held and op in (CLEAR_HISTORY, CLEAR_DIALOG_HISTORY):
                held.new_turns, held.keeps_turns, held.turns = [], False, 0
                held.updated = at if op == CLEAR_HISTORY else held.updated
        if held:
            self.handle.registerTimer(self._expires(held))
            out.append(self._change(key, held, LIVE))
        self._save(before, held)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._load()
        if held and expiredTimerInfo.getExpiryTimeInMs() >= self._expires(held):
            self._save(True, None)
            yield self._frame([self._change(key, held, EVICTED)])

    def close(self) -> None:
        pass


def changes(operations: DataFrame, timeout: int, late: str = "0 seconds") -> DataFrame:
    """Changes of sessions by a stream of OPERATION rows: a session that a batch touched as it stands after it, and those that
    were evicted `timeout` seconds after their last update, by the time of the stream."""
    store = Sessions(timeout * 1000)
    cleaned = F.when(F.col("op") == TURN, clean_content(F.col("content"))).otherwise(F.col("content"))
    return operations.withColumn("content", cleaned).where("session_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(statefulProcessor=store, outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")


def run(operations: DataFrame, path: str, checkpoint: str, timeout: int, late: str = "0 seconds") -> StreamingQuery:
    """Write changes to a log until what is there has been read. State is kept with the checkpoint, in RocksDB."""
    conf, key = operations.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return changes(operations, timeout, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:  # a query takes its settings with it as it starts
        conf.set(key, before) if before else conf.unset(key)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """The sessions of a log of changes, each as it stands last; one that was evicted and created again is two."""
    log = spark.read.schema(CHANGE).parquet(path)
    columns = [c.split()[0] for c in CHANGE.split(", ")]
    latest = F.max_by(F.struct(*columns), "version")
    return log.groupBy("session_id", "created_at").agg(latest.alias("s")).select("s.*")
