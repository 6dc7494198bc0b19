"""Streams: append-only logs, session expiry and facts by conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a log, each record once, until what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sessions(stream: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of sessions that end after a gap without a record."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_facts(stream: DataFrame, schema: str = "session_id string, key string, value string, turn long", minutes: int | None = None) -> DataFrame:
    """Changes of facts (session_id, key, value, turn): a value is given out when its turn is later than the one held.

    State is one value per session and key. With `minutes` it leaves after so long without a record; such a query never
    ends by itself, so runs over what is there (`availableNow`) give none.
    """

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (None, -1)
        best = held
        for b in batches:
            b = b[b["turn"].notna()]  # a fact without a turn has no place in the order
            if b.empty:
                continue
            row = b.loc[b["turn"].idxmax()]
            if row["turn"] > best[1]:
                best = (row["value"], int(row["turn"]))
        if minutes:
            state.setTimeoutDuration(minutes * 60_000)
        if best != held:
            state.update(best)
            yield pd.DataFrame({"session_id": [group[0]], "key": [group[1]], "value": [best[0]], "turn": [best[1]]})

    return stream.groupBy("session_id", "key").applyInPandasWithState(update, schema, "value string, turn long", "append", GroupStateTimeout.ProcessingTimeTimeout if minutes else GroupStateTimeout.NoTimeout)
