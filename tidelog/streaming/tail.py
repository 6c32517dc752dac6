"""A growing folder of change-log files as a stream: into a store, or as the newest version of each key.

seq decides what is newest, so files may come late and out of order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import compaction
from ..store import ColumnFamily, Store

#: user_key, seq, op, value; keys and values as text or bytes.
LOG = "user_key string, seq bigint, op int, value string"


def read_log(spark: SparkSession, path: str, schema: str = LOG, *, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def into_store(stream: DataFrame, store: Store, checkpoint: str, cf: ColumnFamily | None = None) -> StreamingQuery:
    """Each micro-batch's newest versions become a run, with the seqs that they came with, so a late one never hides a newer one.

    The commit of a batch names it, by the checkpoint; a batch that is repeated after a failure is skipped.
    """

    def append(rows: DataFrame, batch: int) -> None:
        newest = compaction.flush(rows, key=["user_key"]).select("user_key", "seq", "op", "value")
        store.write_versions(newest, cf, stream=checkpoint, batch=batch)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stream: DataFrame) -> DataFrame:
    """The newest version of each key so far, as updates: an aggregation whose state is one row a key."""
    newest = F.max(F.struct("seq", "op", "value"))
    return stream.groupBy("user_key").agg(newest.alias("v")).select("user_key", "v.seq", "v.op", "v.value")


_STATE = "seq bigint, op int, value string"


def latest_with_ttl(stream: DataFrame, ttl_ms: int) -> DataFrame:
    """As latest(), only rows that change something; a deleted key's state goes after ttl_ms without news.

    Time-outs keep such a query at work, so it takes a trigger by time; availableNow would not end.
    A version older than a deletion that has been forgotten would count as new; ttl_ms is to be longer than files are late.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else (-1, None, None)
        best = old
        for pdf in batches:
            row = pdf.loc[pdf["seq"].idxmax()]
            if row["seq"] > best[0]:
                value = row["value"]
                best = (int(row["seq"]), int(row["op"]), None if pd.isna(value) else value)
        if best is not old:
            state.update(best)
            yield pd.DataFrame([[key[0], *best]], columns=["user_key", "seq", "op", "value"])
        if best[1] == 0:
            state.setTimeoutDuration(ttl_ms)

    return stream.groupBy("user_key").applyInPandasWithState(step, f"user_key string, {_STATE}", _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(stream: DataFrame, time: str = "ts", *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Operations per window and kind; a window is final once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "op").agg(F.count("*").alias("n")).select("window.start", "window.end", "op", "n")
