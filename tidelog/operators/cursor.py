"""Ordered reads over resolved rows (one per live key): seeks, ranges, neighbours.

Keys compare bytewise, which is Spark's order of binary and of string columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

K = "user_key"


def scan(rows: DataFrame, *, reverse: bool = False) -> DataFrame:
    """All rows in key order; a range-partitioned sort."""
    return rows.orderBy(F.col(K).desc() if reverse else F.col(K))


def first(rows: DataFrame, n: int = 1) -> DataFrame:
    return rows.orderBy(K).limit(n)


def last(rows: DataFrame, n: int = 1) -> DataFrame:
    return rows.orderBy(F.col(K).desc()).limit(n)


def seek(rows: DataFrame, target: Column | str | bytes, n: int = 1) -> DataFrame:
    """The first n rows with a key at or after target: each task keeps n rows."""
    return first(rows.filter(F.col(K) >= _value(target)), n)


def seek_for_prev(rows: DataFrame, target: Column | str | bytes, n: int = 1) -> DataFrame:
    """The last n rows with a key at or before target, nearest first."""
    return last(rows.filter(F.col(K) <= _value(target)), n)


def key_range(rows: DataFrame, start: Column | str | bytes | None = None, end: Column | str | bytes | None = None) -> DataFrame:
    """start <= key < end; the bounds reach the Parquet scan."""
    if start is not None:
        rows = rows.filter(F.col(K) >= _value(start))
    return rows if end is None else rows.filter(F.col(K) < _value(end))


def prefix(rows: DataFrame, start: str | bytes) -> DataFrame:
    """Keys that begin with start, as a range so that statistics prune, and the test itself."""
    rows = rows.filter(F.col(K) >= _value(start)).filter(F.col(K).startswith(_value(start)))
    raw = start if isinstance(start, bytes) else start.encode()
    end = raw.rstrip(b"\xff")
    if isinstance(start, bytes) and end:
        rows = rows.filter(F.col(K) < _value(end[:-1] + bytes([end[-1] + 1])))
    return rows


def neighbours(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """rows with next_key and prev_key.

    Keys are dealt to fixed ranges; within a range lead and lag give the neighbours. Across a boundary they are the first and
    last key of the ranges next to it, of which there is one row a range.
    """
    ranged = rows.withColumn("_range", ranges.number(F.col(K), ranges.splitters(rows, K, partitions)))
    inside = Window.partitionBy("_range").orderBy(K)
    near = ranged.withColumns({"next_key": F.lead(K).over(inside), "prev_key": F.lag(K).over(inside)})
    ends = ranged.groupBy("_range").agg(F.min(K).alias("_lo"), F.max(K).alias("_hi"))
    order = Window.orderBy("_range")
    ends = ends.select("_range", F.lead("_lo").over(order).alias("_next"), F.lag("_hi").over(order).alias("_prev"))
    out = near.join(F.broadcast(ends), "_range")
    return out.withColumns({"next_key": F.coalesce("next_key", "_next"), "prev_key": F.coalesce("prev_key", "_prev")}).drop("_range", "_next", "_prev")


def batch_seek_for_prev(rows: DataFrame, probes: DataFrame, probe: str = "probe") -> DataFrame:
    """For each probe the greatest key at or before it (null if there is none): one sort of both sides, no pairs.

    Probes, each once, and keys are dealt to fixed ranges together; the greatest key before a range comes from one row a range.
    """
    once = probes.groupBy(F.col(probe).alias("_at")).agg(F.count("*").alias("_times"))
    none = F.lit(None).cast(rows.schema[K].dataType)
    both = rows.select(F.col(K).alias("_at"), F.lit(0).cast("long").alias("_times"), F.col(K).alias("_key")).unionByName(once.withColumn("_key", none))
    ranged = both.withColumn("_range", ranges.number(F.col("_at"), ranges.splitters(both, "_at")))
    upto = Window.partitionBy("_range").orderBy("_at", "_times").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("_found", F.last("_key", ignorenulls=True).over(upto))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("_range").agg(F.max("_key").alias("_hi")).select("_range", F.max("_hi").over(before).alias("_prev"))
    out = found.filter("_times > 0").join(F.broadcast(ends), "_range").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return out.select(F.col("_at").alias(probe), F.when(F.col("_at").isNotNull(), F.coalesce("_found", "_prev")).alias(K))


def _value(x: Column | str | bytes) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
