"""Which version of a key counts: the reads that everything else is made of.

All take and return DataFrames with the change-log's columns, keys of one column or several.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE

KEY = ("cf_id", "user_key")


def as_of(log: DataFrame, snapshot: int | Column | None) -> DataFrame:
    """Versions that a snapshot can see."""
    return log if snapshot is None else log.filter(F.col("seq") <= snapshot)


def newest(log: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The newest version of each key, tombstones too.

    row_number() = 1 has a partial limit on either side of the shuffle, so a key with many versions sends one row a task.
    """
    order = Window.partitionBy(*key).orderBy(F.col("seq").desc())
    return log.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def latest_wins(log: DataFrame, *, snapshot: int | Column | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Live keys with their newest value. Tombstones are dropped after the newest version is chosen, never before."""
    return newest(as_of(log, snapshot), key).filter(F.col("op") != DELETE)


def history(log: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Every version with its rank from the newest (1), the seq it replaced and the seq that replaced it."""
    order = Window.partitionBy(*key).orderBy(F.col("seq").desc())
    return log.withColumns(
        {"version": F.row_number().over(order).cast("long"), "replaced_by": F.lag("seq").over(order), "replaces": F.lead("seq").over(order)}
    )


def tombstones(log: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys whose newest version is a deletion."""
    return newest(log, key).filter(F.col("op") == DELETE)


#: Probe keys, and bytes of them, that may be broadcast once counted.
BROADCAST_KEYS, BROADCAST_BYTES = 1_000_000, 64 << 20


def of_keys(log: DataFrame, probes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Versions of the probes' keys. Few keys go to the log, which then isn't shuffled as a whole; they are counted while the plan is made."""
    want = probes.select(*key)
    size = sum((F.octet_length(F.col(k).cast("binary" if t == "binary" else "string")) + 16 for k, t in want.dtypes), F.lit(0)).cast("long")
    n, total = want.limit(BROADCAST_KEYS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return log.join(F.broadcast(want) if n <= BROADCAST_KEYS and total <= BROADCAST_BYTES else want.distinct(), list(key), "left_semi")


def lookup(log: DataFrame, probes: DataFrame, *, snapshot: int | Column | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """probes with state (found, deleted, miss), seq and value of each key."""
    seen = newest(as_of(of_keys(log, probes, key), snapshot), key)
    state = F.when(F.col("op").isNull(), "miss").when(F.col("op") == DELETE, "deleted").otherwise("found")
    return probes.join(seen, list(key), "left").select(*probes.columns, state.alias("state"), "seq", F.when(F.col("op") != DELETE, F.col("value")).alias("value"))


def multi_get(log: DataFrame, probes: DataFrame, *, snapshot: int | Column | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Live keys among probes, with seq and value."""
    return latest_wins(of_keys(log, probes, key), snapshot=snapshot, key=key).select(*key, "seq", "value")


def existing(log: DataFrame, probes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Probes whose key is live."""
    return probes.join(latest_wins(of_keys(log, probes, key), key=key), list(key), "left_semi")


def missing(log: DataFrame, probes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Probes whose key is not live: never written, or deleted."""
    return probes.join(latest_wins(of_keys(log, probes, key), key=key), list(key), "left_anti")
