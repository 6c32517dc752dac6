"""Batches and transactions as queries. A batch's rows are (ordinal, cf_id, user_key, op, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import merge
from .resolve import KEY


def stamp(batch: DataFrame, base: int | Column) -> DataFrame:
    """The batch as change-log rows: seq = base + ordinal, ordinals from 1."""
    return batch.withColumn("seq", (F.lit(base) if isinstance(base, int) else base) + F.col("ordinal")).drop("ordinal")


def last_in_batch(batch: DataFrame) -> DataFrame:
    """Of each key the batch's last operation."""
    order = Window.partitionBy(*KEY).orderBy(F.col("ordinal").desc())
    return batch.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def data_size(batch: DataFrame) -> DataFrame:
    """One row: n_ops, bytes of keys and values."""
    return batch.agg(F.count("*").alias("n_ops"), F.coalesce(F.sum((F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")), F.lit(0)).alias("bytes"))


def applied(log: DataFrame, batch: DataFrame, operator: merge.MergeOperator | merge.ExpressionMerge | None = None, *, snapshot: int | Column | None = None) -> DataFrame:
    """What a transaction reads: its own operations over the versions of its snapshot, merges folded by the operator.

    Own operations are stamped beyond every seq of the log; own says that one of them decides or is folded in.
    """
    columns = ["cf_id", "user_key", "seq", "op", "value"]
    mine = stamp(batch, 1 << 62).select(*columns)
    rows = merge.fold((log if snapshot is None else log.filter(F.col("seq") <= snapshot)).select(*columns).unionByName(mine), operator)
    return rows.select("cf_id", "user_key", "value", (F.col("seq") > 1 << 62).alias("own"))


def conflicts(log: DataFrame, tracked: DataFrame, snapshot: int | Column) -> DataFrame:
    """Tracked keys that someone has written since the snapshot: cf_id, user_key, last_seq."""
    late = log.filter(F.col("seq") > snapshot).join(tracked.select(*KEY).distinct(), list(KEY), "left_semi")
    return late.groupBy(*KEY).agg(F.max("seq").alias("last_seq"))


def lock_conflicts(locks: DataFrame) -> DataFrame:
    """Each lock held (cf_id, user_key, txn_id, mode) with the number of other transactions that it can't be held together with.

    Only reads are compatible. Of one transaction's locks on a key the strongest counts, so an upgrade is one lock. A key's
    holders and writers are counted, never paired.
    """
    held = locks.groupBy(*KEY, "txn_id").agg(F.max((F.col("mode") == "WRITE").cast("long")).alias("_w"))
    keys = held.groupBy(*KEY).agg(F.count("*").alias("_holders"), F.sum("_w").alias("_writers"))
    others = F.when(F.col("_w") == 1, F.col("_holders") - 1).otherwise(F.col("_writers"))
    return held.join(keys, list(KEY)).select(*KEY, "txn_id", F.when(F.col("_w") == 1, "WRITE").otherwise("READ").alias("mode"), others.alias("conflicts"))
