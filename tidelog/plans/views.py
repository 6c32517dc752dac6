"""Driver tables as change-logs and run files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changelog(spark: SparkSession, sf_dir: str, families: int = 1) -> DataFrame:
    """events as a change-log: a key a user, errors delete, purchases are merges, all else puts; runs of 1000 events."""
    events = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return events.select(
        (F.col("user_id") % families).cast("int").alias("cf_id"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("user_key"),
        (F.col("event_id") + 1).alias("seq"),
        op.cast("int").alias("op"),
        F.when(op != 0, F.round(F.col("value") * 100).cast("bigint").cast("string")).alias("value"),
        F.expr("event_id div 1000").alias("run_id"),
    )


#: The same in SQL, for one column family and for three.
CHANGELOG_SQL = """
SELECT CAST({cf} AS INTEGER) AS cf_id, concat('u', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS user_key, event_id + 1 AS seq,
       CAST(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 2 ELSE 1 END AS INTEGER) AS op,
       CASE WHEN event_type <> 'error' THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS value,
       event_id // 1000 AS run_id
FROM events"""


def orders_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as live rows of a wide, unique key space."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("user_key"), F.col("o_orderstatus").alias("value"))


ORDERS_SQL = "SELECT concat('o', lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS user_key, o_orderstatus AS value FROM orders"


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change-log's runs as files of levels 0 to 3 in turn, with their ranges and sizes."""
    from ..operators import compaction

    meta = compaction.run_metadata(changelog(spark, sf_dir))
    return meta.select("run_id", (F.col("run_id") % 4).cast("int").alias("level"), F.lit(0).alias("cf_id"), "bytes", F.col("n_rows").alias("rows"), "tombstones", "smallest", "largest", "max_seq")


FILES_SQL = """
SELECT run_id, CAST(run_id % 4 AS INTEGER) AS level, 0 AS cf_id,
       CAST(sum(strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes, count(*) AS rows,
       CAST(sum(CASE WHEN op = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tombstones, min(user_key) AS smallest, max(user_key) AS largest, max(seq) AS max_seq
FROM cl GROUP BY run_id"""
