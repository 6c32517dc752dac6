"""What several operators share: scratch tables, distributed prefix sums, joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their values, of a table that may be broadcast once they have been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: A key is hot if it holds at least one of so many parts of all rows; so at most this many keys are hot.
HOT_PARTS = 1000

#: Bytes of an Arrow batch, but for a single longer row.
BATCH_BYTES = 8 << 20

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder for written tables, inside spark.checkpoint.dir.

    The folder is removed when the application ends. Where the setting is absent (tests) a local folder is taken,
    which only local mode can use.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        _own[app] = f"{base.rstrip('/')}/tidelog-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(clear_scratch, spark, app)
    return _own[app]


def clear_scratch(spark: SparkSession, app: str | None = None) -> None:
    """Remove the written tables of this application; results that still read them end to work."""
    path = _own.pop(app or spark.sparkContext.applicationId, None)
    if path and spark.sparkContext._jsc is not None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM has already gone
            pass


def saved(df: DataFrame, *, partition_by: tuple[str, ...] = (), options: dict[str, str] | None = None) -> DataFrame:
    """df as a written table: it cuts the lineage, and a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.options(**({"compression": "zstd"} | (options or {})))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let a batch of rows for Python hold BATCH_BYTES, if the session allows more: texts may be long, and workers small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").rstrip("bB")
    if not now.isdigit() or int(now) <= 0 or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_total(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with, for each name in sums, the total of that column over all rows that come before in the given order.

    Range partitions are totalled one by one; only the totals, one row a partition, meet in one task.
    """
    parts = parallelism(df.sparkSession)
    ranged = saved(
        df.select("*", *(c.cast("long").alias(f"_v_{n}") for n, c in sums.items()))
        .repartitionByRange(parts, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "_part")  # as many rows as range partitions
    for n in sums:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)))
    return out.drop("_part", *(f"_{k}_{n}" for n in sums for k in "vo"))


def _bytes(kind: T.DataType, value: Column) -> Column:
    """About the bytes of a value; null has none."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(f.dataType, value[f.name]) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType)):
            return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(8).cast("long"), lambda a, x: a + _bytes(inner, x))
        return F.greatest(F.size(value), F.lit(0)).cast("long") * (8 * len(inner.fields) + 8 if isinstance(inner, T.StructType) else 8) + 8
    return F.lit(8).cast("long")


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows, and their bytes, keep the bounds; else Spark shuffles both sides."""
    size = sum((_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0).cast("long"))
    n, total = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def hot_join(rows: DataFrame, groups: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with one row a key in groups, where groups[count] says how many rows have that key.

    Keys that hold at least total / HOT_PARTS rows are at most HOT_PARTS by the pigeonhole principle; they are
    broadcast, so their rows stay where they are. All others are joined by a shuffle whose keys are small.
    """
    least = max(2, -(-total // HOT_PARTS))
    hot, cold = groups.filter(F.col(count) >= least), groups.filter(F.col(count) < least)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(cold, key)
    )


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
