"""The version state as queries over logs of edits: live files, live column families, properties, level statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import N_LEVELS


def live_files(edits: DataFrame, *, version: int | None = None) -> DataFrame:
    """Files added and not removed, as of a version: of each file the newest edit counts."""
    if version is not None:
        edits = edits.filter(F.col("version") <= version)
    order = Window.partitionBy("cf_id", "run_id").orderBy(F.col("version").desc(), F.col("action"))
    return edits.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1 AND action = 'add'").drop("_rn", "action")


def live_families(events: DataFrame) -> DataFrame:
    """Column families created and not dropped: cf_id, name."""
    order = Window.partitionBy("cf_id").orderBy(F.col("event_seq").desc())
    return events.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1 AND event = 'create'").select("cf_id", "name")


def of_live_families(log: DataFrame, families: DataFrame) -> DataFrame:
    """Log rows whose column family is there: what recovery replays."""
    return log.join(F.broadcast(families.select("cf_id")), "cf_id", "left_semi")


def last_sequences(log: DataFrame) -> DataFrame:
    """Per column family the greatest seq, from which numbering goes on."""
    return log.groupBy("cf_id").agg(F.max("seq").alias("last_seq"), F.count("*").alias("n_rows"))


def level_stats(files: DataFrame) -> DataFrame:
    """A row for each of the levels: n_files, bytes, n_rows."""
    levels = files.sparkSession.range(N_LEVELS).select(F.col("id").cast("int").alias("level"))
    found = files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("n_rows"))
    return levels.join(found, "level", "left").na.fill(0, ["n_files", "bytes", "n_rows"])


def properties(files: DataFrame) -> DataFrame:
    """Rows (property, value): num-files-at-levelN, total-size, num-entries."""
    stats = level_stats(files)
    per_level = stats.select(F.concat(F.lit("num-files-at-level"), F.col("level").cast("string")).alias("property"), F.col("n_files").cast("string").alias("value"))
    whole = stats.agg(F.sum("bytes").alias("b"), F.sum("n_rows").alias("n"))
    rows = F.array(F.struct(F.lit("total-size").alias("property"), F.col("b").cast("string").alias("value")), F.struct(F.lit("num-entries").alias("property"), F.col("n").cast("string").alias("value")))
    return per_level.unionByName(whole.select(F.inline(rows)))


def amplification(levels: DataFrame) -> DataFrame:
    """levels (level, bytes_read, bytes_written, compactions) with read_amp (0 if nothing was written) and write_amp."""
    read = F.when(F.col("bytes_written") == 0, F.lit(0.0)).otherwise(F.col("bytes_read").cast("double") / F.col("bytes_written"))
    return levels.withColumns({"read_amp": read, "write_amp": F.lit(1.0) + F.col("compactions").cast("double")})
