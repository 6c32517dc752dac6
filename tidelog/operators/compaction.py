"""Runs, levels and their maintenance. A run's rows carry run_id (and level) beside the change-log's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE, N_LEVELS
from . import ranges
from .resolve import KEY, newest

L0_TRIGGER, L0_STOP = 4, 12
BASE_BYTES, MULTIPLIER = 10 << 20, 10
MIN_SUBCOMPACTION_BYTES, SUBCOMPACTIONS = 10 << 20, 4


def flush(log: DataFrame, key: Sequence[str] = KEY, by: Sequence[str] = ()) -> DataFrame:
    """What a memtable leaves: of each key (within by, such as run_id) its newest version; tombstones stay."""
    return newest(log, [*by, *key])


def compact(runs: DataFrame, *, output_level: int, key: Sequence[str] = KEY) -> DataFrame:
    """One version of each key over all given runs; into the bottom level tombstones go, for nothing older lies below."""
    merged = newest(runs, key)
    return merged.filter(F.col("op") != DELETE) if output_level >= N_LEVELS - 1 else merged


def sorted_runs(rows: DataFrame, n: int, key: str = "user_key") -> DataFrame:
    """Rows dealt to n ranges of keys, each sorted: what parallel subcompactions write, one file each."""
    return rows.repartitionByRange(n, key).sortWithinPartitions(key, F.col("seq").desc())


def run_metadata(runs: DataFrame) -> DataFrame:
    """Per run: rows, keys, tombstones, bytes, smallest and largest key, range of seq."""
    size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return runs.groupBy("run_id").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("user_key").alias("n_keys"),
        F.sum((F.col("op") == DELETE).cast("long")).alias("tombstones"),
        F.sum(size.cast("long")).alias("bytes"),
        F.min("user_key").alias("smallest"),
        F.max("user_key").alias("largest"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )


def contains(smallest: Column, largest: Column, key: Column) -> Column:
    """Both ends belong to a range."""
    return (key >= smallest) & (key <= largest)


def overlap_pairs(files: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Pairs of runs (a < b) whose ranges overlap, among the files of a manifest; group keeps pairs within e.g. a level.

    Runs go to the fixed ranges of keys that they touch and are joined there, a pair where the later of the two begins.
    """
    cuts = ranges.splitters(files, "smallest")
    held = files.select("run_id", "smallest", "largest", *group, ranges.number(F.col("smallest"), cuts).alias("_lo"), ranges.number(F.col("largest"), cuts).alias("_hi"))
    held = held.withColumn("_range", F.explode(F.sequence("_lo", "_hi")))
    a, b = held.alias("a"), held.alias("b")
    near = (F.col("a.run_id") < F.col("b.run_id")) & ~((F.col("a.largest") < F.col("b.smallest")) | (F.col("b.largest") < F.col("a.smallest")))
    for g in ("_range", *group):
        near &= F.col(f"a.{g}") == F.col(f"b.{g}")
    return a.join(b, near & (F.col("a._range") == F.greatest("a._lo", "b._lo"))).select(F.col("a.run_id").alias("run_a"), F.col("b.run_id").alias("run_b"))


def overlapping(files: DataFrame, smallest, largest) -> DataFrame:
    """Files that may hold a key of a range: the pruning before a read."""
    return files.filter(~((F.col("largest") < F.lit(smallest)) | (F.col("smallest") > F.lit(largest))))


def target_bytes(level: int, base: int = BASE_BYTES, multiplier: int = MULTIPLIER) -> int:
    return 0 if level == 0 else base * multiplier ** (level - 1)


def level_scores(files: DataFrame, *, trigger: int = L0_TRIGGER, base: int = BASE_BYTES, multiplier: int = MULTIPLIER) -> DataFrame:
    """Per level with files: n_files, bytes, score. Level 0 counts files against its trigger, others bytes against their target."""
    target = F.lit(float(base)) * F.pow(F.lit(float(multiplier)), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("n_files") / F.lit(float(trigger))).otherwise(F.col("bytes") / target)
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes")).withColumn("score", score)


def pick_level(scores: DataFrame) -> DataFrame:
    """The level to compact: the highest score above 1 among levels 0 to 5, ties to the lower; no row if there is none."""
    return scores.filter((F.col("score") > 1.0) & (F.col("level") < N_LEVELS - 1)).orderBy(F.col("score").desc(), "level").limit(1)


def subcompaction_ranges(rows: DataFrame, n: int = SUBCOMPACTIONS, key: str = "user_key") -> DataFrame:
    """n ranges of near equal numbers of distinct keys: tile (1 to n), smallest, largest, n_keys.

    Tiles follow from a key's rank: fixed ranges of keys are counted, and only their counts, a row each, meet in one task.
    """
    keys = rows.select(key).distinct()
    ranged = keys.withColumn("_range", ranges.number(F.col(key), ranges.splitters(rows, key)))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    counts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key)) + F.col("_before") - 1
    placed = ranged.join(F.broadcast(counts), "_range").withColumn("_rank", rank)
    size, large = F.expr(f"_total div {n}"), F.col("_total") % n
    edge = large * (size + 1)  # the first tiles take one key more, as NTILE does
    tile = F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / (size + 1))).otherwise(large + F.floor((F.col("_rank") - edge) / F.greatest(size, F.lit(1))))
    return placed.groupBy((tile + 1).cast("long").alias("tile")).agg(F.min(key).alias("smallest"), F.max(key).alias("largest"), F.count("*").alias("n_keys"))


def stalls(files: DataFrame, stop: int = L0_STOP) -> DataFrame:
    """One row: n_l0, trigger (compaction is due), stall (writes should wait)."""
    n = F.sum((F.col("level") == 0).cast("long"))
    return files.agg(F.coalesce(n, F.lit(0)).alias("n_l0")).select("n_l0", (F.col("n_l0") >= L0_TRIGGER).alias("trigger"), (F.col("n_l0") >= stop).alias("stall"))


def differences(after: DataFrame, before: DataFrame) -> DataFrame:
    """One row: n_after, n_before, n_differences (rows that one side has more often); 0 if a compaction changed nothing that a reader sees."""
    sides = after.withColumn("_side", F.lit(1)).unionByName(before.withColumn("_side", F.lit(-1)))
    rows = sides.groupBy(*after.columns).agg(F.sum((F.col("_side") == 1).cast("long")).alias("_a"), F.sum((F.col("_side") == -1).cast("long")).alias("_b"))
    counts = {"n_after": F.col("_a"), "n_before": F.col("_b"), "n_differences": F.abs(F.col("_a") - F.col("_b"))}
    return rows.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for n, x in counts.items()))
