"""Counters of a store and what follows from them.

A counter is declared here with what it counts, and is added to in the one place where that happens.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import ranges

COUNTERS = {
    "commits": "commit files put in place by this store object",
    "lost_races": "commits that another writer was first to",
    "commit_bytes": "bytes of commit files",
    "commit_syncs": "commit files forced to the disk",
    "operations": "operations of batches",
    "deletions": "deletions among them",
    "operation_bytes": "bytes of their keys and values",
    "waits": "writes that found level 0 full",
    "wait_micros": "time that they waited or compacted",
    "runs_written": "runs written by bulk writes, flushes and compactions",
    "run_rows": "rows of them",
    "run_bytes": "bytes of them, as stored",
    "flushes": "buffers turned into runs",
    "batches_skipped": "stream batches that had been taken in before",
    "lookups": "keys looked up by get()",
    "lookups_from_buffer": "of them answered by the buffer, without a job",
    "lookups_found": "of them that are live",
    "scans": "iterators made and families read whole or in part",
    "runs_considered": "runs that a read could have opened",
    "runs_left_out": "of them left out by their key range",
    "readers_asked": "times that a set of run files was to be opened",
    "readers_kept": "of them that an opened reader was kept for",
    "cache_reads": "reads of a family that was cached once",
    "cache_hits": "of them answered by cached rows",
    "cache_evictions": "families that left the cache for lack of room",
    "compactions": "compactions done",
    "split_compactions": "of them dealt to several ranges of keys",
    "compacted_runs": "runs merged away",
    "compaction_read_bytes": "bytes of runs merged",
    "compaction_micros": "time of compactions",
    "compaction_written_bytes": "bytes of runs that compactions wrote",
}

#: Shares and ratios: part over whole.
RATES = {
    "found": ("lookups_found", "lookups"),
    "from_buffer": ("lookups_from_buffer", "lookups"),
    "left_out": ("runs_left_out", "runs_considered"),
    "reader": ("readers_kept", "readers_asked"),
    "cache": ("cache_hits", "cache_reads"),
    "split": ("split_compactions", "compactions"),
    "compaction_volume": ("compaction_written_bytes", "compaction_read_bytes"),
    "micros_per_compaction": ("compaction_micros", "compactions"),
    "operations_per_commit": ("operations", "commits"),
}


class Statistics:
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self._lock:
            self._counts = dict.fromkeys(COUNTERS, 0)

    def add(self, **counts: int) -> None:
        with self._lock:
            for name, n in counts.items():
                self._counts[name] += n

    def __getattr__(self, name: str) -> int:
        if name in COUNTERS:
            return self._counts[name]
        raise AttributeError(name)

    def rates(self) -> dict[str, float]:
        """Each of RATES; 0 where there is nothing to divide by."""
        return {name: self._counts[part] / self._counts[whole] if self._counts[whole] else 0.0 for name, (part, whole) in RATES.items()}

    def report(self) -> str:
        """A line for each counter with what it counts, then one for each rate."""
        lines = [f"{n:>14}  {name}: {COUNTERS[name]}" for name, n in self._counts.items()]
        return "\n".join([*lines, *(f"{x:>14.4g}  {name}: {RATES[name][0]} / {RATES[name][1]}" for name, x in self.rates().items())])


def percentiles(rows: DataFrame, column: str, points: list[float]) -> DataFrame:
    """Nearest-rank values: the one at floor(n x p / 100) of the sorted column, at most the last.

    Only counts a distinct value are kept, and a running count over fixed ranges of values finds the ranks.
    """
    some = rows.filter(F.col(column).isNotNull())
    counts = some.groupBy(F.col(column).alias("_x")).agg(F.count("*").alias("_n"))
    ranged = counts.withColumn("_range", ranges.number(F.col("_x"), ranges.splitters(some, column)))
    before = Window.orderBy("_range")
    offsets = ranged.groupBy("_range").agg(F.sum("_n").alias("_all")).select("_range", (F.sum("_all").over(before) - F.col("_all")).alias("_off"), F.sum("_all").over(Window.partitionBy()).alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy("_range").orderBy("_x")) + F.col("_off")
    placed = ranged.join(F.broadcast(offsets), "_range").withColumn("_end", upto)
    want = rows.sparkSession.createDataFrame([(float(p),) for p in points], "percentile double")
    rank = F.least(F.floor(F.col("_total") * F.col("percentile") / 100), F.col("_total") - 1)
    hit = placed.join(F.broadcast(want), (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_n")))
    return hit.select("percentile", F.col("_x").cast("double").alias("value"))
