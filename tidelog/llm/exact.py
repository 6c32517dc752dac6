"""Exact dedup over a log-structured merge index of text digests, in DataFrame operations only.

Documents go through memtables: of the rows of a memtable that have the same digest, the best identifier and a count stay. Each
memtable is flushed as a run, whose files are sorted by digest, and gets a filter: a Bloom filter in pages of 4 KB, all bits of a
digest in one page. There are as many runs as memtables of MEMTABLE_ROWS, at most RUNS; beyond that memtables grow, and as all
tasks share in each of them, what one task holds doesn't.

Compaction sends the digests of each run through the filters of all other runs. What no other run may hold is final as it stands;
only the rest is merged by a shuffle, where the best identifier of each digest stays and counts add up. So most documents
are known to be alone by a filter. The others probe the compacted level by their digest, and are verified byte by byte: within
a digest the least and the greatest normalised text must be the same string, else the rows of that digest are grouped by
the text itself. Only texts of documents with a shared digest are read and normalised again.

Hot digests shrink in the memtables and are joined back by a broadcast that the pigeonhole principle bounds; see common.hot_join.

Defined results: a null text is an empty one; the row with the most code points stays, then the smallest doc_id, null
last; rows that agree in doc_id and text are of one group and share keep_id, and each is marked as kept that has it;
an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The white space that does not count, [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Documents that a memtable takes before it is flushed, while there are at most RUNS runs.
MEMTABLE_ROWS, RUNS = 1 << 14, 16
#: Of a run's filter: bits for each digest, bits that a digest sets, and bits of a page (the size of Spark's bitmaps).
BITS, PROBES, PAGE_BITS = 10, 4, 32768

_ENTRY = "digest binary, best struct<r: bigint, n: boolean, id: bigint>, n bigint"


def normalised(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _best() -> Column:
    """The identifier of a group that is preferred."""
    return F.min(F.struct(F.col("_rank").alias("r"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id")))


def _bit(page: Column, at: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(page, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at.bitwiseAND(7)) == 1


class DigestIndex:
    """Runs of (digest, best, n), each sorted by digest, in a folder; level 0 as flushed, with filters; level 1 compacted."""

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = MEMTABLE_ROWS):
        self.spark, self.memtable_rows = spark, memtable_rows
        self.path = path or f"{common.scratch_dir(spark)}/lsm-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.pages = 1

    def ingest(self, entries: DataFrame, rows: int) -> None:
        """entries (doc_id, _rank, digest): deal them to memtables, sum each up, flush each as a run, and build the filters."""
        memtables = max(1, min(RUNS, -(-rows // self.memtable_rows)))
        dealt = entries.withColumn("_run", F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int"))
        merged = dealt.groupBy("_run", "digest").agg(_best().alias("best"), F.count("*").alias("n"))
        flushed = f"{self.path}/L0"
        merged.sortWithinPartitions("_run", "digest").write.option("compression", "zstd").partitionBy("_run").parquet(flushed)
        self.runs = [f"{flushed}/_run={i}" for i in range(memtables)] if rows else []
        self.pages = max(1, -(-rows * BITS // (memtables * PAGE_BITS)))
        bits = self._placed(self.level0().select("_run", "digest")).select("_run", "_page", F.explode("_bits").alias("bit"))
        bits.groupBy("_run", "_page").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(f"{self.path}/filters")

    def level0(self) -> DataFrame:
        return self.spark.read.schema(f"{_ENTRY}, _run int").parquet(f"{self.path}/L0")

    def _placed(self, digests: DataFrame) -> DataFrame:
        """digests with the page and the bits that a filter has for each."""
        bits = F.array(*(F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(PAGE_BITS)) for i in range(PROBES)))
        return digests.withColumns({"_page": F.pmod(F.xxhash64("digest"), F.lit(self.pages)), "_bits": bits})

    def may_hold(self, digests: DataFrame) -> DataFrame:
        """digests with _runs: the runs whose filter doesn't rule a digest out. A page of all runs, at most RUNS x 4 KB, is a row."""
        pages = self.spark.read.schema("_run int, _page bigint, bits binary").parquet(f"{self.path}/filters")
        pages = pages.groupBy("_page").agg(F.collect_list(F.struct("_run", "bits")).alias("_filters"))
        found = self._placed(digests).join(common.maybe_broadcast(common.saved(pages)), "_page", "left")

        def set_in(f: Column) -> Column:
            at = [F.element_at("_bits", i + 1).cast("int") for i in range(PROBES)]
            return _bit(f["bits"], at[0]) & _bit(f["bits"], at[1]) & _bit(f["bits"], at[2]) & _bit(f["bits"], at[3])

        runs = F.transform(F.filter(F.coalesce("_filters", F.expr("cast(array() as array<struct<_run: int, bits: binary>>)")), set_in), lambda f: f["_run"])
        return found.select(*digests.columns, runs.alias("_runs"))

    def compact(self) -> DataFrame:
        """The compacted level: of each digest the best identifier, and the sum of its counts. Only digests that another run may hold are merged."""
        probed = common.saved(self.may_hold(self.level0()).withColumn("_elsewhere", F.size(F.array_remove("_runs", F.col("_run"))) > 0).drop("_runs"))
        merged = probed.filter("_elsewhere").groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        level = probed.filter("NOT _elsewhere").select("digest", "best", "n").unionByName(merged)
        level.sortWithinPartitions("digest").write.options(**{"compression": "zstd", "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": str(1 << 20)}).parquet(f"{self.path}/L1")
        self.runs = [f"{self.path}/L1"]
        return self.read()

    def read(self) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(*self.runs) if self.runs else self.spark.createDataFrame([], _ENTRY)

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Index rows of a few digests. Of level 0 only runs whose filter lets one of them pass are opened; of level 1 files and row
        groups are left out by Parquet's own filters."""
        want = [bytearray(d) for d in digests]
        runs = self.runs
        if any("/_run=" in r for r in runs):
            held = self.may_hold(self.spark.createDataFrame([(d,) for d in want], "digest binary"))
            numbers = {i for r in held.select("_runs").collect() for i in r["_runs"]}  # of the digests asked for
            runs = [r for i, r in enumerate(self.runs) if i in numbers]
        rows = self.spark.read.schema(_ENTRY).parquet(*runs) if runs else self.spark.createDataFrame([], _ENTRY)
        return rows.filter(F.col("digest").isin(want))


def dedup(
    docs: DataFrame, *, memtable_rows: int = MEMTABLE_ROWS, digest: Callable[[Column], Column] = sha256, path: str | None = None
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (of the normalised text)."""
    spark = docs.sparkSession
    text = common.text_of()

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", (-F.length(text)).cast("long").alias("_rank"), normalised(text).alias("_norm")).withColumn("digest", digest(F.col("_norm")))

    entries = common.saved(hashed(docs).drop("_norm"))
    total = entries.count()
    index = DigestIndex(spark, path, memtable_rows)
    index.ingest(entries, total)
    level = index.compact()
    alone = level.filter("n = 1").select(F.col("best.id").alias("doc_id"), F.col("best.r").alias("_rank"), "digest", "best", "n")
    shared = common.saved(level.filter("n > 1"))
    hits = common.saved(common.hot_join(entries.join(common.maybe_broadcast(shared.select("digest")), "digest", "left_semi"), shared, "digest", "n", total))
    # Not one group of hits meets in a task: each task sends the least and greatest text of a digest.
    again = common.maybe_broadcast(hits.select(F.col("doc_id").alias("_hit")).distinct())
    texts = hashed(docs.join(again, docs["doc_id"].eqNullSafe(F.col("_hit")), "left_semi"))
    unlike = texts.groupBy("digest").agg(F.min("_norm").alias("_a"), F.max("_norm").alias("_b")).filter("_a != _b").select("digest")
    unlike = common.saved(unlike)
    out = _result(alone.unionByName(hits.select(*alone.columns)), F.col("best.id"), F.col("n"))
    if unlike.isEmpty():
        return out
    clash = hashed(docs).join(common.maybe_broadcast(unlike), "digest", "left_semi")
    groups = clash.groupBy("_norm").agg(_best().alias("best"), F.count("*").alias("n"))
    apart = common.hot_join(clash, groups, "_norm", "n", total)
    return out.join(common.maybe_broadcast(unlike), "digest", "left_anti").unionByName(_result(apart, F.col("best.id"), F.col("n")))


def _result(df: DataFrame, keep_id: Column, size: Column) -> DataFrame:
    kept = F.col("doc_id").eqNullSafe(keep_id) & (F.col("_rank") == F.col("best.r"))
    return df.select("doc_id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), "digest")
