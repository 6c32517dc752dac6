"""Sharding by sampled splitters: shards of near equal bytes, equal texts together.

Records with equal texts are a group, which is known by the md5 of its text and placed as a whole. Only a group larger than a
shard's due share of all bytes is cut, in the order of doc_id, into pieces that fill a share each; a group that is not cut, or
a piece, is a unit. Units above 1 / LARGE of a share, which are at most LARGE + 1 a shard, are dealt first, largest first, to
the shards in turn, there and back. All others then fill the shards up to one level, in the order of their md5: a sample drawn
with a chance in proportion to a group's size gives quantile boundaries; they cut the groups into many more ranges than
shards; ranges that turn out to hold more than twice their due are sampled again, on their own, and subdivided until no
divisible one is left. Prefix sums over the ranges, then within each range, place every group, and its middle byte decides. So
a shard differs from the level by at most a hundredth of a share (half such a group at either end), unless units dealt first
are above the level already.

Slots follow the order of (md5, doc_id, null first) within a shard.

Defined results: a null text has no bytes, the checksum 0, and counts as an empty one; a size is at least 16, so empty texts
count; a single text larger than a share is a unit; rows that agree in text and doc_id are interchangeable; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
OVERHEAD = 16
#: Sampled keys a range, as expected; the driver holds so many times ranges.
OVERSAMPLE = 16
#: Units above one in so many parts of a shard are dealt before all others; the driver holds at most as many times shards.
LARGE = 100
#: A range is overfull above so many times its due.
OVERFULL = 2.0
_ID = ("_key", "_tie")


def _md5_bits(text: Column) -> list[Column]:
    """120 bits of the md5 of a text as two longs of 60; the first orders groups."""
    return [F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("long").alias(n) for at, n in zip((1, 16), _ID, strict=True)]


def _assign(splitters: list[tuple[int, int]], names: tuple[str, str] = _ID):
    """Arrow batches with _range: the number of splitters at or before the two columns named."""
    keys, ties = (np.array([s[i] for s in splitters], dtype=np.int64) for i in (0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, t = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names)
            low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            at = high.copy()
            tied = np.flatnonzero(high > low)  # a splitter has the same key: the second column decides
            for a in np.unique(low[tied]):
                rows = tied[low[tied] == a]
                at[rows] = a + np.searchsorted(ties[a : high[rows[0]]], t[rows], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], [*batch.schema.names, "_range"])

    return assign


def _splitters(sample: list, parts: int) -> list[tuple[int, int]]:
    """Quantiles by weight of a sample of (key, second key, weight)."""
    sample = sorted((r[0], r[1], r[2]) for r in sample)
    if not sample or parts < 2:
        return []
    weights = np.cumsum([r[2] for r in sample])
    at = np.searchsorted(weights, weights[-1] * np.arange(1, parts) / parts)
    return [sample[i][:2] for i in np.unique(np.minimum(at, len(sample) - 1))]


def _ranged(groups: DataFrame, total: int, ranges: int) -> tuple[DataFrame, list]:
    """groups (_key, _tie, _bytes) with _range, and for each range its number and bytes, in order."""
    schema = f"{', '.join(f'{n} {t}' for n, t in groups.dtypes)}, _range long"
    chance = (F.shiftrightunsigned(F.xxhash64(*_ID, F.lit(7)), 11)) / F.lit(float(1 << 53))
    due = max(1.0, total / ranges)

    def draw(df: DataFrame, step: float) -> list:
        return df.filter(chance < F.col("_bytes") / F.lit(step)).select(*_ID, F.greatest(F.col("_bytes").cast("double"), F.lit(step))).collect()

    splitters = _splitters(draw(groups, due / OVERSAMPLE), ranges)
    while True:
        out = groups.mapInArrow(_assign(splitters), schema)
        ends = F.struct(*_ID)
        found = out.groupBy("_range").agg(F.sum("_bytes").alias("b"), F.min(ends).alias("lo"), F.max(ends).alias("hi")).orderBy("_range").collect()
        over = [r for r in found if r["b"] > OVERFULL * due and r["lo"] != r["hi"]]
        more: set[tuple[int, int]] = set()
        if over:
            each = due / OVERSAMPLE / 4
            again = draw(out.join(F.broadcast(out.sparkSession.createDataFrame([(r["_range"],) for r in over], "_range long")), "_range"), each)
            for r in over:
                lo, hi = tuple(r["lo"]), tuple(r["hi"])
                inside = [s for s in again if lo <= (s[0], s[1]) <= hi]
                # The first key of a range is already its start; the last always divides it.
                more |= {s for s in _splitters(inside, 2 * int(np.ceil(r["b"] / due))) if s > lo} | {hi}
        if not more - set(splitters):
            return out, found
        splitters = sorted({*splitters, *more})


def _deal(large: list, total: int, n_shards: int) -> tuple[list[tuple], list[int]]:
    """Units of the large groups (_key, _tie, _piece, shard), and for each shard the small bytes up to its end."""
    units = []
    for r in large:
        each = max(1, total // (n_shards * r["_size"]))
        units += [(min(each, r["_n"] - at) * r["_size"], r["_key"], r["_tie"], at // each) for at in range(0, r["_n"], each)]
    units.sort(key=lambda u: (-u[0], *u[1:]))
    turn = [*range(n_shards), *reversed(range(n_shards))]
    load, dealt = [0] * n_shards, []
    for i, (size, key, tie, piece) in enumerate(units):
        shard = turn[i % len(turn)]
        load[shard] += size
        dealt.append((key, tie, piece, shard))
    # The least of these is the level that the rest fills the shards to.
    small, below = total - sum(load), np.cumsum(sorted(load))
    level = min((small + int(b)) // (j + 1) for j, b in enumerate(below))
    return dealt, np.cumsum([max(0, level - x) for x in load]).tolist()


def _fill(ends: list[int]):
    """Arrow batches of (_key, _tie, _bytes, _at) as (_key, _tie, shard): the shard that has the middle byte."""
    ends = np.array(ends, dtype=np.int64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            middle = 2 * column["_at"].to_numpy(zero_copy_only=False) + column["_bytes"].to_numpy(zero_copy_only=False)
            shard = np.minimum(np.searchsorted(2 * ends, middle, "right"), len(ends) - 1)
            yield pa.RecordBatch.from_arrays([column["_key"], column["_tie"], pa.array(shard.astype(np.int32))], [*_ID, "shard"])

    return fill


def shard(docs: DataFrame, n_shards: int = SHARDS, *, ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ("bytes"), shard, slot (gapless within the shard)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    raw = F.encode(common.text_of(), "utf-8")
    rows = common.saved(docs.select("doc_id", (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *_md5_bits(common.text_of()), F.monotonically_increasing_id().alias("_nr")))
    groups = common.saved(rows.groupBy(*_ID).agg(F.min("size").alias("_size"), F.count("*").alias("_n")).withColumn("_bytes", F.col("_size") * F.col("_n")))
    total = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    is_large = F.col("_bytes").cast("decimal(38,0)") * LARGE * n_shards > F.lit(total)
    large = groups.filter(is_large).select(*_ID, "_size", "_n").collect()  # at most LARGE * n_shards
    dealt, ends = _deal(large, total, n_shards)

    # All other groups, by ranges
    small = groups.filter(~is_large).select(*_ID, "_bytes")
    ranged, found = _ranged(small, total, ranges or 4 * max(n_shards, common.parallelism(spark)))
    starts, before = [], 0
    for r in found:  # one entry a range, whose number is a parameter
        starts.append((r["_range"], before))
        before += r["b"]
    inside = Window.partitionBy("_range").orderBy(*_ID).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_start") + F.coalesce(F.sum("_bytes").over(inside), F.lit(0))
    placed = ranged.join(F.broadcast(spark.createDataFrame(starts, "_range long, _start long")), "_range").select(*_ID, "_bytes", at.alias("_at"))
    placed = placed.mapInArrow(_fill(ends), "_key long, _tie long, shard int")

    # Rows follow their group; those of a group in pieces by their rank in it.
    names = spark.createDataFrame([(r["_key"], r["_tie"]) for r in large], "_key long, _tie long")
    where = spark.createDataFrame(dealt, "_key long, _tie long, _piece long, shard int")
    out = rows.join(F.broadcast(names), list(_ID), "left_anti").join(placed, list(_ID))
    whole = where.join(where.groupBy(*_ID).count().filter("count = 1").select(*_ID), list(_ID)).drop("_piece")
    out = out.unionByName(rows.join(F.broadcast(whole), list(_ID)))
    cut = sorted((r["_key"], r["_tie"], r["_n"], each) for r in large if r["_n"] > (each := max(1, total // (n_shards * r["_size"]))))
    if cut:
        first = np.cumsum([0, *(n for _, _, n, _ in cut)]).tolist()
        sizes = spark.createDataFrame([(k, t, each, first[i]) for i, (k, t, _, each) in enumerate(cut)], "_key long, _tie long, _each long, _first long")
        ranked = common.running_total(rows.join(F.broadcast(sizes), list(_ID)), [*(F.col(c) for c in _ID), F.col("doc_id").asc_nulls_first(), F.col("_nr")], _rank=F.lit(1))
        pieces = ranked.withColumn("_piece", F.expr("(_rank - _first) div _each")).drop("_rank", "_each", "_first")
        out = out.unionByName(pieces.join(F.broadcast(where), [*_ID, "_piece"]).drop("_piece"))
    order = [F.col("shard"), *(F.col(c) for c in _ID), F.col("doc_id").asc_nulls_first(), F.col("_nr")]
    out = common.saved(common.running_total(out, order, _row=F.lit(1)))
    first = out.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row a shard
    return out.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot")
    )
