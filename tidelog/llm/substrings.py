"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes proposes cuts; a cut counts if the proposal before it is at least MIN bytes away,
and chunks longer than MAX are cut evenly. Both rules look at nearby bytes only, so an insertion moves no cut far from
it. Chunks are deduplicated by a 96-bit digest: the one in the document of least rank stays (in doc_id order, null last),
within a document the first; every other one is repeated. All repeated chunks are counted (n_repeated, repeated_bytes).

What is cut out of the text are runs of repeated chunks, side by side, of min_words words or more; min_words=0 cuts all. Words
count by blanks, where longer stretches without a blank than LONG bytes (scripts that don't part words, base64, URLs) count a
word for each UNIT bytes; but chunks that only repeat the one before them in their own text, as in a ruler, count by blanks
alone. So a passage that repeats loses all but a few words at its edges, and a phrase or a line that texts share by chance
stays in the text.

Only counts and least ranks are gathered for each digest, summed up before the shuffle; digests that many rows share are
joined back by a bounded broadcast (common.hot_join). Spans are cut to whole UTF-8 characters.

Defined results: null and empty texts have no chunks and stay as they are (null becomes empty); equal texts lose all but
their edges but in the first; repeated doc_ids are ranked in the order of the written table; a document without doc_id keeps
chunks as any other, but isn't named in first_ids; an empty table gives an empty one. Columns of the input with the name of a
result are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext, common

MIN, MAX = 12, 128
#: One position in so many is proposed, as expected: the hash's upper bits are zero.
SPACING_BITS = 4
MIN_WORDS = 20
#: Bytes without a blank that are one word at most, and bytes that count as a word in longer ones.
LONG, UNIT = 32, 6

#: 16 bits for each byte, by rule.
GEAR = (bytetext.mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)

_RESULT = ("n_bytes", "n_chunks", "n_repeated", "repeated_bytes", "removed_bytes", "removed", "first_ids")
_OWN, _ID = "_substrings", ["digest", "mark"]


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of GEAR[byte k back] << k, for 16 bytes."""
    h = GEAR[data]
    for m in (1, 2, 4, 8):
        shifted = h.copy()
        shifted[m:] += h[:-m] << np.uint16(m)
        h = shifted
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all chunks, and the text each belongs to."""
    owner_start = np.repeat(offsets[:-1], np.diff(offsets))
    at = np.flatnonzero(gear(data) >> np.uint16(16 - SPACING_BITS) == 0) if len(data) else np.zeros(0, np.int64)
    at = at[at - owner_start[at] >= 15] + 1  # a whole window in its own text; cut after the byte
    text = np.searchsorted(offsets, at, "left") - 1
    gap = np.diff(at, prepend=-MAX)
    gap[1:][text[1:] != text[:-1]] = MAX
    at = at[gap >= MIN]
    full = offsets[1:][np.diff(offsets) > 0]
    ends = np.union1d(at, full)
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    pieces = -(-(ends - starts) // MAX)
    if len(pieces) and pieces.max() > 1:
        first = np.repeat(starts, pieces)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = np.repeat(ends, pieces)
        starts, ends = first + step * MAX, np.minimum(first + (step + 1) * MAX, last)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def units(begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where further words are counted in long words: each UNIT bytes after the begin."""
    times = -(-(stops - begins) // UNIT) - 1
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(begins, times) + (step + 1) * UNIT


_LISTS = ("_digests", "_marks", "_places")


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        for a, b, data, offsets in bytetext.batches(text):
            starts, ends, owner = chunks(data, offsets)
            digests, marks = bytetext.span_hashes(data, starts, ends, wide=True)
            marks >>= np.uint64(32)
            begins, stops, _ = bytetext.word_spans(~bytetext.BLANK[data], offsets)
            long = stops - begins > LONG
            bounds = np.append(starts, len(data))
            words, more = (np.diff(np.searchsorted(x, bounds)) for x in (begins, units(begins[long], stops[long])))
            order = np.lexsort((marks, digests, owner))
            same = np.zeros(len(order), dtype=bool)
            same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (owner, digests, marks)])
            own = np.zeros(len(order), dtype=np.int64)
            own[order] = same  # the same chunk stands earlier in its text, or right before it
            ruler = np.zeros(len(order), dtype=np.int64)
            ruler[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in (owner, digests, marks)])
            places = ((starts - offsets[owner]) << 26) | (own << 25) | (ruler << 24) | ((ends - starts) << 16) | (np.minimum(words, 255) << 8) | np.minimum(more, 255)
            cuts = pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (digests.astype(np.int64), marks.astype(np.uint32).view(np.int32), places.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *lists], [*batch.schema.names, *_LISTS])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts, spans = (batch.column(names.index(n)).to_pylist() for n in ("text", "removed"))
        counts = []
        for i, found in enumerate(spans):
            raw, kept, last, gone = texts[i].encode(), [], 0, 0
            for span in found:
                s, e = span["start"], span["end"]
                while s < e and raw[s] & 0xC0 == 0x80:
                    s += 1
                while s < e < len(raw) and raw[e] & 0xC0 == 0x80:
                    e -= 1
                kept.append(raw[last:s])
                last, gone = e, gone + e - s
                span["start"], span["end"] = s, e
            if found:
                texts[i] = b"".join([*kept, raw[last:]]).decode()
            counts.append(gone)
        fresh = {"text": pa.array(texts, batch.schema.field("text").type), "removed_bytes": pa.array(counts, pa.int64()), "removed": pa.array(spans, batch.schema.field("removed").type)}
        yield pa.RecordBatch.from_arrays([fresh.get(n, batch.column(k)) for k, n in enumerate(names)], names)


def dedup(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text left, n_bytes and n_chunks (before), n_repeated and repeated_bytes (of chunks that an earlier place has),
    removed_bytes, removed (spans of bytes), first_ids (documents that keep what is removed)."""
    common.small_batches(docs.sparkSession)
    rest = docs.drop(*_RESULT)
    names = [c for c in rest.columns if c != "text"]
    rows = rest.select(F.struct(*names).alias(_OWN), F.col("doc_id").cast("long").alias("_id"), common.text_of().alias("text"), F.monotonically_increasing_id().alias("_row"))
    kinds = (T.LongType(), T.IntegerType(), T.LongType())
    table = common.saved(rows.mapInArrow(_chunk, T.StructType([*rows.schema, *(T.StructField(n, T.ArrayType(t)) for n, t in zip(_LISTS, kinds, strict=True))])))
    total = table.agg(F.coalesce(F.sum(F.size("_digests")), F.lit(0))).first()[0]
    ranks = None
    if not table.groupBy("_id").count().filter("count > 1 OR _id IS NULL").isEmpty():
        # Ranks stand in for doc_ids, which don't tell rows apart here.
        ranks = common.running_total(table.select("_id", "_row"), [F.col("_id").asc_nulls_last(), F.col("_row")], _rank=F.lit(1))
        ranks = common.saved(ranks.select("_row", "_rank", "_id"))
        lists = table.select("_row", *_LISTS).join(ranks.select("_row", "_rank"), "_row").drop("_row")
    else:
        lists = table.select(F.col("_id").alias("_rank"), *_LISTS)
    chunk = lists.select("_rank", F.inline(F.arrays_zip(F.col("_digests").alias("digest"), F.col("_marks").alias("mark"), F.col("_places").alias("place"))))
    groups = common.saved(chunk.groupBy(*_ID).agg(F.min("_rank").alias("_first"), F.count("*").alias("_n")).filter("_n > 1"))
    # In the document that keeps a chunk, its first place stays.
    own, ruler = (F.shiftright("place", k).bitwiseAND(1) == 1 for k in (25, 24))
    same = common.hot_join(chunk, groups, _ID, "_n", total).filter((F.col("_rank") != F.col("_first")) | own).select("_rank", "_first", "place")
    size, words, more = (F.shiftright("place", k).bitwiseAND(255) for k in (16, 8, 0))
    order = Window.partitionBy("_rank").orderBy("place")
    start = F.shiftright("place", 26)
    same = same.withColumn("_before", F.lag(start + size).over(order)).withColumn("_run", F.sum((~F.col("_before").eqNullSafe(start)).cast("int")).over(order))
    words = words + F.when(ruler & (F.col("_rank") == F.col("_first")), 0).otherwise(more)
    runs = same.select("_rank", "_run", "_first", start.alias("start"), (start + size).alias("end"), words.alias("words")).groupBy("_rank", "_run").agg(
        F.count("*").alias("n"), F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.sum("words").alias("words"), F.collect_set("_first").alias("ids")
    )
    goes = F.col("words") >= min_words
    spans = runs.groupBy("_rank").agg(
        F.sum("n").alias("n_repeated"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("repeated_bytes"),
        F.array_sort(F.collect_list(F.when(goes, F.struct("start", "end")))).alias("removed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(goes, F.col("ids")))))).alias("first_ids")
    )
    key = "_id"
    if ranks is not None:
        key = "_row"
        firsts = spans.select("_rank", F.explode("first_ids").alias("_first")).join(ranks.select(F.col("_rank").alias("_first"), "_id"), "_first")
        firsts = firsts.groupBy("_rank").agg(F.array_sort(F.collect_set("_id")).alias("first_ids"))
        spans = spans.drop("first_ids").join(firsts, "_rank", "left").join(ranks.select("_rank", "_row"), "_rank")
    spans = common.saved(spans.withColumnRenamed("_rank", "_id") if ranks is None else spans.drop("_rank"))
    out = table.withColumn("n_chunks", F.size("_digests").cast("long")).drop(*_LISTS).join(common.maybe_broadcast(spans), key, "left")
    none = F.lit(0).cast("long")
    out = out.select(
        _OWN, "text", F.octet_length("text").cast("long").alias("n_bytes"), "n_chunks", F.coalesce("n_repeated", none).alias("n_repeated"), F.coalesce("repeated_bytes", none).alias("repeated_bytes"), none.alias("removed_bytes"),
        F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"), F.coalesce("first_ids", F.array().cast("array<bigint>")).alias("first_ids"),
    )
    out = out.mapInArrow(_cut, out.schema)
    return out.select(*(F.col("text") if c == "text" else F.col(_OWN).getField(c).alias(c) for c in rest.columns), *_RESULT)
