"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over whole training texts.

Words are lower-cased in A-Z and are runs of letters, digits and non-ASCII characters. A window is ten consecutive words of
an item; an item with fewer words, but not none, is one window. The windows' hashes are broadcast; each document's windows
are looked up, every hit is verified word by word, and the words of verified windows are hit.

The benchmark is broadcast in blocks of BLOCK_BYTES; a larger one makes several passes over the documents, up to PASSES in
one stage, each adding its hits to those before. No worker holds more than a block.

Defined results: a null or wordless text has no words and no hits; null or wordless items have no windows; repeated items
and rows are each reported; an empty benchmark hits nothing. Columns of the input with the name of a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext, common

WINDOW = 10
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 4 << 20
#: Blocks that one stage passes; each has a worker of its own in a task. Then the documents are written with their hits so far.
PASSES = 4
#: Fixed values: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

RESULT = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "hit_words": pa.list_(pa.list_(pa.int64()))}
_SQL = "n_words long, n_hit long, items array<string>, hit_words array<array<long>>"


class WindowSet:
    """The windows of a block of items: for each length the sorted hashes, and where the window's words stand."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.names = [i for i, _ in items]
        texts = [_GAP.sub(b" ", t.encode().translate(bytes(bytetext.LOWER.tolist()))).strip(b" ") for _, t in items]
        offsets = np.cumsum([0, *map(len, texts)])
        self.text = b"".join(texts)
        data = np.frombuffer(self.text, dtype=np.uint8)
        starts, ends, first = bytetext.word_spans(WORD_BYTE[data], offsets)
        hashes = bytetext.word_hashes(data, starts, ends)
        counts = np.diff(first)
        owner = np.repeat(np.arange(len(items)), counts)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(np.minimum(counts[counts > 0], size)):
            fits = (counts >= size) if n == size else (counts == n)
            at = np.flatnonzero(fits[owner] & (np.arange(len(starts)) + n <= first[owner + 1])) if len(owner) else np.zeros(0, np.int64)
            found = bytetext.windows(hashes, int(n))[at]
            order = np.argsort(found, kind="stable")
            at = at[order]
            bits = max(16, min(24, int(len(at) * 64).bit_length()))
            seen = np.zeros(1 << bits, dtype=bool)
            seen[found & np.uint64((1 << bits) - 1)] = True
            self.by_length[int(n)] = (found[order], starts[at], ends[at + n - 1], owner[at], seen)

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Verified hits (position of the first word, words, item) in lower-cased texts."""
        hashes = bytetext.word_hashes(data, starts, ends)
        last = np.repeat(first[1:], np.diff(first))
        for n, (known, begin, end, owner, seen) in self.by_length.items():
            found = bytetext.windows(hashes, n)
            at = np.flatnonzero(seen[found & np.uint64(len(seen) - 1)])
            at = at[at + n <= last[at]]
            low = np.searchsorted(known, found[at], "left")
            high = np.searchsorted(known, found[at], "right")
            verified: dict[bytes, list[int]] = {}
            for i, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                raw = data[starts[i] : ends[i + n - 1]].tobytes()
                if raw not in verified:
                    words = _GAP.sub(b" ", raw)
                    verified[raw] = sorted({int(owner[k]) for k in range(a, b) if self.text[begin[k] : end[k]] == words})
                for item in verified[raw]:
                    yield i, n, item


def _pass(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: WindowSet = shared.value
        for batch in batches:
            names = batch.schema.names
            column = {n: batch.column(i) for i, n in enumerate(names)}
            counts, changed = [], {}
            for a, b, data, offsets in bytetext.batches(column["text"]):
                data = bytetext.LOWER[data]
                starts, ends, first = bytetext.word_spans(WORD_BYTE[data], offsets)
                ranges: dict[int, list] = {}
                items: dict[int, set] = {}
                for i, n, item in block.scan(data, starts, ends, first):
                    row = int(np.searchsorted(first, i, "right")) - 1
                    ranges.setdefault(row, []).append((i - int(first[row]), i - int(first[row]) + n))
                    items.setdefault(row, set()).add(block.names[item])
                counts.append(np.diff(first))
                for row in ranges:  # only rows with a hit become Python objects
                    old, had = column["hit_words"][a + row].as_py(), column["items"][a + row].as_py()
                    merged: list[list[int]] = []
                    for s, e in sorted([*map(tuple, old), *set(ranges[row])]):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    changed[a + row] = (sum(e - s for s, e in merged), sorted({*had, *items[row]}), merged)
            fresh = {"n_words": pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]))}
            if changed:
                at = np.arange(batch.num_rows)
                at[list(changed)] = batch.num_rows + np.arange(len(changed))
                for k, n in enumerate(("n_hit", "items", "hit_words")):
                    new = pa.array([r[k] for r in changed.values()], type=RESULT[n])
                    fresh[n] = pa.concat_arrays([column[n].cast(RESULT[n]), new]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([fresh.get(n, column[n]) for n in names], names)

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (ids of items with occurring windows, sorted as strings), hit_words ([start, end) runs)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    bench = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    out = docs.drop(*RESULT).select(
        "*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<array<bigint>>").alias("hit_words")
    )
    for k in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        block = WindowSet([(r["item_id"] or "", r["text"]) for r in rows.collect()], window)
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(block)), out.schema)
        if (k + 1) % PASSES == 0 and k + 1 < blocks:
            out = common.saved(out)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", **options) -> DataFrame:
    """docs without contamination, in their own columns.

    mode "documents" drops every document with a hit word; "spans" cuts the hit words, and what stands between them, out
    of the text, and drops a document that has no other word.
    """
    names = docs.columns
    found = scan(docs.select("*", *(F.col(n).alias(f"_own_{n}") for n in RESULT if n in names)), benchmark, **options)
    back = [F.col(f"_own_{n}").alias(n) if n in RESULT else F.col(n) for n in names]
    if mode == "documents":
        return found.filter("n_hit = 0").select(*back)
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    clean = found.filter("n_hit = 0 OR n_hit < n_words").mapInArrow(_cut, found.schema)
    if "n_chars" in names:
        clean = clean.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*back)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for batch in batches:
        names = batch.schema.names
        texts, runs = batch.column(names.index("text")).to_pylist(), batch.column(names.index("hit_words")).to_pylist()
        for i, found in enumerate(runs):
            if found:
                raw = texts[i].encode()
                at = [m.span() for m in word.finditer(raw.translate(bytes(bytetext.LOWER.tolist())))]
                kept, last = [], 0
                for s, e in found:
                    kept.append(raw[last : at[s][0]])
                    last = at[e - 1][1]
                texts[i] = b"".join([*kept, raw[last:]]).decode()
        fresh = pa.array(texts, type=batch.schema.field("text").type)
        yield pa.RecordBatch.from_arrays([fresh if n == "text" else batch.column(k) for k, n in enumerate(names)], names)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract, from scan()."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
