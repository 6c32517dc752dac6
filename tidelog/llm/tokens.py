"""Token ids in a binary container, in ascending doc_id order, coded by rans.

Writing takes three passes. Texts are encoded where they lie and written with zstd. Ids are counted over all documents and
make one shared frequency table. Splitters of (doc_id, row), sampled by token counts, then deal packed ids to many ranges,
each of which one task sorts and codes as segments of whole documents.

Container: a folder with frequencies (id, freq) and segments (range, segment, first: ids before it in its range, n_ids,
doc_ids, lengths, payload: rans blocks), both Parquet, so they can lie in any store that Spark writes. A segment is
closed with the document that fills it; a longer document is a segment of several blocks.

Defined results: a null text is empty and has the end id alone; null doc_ids come last; rows with the same doc_id stand
together in any order; an empty table gives a container without segments. Extra columns are not written.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext, common, rans
from .sharding import _assign, _splitters

END_ID = 1
#: Ids after which a segment is closed.
SEGMENT = 1 << 20
#: Ids in a range, as expected, once there are more than four ranges for each partition.
RANGE_IDS = 1 << 24
#: A worker's table of known words: slots, and ids after which it starts anew.
SLOTS, POOL = 1 << 20, 1 << 23
#: Bytes of text (or one text) and words that are looked up at once.
PIECE, WORDS_AT_ONCE = 1 << 20, 1 << 18
#: 1: a-z; 2: ASCII signs but the apostrophe. Such tokenizers always part a letter and a sign.
_KIND = np.zeros(256, dtype=np.int8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = 2
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_LAST = (1 << 63) - 1


def independent_words(parsed: dict) -> bool:
    """Whether the tokenizer drops white space and never joins what it parts, so words can be encoded one by one."""
    parts = parsed.get("pre_tokenizer") or {}
    parts = parts.get("pretokenizers", [parts])
    return any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and r"[^\s" in (p.get("pattern") or {}).get("Regex", "") for p in parts)


class Encoder:
    """Ids of whole texts.

    If the tokenizer drops white space and never joins what it parts, the words of a text, ASCII letters lower-cased, are
    parted from ASCII signs and looked up in a table of known words, all at once in numpy; the key is the whole word, of up to 16
    bytes, and longer words have a dict. Only words not seen before go to the tokenizer, many in one call. What a call
    returns is cut where a token ends a word, which is right if there are as many ends as words; otherwise the words of
    that call are encoded singly. A text that may hold a special token's string is encoded whole.
    """

    def __init__(self, config: str, *, slots: int = SLOTS, pool: int = POOL):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        parsed = json.loads(config)
        suffix = parsed["model"].get("end_of_word_suffix") or ""
        self.by_word = bool(suffix) and independent_words(parsed)
        self.special = [t["content"].encode()[:2] for t in parsed.get("added_tokens", [])]
        self.slots, self.pool_size = slots, pool
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            self._clear()

    def _clear(self) -> None:
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.length = np.zeros(self.slots, np.uint8)  # 0: free
        self.at, self.count = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.pool = np.zeros(self.pool_size, self.kind)
        self.used = 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of words into the pool: where they begin, and how many they are."""
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            ids = self.whole([b" ".join(part).decode()])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            marked = [w for w in part if not w.isalpha()]
            if len(cuts) != len(part) or (marked and not all(w.decode().isalpha() for w in marked)):
                single = self.whole([w.decode() for w in part])
                ids, n = np.concatenate(single), np.array([len(x) for x in single])
            else:
                n = np.diff(cuts, prepend=0)
            found.append(ids)
            counts.append(n)
        ids, n = np.concatenate(found), np.concatenate(counts)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), self.kind)])
        at = self.used + np.cumsum(n) - n
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return at, n

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of each word's ids in the pool. data: lower-cased, with 8 bytes more at either end."""
        if self.used > self.pool_size:
            self._clear()
        size = ends - starts
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        low = eight[starts] & _MASK[np.minimum(size, 8)]
        high = np.where(size > 8, eight[ends - 8], np.uint64(0))
        mixed = bytetext.mix64(low * np.uint64(0x9E3779B97F4A7C15) + bytetext.mix64(high + size.astype(np.uint64)))
        slot, other = (mixed % np.uint64(self.slots)).astype(np.int64), ((mixed >> np.uint64(32)) % np.uint64(self.slots)).astype(np.int64)

        def holds(where: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
            return (self.low[where] == low[rows]) & (self.high[where] == high[rows]) & (self.length[where] == size[rows])

        known = holds(slot, slice(None)) & (size <= 16)
        at, n = self.at[slot], self.count[slot]
        rest = np.flatnonzero(~known & (size <= 16))
        second = holds(other[rest], rest)
        hit = rest[second]
        at[hit], n[hit] = self.at[other[hit]], self.count[other[hit]]
        rest = rest[~second]
        if len(rest):
            order = rest[np.lexsort((size[rest], high[rest], low[rest]))]
            new = np.ones(len(order), dtype=bool)
            a, b = order[1:], order[:-1]
            new[1:] = (low[a] != low[b]) | (high[a] != high[b]) | (size[a] != size[b])
            first = order[new]
            raw = data.tobytes()
            # Words of letters first, so that whole calls can be cut at the ends of words
            texts = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            kinds = np.array([not (w.isalpha() or w.decode().isalpha()) for w in texts])
            sort = np.argsort(kinds, kind="stable")
            got_at, got_n = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
            for part in (sort[: len(sort) - kinds.sum()], sort[len(sort) - kinds.sum() :]):
                if len(part):
                    got_at[part], got_n[part] = self._new([texts[i] for i in part.tolist()])
            which = np.cumsum(new) - 1
            at[order], n[order] = got_at[which], got_n[which]
            place = np.where(self.length[slot[first]] == 0, slot[first], other[first])
            self.low[place], self.high[place], self.length[place] = low[first], high[first], size[first]
            self.at[place], self.count[place] = got_at, got_n
            # Two new words may have taken one slot: it holds the last of each column, so all columns agree.
        longs = np.flatnonzero(size > 16)
        if len(longs):
            keys = [data[i:j].tobytes() for i, j in zip(starts[longs].tolist(), ends[longs].tolist(), strict=True)]
            unknown = [k for k in dict.fromkeys(keys) if k not in self.long]
            if unknown:
                where, many = self._new(unknown)
                self.long.update(zip(unknown, zip(where.tolist(), many.tolist(), strict=True), strict=True))
            both = np.array([self.long[k] for k in keys], dtype=np.int64)
            at[longs], n[longs] = both[:, 0], both[:, 1]
        return at, n

    def __call__(self, column: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each piece of a text column: the number of ids of each text, and all ids; end follows each text."""
        if not self.by_word:
            for a in range(0, len(column), 256):
                found = [np.append(x, end).astype(self.kind) for x in self.whole([t or "" for t in column.slice(a, 256).to_pylist()])]
                yield np.array([len(x) for x in found]), np.concatenate(found)
            return
        for row, _, data, offsets in bytetext.batches(column, PIECE):
            whole = [i for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)) if any(s in data[a:b].tobytes() for s in self.special)] if self._suspect(data) else []
            padded = np.zeros(len(data) + 16, np.uint8)
            padded[8:-8] = bytetext.LOWER[data]
            starts, ends, first = bytetext.word_spans(~bytetext.BLANK[data], offsets, _KIND[padded[8:-8]])
            parts_n = [np.zeros(0, np.int64)]
            ids: list[np.ndarray] = []
            for a in range(0, len(starts), WORDS_AT_ONCE):
                at, n = self.words(padded, starts[a : a + WORDS_AT_ONCE] + 8, ends[a : a + WORDS_AT_ONCE] + 8)
                n = n.astype(np.int64)
                ids.append(self.pool[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                parts_n.append(n)
            n = np.concatenate(parts_n)
            upto = np.concatenate([[0], np.cumsum(n)])[first]
            flat = np.insert(np.concatenate(ids) if ids else np.zeros(0, self.kind), upto[1:], end)
            sizes = np.diff(upto) + 1
            if whole:
                texts = np.split(flat, np.cumsum(sizes)[:-1])
                for i in whole:
                    texts[i] = np.append(self.whole([column[row + i].as_py()])[0], end).astype(self.kind)
                sizes, flat = np.array([len(x) for x in texts]), np.concatenate(texts)
            yield sizes, flat.astype(self.kind)

    def _suspect(self, data: np.ndarray) -> bool:
        raw = data.tobytes()
        return any(s in raw for s in self.special)


_encoders: dict[str, Encoder] = {}


def encoder_of(config: str) -> Encoder:
    """The worker's own encoder, kept from task to task for the words that it knows."""
    if config not in _encoders:
        _encoders.clear()
        _encoders[config] = Encoder(config)
    return _encoders[config]


def _encode(config, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(config.value)
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            row = 0
            for sizes, flat in encoder(column["text"], end):
                offsets = np.concatenate([[0], np.cumsum(sizes)]) * encoder.kind.itemsize
                ids = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                keys = [column[n].slice(row, len(sizes)) for n in ("_key", "_id")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes, pa.int64()), ids], ["_key", "_id", "size", "ids"])
                row += len(sizes)

    return encode


def _count(kind: str, vocabulary: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bincount a batch, over the column's bytes."""
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            if len(column):
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                total += np.bincount(np.frombuffer(data.tobytes(), kind), minlength=vocabulary)
        bytetext.release()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return count


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that go to the same range, as one compressed row."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        where = batch.column(at["_range"]).to_numpy(zero_copy_only=False)
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order])) + 1
        rows = []
        for rows_of in np.split(order, cuts) if len(order) else []:
            part = batch.take(pa.array(rows_of))
            head = np.column_stack([part.column(at[n]).to_numpy(zero_copy_only=False) for n in ("_key", "_id", "size")]).astype("<i8").tobytes()
            rows.append((int(where[rows_of[0]]), len(rows_of), press.compress(head + b"".join(part.column(at["ids"]).to_pylist()))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["range", "rows", "pack"])
    bytetext.release()


SEGMENTS = "range long, segment long, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _code(kind: str, shared, segment: int):
    """Packs, sorted by range, as coded segments."""
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(number: int, packs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            press = zstandard.ZstdDecompressor()
            heads, bodies = [], []
            for rows, pack in packs:
                raw = press.decompress(pack)
                heads.append(np.frombuffer(raw, "<i8", 3 * rows).reshape(-1, 3))
                bodies.append(np.frombuffer(raw, kind, offset=24 * rows))
            head, body = np.concatenate(heads), np.concatenate(bodies)
            ends = np.cumsum(head[:, 2])
            order = np.lexsort((head[:, 1], head[:, 0]))
            sizes = head[order, 2]
            before = np.concatenate([[0], np.cumsum(sizes)])
            row = first = count = 0
            while row < len(order):
                last = max(row + 1, int(np.searchsorted(before, before[row] + segment, "left")))
                last = min(last, len(order))
                ids = np.concatenate([body[ends[i] - head[i, 2] : ends[i]] for i in order[row:last]]).astype(np.uint32)
                docs = [None if k == _LAST else int(k) for k in head[order[row:last], 0]]
                values = [number, count, first, len(ids), docs, sizes[row:last].tolist(), rans.encode(ids, shared.value)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)
                first, count, row = first + len(ids), count + 1, last
            bytetext.release()

        now, packs = None, []
        for batch in batches:
            for number, rows, pack in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number != now and packs:
                    yield from finish(now, packs)
                    packs = []
                now = number
                packs.append((rows, pack))
        if packs:
            yield from finish(now, packs)

    return code


def write(docs: DataFrame, config: str, path: str, *, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Encode docs (doc_id, text) with the tokenizer of that JSON and write the container at path."""
    spark = docs.sparkSession
    common.small_batches(spark)
    encoder = Encoder(config, slots=1)
    kind, vocabulary = encoder.kind.str, max(end_id + 1, encoder.tokenizer.get_vocab_size(with_added_tokens=True))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_key"), F.monotonically_increasing_id().alias("_id"), "text")
    encoded = common.saved(rows.mapInArrow(_encode(spark.sparkContext.broadcast(config), end_id), "_key long, _id long, size long, ids binary"))
    counts = np.zeros(vocabulary, dtype=np.int64)
    found = encoded.select("ids").mapInArrow(_count(kind, vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for i, n in found.collect():  # a row an id of the vocabulary
        counts[i] = n
    table = rans.Frequencies(counts)
    total = int(counts.sum())
    parts = common.parallelism(spark)
    ranges = max(4 * parts, total // RANGE_IDS)
    step = max(1.0, total / ranges / 16)
    chance = F.shiftrightunsigned(F.xxhash64("_key", "_id"), 11) / F.lit(float(1 << 53))
    sample = encoded.filter(chance < F.col("size") / F.lit(step)).select("_key", "_id", F.greatest(F.col("size").cast("double"), F.lit(step)))
    splitters = _splitters(sample.collect(), ranges)  # 16 a range are drawn
    assign = _assign(splitters, ("_key", "_id"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both steps in one worker."""
        yield from _pack(assign(batches))

    packs = encoded.mapInArrow(deal, "range long, rows long, pack binary").repartition(parts, "range").sortWithinPartitions("range")
    coded = packs.mapInArrow(_code(kind, spark.sparkContext.broadcast(table), segment), SEGMENTS)
    coded.write.option("compression", "uncompressed").parquet(f"{path}/segments")
    known = [(int(i), int(table.freq[i])) for i in np.flatnonzero(table.freq)]
    spark.createDataFrame([(vocabulary, known)], "vocabulary long, freq array<struct<id: long, parts: long>>").coalesce(1).write.parquet(f"{path}/frequencies")


def read_frequencies(spark: SparkSession, path: str) -> rans.Frequencies:
    row = spark.read.parquet(f"{path}/frequencies").first()
    counts = np.zeros(row["vocabulary"], dtype=np.int64)
    for i, n in row["freq"]:
        counts[i] = n
    return rans.Frequencies(counts)


def _decode(shared, with_ids: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, first, docs, lengths, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = rans.decode(payload, shared.value).astype("<u4")
                at = np.concatenate([[0], np.cumsum(lengths)])
                parts = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [
                    pa.array(docs, pa.int64()), pa.array(np.full(len(docs), number)), pa.array(first + at[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())
                ]
                names = ["doc_id", "range", "_at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
            bytetext.release()

    return decode


def read(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """The container's documents: doc_id, start, n_tokens, ids_crc32, and ids on demand; every block is verified."""
    table = spark.sparkContext.broadcast(read_frequencies(spark, path))
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    schema = "doc_id long, range long, _at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = segments.select("range", "first", "doc_ids", "lengths", "payload").mapInArrow(_decode(table, with_ids), schema)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = segments.groupBy("range").agg(F.sum("n_ids").alias("_n")).select("range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = docs.join(F.broadcast(starts), "range")
    return out.select("doc_id", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def default_config() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def round_trip(docs: DataFrame, *, config: str | None = None, path: str | None = None) -> DataFrame:
    """Write the container in the shared folder and read it back."""
    spark = docs.sparkSession
    path = path or f"{common.scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, config or default_config(), path)
    return read(spark, path)
