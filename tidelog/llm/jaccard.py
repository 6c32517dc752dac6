"""N-gram Jaccard join: all links of similarity 0.8 or more between sets of 5-word shingles, as components.

Equal sets form a class, and classes are joined, so copies cost nothing. Three exact filters, none of which can lose a
link, bring the classes that may be linked together; then a T-occurrence search finds the links.

1. Each class sends its K(n) least shingle hashes, about 0.4 n of n. Two linked classes share at least L of them, where
   L is about 0.2 n: what lies outside is at most n - K(n), and the overlap is at least 0.8 n.
2. Where hashes meet, those that one class alone has are dropped. A class with fewer than L others has no link.
3. The rest of a class is ordered by frequency, rarest first; two linked classes share one of the first few (prefix
   filter), so classes that share none of those never meet. Components of "share one" hold all links.

In a task, an inverted index is searched for each class with DivideSkip: short lists are merged and counted, the longest
are only probed by binary search for what may still reach the required overlap. The search reaches out to similarity
0.6: by the triangle inequality of the Jaccard distance, a class x near the searched q, with no class in the ring
between them, can have no link outside, so it is never searched itself. Large groups of near copies take one search.

Hot keys never meet in one task. Hashes that at least one in HOT_PARTS classes sends are found by counts that each batch
takes of its frequent ones; they are at most HOT_PARTS times the mean number sent, are broadcast, count as the most frequent,
and need not meet. Classes of as many copies, at most HOT_PARTS, send from one batch only. Where classes are gathered,
a task links those that share a hash and sends on one of them for each hash.

Components beyond TIGHT shingles are first reduced in rounds: their shingles are compared with a few leaders each, and what
the triangle inequality closes around a leader is linked to it and leaves. Components beyond SPLIT are cut into blocks, up to
BLOCKS of them, or as many as it takes for a pair to hold no more than GROUP, and each pair of blocks is searched by itself.
Links meet in a distributed search for components.

Defined results: null and wordless texts have size 0 and no link, component_id is their own doc_id; texts with fewer than
five words are one shingle; equal rows are linked (their sets are equal); null doc_ids are never a component_id unless all
are null. Shingles are compared by 64 bits; the filters go by 48 of them, which can only let more classes meet. Classes are
named by 64 bits and checked by 64 others; names that unlike sets share are told apart by both, in a second signing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext, common
from .components import Forest, connected_components

WORDS = 5
#: Shingles that one task searches at once.
GROUP = 1 << 22
#: Shingles of a candidate component from which on it is reduced first, all tasks working on it.
TIGHT = 1 << 22
#: Shingles from which on a component is dealt to several tasks, as pairs of at most so many blocks, while a pair keeps GROUP.
SPLIT, BLOCKS = 1 << 19, 4
#: Small components are searched together until they have so many shingles.
TOGETHER = 1 << 19
#: Classes that a hash or copies that a class must have, at least, to be hot.
HOT = 64
#: Rounds that reduce large components, components in a round, leaders of each, and shingles that a leader may have.
ROUNDS, LARGEST, LEADERS, LEADER_SIZE = 8, 64, 4, 1 << 16
#: Weight of a binary search against a merge step, in DivideSkip.
MU = 0.0085


def _least_overlap(n: np.ndarray) -> np.ndarray:
    """Of n shingles, at least so many are shared with a linked class."""
    return (4 * n + 4) // 5


def _shared(n: np.ndarray) -> np.ndarray:
    return np.minimum(_least_overlap(n), (n + 4) // 5)


def _sent(n: np.ndarray) -> np.ndarray:
    """K(n)."""
    return n - _least_overlap(n) + _shared(n)


def _needed(n: np.ndarray) -> np.ndarray:
    """What any linked class of at least 0.8 n shingles shares of those sent."""
    return _shared(_least_overlap(n))


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in bytetext.batches(column):
        data = bytetext.LOWER[data]
        starts, ends, first = bytetext.word_spans(~bytetext.BLANK[data], offsets)
        hashes = bytetext.word_hashes(data, starts, ends)
        grams = bytetext.windows(hashes, words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield bytetext.windows(hashes[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


#: By rule: what the hashes of a set are mixed with for its class and for the check of the class.
_SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


@dataclass(frozen=True)
class Classes:
    """Names of sets: 64 bits, and 64 others as a check. Names that sets with unlike checks share are clashing; there both count."""

    bits: int = 64
    clashing: frozenset[int] = frozenset()

    def of(self, hashes: np.ndarray) -> tuple[int, int]:
        if not len(hashes):
            return 0, 0
        sums = np.array([bytetext.mix64(hashes ^ np.uint64(salt)).sum(dtype=np.uint64) for salt in _SALTS]) + np.uint64(len(hashes))
        name, check = bytetext.mix64(sums)
        name >>= np.uint64(64 - self.bits)
        if int(name.astype(np.int64)) in self.clashing:
            name = bytetext.mix64(np.array([name ^ check]))[0]
        return int(name.astype(np.int64)), int(check.astype(np.int64))


def targets(spark: SparkSession, parts: int) -> list[int]:
    """parts integers, each of which a shuffle to parts partitions sends to another partition."""
    found: dict[int, int] = {}
    n = 16 * parts
    while len(found) < parts:
        for i, p in spark.range(n).select("id", F.pmod(F.hash("id"), F.lit(parts))).collect():
            found.setdefault(p, i)
        n *= 4
    return [found[p] for p in range(parts)]


def _batch(schema: str, *values) -> pa.RecordBatch:
    """One row in a schema of longs and binaries."""
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if t == "long" else pa.binary()) for v, (_, t) in zip(values, fields, strict=True)], [n for n, _ in fields])


_FIRST = "doc_id long, n long, cid long, check long, batch long, target long, cids binary, ns binary, counts binary, hashes binary"
#: Targets of rows that aren't packs of hashes.
_DOCUMENTS, _FREQUENT = -2, -1


def _unpack(raw: bytes | np.ndarray) -> np.ndarray:
    """Hashes of 48 bits, which are enough to filter."""
    flat = np.frombuffer(raw, np.uint8)
    wide = np.zeros((len(flat) // 6, 8), np.uint8)
    wide[:, :6] = flat.reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.uint64)


def _packed(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _packs(goals: list[int], batch: int, hashes: np.ndarray, owner: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each target: its hashes, in the order of their classes."""
    goal = (hashes % np.uint64(len(goals))).astype(np.uint16 if len(goals) < 1 << 16 else np.uint32)
    order = np.argsort(goal, kind="stable")
    cuts = np.searchsorted(goal[order], np.arange(len(goals) + 1))
    for g in np.flatnonzero(np.diff(cuts)):
        rows = order[cuts[g] : cuts[g + 1]]
        who, count = np.unique(owner[rows], return_counts=True)
        yield _batch(_FIRST, None, None, None, None, batch, goals[g], known[who].tobytes(), sizes[who].astype("<u4").tobytes(), count.astype("<u4").tobytes(), _packed(hashes[rows]))


def _sign(goals: list[int], words: int, names_of: Classes):
    """A row for each document; for each batch and target packed hashes of its classes, and its frequent hashes."""
    names = [c.split()[0] for c in _FIRST.split(", ")]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            if not len(ids):
                continue
            number = batch.column(batch.schema.get_field_index("_row"))[0].as_py()
            ns, cids, checks, sent, seen = [], [], [], [], {}
            for found in shingle_sets(batch.column(batch.schema.get_field_index("text")), words):
                n, (cid, check) = len(found), names_of.of(found)
                ns.append(n)
                cids.append(cid)
                checks.append(check)
                if n and cid not in seen:
                    seen[cid] = n
                    sent.append(found[: int(_sent(np.int64(n)))] >> np.uint64(16))
            fixed = [pa.array(np.full(len(ids), x), pa.int64()) for x in (number, _DOCUMENTS)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (ns, cids, checks)), *fixed, *(pa.nulls(len(ids), pa.binary()) for _ in range(4))], names)
            if not sent:
                continue
            hashes, owner = np.concatenate(sent), np.repeat(np.arange(len(sent), dtype=np.uint32), [len(x) for x in sent])
            known, sizes = np.fromiter(seen, np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen))
            yield from _packs(goals, number, hashes, owner, known, sizes)
            # What one in HOT_PARTS of all classes sends, so does one in HOT_PARTS of some batch's.
            once = np.sort(hashes)
            at = np.flatnonzero(np.concatenate([[True], once[1:] != once[:-1]]))
            times = np.diff(np.append(at, len(once)))
            often = times >= max(2, len(sent) // common.HOT_PARTS)
            if often.any():
                yield _batch(_FIRST, None, None, None, None, number, _FREQUENT, None, None, times[often].astype("<u4").tobytes(), once[at[often]].tobytes())

    return sign


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, times = _gather(batches, {"hashes": np.int64, "counts": np.uint32})
    found, which = np.unique(hashes, return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(which, times, len(found)).astype(np.int64))], ["h", "n"])


def _route(shared, goals: list[int], hot: bool):
    """Packs without hot hashes, and without hot classes but from the batch that sends them; or (hot) the hot hashes alone."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes, senders = shared.value
        for batch in batches:
            for number, target, cids, ns, counts, raw in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("batch", "target", "cids", "ns", "counts", "hashes")), strict=True):
                known, sizes, count, hashes = np.frombuffer(cids, np.int64), np.frombuffer(ns, np.uint32), np.frombuffer(counts, np.uint32), _unpack(raw)
                sends = np.ones(len(known), dtype=bool)
                if len(classes):
                    place = np.minimum(np.searchsorted(classes, known), len(classes) - 1)
                    sends = (classes[place] != known) | (senders[place] == number)
                owner = np.repeat(np.arange(len(known)), count)
                often = np.zeros(len(hashes), dtype=bool)
                if len(frequent):
                    often = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
                rows = np.flatnonzero((often == hot) & sends[owner])
                if not len(rows):
                    continue
                if hot:
                    yield from _send(goals, known[owner[rows]], sizes[owner[rows]], hashes[rows], np.full(len(rows), 0xFFFFFFFF, np.uint32), known[owner[rows]])
                elif len(rows) == len(hashes):
                    yield _batch(_FIRST, None, None, None, None, number, target, cids, ns, counts, raw)
                else:
                    who, left = np.unique(owner[rows], return_counts=True)
                    yield _batch(_FIRST, None, None, None, None, number, target, known[who].tobytes(), sizes[who].tobytes(), left.astype("<u4").tobytes(), _packed(hashes[rows]))

    return route


_MEET = "target long, cids binary, ns binary, hashes binary, dfs binary"


def _column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _send(goals: list[int], cids, ns, hashes, dfs, by) -> Iterator[pa.RecordBatch]:
    goal = (by.astype(np.uint64) % np.uint64(len(goals))).astype(np.int64)
    order = np.argsort(goal, kind="stable")
    cuts = np.searchsorted(goal[order], np.arange(len(goals) + 1))
    for g in np.flatnonzero(np.diff(cuts)):
        rows = order[cuts[g] : cuts[g + 1]]
        yield _batch(_MEET, goals[g], cids[rows].tobytes(), ns[rows].tobytes(), hashes[rows].tobytes(), dfs[rows].tobytes())


def _gather(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> list[np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {n: [] for n in kinds}
    for batch in batches:
        for n, kind in kinds.items():
            parts[n] += [np.frombuffer(x, kind) for x in _column(batch, n)]
    return [np.concatenate(p) if p else np.zeros(0, kinds[n]) for n, p in parts.items()]


def _meet(goals: list[int]):
    """Filter 2, where hashes meet: those of two classes or more go on to where their class is gathered."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, ns, counts, raw = _gather(batches, {"cids": np.int64, "ns": np.uint32, "counts": np.uint32, "hashes": np.uint8})
        if not len(cids):
            return
        hashes = _unpack(raw)
        cids, ns = np.repeat(cids, counts), np.repeat(ns, counts)
        order = np.lexsort((cids, hashes))
        h, c, n = hashes[order], cids[order], ns[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])  # a class of several batches comes several times
        h, c, n = h[new], c[new], n[new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.diff(np.append(start, len(h)))
        df = np.repeat(df, df)
        keep = df > 1
        yield from _send(goals, c[keep], n[keep], h[keep], df[keep].astype(np.uint32), c[keep])
        bytetext.release()

    return meet


_NONE = np.zeros(0, np.int64)
_LINKED = "target long, a binary, b binary, cids binary, hashes binary"


def _prefix(goals: list[int]):
    """Filters 2 and 3, where a class is gathered. Classes of the task that share one of their rarest hashes are linked
    here; for each hash one of them goes to where hashes meet."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, ns, hashes, dfs = _gather(batches, {"cids": np.int64, "ns": np.uint32, "hashes": np.uint64, "dfs": np.uint32})
        order = np.lexsort((hashes, dfs, cids))
        c, n, h = cids[order], ns[order].astype(np.int64), hashes[order]
        if not len(c):
            return
        new = np.ones(len(c), dtype=bool)
        new[1:] = (c[1:] != c[:-1]) | (h[1:] != h[:-1])  # hot hashes come from each batch that has the class
        c, n, h = c[new], n[new], h[new]
        start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        count = np.diff(np.append(start, len(c)))
        rank = np.arange(len(c)) - np.repeat(start, count)
        count = np.repeat(count, count)
        keep = (rank < count - _needed(n) + 1) & (count >= _needed(n))
        links, (who, what) = _forest(c[keep], h[keep])
        yield _batch(_LINKED, goals[int(cids[0]) % len(goals)], links[0].tobytes(), links[1].tobytes(), b"", b"")
        goal = (what % np.uint64(len(goals))).astype(np.int64)
        order = np.argsort(goal, kind="stable")
        cuts = np.searchsorted(goal[order], np.arange(len(goals) + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[g] : cuts[g + 1]]
            yield _batch(_LINKED, goals[g], b"", b"", who[rows].tobytes(), what[rows].tobytes())
        bytetext.release()

    return prefix


def _forest(cids: np.ndarray, hashes: np.ndarray, a: np.ndarray = _NONE, b: np.ndarray = _NONE) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of "share a hash" and of links (a, b); and for each hash one of its classes."""
    nodes, at = np.unique(np.concatenate([cids, a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    order = np.argsort(hashes, kind="stable")
    h, x = hashes[order], at[: len(cids)][order]
    same = np.flatnonzero(h[1:] == h[:-1])
    for i, j in np.unique(np.column_stack([x[same], x[same + 1]]), axis=0).tolist():
        forest.union(i, j)
    for i, j in zip(at[len(cids) : len(cids) + len(a)].tolist(), at[len(cids) + len(a) :].tolist(), strict=True):
        forest.union(i, j)
    roots = forest.roots()
    other = np.flatnonzero(roots != np.arange(len(nodes)))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return (nodes[other], nodes[roots[other]]), (cids[order][first], h[first])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is linked in a partition, as a spanning forest."""
    cids, hashes, a, b = _gather(batches, {"cids": np.int64, "hashes": np.uint64, "a": np.int64, "b": np.int64})
    links, _ = _forest(cids, hashes, a, b)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in links], ["a", "b"])


class Index:
    """An inverted index over sets, searched for T occurrences with DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int64), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.posts = owner[order]
        new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
        self.start = np.append(np.flatnonzero(new), len(flat))
        number = np.empty(len(flat), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.number = number

    def search(self, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets other than q that share at least so many elements with it, and how many."""
        lists = self.number[self.first[q] : self.first[q + 1]]
        begin, end = self.start[lists], self.start[lists + 1]
        length = end - begin
        several = length > 1
        begin, end, length = begin[several], end[several], length[several]
        if len(length) < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(length, kind="stable")
        longs = min(least - 1, int(least / (MU * np.log2(max(2, int(length.max()))) + 1)))
        short, long = order[: len(order) - longs], order[len(order) - longs :]
        merged = np.sort(np.concatenate([self.posts[begin[i] : end[i]] for i in short.tolist()]), kind="stable")
        at = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[at], np.diff(np.append(at, len(merged)))
        keep = (count >= least - longs) & (found != q)
        found, count = found[keep], count[keep]
        for left, i in zip(range(len(long), 0, -1), long.tolist(), strict=True):
            if not len(found):
                break
            posts = self.posts[begin[i] : end[i]]
            place = np.minimum(np.searchsorted(posts, found), len(posts) - 1)
            count = count + (posts[place] == found)
            if left % 16 == 0:
                keep = count >= least - left + 1
                found, count = found[keep], count[keep]
        keep = count >= least
        return found[keep], count[keep]


def link(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least number in its component of links of similarity 0.8 or more."""
    forest = Forest(len(sets))
    if len(sets) < 2:
        return forest.roots()
    index = Index(sets)
    closed = np.zeros(len(sets), dtype=bool)
    for q in range(len(sets)):
        if closed[q]:
            continue
        n = int(index.sizes[q])
        found, shared = index.search(q, max(1, -(-3 * n // 5)))
        either = n + index.sizes[found] - shared
        near = 5 * shared >= 4 * either
        for j in found[near].tolist():
            forest.union(q, j)
        alike = shared / either
        ring = alike[~near]
        outer = ring.max() if len(ring) else 0.0
        closed[found[near & (alike - 0.2 > outer + 1e-9)]] = True
    return forest.roots()


_SETS = "cid long, n long, hashes binary"


def _sets(words: int, names_of: Classes):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {}
            for found in shingle_sets(batch.column(batch.schema.get_field_index("text")), words):
                if len(found):
                    rows[names_of.of(found)[0]] = found
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.int64()), pa.array([len(r) for r in rows.values()], pa.int64()), pa.array([r.tobytes() for r in rows.values()], pa.binary())], ["cid", "n", "hashes"]
            )

    return sets


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, cid, hashes) sorted by block, as links (a, b) of a spanning forest; blocks are searched whole."""

    def finish(rows: dict[int, bytes]) -> pa.RecordBatch:
        cids = np.fromiter(rows, np.int64, len(rows))
        roots = link([np.frombuffer(x, np.uint64) for x in rows.values()])
        return pa.RecordBatch.from_arrays([pa.array(cids), pa.array(cids[roots])], ["a", "b"])

    rows: dict[int, bytes] = {}
    size, last = 0, None
    for batch in batches:
        for block, cid, raw in zip(_column(batch, "block"), _column(batch, "cid"), _column(batch, "hashes"), strict=True):
            if block != last and size >= TOGETHER:
                yield finish(rows)
                rows, size = {}, 0
            last = block
            if cid not in rows:
                rows[cid] = raw
                size += len(raw) // 8
    if rows:
        yield finish(rows)
    bytetext.release()


def _against(shared):
    """Rows (comp, cid, hashes) against their component's leaders: those with similarity 0.6 or more."""

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for comp, cid, raw in zip(_column(batch, "comp"), _column(batch, "cid"), _column(batch, "hashes"), strict=True):
                mine = np.frombuffer(raw, np.uint64)
                for leader, other in shared.value.get(comp, ()):
                    common_ = len(np.intersect1d(mine, other, assume_unique=True))
                    either = len(mine) + len(other) - common_
                    if 10 * common_ >= 6 * either:
                        out.append((cid, leader, 5 * common_ >= 4 * either, common_ / either))
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["cid", "leader", "near", "alike"])

    return against


def _sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("comp").agg(F.sum("n").alias("_size"), F.count("*").alias("_rows"))


def _reduce(large: DataFrame, tight: int) -> tuple[DataFrame, list[DataFrame]]:
    """Take from large components (comp, cid, n, hashes) what leaders close, in rounds; the rest, and links (a, b) found."""
    links: list[DataFrame] = []
    spark = large.sparkSession
    for turn in range(ROUNDS):
        top = _sizes(large).filter(F.col("_size") > tight).orderBy(F.col("_size").desc()).limit(LARGEST).collect()
        if not top:
            break
        chosen = spark.createDataFrame([(r["comp"],) for r in top], "comp long")
        mine = large.join(F.broadcast(chosen), "comp")
        order = Window.partitionBy("comp").orderBy(F.xxhash64("cid", F.lit(turn)), "cid")
        leaders: dict[int, list] = {}
        picked = mine.filter(F.col("n") <= LEADER_SIZE).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= LEADERS)
        for r in picked.select("comp", "cid", "hashes").collect():  # at most LARGEST x LEADERS sets of bounded size
            leaders.setdefault(r["comp"], []).append((r["cid"], np.frombuffer(bytes(r["hashes"]), np.uint64)))
        found = mine.select("comp", "cid", "hashes").mapInArrow(_against(spark.sparkContext.broadcast(leaders)), "cid long, leader long, near boolean, alike double")
        found = common.saved(found)
        ring = found.groupBy("leader").agg(F.coalesce(F.max(F.when(~F.col("near"), F.col("alike"))), F.lit(0.0)).alias("ring"))
        near = found.filter("near").join(F.broadcast(ring), "leader")  # a row a leader
        links.append(common.saved(near.select(F.col("cid").alias("a"), F.col("leader").alias("b"))))
        closed = common.saved(near.filter("alike - 0.2 > ring + 1e-9").select("cid").distinct())
        gone = closed.count()
        large = common.saved(large.join(closed, "cid", "left_anti").select("comp", "cid", "n", "hashes"))
        if 10 * gone < sum(r["_rows"] for r in top):
            break
    return large, links


def join(docs: DataFrame, *, words: int = WORDS, group: int = GROUP, tight: int = TIGHT, hot: int = HOT, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (of its set), component_id. bits: of a class's name, fewer in tests."""
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = common.parallelism(spark)
    goals = targets(spark, parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    names_of = Classes(bits)
    while True:
        signed = common.saved(rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(_sign(goals, words, names_of), _FIRST))
        members = signed.filter(F.col("target") == _DOCUMENTS).select("doc_id", "n", "cid", "check", "batch")
        own = [F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.min("batch").alias("batch")]
        classes = common.saved(members.groupBy("cid").agg(*own, F.min("check").alias("_lo"), F.max("check").alias("_hi")))
        # Chance: one name in 4 billion sets, about; so few names come here, and once.
        clashing = frozenset(r["cid"] for r in classes.filter("_lo <> _hi").select("cid").collect())
        if not clashing:
            break
        names_of = replace(names_of, clashing=names_of.clashing | clashing)
    members, classes = members.drop("check"), classes.drop("_lo", "_hi")
    total, n_classes = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()

    counts = signed.filter(F.col("target") == _FREQUENT).select("hashes", "counts").mapInArrow(_frequent, "h long, n long")
    frequent = counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(hot, n_classes // common.HOT_PARTS)).select("h").collect()
    copied = classes.filter((F.col("copies") >= max(hot, total // common.HOT_PARTS)) & (F.col("n") > 0)).select("cid", "batch").orderBy("cid").collect()
    routes = spark.sparkContext.broadcast(
        (np.sort(np.array([r["h"] for r in frequent], dtype=np.int64)).astype(np.uint64), *(np.array([r[k] for r in copied], dtype=np.int64) for k in ("cid", "batch")))
    )
    packed = signed.filter("target >= 0")
    cold = packed.mapInArrow(_route(routes, goals, False), _FIRST).select("target", "cids", "ns", "counts", "hashes")
    met = cold.repartition(parts, "target").mapInArrow(_meet(goals), _MEET)
    if frequent:
        met = met.unionByName(packed.mapInArrow(_route(routes, goals, True), _MEET))
    first = met.repartition(parts, "target").mapInArrow(_prefix(goals), _LINKED)
    edges = first.repartition(parts, "target").mapInArrow(_stars, "a long, b long")
    candidates = connected_components(edges)

    maybe = common.saved(classes.join(candidates, classes["cid"] == candidates["node"]).select("cid", "rep", "n", F.col("root").alias("comp")))
    split = min(SPLIT, tight)
    large = common.saved(_sizes(maybe).filter(F.col("_size") > split).select("comp"))

    def placed_sets(some: DataFrame) -> DataFrame:
        """comp, cid, n, hashes of classes; the few texts that stand for them are read again."""
        wanted = rows.join(common.maybe_broadcast(some.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
        sets = wanted.unionByName(rows.filter("doc_id IS NULL")).mapInArrow(_sets(words, names_of), _SETS)
        return sets.join(common.maybe_broadcast(some.select("cid", "comp")), "cid").select("comp", "cid", "n", "hashes")

    def searched(blocks: DataFrame) -> DataFrame:
        return common.saved(blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_solve, "a long, b long"))

    if large.isEmpty():
        solved = searched(placed_sets(maybe).select(F.col("comp").alias("block"), "cid", "hashes")).select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        own = common.maybe_broadcast(large)
        small = common.saved(maybe.join(own, "comp", "left_anti"))
        rest, found = _reduce(common.saved(placed_sets(common.saved(maybe.join(own, "comp", "left_semi"))).dropDuplicates(["cid"])), tight)
        wanted = F.greatest(F.ceil(F.col("_size") * 2 / group), F.least(F.lit(BLOCKS), F.ceil(F.col("_size") * 2 / split))).cast("int")
        rest = rest.join(common.maybe_broadcast(_sizes(rest).select("comp", F.when(wanted > 2, wanted).otherwise(1).alias("blocks"))), "comp")
        # A class goes to every pair of blocks that has its own: blocks copies of it.
        rest = rest.withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        rest = rest.withColumn("block", F.when(F.col("blocks") == 1, F.col("comp")).otherwise(F.xxhash64("comp", F.least("_own", "_other"), F.greatest("_own", "_other"))))
        every = searched(rest.select("block", "cid", "hashes"))
        for x in found:
            every = every.unionByName(x)
        roots = connected_components(every)
        apart = every.select(F.col("a").alias("node")).union(every.select("b")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        solved = searched(placed_sets(small).select(F.col("comp").alias("block"), "cid", "hashes")).select(F.col("a").alias("node"), F.col("b").alias("root"))
        solved = common.saved(solved.unionByName(apart))
    named = solved.join(maybe.select(F.col("cid").alias("node"), "rep"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root").select(F.col("node").alias("cid"), "least")
    groups = common.saved(classes.join(named, "cid", "left").select("cid", "copies", F.coalesce("least", "rep").alias("component_id")))
    out = common.hot_join(members, groups, "cid", "copies", total)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), component.alias("component_id"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component, the one with the least doc_id, null last; of rows with that doc_id, one."""
    repeated = docs.groupBy(F.col("doc_id").alias("d")).count().filter("count > 1 OR d IS NULL")
    if repeated.isEmpty():
        found = join(docs, **options).filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
        found = common.saved(found)
        return docs.join(common.maybe_broadcast(found), "doc_id", "left_semi").select(*docs.columns)
    # Ranks stand in for doc_ids, which don't tell rows apart here.
    table = common.saved(docs.withColumn("_row", F.monotonically_increasing_id()))
    ranks = common.running_total(table.select("doc_id", "_row"), [F.col("doc_id").asc_nulls_last(), F.col("_row")], _rank=F.lit(1))
    ranks = common.saved(ranks.select("_row", "_rank"))
    ranked = table.select("_row", "text").join(ranks, "_row").select(F.col("_rank").alias("doc_id"), "text")
    found = join(ranked, **options).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_rank"))
    kept = common.saved(ranks.join(found, "_rank").select("_row"))
    return table.join(common.maybe_broadcast(kept), "_row", "left_semi").select(*docs.columns)
