"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of a whole text alone: shares of classes of bytes, lengths of words and lines, repetition.
The trees are fitted on at most TRAIN_ROWS labelled documents (a documented bound; those with the least hashes of doc_id),
then flattened into arrays; a document is scored by walking all trees at once, a level a step, in numpy.

Defined results: a null text counts as empty, and empty texts get the score of their statistics, which are zeros; a null
doc_id is the empty text where its checksum is taken; of repeated labels of a doc_id the least counts, of repeated documents
the one whose text has the least hash; without labels,
or with one kind of label only, every score is the (smoothed) share of good labels, 0.5 if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext, common

#: Labelled documents that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.2

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_HIGH = np.arange(256) >= 128
_PUNCT = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_VOWEL = np.isin(np.arange(256), np.frombuffer(b"aeiouyAEIOUY", np.uint8))
_MARKS = [np.arange(256) == ord(c) for c in "|!?%$&*#.,;:-_=+<>/\\@\"'()[]{}~^`"]
_CLASSES = np.stack([_LETTER, _UPPER, _DIGIT, _HIGH, _PUNCT, _VOWEL, bytetext.BLANK, *_MARKS]).astype(np.float64).T

NAMES = [
    *("letters", "upper", "digits", "high", "punct", "vowels", "blank"), *(f"mark_{i}" for i in range(len(_MARKS))),
    *("log_bytes", "log_words", "word_mean", "word_sd", "word_max", "long_words", "capital_words", "marked_words", "distinct", "commonest", "line_mean", "lines_per_word", "repeated_lines", "entropy"),
]
_END = np.array([b in b"!%$&*#|?" for b in range(256)])


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    counts = np.bincount(owner * 256 + data, minlength=rows * 256).reshape(rows, 256).astype(np.float64)
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    starts, ends, first = bytetext.word_spans(~bytetext.BLANK[data], offsets)
    n = np.diff(first).astype(np.float64)
    some = np.maximum(n, 1)
    of = np.repeat(np.arange(rows), np.diff(first))
    length = (ends - starts).astype(np.float64)

    def per_word(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=x, minlength=rows) / some

    mean = per_word(length)
    sd = np.sqrt(np.maximum(per_word(length**2) - mean**2, 0))
    longest = np.zeros(rows)
    np.maximum.at(longest, of, length)
    # A word's hash with its document in the high bits' place: distinct words and the commonest one
    key = bytetext.word_hashes(bytetext.LOWER[data], starts, ends)
    order = np.lexsort((key, of))
    k, o = key[order], of[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    distinct = np.bincount(o[at], minlength=rows) / some
    runs = np.diff(np.append(at, len(k)))
    commonest = np.zeros(rows)
    np.maximum.at(commonest, o[at], runs)
    s, e, f = bytetext.word_spans(data != 10, offsets)
    lines = np.diff(f).astype(np.float64)
    line_of = np.repeat(np.arange(rows), np.diff(f))
    line_key = bytetext.word_hashes(data, s, e)
    order = np.lexsort((line_key, line_of))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (line_key[order][1:] == line_key[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    repeated = np.bincount(line_of[order], weights=same, minlength=rows) / np.maximum(lines, 1)
    columns = [
        np.log1p(size), np.log1p(n), mean, sd, longest, per_word(length > 20), per_word(_UPPER[data[starts]]), per_word(_END[data[ends - 1]]), distinct, commonest / some,
        size / np.maximum(lines, 1), lines / some, repeated, entropy,
    ]
    return np.column_stack([share @ _CLASSES, *columns]).astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node i has the children 2 i + 1 and 2 i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; greater goes right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base, dtype=np.float64)
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.threshold[t][node])
            total += self.leaf[t][node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = 1.0) -> Trees:
    """Logistic loss, Newton leaves, splits from histograms of gradients over quantile bins."""
    inner = (1 << depth) - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(features)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    flat = binned + np.arange(features) * bins
    raw = np.full(len(y), base)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.full(inner, bins, np.int64)
        for level in range(depth):
            start, width = (1 << level) - 1, 1 << level
            at = ((node - start)[:, None] * (features * bins) + flat).ravel()
            size = width * features * bins
            sum_g = np.bincount(at, np.repeat(g, features), size).reshape(width, features, bins).cumsum(axis=2)
            sum_h = np.bincount(at, np.repeat(h, features), size).reshape(width, features, bins).cumsum(axis=2)
            all_g, all_h = sum_g[:, :1, -1:], sum_h[:, :1, -1:]
            gain = sum_g**2 / (sum_h + ridge) + (all_g - sum_g) ** 2 / (all_h - sum_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(sum_h < 1) | (all_h - sum_h < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                f, b = divmod(int(best[i]), bins)
                if gain[i, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[start + i], threshold[start + i], cut[start + i] = f, cuts[f][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw += value[leaf]
        out_f.append(feature), out_t.append(threshold), out_v.append(value)
    return Trees(base, np.array(out_f), np.array(out_t), np.array(out_v))


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "utf-8")) % 3 == 1


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        for a, b, data, offsets in bytetext.batches(text):
            x = statistics(data, offsets)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            own = [batch.column(batch.schema.get_field_index(n)).slice(a, b - a) for n in ("doc_id", "label", "h")]
            yield pa.RecordBatch.from_arrays([*own, flat], ["doc_id", "label", "h", "x"])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fit on labelled documents that aren't held out; on at most so many rows, one a doc_id."""
    common.small_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most rows of them
    # Measured first, so that no text is moved; then one row a doc_id
    order = F.xxhash64(common.text_of())
    measured = chosen.select("doc_id", "label", order.alias("h"), "text").mapInArrow(_measure, "doc_id long, label int, h long, x array<float>")
    found = measured.groupBy("doc_id").agg(F.min_by(F.struct("label", "x"), "h").alias("r")).orderBy("doc_id").select("r.label", "r.x").toArrow()
    x = np.asarray(found["x"].combine_chunks().flatten(), dtype=np.float32).reshape(-1, len(NAMES))
    return fit(x, np.asarray(found["label"], dtype=np.float64))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5)."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for a, b, data, offsets in bytetext.batches(text):
                p = shared.value.score(statistics(data, offsets))
                rest = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    rest = docs.drop("score", "predicted")
    return rest.mapInArrow(add, T.StructType([*rest.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
