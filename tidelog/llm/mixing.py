"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are put in the order of (key, doc_id), cut into bins
of that order, and a prefix sum of word counts runs over bins and then within each bin. A source's budget is taken from
the front of its order: whole epochs first, then the documents before the cut, and from the document on the cut as many
words as are left, so a budget is met to the word.

Defined results: a null text has size 0; a null source is a source of its own, the last; a source without words gets
target 0; null doc_ids come last; rows that agree in doc_id and size are interchangeable; an empty table gives an empty one.
Columns of the input with the name of a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """60 hash-random bits as a long; md5, so that any engine can repeat the order. Without a doc_id the text stands in for it."""
    hexed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))))
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, source_size) with target: share x all words by weight, no source above epochs x its own size.

    What capped sources leave is reshared by weight among the others. That ends at one level: a source's target is
    min(weight x level, cap). Sorted by cap / weight, the level is the first share by weight that its source can take.
    """
    ranked = common.running_total(sources, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    filled = common.running_total(ranked, [F.col("ratio"), F.col("rank")], caps=F.col("cap"), used=F.col("weight"))
    level = (F.lit(share * total) - F.col("caps")) / (F.lit(weight) - F.col("used"))
    first = filled.withColumn("level", level).filter("ratio >= level").agg(F.min_by("level", F.struct("ratio", "rank"))).first()[0]
    cap = F.col("cap").cast("double")
    target = cap if first is None else F.least(F.col("weight") * F.lit(first), cap)
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    carry: columns of docs that come along, as fields of the struct _own.
    """
    parts = common.parallelism(docs.sparkSession)
    bins = 4 * parts
    own = [F.struct(*(F.col(c) for c in carry)).alias("_own")] if carry else []
    rows = docs.select("doc_id", "source", *own, words(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("text"), seed).alias("_key"))
    rows = rows.withColumn("_bin", F.shiftright(F.shiftright("_key", 29) * bins, 31))
    if not carry:  # a few numbers a document, written once, so that texts are read and counted once
        rows = common.saved(rows)
    # At most 4 x partitions bins a source: what a hot source is cut into.
    binned = common.saved(rows.groupBy("source", "_bin").agg(F.sum("size").alias("_words")))
    goals = targets(binned.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, epochs)
    before = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    placed = placed.join(goals, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "_bin").orderBy(F.col("_key"), F.col("doc_id").asc_nulls_last(), F.col("size")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(placed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b")))
    out = out.withColumn("_before", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    full = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0))
    left = F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_before")))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (full * F.col("size") + part).cast("long").alias("taken"), *(["_own"] if carry else [])
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each time that a document is taken; the last may be cut after a word.

    A document without words takes no part of a budget and is kept once if its source is taken at all.
    """
    names = docs.columns
    plan = mix(docs, carry=tuple(names), **options)
    # size 0: nothing to count; kept as it is
    times = F.when(F.col("size") == 0, F.when(F.col("target") > 0, 1).otherwise(0)).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    rows = plan.withColumn("_n", times).filter("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    left = F.col("taken") - (F.col("_i") - 1) * F.col("size")
    whole = (F.col("size") == 0) | (left >= F.col("size"))
    own = {c: F.col("_own").getField(c) for c in names}
    fresh = {"text": F.when(whole, own["text"]).otherwise(_first_words(own["text"], left))}
    if "n_chars" in names:
        fresh["n_chars"] = F.when(whole, own["n_chars"]).otherwise(F.length(fresh["text"])).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(fresh.get(c, own[c]).alias(c) for c in names))


def _first_words(text: Column, n: Column) -> Column:
    """The first n words, joined by a blank; only documents on a cut come here, one a source."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), 1, F.greatest(n, F.lit(0)).cast("int")), " ")
