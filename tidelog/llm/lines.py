"""Line dedup by winnowing, in DataFrame operations only.

A text's lines, trimmed, blank ones left out, are a sequence. A run of RUN lines, or of fewer that hold MIN_WORDS words, that occurs
at an earlier place (in the order of doc_id, null last, then place) is repeated, and all its lines are deleted. min_words=None
leaves runs of fewer lines alone.

1. Winnowing: hashes of GRAM lines are fingerprints; each window of RUN lines selects its least one, the last of equals, so
   two equal runs select the same. A shorter run with enough words selects by the same rule, or as a whole. A position that
   several windows select counts once.
2. Positions are joined: fingerprints of one position alone are dropped.
3. Each position that is left is extended, to the left and right, over the lines of the windows that selected it; windows equal
   in all lines, by 128 bits, meet, and the first place stays.
4. Later windows whose lines follow one another as those of the first place do, on one diagonal, are a match extended as far as
   both agree: a maximal run. Its lines are deleted.

Any two equal runs of RUN lines select the same fingerprint at the same line, so no match is lost. Windows are grouped, never
paired: groups shrink to a count and a least place before the shuffle, and keys that many rows share are joined back by a
bounded broadcast (common.hot_join).

Defined results: null and empty texts have no lines; rows with equal doc_id are at one place, and none is earlier; a first place
without doc_id isn't named; an empty table gives an empty one. Columns of the input with the name of a result are replaced, all
others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

RUN, GRAM = 3, 2
#: Words of a run of fewer lines.
MIN_WORDS = 20
_RESULT = ("n_lines", "n_deleted", "deleted", "runs")
_OWN, _KEY = "_lines_own", ["a", "b"]
#: White space in a line that counts as a blank.
BLANKS = ("\t", "\x0b", "\x0c", "\r")


def sequences(docs: DataFrame) -> DataFrame:
    """docs with, of each line that isn't blank, its number _line, two hashes _a and _b, and its words _w."""
    text = common.text_of()
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("x")))
    out = docs.withColumn("_s", F.filter(lines, lambda p: p["x"] != ""))
    return out.withColumns(
        {
            "_n": F.size("_s"),
            "_line": F.col("_s.line"),
            "_a": F.transform("_s", lambda p: F.xxhash64(p["x"], F.length(p["x"]))),
            "_b": F.transform("_s", lambda p: F.xxhash64(F.length(p["x"]), p["x"])),
            "_w": F.transform("_s", lambda p: F.size(F.filter(F.split(p["x"], " "), lambda w: w != ""))),
        }
    ).drop("_s")


def _over(array: str, items: int, first: str = "i") -> str:
    return ", ".join(f"element_at({array}, {first} + {j})" for j in range(items))


def _print(size: int, first: str) -> str:
    return f"xxhash64({size}, {_over('_a', size, first)})"


def _windows(span: int, gram: int, min_words: int | None) -> str:
    """SQL of an array of a window for each start of span lines, with enough words if given: its start (from 0), span, print, and keys.

    The keys stand for all its lines: the selected position, extended to the left and right."""
    starts = f"if(_n < {span}, array(), sequence(1, greatest(1, _n - {span - 1})))"
    if min_words is not None:
        starts = f"filter({starts}, i -> {' + '.join(f'element_at(_w, i + {j})' for j in range(span))} >= {min_words})"
    size = min(gram, span)
    grams = [f"struct({_print(size, f'i + {j}')} AS print, {-j} AS back)" for j in range(span - size + 1)]
    best = grams[0] if len(grams) == 1 else f"least({', '.join(grams)})"
    keys = ", ".join(f"xxhash64({span}, {_over(array, span)}) AS {key}" for array, key in zip(("_a", "_b"), _KEY, strict=True))
    return f"transform({starts}, i -> struct(i - 1 AS at, {span} AS span, {best} AS best, {keys}))"


def _spans(run: int, min_words: int | None) -> dict[int, int | None]:
    """Lengths of windows, and the words that they must have."""
    return {run: None} | ({m: min_words for m in range(1, run)} if min_words is not None else {})


def _prints(run: int, gram: int, min_words: int | None) -> Column:
    """The fingerprints of the positions that windows select, each position once. Integers are told apart in linear time."""
    out = []
    for size in range(1, gram + 1):
        kinds = [_windows(m, gram, words) for m, words in _spans(run, min_words).items() if min(m, gram) == size]
        if kinds:
            at = f"array_distinct(transform(concat({', '.join(kinds)}), w -> w.at - w.best.back))"
            out.append(F.expr(f"transform({at}, p -> {_print(size, 'p + 1')})"))
    return F.concat(*out)


def dedup(docs: DataFrame, *, run: int = RUN, gram: int = GRAM, min_words: int | None = MIN_WORDS) -> DataFrame:
    """docs with the text left, n_lines (not blank, before), n_deleted, deleted (numbers of lines in the text, from 0), and runs:
    the maximal ones that went, as start and end among the lines that aren't blank, first_id and first_start of the place that stays."""
    if not 1 <= gram <= run:
        raise ValueError("gram must be from 1 to run")
    if min_words is not None and min_words < 1:
        raise ValueError("min_words must be 1 or more")
    rest = docs.drop(*_RESULT)
    names = [c for c in rest.columns if c != "text"]
    rows = rest.select(F.struct(*names).alias(_OWN), F.col("doc_id").alias("_id"), "text", F.monotonically_increasing_id().alias("_row"))
    table = common.saved(sequences(rows))
    total = table.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] * (1 if min_words is None else run)
    arrays = table.select("_row", "_id", "_n", "_a", "_b", "_w")
    prints = common.saved(arrays.select(F.explode(_prints(run, gram, min_words)).alias("print")).groupBy("print").count().filter("count > 1"))
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), F.col("at").alias("at"))
    every = F.concat(*(F.expr(_windows(m, gram, words)) for m, words in _spans(run, min_words).items()))
    windows = arrays.select("_row", "_id", F.inline(every)).select("_row", F.col("best.print").alias("print"), "span", place.alias("place"), *_KEY)
    live = common.saved(common.hot_join(windows, prints, "print", "count", total).select("_row", "span", "place", *_KEY))
    first = common.saved(live.groupBy(*_KEY).agg(F.min("place").alias("first"), F.count("*").alias("times")).filter("times > 1"))
    later = common.hot_join(live, first, _KEY, "times", total).filter("place > first")
    later = later.select("_row", F.col("place.at").alias("at"), (F.col("place.at") + F.col("span")).alias("end"), "first.n", "first.d", (F.col("place.at") - F.col("first.at")).alias("shift"))
    diagonal = Window.partitionBy("_row", "n", "d", "shift").orderBy("at", "end")
    begins = ~(F.col("at") <= F.max("end").over(diagonal.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("_new", F.coalesce(begins, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(diagonal))
    runs = later.groupBy("_row", "n", "d", "shift", "_run").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    runs = runs.select("_row", F.struct("start", "end", F.col("d").alias("first_id"), (F.col("start") - F.col("shift")).alias("first_start")).alias("run"))
    gone = common.saved(runs.groupBy("_row").agg(F.array_sort(F.collect_list("run")).alias("_runs")))
    out = table.drop("_a", "_b", "_w", "_id").join(common.maybe_broadcast(gone), "_row", "left")
    none = F.array().cast(gone.schema["_runs"].dataType)
    out = out.withColumn("_runs", F.coalesce("_runs", none))
    # Each line of overlapping runs is taken once; positions are taken from arrays, so a text takes time in proportion to its lines.
    deleted = F.expr("sort_array(array_distinct(transform(flatten(transform(_runs, r -> sequence(r.start + 1, r.end))), i -> element_at(_line, i))))")
    out = out.withColumn("_gone", deleted).withColumn("_parts", F.when(F.size("_runs") > 0, F.split("text", "\n")).otherwise(F.array().cast("array<string>")))
    left = F.array_join(F.expr("transform(array_except(sequence(1, greatest(1, size(_parts))), transform(_gone, i -> i + 1)), i -> element_at(_parts, i))"), "\n")
    results = {"n_lines": F.col("_n").cast("long"), "n_deleted": F.size("_gone").cast("long"), "deleted": F.col("_gone"), "runs": F.col("_runs")}
    text = F.when(F.size("_runs") > 0, left).otherwise(F.col("text"))
    return out.select(*(text.alias("text") if c == "text" else F.col(_OWN).getField(c).alias(c) for c in rest.columns), *(x.alias(n) for n, x in results.items()))
