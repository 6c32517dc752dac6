"""Small tables for the tests of the training-data operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Columns of a table may have the names of results and of an operator's own columns.
CLASHES = ("size", "score", "predicted", "n_words", "n_hit", "items", "hit_words", "removed", "n_lines", "deleted", "cid", "n", "target", "label", "kept", "digest", "shard", "rank", "at", "run", "print")


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


def odd_texts() -> list:
    """Nulls, empty and blank texts, copies, near copies, signs, scripts, one very long text and one very long word."""
    base = words(200, 1)
    near = base.replace(base.split()[50], "changed").replace(base.split()[120], "Other")
    return [
        None, "", "  \t\n\x0b\x0c\r ", "one", "two words", "three little words", base, base, base.upper(), near, base + " tail", base.replace(" ", "\n"),
        "x" * 5000, words(30_000, 2), "Ünïcode ÉÈ 日本語 テキスト 😀👍🏽 ok é", "a\x00b \x1c\x1d c", "line\nline\nline\nline\nline\nline", words(12, 3), words(12, 3) + ".", "<|endoftext|> <|end|>", "don't, it's; e-mail 3.14 %%% $$$",
    ]


def docs(spark, texts=None, *, clash=False, parts=3):
    rows = [(i * 3 % 101 if i else None, t, "en", None if i % 5 == 4 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(odd_texts() if texts is None else texts)]
    rows += rows[5:7]  # repeated rows
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)
