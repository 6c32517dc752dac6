"""Empty tables, clashing columns, null benchmarks and labels: each operator gives its defined result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import chat, common, components, decontam, exact, jaccard, lines, mixing, quality, queries, sharding, substrings, tokens

from . import data


def bench(spark, rows=((1, "some short item"), (2, None))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, rows=((0, 1, 0), (3, 0, 0), (3, 1, 0), (6, None, 0), (None, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "mix": lambda s, d: mixing.mix(d),
    "mixed_documents": lambda s, d: mixing.mixed_documents(d),
    "decontam": lambda s, d: decontam.scan(d, bench(s)),
    "decontaminate": lambda s, d: decontam.decontaminate(d, bench(s)),
    "decontaminate_spans": lambda s, d: decontam.decontaminate(d, bench(s), mode="spans"),
    "substrings": lambda s, d: substrings.dedup(d),
    "exact": lambda s, d: exact.dedup(d),
    "shard": lambda s, d: sharding.shard(d),
    "jaccard": lambda s, d: jaccard.join(d),
    "representatives": lambda s, d: jaccard.representatives(d),
    "tokens": lambda s, d: tokens.round_trip(d),
    "quality": lambda s, d: quality.score(d, quality.train(d, labels(s))),
    "lines": lambda s, d: lines.dedup(d),
}
ROW_FOR_ROW = set(OPERATORS) - {"mixed_documents", "decontaminate", "decontaminate_spans", "representatives"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    docs = data.docs(spark, clash=True)
    rows = OPERATORS[name](spark, docs).collect()
    if name in ROW_FOR_ROW:
        assert len(rows) == docs.count()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, data.empty(spark)).collect() == []


def test_empty_benchmark_and_labels(spark):
    docs = data.docs(spark)
    found = decontam.digest(decontam.scan(docs, bench(spark, ()))).collect()
    assert len(found) == docs.count() and not any(r["contaminated"] or r["n_hit"] for r in found)
    scored = quality.score(docs, quality.train(docs, labels(spark, ()))).collect()
    assert {round(r["score"], 6) for r in scored} == {0.5}


def test_filters_keep_own_columns(spark):
    docs = data.docs(spark, clash=True)
    for out in (decontam.decontaminate(docs, bench(spark)), decontam.decontaminate(docs, bench(spark), mode="spans")):
        assert out.columns == docs.columns and {r["n_hit"] for r in out.select("n_hit").collect()} == {"own n_hit"}


def test_empty_chats(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preferences(none, chat.adjacent_pairs(none)).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (8, 7), (10, 10), (3, 4), (20, 21), (21, 22), (22, 20), *((100, 101 + i) for i in range(50)), *((200 + i, 201 + i) for i in range(40))]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 20: 20, 21: 20, 22: 20} | {i: 100 for i in range(100, 151)} | {200 + i: 200 for i in range(41)}
    assert got == want


def test_running_total(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r["id"]: r["t"] for r in common.running_total(df, [F.col("id")], t=F.col("v")).collect()}
    assert all(got[i] == sum(k % 7 for k in range(i)) for i in (0, 1, 500, 999))


def test_hot_join(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").count()
    got = common.hot_join(rows, groups, "k", "count", 4000)
    assert got.count() == 4000 and got.filter("k = 1").select("count").distinct().first()[0] == rows.filter("k = 1").count()


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").limit(5).collect()


def tables(tmp_path, docs, benchmark, known):
    for name, df in (("documents", docs), ("benchmark", benchmark), ("labels", known)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and columns that clash go through all stages."""
    docs = data.docs(spark, clash=True)
    sf = tables(tmp_path, docs, bench(spark), labels(spark))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, common.saved(stage(spark, kept, sf))
        assert kept.columns == docs.columns and kept.select("text").distinct().count() <= before.select("text").distinct().count() + 4
        assert {r["kept"] for r in kept.select("kept").collect()} <= {"own kept"}
    assert corpus_pipeline.run(spark, sf).count() == kept.count()


def test_pipeline_of_empty_tables(spark, tmp_path):
    sf = tables(tmp_path, data.empty(spark), bench(spark, ()), labels(spark, ()))
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    rows = spark.range(10).select("id", F.expr("transform(sequence(1, 100), i -> struct(i AS a, i AS b))").alias("spans"), F.lit("é" * 10).alias("s"))

    def broadcast(df):
        return "hint" in common.maybe_broadcast(df)._jdf.queryExecution().logical().toString().lower()

    assert broadcast(rows)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10_000)
    assert not broadcast(rows) and broadcast(rows.drop("spans"))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    assert not broadcast(rows.drop("spans"))


def test_pipeline(spark):
    """Stage by stage: what goes is what each stage is for, and clean documents stay."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "token_ids"]
    good, unique, clean, mixed = (f for _, f in corpus_pipeline.STAGES[:4])
    kept = common.saved(good(spark, docs, sf))
    known = kept.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert kept.columns == columns and known.filter("quality = 0").count() <= 0.2 * known.count()
    one = common.saved(unique(spark, kept, sf))
    assert one.columns == columns and 0 < one.count() < kept.count()
    classes = jaccard.join(one)
    assert classes.filter("doc_id <> component_id").count() == 0
    pure = common.saved(clean(spark, one, sf))
    assert pure.columns == columns and decontam.scan(pure, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("n_hit > 0").count() == 0
    mix = common.saved(mixed(spark, pure, sf))
    assert mix.columns == columns and mix.groupBy("doc_id").count().filter("count > 2").count() == 0
    last = corpus_pipeline.STAGES[4][1](spark, mix, sf)
    assert last.count() == mix.count()
    assert corpus_pipeline.run(spark, sf).count() > 0
