"""Registered corpus queries against their SQL, and the pipeline against its parts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import against_sql, frame, saved
from tests.llm.test_near_copies import brute_near_roots, edited
from tests.llm.test_operators import expected_groups, odd_texts, prose
from vigitab.llm import langid, mixing
from vigitab.llm.queries import ORACLES, QUERIES

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert against_sql(spark, PATH, name) is None


def test_odd_rows_equal_sql(spark, tmp_path):
    path = saved(spark, frame(spark, odd_texts(), ["en", None] * 6, ["src1", "src9", None] * 4), tmp_path)
    for name in ("op8_exact_dedup", "op9_mixing"):
        assert against_sql(spark, path, name) is None


def test_names_and_numbers():
    import __spark_entry__ as entry

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_near_dedup_leaves_texts_where_they_are(spark, tmp_path):
    texts = [prose("en", i, 120) for i in range(20)]
    texts[15:] = [edited(random.Random(i), texts[i - 15], 1) for i in range(15, 20)]
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, texts, ["en"] * 20, ["src0"] * 20), str(tmp_path))
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    roots = brute_near_roots(texts)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(roots))


def test_dropping_and_mixing_move_few_texts(spark, tmp_path, monkeypatch):
    texts = [prose("en", i, 40) for i in range(300)]
    ids = [*range(290), *[3, 4, 5, 6, 7] * 2]  # repeated ids, in other leaves and with other texts
    docs = frame(spark, texts, [["en", "de"][i % 2] for i in range(300)], [f"src{i % 20}" for i in range(300)], ids=[None, *ids[1:]])
    dropped = spark.createDataFrame([(None,), *((i,) for i in range(2, 290, 3))], "__dropped_id long")
    for bits in (64, corpus_pipeline.MAP_BITS):  # a full map, and a thin one
        monkeypatch.setattr(corpus_pipeline, "MAP_BITS", bits)
        out = [tuple(r) for r in corpus_pipeline.without_ids(docs, dropped).collect()]
        assert sorted(out) == sorted(tuple(r) for r in docs.collect() if r.doc_id is not None and r.doc_id % 3 != 2)
    taken = mixing.mix(docs, mixing.source_tree(), mixing.TREE_WEIGHTS, mixing.PERCENT, 1, mixing.SEED)
    want = {r.doc_id for r in taken.where("copies > 0").collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert sorted(map(repr, mixed.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id in want)
    docs.write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # as with many ids: neither stage may shuffle all texts
    try:
        mixed = corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
        assert "hashpartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pipeline_stages(spark, tmp_path):
    langs = ["en", "de", "fr"]
    texts = [prose(langs[i % 3], i // 2, 120) for i in range(120)] + [None, "", "12 34", prose("en", 0, 120)]
    texts[60:70] = [edited(random.Random(i), texts[i - 60], 1) for i in range(60, 70)]
    docs = frame(spark, texts, [langs[i % 3] for i in range(124)], [f"src{i % 20}" for i in range(124)]).withColumn("extra", F.lit("digest"))
    step, text = docs, dict(enumerate(texts))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = ids(step)
        out = stage(spark, step, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "language_id":
            assert ids(out) == sorted(r.doc_id for r in langid.identify(step).where("not rejected").collect()) == list(range(120)) + [123]
        elif name == "exact_dedup":
            assert ids(out) == sorted(d for d, _, _, kept, _ in expected_groups([(i, text[i]) for i in before]) if kept)
        elif name == "near_dedup":
            roots = brute_near_roots([text[i] for i in before])
            assert ids(out) == sorted(before[r] for r in set(roots)) and len(ids(out)) <= len(before) - 10
        elif name == "mixing":
            taken = mixing.mix(step, mixing.source_tree(), mixing.TREE_WEIGHTS, mixing.PERCENT, 1, mixing.SEED)
            assert ids(out) == sorted(r.doc_id for r in taken.where("copies > 0").collect()) and len(ids(out)) > 10
        else:
            assert ids(out) == before and out.where("not round_trip").isEmpty()
        if name != "bpe":
            assert out.columns == docs.columns
        step = out


def test_stages_on_repeated_rows_null_ids_and_clashing_names(spark, tmp_path):
    texts = [prose("en", k, 100) for k in range(40)] + [prose("en", 0, 100)] * 2 + [None, "12 34", prose("en", 50, 100)]
    ids = [*range(40), 0, 90, None, 1, None]  # row 0 twice, a copy under another id, null ids with a rejected and a good text
    docs = frame(spark, texts, ids=ids).withColumns({c: F.lit("own") for c in ("ids", "decoded", "round_trip", "digest", "kept", "label", "tokens", "key")})
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            step = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "language_id":
            assert {r.doc_id for r in step.collect()} == {*ids}
        if name == "exact_dedup":
            assert sorted((r.doc_id for r in step.where("doc_id is not null").collect())) == sorted([*range(40), 1])
    assert out.where("not round_trip").isEmpty() and out.first().decoded == "own"


def test_empty_pipeline(spark, tmp_path):
    path = saved(spark, frame(spark, []), tmp_path)
    assert corpus_pipeline.run(spark, path).collect() == []
