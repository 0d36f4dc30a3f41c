"""Pipeline stages against plain definitions, each on its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from reportmesh.llm.frames import tokenizer_file

from . import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("ids", F.lit("x")).withColumn("n_hit", F.lit(3)).cache()


def _texts(df) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_quality_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = cp.quality(spark, docs, folder)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert labels.filter("quality = 1").join(kept, "doc_id", "left_anti").count() == 0
    assert labels.filter("quality = 0").join(kept, "doc_id").count() <= 3


def test_near_duplicates_keep_one_of_each_component(spark, docs):
    want = {i for i, (_, c) in brute.components(_texts(docs).items()).items() if i == c}
    kept = cp.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns and set(_texts(kept)) == want


def test_repeated_passages_are_cut(spark, docs):
    want = {r[0]: r[4].decode("utf-8", "ignore") for r in brute.kept_bytes(_texts(docs).items()) if r[2] == 0 or r[2] < r[1]}
    kept = cp.repeated_passages(spark, docs, SMALL)
    assert kept.columns == docs.columns and _texts(kept) == want
    assert kept.filter("n_chars <> length(text)").count() == 0


def test_benchmark_spans_are_cut(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = _texts(docs)
    found = {i: brute.contamination(t, items) for i, t in texts.items()}
    kept = _texts(cp.decontaminated(spark, docs, SMALL))
    assert any(f[1] for f in found.values())
    assert set(kept) == {i for i, f in found.items() if 2 * f[1] <= f[0]}
    for i, text in kept.items():
        assert text == texts[i] if not found[i][1] else brute.contamination(text, items)[1] < found[i][1]


def test_tokens_equal_library(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in cp.tokens(spark, docs, SMALL).collect()}
    assert got == {i: library.encode(t or "") for i, t in _texts(docs).items()}


def test_stages_take_nulls_and_empty_tables(spark, docs):
    awkward = docs.limit(3).unionByName(docs.limit(3)).unionByName(
        spark.createDataFrame([(None, "some text " * 9), (7000, None), (7001, "")], "doc_id long, text string"), allowMissingColumns=True
    )
    for name, stage in cp.STAGES:
        assert stage(spark, awkward, SMALL).count() >= 3, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name


def test_run_returns_tokens_of_all_that_is_kept(spark):
    got = cp.run(spark, SMALL)
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < got.count() < 200 and got.filter("n_tokens <> size(ids)").count() == 0
