from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_substring, dense_components
from tokenizers import Tokenizer

import corpus_pipeline
from affinis.llm import quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    """What each stage gets and what it gives."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet").cache(), {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stage(spark, docs, DATA).cache()
        out[name] = (given, docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(outputs):
    names = list(outputs)
    assert names == ["quality_rules", "near_dedup", "substring_dedup", "secret_scan", "packing"]
    columns = outputs[names[0]][0].columns
    assert all(outputs[n][1].columns == columns for n in names[:-1])
    assert all(r.n_chars == len(r.text) for n in ("substring_dedup", "secret_scan") for r in outputs[n][1].collect())


def test_quality_stage(spark, outputs):
    given, got = outputs["quality_rules"]
    said = quality.judge(given, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept").select("doc_id").collect()
    assert {r.doc_id for r in said} == set(texts(got)) and all(given_text == texts(given)[k] for k, given_text in texts(got).items())


def test_near_dedup_stage(outputs):
    given, got = outputs["near_dedup"]
    rows = sorted(texts(given).items())
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    long_enough = [(k, t.translate(low)) for k, t in rows if len(t.split()) >= 5]
    label = dense_components([t for _, t in long_enough], 5)
    kept = {k for n, (k, _) in enumerate(long_enough) if label[n] == n}
    assert {k for k in texts(got) if k in dict(long_enough)} == kept


def test_substring_stage(outputs):
    given, got = outputs["substring_dedup"]
    rows = list(texts(given).items())
    want = {}
    for (k, t), (n, gone, kept) in zip(rows, brute_substring([t for _, t in rows], 35), strict=True):
        if not gone or gone < n:
            want[k] = kept if gone else t
    assert texts(got) == want


def test_secret_stage(outputs):
    given, got = outputs["secret_scan"]
    before, after = texts(given), texts(got)
    assert before.keys() == after.keys()
    for k in before:
        at = 0
        for part in after[k].split("[SECRET]"):
            at = before[k].index(part, at) + len(part)


def test_packing_stage(outputs):
    given, got = outputs["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in texts(given).items()}
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n <> end or n > 1024").count() == 0 and full.count() <= -(-sum(want.values()) // 1024) + 2


def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "x", 0), (1, "w " * 30000, None, None, 5)], docs.schema)
    both = docs.unionByName(odd).unionByName(docs).withColumns({"id": F.lit("x"), "kept": F.lit(1), "row": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, both, DATA)
        assert out.columns == both.columns
        out.collect()
        stage(spark, both.limit(0), DATA).collect()
    corpus_pipeline.STAGES[-1][1](spark, both, DATA).collect()
