from __future__ import annotations

import zlib

import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from affinis.llm import langid

DATA = "/root/testdata/sf0.01"


def brute(text, model, narrow=0.02):
    """One text at a time, with fresh compressors."""
    if text is None or not model.languages or not any(c.isalpha() for c in text):
        return "und", 0.0, False
    data = langid.plain(text)
    total = []
    for own in model.contents:
        n = 0
        for b in range(0, len(data), langid.BLOCK):
            for k in range(min(-(-langid.LEAST // len(data)), len(own))):
                content = zstd.ZstdCompressionDict(own[(b // langid.BLOCK + k) % len(own)], dict_type=zstd.DICT_TYPE_RAWCONTENT)
                params = zstd.ZstdCompressionParameters(compression_level=langid.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
                n += len(zstd.ZstdCompressor(compression_params=params, dict_data=content).compress(data[b : b + langid.BLOCK]))
        total.append(n)
    best = total.index(min(total))
    others = total[:best] + total[best + 1 :]
    margin = 1 - total[best] / min(others) if others else 1.0
    return model.languages[best], margin, margin >= narrow


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return langid.op13_language_id(spark, DATA).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()


def test_held_out_accuracy(judged):
    assert len(judged) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in judged)
    rows = [r for r in judged if r.held_out]
    right = sum(r.lang_pred == r.lang for r in rows) / len(rows)
    sure = [r for r in rows if r.sure]
    assert right > 0.98 and sum(r.lang_pred == r.lang for r in sure) / len(sure) >= right and len(sure) > 0.95 * len(rows)


def test_equals_brute_force_and_learns_from_stated_rows_only(spark, judged):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.LanguageModel.fit(docs.where(~langid.held_out()))
    assert all((r.lang_pred, r.score, r.sure) == brute(r.text, model) for r in judged[::9])
    other = docs.withColumns({"lang": F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("s")})
    assert langid.LanguageModel.fit(other.where(~langid.held_out())) == model
    assert sum(len(x) for own in model.contents for x in own) <= 4 * 512 * 400 * 3


def test_odd_rows(spark):
    texts = ["the cat sat on the mat and the dog sat on the log", "le chat est sur le tapis et le chien sur la route"] * 3
    rows = [(i, t, "en" if "the" in t else "fr") for i, t in enumerate(texts)] + [(50, "no language", None), (51, None, "de"), (52, "123", "de"), (None, "the end", "en")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.LanguageModel.fit(labelled)
    assert set(model.languages) == {"en", "fr"}
    asked = spark.createDataFrame([(1, None), (1, ""), (None, "12 .!"), (2, "the dog sat on the mat"), (2, "le chien est sur la route"), (3, "the log " * 300_000), (4, "日本"), (5, "ª")], "doc_id long, text string")
    asked = asked.withColumns({"lang_pred": F.lit(1), "score": F.lit("x"), "id": F.lit(2), "sure": F.lit(0)})
    out = langid.identify(asked, model).collect()
    assert [r.lang_pred for r in out[:6]] == ["und", "und", "und", "en", "fr", "en"] and all(r.score == 0 for r in out[:3])
    assert all(r.lang_pred in model.languages for r in out[6:]) and not out[6].sure
    assert [(r.lang_pred, r.score, r.sure) for r in out] == [brute(r.text, model) for r in asked.collect()]
    assert langid.identify(asked.limit(0), model).count() == 0
    empty = langid.LanguageModel.fit(labelled.limit(0))
    assert empty.languages == () and {r.lang_pred for r in langid.identify(asked, empty).collect()} == {"und"}
    alone = langid.LanguageModel.fit(labelled.where("lang = 'fr'"))
    assert langid.identify(asked.where("doc_id = 4"), alone).collect()[0].score == 1.0


def test_sample_is_bounded_with_a_hot_language_and_copies(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same text in every row of it")).otherwise(F.concat(F.lit("word "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" other"))).alias("text"), F.when(F.col("id") < 2900, "aa").otherwise(F.concat(F.lit("l"), F.col("id").cast("string"))).alias("lang"))
    model = langid.LanguageModel.fit(rows, most=5, samples=20)
    assert len(model.languages) == 5 and model.languages[0] == "aa" and list(model.languages[1:]) == sorted(model.languages[1:])
    assert sum(x.count(b"same text") for x in model.contents[0]) == 1
