"""Learned language model, valences and their scorers."""

import math

import pytest
from pyspark.sql import functions as F

from plaudit.operators import langmodel as lm
from plaudit.operators import sentiment as se
from plaudit.operators import valence as va
from plaudit.sources.fixtures import reviews

SF = "/root/testdata/sf0.01"


def test_held_out_language_accuracy(spark):
    df = reviews(spark, SF).drop("detected_language")
    train = F.col("recommendation_id").cast("long") % 5 != 0
    out = lm.detect_language_ngrams(df.where(~train), lm.language_model(df.where(train)))
    rows = out.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_if(
        F.col("language") == F.col("detected_language")).alias("right")).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["right"] >= 0.95 * r["n"], r


def test_language_model_counts(spark):
    rows = [("ab ab", "x"), ("AB c", "y"), (None, "x"), ("zz", None), ("", "y"), ("日本 12", "x")]
    df = spark.createDataFrame(rows, "review string, language string")
    got = {(r["language"], r["gram"]): r["n"] for r in lm.language_model(df, lo=1, hi=3, max_grams=100).collect()}
    assert got["x", " a"] == 2 and got["y", " a"] == 1 and got["x", "c"] == 0 and got["x", " "] == 6
    assert got["x", "日本 "] == 1 and ("x", "zz") not in got
    model = lm.language_model(df, lo=1, hi=3, max_grams=4)
    assert model.count() == 8 and model.agg(F.max("log_p")).first()[0] < 0
    assert lm.language_model(df.where("false")).count() == 0


def test_detection_of_odd_texts(spark):
    train = spark.createDataFrame([("the cat sat", "en"), ("le chat dort", "fr")], "review string, language string")
    model = lm.language_model(train, max_grams=500)
    texts = ["the sat", "CHAT dort", None, " ", "日本語", "ですか", "한국", "123 !!", "qqq", "the " * 20_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, review string")
    got = [r["detected_language"] for r in lm.detect_language_ngrams(df, model).orderBy("k").collect()]
    assert got[:8] == ["en", "fr", "unknown", "unknown", "zh", "ja", "ko", "en"] and got[9] == "en"


def brute_total(words, valences):
    out = 0
    for i, w in enumerate(words):
        if w in valences:
            before = words[i - 1] if i else ""
            scale = va.UP if before in va.BOOSTERS else va.DOWN if before in va.SOFTENERS else 100
            turned = any(x in va.NEGATORS for x in words[max(0, i - va.SCOPE):i])
            out += valences[w] * scale * (va.TURN if turned else 100)
    return out


def test_scopes(spark):
    scorer = va.ValenceScorer({"good": 2000, "bad": -1500})
    assert scorer.total("good".split()) == 2000 * 100 * 100
    assert scorer.total("very good".split()) == 2000 * 125 * 100
    assert scorer.total("not very good".split()) == 2000 * 125 * -75
    assert scorer.total("not a b c good".split()) == 2000 * 100 * 100
    words = "never really bad but rather good not at all bad very very good".split()
    assert scorer.total(words) == brute_total(words, scorer.valences)
    lexicon = spark.createDataFrame([("good", 2000), ("bad", -1500), ("dont", 10)], "word string, valence long")
    df = spark.createDataFrame([("GOOD, don't!",), (None,), ("",), ("Not good.",), ("bad " * 50_000,)], "review string")
    got = [r[0] for r in df.select(va.valence_scorer(lexicon)("review")).collect()]
    assert got[0] == pytest.approx(2.01 / math.sqrt(2.01 ** 2 + 15)) and got[1] == got[2] == 0
    assert got[3] < 0 and -1 <= got[4] < -0.99


def test_valences_match_their_formula(spark):
    rows = [("good good fun", 1)] * 30 + [("bad", 0)] * 20 + [("fun bad", 0)] * 10 + [("good", None), (None, 1), ("x", 7)]
    df = spark.createDataFrame(rows, "review string, voted_up int")
    got = {r["word"]: r for r in va.learn_valences(df, prior=0.1, least_z=0.0).collect()}
    pos, neg, a = 60, 40, 0.1 * 30
    want = math.log((30 + a) / (pos + 10 - 30 - a)) - math.log((0 + a) / (neg + 10 - 0 - a))
    assert got["good"]["log_odds"] == pytest.approx(want) and got["good"]["n_pos"] == 30
    assert got["good"]["valence"] > 0 > got["bad"]["valence"] and "x" not in got
    assert va.learn_valences(df, max_words=1, prior=0.1).count() == 1
    assert va.learn_valences(df.where("false")).count() == 0


def test_beats_the_lexicon_on_held_out_labels(spark):
    """Votes that follow the text: quality labels of documents, two thirds for learning."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("doc_id", "text", "quality", "lang")
    train = F.col("doc_id") % 3 != 0
    lexicon = va.learn_valences(docs.where(train), "text", "quality")
    held = se.with_lexicon_sentiment(docs.where(~train).withColumnRenamed("text", "review"))
    held = held.withColumn("learned", va.valence_scorer(lexicon)("review"))
    right = lambda c: F.avg(((F.col(c) > 0) == (F.col("quality") == 1)).cast("int"))
    r = held.agg(right("learned").alias("learned"), right("sentiment_score").alias("lexicon")).first()
    assert r["learned"] > r["lexicon"] + 0.1


def test_toxicity_baseline_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("doc_id", "text", "toxic")
    model = se.train_toxicity_baseline(docs.where("doc_id % 4 <> 0").select("text", "toxic"))
    out = se.apply_toxicity_baseline(model, docs.where("doc_id % 4 = 0"), "text")
    r = out.agg(F.expr("count_if(is_toxic and toxic = 1) hit"), F.expr("count_if(toxic = 1) toxic"),
                F.expr("count_if(is_toxic and toxic = 0) wrong"), F.expr("count_if(toxic = 0) clean")).first()
    assert r["hit"] >= 0.8 * r["toxic"] and r["wrong"] <= 0.1 * r["clean"]
