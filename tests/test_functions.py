"""Golden cases for the per-review expressions (branch boundaries)."""

import pytest
from pyspark.sql import functions as F

from plaudit import functions as P


def col_values(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_normalize_vote(spark):
    rows = [("true",), ("True",), ("1",), ("1",), ("False",), ("x",), (None,)]
    assert col_values(spark, rows, "v string", P.normalize_vote("v")) == [1, 1, 1, 1, 0, 0, 0]
    b = col_values(spark, [(True,), (False,), (None,)], "v boolean", P.normalize_vote("v"))
    assert b == [1, 0, 0]


def test_playtime_bin(spark):
    rows = [(0.0,), (0.99,), (1.0,), (499.9,), (500.0,), (501.0,), (None,)]
    got = col_values(spark, rows, "h double", P.playtime_bin(F.col("h")))
    assert got == ["<1h", "<1h", "1-5h", "200-500h", ">=500h", ">=500h", None]


def test_length_bin(spark):
    got = col_values(spark, [(49,), (50,), (999,), (1000,)], "n int", P.length_bin(F.col("n")))
    assert got == ["<50", "50-100", "500-1000", ">1000"]


def test_intensity_labels(spark):
    got = col_values(spark, [(2,), (1,), (0,), (-1,), (-2,), (-3,)], "s int", P.intensity_label("s"))
    assert got == ["Very Positive", "Positive", "Positive", "Negative", "Negative", "Very Negative"]


def test_intensity_score_default_lexicon(spark):
    rows = [("This is excellent and good", 1), ("terrible, a problem", 0), ("", 0)]
    got = col_values(spark, rows, "review string, voted_up int", P.intensity_score("review", "voted_up"))
    assert got == [2 + 1 + 1, -2 - 1 - 1, -1]


def test_segments(spark):
    rows = [(1, 101), (1, 21), (1, 20), (1, 19), (0, 101), (0, 21), (0, 20)]
    got = col_values(spark, rows, "v int, n int", P.segment("v", "n"))
    assert got == ["Enthusiasts", "Satisfied", "Cautious", "Satisfied", "Critical", "Dissatisfied",
                   "Cautious"]


def _words(n):
    return " ".join(f"w{i}" for i in range(n))


def test_quality_score(spark):
    rows = [(_words(n), 0) for n in (0, 1, 50, 100, 200, 500)]
    got = col_values(spark, rows, "review string, voted_up int", P.quality_score("review", "voted_up"))
    assert got == [0, 10, 15, 20, 25, 30]
    rows = [("The story.\nok", 1)]
    # 5 (words) + 15 (story) + 10 ('.') + 5 (newline) + 5 (diverse) + 10 (vote)
    assert col_values(spark, rows, "review string, voted_up int",
                      P.quality_score("review", "voted_up")) == [50]


def test_recency(spark):
    day = 86400
    rows = [(1000 * day - d * day,) for d in (30, 31, 90, 91, 365, 366)] + [(None,)]
    got = col_values(spark, rows, "ts long", P.recency("ts", F.lit(1000 * day)))
    assert got[:6] == pytest.approx([1.0, 0.795, 0.5, 0.5 - 1 / 275 * 0.3, 0.2, 0.2])
    assert got[6] == 0.5


def test_usefulness(spark):
    got = col_values(spark, [(75.0,), (74.99,), (60.0,), (40.0,), (39.99,)], "s double",
                     P.usefulness_category("s"))
    assert got == ["Highly Useful", "Useful", "Useful", "Moderately Useful", "Less Useful"]


def test_helpfulness(spark):
    got = col_values(spark, [(0, 0), (3, 1), (0, 5)], "u int, f int", P.helpfulness("u", "f"))
    assert got == [0.0, 0.75, 0.0]


def test_detect_versions(spark):
    rows = [("v1.2.3",), ("Update 1.5",), ("update 1.2.3",), ("build 12345",), ("patch notes 2.0",),
            ("hotfix",), (None,)]
    got = col_values(spark, rows, "review string", F.sort_array(P.detect_versions("review")))
    assert got == [["1.2.3"], ["1.5"], ["1.2", "1.2.3"], ["12345"], ["2.0"], [], []]


def test_clean_text(spark):
    rows = [("Visit http://x.y/z now",), ("Co-op!",), ("fun 😀 time",), ("好玩 Game",)]
    got = col_values(spark, rows, "t string", P.clean_text("t"))
    assert got == ["visit now", "co op", "fun time", "好玩 game"]


def test_ngrams_edges(spark):
    rows = [(["a", "b", "c"],), (["a"],), ([],)]
    got = col_values(spark, rows, "t array<string>", P.ngrams(F.col("t"), 1, 3))
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_aspect_context(spark):
    text = "x" * 100 + "graphics" + "y" * 100
    rows = [("graphics are nice",), (text,), ("nothing here" * 30,)]
    df = spark.createDataFrame(rows, "t string")
    out = df.select(P.aspect_context("t", P.matched_words(F.lower("t"), ["graphic", "graphics"])).alias("c"))
    got = [r.c for r in out.collect()]
    assert got[0] == "graphics are nice"
    assert got[1] == "x" * 50 + "graphic" + "sy" + "y" * 48
    assert got[2] == ("nothing here" * 30)[:200]


def test_lexicon_sentiment(spark):
    rows = [("good great",), ("bad bug bug",), ("meh",), ("good bad",)]
    got = col_values(spark, rows, "t string", P.lexicon_sentiment("t"))
    assert [(r.label, r.score, r.compound) for r in got] == [
        ("positive", 0.7, 0.7), ("negative", 0.7, -0.7), ("neutral", 0.5, 0.0), ("neutral", 0.5, 0.0)]


def test_tokenize_zh(spark):
    got = col_values(spark, [("这个游戏非常好玩",)], "t string", P.tokenize_zh(P.clean_text("t")))
    assert "非常" in got[0] and "好玩" in got[0] and "游戏" not in got[0]


def test_word_count_matches_python_split(spark):
    texts = ["  a b\tc\n", "", "one", "x　y\xa0z", " a"]
    got = col_values(spark, [(t,) for t in texts], "t string", P.word_count("t"))
    assert got == [len(t.split()) for t in texts]


def test_lang_code(spark):
    got = col_values(spark, [("zh-CN",), ("fr",), ("english",), (None,)], "l string", P.lang_code("l"))
    assert got == ["zh", "fr", "en", "en"]
