"""Counts that are pruned, summed once or read in parts give the plain results."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plaudit.operators import keywords as kw
from plaudit.operators import sentiment as se
from plaudit.operators import versions as vs

SCHEMA = "recommendation_id string, language string, review string, voted_up int"


@pytest.mark.parametrize("hi", [2, 3])
def test_ngrams_of_frequent_words_are_the_top_of_all(spark, hi):
    """Against a count of every n-gram: ties, small groups, null keys, repeated words."""
    rng = random.Random(5)
    rows = [(str(i), [None, "german", "french"][i % 3], " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 9))),
             i % 2) for i in range(80)]
    rows += [("x", "spanish", "zz zz zz zz", 1), ("y", "spanish", "one", 1), ("z", "spanish", None, 0), ("w", None, " ", 0)]
    top = 12
    count = Counter()
    for _, lang, text, up in rows:
        t = (text or "").split()
        for n in range(1, hi + 1):
            count.update((lang, up, " ".join(t[k:k + n])) for k in range(len(t) - n + 1))
    want = set()
    for group in {k[:2] for k in count}:
        best = sorted((-c, k[2]) for k, c in count.items() if k[:2] == group)[:top]
        want |= {(*group, w, -c, r + 1) for r, (c, w) in enumerate(best)}
    df = spark.createDataFrame(rows, SCHEMA)
    got = kw.language_keywords(df, (1, hi), top).select("language", "voted_up", "ngram", "count", "rank").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_only_ngrams_of_frequent_words_are_counted(spark):
    """Of 4,000 words that occur once, no pair reaches the count."""
    rows = [(str(i), "german", " ".join(f"{'abcdefghij'[i % 10]}{chr(97 + i // 10)}{chr(97 + j // 26)}{chr(97 + j % 26)}q"
                                        for j in range(100)) + " top words here " * 3, 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    words = kw._frequent_words(df.withColumn("_ptoks", F.split(F.trim("review"), " +")), ["voted_up"], 3)
    assert sorted(map(tuple, words.select("ngram", "count").collect())) == [("here", 120), ("top", 120), ("words", 120)]


def test_versions_over_time_read_the_mentions_once(spark):
    rows = [("a", f"1.{i % 7}", None if i % 11 == 0 else 1_700_000_000 + i * 86_400, i % 2) for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def spy(v):
        seen.add(1)
        return v

    df = spark.createDataFrame(rows, "app_id string, version string, timestamp_created long, voted_up int")
    out = vs.version_over_time(df.withColumn("version", spy("version")), "W", 3).collect()
    assert seen.value == 60
    count = Counter(r[1] for r in rows)
    assert {r["version"] for r in out} == set(sorted(count, key=lambda v: (-count[v], v))[:3])


def test_models_share_a_text_and_see_a_few_at_a_time(spark, tmp_path):
    """One text column goes to Python for all models; rows that a condition leaves out
    are not scored, whatever the chunks."""
    def loader():
        return lambda texts: [("toxic" if "bad" in t else "clean", float(len(t))) for t in texts]

    df = spark.range(700).selectExpr("cast(id as string) recommendation_id", "if(id % 9 = 0, null, concat(if(id % 2 = 0, 'bad', 'good'), repeat('x', id % 50))) review",
                                     "if(id % 3 = 0, 'de', 'english') language").coalesce(1)
    both = se.with_models(df, {"emotion": loader, "toxicity": loader})
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "c0" in plan and "c1" not in plan
    for r in both.collect():
        text = r["review"] or ""
        assert tuple(r["_models"]["toxicity"]) == ("toxic" if "bad" in text else "clean", float(len(text)), True)
        want = (None, None, False) if r["language"] == "de" else tuple(r["_models"]["toxicity"])
        assert tuple(r["_models"]["emotion"]) == want


def test_staged_files_grow_in_number(spark, monkeypatch, tmp_path):
    """No landed file holds more than ``FILE_ROWS`` rows, and both copies of a review come."""
    from plaudit.plans import q_stream
    monkeypatch.setattr(q_stream, "FILE_ROWS", 20)
    dirs = [str(tmp_path / d) for d in ("out", "ck", "src")]
    monkeypatch.setattr(q_stream, "_dirs", lambda spark, name: dirs)
    got = q_stream.q_stream_ingest(spark, "/root/testdata/sf0.001")
    files = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(dirs[2])
    sizes = [r["count"] for r in files.groupBy(F.input_file_name().alias("f")).count().collect()]
    assert max(sizes) <= 20 and sum(sizes) == 2 * got.count()
