"""Operator golden cases (FIXTURES section 2) and the original test assertions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from plaudit.operators import alerts, benchmark, stats, timeseries as ts, versions
from plaudit.sources import ingest, io

DAY = 86400
T0 = 1704067200  # 2024-01-01 00:00 UTC, a Monday


def test_rank_average_and_percentile(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0)], "app_id string, v double")
    got = {r.app_id: r.v_rank for r in ts.rank_average(df, "v").collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 3.0}
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 4.0)], "app_id string, v double")
    got = {r.app_id: r.v_percentile for r in ts.percentile_rank(df, "v").collect()}
    assert got == {"a": 0.0, "b": 25.0, "c": 25.0, "d": 75.0}


def _reviews(spark, rows):
    return spark.createDataFrame(rows, "recommendation_id string, app_id string, review string, "
                                       "timestamp_created long, voted_up int, votes_up int")


def test_issue_diversity(spark):
    rows = [(str(i), "all", w, T0, 1, 0) for i, w in
            enumerate(["lag", "graphics", "gameplay", "audio", "bug", "story"])]
    rows += [("o1", "one", "it lags", T0, 1, 0), ("n1", "none", "fine", T0, 1, 0)]
    got = {r.app_id: r.issue_diversity for r in benchmark.benchmark_games(_reviews(spark, rows)).collect()}
    assert got == {"all": 1.0, "one": 0.0, "none": 0.0}


def test_weekly_sentiment_sunday_and_empty_week(spark):
    sun = T0 + 6 * DAY + 86399          # Sunday 23:59:59 -> week ending that Sunday
    mon = T0 + 7 * DAY                   # next Monday 00:00 -> next week
    later = T0 + 21 * DAY                # two weeks later, one empty week between
    rows = [("1", "a", "x", sun, 1, 0), ("2", "a", "x", mon, 0, 0), ("3", "a", "x", later, 1, 0)]
    got = ts.weekly_sentiment(_reviews(spark, rows)).orderBy("week").collect()
    assert [r.week for r in got] == [dt.date(2024, 1, 7), dt.date(2024, 1, 14), dt.date(2024, 1, 21),
                                     dt.date(2024, 1, 28)]
    assert [r.total for r in got] == [1, 1, 0, 1]
    assert got[2].positive_ratio is None


def test_detect_anomalies(spark):
    def series(n_days, rate_of):
        rows = []
        for d in range(n_days):
            pos = rate_of(d)
            rows += [(f"{d}-{k}", "a", "x", T0 + d * DAY + k, int(k < pos), 0) for k in range(10)]
        return _reviews(spark, rows)
    assert ts.detect_anomalies(series(13, lambda d: 8)).count() == 0
    assert ts.detect_anomalies(series(20, lambda d: 8)).count() == 0      # flat: std 0
    rates = [8, 9, 8, 9, 8, 9, 8, 9, 8, 9, 8, 9, 8, 9, 0, 9, 8]
    got = ts.detect_anomalies(series(len(rates), lambda d: rates[d])).collect()
    assert [r.type for r in got] == ["drop"]


def test_forecast_exact_quadratic(spark):
    # weekly rate = 0.2 + 0.01 t + 0.002 t^2 exactly, 8 weeks
    rows = []
    for t in range(8):
        rate = 0.2 + 0.01 * t + 0.002 * t * t
        n = 1000
        pos = round(rate * n)
        rows += [(f"{t}-{k}", "a", "x", T0 + t * 7 * DAY + k, int(k < pos), 0) for k in range(n)]
    pred = ts.forecast_rate(_reviews(spark, rows), "W", 3).orderBy("step").collect()
    exp = [0.2 + 0.01 * t + 0.002 * t * t for t in (8, 9, 10)]
    assert [r.predicted_rate for r in pred] == pytest.approx(exp, abs=1e-9)
    few = [(f"{t}", "a", "x", T0 + t * 7 * DAY, 1, 0) for t in range(3)]
    assert ts.forecast_rate(_reviews(spark, few), "W", 3).count() == 0


def test_update_impact_windows(spark):
    t = T0 + 30 * DAY
    rows = [("m", "a", "patch 2.0 is out", t, 1, 0),
            ("b1", "a", "x", t - 7 * DAY, 1, 0), ("b2", "a", "x", t - 1, 0, 0),
            ("a1", "a", "x", t + 1, 1, 0), ("a2", "a", "x", t + 7 * DAY, 1, 0),
            ("late", "a", "x", t + 7 * DAY + 1, 0, 0), ("early", "a", "x", t - 7 * DAY - 1, 0, 0)]
    got = versions.update_impact(_reviews(spark, rows)).collect()
    assert len(got) == 1 and got[0].version == "2.0"
    assert got[0].before_avg == 50.0 and got[0].after_avg == 100.0 and got[0].impact == 50.0
    zero = [("m", "a", "patch 2.0", t, 1, 0), ("b", "a", "x", t - 10, 0, 0), ("c", "a", "x", t + 10, 1, 0)]
    z = versions.update_impact(_reviews(spark, zero)).collect()[0]
    assert z.before_avg == 0.0 and z.impact == 100.0


def test_evaluate_alerts(spark):
    rows = [("a", dt.date(2024, 1, 1), 0, 0, 0, None), ("b", dt.date(2024, 1, 1), 9, 9, 0, None),
            ("c", dt.date(2024, 1, 1), 100, 49, 51, 30.0), ("d", dt.date(2024, 1, 1), 100, 50, 50, 25.0),
            ("e", dt.date(2024, 1, 1), 100, 90, 10, 5.0), ("f", dt.date(2024, 1, 1), 100, 90, 10, 4.7)]
    st = spark.createDataFrame(rows, "app_id string, bucket date, total long, positive long, "
                                     "recent_negative long, avg_negative double")
    got = {}
    for r in alerts.evaluate_alerts(st).collect():
        got.setdefault(r.app_id, set()).add(r.rule)
    assert got["a"] == {"no_reviews"}
    assert got["b"] == {"no_reviews"}
    assert "low_rating" in got["c"] and "low_rating" not in got.get("d", set())
    assert "negative_spike" not in got.get("e", set()) and "negative_spike" in got["f"]


def test_database_assertions(spark, tmp_path):
    """The original database tests: empty insert, insert 3, duplicate insert, ids, stats."""
    schema = "recommendation_id string, app_id string, language string, review string, voted_up boolean"
    path = str(tmp_path / "t")
    assert ingest.append_new(None, spark.createDataFrame([], schema), path) == 0
    first = spark.createDataFrame([("1", "123", "en", "a", True), ("2", "123", "en", "b", False)], schema)
    assert ingest.append_new(None, first, path) == 2
    again = spark.createDataFrame([("1", "123", "en", "a", True), ("3", "123", "en", "c", True)], schema)
    assert ingest.append_new(io.read_reviews_table(spark, path), again, path) == 1
    stored = io.read_reviews_table(spark, path)
    assert {r[0] for r in ingest.existing_ids(stored).collect()} == {"1", "2", "3"}
    rows = spark.createDataFrame([("1", "123", "en", "a", True), ("2", "123", "en", "b", True),
                                  ("3", "123", "en", "c", False), ("4", "456", "en", "d", True)], schema)
    r = stats.review_stats(ingest.new_rows(None, rows), app_id="123").first()
    assert (r.total, r.positive, r.negative) == (3, 2, 1)


def test_flatten(spark):
    schema = "reviews array<struct<review_id:long, review:string, author:struct<steamid:string, playtime_forever:long>>>"
    df = spark.createDataFrame([([(1, "x", ("s1", 10)), (2, "y", None)],)], schema)
    flat = io.flatten_review(df.select(F.explode("reviews").alias("r")).select("r.*")).collect()
    assert "author" not in flat[0].asDict()
    assert flat[0].author_steamid == "s1" and flat[1].author_steamid is None
    assert flat[0].review == "x"


def test_game_names(spark):
    games = ingest.game_names(spark, {"2897760": "Override"})
    df = spark.createDataFrame([("2897760",), ("2277560",), ("999999",), (None,)], "app_id string")
    got = [r.game_name for r in ingest.with_game_name(df, games).orderBy(F.col("app_id").asc_nulls_last()).collect()]
    assert got == ["WUCHANG: Fallen Feathers", "Override", "App 999999", "Unknown"]


def test_pearson_p_value(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    ys = [2.1, 3.9, 6.2, 7.8, 10.1, 12.2, 13.8, 16.1, 18.0, 20.2]
    ys = [y + (0.5 if i % 3 == 0 else -0.7) for i, y in enumerate(ys)]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    r = stats.pearson_test(df, "x", "y").first()
    n = len(xs)
    mx, my = sum(xs) / n, sum(ys) / n
    rr = sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / math.sqrt(
        sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
    assert r.r == pytest.approx(rr)
    # p from the t distribution: compare with a direct numeric integration
    t = rr * math.sqrt((n - 2) / (1 - rr * rr))
    k = n - 2
    c = math.gamma((k + 1) / 2) / (math.sqrt(k * math.pi) * math.gamma(k / 2))
    steps = 200000
    hi = 200.0
    h = (hi - abs(t)) / steps
    tail = sum(c * (1 + ((abs(t) + (i + 0.5) * h) ** 2) / k) ** (-(k + 1) / 2) for i in range(steps)) * h
    assert r.p_value == pytest.approx(2 * tail, rel=1e-3, abs=1e-12)


def test_rows_without_id_are_rejects(spark, tmp_path):
    batch = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), ("1", "x"), ("1", "x")],
                                  "recommendation_id string, review string")
    path = str(tmp_path / "t")
    assert ingest.append_report(None, batch, path) == {"inserted": 1, "rejected": 3}
    assert sorted(r["review"] for r in spark.read.json(path + "_rejects").collect()) == ["a", "a", "b"]


def test_ties_keep_the_same_row(spark):
    rows = [("1", f"text{k}", 5) for k in range(20)]
    pick = [ingest.dedupe_batch(spark.createDataFrame(r, "recommendation_id string, review string, "
                                                          "timestamp_updated long").repartition(n)).first()["review"]
            for r, n in ((rows, 3), (rows[::-1], 1))]
    assert pick[0] == pick[1]


def test_hot_app_is_written_by_many_tasks(spark, tmp_path):
    df = spark.range(20_000).selectExpr("cast(id as string) recommendation_id", "'one' app_id", "id timestamp_created")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_reviews_table(df, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "t" / "app_id=one").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20_000


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "My Game_7_reviews.csv").write_text('recommendationid,review,voted_up\n1,"a\nb",True\n')
    (tmp_path / "Other_8_reviews.csv").write_text("language,recommendationid,review,voted_up\nen,2,c,False\n")
    got = {r["recommendation_id"]: (r["review"], r["voted_up"], r["language"], r["file_name"])
           for r in io.read_review_glob(spark, str(tmp_path)).collect()}
    assert got == {"1": ("a\nb", "True", None, "My%20Game_7_reviews.csv"),
                   "2": ("c", "False", "en", "Other_8_reviews.csv")} or \
        got == {"1": ("a\nb", "True", None, "My Game_7_reviews.csv"), "2": ("c", "False", "en", "Other_8_reviews.csv")}


def test_a_wrong_schema_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(Exception):
        io.read_review_csv(spark, str(tmp_path / "a.csv"), ["y", "x"]).collect()


def test_stream_ingest_raises_on_an_unreadable_table(spark, tmp_path):
    from pyspark.sql import types as T
    from plaudit.streaming import jobs
    (tmp_path / "table").mkdir()
    (tmp_path / "table" / "part.parquet").write_text("this is no parquet file")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"recommendation_id": "1", "app_id": "a"}\n')
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("recommendation_id", "app_id")])
    q = jobs.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "ck"), schema)
    with pytest.raises(Exception):
        q.awaitTermination()


def test_replayed_alert_batch_changes_nothing(spark, tmp_path):
    from plaudit.streaming import jobs
    rows = [(f"{k}", "a", 86_400 * (19_000 + k % 9) + k, int(k % 3 > 0)) for k in range(60)]
    schema = "recommendation_id string, app_id string, timestamp_created long, voted_up int"
    src = str(tmp_path / "in")
    for n, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    rules = [("low", "positive_rate_below", 0.9, "{rate:.1f}")]
    want = {(r["bucket"], r["message"]) for r in alerts.evaluate_alerts(alerts.alert_stats(
        spark.createDataFrame(rows, schema)), rules).collect()}
    out = str(tmp_path / "alerts")
    for attempt in ("one", "two"):  # the second checkpoint replays all batches
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.run_to_end(jobs.stream_alerts(stream, out, str(tmp_path / attempt), rules))
        got = [(r["bucket"], r["message"]) for r in jobs.read_stream_alerts(spark, out).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_late_rows_are_an_error(spark, tmp_path):
    from plaudit.streaming import jobs
    schema = "recommendation_id string, app_id string, timestamp_created long, voted_up int"
    src = str(tmp_path / "in")
    for day in (19_030, 19_031, 19_000):
        spark.createDataFrame([(f"{day}", "a", 86_400 * day, 1)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = jobs.upsert_sink(jobs.stream_daily_trend(stream, "1 day"), str(tmp_path / "o"), str(tmp_path / "c"))
    with pytest.raises(RuntimeError):
        jobs.run_to_end(q)


def test_rule_messages(spark):
    st = spark.createDataFrame([("a", 7, 3, 4, 1.25)], "app_id string, total long, positive long, "
                               "recent_negative long, avg_negative double")
    rules = [("r", "positive_rate_below", 0.8, "at {rate:.0f}% (100% is best)"),
             ("s", "negative_reviews_spike", 2.0, "{recent} after {avg:.1f}"),
             ("t", "total_reviews_below", 10, "{{{total}}}")]
    got = [r["message"] for r in alerts.evaluate_alerts(st, rules).collect()]
    assert got == ["at 43% (100% is best)", "4 after 1.3", "{7}"]
    with pytest.raises(ValueError):
        alerts.evaluate_alerts(st, [("r", "total_reviews_below", 1, "{rate}")])


def test_models_load_once_per_worker(spark, tmp_path):
    from plaudit.operators import sentiment as se
    log = str(tmp_path / "loads")

    def loader():
        import os
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [("positive", float(len(t))) for t in texts]

    df = spark.range(200).selectExpr("cast(id as string) recommendation_id", "'x' review").repartition(16)
    assert se.model_sentiment(df, loader).where("sentiment_score = 1").count() == 200
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))


def test_failing_models_raise_or_are_marked(spark):
    from plaudit.operators import sentiment as se

    def loader():
        def predict(texts):
            raise RuntimeError("no such model")
        return predict

    df = spark.createDataFrame([("1", "a", "english")], "recommendation_id string, review string, language string")
    with pytest.raises(Exception):
        se.model_sentiment(df, loader).collect()
    marked = se.with_models(df, {"sentiment": loader}, fallback=("neutral", 0.0)).select("_models.sentiment.*").first()
    assert tuple(marked) == ("neutral", 0.0, False)


def test_emotion_model_sees_english_only(spark):
    from plaudit.operators import sentiment as se

    def loader():
        def predict(texts):
            if any("le" in t for t in texts):
                raise RuntimeError("not English")
            return [("joy", 0.9)] * len(texts)
        return predict

    df = spark.createDataFrame([("1", "good", "english"), ("2", "le jeu", "fr")],
                               "recommendation_id string, review string, language string")
    got = {r["recommendation_id"]: (r["emotion_type"], r["emotion_score"]) for r in se.emotion(df, loader).collect()}
    assert got == {"1": ("joy", 0.9), "2": ("unknown", 0.0)}


def test_kana_before_ideographs(spark):
    from plaudit.operators.language import detect_language
    df = spark.createDataFrame([("このゲームは最高です",), ("这是一个好游戏",), ("좋은 게임",)], "review string")
    got = [r["detected_language"] for r in detect_language(df).collect()]
    assert got == ["ja", "zh", "ko"]
    assert [r["detected_language"] for r in detect_language(df, legacy_order=True).collect()] == ["zh", "zh", "ko"]


def test_exact_quantiles(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    data = {"a": rng.lognormal(0, 3, 3000), "b": np.repeat([1.0, 2.0], [1, 7]), "c": np.array([5.0])}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in stats.describe_scores(df, "v", ["k"]).collect():
        v = data[r["k"]]
        assert np.allclose([r["p25"], r["p50"], r["p75"]], np.quantile(v, [0.25, 0.5, 0.75]))
    whole = stats.describe_scores(df, "v").first()
    assert np.isclose(whole["p50"], np.quantile(np.concatenate(list(data.values())), 0.5))


def test_student_t_tail():
    import math
    assert np_close(stats.student_t_two_sided_p([2.0], [1.0])[0], 1 - 2 / math.pi * math.atan(2.0))
    assert np_close(stats.student_t_two_sided_p([2.0], [2.0])[0], 1 - 2 / math.sqrt(6))
    assert abs(stats.student_t_two_sided_p([1.96], [1e9])[0] - math.erfc(1.96 / math.sqrt(2))) < 1e-6
    assert np_close(stats.student_t_two_sided_p([0.0], [5.0])[0], 1.0)


def np_close(a, b):
    return abs(a - b) < 1e-10


def topic_reviews(spark, n=60):
    kinds = (["sword", "dragon", "castle", "knight"], ["engine", "wheel", "race", "track"])
    rows = [(f"r{k}", 1, " ".join(kinds[k % 2][(k // 2 + j) % 4] for j in range(6)) + " and more") for k in range(n)]
    return spark.createDataFrame(rows, "recommendation_id string, voted_up int, review string")


def test_nmf_finds_the_two_topics(spark):
    from plaudit.operators import topics
    df = topic_reviews(spark)
    errors = []
    for rounds in (0, 2, 8):
        h, w, cells = topics.fit_nmf(df, k=2, max_iter=rounds)
        errors.append(topics.nmf_error(cells, w, h, 2))
    assert errors[0] > errors[1] > errors[2]
    assert all(x >= 0 for r in h.collect() for x in r["f"])
    top = topics.nmf_topic_terms(h, 100).collect()
    for t in (0, 1):
        assert abs(sum(r["weight"] for r in top if r["topic"] == t) - 1) < 1e-9
    first = [{r["term"] for r in top if r["topic"] == t and r["pos"] < 3} for t in (0, 1)]
    assert not first[0] & first[1]
    again = topics.nmf_topic_terms(topics.fit_nmf(df, k=2, max_iter=8)[0], 100).collect()
    assert [(r["topic"], r["pos"], r["term"]) for r in sorted(again)] == [(r["topic"], r["pos"], r["term"]) for r in sorted(top)]


def test_nmf_in_blocks_is_the_plain_update(spark, monkeypatch):
    """Several blocks give the factors of the plain multiplicative updates."""
    import numpy as np
    from plaudit.operators import blocks, topics
    monkeypatch.setattr(blocks.pack, "__defaults__", (60,))
    df = topic_reviews(spark)
    h0, w0, cells = topics.fit_nmf(df, k=2, max_iter=0)
    assert blocks.pack(cells, "doc", "w", "t").count() > 3
    h, w = ({r[0]: np.array(r[1]) for r in f.collect()} for f in (h0, w0))
    x = [tuple(r) for r in cells.select("doc", "term", "w").collect()]
    for _ in range(3):
        for own, other, i, j in ((w, h, 0, 1), (h, w, 1, 0)):
            gram = sum(np.outer(f, f) for f in other.values())
            num = {n: np.zeros(2) for n in own}
            for c in x:
                num[c[i]] += c[2] * other[c[j]]
            for n in own:
                own[n] = own[n] * num[n] / (own[n] @ gram + 1e-12)
    h3, w3, _ = topics.fit_nmf(df, k=2, max_iter=3, tolerance=0.0)
    for got, want in ((h3, h), (w3, w)):
        rows = got.collect()
        assert {r[0] for r in rows} == set(want)
        assert all(np.allclose(r[1], want[r[0]], rtol=1e-9) for r in rows)


def test_few_documents_make_no_topics(spark):
    from plaudit.operators import topics
    assert topics.fit_lda(topic_reviews(spark, 3), k=2)[0] is None
    assert topics.fit_nmf(topic_reviews(spark, 3), k=2)[0] is None


def test_recommendation_starts_no_job(spark):
    from plaudit.operators import recommend
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = spark.createDataFrame([("1", "a", "good game", 5, 1, 0, 1, "s", 1.0)],
                               "recommendation_id string, app_id string, review string, timestamp_created long, "
                               "votes_up int, votes_funny int, voted_up int, author_steam_id string, "
                               "author_playtime_forever double")
    recommend.recommend_reviews(df)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(before)


def test_reports(spark):
    import __spark_entry__  # noqa: F401
    from plaudit.operators import quality
    from plaudit.sources.fixtures import reviews
    df = reviews(spark, "/root/testdata/sf0.001")
    r = quality.comprehensive_report(df)
    assert sum(x["n"] for x in r["intensity"].collect()) == df.count()
    assert sorted(map(tuple, r["segments"].collect())) == sorted(map(tuple, quality.segment_players(df, ["app_id"]).collect()))
    assert sum(x["count"] for x in r["quality"].collect()) == df.count()
    r["_base"].unpersist()
    v = versions.version_report(df)
    assert sum(x["total"] for x in v["summary"].collect()) == v["mentions"].count()
    v["mentions"].unpersist()
