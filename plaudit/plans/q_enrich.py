"""Registered queries for sentiment, quality, issues, segments (2-G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.functions import NON_WS, quality_score
from plaudit.operators import quality as qu
from plaudit.operators import sentiment as se
from plaudit.operators import stats
from plaudit.operators import valence as va
from plaudit.operators.scan import top_reviews
from plaudit.plans import sqlgen as S
from plaudit.plans.registry import register, rnd
from plaudit.sources.fixtures import REVIEWS_CTE_SQL, reviews, table

R = f"WITH {REVIEWS_CTE_SQL}"
TEST_POS = ["tion", "ing", "que", "les"]
TEST_NEG = ["heit", "ung", "ver", "her"]
LOW = S.low()


def _lex_sql(t_lower: str, pos=L.LEXICON_POSITIVE, neg=L.LEXICON_NEGATIVE):
    return S.lexicon(t_lower, pos, neg)


def _lex_query(pos, neg) -> str:
    lab, sc, comp = _lex_sql(LOW, pos, neg)
    return rnd(f"""{R}
SELECT recommendation_id, {lab} AS sentiment_label, {sc} AS sentiment_confidence,
       {comp} AS sentiment_score FROM reviews""", ["sentiment_confidence", "sentiment_score"])


@register("lexicon_sentiment", _lex_query(L.LEXICON_POSITIVE, L.LEXICON_NEGATIVE))
def q_lexicon_sentiment(spark, sf):
    return se.with_lexicon_sentiment(reviews(spark, sf)).select(
        "recommendation_id", "sentiment_label", "sentiment_confidence", "sentiment_score")


@register("lexicon_sentiment_test_lexicon", _lex_query(TEST_POS, TEST_NEG))
def q_lexicon_sentiment_test(spark, sf):
    return se.with_lexicon_sentiment(reviews(spark, sf), TEST_POS, TEST_NEG).select(
        "recommendation_id", "sentiment_label", "sentiment_confidence", "sentiment_score")


def _hybrid_sql(pos, neg) -> str:
    _, _, comp = _lex_sql(LOW, pos, neg)
    score = f"CASE WHEN {S.lang_code()} = 'en' THEN {comp} ELSE CAST(voted_up AS DOUBLE) END"
    return f"""hy AS (SELECT * REPLACE ({score} AS sentiment_score) FROM reviews),
hl AS (SELECT *, CASE WHEN sentiment_score > 0.05 THEN 'positive' WHEN sentiment_score < -0.05
                      THEN 'negative' ELSE 'neutral' END AS sentiment_label,
              abs(sentiment_score) AS sentiment_confidence FROM hy)"""


@register("hybrid_sentiment", rnd(f"""{R}, {_hybrid_sql(TEST_POS, TEST_NEG)}
SELECT recommendation_id, sentiment_score, sentiment_label, sentiment_confidence FROM hl""",
                                  ["sentiment_score", "sentiment_confidence"]))
def q_hybrid_sentiment(spark, sf):
    """English rows scored by the (test) lexicon, other languages by their vote."""
    from plaudit.functions import lexicon_sentiment
    sc = lambda c: lexicon_sentiment(c, TEST_POS, TEST_NEG).getField("compound")
    return se.hybrid_sentiment(reviews(spark, sf), scorer=sc).select(
        "recommendation_id", "sentiment_score", "sentiment_label", "sentiment_confidence")


@register("sentiment_label_distribution", rnd(f"""{R}, {_hybrid_sql(TEST_POS, TEST_NEG)}
SELECT app_id, sentiment_label, n, round(n / sum(n) OVER (PARTITION BY app_id) * 100, 2) AS pct
FROM (SELECT app_id, sentiment_label, count(*) AS n FROM hl GROUP BY ALL)""", ["pct"]))
def q_sentiment_label_distribution(spark, sf):
    from plaudit.functions import lexicon_sentiment
    sc = lambda c: lexicon_sentiment(c, TEST_POS, TEST_NEG).getField("compound")
    return stats.label_distribution(se.hybrid_sentiment(reviews(spark, sf), scorer=sc),
                                    "sentiment_label", ["app_id"])


@register("model_sentiment_udf", rnd(f"""{R}
SELECT recommendation_id, {_lex_sql(LOW)[0]} AS sentiment_label,
       {_lex_sql(LOW)[1]} AS sentiment_confidence, {_lex_sql(LOW)[2]} AS sentiment_score
FROM reviews""", ["sentiment_confidence", "sentiment_score"]))
def q_model_sentiment_udf(spark, sf):
    """The Arrow scorer slot driven by a stand-in lexicon model over whole texts."""
    return se.model_sentiment(reviews(spark, sf), se.lexicon_model_loader()).select(
        "recommendation_id", "sentiment_label", "sentiment_confidence", "sentiment_score")


def _flag_sql(words, hit, miss, flag, score):
    holds = " OR ".join(f"contains({LOW}, '{w}')" for w in words)
    return f"({holds}) AS {flag}, CASE WHEN {holds} THEN 0.8 ELSE 1 - 0.8 END AS {score}"


@register("emotion_sarcasm_toxicity_models", rnd(f"""{R}
SELECT recommendation_id,
       CASE WHEN {S.lang_code()} <> 'en' THEN 'unknown' WHEN contains({LOW}, 'tha') THEN 'joy' ELSE 'anger' END
         AS emotion_type,
       CASE WHEN {S.lang_code()} <> 'en' THEN 0.0 ELSE 0.8 END AS emotion_score,
       {_flag_sql(["ing", "heit"], "sarcasm", "none", "is_sarcasm", "sarcasm_score")},
       {_flag_sql(["idiot", "loser"], "toxic", "clean", "is_toxic", "toxicity_score")} FROM reviews""",
                                                     ["emotion_score", "sarcasm_score", "toxicity_score"]))
def q_models(spark, sf):
    """Emotion, sarcasm and toxicity slots with models, all in one pass."""
    loaders = {"emotion": se.keyword_model_loader(["tha"], "joy", "anger"),
               "sarcasm": se.keyword_model_loader(["ing", "heit"], "sarcasm", "clear"),
               "toxicity": se.keyword_model_loader(["idiot", "loser"], "toxic", "clean")}
    d = se.with_models(reviews(spark, sf), loaders)
    d = se.toxicity(se.sarcasm(se.emotion(d, loaders["emotion"]), loaders["sarcasm"]), loaders["toxicity"])
    return d.select("recommendation_id", "emotion_type", "emotion_score", "is_sarcasm", "sarcasm_score",
                    "is_toxic", "toxicity_score")


@register("emotion_sarcasm_toxicity_defaults", f"""{R}
SELECT recommendation_id,
       CASE WHEN {S.lang_code()} = 'en' THEN 'neutral' ELSE 'unknown' END AS emotion_type,
       CAST(0.0 AS DOUBLE) AS emotion_score, false AS is_sarcasm, CAST(0.0 AS DOUBLE) AS sarcasm_score,
       false AS is_toxic, CAST(0.0 AS DOUBLE) AS toxicity_score FROM reviews""")
def q_model_defaults(spark, sf):
    d = se.toxicity(se.sarcasm(se.emotion(reviews(spark, sf))))
    return d.select("recommendation_id", "emotion_type", "emotion_score", "is_sarcasm",
                    "sarcasm_score", "is_toxic", "toxicity_score")


def _tokens_sql(col: str) -> str:
    return f"""regexp_extract_all(translate(lower(coalesce({col}, '')), '\'\'’', ''), '[\\p{{L}}\\p{{N}}]+')"""


def _valences_sql(rows: str, col: str, label: str, prior: float = 0.05, least: float = 1.96) -> str:
    """CTEs up to ``lexicon`` over a relation of labelled texts."""
    return f"""vw AS (SELECT {label} AS y, unnest(list_distinct({_tokens_sql(col)})) AS word FROM {rows}
        WHERE {label} IN (0, 1)),
vc AS (SELECT word, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM vw GROUP BY word),
va AS (SELECT *, {prior} * (n_pos + n_neg) AS a, CAST(sum(n_pos) OVER () AS DOUBLE) AS pos,
              CAST(sum(n_neg) OVER () AS DOUBLE) AS neg FROM vc),
vz AS (SELECT *, ln((n_pos + a) / (pos + {prior} * (pos + neg) - n_pos - a))
                 - ln((n_neg + a) / (neg + {prior} * (pos + neg) - n_neg - a)) AS log_odds,
              sqrt(1 / (n_pos + a) + 1 / (n_neg + a)) AS sd FROM va),
lexicon AS (SELECT word, n_pos, n_neg, log_odds, log_odds / sd AS z, CAST(round(log_odds * 1000) AS BIGINT) AS valence
            FROM vz WHERE abs(log_odds / sd) >= {least} ORDER BY abs(z) DESC, word LIMIT {va.MAX_WORDS})"""


_VOTED = "seen AS (SELECT * FROM reviews WHERE CAST(recommendation_id AS BIGINT) % 5 <> 0)"


def _voted(spark, sf):
    df = reviews(spark, sf)
    return df, va.learn_valences(df.where(F.col("recommendation_id").cast("long") % 5 != 0))


@register("learned_valences", rnd(f"""{R}, {_VOTED}, {_valences_sql("seen", "review", "voted_up")}
SELECT * FROM lexicon""", ["log_odds", "z"]))
def q_learned_valences(spark, sf):
    """Words whose log-odds between positive and negative votes are significant."""
    return _voted(spark, sf)[1]


def _scope(words) -> str:
    return S.lst(words)


@register("hybrid_sentiment_learned", rnd(f"""{R}, {_VOTED}, {_valences_sql("seen", "review", "voted_up")},
tk AS (SELECT recommendation_id, {_tokens_sql("review")} AS t FROM reviews),
ps AS (SELECT recommendation_id, t, unnest(range(1, len(t) + 1)) AS i FROM tk),
sc AS (SELECT recommendation_id, CAST(sum(valence
         * CASE WHEN i > 1 AND list_contains({_scope(va.BOOSTERS)}, t[i - 1]) THEN {va.UP}
                WHEN i > 1 AND list_contains({_scope(va.SOFTENERS)}, t[i - 1]) THEN {va.DOWN} ELSE 100 END
         * CASE WHEN list_has_any(t[greatest(1, i - {va.SCOPE}):i - 1], {_scope(va.NEGATORS)}) THEN {va.TURN}
                ELSE 100 END) AS DOUBLE) / 1e7 AS s
       FROM ps JOIN lexicon ON word = t[i] GROUP BY recommendation_id),
hy AS (SELECT recommendation_id, CASE WHEN {S.lang_code()} = 'en'
              THEN coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15)
              ELSE CAST(voted_up AS DOUBLE) END AS sentiment_score
       FROM reviews LEFT JOIN sc USING (recommendation_id))
SELECT recommendation_id, sentiment_score, CASE WHEN sentiment_score > 0.05 THEN 'positive'
         WHEN sentiment_score < -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       abs(sentiment_score) AS sentiment_confidence FROM hy""", ["sentiment_score", "sentiment_confidence"]))
def q_hybrid_sentiment_learned(spark, sf):
    """English rows by valences learned from the votes of four fifths of the reviews."""
    df, lexicon = _voted(spark, sf)
    return se.hybrid_sentiment(df, scorer=va.valence_scorer(lexicon)).select(
        "recommendation_id", "sentiment_score", "sentiment_label", "sentiment_confidence")


@register("toxicity_baseline", rnd(f"""{R},
lab AS (SELECT text, toxic FROM documents JOIN labels USING (doc_id)), {_valences_sql("lab", "text", "toxic", least=4.0)},
base AS (SELECT ln((coalesce(sum(toxic), 0) + 1) / (count(toxic) - coalesce(sum(toxic), 0) + 1)) AS b FROM lab),
tk AS (SELECT recommendation_id, unnest(list_distinct({_tokens_sql("review")})) AS word FROM reviews),
sc AS (SELECT recommendation_id, CAST(sum(valence) AS DOUBLE) / 1000 AS s FROM tk JOIN lexicon USING (word) GROUP BY ALL),
pr AS (SELECT recommendation_id, 1 / (1 + exp(-((SELECT b FROM base) + coalesce(s, 0)))) AS toxicity_score
       FROM reviews LEFT JOIN sc USING (recommendation_id))
SELECT recommendation_id, toxicity_score, toxicity_score >= 0.5 AS is_toxic FROM pr""", ["toxicity_score"]))
def q_toxicity_baseline(spark, sf):
    """Log-odds of words between toxic and other labelled texts."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    model = se.train_toxicity_baseline(docs.select("text", "toxic"))
    return se.apply_toxicity_baseline(model, reviews(spark, sf)).select(
        "recommendation_id", "toxicity_score", "is_toxic")


def _matched_sql(words) -> str:
    return f"list_filter({S.lst(dict.fromkeys(words))}, lambda w: contains({LOW}, w))"


@register("aspect_mentions", f"""{R},
a AS (SELECT recommendation_id, {", ".join(f"{_matched_sql(ws)} AS {a}" for a, ws in L.ASPECTS.items())}
      FROM reviews),
long AS ({" UNION ALL ".join(f"SELECT recommendation_id, '{a}' AS aspect, {a} AS kw FROM a"
                              for a in L.ASPECTS)})
SELECT recommendation_id, aspect, array_to_string(kw, ',') AS keywords FROM long WHERE len(kw) > 0""")
def q_aspect_mentions(spark, sf):
    return se.aspect_mentions(reviews(spark, sf))


def _aspect_cols_sql() -> tuple[str, list[str], list[str]]:
    t = S.text()
    cols, doubles = [], []
    for a, ws in L.ASPECTS.items():
        kw = f"{_matched_sql(ws)}[1]"
        p0 = f"(instr({LOW}, {kw}) - 1)"
        s0 = f"greatest({p0} - 50, 0)"
        e0 = f"least(length({t}), {p0} + length({kw}) + 50)"
        ctx = f"lower(substring({t}, {s0} + 1, {e0} - {s0}))"
        lab, _, comp = _lex_sql(ctx)
        m = f"len({_matched_sql(ws)}) > 0"
        cols.append(f"CASE WHEN {m} THEN {lab} ELSE 'none' END AS aspect_{a}_sentiment")
        cols.append(f"CASE WHEN {m} THEN {comp} ELSE 0.0 END AS aspect_{a}_score")
        doubles.append(f"aspect_{a}_score")
    return ", ".join(cols), doubles, [f"aspect_{a}_sentiment" for a in L.ASPECTS]


ASPECT_COLS, ASPECT_DOUBLES, _ = _aspect_cols_sql()
ASPECT_NAMES = [c for a in L.ASPECTS for c in (f"aspect_{a}_sentiment", f"aspect_{a}_score")]


@register("aspect_sentiment", rnd(f"""{R}
SELECT recommendation_id, {ASPECT_COLS} FROM reviews""", ASPECT_DOUBLES))
def q_aspect_sentiment(spark, sf):
    return se.aspect_columns(reviews(spark, sf)).select("recommendation_id", *ASPECT_NAMES)


@register("enrich_sentiment", rnd(f"""{R}
SELECT recommendation_id, {_lex_sql(LOW)[0]} AS sentiment_label,
       {_lex_sql(LOW)[1]} AS sentiment_confidence, {_lex_sql(LOW)[2]} AS sentiment_score,
       CASE WHEN {S.lang_code()} = 'en' THEN 'neutral' ELSE 'unknown' END AS emotion_type,
       CAST(0.0 AS DOUBLE) AS emotion_score, false AS is_sarcasm, CAST(0.0 AS DOUBLE) AS sarcasm_score,
       false AS is_toxic, CAST(0.0 AS DOUBLE) AS toxicity_score, {ASPECT_COLS}
FROM reviews""", ["sentiment_confidence", "sentiment_score", *ASPECT_DOUBLES]))
def q_enrich_sentiment(spark, sf):
    d = se.enrich_sentiment(reviews(spark, sf), lang_col="language")
    return d.select("recommendation_id", "sentiment_label", "sentiment_confidence", "sentiment_score",
                    "emotion_type", "emotion_score", "is_sarcasm", "sarcasm_score", "is_toxic",
                    "toxicity_score", *ASPECT_NAMES)


def _intensity_sql(lists) -> str:
    parts = [f"{S.count_contained(LOW, ws, distinct=False)} * ({w})" for ws, w in lists]
    return f"({' + '.join(parts)} + CASE WHEN voted_up = 1 THEN 1 ELSE -1 END)"


INTENSITY_LISTS = [(L.INTENSITY_VERY_POSITIVE, 2), (L.INTENSITY_POSITIVE, 1),
                   (L.INTENSITY_VERY_NEGATIVE, -2), (L.INTENSITY_NEGATIVE, -1)]
TEST_INTENSITY = [(["tion", "que"], 2), (["ing", "les"], 1), (["heit", "ung"], -2), (["ver", "her"], -1)]


def _intensity_query(lists) -> str:
    s = _intensity_sql(lists)
    lab = (f"CASE WHEN {s} >= 2 THEN 'Very Positive' WHEN {s} >= 0 THEN 'Positive' "
           f"WHEN {s} >= -2 THEN 'Negative' ELSE 'Very Negative' END")
    return rnd(f"""{R}
SELECT app_id, sentiment_intensity, n, round(n / sum(n) OVER (PARTITION BY app_id) * 100, 2) AS pct
FROM (SELECT app_id, {lab} AS sentiment_intensity, count(*) AS n FROM reviews GROUP BY ALL)""", ["pct"])


@register("sentiment_intensity", _intensity_query(INTENSITY_LISTS))
def q_sentiment_intensity(spark, sf):
    return qu.sentiment_intensity(reviews(spark, sf), ["app_id"])


@register("sentiment_intensity_test_lexicon", _intensity_query(TEST_INTENSITY))
def q_sentiment_intensity_test(spark, sf):
    return qu.sentiment_intensity(reviews(spark, sf), ["app_id"], TEST_INTENSITY)


def _quality_sql() -> str:
    t, n = S.text(), S.word_count()
    return f"""(least(
  CASE WHEN {n} >= 500 THEN 25 WHEN {n} >= 200 THEN 20 WHEN {n} >= 100 THEN 15
       WHEN {n} >= 50 THEN 10 WHEN {n} > 0 THEN 5 ELSE 0 END
  + CASE WHEN {S.any_contained(LOW, L.QUALITY_DETAIL_WORDS)} THEN 15 ELSE 0 END
  + CASE WHEN contains({t}, '.') OR contains({t}, '。') THEN 10 ELSE 0 END
  + CASE WHEN contains({t}, chr(10)) THEN 5 ELSE 0 END
  + CASE WHEN len(list_distinct({S.words()})) > {n} * 0.3 THEN 5 ELSE 0 END
  + CASE WHEN voted_up = 1 THEN 10 ELSE 0 END, 100))"""


QUALITY = _quality_sql()


@register("quality_score", f"""{R}
SELECT recommendation_id, CAST({QUALITY} AS BIGINT) AS quality_score FROM reviews""")
def q_quality_score(spark, sf):
    return qu.with_quality(reviews(spark, sf)).select("recommendation_id", "quality_score")


@register("describe_quality", rnd(f"""{R},
b AS (SELECT app_id, CAST({QUALITY} AS DOUBLE) AS v FROM reviews)
SELECT app_id, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS "min",
       quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75,
       max(v) AS "max" FROM b GROUP BY app_id""", ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def q_describe_quality(spark, sf):
    return stats.describe_scores(qu.with_quality(reviews(spark, sf)), "quality_score", ["app_id"])


def _issues_sql(cats) -> str:
    rows = " UNION ALL ".join(
        f"SELECT app_id, '{n}' AS issue, count_if({S.any_contained(LOW, ws)}) AS count, "
        f"count_if({S.any_contained(LOW, ws)}) / count(*) * 100 AS pct FROM reviews GROUP BY app_id"
        for n, ws in cats.items())
    return rnd(f"{R} {rows}", ["pct"])


@register("detect_issues", _issues_sql(L.ISSUE_CATEGORIES))
def q_detect_issues(spark, sf):
    return qu.detect_issues(reviews(spark, sf), ["app_id"])


TEST_ISSUES = {"A": ["tion", "heit"], "B": ["ung", "que"], "C": ["ver", "zzzz"]}


@register("detect_issues_test_lexicon", _issues_sql(TEST_ISSUES))
def q_detect_issues_test(spark, sf):
    return qu.detect_issues(reviews(spark, sf), ["app_id"], TEST_ISSUES)


@register("issue_samples", f"""{R},
hits AS ({" UNION ALL ".join(f"SELECT app_id, '{n}' AS issue, recommendation_id, timestamp_created, {LOW} AS lo FROM reviews WHERE {S.any_contained(LOW, ws)}" for n, ws in TEST_ISSUES.items())})
SELECT app_id, issue, sample_rank, recommendation_id, substring(lo, 1, 100) AS sample FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY app_id, issue ORDER BY timestamp_created,
                                    recommendation_id) AS BIGINT) AS sample_rank FROM hits)
WHERE sample_rank <= 3""")
def q_issue_samples(spark, sf):
    return qu.issue_samples(reviews(spark, sf), 3, 100, ["app_id"], TEST_ISSUES)


SEGMENT_SQL = f"""CASE WHEN voted_up = 1 AND {S.word_count()} > 100 THEN 'Enthusiasts'
  WHEN voted_up = 1 AND {S.word_count()} > 20 THEN 'Satisfied'
  WHEN voted_up = 1 AND {S.word_count()} < 20 THEN 'Satisfied'
  WHEN voted_up <> 1 AND {S.word_count()} > 100 THEN 'Critical'
  WHEN voted_up <> 1 AND {S.word_count()} > 20 THEN 'Dissatisfied' ELSE 'Cautious' END"""


@register("segment_players", rnd(f"""{R},
s AS (SELECT app_id, {SEGMENT_SQL} AS segment FROM reviews),
seg AS (SELECT unnest({S.lst(L.SEGMENTS)}) AS segment),
apps AS (SELECT app_id, count(*) AS total FROM s GROUP BY app_id)
SELECT apps.app_id, seg.segment, count(s.segment) AS count, count(s.segment) / apps.total * 100 AS pct
FROM apps JOIN seg ON true LEFT JOIN s ON s.app_id = apps.app_id AND s.segment = seg.segment
GROUP BY apps.app_id, seg.segment, apps.total""", ["pct"]))
def q_segment_players(spark, sf):
    return qu.segment_players(reviews(spark, sf), ["app_id"])


@register("segment_samples", f"""{R}
SELECT app_id, segment, sample_rank, recommendation_id FROM (
  SELECT app_id, {SEGMENT_SQL} AS segment, recommendation_id,
         CAST(row_number() OVER (PARTITION BY app_id, {SEGMENT_SQL}
                                 ORDER BY timestamp_created, recommendation_id) AS BIGINT) AS sample_rank
  FROM reviews) WHERE sample_rank <= 3""")
def q_segment_samples(spark, sf):
    return qu.segment_samples(reviews(spark, sf), 3, ["app_id"])


@register("comparison_metrics", rnd(f"""{R}
SELECT app_id, CAST(sum({S.word_count()}) AS BIGINT) AS total_words, avg({S.word_count()}) AS avg_words,
       avg(voted_up) * 100 AS positive_rate, count(*) AS review_count,
       avg({QUALITY}) AS avg_quality_score FROM reviews GROUP BY app_id""",
                                    ["avg_words", "positive_rate", "avg_quality_score"]))
def q_comparison_metrics(spark, sf):
    return stats.comparison_metrics(qu.with_quality(reviews(spark, sf)), ["app_id"])


@register("top_reviews_quality", f"""{R}
SELECT app_id, rank, recommendation_id, review, quality_score, CAST(voted_up AS BIGINT) AS voted_up FROM (
  SELECT app_id, recommendation_id, review, CAST({QUALITY} AS BIGINT) AS quality_score, voted_up,
         CAST(row_number() OVER (PARTITION BY app_id ORDER BY {QUALITY} DESC, recommendation_id)
              AS BIGINT) AS rank FROM reviews) WHERE rank <= 5""")
def q_top_reviews_quality(spark, sf):
    return top_reviews(qu.with_quality(reviews(spark, sf)), 5, "quality_score", ["app_id"])
