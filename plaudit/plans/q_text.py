"""Registered queries for text, keywords, topics and language (2-F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.functions import clean_text, lang_code, script_language, tokenize_zh
from plaudit.operators import keywords as kw
from plaudit.operators import langmodel as lm
from plaudit.operators import language as lg
from plaudit.operators import lda
from plaudit.operators import topics as tp
from plaudit.operators import wordseg as ws
from plaudit.plans import sqlgen as S
from plaudit.plans.registry import register, rnd
from plaudit.sources.fixtures import REVIEWS_CTE_SQL, reviews

R = f"WITH {REVIEWS_CTE_SQL}"
TOK = f"""tok AS (SELECT *, {S.tokens_en(S.clean())} AS tokens FROM reviews)"""
DAYMONTH = "CAST(date_trunc('month', to_timestamp(timestamp_created) AT TIME ZONE 'UTC') AS DATE)"


def _top(inner: str, keys: list[str], term: str, n: int) -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    ks = ", ".join(keys) + ", " if keys else ""
    return f"""SELECT {ks}{term}, count, rank FROM (
  SELECT {ks}{term}, count, CAST(row_number() OVER ({part}ORDER BY count DESC, {term}) AS BIGINT) AS rank
  FROM (SELECT {ks}{term}, count(*) AS count FROM ({inner}) GROUP BY ALL)) WHERE rank <= {n}"""


@register("clean_text", f"""{R}
SELECT recommendation_id, {S.clean()} AS cleaned FROM reviews""")
def q_clean_text(spark, sf):
    return reviews(spark, sf).select("recommendation_id", clean_text("review").alias("cleaned"))


@register("keyword_counts", f"""{R}, {TOK}
{_top("SELECT unnest(tokens) AS word FROM tok", [], "word", 50)}""")
def q_keyword_counts(spark, sf):
    return kw.keyword_counts(reviews(spark, sf), 50)


@register("keyword_counts_by_app", f"""{R}, {TOK}
{_top("SELECT app_id, unnest(tokens) AS word FROM tok", ["app_id"], "word", 10)}""")
def q_keyword_counts_by_app(spark, sf):
    return kw.keyword_counts(reviews(spark, sf), 10, ["app_id"])


@register("keyword_summary", rnd(f"""{R}, {TOK},
c AS (SELECT word, count(*) AS count FROM (SELECT unnest(tokens) AS word FROM tok) GROUP BY word),
t AS (SELECT count FROM c ORDER BY count DESC, word LIMIT 50)
SELECT (SELECT count(*) FROM c) AS total_unique, (SELECT avg(count) FROM t) AS average_frequency""",
                                  ["average_frequency"]))
def q_keyword_summary(spark, sf):
    return kw.keyword_summary(reviews(spark, sf), 50)


@register("bigram_counts", f"""{R}, {TOK}
{_top(f"SELECT unnest({S.ngrams('tokens', 2, 2)}) AS bigram FROM tok", [], "bigram", 30)}""")
def q_bigram_counts(spark, sf):
    return kw.bigram_counts(reviews(spark, sf), 30)


@register("word_cloud_weights", f"""{R}, {TOK},
top AS ({_top("SELECT unnest(tokens) AS word FROM tok", [], "word", 100)})
SELECT word, CAST(CASE WHEN max(count) OVER () = min(count) OVER () THEN 1
       ELSE floor(1 + (count - min(count) OVER ()) / (max(count) OVER () - min(count) OVER ()) * 99)
       END AS BIGINT) AS size, count AS frequency FROM top""")
def q_word_cloud(spark, sf):
    return kw.word_cloud_weights(reviews(spark, sf), 100)


PRE = f"""pre AS (SELECT *, {S.preprocess()} AS ptoks FROM reviews WHERE NOT {S.is_blank()})"""


@register("polarity_keywords", f"""{R}, {PRE}
{_top(f"SELECT voted_up, unnest({S.ngrams('ptoks', 1, 3)}) AS ngram FROM pre", ["voted_up"], "ngram", 20)}""")
def q_polarity_keywords(spark, sf):
    return kw.polarity_keywords(reviews(spark, sf), (1, 3), 20)


@register("language_keywords", f"""{R}, {PRE}
{_top(f"SELECT language, voted_up, unnest({S.ngrams('ptoks', 1, 3)}) AS ngram FROM pre",
      ["language", "voted_up"], "ngram", 20)}""")
def q_language_keywords(spark, sf):
    return kw.language_keywords(reviews(spark, sf), (1, 3), 20)


@register("monthly_keywords", f"""{R}, {PRE}
{_top(f"SELECT {DAYMONTH} AS month, voted_up, unnest({S.ngrams('ptoks', 1, 2)}) AS ngram FROM pre",
      ["month", "voted_up"], "ngram", 10)}""")
def q_monthly_keywords(spark, sf):
    return kw.monthly_keywords(reviews(spark, sf), 10)


def _topic_scores_sql(topics: dict, n: int | None, by_app: bool) -> str:
    c = S.clean()
    ks = "app_id, " if by_app else ""
    grp = "GROUP BY app_id" if by_app else ""
    sums = ", ".join(f"CAST(sum({S.count_contained(c, ws, distinct=False)}) AS BIGINT) AS t{i}"
                     for i, ws in enumerate(topics.values()))
    rows = " UNION ALL ".join(f"SELECT {ks}{S.q(name)} AS topic, CAST({i} AS BIGINT) AS topic_order, t{i} AS score FROM agg"
                              for i, name in enumerate(topics))
    part = "PARTITION BY app_id " if by_app else ""
    body = f"""{R},
agg AS (SELECT {ks}{sums} FROM reviews {grp}),
long AS ({rows}),
pct AS (SELECT *, CASE WHEN sum(score) OVER ({part}) > 0 THEN score / sum(score) OVER ({part}) * 100 END AS pct
        FROM long)"""
    if n is None:
        return rnd(f"{body} SELECT * FROM pct", ["pct"])
    return rnd(f"""{body}
SELECT * FROM (SELECT *, CAST(row_number() OVER ({part}ORDER BY score DESC, topic_order) AS BIGINT) AS rank
               FROM pct) WHERE rank <= {n}""", ["pct"])


@register("topic_scores", _topic_scores_sql(L.TOPIC_KEYWORDS, 5, False))
def q_topic_scores(spark, sf):
    return kw.topic_scores(reviews(spark, sf), 5)


TEST_TOPICS = {"tion": ["tion", "sion"], "ing": ["ing", "ung"], "que": ["que", "qui"],
               "les": ["les", "le "], "her": ["her", "heit"]}


@register("topic_scores_test_lexicon", _topic_scores_sql(TEST_TOPICS, None, True))
def q_topic_scores_test(spark, sf):
    """Same operator with a lexicon that occurs in the invented test prose."""
    return kw.topic_scores(reviews(spark, sf), None, ["app_id"], topics=TEST_TOPICS)


def _sentiment_by_topic_sql(topics: dict) -> str:
    lo = S.low()
    rows = " UNION ALL ".join(
        f"""SELECT {S.q(name)} AS topic, count_if({S.any_contained(lo, ws)}) AS review_count,
              round(avg(CASE WHEN {S.any_contained(lo, ws)} THEN CAST(voted_up AS DOUBLE) END) * 100, 1)
                AS positive_rate,
              count_if({S.any_contained(lo, ws)}) / count(*) * 100 AS pct_of_total FROM reviews"""
        for name, ws in topics.items())
    return rnd(f"{R} SELECT * FROM ({rows}) WHERE review_count > 0", ["positive_rate", "pct_of_total"])


@register("sentiment_by_topic", _sentiment_by_topic_sql(L.TOPIC_SENTIMENT_KEYWORDS))
def q_sentiment_by_topic(spark, sf):
    return kw.sentiment_by_topic(reviews(spark, sf))


@register("sentiment_by_topic_test_lexicon", _sentiment_by_topic_sql(TEST_TOPICS))
def q_sentiment_by_topic_test(spark, sf):
    return kw.sentiment_by_topic(reviews(spark, sf), topics=TEST_TOPICS)


@register("corpus_has_cjk", f"""{R}
SELECT CAST(coalesce(max(CASE WHEN regexp_matches(coalesce(review, ''), '[\\x{{4e00}}-\\x{{9fff}}]')
                     THEN 1 ELSE 0 END), 0) AS BIGINT) AS has_cjk
FROM reviews""")
def q_corpus_has_cjk(spark, sf):
    return kw.corpus_has_cjk(reviews(spark, sf))


def _script_sql(text: str, kana_first: bool = True) -> str:
    kana = f"WHEN regexp_matches({text}, '[\\x{{3040}}-\\x{{309f}}\\x{{30a0}}-\\x{{30ff}}]') THEN 'ja' "
    han = f"WHEN regexp_matches({text}, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh' "
    first, second = (kana, han) if kana_first else (han, kana)
    return (f"CASE {first}{second}WHEN regexp_matches({text}, '[\\x{{ac00}}-\\x{{d7af}}]') THEN 'ko' "
            "ELSE 'en' END")


SCRIPT_SQL = _script_sql(S.text())
#: letters swapped for other scripts, so that texts hold kana, ideographs and hangul
SWAPS = {0: ("aeiou", "かなカタん"), 1: ("thern", "漢字文学人"), 2: ("aethn", "かな漢字人"), 3: ("aeton", "한국어문장")}
_SWAP_SQL = "CASE CAST(recommendation_id AS BIGINT) % 5 " + " ".join(
    f"WHEN {k} THEN translate(review, '{a}', '{b}')" for k, (a, b) in SWAPS.items()) + " ELSE review END"


def _swapped(df):
    k = F.col("recommendation_id").cast("long") % 5
    text = F.when(k == 0, F.translate("review", *SWAPS[0]))
    for i in (1, 2, 3):
        text = text.when(k == i, F.translate("review", *SWAPS[i]))
    return df.withColumn("review", text.otherwise(F.col("review")))


@register("detect_language_scripts", f"""{R}, s AS (SELECT {_SWAP_SQL} AS review FROM reviews),
d AS (SELECT {_script_sql("review")} AS script, {_script_sql("review", False)} AS legacy FROM s
      WHERE regexp_matches(review, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}]'))
SELECT script AS detected_language, legacy AS legacy_language, count(*) AS n FROM d GROUP BY ALL""")
def q_detect_language_scripts(spark, sf):
    """Texts with kana, ideographs and hangul derived from the reviews."""
    df = _swapped(reviews(spark, sf)).where(
        F.col("review").rlike(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"))
    out = lg.detect_language(lg.detect_language(df), out="legacy_language", legacy_order=True)
    return out.groupBy("detected_language", "legacy_language").agg(F.count(F.lit(1)).alias("n"))


@register("language_codes", f"""{R}
SELECT language, {S.lang_code()} AS lang_code, {SCRIPT_SQL} AS script_language, count(*) AS n
FROM reviews GROUP BY ALL""")
def q_language_codes(spark, sf):
    df = reviews(spark, sf)
    return df.groupBy("language", lang_code("language").alias("lang_code"),
                      script_language("review").alias("script_language")).agg(
        F.count(F.lit(1)).alias("n"))


def _profile_sql() -> str:
    toks = f"list_distinct({S.alpha_tokens()})"
    scores = [f"len(list_intersect({toks}, {S.lst(ws)}))" for ws in lg.PROFILES.values()]
    best = f"greatest({', '.join(scores)})"
    cases = " ".join(f"WHEN {s} = {best} THEN {S.q(l)}" for l, s in zip(lg.PROFILES, scores))
    return f"CASE WHEN {best} > 0 THEN (CASE {cases} END) END"


@register("detect_language", f"""{R}
SELECT language, CASE WHEN {S.is_blank()} THEN 'unknown'
                      WHEN ({SCRIPT_SQL}) <> 'en' THEN ({SCRIPT_SQL})
                      ELSE coalesce({_profile_sql()}, 'en') END AS detected_language,
       count(*) AS n
FROM reviews GROUP BY ALL""")
def q_detect_language(spark, sf):
    return lg.detect_language(reviews(spark, sf)).groupBy("language", "detected_language").agg(
        F.count(F.lit(1)).alias("n"))


_GRAMS = " || ".join(f"list_transform(range(1, length(word) + {3 - n + 1}), lambda i: substr(' ' || word || ' ', i, {n}))"
                     for n in range(1, 5))
_TRAINED = f"""wd AS (SELECT language, word, count(*) AS n FROM (
  SELECT language, unnest({S.alpha_tokens()}) AS word FROM reviews
  WHERE review IS NOT NULL AND language IS NOT NULL AND CAST(recommendation_id AS BIGINT) % 5 <> 0) GROUP BY ALL),
cn AS (SELECT language, gram, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT language, n, unnest({_GRAMS}) AS gram FROM wd) GROUP BY ALL),
kp AS (SELECT gram FROM cn GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {lm.MAX_GRAMS}),
tt AS (SELECT language, sum(n) AS total FROM cn SEMI JOIN kp USING (gram) GROUP BY language),
model AS (SELECT language, gram, coalesce(n, 0) AS n,
                 CAST(round(ln((coalesce(n, 0) + 1) / (total + {lm.MAX_GRAMS})) * 1e6) AS BIGINT) AS log_p
          FROM (SELECT * FROM kp, tt) LEFT JOIN cn USING (language, gram))"""


def _trained(spark, sf):
    """The model of the reviews whose id isn't divisible by five."""
    df = reviews(spark, sf)
    return df, lm.language_model(df.where(F.col("recommendation_id").cast("long") % 5 != 0))


@register("language_model", f"{R}, {_TRAINED} SELECT language, gram, n, log_p FROM model")
def q_language_model(spark, sf):
    """Character n-gram counts and log probabilities per language."""
    return _trained(spark, sf)[1]


@register("detect_language_ngrams", f"""{R}, {_TRAINED},
held AS (SELECT recommendation_id, language, review FROM reviews WHERE CAST(recommendation_id AS BIGINT) % 5 = 0),
tk AS (SELECT recommendation_id, unnest({S.alpha_tokens()}) AS word FROM held),
ws AS (SELECT word, m.language, sum(log_p) AS s FROM (
         SELECT word, unnest({_GRAMS}) AS gram FROM (SELECT DISTINCT word FROM tk)) JOIN model m USING (gram)
       GROUP BY ALL),
ds AS (SELECT recommendation_id, ws.language AS found, sum(s) AS s FROM tk JOIN ws USING (word) GROUP BY ALL),
best AS (SELECT recommendation_id, found FROM ds
         QUALIFY row_number() OVER (PARTITION BY recommendation_id ORDER BY s DESC, found) = 1)
SELECT recommendation_id, language, CASE WHEN {S.is_blank()} THEN 'unknown'
         WHEN ({SCRIPT_SQL}) <> 'en' THEN ({SCRIPT_SQL}) ELSE coalesce(found, 'en') END AS detected_language
FROM held LEFT JOIN best USING (recommendation_id)""")
def q_detect_language_ngrams(spark, sf):
    """Languages of the reviews that the model has not seen."""
    df, model = _trained(spark, sf)
    held = df.where(F.col("recommendation_id").cast("long") % 5 == 0).drop("detected_language")
    return lm.detect_language_ngrams(held, model).select("recommendation_id", "language", "detected_language")


_PIECES = f"regexp_extract_all({S.clean()}, '[{S.CJK}]+|[a-z0-9]+')"


@register("chinese_tokens", f"""{R},
pc AS (SELECT unnest({_PIECES}) AS piece FROM reviews),
tk AS (SELECT unnest(CASE WHEN length(piece) > 1 AND regexp_matches(piece, '[{S.CJK}]')
                          THEN list_transform(range(1, length(piece)), lambda i: substr(piece, i, 2))
                          ELSE [piece] END) AS token FROM pc)
SELECT token, count(*) AS count FROM tk WHERE NOT list_contains({S.lst(L.STOP_WORDS_ZH)}, token) GROUP BY token""")
def q_chinese_tokens(spark, sf):
    df = reviews(spark, sf)
    toks = tokenize_zh(clean_text("review"))
    return df.select(F.explode(toks).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("count"))


_STATS = f"""s AS (SELECT recommendation_id, {_SWAP_SQL} AS review FROM reviews),
rc AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all({S.clean()}, '[{S.CJK}]+')) AS run FROM s)
       GROUP BY run),
ri AS (SELECT run, n, unnest(range(1, length(run) + 1)) AS i FROM rc),
rk AS (SELECT run, n, i, unnest(range(1, least({ws.LONGEST}, length(run) - i + 1) + 1)) AS k FROM ri),
gc AS (SELECT substr(run, i, k) AS gram, CASE WHEN i > 1 THEN substr(run, i - 1, 1) ELSE '' END AS before,
              substr(run, i + k, 1) AS behind, sum(n) AS n FROM rk GROUP BY ALL),
hb AS (SELECT gram, sum(m) AS n, ln(sum(m)) - sum(CASE WHEN before <> '' THEN m * ln(m) ELSE 0 END) / sum(m) AS h
       FROM (SELECT gram, before, sum(n) AS m FROM gc GROUP BY ALL) GROUP BY gram),
ha AS (SELECT gram, ln(sum(m)) - sum(CASE WHEN behind <> '' THEN m * ln(m) ELSE 0 END) / sum(m) AS h
       FROM (SELECT gram, behind, sum(n) AS m FROM gc GROUP BY ALL) GROUP BY gram),
st AS (SELECT gram, CAST(n AS BIGINT) AS n, least(hb.h, ha.h) AS freedom FROM hb JOIN ha USING (gram)),
pt AS (SELECT gram, n, freedom, unnest(range(1, length(gram))) AS k FROM st WHERE length(gram) > 1 AND n >= 5),
co AS (SELECT pt.gram, pt.n, pt.freedom, max(CAST(l.n AS DOUBLE) * r.n) AS most
       FROM pt JOIN st l ON l.gram = substr(pt.gram, 1, k) JOIN st r ON r.gram = substr(pt.gram, k + 1) GROUP BY ALL),
words AS (SELECT gram, n, ln(n * (SELECT CAST(sum(n) AS DOUBLE) FROM st WHERE length(gram) = 1) / most) AS cohesion,
                 freedom FROM co
          UNION ALL SELECT gram, n, NULL, NULL FROM st WHERE length(gram) = 1)"""


@register("word_statistics", rnd(f"{R}, {_STATS} SELECT * FROM words", ["cohesion", "freedom"]))
def q_word_statistics(spark, sf):
    """Cohesion and freedom of n-grams of ideographs (texts derived from the reviews)."""
    return ws.word_statistics(_swapped(reviews(spark, sf)))


@register("discovered_words", f"""{R}, {_STATS}
SELECT gram AS word, n FROM words WHERE cohesion IS NULL OR (cohesion >= 1.0 AND freedom >= 0.5)""")
def q_discovered_words(spark, sf):
    return ws.discover_words(ws.word_statistics(_swapped(reviews(spark, sf))))


@register("segmented_tokens", note="most probable cut; brute force over all cuts in tests")
def q_segmented_tokens(spark, sf):
    """Tokens of all reviews, cut by the words discovered in them."""
    df = _swapped(reviews(spark, sf))
    words = ws.discover_words(ws.word_statistics(df))
    return ws.segment(df, words).select(F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("count"))


@register("topic_model_lda", note="online LDA (seed 42); iterative ML, rows-only check")
def q_topic_model_lda(spark, sf):
    model, docs = tp.fit_lda(reviews(spark, sf), k=10, max_iter=10)
    return tp.topic_terms(model, 10)


@register("topic_model_lda_table", note="variational EM, topics as a table; properties in tests")
def q_topic_model_lda_table(spark, sf):
    model = lda.fit_lda_table(reviews(spark, sf), k=10, rounds=10)
    return lda.lda_terms(model, 10)


@register("topic_summary_lda", note="dominant LDA topic per review, counted; rows-only")
def q_topic_summary(spark, sf):
    model, docs = tp.fit_lda(reviews(spark, sf), k=10, max_iter=10)
    return tp.topic_summary(tp.document_topics(model, docs))


@register("topic_model_nmf", note="multiplicative updates; iterative, properties in tests")
def q_topic_model_nmf(spark, sf):
    terms, _, _ = tp.fit_nmf(reviews(spark, sf), tolerance=0.01)
    return tp.nmf_topic_terms(terms, 10)
