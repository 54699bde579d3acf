"""Keywords, n-grams and keyword-list topics (2-F).

Token tables are built per review (``explode``) and counted with a hash
aggregate, so frequent words are combined map-side before the shuffle; the
text is never concatenated or collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaudit.functions.cleaning import round_to

from plaudit import lexicons as L
from plaudit.functions import (any_contained, clean_text, count_contained, is_blank, lang_code,
                               lower_text, ngrams, preprocess_tokens, tokenize_en, tokenize_zh)
from plaudit.operators.scan import top_n_per_group
from plaudit.session import scratch_path

Keys = Sequence[str]


def _keys(keys) -> list[str]:
    return [] if keys is None else ([keys] if isinstance(keys, str) else list(keys))


def with_tokens(df: DataFrame, mode: str = "english", col: str = "review") -> DataFrame:
    """Add ``tokens``: cleaned-text tokens (English rule, or CJK bigrams for 'chinese',
    or per row by script for 'auto')."""
    cleaned = clean_text(col)
    if mode == "english":
        toks = tokenize_en(cleaned)
    elif mode == "chinese":
        toks = tokenize_zh(cleaned)
    else:
        toks = F.when(cleaned.rlike(r"[\x{4e00}-\x{9fff}]"), tokenize_zh(cleaned)).otherwise(
            tokenize_en(cleaned))
    return df.withColumn("tokens", toks)


def english_token_rows(df: DataFrame, keys: Keys | None = None, col: str = "review",
                       term_name: str = "word", min_len: int = 3,
                       stop_words=L.STOP_WORDS_EN) -> DataFrame:
    """One row per English token: explode the split cleaned text, then filter with
    plain predicates (hash-set ``isin``), which stays in generated code."""
    ks = _keys(keys)
    w = df.select(*ks, F.explode(F.split(clean_text(col), " ")).alias(term_name))
    return w.where((F.length(term_name) >= min_len) & ~F.col(term_name).isin(list(dict.fromkeys(stop_words))))


def term_counts(df: DataFrame, terms: Column, keys: Keys | None = None,
                term_name: str = "term") -> DataFrame:
    ks = _keys(keys)
    return (df.select(*ks, F.explode(terms).alias(term_name))
              .groupBy(*ks, term_name).agg(F.count(F.lit(1)).alias("count")))


def top_terms(counts: DataFrame, n: int, keys: Keys | None = None, term_name: str = "term") -> DataFrame:
    """Top n by count (ties: term ascending)."""
    return top_n_per_group(counts, _keys(keys), [F.col("count").desc(), F.col(term_name)], n)


def keyword_counts(df: DataFrame, top_n: int = 50, keys: Keys | None = None,
                   mode: str = "english") -> DataFrame:
    if mode == "english":
        ks = _keys(keys)
        counts = english_token_rows(df, ks).groupBy(*ks, "word").agg(F.count(F.lit(1)).alias("count"))
        return top_terms(counts, top_n, keys, "word")
    t = with_tokens(df, mode)
    return top_terms(term_counts(t, F.col("tokens"), keys, "word"), top_n, keys, "word")


def keyword_summary(df: DataFrame, top_n: int = 50, keys: Keys | None = None,
                    mode: str = "english") -> DataFrame:
    """Distinct keyword total and the mean count of the top n."""
    ks = _keys(keys)
    if mode == "english":
        counts = english_token_rows(df, ks).groupBy(*ks, "word").agg(F.count(F.lit(1)).alias("count"))
    else:
        counts = term_counts(with_tokens(df, mode), F.col("tokens"), ks, "word")
    top = top_terms(counts, top_n, ks, "word")
    # two one-row-per-group results combined by union + aggregate (no join)
    u = counts.groupBy(*ks).agg(F.count(F.lit(1)).alias("total_unique"),
                                F.lit(None).cast("double").alias("average_frequency"))
    a = top.groupBy(*ks).agg(F.lit(None).cast("long").alias("total_unique"),
                             F.avg("count").alias("average_frequency"))
    return u.unionByName(a).groupBy(*ks).agg(F.max("total_unique").alias("total_unique"),
                                             F.max("average_frequency").alias("average_frequency"))


def bigram_counts(df: DataFrame, top_n: int = 30, keys: Keys | None = None,
                  mode: str = "english") -> DataFrame:
    """Adjacent token pairs inside one review (after stop-word removal)."""
    t = with_tokens(df, mode)
    return top_terms(term_counts(t, ngrams(F.col("tokens"), 2, 2), keys, "bigram"), top_n, keys,
                     "bigram")


def word_cloud_weights(df: DataFrame, top_n: int = 100, keys: Keys | None = None) -> DataFrame:
    """size = int(1 + (f - min) / (max - min) * 99) over the top n; all equal -> 1."""
    ks = _keys(keys)
    top = keyword_counts(df, top_n, ks)
    w = Window.partitionBy(*ks)
    lo, hi = F.min("count").over(w), F.max("count").over(w)
    size = F.when(hi == lo, F.lit(1)).otherwise(
        F.floor(F.lit(1) + (F.col("count") - lo) / (hi - lo) * 99)).cast("long")
    return top.select(*ks, "word", size.alias("size"), F.col("count").alias("frequency"))


def polarity_keywords(df: DataFrame, n_range: tuple[int, int] = (1, 3), top: int = 20,
                      keys: Keys | None = None, remove_stop_words: bool = True,
                      extra_keys: Keys = ()) -> DataFrame:
    """Top n-grams (lo..hi, per review, alphabetic tokens) for positive and for
    negative reviews; blank reviews skipped. No n-gram is more frequent than any of its
    words: words are counted first, and longer n-grams only of words that reach the count
    of the group's ``top``-th word (all its words if there are fewer)."""
    ks = [*_keys(keys), *extra_keys, "voted_up"]
    base = df.where(~is_blank("review"))
    lang = F.col("language") if "language" in df.columns else None
    # materialise the token array first: n-gram lambdas must reference a column,
    # not re-run the tokenizer for every position
    base = base.withColumn("_ptoks", preprocess_tokens("review", lang, remove_stop_words))
    lo, hi = n_range
    if lo != 1 or hi == 1:
        return top_terms(term_counts(base, ngrams(F.col("_ptoks"), lo, hi), ks, "ngram"), top, ks, "ngram")
    words = _frequent_words(base, ks, top)
    shifted = [F.slice("_ptoks", k + 1, F.greatest(F.size("_ptoks"), F.lit(1))).alias(f"_w{k}") for k in range(hi)]
    grams = base.select(*ks, F.inline(F.arrays_zip(*shifted)))
    for k in range(hi):
        known = words.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(ks)],
                             F.col("ngram").alias(f"_f{k}"))
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(ks)]
        # a place counts as far as its words are frequent
        grams = grams.join(known, [*same, F.col(f"_w{k}") == F.col(f"_f{k}")], "inner" if k < 2 else "left") \
            .drop(*[f"_k{i}" for i in range(len(ks))], f"_w{k}")
    parts, whole = [], F.lit(True)
    for k in range(1, hi):
        whole = whole & F.col(f"_f{k}").isNotNull()
        parts.append(F.when(whole, F.concat_ws(" ", *[f"_f{i}" for i in range(k + 1)])))
    longer = term_counts(grams, F.array_compact(F.array(*parts)), ks, "ngram")
    return top_terms(words.unionByName(longer), top, ks, "ngram")


def _frequent_words(base: DataFrame, ks: list[str], top: int) -> DataFrame:
    """(keys, ngram, count) of each group's words with the count of its ``top``-th word or
    more, ties included; written, as each length of n-gram asks for them."""
    counts = term_counts(base, F.col("_ptoks"), ks, "ngram")
    rank = F.rank().over(Window.partitionBy(*ks).orderBy(F.col("count").desc()))
    kept = counts.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")
    path = scratch_path(base.sparkSession, f"keywords/words-{uuid.uuid4().hex}")
    kept.write.parquet(path)
    return base.sparkSession.read.schema(kept.schema).parquet(path)


def language_keywords(df: DataFrame, n_range=(1, 3), top: int = 20, keys: Keys | None = None,
                      lang_col: str = "language") -> DataFrame:
    """polarity_keywords per language x polarity."""
    return polarity_keywords(df, n_range, top, keys, extra_keys=[lang_col])


def monthly_keywords(df: DataFrame, k: int = 10, keys: Keys | None = None) -> DataFrame:
    """Top k 1-2-grams per month x polarity."""
    m = df.withColumn("month", F.date_trunc("month", F.timestamp_seconds("timestamp_created"))
                      .cast("date"))
    return polarity_keywords(m, (1, 2), k, keys, extra_keys=["month"])


def _unpivot_sums(df: DataFrame, ks: list[str], names: list[str], value: str) -> DataFrame:
    cols = [f"_t{i}" for i in range(len(names))]
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("topic"), F.lit(i).alias("topic_order"),
                                           F.col(c).alias(value))
                                  for i, (n, c) in enumerate(zip(names, cols))]))
    return df.select(*ks, stacked.alias("_s")).select(*ks, "_s.*")


def topic_scores(df: DataFrame, num_topics: int | None = 5, keys: Keys | None = None,
                 topics: dict[str, list[str]] | None = None) -> DataFrame:
    """Per topic: total number of topic keywords contained in each cleaned review,
    summed; share of all topic hits; top ``num_topics`` (ties: topic list order)."""
    ks = _keys(keys)
    topics = topics or L.TOPIC_KEYWORDS
    names = list(topics)
    c = clean_text("review")
    sums = [F.sum(count_contained(c, topics[n], distinct=False)).cast("long").alias(f"_t{i}")
            for i, n in enumerate(names)]
    agg = df.groupBy(*ks).agg(*sums) if ks else df.agg(*sums)
    long = _unpivot_sums(agg, ks, names, "score")
    w = Window.partitionBy(*ks)
    long = long.withColumn("pct", F.when(F.sum("score").over(w) > 0,
                                         F.col("score") / F.sum("score").over(w) * 100))
    if num_topics is None:
        return long
    return top_n_per_group(long, ks, [F.col("score").desc(), F.col("topic_order")], num_topics)


def sentiment_by_topic(df: DataFrame, keys: Keys | None = None,
                       topics: dict[str, list[str]] | None = None) -> DataFrame:
    """Per topic: reviews mentioning any keyword (raw lower text), positive % (1 dp),
    share of all reviews; topics without mentions are omitted."""
    ks = _keys(keys)
    topics = topics or L.TOPIC_SENTIMENT_KEYWORDS
    names = list(topics)
    low = lower_text("review")
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, n in enumerate(names):
        m = any_contained(low, topics[n])
        aggs += [F.count_if(m).alias(f"_c{i}"),
                 F.avg(F.when(m, F.col("voted_up").cast("double"))).alias(f"_p{i}")]
    agg = df.groupBy(*ks).agg(*aggs) if ks else df.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("topic"), F.col(f"_c{i}").alias("review_count"),
                                           round_to(F.col(f"_p{i}") * 100, 1).alias("positive_rate"),
                                           (F.col(f"_c{i}") / F.col("_total") * 100).alias("pct_of_total"))
                                  for i, n in enumerate(names)]))
    out = agg.select(*ks, stacked.alias("_s")).select(*ks, "_s.*")
    return out.where(F.col("review_count") > 0)


def corpus_has_cjk(df: DataFrame, sample: int | None = None) -> DataFrame:
    """Whether any review contains CJK ideographs; with ``sample``, whether any of the
    first ones (by time, id) does."""
    rows = df if sample is None else df.orderBy("timestamp_created", "recommendation_id").limit(sample)
    return rows.agg(F.coalesce(F.max(F.coalesce(F.col("review"), F.lit(""))
                                     .rlike(r"[\x{4e00}-\x{9fff}]").cast("int")), F.lit(0))
                    .alias("has_cjk"))
