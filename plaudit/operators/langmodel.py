"""Language detection by a character n-gram model learned from texts of known language.

Training counts distinct words per language first, so n-grams are cut from each distinct
word once and weighted by its count; all counts are grouped sums. The ``max_grams`` most
frequent n-grams over all languages form the model (its bound: languages times
``max_grams`` numbers), with add-one smoothed log probabilities in whole millionths, so
that sums are exact and do not depend on their order. Scoring is naive Bayes with equal
priors in one Arrow pass without a shuffle; a worker scores each distinct word once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions import alpha_tokens, is_blank, script_language

MAX_GRAMS = 20_000
CACHE_WORDS = 200_000


def _grams(word: str, lo: int, hi: int) -> Column:
    """All n-grams of a word between two spaces, as an array."""
    w = F.concat(F.lit(" "), F.col(word), F.lit(" "))
    size = F.length(w)

    def grams(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(w, i, F.lit(n)))
        return F.when(size >= n, cut).otherwise(F.array())

    return F.flatten(F.array(*[grams(n) for n in range(lo, hi + 1)]))


def language_model(df: DataFrame, text: str = "review", lang: str = "language", lo: int = 1, hi: int = 4,
                   max_grams: int = MAX_GRAMS) -> DataFrame:
    """``(language, gram, n, log_p)``: count of each kept n-gram in a language's texts and
    its log probability in millionths. Ties at the bound go to the smaller gram. Rows
    without text or language are left out."""
    words = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("language"), F.explode(alpha_tokens(text)).alias("word"))
    words = words.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = words.select("language", "n", F.explode(_grams("word", lo, hi)).alias("gram")) \
        .groupBy("language", "gram").agg(F.sum("n").alias("n"))
    kept = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.col("all").desc(), "gram") \
        .limit(max_grams).select("gram")
    counts = counts.join(kept, "gram")
    total = counts.groupBy("language").agg(F.sum("n").alias("total")).select(
        F.map_from_entries(F.collect_list(F.struct("language", "total"))))  # a row, an entry per language
    grid = kept.select("gram", F.explode(total.scalar()).alias("language", "total"))
    return grid.join(counts, ["language", "gram"], "left").select(
        "language", "gram", F.coalesce("n", F.lit(0)).alias("n"),
        F.round(F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + max_grams)) * 1e6).cast("long")
        .alias("log_p"))


class NgramScorer:
    """Naive Bayes over a collected model; languages in order of name."""

    def __init__(self, languages: list[str], table: dict[str, np.ndarray], lo: int, hi: int):
        self.languages, self.table, self.lo, self.hi = languages, table, lo, hi
        self.known: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            w, got = f" {word} ", np.zeros(len(self.languages), np.int64)
            for n in range(self.lo, self.hi + 1):
                for k in range(len(w) - n + 1):
                    p = self.table.get(w[k:k + n])
                    if p is not None:
                        got = got + p
            self.known[word] = got
        return got

    def best(self, words: list[str]) -> str | None:
        """The likeliest language (ties: the first by name); None without any gram."""
        score = sum((self.word(w) * k for w, k in Counter(words).items()), np.zeros(len(self.languages), np.int64))
        return self.languages[int(score.argmax())] if score.any() else None


def ngram_language(model: DataFrame, lo: int = 1, hi: int = 4):
    """Column of a text -> likeliest language (null without letters of the model). The
    model's rows are collected: at most languages x ``max_grams``."""
    rows = model.select("language", "gram", "log_p").toPandas()
    languages = sorted(rows["language"].unique())
    table = {g: np.array(p, np.int64) for g, p in rows.sort_values("language").groupby("gram")["log_p"].agg(list).items()}
    shared = model.sparkSession.sparkContext.broadcast((languages, table, lo, hi))

    @F.pandas_udf("string")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = NgramScorer(*shared.value)
        for words in batches:
            yield pd.Series([scorer.best(list(w)) for w in words], dtype=object)

    return lambda text: detect(alpha_tokens(text))


def detect_language_ngrams(df: DataFrame, model: DataFrame, col: str = "review", out: str = "detected_language",
                           lo: int = 1, hi: int = 4) -> DataFrame:
    """blank -> 'unknown'; kana, ideographs and hangul by script; else the likeliest
    language of the model; 'en' without any letter that it knows."""
    script = script_language(col)
    by_model = ngram_language(model, lo, hi)
    own = F.when(is_blank(col), F.lit("unknown")).when(script != "en", script)
    return df.withColumn("_own", own).withColumn(
        out, F.coalesce("_own", by_model(F.when(F.col("_own").isNull(), F.col(col))), F.lit("en"))).drop("_own")
