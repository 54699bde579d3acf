"""Valences learned from votes, and a scorer with negation and booster scopes.

For each word, the log-odds of standing in a text of the one label against the other
are estimated with an informative Dirichlet prior (the word's share in all texts, with
the weight of the share ``prior`` of all words); z is the estimate over its standard
deviation. Words with |z| of
at least ``least_z`` form the lexicon, at most ``max_words`` of them by |z| (its bound).
Counts are of texts that hold the word, by grouped sums: one shuffle on (word), after
partial sums in the tasks.

A text's score adds the valences of its words. A booster right before a word scales it
by a quarter up, a softener down; a negator among the three words before turns it round
at three quarters. Valences are whole thousandths and scopes whole percents, so sums are
exact; the compound is s / sqrt(s * s + 15) in (-1, 1).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions import lower_text

#: own choice of common words that turn, strengthen or soften what follows
NEGATORS = ["no", "not", "never", "none", "nothing", "neither", "nor", "cannot", "cant", "dont", "doesnt", "didnt",
            "isnt", "wasnt", "wont", "wouldnt", "without", "hardly"]
BOOSTERS = ["very", "really", "so", "extremely", "absolutely", "totally", "incredibly", "highly", "completely"]
SOFTENERS = ["slightly", "somewhat", "barely", "kinda", "fairly", "rather", "partly", "almost"]
SCOPE = 3
UP, DOWN, TURN = 125, 75, -75   # percent
TOKEN = r"[\p{L}\p{N}]+"
MAX_WORDS = 50_000


def scored_tokens(text) -> Column:
    """Lower-cased words of letters and digits; apostrophes join (don't -> dont)."""
    t = F.translate(lower_text(text), "'’", "")
    return F.regexp_extract_all(t, F.lit(f"({TOKEN})"), 1)


def learn_valences(df: DataFrame, text: str = "review", label: str = "voted_up", prior: float = 0.05,
                   least_z: float = 1.96, max_words: int = MAX_WORDS) -> DataFrame:
    """``(word, n_pos, n_neg, log_odds, z, valence)``; rows without a label (1 or 0) are
    left out. Ties at the bound go to the smaller word."""
    rows = df.where(F.col(label).isin(0, 1)).select(
        F.col(label).cast("long").alias("y"), F.explode(F.array_distinct(scored_tokens(text))).alias("word"))
    counts = rows.groupBy("word").agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"))
    total = counts.agg(F.struct(F.sum("n_pos").cast("double").alias("pos"), F.sum("n_neg").cast("double").alias("neg"))
                       .alias("t")).scalar()
    c = counts.withColumn("t", total).select("*", "t.*")
    a, extra = F.lit(prior) * (F.col("n_pos") + F.col("n_neg")), F.lit(prior) * (F.col("pos") + F.col("neg"))
    c = c.withColumns({"p": F.col("n_pos") + a, "q": F.col("n_neg") + a})
    odds = F.log(F.col("p") / (F.col("pos") + extra - F.col("p"))) - F.log(F.col("q") / (F.col("neg") + extra - F.col("q")))
    c = c.withColumn("log_odds", odds).withColumn("z", F.col("log_odds") / F.sqrt(1 / F.col("p") + 1 / F.col("q")))
    return c.where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "word").limit(max_words).select(
        "word", "n_pos", "n_neg", "log_odds", "z", F.round(F.col("log_odds") * 1000).cast("long").alias("valence"))


class ValenceScorer:
    """Sums of valences in hundred-thousandths; see the module's rules."""

    def __init__(self, valences: dict[str, int]):
        self.valences = valences
        self.negators, self.scale = set(NEGATORS), dict.fromkeys(BOOSTERS, UP) | dict.fromkeys(SOFTENERS, DOWN)

    def total(self, words: list[str]) -> int:
        """Sum in units of 10^-7: thousandths times two percents."""
        out, get = 0, self.valences.get
        for i in [k for k, w in enumerate(words) if w in self.valences]:
            v = get(words[i]) * (self.scale.get(words[i - 1], 100) if i else 100)
            out += v * (TURN if not self.negators.isdisjoint(words[max(0, i - SCOPE):i]) else 100)
        return out


def compound(total: float) -> float:
    s = total / 1e7
    return s / math.sqrt(s * s + 15)


def valence_scorer(lexicon: DataFrame):
    """Column of a text -> compound in (-1, 1), for ``hybrid_sentiment(scorer=...)``.
    The lexicon is collected: at most ``max_words`` rows."""
    words = {r["word"]: r["valence"] for r in lexicon.select("word", "valence").toLocalIterator()}
    shared = lexicon.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = ValenceScorer(shared.value)
        for tokens in batches:
            yield pd.Series([compound(scorer.total(list(t))) for t in tokens], dtype="float64")

    return lambda text: score(scored_tokens(text))


def label_odds(df: DataFrame, lexicon: DataFrame, labelled: DataFrame, label: str, text: str = "review",
               out: str = "probability") -> DataFrame:
    """Probability of the label for each text: the labelled rows' prior log-odds and the
    log-odds of the distinct words of the text that the lexicon holds."""
    n = labelled.agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.col(label)).alias("all")).first()
    base = math.log(((n["pos"] or 0) + 1) / (n["all"] - (n["pos"] or 0) + 1))
    words = {r["word"]: r["valence"] for r in lexicon.select("word", "valence").toLocalIterator()}
    shared = lexicon.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("double")
    def odds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        valences = shared.value
        for tokens in batches:
            yield pd.Series([sum(valences[w] for w in valences.keys() & set(t)) / 1000 for t in tokens],
                            dtype="float64")

    return df.withColumn(out, 1 / (1 + F.exp(-(F.lit(base) + odds(scored_tokens(text))))))
