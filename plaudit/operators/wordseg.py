"""Word discovery and segmentation of scripts written without spaces.

Discovery needs no dictionary. Runs of ideographs are counted first, so n-grams are cut
from each distinct run once; all counts are grouped sums with partial sums in the tasks.
A candidate of two to ``longest`` characters is a word if it occurs ``least_count``
times, coheres (its mutual information, the smallest over all ways to part it in two,
in nats) and is free on both sides (the entropy of the characters that stand before
and behind it; the edge of a run counts as a character of its own at each place).

Cutting takes the most probable sequence of words by dynamic programming; a single
character is always possible, at the cost of a word seen once if it isn't a word. The
lexicon goes to the tasks: at most ``max_words`` words, by count. Whole texts are cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.functions import clean_text
from plaudit.functions.text import CJK
from plaudit.session import ensure_checkpoint_dir

LONGEST = 4
MAX_WORDS = 200_000
CACHE_RUNS = 50_000


def runs(text) -> Column:
    """Runs of ideographs of a text."""
    return F.regexp_extract_all(clean_text(text), F.lit(f"([{CJK}]+)"), 1)


def gram_counts(df: DataFrame, text: str = "review", longest: int = LONGEST) -> DataFrame:
    """``(gram, before, behind, n)``: n-grams of one to ``longest`` characters with their
    neighbours ('' at the edge of a run)."""
    counted = df.select(F.explode(runs(text)).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    size = F.length("run")
    at = counted.select("run", "n", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    at = at.select("run", "n", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("i") + 1)))
                   .alias("k"))
    before = F.when(F.col("i") > 1, F.substring("run", F.col("i") - 1, F.lit(1))).otherwise(F.lit(""))
    return at.select(F.substring("run", F.col("i"), F.col("k")).alias("gram"), before.alias("before"),
                     F.substring("run", F.col("i") + F.col("k"), F.lit(1)).alias("behind"), "n") \
        .groupBy("gram", "before", "behind").agg(F.sum("n").alias("n"))


def word_statistics(df: DataFrame, text: str = "review", longest: int = LONGEST, least_count: int = 5) -> DataFrame:
    """``(gram, n, cohesion, freedom)`` of the candidates and, without measures, of single
    characters. Cohesion: ln(n * total / (n of the parts)), total the number of
    characters; freedom: the smaller of the two neighbour entropies."""
    counts = gram_counts(df, text, longest)  # read for either side, its exchange once

    def entropy(side: str) -> DataFrame:
        # every edge is a neighbour of its own: n edges add n * (1 / total) * ln(total)
        own = counts.groupBy("gram", side).agg(F.sum("n").alias("m"))
        return own.groupBy("gram").agg(
            F.sum("m").alias("n"),
            F.sum(F.when(F.col(side) != "", F.col("m") * F.log(F.col("m").cast("double"))).otherwise(0.0)).alias("_s")) \
            .select("gram", "n", (F.log(F.col("n").cast("double")) - F.col("_s") / F.col("n")).alias(f"h_{side}"))

    ensure_checkpoint_dir(df.sparkSession)
    stat = entropy("before").join(entropy("behind").drop("n"), "gram").checkpoint()
    frequent = stat.where((F.length("gram") > 1) & (F.col("n") >= least_count))
    total = stat.where(F.length("gram") == 1).agg(F.sum("n").cast("double").alias("total")).scalar()
    parts = frequent.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k")).select(
        "gram", "n", F.substring("gram", F.lit(1), F.col("k")).alias("left"),
        F.expr("substring(gram, k + 1)").alias("right"))
    of = stat.select("gram", "n")
    parts = parts.join(of.select(F.col("gram").alias("left"), F.col("n").alias("n_left")), "left") \
        .join(of.select(F.col("gram").alias("right"), F.col("n").alias("n_right")), "right")
    cohesion = parts.groupBy("gram").agg(F.max(F.col("n_left").cast("double") * F.col("n_right")).alias("most"))
    words = frequent.join(cohesion, "gram").select(
        "gram", "n", F.log(F.col("n") * total / F.col("most")).alias("cohesion"),
        F.least("h_before", "h_behind").alias("freedom"))
    none = F.lit(None).cast("double")
    return words.unionByName(stat.where(F.length("gram") == 1).select(
        "gram", "n", none.alias("cohesion"), none.alias("freedom")))


def discover_words(stats: DataFrame, least_cohesion: float = 1.0, least_freedom: float = 0.5,
                   max_words: int = MAX_WORDS) -> DataFrame:
    """``(word, n)``: candidates that cohere and are free, and all single characters."""
    ok = F.col("cohesion").isNull() | ((F.col("cohesion") >= least_cohesion) & (F.col("freedom") >= least_freedom))
    return stats.where(ok).orderBy(F.col("n").desc(), "gram").limit(max_words).select(F.col("gram").alias("word"), "n")


class Cutter:
    """Most probable cut of a run; ties go to the longer last word."""

    def __init__(self, counts: dict[str, int]):
        total = math.log(sum(counts.values()) or 1)
        self.cost = {w: total - math.log(n) for w, n in counts.items()}
        self.unknown, self.longest = total, max(map(len, counts), default=1)
        self.known: dict[str, list[str]] = {}

    def cut(self, run: str) -> list[str]:
        if run in self.known:
            return self.known[run]
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            low, at = math.inf, end - 1
            for start in range(max(0, end - self.longest), end):
                cost = self.cost.get(run[start:end], self.unknown if end - start == 1 else math.inf)
                if best[start] + cost < low:
                    low, at = best[start] + cost, start
            best.append(low)
            back.append(at)
        words, end = [], len(run)
        while end:
            words.append(run[back[end]:end])
            end = back[end]
        words.reverse()
        if len(run) <= 32:
            if len(self.known) > CACHE_RUNS:
                self.known.clear()
            self.known[run] = words
        return words


def segment(df: DataFrame, words: DataFrame, text: str = "review", out: str = "tokens",
            stop_words=L.STOP_WORDS_ZH) -> DataFrame:
    """Adds the text's tokens: words of each run of ideographs and whole Latin tokens, in
    order, without stop words."""
    counts = {r["word"]: r["n"] for r in words.select("word", "n").toLocalIterator()}
    shared = words.sparkSession.sparkContext.broadcast((counts, frozenset(stop_words)))

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cutter, stop = Cutter(shared.value[0]), shared.value[1]
        for rows in batches:
            yield pd.Series([[w for piece in row for w in ([piece] if piece[0].isascii() else cutter.cut(piece))
                              if w not in stop] for row in rows], dtype=object)

    pieces = F.regexp_extract_all(clean_text(text), F.lit(f"([{CJK}]+|[a-z0-9]+)"), 1)
    return df.withColumn(out, cut(pieces))
