"""Per-review scores: lexicon sentiment, intensity, quality, helpfulness, recency, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.functions.cleaning import ASCII_NON_WS, as_col, distinct_word_count, norm_ws, \
    normalize_vote, text_or_empty, word_count
from plaudit.functions.text import any_contained, count_contained, lower_text, weighted_contained

__all__ = [
    "lexicon_sentiment", "lexicon_outcome", "sentiment_label", "intensity_score", "intensity_label",
    "quality_score", "simple_quality", "helpfulness", "sentence_count", "detail_level",
    "opinion_intensity", "recency", "recommendation_score", "usefulness_category",
    "segment", "benchmark_intensity",
]


def lexicon_outcome(pos, neg) -> Column:
    """struct(label, score, compound) from positive / negative hit counts."""
    pos, neg = as_col(pos), as_col(neg)
    label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
    score = F.when(pos != neg, F.lit(0.7)).otherwise(F.lit(0.5))
    compound = F.when(pos > neg, F.lit(0.7)).when(neg > pos, F.lit(-0.7)).otherwise(F.lit(0.0))
    return F.struct(label.alias("label"), score.alias("score"), compound.alias("compound"))


def lexicon_sentiment(text, positive: Sequence[str] = L.LEXICON_POSITIVE,
                      negative: Sequence[str] = L.LEXICON_NEGATIVE) -> Column:
    """struct(label, score, compound) from distinct positive vs negative substring hits.
    For wide projections prefer computing the two counts as columns first and
    calling ``lexicon_outcome`` (keeps the expression tree small)."""
    t = lower_text(text)
    return lexicon_outcome(count_contained(t, positive), count_contained(t, negative))


def sentiment_label(score) -> Column:
    s = as_col(score)
    return F.when(s > 0.05, "positive").when(s < -0.05, "negative").otherwise("neutral")


def intensity_score(text, vote,
                    lists: Sequence[tuple[Sequence[str], int]] | None = None) -> Column:
    """+2/+1/-2/-1 per contained word of the four lists, +1 for a positive vote else -1."""
    lists = lists or [(L.INTENSITY_VERY_POSITIVE, 2), (L.INTENSITY_POSITIVE, 1),
                      (L.INTENSITY_VERY_NEGATIVE, -2), (L.INTENSITY_NEGATIVE, -1)]
    v = F.when(normalize_vote(vote) == 1, F.lit(1)).otherwise(F.lit(-1))
    return weighted_contained(lower_text(text), lists) + v


def intensity_label(score) -> Column:
    s = as_col(score)
    return (F.when(s >= 2, "Very Positive").when(s >= 0, "Positive")
            .when(s >= -2, "Negative").otherwise("Very Negative"))


def quality_score(text, vote, detail_words: Sequence[str] = L.QUALITY_DETAIL_WORDS) -> Column:
    """Length points (5..25) + 15 detail word + 10 '.'/'。' + 5 newline + 5 vocabulary
    diversity (> 30 % distinct) + 10 positive vote, capped at 100."""
    t = text_or_empty(text)
    n = word_count(text)
    pts = (F.when(n >= 500, 25).when(n >= 200, 20).when(n >= 100, 15)
           .when(n >= 50, 10).when(n > 0, 5).otherwise(0))
    pts = pts + F.when(any_contained(F.lower(t), detail_words), 15).otherwise(0)
    pts = pts + F.when(t.contains(".") | t.contains("。"), 10).otherwise(0)
    pts = pts + F.when(t.contains("\n"), 5).otherwise(0)
    pts = pts + F.when(distinct_word_count(text) > n * F.lit(0.3), 5).otherwise(0)
    pts = pts + F.when(normalize_vote(vote) == 1, 10).otherwise(0)
    return F.least(pts, F.lit(100))


def simple_quality(text, votes_up) -> Column:
    """min(words / 100 * 50 + votes_up * 5, 100) as double."""
    v = F.coalesce(as_col(votes_up).cast("double"), F.lit(0.0))
    return F.least(word_count(text).cast("double") / 100 * 50 + v * 5, F.lit(100.0))


def helpfulness(votes_up, votes_funny) -> Column:
    """up / (up + funny); 0 when there are no votes."""
    up = F.coalesce(as_col(votes_up).cast("double"), F.lit(0.0))
    fun = F.coalesce(as_col(votes_funny).cast("double"), F.lit(0.0))
    tot = up + fun
    return F.when(tot == 0, F.lit(0.0)).otherwise(F.least(up / F.greatest(tot, F.lit(1.0)), F.lit(1.0)))


def sentence_count(text) -> Column:
    """Non-blank pieces of the text split on '.'."""
    pieces = F.split(norm_ws(text_or_empty(text)), r"\.", -1)
    return F.size(F.filter(pieces, lambda s: s.rlike(ASCII_NON_WS)))


def detail_level(text) -> Column:
    """0.5 * min(words/500, 1) + 0.5 * min(words per sentence / 20, 1); empty -> 0."""
    n = word_count(text).cast("double")
    per = n / F.greatest(sentence_count(text), F.lit(1))
    v = F.least(n / 500, F.lit(1.0)) * 0.5 + F.least(per / 20, F.lit(1.0)) * 0.5
    return F.when(text_or_empty(text) == "", F.lit(0.0)).otherwise(F.least(v, F.lit(1.0)))


def opinion_intensity(text, words: Sequence[str] = L.STRONG_WORDS_RECOMMEND) -> Column:
    """min(strong-word hits / 5, 1)."""
    return F.least(count_contained(lower_text(text), words, distinct=False) / 5.0, F.lit(1.0))


def benchmark_intensity(text, words: Sequence[str] = L.STRONG_WORDS_BENCHMARK) -> Column:
    """min(hits, 5) / 5 * 100 per review (benchmark variant)."""
    return F.least(count_contained(lower_text(text), words, distinct=False), F.lit(5)) / 5.0 * 100


def recency(ts_epoch, as_of_epoch) -> Column:
    """1.0 within 30 days; linear 0.8->0.5 to 90; 0.5->0.2 to 365; then 0.2.
    Missing or zero timestamp -> 0.5. ``as_of_epoch`` replaces the wall clock."""
    ts = as_col(ts_epoch).cast("double")
    age = (as_col(as_of_epoch).cast("double") - ts) / 86400.0
    v = (F.when(age <= 30, F.lit(1.0))
         .when(age <= 90, F.lit(0.8) - (age - 30) / 60 * 0.3)
         .when(age <= 365, F.lit(0.5) - (age - 90) / 275 * 0.3)
         .otherwise(F.lit(0.2)))
    return F.when(ts.isNull() | (ts == 0), F.lit(0.5)).otherwise(v)


def recommendation_score(quality, helpful, intensity, recent, detail) -> Column:
    w = L.RECOMMEND_WEIGHTS
    return (as_col(quality) / 100.0 * w["quality_score"] + as_col(helpful) * w["helpfulness"]
            + as_col(intensity) * w["sentiment_intensity"] + as_col(recent) * w["recency"]
            + as_col(detail) * w["detail_level"]) * 100


def usefulness_category(score) -> Column:
    s = as_col(score)
    return (F.when(s >= 75, "Highly Useful").when(s >= 60, "Useful")
            .when(s >= 40, "Moderately Useful").otherwise("Less Useful"))


def segment(vote, n_words) -> Column:
    """Player segment from vote and word count (a positive review of exactly 20
    words falls through to 'Cautious', as in the original)."""
    v = normalize_vote(vote) == 1
    n = as_col(n_words)
    return (F.when(v & (n > 100), "Enthusiasts").when(v & (n > 20), "Satisfied")
            .when(v & (n < 20), "Satisfied").when(~v & (n > 100), "Critical")
            .when(~v & (n > 20), "Dissatisfied").otherwise("Cautious"))
