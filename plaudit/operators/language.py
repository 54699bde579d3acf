"""Language detection re-aimed as a Spark job: script rule, then function-word
profile voting. A library detector can be plugged in through ``scorers``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions import alpha_tokens, array_lit, is_blank, script_language

# Function-word profiles (our own choice of very common words per language).
PROFILES = {
    "en": ["the", "and", "of", "to", "is", "in", "that", "it", "with", "for", "this", "was",
           "on", "are", "as", "be", "by", "at", "or", "an"],
    "fr": ["le", "la", "les", "des", "et", "est", "une", "un", "du", "que", "qui", "dans",
           "pour", "pas", "au", "sur", "ne", "se", "ce", "il"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "den", "zu",
           "von", "auf", "sich", "dem", "des", "im", "es", "wir", "ich"],
    "es": ["el", "los", "las", "y", "es", "que", "de", "en", "un", "una", "por", "con",
           "para", "del", "se", "al", "lo", "como", "su", "pero"],
}


def profile_language(text, profiles: dict[str, list[str]] | None = None) -> Column:
    """Language whose profile shares most distinct words with the text (ties: profile
    order); null when no profile word occurs."""
    profiles = profiles or PROFILES
    toks = F.array_distinct(alpha_tokens(text))
    scores = [F.size(F.array_intersect(toks, array_lit(ws))) for ws in profiles.values()]
    best = F.greatest(*scores)
    out = None
    for lang, s in zip(profiles, scores):
        out = F.when(s == best, F.lit(lang)) if out is None else out.when(s == best, F.lit(lang))
    return F.when(best > 0, out)


def detect_language(df: DataFrame, col: str = "review", out: str = "detected_language",
                    legacy_order: bool = False) -> DataFrame:
    """blank -> 'unknown'; kana / CJK / hangul by script; else profile vote; else 'en'.
    ``legacy_order``: the original's order of scripts (ideographs before kana)."""
    script = script_language(col, kana_first=not legacy_order)
    lang = (F.when(is_blank(col), F.lit("unknown"))
            .when(script != "en", script)
            .otherwise(F.coalesce(profile_language(col), F.lit("en"))))
    return df.withColumn(out, lang)
