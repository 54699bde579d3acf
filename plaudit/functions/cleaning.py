"""Type repair and derived per-review columns (votes, flags, epochs, lengths, bins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaudit import lexicons as L

__all__ = [
    "WS", "NON_WS", "U_WS", "ASCII_WS", "ASCII_NON_WS", "norm_ws", "as_col", "normalize_vote", "normalize_flag", "coerce_epoch", "epoch_to_ts",
    "playtime_hours", "review_length", "word_count", "distinct_word_count", "words",
    "clip", "round_to", "star_rating", "playtime_bin", "length_bin", "is_blank", "text_or_empty",
]

# Python's str.split()/str.strip() whitespace set, written so that the same class
# means the same thing in Java regex and RE2: ASCII whitespace, the separators
# \x1c-\x1f and the Unicode space characters.
WS = (r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
NON_WS = f"[^{WS}]"
# The same set split in two for speed: the non-ASCII-basic members are first mapped
# to a space with translate (a per-character lookup), after which a pure ASCII
# class matches. Java regex classes holding non-ASCII members are ~10x slower.
U_WS = ("\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
        "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
ASCII_WS = r"\t\n\x0b\x0c\r "
# the complement of ASCII_WS written as a positive class (negated classes are the
# slow path of java.util.regex)
ASCII_NON_WS = r"[\x00-\x08\x0e-\x1f\x{21}-\x{10ffff}]"


def norm_ws(c) -> Column:
    """Text with every Unicode whitespace character mapped to a plain space."""
    return F.translate(as_col(c), U_WS, " " * len(U_WS))


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    """Missing text is the empty string (never the literal 'nan')."""
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def normalize_vote(c) -> Column:
    """bool / 'True' / 1 / '1' -> 1, everything else (incl. null) -> 0."""
    s = F.lower(F.trim(as_col(c).cast("string")))
    return F.when(s.isin("true", "1", "1.0"), F.lit(1)).otherwise(F.lit(0))


normalize_flag = normalize_vote


def coerce_epoch(c, fill: int | None = None) -> Column:
    """Epoch seconds as long; unparsable -> null (or ``fill``)."""
    v = as_col(c).cast("string").try_cast("double").try_cast("bigint")
    return F.coalesce(v, F.lit(fill)) if fill is not None else v


def epoch_to_ts(c) -> Column:
    return F.timestamp_seconds(as_col(c))


def playtime_hours(c, default: float | None = None) -> Column:
    v = as_col(c).cast("string").try_cast("double") / F.lit(60.0)
    return F.coalesce(v, F.lit(default)) if default is not None else v


def review_length(c) -> Column:
    """Characters (code points) of the text; missing -> 0."""
    return F.length(text_or_empty(c))


def word_count(c) -> Column:
    """len(text.split()) of the text: runs of non-whitespace."""
    return F.regexp_count(norm_ws(text_or_empty(c)), F.lit(f"{ASCII_NON_WS}+"))


def words(c) -> Column:
    """text.split() as an array."""
    return F.regexp_extract_all(norm_ws(text_or_empty(c)), F.lit(f"({ASCII_NON_WS}+)"), 1)


def distinct_word_count(c) -> Column:
    return F.size(F.array_distinct(words(c)))


def is_blank(c) -> Column:
    """null or only whitespace."""
    return as_col(c).isNull() | ~norm_ws(c).rlike(ASCII_NON_WS)


def clip(c, lo=None, hi=None) -> Column:
    v = as_col(c)
    if lo is not None:
        v = F.greatest(v, F.lit(lo))
    if hi is not None:
        v = F.least(v, F.lit(hi))
    return v


def round_to(c, places: int = 0) -> Column:
    """Round half away from zero on the binary value (x * 10^p + 0.5, floor), the
    rule of C ``round``; used for every reported rounded number."""
    x = as_col(c).cast("double")
    m = float(10 ** places)
    return F.when(x >= 0, F.floor(x * m + 0.5)).otherwise(-F.floor(-x * m + 0.5)) / m


def star_rating(c) -> Column:
    """round(weighted_vote_score * 5), half to even like numpy."""
    return F.bround(as_col(c).cast("double") * 5, 0)


def playtime_bin(hours) -> Column:
    """Left-closed bins [0,1,5,10,20,50,100,200,500) plus '>=500h'; null/negative -> null."""
    h = as_col(hours)
    edges, labels = L.PLAYTIME_BIN_EDGES, L.PLAYTIME_BIN_LABELS
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (h >= lo) & (h < hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out.when(h >= edges[-1], F.lit(L.PLAYTIME_OVERFLOW_LABEL))


def length_bin(length) -> Column:
    """Left-closed bins [0,50,100,200,500,1000,inf)."""
    n = as_col(length)
    edges = L.LENGTH_BIN_EDGES + [None]
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], L.LENGTH_BIN_LABELS):
        cond = (n >= lo) if hi is None else ((n >= lo) & (n < hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out
