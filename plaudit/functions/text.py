"""Text expressions: cleaning, tokens, n-grams, lexicon containment, scripts, languages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.functions.cleaning import ASCII_NON_WS, ASCII_WS, as_col, norm_ws, text_or_empty

__all__ = [
    "lower_text", "clean_text", "tokenize_en", "tokenize_zh", "alpha_tokens", "preprocess_tokens",
    "ngrams", "count_contained", "weighted_contained", "any_contained", "matched_words",
    "script_language", "lang_code", "aspect_context", "has_cjk", "sql_str", "array_lit",
]

CJK = r"\x{4e00}-\x{9fff}"


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_lit(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lower_text(c) -> Column:
    return F.lower(text_or_empty(c))


def clean_text(c) -> Column:
    """lower; drop URLs; keep [a-z0-9], whitespace and CJK; collapse whitespace."""
    t = norm_ws(lower_text(c))
    t = F.regexp_replace(t, F.lit(f"http{ASCII_NON_WS}+|www{ASCII_NON_WS}+"), F.lit(""))
    # everything except [a-z0-9], whitespace and CJK ideographs, as a positive class
    t = F.regexp_replace(t, F.lit(r"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x{4dff}\x{a000}-\x{10ffff}]"),
                         F.lit(" "))
    t = F.regexp_replace(t, F.lit(f"[{ASCII_WS}]+"), F.lit(" "))
    return F.trim(t)


def tokenize_en(cleaned, stop_words: Sequence[str] = L.STOP_WORDS_EN, min_len: int = 3) -> Column:
    """Whitespace tokens of cleaned text, length >= min_len, stop words removed."""
    stop = list(dict.fromkeys(stop_words))
    toks = F.split(as_col(cleaned), " ")
    # isin over a literal list becomes a hash-set lookup (InSet), not a list scan
    return F.filter(toks, lambda x: (F.length(x) >= min_len) & ~x.isin(stop))


def tokenize_zh(cleaned, stop_words: Sequence[str] = L.STOP_WORDS_ZH) -> Column:
    """Dictionary-free Chinese tokens: each CJK run becomes its character bigrams
    (a single character stays a unigram); Latin tokens are kept whole."""
    stop = list(dict.fromkeys(stop_words))
    runs = F.regexp_extract_all(as_col(cleaned), F.lit(f"([{CJK}]+|[a-z0-9]+)"), 1)
    grams = F.flatten(F.transform(runs, lambda r: F.when(
        r.rlike(f"^[{CJK}]{{2,}}$"),
        F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))
    ).otherwise(F.array(r))))
    return F.filter(grams, lambda x: (F.length(x) > 0) & ~x.isin(stop))


def alpha_tokens(c) -> Column:
    """Alphabetic tokens of the lower-cased text (word.isalpha())."""
    return F.regexp_extract_all(lower_text(c), F.lit(r"(\p{L}+)"), 1)


def preprocess_tokens(c, lang: Column | str | None = None,
                      remove_stop_words: bool = True) -> Column:
    """Alphabetic tokens; English stop words removed for English rows (language code
    normalised first, so 'en'/'english' both count as English)."""
    toks = alpha_tokens(c)
    if not remove_stop_words or lang is None:
        return toks
    stop = list(dict.fromkeys(L.STOP_WORDS_EN))
    is_en = lang_code(lang) == F.lit("en")
    return F.when(is_en, F.filter(toks, lambda x: ~x.isin(stop))).otherwise(toks)


def ngrams(tokens, lo: int = 1, hi: int = 1) -> Column:
    """All contiguous n-grams, lo <= n <= hi, joined with a space (per review).

    Built by zipping the token array with its shifted copies (one pass per n),
    so no sub-array is allocated per position."""
    t = as_col(tokens)
    size = F.size(t)

    def grams_of(n: int) -> Column:
        g = t
        for k in range(2, n + 1):
            g = F.zip_with(g, F.slice(t, k, F.greatest(size, F.lit(1))),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        return F.slice(g, 1, F.greatest(size - n + 1, F.lit(0))) if n > 1 else g

    per_n = [grams_of(n) for n in range(lo, hi + 1)]
    return per_n[0] if len(per_n) == 1 else F.concat(*per_n)


def count_contained(text: Column, words: Iterable[str], distinct: bool = True) -> Column:
    """Number of list words that occur as substrings of ``text``."""
    ws = list(dict.fromkeys(words)) if distinct else list(words)
    parts = [F.when(text.contains(w), F.lit(1)).otherwise(F.lit(0)) for w in ws]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def weighted_contained(text: Column, weighted: Sequence[tuple[Sequence[str], int]]) -> Column:
    out = None
    for ws, w in weighted:
        term = count_contained(text, ws, distinct=False) * F.lit(w)
        out = term if out is None else out + term
    return out


def any_contained(text: Column, words: Iterable[str]) -> Column:
    out = None
    for w in dict.fromkeys(words):
        cond = text.contains(w)
        out = cond if out is None else (out | cond)
    return out


def matched_words(text: Column, words: Sequence[str]) -> Column:
    """Distinct list words contained in ``text``, in list order."""
    return F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in dict.fromkeys(words)]))


def has_cjk(c) -> Column:
    return text_or_empty(c).rlike(f"[{CJK}]")


def script_language(c, kana_first: bool = True) -> Column:
    """Kana -> ja, any CJK ideograph -> zh, hangul -> ko, else en. The original tests
    ideographs first (so Japanese with kanji is zh): ``kana_first=False``."""
    t = text_or_empty(c)
    zh = t.rlike(f"[{CJK}]")
    ja = t.rlike(r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}]")
    ko = t.rlike(r"[\x{ac00}-\x{d7af}]")
    if kana_first:
        return F.when(ja, "ja").when(zh, "zh").when(ko, "ko").otherwise("en")
    return F.when(zh, "zh").when(ja, "ja").when(ko, "ko").otherwise("en")


def lang_code(c) -> Column:
    """Store/ISO language name -> short code via the fixed map; default 'en'."""
    m = F.create_map(*[x for kv in L.LANG_CODE_MAP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    key = F.substring(F.lower(as_col(c).cast("string")), 1, 5)
    return F.coalesce(F.try_element_at(m, key), F.lit("en"))


def aspect_context(text, matched: Column, before: int = 50, after: int = 50,
                   fallback: int = 200, lowered: Column | None = None,
                   length: Column | None = None) -> Column:
    """Window of text around the first occurrence of the first matched keyword:
    [pos-50, pos+len(kw)+50); no keyword -> the first 200 characters.
    ``lowered`` / ``length`` may pass precomputed columns of the text."""
    t = text_or_empty(text)
    low = lowered if lowered is not None else F.lower(t)
    n = length if length is not None else F.length(t)
    kw = F.try_element_at(matched, F.lit(1))
    p0 = F.instr(low, kw) - 1
    start0 = F.greatest(p0 - before, F.lit(0))
    end0 = F.least(n, p0 + F.length(kw) + after)
    return F.when(kw.isNull() | (p0 < 0), F.substring(t, 1, fallback)) \
        .otherwise(t.substr(start0 + 1, end0 - start0))
