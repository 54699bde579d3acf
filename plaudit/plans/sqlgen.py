"""DuckDB SQL fragments for the oracle, generated from the same fixed word lists.

These are an independent, SQL-only statement of each operator's semantics; the
Spark side never uses them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from plaudit import lexicons as L
from plaudit.functions.cleaning import NON_WS, WS

CJK = r"\x{4e00}-\x{9fff}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words: Iterable[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def text(col: str = "review") -> str:
    return f"coalesce({col}, '')"


def low(col: str = "review") -> str:
    return f"lower({text(col)})"


def clean(col: str = "review") -> str:
    t = low(col)
    t = f"regexp_replace({t}, 'http{NON_WS}+|www{NON_WS}+', '', 'g')"
    t = f"regexp_replace({t}, '[^a-zA-Z0-9{WS}{CJK}]', ' ', 'g')"
    t = f"regexp_replace({t}, '[{WS}]+', ' ', 'g')"
    return f"trim({t})"


def tokens_en(cleaned: str, stop: Sequence[str] = L.STOP_WORDS_EN, min_len: int = 3) -> str:
    return (f"list_filter(string_split({cleaned}, ' '), lambda x: length(x) >= {min_len} "
            f"AND NOT list_contains({lst(stop)}, x))")


def word_count(col: str = "review") -> str:
    return f"len(regexp_extract_all({text(col)}, '({NON_WS}+)', 1))"


def words(col: str = "review") -> str:
    return f"regexp_extract_all({text(col)}, '({NON_WS}+)', 1)"


def count_contained(t: str, ws: Iterable[str], distinct: bool = True) -> str:
    ws = list(dict.fromkeys(ws)) if distinct else list(ws)
    return "(" + " + ".join(f"CASE WHEN contains({t}, {q(w)}) THEN 1 ELSE 0 END" for w in ws) + ")"


def any_contained(t: str, ws: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in dict.fromkeys(ws)) + ")"


def ngrams(t: str, lo: int, hi: int) -> str:
    parts = [f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"
             for n in range(lo, hi + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def lang_code(col: str = "language") -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.LANG_CODE_MAP.items())
    return f"coalesce(CASE lower(substr({col}, 1, 5)) {cases} END, 'en')"


def is_blank(col: str = "review") -> str:
    return f"({col} IS NULL OR NOT regexp_matches({col}, '{NON_WS}'))"


def alpha_tokens(col: str = "review") -> str:
    return f"regexp_extract_all({low(col)}, '(\\p{{L}}+)', 1)"


def preprocess(col: str = "review", lang: str = "language") -> str:
    a = alpha_tokens(col)
    return (f"CASE WHEN {lang_code(lang)} = 'en' THEN list_filter({a}, lambda x: NOT list_contains("
            f"{lst(L.STOP_WORDS_EN)}, x)) ELSE {a} END")


def lexicon(t_lower: str, pos=L.LEXICON_POSITIVE, neg=L.LEXICON_NEGATIVE) -> tuple[str, str, str]:
    p, n = count_contained(t_lower, pos), count_contained(t_lower, neg)
    label = f"CASE WHEN {p} > {n} THEN 'positive' WHEN {n} > {p} THEN 'negative' ELSE 'neutral' END"
    score = f"CASE WHEN {p} <> {n} THEN 0.7 ELSE 0.5 END"
    comp = f"CASE WHEN {p} > {n} THEN 0.7 WHEN {n} > {p} THEN -0.7 ELSE 0.0 END"
    return label, score, comp
