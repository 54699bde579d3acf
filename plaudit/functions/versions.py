"""Version-mention extraction from review text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.functions.cleaning import text_or_empty

__all__ = ["detect_versions"]


def detect_versions(text, patterns=L.VERSION_PATTERNS, keywords=L.UPDATE_KEYWORDS_EN,
                    before: int = 50, after: int = 100) -> Column:
    """Distinct version strings mentioned in the text.

    (1) every capture of each case-insensitive pattern; (2) for each update keyword,
    the first ``\\d+\\.\\d+`` inside [pos-50, pos+100) of its first occurrence in the
    lower-cased text.
    """
    t = text_or_empty(text)
    low = F.lower(t)
    parts = [F.regexp_extract_all(t, F.lit("(?i)" + p), 1) for p in patterns]
    near = []
    for kw in keywords:
        p0 = F.instr(low, kw) - 1
        s0 = F.greatest(p0 - before, F.lit(0))
        e0 = F.least(F.length(t), p0 + after)
        ctx = t.substr(s0 + 1, e0 - s0)
        m = F.regexp_extract(ctx, r"\d+\.\d+", 0)
        near.append(F.when((p0 >= 0) & (m != ""), m))
    found = F.concat(*parts, F.filter(F.array(*near), lambda x: x.isNotNull()))
    return F.array_distinct(found)
