"""Row filters of the cleaning step (2-B)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions import is_blank, review_length


def not_blank(col: str = "review") -> Column:
    return ~is_blank(col)


def longer_than(min_len: int = 20, col: str = "review") -> Column:
    return review_length(col) > min_len


def complete(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def drop_blank_reviews(df: DataFrame, col: str = "review") -> DataFrame:
    """Not null and not only whitespace."""
    return df.where(not_blank(col))


def long_reviews(df: DataFrame, min_len: int = 20, col: str = "review") -> DataFrame:
    """Reviews longer than ``min_len`` characters."""
    return df.where(longer_than(min_len, col))


def dropna_subset(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(complete(cols))
