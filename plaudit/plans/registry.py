"""Registered queries: name -> (Spark plan builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads whole tables. Double columns
are rounded to 6 places on both sides so that summation order cannot change the
value hash; integer columns are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
NOTES: dict[str, str] = {}


def register(name: str, sql: str | None = None, note: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return normalize(_fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        if note:
            NOTES[name] = note
        return fn
    return deco


def normalize(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles, widen integers to bigint (the oracle does the same)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round_half_away(c.cast("double"), places)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def round_half_away(c, places: int = 6):
    """Round half away from zero on the binary value (x * 10^p, +0.5, floor); the
    oracle applies the identical IEEE operations, so both sides agree exactly."""
    m = float(10 ** places)
    return F.when(c >= 0, F.floor(c * m + 0.5)).otherwise(-F.floor(-c * m + 0.5)) / m


def sql_round(expr: str, places: int = 6) -> str:
    m = f"{float(10 ** places)}"
    return (f"(CASE WHEN ({expr}) >= 0 THEN floor(({expr}) * {m} + 0.5) "
            f"ELSE -floor(-({expr}) * {m} + 0.5) END / {m})")


def rnd(sql: str, doubles: list[str], places: int = 6) -> str:
    """Wrap an oracle query so the listed double columns are rounded."""
    if not doubles:
        return sql
    rep = ", ".join(f"CAST({sql_round(f'CAST(\"{c}\" AS DOUBLE)', places)} AS DOUBLE) AS \"{c}\""
                    for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"
