"""Cross-game benchmarking (2-J): all metrics of all games from one grouped
aggregate plus one distinct-word aggregate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit.functions.cleaning import round_to

from plaudit import lexicons as L
from plaudit.functions import any_contained, benchmark_intensity, lower_text, simple_quality
from plaudit.functions.cleaning import ASCII_WS, norm_ws

DIMS = L.BENCHMARK_DIMENSIONS


def topic_variety(df: DataFrame, key: str = "app_id", approx: bool = False) -> DataFrame:
    """Distinct lower-cased whitespace tokens longer than 3 characters, capped at 100.

    The (app, word) pairs are de-duplicated by a partial+final aggregate keyed on
    both columns, so a hot app's words spread over all shuffle partitions. With
    ``approx`` the HyperLogLog sketch is used instead (the metric caps at 100).
    """
    words = F.split(norm_ws(lower_text("review")), f"[{ASCII_WS}]+")
    e = df.select(key, F.explode(words).alias("w")).where(F.length("w") > 3)
    if approx:
        c = e.groupBy(key).agg(F.approx_count_distinct("w").alias("_u"))
    else:
        c = e.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_u"))
    return c.select(key, F.least(F.col("_u").cast("double"), F.lit(100.0)).alias("topic_variety"))


def benchmark_games(df: DataFrame, key: str = "app_id", approx_variety: bool = False) -> DataFrame:
    """positive_rate, avg_quality_score, issue_diversity, player_satisfaction,
    review_engagement, sentiment_intensity, topic_variety and total_reviews per game
    (rounded to 2 places like the original, except positive_rate)."""
    low = F.col("_low")
    d = df.withColumn("_low", lower_text("review"))
    groups = list(L.BENCHMARK_ISSUES.values())
    aggs = [F.count(F.lit(1)).alias("total_reviews"),
            (F.sum(F.when(F.col("voted_up") == 1, 1).otherwise(0)) / F.count(F.lit(1)) * 100)
            .alias("positive_rate"),
            F.avg(simple_quality("review", "votes_up")).alias("_q"),
            F.avg(F.coalesce(F.col("votes_up").cast("double"), F.lit(0.0))).alias("_v"),
            F.avg(benchmark_intensity("review")).alias("_si")]
    aggs += [F.count_if(any_contained(low, ws)).alias(f"_g{i}") for i, ws in enumerate(groups)]
    g = d.groupBy(key).agg(*aggs)
    tot = sum((F.col(f"_g{i}") for i in range(len(groups))), F.lit(0))
    ent = None
    for i in range(len(groups)):
        p = F.col(f"_g{i}") / tot
        term = F.when(F.col(f"_g{i}") > 0, -p * F.log(p + 1e-10)).otherwise(F.lit(0.0))
        ent = term if ent is None else ent + term
    div = F.when(tot > 0, F.least(ent / math.log(6), F.lit(1.0))).otherwise(F.lit(0.0))
    out = g.select(
        key, "total_reviews", "positive_rate",
        round_to("_q", 2).alias("avg_quality_score"),
        round_to(div, 2).alias("issue_diversity"),
        round_to(F.col("positive_rate") * 0.7 + F.col("_q") / 100.0 * 100 * 0.3, 2).alias("player_satisfaction"),
        round_to(F.least(F.col("_v") / 10 * 100, F.lit(100.0)), 2).alias("review_engagement"),
        round_to("_si", 2).alias("sentiment_intensity"))
    v = topic_variety(df, key, approx_variety)
    return out.join(v, key, "left").withColumn(
        "topic_variety", round_to(F.coalesce("topic_variety", F.lit(0.0)), 2))


def _by_dimension(bench: DataFrame, dims, key: str, value) -> DataFrame:
    """Apply ``value(dimension window)`` to all dimensions at once: the table is
    unpivoted, windows are partitioned by dimension (and tie), and the result is
    pivoted back by one grouped aggregate."""
    long = bench.select(key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("d"), F.col(c).cast("double").alias("v")) for i, c in enumerate(dims)])).alias("s")) \
        .select(key, "s.d", "s.v")
    got = long.select(key, "d", value.alias("x"))
    return got.groupBy(key).agg(*[F.max(F.when(F.col("d") == i, F.col("x"))).alias(f"_x{i}")
                                  for i in range(len(dims))])


def rank_games(bench: DataFrame, key: str = "app_id") -> DataFrame:
    """Average-tie descending rank per dimension -> ``<dim>_rank``. Runs over the
    per-game table (one row per game)."""
    rank = F.rank().over(Window.partitionBy("d").orderBy(F.col("v").desc()))
    ties = F.count(F.lit(1)).over(Window.partitionBy("d", "v"))
    got = _by_dimension(bench, DIMS, key, rank + (ties - 1) / 2.0)
    return bench.join(got, key).select(*bench.columns, *[F.col(f"_x{i}").alias(f"{d}_rank")
                                                         for i, d in enumerate(DIMS)])


def game_percentiles(bench: DataFrame, dims=DIMS, key: str = "app_id") -> DataFrame:
    """Strictly-smaller percentile per dimension -> ``<dim>_percentile``."""
    rank = F.rank().over(Window.partitionBy("d").orderBy(F.col("v").asc()))
    n = F.count(F.lit(1)).over(Window.partitionBy("d"))
    got = _by_dimension(bench, dims, key, (rank - 1) / n * 100.0)
    return bench.join(got, key).select(*bench.columns, *[F.col(f"_x{i}").alias(f"{d}_percentile")
                                                         for i, d in enumerate(dims)])


def strengths_weaknesses(ranked: DataFrame, key: str = "app_id") -> DataFrame:
    """Long form (game, dimension, kind, text): rank 1 -> 'Best x'; rank <= N/2 ->
    'Above average x'; else weakness 'Below average x'."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    r = ranked.withColumn("_n", n)
    st = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_rank").alias("rank"),
                                      F.lit(i).alias("dim_order")) for i, d in enumerate(DIMS)]))
    long = r.select(key, "_n", st.alias("s")).select(key, "_n", "s.*")
    name = F.regexp_replace("dimension", "_", " ")
    return long.select(
        key, "dimension", "dim_order", "rank",
        F.when(F.col("rank") <= F.col("_n") / 2, "strength").when(F.col("rank") == 1, "strength")
         .otherwise("weakness").alias("kind"),
        F.when(F.col("rank") == 1, F.concat(F.lit("Best "), name))
         .when(F.col("rank") <= F.col("_n") / 2, F.concat(F.lit("Above average "), name))
         .otherwise(F.concat(F.lit("Below average "), name)).alias("text"))
