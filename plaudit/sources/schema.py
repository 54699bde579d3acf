"""Canonical review schema."""

from pyspark.sql import types as T

REVIEW_FIELDS = [
    ("recommendation_id", T.StringType()), ("app_id", T.StringType()),
    ("language", T.StringType()), ("review", T.StringType()),
    ("timestamp_created", T.LongType()), ("timestamp_updated", T.LongType()),
    ("voted_up", T.IntegerType()), ("votes_up", T.IntegerType()), ("votes_funny", T.IntegerType()),
    ("weighted_vote_score", T.DoubleType()), ("helpful_count", T.IntegerType()),
    ("playtime_forever", T.DoubleType()), ("playtime_last_two_weeks", T.DoubleType()),
    ("author_steam_id", T.StringType()), ("author_num_games_owned", T.IntegerType()),
    ("author_num_reviews", T.IntegerType()), ("author_playtime_forever", T.DoubleType()),
    ("written_during_early_access", T.IntegerType()), ("primarily_steam_deck", T.IntegerType()),
    ("received_for_free", T.IntegerType()), ("is_recommended", T.IntegerType()),
    ("detected_language", T.StringType()), ("sentiment_score", T.DoubleType()),
    ("review_length", T.IntegerType()), ("scraped_at", T.TimestampType()),
]
REVIEW_SCHEMA = T.StructType([T.StructField(n, t, n != "recommendation_id") for n, t in REVIEW_FIELDS])
FLAG_COLUMNS = ["voted_up", "written_during_early_access", "primarily_steam_deck",
                "received_for_free", "is_recommended"]
