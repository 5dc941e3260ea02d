"""Routing: every event gets one bucket and a reason; none is ever dropped.

Row-wise routers are a chain of conditions; the candidate router compares only events that survived the earlier ones,
so it sits between two row-wise blocks. Buckets are a column, so each side is a filter, not a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalyn.operators.intervals import flag_kept

#: The buckets.
ORIGINAL, COMPONENT_REVIEW, LOW_DETECTION, LOW_NOISE, AMBIGUOUS, SHORT, MIXED = "original", "component_review", "low_detection_confidence", "low_confidence_noise", "ambiguous_review", "short_review", "mixed"


def start(df: DataFrame) -> DataFrame:
    return df.withColumns({"route": F.lit(None).cast("string"), "route_reason": F.lit(None).cast("string")})


def route(df: DataFrame, test: Column, bucket: Column | str, reason: Column | str) -> DataFrame:
    """Send events without a route for which ``test`` is true; null is not true."""
    goes = F.col("route").isNull() & F.coalesce(test, F.lit(False))
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.withColumns({"route": F.when(goes, lit(bucket)).otherwise(F.col("route")), "route_reason": F.when(goes, F.concat_ws(";", "route_reason", lit(reason))).otherwise(F.col("route_reason"))})


def _value(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def route_short(df: DataFrame, duration: str, least: float | Column = 0.20) -> DataFrame:
    """``least`` may be a column; null reviews nothing."""
    return route(df, F.col(duration) < _value(least), SHORT, F.format_string("short_event:<%.3fs", _value(least).cast("double")))


def route_clusterability(df: DataFrame, score: str, keep: float | Column = 0.55, review: float | Column = 0.30) -> DataFrame:
    low = F.col(score) < _value(review)
    return route(df, F.col(score) < _value(keep), F.when(low, LOW_NOISE).otherwise(AMBIGUOUS), F.when(low, "clusterability:low").otherwise("clusterability:ambiguous"))


def route_candidates(df: DataFrame, keys: list[str], parent: str, ident: str, start_col: str, end_col: str, score: str, limit: int = 3, threshold: float = 0.98) -> DataFrame:
    """Per parent the ``limit`` best survivors stay, then temporal suppression among what is left."""
    alive = F.col("route").isNull()
    w = Window.partitionBy(*keys, parent, alive).orderBy(F.col(score).desc(), F.col(ident))
    d = route(df.withColumn("_r", F.row_number().over(w)), F.col(parent).isNotNull() & (F.col("_r") > limit), LOW_NOISE, F.concat(F.lit("component_limit:"), F.col(parent).cast("string"))).drop("_r")
    flagged = flag_kept(d.withColumn("_alive", F.col("route").isNull()), [*keys, "_alive"], start_col, end_col, ident, [-F.col(score)], threshold, parent, "_stay")
    return route(flagged, ~F.col("_stay"), LOW_NOISE, "temporal_nms").drop("_stay", "_alive")


def finish(df: DataFrame) -> DataFrame:
    """What no router took is original; ``clusterable`` follows the final route."""
    return df.withColumn("route", F.coalesce("route", F.lit(ORIGINAL))).withColumn("clusterable", F.col("route") == ORIGINAL)


def by_bucket(df: DataFrame, keys: list[str], ident: str = "event_id", buckets: tuple[str, ...] = (LOW_NOISE, AMBIGUOUS, SHORT, COMPONENT_REVIEW)) -> DataFrame:
    """Review folders: the ids of each review bucket of a recording, in order; a bucket without events has no row."""
    return df.where(F.col("route").isin(*buckets)).groupBy(*keys, "route").agg(F.array_sort(F.collect_list(ident)).alias("event_ids"), F.count("*").alias("n_events"))


def bucket_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_events"), *[F.count_if(F.col("route") == b).alias(f"n_{b}") for b in (ORIGINAL, COMPONENT_REVIEW, LOW_DETECTION, LOW_NOISE, AMBIGUOUS, SHORT)])
