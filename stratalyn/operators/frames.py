"""Frame-series operators: one row per recording and frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalyn.operators.vectors import dot, norm


def decibel(x: Column, floor: float = 1e-10) -> Column:
    return 20 * F.log10(F.greatest(F.abs(x), F.lit(floor)))


def mean_in_order(value: Column, *order: Column) -> Column:
    """Mean of the non-null values of a group, summed one by one in a given order.

    ``avg`` adds partial sums as they arrive, so its last bits change with the partitions, and with them what a comparison
    with the mean says where both are equal. Holds the values of a group at once, as a percentile does.
    """
    values = F.transform(F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.cast("double").alias("v"))))), lambda x: x["v"])
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.count(value))


def rolling_rank(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, percent: float, out: str) -> DataFrame:
    """Order statistic of an odd sliding frame; edges repeat the first and last value."""
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(*order)
    own, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.collect_list(value).over(w.rowsBetween(-half, half))
    d = df.withColumns({"_in": inside, "_lo": F.greatest(F.lit(0), half + 1 - own), "_hi": F.greatest(F.lit(0), own + half - n), "_f": first, "_l": last})
    padded = F.array_sort(F.concat("_in", F.array_repeat("_f", F.col("_lo").cast("int")), F.array_repeat("_l", F.col("_hi").cast("int"))))
    return d.withColumn(out, F.get(padded, F.lit(int(width * percent / 100)))).drop("_in", "_lo", "_hi", "_f", "_l")


def robust_z(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Rises of a series as (x - median) / (1.4826 * median absolute deviation)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_d", F.greatest(F.lit(0.0), F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))))
    med = d.groupBy(*keys).agg(F.median("_d").alias("_m"))
    d = d.join(med, keys)
    mad = d.groupBy(*keys).agg(F.median(F.abs(F.col("_d") - F.col("_m"))).alias("_a"))
    return d.join(mad, keys).withColumn(out, (F.col("_d") - F.col("_m")) / (1.4826 * F.col("_a") + 1e-9)).drop("_d", "_m", "_a")


def noise_floor(df: DataFrame, keys: list[str], value: str, share: float = 0.2) -> DataFrame:
    """The level below which a ``share`` of a recording's frames lies, interpolated."""
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias("noise_floor"))


def stationarity(df: DataFrame, keys: list[str], order: list[str], vector: str) -> DataFrame:
    """Mean cosine of consecutive frames of a recording: 1 where nothing changes or there is one frame only."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = df.withColumn("_v", F.lag(vector).over(w))
    length = F.greatest(norm(F.col(vector)), F.lit(1e-12)) * F.greatest(norm(F.col("_v")), F.lit(1e-12))
    each = before.withColumn("_c", F.when(F.col("_v").isNotNull(), dot(F.col(vector), F.col("_v")) / length))
    return each.groupBy(*keys).agg(F.coalesce(F.avg("_c"), F.lit(1.0)).alias("stationarity"))


def vote(needed: int, *tests: Column) -> Column:
    """True where at least ``needed`` tests hold; a null test does not."""
    total = F.lit(0)
    for t in tests:
        total = total + F.coalesce(t, F.lit(False)).cast("int")
    return total >= needed


def mean_in_span(frames: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, ident: str, bucket: float, *aggs: Column) -> DataFrame:
    """Aggregates of the frames with start <= t <= end, joined on time buckets."""
    f = frames.withColumn("_b", F.floor(F.col(t) / bucket))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return s.join(f, [*keys, "_b"]).where(F.col(t).between(F.col(start), F.col(end))).groupBy(*keys, ident).agg(*aggs)


def interpolate(df: DataFrame, points: DataFrame, keys: list[str], t: str, value: str, out: str) -> DataFrame:
    """Linear interpolation of ``points`` at the times of ``df``, constant beyond the ends: an as-of join both ways."""
    mine = df.withColumns({"_v": F.lit(None).cast("double"), "_p": F.lit(None).cast("double"), "_own": F.lit(1)})
    theirs = points.select(*keys, F.col(t), F.col(value).cast("double").alias("_v"), F.col(t).cast("double").alias("_p"), F.lit(0).alias("_own"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    # both directions as running values: a frame that reaches to the end of the recording would be read anew for each row
    back = Window.partitionBy(*keys).orderBy(t, "_own").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col(t).desc(), F.col("_own").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumns({"_v0": F.last("_v", True).over(back), "_p0": F.last("_p", True).over(back), "_v1": F.last("_v", True).over(ahead), "_p1": F.last("_p", True).over(ahead)})
    mix = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.coalesce(F.try_divide(F.col(t) - F.col("_p0"), F.col("_p1") - F.col("_p0")), F.lit(0.0))
    filled = F.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(mix)
    return d.where("_own = 1").withColumn(out, filled).drop("_v", "_p", "_own", "_v0", "_p0", "_v1", "_p1")


def window_grid(df: DataFrame, samples: str, size: int, hop: int) -> DataFrame:
    """Starts of sliding windows over ``samples`` samples; a longer recording gets one last padded window."""
    n = F.when(F.col(samples) <= size, 1).otherwise(F.floor((F.col(samples) - size) / hop) + (2 if hop <= size else 1))
    d = df.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    return d.withColumn("first_sample", F.col("window") * hop).withColumn("padding", F.greatest(F.lit(0).cast("long"), F.col("first_sample") + size - F.col(samples)))
