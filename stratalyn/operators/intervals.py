"""Interval and sequence operators. Keys name the recording; nothing crosses it.

Order-dependent folds run within *islands*: maximal runs of intervals that overlap or touch. Intervals of different
islands cannot suppress or match one another. An island is gathered into one row of numbers; where overlaps chain, as
half-overlapping chunks do, that may be a whole recording. Islands of up to ``SMALL`` intervals are folded in the JVM;
larger ones go to a kernel that looks only at neighbours in time, so work does not grow with the square of an island.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalyn.functions import greedy
from stratalyn.functions.scores import iou

SMALL = 64


def with_islands(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0.0, order: list[str] = (), out: str = "island") -> DataFrame:
    """Number the groups of intervals whose gap to all earlier ones is at most ``gap``."""
    w = Window.partitionBy(*keys).orderBy(start, end, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge(df: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    return with_islands(df, keys, start, end, gap).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def split_long(df: DataFrame, start: str, end: str, longest: float, shortest: float) -> DataFrame:
    """Half-overlapping chunks of at most ``longest``; a last chunk under ``shortest`` goes."""
    span, hop = F.col(end) - F.col(start), longest / 2
    last = F.when(span > longest, F.ceil((span - longest) / hop)).otherwise(0).cast("int")
    chunk = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    out = chunk.withColumn("_s", F.col(start) + F.col("chunk") * hop).withColumn(end, F.least(F.col(end), F.col("_s") + longest)).withColumn(start, F.col("_s")).drop("_s")
    return out.where(F.col(end) - F.col(start) >= shortest)


def flag_kept(df: DataFrame, keys: list[str], start: str, end: str, ident: str, order: list[Column], threshold: float, parent: str | None = None, out: str = "kept") -> DataFrame:
    """``df`` with ``out``: whether greedy suppression in the order of ``order`` (ascending, then ``ident``) keeps a row.

    A row is not kept if it overlaps a kept one by ``threshold`` or more, unless both have the same parent. With a
    threshold of 1 or more all are kept. Rows travel through the fold, so the input is read once.
    """
    if threshold >= 1:
        return df.withColumn(out, F.lit(True))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    fields = [*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(ident).alias("i"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), (F.col(parent).cast("string") if parent else F.lit(None).cast("string")).alias("p"), row]
    grouped = with_islands(df, keys, start, end).groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_all"))
    spans = F.transform("_all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["p"].alias("p")))

    def hit(k: Column, x: Column) -> Column:
        near = iou(k["s"], k["e"], x["s"], x["e"]) >= threshold
        return near & ~F.coalesce(k["p"] == x["p"], F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        gone = F.exists(acc["kept"], lambda k: hit(k, x))
        return F.struct(F.when(gone, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"), F.array_append(acc["flags"], ~gone).alias("flags"))

    none = F.struct(F.filter(spans, lambda x: F.lit(False)).alias("kept"), F.array().cast("array<boolean>").alias("flags"))
    # alone in its island a row is kept; no fold is needed
    folded = F.when(F.size("_all") == 1, F.array(F.lit(True))).otherwise(F.aggregate(spans, none, step, lambda acc: acc["flags"]))
    flags = F.when(F.size("_all") <= SMALL, folded).otherwise(greedy.kept_flags(F.when(F.size("_all") > SMALL, spans), threshold))
    each = grouped.select(F.explode(F.arrays_zip(F.col("_all.row").alias("row"), flags.alias("flag"))).alias("x"))
    return each.select("x.row.*", F.col("x.flag").alias(out))


def suppress(df: DataFrame, keys: list[str], start: str, end: str, ident: str, order: list[Column], threshold: float, parent: str | None = None) -> DataFrame:
    """The rows of ``df`` that ``flag_kept`` keeps."""
    return df if threshold >= 1 else flag_kept(df, keys, start, end, ident, order, threshold, parent, "_kept").where("_kept").drop("_kept")


def runs(df: DataFrame, keys: list[str], start: str, label: str, ident: str, window: float, gap: float, longest: float, shortest: float, measures: list[str] = ()) -> DataFrame:
    """Windows to events: same label, gap at most ``gap``, total at most ``longest``; label -1 and nulls break runs.

    Label and gap breaks are islands; the reset at ``longest`` depends on where the run began, so it is a fold.
    """
    w = Window.partitionBy(*keys).orderBy(start, ident)
    broken = F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label)) | (F.col(start) - (F.lag(start).over(w) + window) > gap)
    marked = df.withColumn("_run", F.sum(F.when(broken, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(label) >= 0)
    item = F.struct(F.col(start).cast("double").alias("s"), F.col(ident).alias("i"), *[F.col(m).cast("double").alias(m) for m in measures])
    grouped = marked.groupBy(*keys, "_run", label).agg(F.array_sort(F.collect_list(item)).alias("_w"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["s"] + window - acc["first"] <= longest
        first = F.when(fits, acc["first"]).otherwise(x["s"])
        part = F.when(fits, acc["part"]).otherwise(acc["part"] + 1)
        return F.struct(first.alias("first"), part.alias("part"), F.array_append(acc["parts"], part).alias("parts"))

    # a run that is short enough as a whole is one part
    whole = F.element_at("_w", -1)["s"] + window - F.get("_w", F.lit(0))["s"] <= longest
    init = F.struct(F.get("_w", F.lit(0))["s"].alias("first"), F.lit(0).alias("part"), F.array().cast("array<int>").alias("parts"))
    folded = F.aggregate("_w", init, step, lambda acc: acc["parts"])
    far = F.when(~whole & (F.size("_w") > SMALL), F.transform("_w", lambda x: F.struct(x["s"].alias("s"))))
    parts = F.when(whole, F.array_repeat(F.lit(0), F.size("_w"))).when(F.size("_w") <= SMALL, folded).otherwise(greedy.part_numbers(far, window, longest))
    each = grouped.select(*keys, "_run", label, F.explode(F.arrays_zip(F.col("_w").alias("w"), parts.alias("p"))).alias("x"))
    agg = [F.min("x.w.s").alias(start), (F.max("x.w.s") + window).alias("end_sec"), F.count("*").alias("n_windows"), *[F.avg(f"x.w.{m}").alias(f"mean_{m}") for m in measures], F.array_sort(F.collect_list("x.w.i")).alias("windows")]
    return each.groupBy(*keys, "_run", label, F.col("x.p").alias("part")).agg(*agg).where(F.col("end_sec") - F.col(start) >= shortest).drop("_run", "part")


def refine(df: DataFrame, keys: list[str], start: str, end: str, ident: str, order: list[Column], threshold: float, shortest: float, parent: str | None = None) -> DataFrame:
    """Refined events: too short ones go, then suppression; the rest get ids ``event_000000`` on in the order of starts."""
    left = suppress(df.where(F.col(end) - F.col(start) >= shortest), keys, start, end, ident, order, threshold, parent)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(start, end, ident)) - 1
    return left.withColumn(ident, F.format_string("event_%06d", number))


def activity_runs(df: DataFrame, keys: list[str], order: list[str], active: str) -> DataFrame:
    """Lengths of runs of equal activity."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(active).over(w).isNull() | (F.lag(active).over(w) != F.col(active)), 1).otherwise(0)
    return df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run", active).agg(F.count("*").alias("length")).drop("_run")


def overlap_ratio(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Share of covered frames that more than one interval covers, by a sweep over interval ends (no explosion)."""
    ends = df.select(*keys, F.explode(F.array(F.struct(F.col(first).alias("t"), F.lit(1).alias("d")), F.struct((F.col(last) + 1).alias("t"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy(*keys, F.col("x.t").alias("t")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("t")
    level = steps.withColumn("level", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("width", F.lead("t").over(w) - F.col("t"))
    covered = lambda n: F.sum(F.when(F.col("level") >= n, F.col("width")).otherwise(0))
    return level.groupBy(*keys).agg(F.coalesce(F.try_divide(covered(2), covered(1)), F.lit(0.0)).alias("overlap_ratio"))


def morphology(df: DataFrame, keys: list[str], order: list[str], active: str, opening: int, closing: int) -> DataFrame:
    """Opening then closing of an activity mask; outside counts as inactive, as in erosion by minimum."""
    w = Window.partitionBy(*keys).orderBy(*order)
    def step(col: str, out: str, width: int, dilate: bool, d: DataFrame) -> DataFrame:
        before, after = (width - 1) // 2, width // 2
        if dilate:
            before, after = after, before
        frame = w.rowsBetween(-before, after)
        whole = F.count("*").over(frame) == before + after + 1
        value = F.max(col).over(frame) if dilate else F.when(whole, F.min(col).over(frame)).otherwise(0)
        return d.withColumn(out, value)

    d = df.withColumn("_m", F.col(active).cast("int"))
    for width, first in ((opening, False), (closing, True)):
        d = step("_m", "_m", width, first, d)
        d = step("_m", "_m", width, not first, d)
    return d.withColumn("mask", F.col("_m") == 1).drop("_m")


def bucketed_range_join(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, bucket: float) -> DataFrame:
    """Pairs of overlapping intervals of equal keys, by equi-join on time buckets; each pair comes out once."""
    spread = lambda d, s, e, b: d.withColumn(b, F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))))
    both = spread(left, ls, le, "_b").join(spread(right, rs, re, "_b"), [*keys, "_b"])
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / bucket)
    return both.where((F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (F.col("_b") == first)).drop("_b")
