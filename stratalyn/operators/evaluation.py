"""Matching predictions with ground truth, and the figures that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalyn.functions import greedy
from stratalyn.functions.scores import coverage, iou
from stratalyn.operators.intervals import SMALL, bucketed_range_join

#: Source types that leave the evaluation view.
EXCLUDED = ("mixed", "low_confidence_noise", "ambiguous_review", "short_review", "component_review", "low_detection_confidence")


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Adds columns that an evaluation table may lack."""
    return df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})


def evaluation_view(df: DataFrame, clusterable_only: bool = False) -> DataFrame:
    d = with_defaults(df, source_type="original", is_mixed=False, is_low_confidence_noise=False, is_component_review=False, is_low_detection_confidence=False, clusterable=True)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    keep = ~F.coalesce(F.col("source_type"), F.lit("original")).isin(*EXCLUDED)
    for c in ("is_mixed", "is_low_confidence_noise", "is_component_review", "is_low_detection_confidence"):
        keep = keep & ~flag(c)
    return d.where(keep & (F.coalesce(F.col("clusterable").cast("boolean"), F.lit(True)) if clusterable_only else F.lit(True)))


def collapse_parents(df: DataFrame, key: str = "file_id") -> DataFrame:
    """Components of one parent become one prediction: earliest start, latest end, best score.

    All other columns are those of the component with the smallest id. Events without a parent stay as they are, also
    where their id is that of a parent. ``prediction_id`` names either, ``n_members`` counts.
    """
    parent = F.nullif(F.col("parent_event_id").cast("string"), F.lit(""))
    alone = df.where(parent.isNull()).withColumns({"prediction_id": F.col("event_id").cast("string"), "n_members": F.lit(1).cast("long")})
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col("event_id"))
    best = [F.max("detection_score").alias("_best")] if "detection_score" in df.columns else []
    grouped = df.where(parent.isNotNull()).groupBy(F.col(key).alias("_key"), parent.alias("prediction_id")).agg(row.alias("_row"), F.min("start_sec").alias("_s"), F.max("end_sec").alias("_e"), F.count("*").alias("n_members"), *best)
    one = grouped.select("_row.*", "prediction_id", "n_members", "_s", "_e", *(["_best"] if best else []))
    changed = {"start_sec": F.col("_s"), "end_sec": F.col("_e"), "duration_sec": F.col("_e") - F.col("_s"), "is_component": F.lit(False), "detection_score": F.col("_best") if best else None, "source_type": F.when(F.col("n_members") > 1, "parent_aggregated").otherwise(F.col("source_type")) if "source_type" in df.columns else None}
    changed = {c: v for c, v in changed.items() if c in df.columns and v is not None}
    return alone.unionByName(one.withColumns(changed).drop("_s", "_e", "_best"))


def candidates(gt: DataFrame, pred: DataFrame, key: str, min_iou: float, min_cover: float, bucket: float = 86400.0) -> DataFrame:
    """Pairs that overlap enough; gt has (key, gt_id, gs, ge), pred has (key, pred_id, ps, pe)."""
    near = bucketed_range_join(gt, pred, [key], "gs", "ge", "ps", "pe", bucket)
    scored = near.withColumn("iou", iou(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge"))).withColumn("cover", coverage(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge")))
    return scored.where((F.col("iou") >= min_iou) | (F.col("cover") >= min_cover)).withColumn("score", F.greatest("iou", "cover"))


def assign(pairs: DataFrame, key: str) -> DataFrame:
    """Greedy one-to-one matches by falling score, then gt_id, then pred_id: (key, gt_id, pred_id, score, iou, centre_error).

    Pairs are folded within groups that share time; a pair is taken if neither side is taken already. Large groups go
    to a kernel that keeps the taken ids as sets.
    """
    w = Window.partitionBy(key).orderBy("lo", "hi", "gt_id", "pred_id")
    timed = pairs.withColumn("lo", F.least("gs", "ps")).withColumn("hi", F.greatest("ge", "pe"))
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    error = F.abs((F.col("gs") + F.col("ge")) / 2 - (F.col("ps") + F.col("pe")) / 2)
    item = F.struct((-F.col("score")).alias("o"), F.col("gt_id").alias("g"), F.col("pred_id").alias("p"), F.col("iou").alias("iou"), error.alias("error"))
    grouped = timed.withColumn("_n", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_g").agg(F.array_sort(F.collect_list(item)).alias("_a"))
    none = F.filter("_a", lambda x: F.lit(False))
    folded = F.aggregate("_a", none, lambda acc, x: F.when(F.exists(acc, lambda k: (k["g"] == x["g"]) | (k["p"] == x["p"])), acc).otherwise(F.array_append(acc, x)))
    flags = greedy.matched_flags(F.when(F.size("_a") > SMALL, F.transform("_a", lambda x: F.struct(x["g"].alias("g"), x["p"].alias("p")))))
    far = F.transform(F.filter(F.arrays_zip(F.col("_a").alias("x"), flags.alias("f")), lambda z: z["f"]), lambda z: z["x"])
    taken = F.when(F.size("_a") <= SMALL, folded).otherwise(far)
    return grouped.select(key, F.explode(taken).alias("m")).select(key, F.col("m.g").alias("gt_id"), F.col("m.p").alias("pred_id"), (-F.col("m.o")).alias("score"), F.col("m.iou").alias("iou"), F.col("m.error").alias("centre_error"))


def best_truth(gt: DataFrame, pred: DataFrame, key: str, bucket: float = 86400.0) -> DataFrame:
    """Every prediction with the truth of the largest positive overlap score, first gt_id on ties; null if none."""
    near = bucketed_range_join(gt, pred, [key], "gs", "ge", "ps", "pe", bucket)
    score = F.greatest(iou(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge")), coverage(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge")))
    best = near.withColumn("score", score).where("score > 0").groupBy(key, "pred_id").agg(F.max(F.struct("score", (-F.col("gt_id")).alias("g"))).alias("b"))
    return pred.join(best, [key, "pred_id"], "left").select(key, "pred_id", (-F.col("b.g")).alias("gt_id"), F.col("b.score").alias("score"))


def rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def detection_counts(gt: DataFrame, pred: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """tp, fp and fn of every key that has a truth or a prediction."""
    n = lambda d, c: d.groupBy(key).agg(F.count("*").alias(c))
    both = n(gt, "n_gt").join(n(pred, "n_pred"), key, "full").join(n(matches, "tp"), key, "left").na.fill(0)
    return both.select(key, "n_gt", "n_pred", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def with_rates(df: DataFrame) -> DataFrame:
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    d = df.withColumn("precision", p).withColumn("recall", r)
    return d.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def match_quality(matches: DataFrame, key: str) -> DataFrame:
    """Mean IoU and median distance of the centres of each key's matches."""
    return matches.groupBy(key).agg(F.avg("iou").alias("mean_iou"), F.median("centre_error").alias("median_error"))


def detection(gt: DataFrame, pred: DataFrame, key: str, min_iou: float = 0.3, min_cover: float = 0.3, bucket: float = 86400.0) -> tuple[DataFrame, DataFrame]:
    """(metrics of every key, matches): counts, rates, mean IoU (0 without a match) and median centre error (null)."""
    matches = assign(candidates(gt, pred, key, min_iou, min_cover, bucket), key)
    out = with_rates(detection_counts(gt, pred, matches, key)).join(match_quality(matches, key), key, "left")
    return out.na.fill(0.0, ["mean_iou"]), matches


def roll_up(metrics: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Metrics over files: counts are summed and rates taken anew, IoU is weighted by true positives, errors are the median of medians."""
    n = ("n_gt", "n_pred", "tp", "fp", "fn")
    agg = [*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in n], rate(F.sum(F.col("mean_iou") * F.col("tp")), F.sum(F.when(F.col("tp") > 0, F.col("tp")))).alias("mean_iou"), F.median("median_error").alias("median_error")]
    return with_rates((metrics.groupBy(*keys) if keys else metrics).agg(*agg))


#: Columns without which polyphony is not evaluated.
POLYPHONY = ("is_mixed", "source_type", "is_component", "parent_event_id", "purity_score", "polyphony_score")


def polyphony(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts and rates of mixed, component and original events and their mean purity; not enabled without its columns."""
    on = all(c in events.columns for c in POLYPHONY)
    col = lambda c, kind: F.col(c) if c in events.columns else F.lit(None).cast(kind)
    source, part = F.coalesce(col("source_type", "string"), F.lit("original")), F.coalesce(col("is_component", "boolean").cast("boolean"), F.lit(False))
    count = lambda test: F.count_if(test & F.lit(on))
    agg = [F.count("*").alias("n_events"), count(source == "mixed").alias("n_mixed"), count(part).alias("n_components"), count(source == "original").alias("n_original"), F.avg(F.when(F.lit(on), col("purity_score", "double").try_cast("double"))).alias("mean_purity")]
    out = (events.groupBy(*keys) if keys else events).agg(*agg).withColumn("enabled", F.lit(on) & (F.col("n_events") > 0))
    return out.withColumn("mixed_rate", rate(F.col("n_mixed"), F.col("n_events"))).withColumn("component_rate", rate(F.col("n_components"), F.col("n_events")))


def contingency(df: DataFrame, keys: list[str], label: str, cluster: str) -> DataFrame:
    n = df.groupBy(*keys, label, cluster).agg(F.count("*").alias("n"))
    rows, cols = Window.partitionBy(*keys, label), Window.partitionBy(*keys, cluster)
    both = n.withColumn("a", F.sum("n").over(rows)).withColumn("b", F.sum("n").over(cols))
    if keys:
        return both.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return both.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))  # one row


def purity(df: DataFrame, keys: list[str], label: str, cluster: str) -> DataFrame:
    each = df.groupBy(*keys, cluster, label).agg(F.count("*").alias("n")).groupBy(*keys, cluster).agg(F.sum("n").alias("size"), F.max("n").alias("top"))
    agg = [F.count("*").alias("n_clusters"), F.sum("size").alias("n_events"), F.avg("size").alias("mean_size"), F.median("size").alias("median_size"), F.avg(F.col("top") / F.col("size")).alias("mean_purity"), (F.sum("top") / F.sum("size")).alias("weighted_purity"), (F.sum("size") / F.count("*")).alias("compression")]
    return (each.groupBy(*keys) if keys else each).agg(*agg)


def agreement(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Normalised mutual information (arithmetic mean) and adjusted Rand index, from the contingency table."""
    c, pairs = contingency(df, [], label, cluster), lambda x: x * (x - 1) / 2
    p, pa, pb = F.col("n") / F.col("total"), F.col("a") / F.col("total"), F.col("b") / F.col("total")
    one = c.agg(F.sum(p * F.ln(p / (pa * pb))).alias("mi"), F.sum(-p * F.ln(pa)).alias("ha"), F.sum(-p * F.ln(pb)).alias("hb"), F.sum(pairs(F.col("n"))).alias("nn"), F.sum(p * 0 + pairs(F.col("a")) * F.col("n") / F.col("a")).alias("aa"), F.sum(pairs(F.col("b")) * F.col("n") / F.col("b")).alias("bb"), F.max("total").alias("t"))
    expected = F.col("aa") * F.col("bb") / pairs(F.col("t"))
    return one.select(rate(2 * F.col("mi"), F.col("ha") + F.col("hb")).alias("nmi"), F.coalesce(F.try_divide(F.col("nn") - expected, (F.col("aa") + F.col("bb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def audit(df: DataFrame, matched: str, features: list[str]) -> DataFrame:
    """Each feature among matched and unmatched rows: n, mean, median, deviation, and how far the means lie apart."""
    long = df.select(F.col(matched).alias("_m"), F.expr(f"stack({len(features)}, " + ", ".join(f"'{f}', cast(`{f}` as double)" for f in features) + ") as (feature, value)")).where("value is not null")
    side = lambda m, f: f(F.when(F.col("_m") if m else ~F.col("_m"), F.col("value")))
    out = long.groupBy("feature").agg(*[side(m, f).alias(f"{n}_{s}") for m, s in ((True, "matched"), (False, "unmatched")) for n, f in (("n", F.count), ("mean", F.avg), ("median", F.median), ("std", F.stddev_samp))])
    gap = F.col("mean_matched") - F.col("mean_unmatched")
    return out.withColumn("separation", F.try_divide(F.abs(gap), (F.col("std_matched") + F.col("std_unmatched")) / 2)).withColumn("threshold", (F.col("mean_matched") + F.col("mean_unmatched")) / 2).withColumn("direction", F.when(gap >= 0, "higher").otherwise("lower"))


def audit_top(audited: DataFrame, most: int = 6) -> DataFrame:
    """The features that lie furthest apart, first name on ties."""
    return audited.orderBy(F.desc_nulls_last("separation"), "feature").limit(most)


def attach(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``other``, of which one row a key counts: the smallest."""
    fields = [c for c in other.columns if c not in keys and c not in rows.columns]
    one = other.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_one"))
    return rows.join(one, keys, "left").select("*", *[F.col(f"_one.{c}").alias(c) for c in fields]).drop("_one")


#: Thresholds tried by calibration as name, feature, values, and whether a value is the least or the most allowed.
CALIBRATION = (
    ("min_clusterable_detection_score", "detection_score", (0.20, 0.30, 0.35, 0.40, 0.50), "min"),
    ("min_component_quality_for_clustering", "component_quality_score", (0.45, 0.55, 0.62, 0.70, 0.80), "min"),
    ("min_component_purity_for_clustering_strict", "purity_score", (0.55, 0.65, 0.72, 0.80), "min"),
    ("min_component_energy_ratio_for_clustering", "component_energy_ratio", (0.06, 0.10, 0.12, 0.18, 0.25), "min"),
    ("min_component_snr_db_for_clustering", "component_snr_db", (4.0, 6.0, 8.0, 10.0, 12.0), "min"),
    ("min_component_compactness", "component_compactness", (0.08, 0.12, 0.15, 0.22, 0.30), "min"),
    ("min_duration", "duration_sec", (0.08, 0.12, 0.20, 0.25, 0.35), "min"),
    ("max_stationarity_score", "stationarity_score", (0.70, 0.80, 0.90, 0.95), "max"),
)


def sweep(df: DataFrame, matched: str, grid) -> DataFrame:
    """Every threshold of every feature in one pass: rows kept (a null feature is kept), precision, gain, recall kept.

    ``grid`` is a dict of feature to least values, or rows as in ``CALIBRATION``; features that ``df`` lacks are left out.
    """
    rows = [(k, k, ts, "min") for k, ts in grid.items()] if isinstance(grid, dict) else [g for g in grid if g[1] in df.columns]
    number = lambda k: F.col(k).try_cast("double") if dict(df.dtypes)[k] == "string" else F.col(k).cast("double")
    test = lambda k, t, way: number(k).isNull() | (number(k) >= t if way == "min" else number(k) <= t)
    points = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(k).alias("feature"), F.lit(float(t)).alias("threshold"), F.lit(way).alias("way"), test(k, t, way).alias("kept")) for name, k, ts, way in rows for t in ts])
    hit = F.col(matched).cast("int")
    each = df.select(hit.alias("_m"), F.explode(points).alias("x")).groupBy("x.name", "x.feature", "x.threshold", F.col("x.way").alias("direction")).agg(F.count("*").alias("n"), F.sum("_m").alias("n_matched"), F.sum(F.col("x.kept").cast("int")).alias("n_kept"), F.sum(F.col("x.kept").cast("int") * F.col("_m")).alias("kept_matched"))
    d = each.withColumn("precision", rate(F.col("kept_matched"), F.col("n_kept")))
    return d.withColumn("gain", F.col("precision") - rate(F.col("n_matched"), F.col("n"))).withColumn("recall_kept", rate(F.col("kept_matched"), F.col("n_matched")))


def recommended(swept: DataFrame, least_recall: float = 0.85) -> DataFrame:
    """Of each threshold the value of the largest gain in precision among those that keep enough recall, first value on ties."""
    best = F.max(F.struct(F.round("gain", 12).alias("g"), F.round("precision", 12).alias("p"), (-F.col("threshold")).alias("t")))
    return swept.where(F.col("recall_kept") >= least_recall).groupBy("name").agg(best.alias("b")).select("name", (-F.col("b.t")).alias("value"), F.col("b.g").alias("gain"), F.col("b.p").alias("precision"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of the highest score, then F1, then purity, then the first name."""
    return trials.orderBy(F.desc("score"), F.desc("f1"), F.desc("weighted_purity"), "trial").limit(1)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    agg = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, F.lit(0.1)).alias("p10"), F.percentile(value, F.lit(0.9)).alias("p90")]
    return (df.groupBy(*keys) if keys else df).agg(*agg)
