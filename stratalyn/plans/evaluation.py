"""Evaluation of the interval pipeline against annotations: three views, one plan over all recordings, results as tables."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalyn.config import DiscoveryConfig, fingerprint, variants
from stratalyn.functions import scores as sc
from stratalyn.operators import evaluation as ev
from stratalyn.plans import discovery
from stratalyn.sources import results

log = logging.getLogger(__name__)
#: Views in which predictions are matched; the last one is the headline.
VIEWS = ("raw", "parent_aware", "clusterable")
IOU, COVER = 0.3, 0.3
KEY = "recording_id"


def truth(notes: DataFrame) -> DataFrame:
    """Annotations as (recording_id, gt_id, gs, ge, gt_label), numbered within a recording by time."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("file_id").orderBy("start_sec", "end_sec", "label"))
    return notes.select(F.col("file_id").alias(KEY), number.cast("long").alias("gt_id"), F.col("start_sec").alias("gs"), F.col("end_sec").alias("ge"), F.col("label").alias("gt_label"))


def predictions(events: DataFrame, view: str) -> DataFrame:
    """(recording_id, pred_id, ps, pe) of a view of the events."""
    shown = ev.evaluation_view(events.withColumn("source_type", F.col("route")), view == "clusterable")
    if view == "raw":
        return shown.select(KEY, F.col("event_id").alias("pred_id"), F.col("start_sec").alias("ps"), F.col("end_sec").alias("pe"))
    one = ev.collapse_parents(shown, KEY)
    # an event and the group of its components may bear one id
    ident = F.concat(F.when(F.col("parent_event_id").isNotNull(), "parent:").otherwise("event:"), "prediction_id")
    return one.select(KEY, ident.alias("pred_id"), F.col("start_sec").alias("ps"), F.col("end_sec").alias("pe"))


def matched_predictions(gt: DataFrame, events: DataFrame) -> DataFrame:
    """Every event with the truth it overlaps most, IoU and share of that truth covered; null where there is none."""
    pred = events.select(KEY, F.col("event_id").alias("pred_id"), F.col("start_sec").alias("ps"), F.col("end_sec").alias("pe"))
    best = ev.best_truth(gt.drop("gt_label"), pred, KEY, 10.0).where("gt_id is not null").join(gt, [KEY, "gt_id"]).withColumnRenamed("pred_id", "event_id")
    both = events.join(best.drop("score"), [KEY, "event_id"], "left")
    c = F.col
    scored = both.withColumn("match_iou", F.coalesce(sc.iou(c("start_sec"), c("end_sec"), c("gs"), c("ge")), F.lit(0.0))).withColumn("match_overlap_ratio", F.coalesce(sc.coverage(c("start_sec"), c("end_sec"), c("gs"), c("ge")), F.lit(0.0)))
    return scored.withColumnRenamed("gt_label", "matched_gt_label").drop("gt_id", "gs", "ge")


def usable(matched: DataFrame) -> DataFrame:
    """``matched`` with ``hit``: a truth is overlapped enough."""
    return matched.withColumn("hit", F.col("matched_gt_label").isNotNull() & ((F.col("match_iou") >= IOU) | (F.col("match_overlap_ratio") >= COVER)))


def evaluate(events: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(metrics of every recording and view, matched predictions, summary of the run)."""
    each, total = [], {}
    for view in VIEWS:
        m = ev.detection(gt.drop("gt_label"), predictions(events, view), KEY, IOU, COVER, 10.0)[0]
        each.append(m.withColumn("view", F.lit(view)))
    files = each[0].unionByName(each[1]).unionByName(each[2]).checkpoint()
    for row in ev.roll_up(files, ["view"]).collect():
        total[row["view"]] = row.asDict()
    matched = usable(matched_predictions(gt, events)).checkpoint()
    own = matched.where(F.col("hit") & (F.col("cluster_id") >= 0)).withColumn("cluster", F.concat_ws(":", KEY, "cluster_id"))
    purity = ev.purity(own, [], "matched_gt_label", "cluster").first().asDict()
    poly = ev.polyphony(events.withColumn("source_type", F.col("route"))).first().asDict()
    head = total.get("clusterable", {"f1": 0.0, "mean_iou": 0.0})
    spark = events.sparkSession
    parts = spark.createDataFrame([(head["f1"], purity["weighted_purity"] or 0.0, purity["compression"] or 0.0, head["mean_iou"], poly["mean_purity"])], "f1 double, pu double, co double, mi double, poly double")
    score = parts.select(sc.global_score(F.col("f1"), F.col("pu"), F.col("co"), F.col("mi"), F.col("poly")).alias("s")).first().s
    return files, matched, {"final_score_100": score, "detection": head, "views": total, "clustering": purity, "polyphony": poly}


def write(folder: str, files: DataFrame, matched: DataFrame, summary: dict) -> None:
    """Per-file metrics and matched predictions as tables and CSV, the summary as JSON and Markdown."""
    spark = files.sparkSession
    for name, df in (("per_file", files), ("matched_predictions", matched)):
        results.flat(df).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}_csv")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    text = {"summary.json": json.dumps(results.cleaned(summary), indent=2, sort_keys=True), "report.md": report(summary)}
    for name, body in text.items():
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def report(summary: dict) -> str:
    """Markdown of a summary, a row a view."""
    cols = ("n_gt", "n_pred", "tp", "fp", "fn", "precision", "recall", "f1", "mean_iou", "median_error")
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    rows = [f"| {view} | " + " | ".join(show(m.get(c)) for c in cols) + " |" for view, m in summary["views"].items()]
    clustering = [f"- {k}: {show(v)}" for k, v in summary["clustering"].items()]
    head = ["# Evaluation", "", f"Score: {summary['final_score_100']:.1f} of 100", "", "| view | " + " | ".join(cols) + " |", "|" + "---|" * (len(cols) + 1)]
    return "\n".join([*head, *rows, "", "## Clusters", "", *clustering, "", "## Polyphony", "", *[f"- {k}: {show(v)}" for k, v in summary["polyphony"].items()], ""])


def tune(spark: SparkSession, recordings: DataFrame, gt: DataFrame, folder: str, base: DiscoveryConfig | None = None, budget: str = "quick", most: int | None = None) -> dict:
    """Evaluate every setting of the sweep; the best trial and its configuration. A trial is one plan over all recordings."""
    rows, settings = [], {}
    for i, (name, c) in enumerate(list(variants(base or DiscoveryConfig(), budget).items())[:most]):
        trial = f"trial_{i:03d}_{name}"
        log.info("trial %s", trial)
        events, _ = discovery.run(recordings, c)
        files, matched, summary = evaluate(events, gt)
        write(f"{folder}/{trial}", files, matched, summary)
        settings[trial] = asdict(c)
        d, p = summary["detection"], summary["clustering"]
        rows.append((trial, fingerprint(c), summary["final_score_100"], d.get("precision", 0.0), d.get("recall", 0.0), d["f1"], d["mean_iou"], p["weighted_purity"] or 0.0, p["compression"] or 0.0, p["n_clusters"] or 0))
    trials = spark.createDataFrame(rows, "trial string, config_hash string, score double, precision double, recall double, f1 double, mean_iou double, weighted_purity double, compression double, n_clusters long")
    trials.write.mode("overwrite").parquet(f"{folder}/trials")
    best = ev.best_trial(trials).first()
    return {"best_trial": best.trial, "best_score_100": best.score, "best_config": settings[best.trial]} if best else {"best_trial": "", "best_score_100": 0.0, "best_config": {}}


def calibrate(matched: DataFrame, least_recall: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(every threshold tried, the recommended ones) from the matched predictions of an evaluation."""
    swept = ev.sweep(usable(matched), "hit", ev.CALIBRATION)
    return swept, ev.recommended(swept, least_recall)
