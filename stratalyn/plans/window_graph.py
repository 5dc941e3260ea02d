"""The window-graph pipeline: sliding windows, an encoder, a neighbour graph, groups, runs of windows as events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalyn.config import WindowConfig
from stratalyn.functions import kernels as k
from stratalyn.functions import plugins
from stratalyn.functions import scores as sc
from stratalyn.operators import intervals as iv
from stratalyn.operators import tagging as tg
from stratalyn.operators import vectors as vx
from stratalyn.plans.session import shared_dir

WINDOWS = "recording_id string, win_idx int, start_sec double, rms_db double, embedding array<float>"


def windows(recordings: DataFrame, c: WindowConfig) -> DataFrame:
    """Embedded windows; silent ones keep their row, without an embedding. A few windows are in memory at a time."""
    encoder, denoise = plugins.find(plugins.ENCODERS, c.encoder), plugins.find(plugins.DENOISERS, c.denoiser)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                x = denoise(k.resample(np.frombuffer(row.samples, np.float32), int(row.sample_rate), c.rate), c.rate)
                size, hop = int(c.window * c.rate), int(c.hop * c.rate)
                n = 1 if len(x) <= size else (len(x) - size) // hop + (2 if hop <= size else 1)
                for first in range(0, n, 32):
                    block = np.stack([np.pad(w := x[i * hop : i * hop + size], (0, size - len(w))) for i in range(first, min(n, first + 32))])
                    level = 20 * np.log10(np.sqrt((block.astype(np.float64) ** 2).mean(axis=1) + 1e-20) + 1e-20)
                    loud = level > c.silence_db
                    vectors = iter(encoder.embed(block[loud]).tolist() if loud.any() else [])
                    yield pd.DataFrame({"recording_id": row.recording_id, "win_idx": range(first, first + len(block)), "start_sec": np.arange(first, first + len(block)) * c.hop, "rms_db": level, "embedding": [next(vectors) if ok else None for ok in loud]})

    return recordings.where("samples is not null").select("recording_id", "sample_rate", "samples").mapInPandas(run, WINDOWS)


def _graph(x: np.ndarray, c: WindowConfig, seed: int) -> np.ndarray:
    n = len(x)
    if n < 2:
        return np.full(n, 0 if c.min_cluster <= n else -1)
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    m = min(c.neighbours, n - 1)
    near, like = np.empty((n, m), int), np.empty((n, m))
    for at in range(0, n, 256):  # a block of rows at a time: memory follows the windows, not their square
        own = np.arange(at, min(n, at + 256))
        block = unit[own] @ unit.T
        block[np.arange(len(own)), own] = -np.inf
        near[own] = np.argsort(-block, axis=1, kind="stable")[:, :m]
        like[own] = np.take_along_axis(block, near[own], axis=1)
    return k.modularity_groups(np.repeat(np.arange(n), m), near.ravel(), np.clip(like.ravel(), 0, 2), n, c.resolution, seed, c.min_cluster)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the other points on whose togetherness two labellings agree, from counts."""
    def size(*labels: np.ndarray) -> np.ndarray:
        _, at, n = np.unique(np.stack(labels, axis=1), axis=0, return_inverse=True, return_counts=True)
        return n[at.ravel()]

    return (len(a) - size(a) - size(b) + 2 * size(a, b) - 1) / max(1, len(a) - 1)


def grouped(win: DataFrame, c: WindowConfig) -> DataFrame:
    """label and stability of every window; silent ones are -1. Stability: agreement with groups of seeded subsamples."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("win_idx")
        x = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
        n, labels = len(x), _graph(x, c, c.seed)
        agree, seen = np.zeros(n), np.zeros(n)
        for i in range(c.subsamples if n >= 8 else 0):
            own = np.sort(np.random.default_rng(c.seed + i + 1).choice(n, max(2, int(n * c.fraction)), replace=False))
            sub = _graph(x[own], c, c.seed)
            agree[own] += _agreement(labels[own], sub)
            seen[own] += 1
        stability = np.where(labels < 0, 0.0, np.where(seen > 0, agree / np.maximum(seen, 1), 1.0))
        return pd.DataFrame({"recording_id": pdf.recording_id, "win_idx": pdf.win_idx, "label": labels, "stability": stability})

    loud = win.where("embedding is not null").select("recording_id", "win_idx", "embedding")
    found = loud.groupBy("recording_id").applyInPandas(run, "recording_id string, win_idx int, label int, stability double")
    return win.join(found, ["recording_id", "win_idx"], "left").na.fill({"label": -1, "stability": 0.0})


def refined(kept: DataFrame, recordings: DataFrame, c: WindowConfig) -> DataFrame:
    """Events with the bounds of their envelope in the recording as it is; a silent event keeps its own.

    Each recording meets the list of its events. The lists are small beside the samples, so the plan sends them to the
    samples as long as they fit the broadcast threshold.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                x, out = k.resample(np.frombuffer(row.samples, np.float32), int(row.sample_rate), c.rate), []
                for s in row.spans:
                    start, end = s["start_sec"], s["end_sec"]
                    clip = x[int(round(start * c.rate)) : int(round(end * c.rate))]
                    if len(clip) and np.abs(clip).max() > 1e-9:
                        a, b = k.refine_envelope(clip, c.rate, c.envelope_db, c.envelope_pad, c.smoothing)
                        start, end = start + a, min(end, start + b)
                    out.append((row.recording_id, s["key"], start, end))
                yield pd.DataFrame(out, columns=["recording_id", "key", "start_sec", "end_sec"])

    spans = kept.groupBy("recording_id").agg(F.collect_list(F.struct("key", "start_sec", "end_sec")).alias("spans"))
    heard = recordings.where("samples is not null").select("recording_id", "sample_rate", "samples").join(spans, "recording_id")
    bounds = heard.select("recording_id", "sample_rate", "samples", "spans").mapInPandas(run, "recording_id string, key string, start_sec double, end_sec double")
    return kept.drop("start_sec", "end_sec").join(bounds, ["recording_id", "key"])


def events(labelled: DataFrame, c: WindowConfig, recordings: DataFrame | None = None) -> DataFrame:
    """Runs of windows, overlapping runs suppressed by stability, refined if there are recordings, numbered in time order."""
    from pyspark.sql import Window

    found = iv.runs(labelled.select("recording_id", "win_idx", "start_sec", "label", "stability", "rms_db"), ["recording_id"], "start_sec", "label", "win_idx", c.window, c.max_gap, max(c.max_event, c.window), c.min_event, ["stability", "rms_db"])
    named = found.withColumn("key", F.concat_ws("-", "label", F.format_string("%012.3f", "start_sec")))
    kept = iv.suppress(named, ["recording_id"], "start_sec", "end_sec", "key", [-F.col("mean_stability"), F.col("start_sec") - F.col("end_sec")], c.nms)
    if recordings is not None and c.refine:
        kept = refined(kept.checkpoint(), recordings, c)
    order = F.row_number().over(Window.partitionBy("recording_id").orderBy("start_sec", "end_sec", "key")) - 1
    return kept.withColumn("event_id", F.format_string("event_%06d", order)).drop("key")


def embedded(found: DataFrame, win: DataFrame) -> DataFrame:
    """Unit mean of an event's windows."""
    each = found.select("recording_id", "event_id", F.explode("windows").alias("win_idx")).join(win.select("recording_id", "win_idx", "embedding"), ["recording_id", "win_idx"])
    mean = vx.centroids(each, ["recording_id", "event_id"], "embedding").select("recording_id", "event_id", F.col("centroid").alias("embedding"))
    return found.join(mean, ["recording_id", "event_id"], "left")


def summarised(found: DataFrame, c: WindowConfig) -> DataFrame:
    """Clusters with their events nearest to the centroid first."""
    mean = vx.centroids(found, ["recording_id", "label"], "embedding")
    near = found.join(mean.select("recording_id", "label", "centroid"), ["recording_id", "label"]).withColumn("similarity", vx.dot(F.col("embedding"), F.col("centroid")))
    top = vx.ranked(near, ["recording_id", "label"], "similarity", "event_id", c.representatives)
    reps = top.groupBy("recording_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"]).alias("representatives"))
    size = found.groupBy("recording_id", "label").agg(F.count("*").alias("size"), F.avg("mean_stability").alias("stability"))
    return size.join(mean.select("recording_id", "label", "centroid"), ["recording_id", "label"]).join(reps, ["recording_id", "label"])


def few_shot(clusters: DataFrame, found: DataFrame, labels: DataFrame, c: WindowConfig) -> DataFrame:
    """Clusters named after the nearest prototype of labelled events; below the threshold they keep their number."""
    protos = vx.centroids(found.join(labels.withColumnRenamed("label", "name"), "event_id"), ["name"], "embedding").select("name", F.col("centroid").alias("_p"))
    ident = F.concat_ws("/", F.lit("cluster"), "recording_id", F.col("label").cast("string"))
    own = clusters.select(ident.alias("id"), F.col("centroid").alias("v"))
    near = vx.nearest(own, protos.select(F.concat(F.lit("name/"), "name").alias("id"), F.col("_p").alias("v")), "id", "v", 1)
    best = near.select(F.col("src").alias("_id"), F.struct(F.substring("dst", 6, 1 << 30).alias("name"), F.col("similarity").alias("_s")).alias("b"))
    named = clusters.withColumn("_id", ident).join(best, "_id", "left").drop("_id")
    return named.withColumn("name", F.when(F.col("b._s") >= c.few_shot, F.col("b.name"))).withColumn("folder", F.concat_ws("_", F.format_string("cluster_%03d", "label"), F.when(F.col("name").isNotNull(), sc.slug(F.col("name"))))).drop("b")


def captioned(clusters: DataFrame, found: DataFrame, prompts: DataFrame) -> DataFrame:
    """Clusters with the prompt (prompt, embedding) nearest to the mean of their first representatives."""
    reps = clusters.select("recording_id", "label", F.posexplode("representatives").alias("_pos", "event_id")).join(found.select("recording_id", "event_id", "embedding"), ["recording_id", "event_id"])
    best = tg.caption(reps, prompts, ["recording_id", "label"], "embedding", "_pos")
    return clusters.join(best.select("recording_id", "label", F.col("prompt").alias("caption"), F.col("similarity").alias("caption_score")), ["recording_id", "label"], "left")


def run(recordings: DataFrame, c: WindowConfig | None = None, prompts: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, events, clusters) of all recordings; captions if there are prompts, names if there are labelled events."""
    c = c or WindowConfig()
    shared_dir(recordings.sparkSession)
    win = grouped(windows(recordings, c).checkpoint(), c).checkpoint()  # the encoder runs once
    found = embedded(events(win, c, recordings), win).checkpoint()
    clusters = summarised(found, c)
    if prompts is not None:
        clusters = captioned(clusters, found, prompts)
    return win, found, clusters if labels is None else few_shot(clusters, found, labels, c)
