"""Sinks and stored results: event tables, manifests per bucket, metadata, reports, pictures, jobs."""

from __future__ import annotations

import html
import json
import os
import re
import struct
import time
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyn.functions import kernels as k

#: So many events (a few hundred bytes each) may be broadcast to the samples.
SMALL_EVENTS = 100_000
BUCKETS = ("original", "mixed", "low_confidence_noise", "low_detection_confidence", "ambiguous_review", "short_review", "component_review")


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by commas and payloads left out, for CSV."""
    keep = [f for f in df.schema.fields if f.dataType.typeName() not in ("binary", "map", "struct")]
    return df.select(*[F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in keep])


def write_events(events: DataFrame, folder: str) -> None:
    """Parquet by bucket for queries, one CSV table for people; an empty result keeps its header."""
    events.write.mode("overwrite").partitionBy("route").parquet(f"{folder}/events")
    flat(events).write.mode("overwrite").option("header", "true").csv(f"{folder}/events_csv")


def representatives(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """The representative events of every cluster, with the sub-folder of the cluster that they are copied to."""
    named = clusters.select("recording_id", "cluster_id", F.explode("representative_event_ids").alias("event_id"))
    sizes = clusters.select("recording_id", "cluster_id", F.format_string("cluster_%03d_size_%03d/_representatives", F.col("cluster_id"), F.col("size")).alias("folder"))
    return events.join(named, ["recording_id", "cluster_id", "event_id"], "left_semi").join(sizes, ["recording_id", "cluster_id"])


def write_clips(recordings: DataFrame, events: DataFrame, folder: str) -> DataFrame:
    """A WAV clip, a picture and a JSON text for every event, written where the samples are; events with their paths.

    Numbers of events travel to the samples, never the reverse: events are gathered a recording, and each task writes
    the files of its recordings under names that depend on the event alone, so a repeated task writes the same again.
    """
    import pyarrow.fs as pafs

    from stratalyn.sources.recordings import write_wav
    from stratalyn.sources.service import file_stem

    base = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    parts = events.withColumn("component_id", F.regexp_extract("event_id", r"_c([0-9]+)$", 1).try_cast("int")).withColumn("stem", file_stem()).drop("component_id")
    facts = parts.select("recording_id", F.struct("event_id", "stem", "start_sec", "end_sec", F.to_json(F.struct("recording_id", "event_id", "start_sec", "end_sec", "route", "route_reason", "cluster_id", "config_hash")).alias("text")).alias("e"))
    todo = facts.groupBy("recording_id").agg(F.collect_list("e").alias("events"))
    given = recordings.where("samples is not null").select("recording_id", "sample_rate", "samples").join(F.broadcast(todo) if events.count() <= SMALL_EVENTS else todo, "recording_id")

    def run(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples():
                x, rate = np.frombuffer(row.samples, np.float32), int(row.sample_rate)
                for e in row.events:
                    clip = x[int(e["start_sec"] * rate) : int(e["end_sec"] * rate)]
                    at = f"clips/{safe_name(row.recording_id)[:-4]}/{e['stem']}"
                    for end, body in ((".wav", write_wav(clip, rate)), (".png", png(clip if len(clip) else np.zeros(1024), rate)), (".json", e["text"].encode())):
                        fs, path = pafs.FileSystem.from_uri(f"{base}/{at}{end}")
                        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        with fs.open_output_stream(path, compression=None) as f:
                            f.write(body)
                    rows.append((row.recording_id, e["event_id"], f"{at}.wav", f"{at}.png"))
            yield pd.DataFrame(rows, columns=["recording_id", "event_id", "clip_path", "spectrogram_path"])

    paths = given.mapInPandas(run, "recording_id string, event_id string, clip_path string, spectrogram_path string").checkpoint()
    return events.join(paths, ["recording_id", "event_id"], "left")


def manifests(events: DataFrame) -> DataFrame:
    """Every event with the folder it belongs to; clusters carry their size."""
    size = F.count("*").over(Window.partitionBy("recording_id", "route", "cluster_id"))
    folder = F.when((F.col("route") == "original") & (F.col("cluster_id") >= 0), F.format_string("cluster_%03d_n%03d", F.col("cluster_id"), size)).when(F.col("route") == "original", "noise").otherwise(F.col("route"))
    return events.withColumn("folder", folder)


def metadata(events: DataFrame, start_iso: str | None = None, sensor: dict | None = None) -> DataFrame:
    """One JSON document a recording: sensor and start as given, events with times absolute where a start is known.

    The offset of ``start_iso`` is kept as text, since a session zone would normalise it away.
    """
    at = F.to_timestamp(F.lit(start_iso)) if start_iso else F.lit(None).cast("timestamp")
    iso = lambda s: F.date_format(F.timestamp_micros(F.unix_micros(at) + (F.col(s) * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    event = F.struct("start_sec", "event_id", "end_sec", "route", "route_reason", "cluster_id", F.struct(iso("start_sec").alias("absolute_start"), iso("end_sec").alias("absolute_end")).alias("clip_timing"))
    doc = F.to_json(F.struct(F.struct(F.col("recording_id"), F.lit(start_iso).alias("start"), F.lit(json.dumps(sensor or {})).alias("sensor")).alias("recording"), F.array_sort(F.collect_list(event)).alias("events")))
    return events.groupBy("recording_id").agg(doc.alias("document"))


def run_metadata(events: DataFrame, config_hash: str, config: dict | None = None) -> DataFrame:
    """Counts of every recording with the configuration they were made with, as JSON, and its hash."""
    text = F.lit(json.dumps(cleaned(config), sort_keys=True) if config else None).cast("string")
    return events.groupBy("recording_id").agg(F.count("*").alias("n_events"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"), *[F.count_if(F.col("route") == b).alias(f"n_{b}") for b in BUCKETS]).withColumn("config_hash", F.lit(config_hash)).withColumn("config", text)


def report(counts: list[dict]) -> str:
    """Markdown over one small row a recording."""
    if not counts:
        return "# Run\n\nNo recordings.\n"
    cols = list(counts[0])
    return "\n".join(["# Run", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(str(r[c]) for c in cols) + " |" for r in counts), ""])


def review_page(events: DataFrame, per_folder: int = 5) -> str:
    """HTML with the first events of every folder; only those rows are collected."""
    w = Window.partitionBy("recording_id", "folder").orderBy(F.col("representative_score").desc_nulls_last(), "event_id")
    top = manifests(events).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_folder).orderBy("recording_id", "folder", "_r").collect()
    rows = "".join(f"<tr><td>{html.escape(str(r.recording_id))}</td><td>{html.escape(r.folder)}</td><td>{html.escape(r.event_id)}</td><td>{r.start_sec:.3f}</td><td>{r.end_sec:.3f}</td><td>{html.escape(r.route_reason or '')}</td></tr>" for r in top)
    return f"<!doctype html><meta charset=utf-8><title>Review</title><table><tr><th>recording<th>folder<th>event<th>start<th>end<th>reason</tr>{rows}</table>"


def review_pages(events: DataFrame, per_folder: int = 5) -> DataFrame:
    """(recording_id, html): a page a recording with the first events of every folder."""
    w = Window.partitionBy("recording_id", "folder").orderBy(F.col("representative_score").desc_nulls_last(), "event_id")
    top = manifests(events).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_folder)
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *map(cell, (safe("folder"), safe("event_id"), F.format_string("%.3f", "start_sec"), F.format_string("%.3f", "end_sec"), safe("route_reason"))), F.lit("</tr>"))
    rows = top.groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("folder", F.col("_r").alias("r"), row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    head = F.lit("<!doctype html><meta charset=utf-8><title>Review</title><table><tr><th>folder<th>event<th>start<th>end<th>reason</tr>")
    return rows.select("recording_id", F.concat(head, "rows", F.lit("</table>")).alias("html"))


def png(x: np.ndarray, rate: int, mels: int = 96) -> bytes:
    """Log-mel picture in grey."""
    m = k.log_mel(x, rate, 1024, 256, mels)
    g = np.clip((m - m.min()) / max(float(np.ptp(m)), 1e-9) * 255, 0, 255).astype(np.uint8)[::-1]
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    raw = b"".join(b"\0" + row.tobytes() for row in g)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", g.shape[1], g.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pending(files: DataFrame, done: DataFrame, config_hash: str) -> DataFrame:
    """Recordings without a stored result of this configuration."""
    return files.join(done.where(F.col("config_hash") == config_hash).select("recording_id").distinct(), "recording_id", "left_anti")


def safe_name(name: str, default: str = "recording.wav") -> str:
    base = re.sub(r"[^A-Za-z0-9._-]+", "_", name.replace("\\", "/").rsplit("/", 1)[-1]).strip("._") or default
    return base if base.lower().endswith(".wav") else f"{base}.wav"


def inside(folder: str, path: str) -> bool:
    root, full = os.path.realpath(folder), os.path.realpath(os.path.join(folder, path))
    return os.path.commonpath([root, full]) == root


def cleaned(value):
    """NaN and infinities to null, at any depth."""
    if isinstance(value, dict):
        return {str(a): cleaned(b) for a, b in value.items()}
    if isinstance(value, (list, tuple)):
        return [cleaned(x) for x in value]
    return None if isinstance(value, float) and not np.isfinite(value) else value


def assemble(parts: dict[int, bytes], total: int | None = None) -> bytes:
    """Uploaded chunks in order; a missing index or a wrong size raises."""
    if sorted(parts) != list(range(len(parts))):
        raise ValueError("chunks are missing")
    out = b"".join(parts[i] for i in range(len(parts)))
    if total is not None and len(out) != total:
        raise ValueError(f"{len(out)} bytes where {total} were declared")
    return out


class Jobs:
    """Job states as an append-only table; the latest state of a job wins."""

    STATES = ("queued", "running", "done", "failed")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, job: str, status: str, **result) -> None:
        if status not in self.STATES:
            raise ValueError(f"no such state: {status}")
        row = [(job, status, time.time_ns(), json.dumps(cleaned(result)))]
        self.spark.createDataFrame(row, "job string, status string, updated_ns long, result string").coalesce(1).write.mode("append").json(self.folder)

    def latest(self) -> DataFrame:
        rows = self.spark.read.schema("job string, status string, updated_ns long, result string").json(self.folder)
        last = F.max_by(F.struct("status", "result"), "updated_ns")
        return rows.groupBy("job").agg(last.alias("x"), F.max("updated_ns").alias("updated_ns")).select("job", "x.status", "x.result", "updated_ns")
