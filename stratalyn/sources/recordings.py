"""Sources: recordings (PCM WAV), annotation tables, label files, and what file names tell."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyn.functions import kernels as k

SUFFIXES = ("wav", "flac", "mp3")
#: Names that a column of annotations may have.
SYNONYMS = {
    "start": ("starttime", "start_time", "start", "onset", "begin"),
    "end": ("endtime", "end_time", "end", "offset"),
    "label": ("label", "class", "species", "event_label", "annotation", "q", "type"),
}
#: Subsets that a folder or a file name may state.
SUBSETS = ("PB24", "WMW", "BV", "JD", "MT", "ME", "PB", "PW", "HB", "RD", "HT")


def parse_wav(content: bytes, target: int | None = None) -> tuple[np.ndarray, int]:
    """Mono float32 without mean, peak at most 1; raises ValueError on what is not PCM WAV."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    try:
        with wave.open(io.BytesIO(content)) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise ValueError(str(e)) from None
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / 2 ** (8 * width - 1)
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
    if not len(x):
        raise ValueError("an empty recording")
    x = np.nan_to_num(x)
    if target and target != rate:
        x, rate = k.resample(x, rate, target), target
    x = x - x.mean()
    peak = np.abs(x).max()
    return (np.zeros_like(x) if peak < 1e-8 else x / max(1.0, peak)).astype(np.float32), rate


def write_wav(x: np.ndarray, rate: int) -> bytes:
    """PCM 16 bit, clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def discover(spark: SparkSession, folder: str, limit: int | None = None, split: str | None = None, subset: str | None = None) -> DataFrame:
    """Paths of recordings below a folder with stem, split and subset, in path order; ``all`` takes every split."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    found = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES))
    named = with_split(found.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)))
    if split and split != "all":
        named = named.where(F.col("split").isin(split, "all"))
    if subset:
        named = named.where(F.upper("subset") == subset.upper())
    return named.orderBy("path").limit(limit) if limit else named


def with_split(df: DataFrame, path: str = "path") -> DataFrame:
    """``split`` (validation, train or all) and ``subset``: a known folder, a known name in the file's, or its first token."""
    low, parts = F.lower(path), F.split(F.lower(path), "/")
    split = F.when(low.contains("val"), "validation").when(low.contains("train"), "train").otherwise("all")
    known = F.array(*[F.lit(x) for x in SUBSETS])
    folder = F.get(F.filter(F.transform(parts, lambda p: F.upper(p)), lambda p: F.array_contains(known, p)), F.lit(0))
    name = F.upper(F.element_at(parts, -1))
    inside = F.get(F.filter(known, lambda x: F.contains(name, x)), F.lit(0))
    token = F.nullif(F.regexp_extract(name, r"^([A-Z]{2,5})(?:[_.-]|$)", 1), F.lit(""))
    return df.withColumn("split", split).withColumn("subset", F.coalesce(folder, inside, token))


def annotation_index(spark: SparkSession, folder: str) -> DataFrame:
    """(note_path, note_stem) of all CSV files below a folder, by stem and by stem without an annotation ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,CSV}").load(folder).select(F.col("path").alias("note_path"))
    stem = F.lower(F.regexp_extract("note_path", r"([^/]+)\.[^./]+$", 1))
    bare = F.regexp_replace(stem, "[_-]annotations?$", "")
    return files.select("note_path", F.explode(F.array_distinct(F.array(stem, bare))).alias("note_stem")).where("note_stem <> ''")


def load(spark: SparkSession, folder: str, rate: int | None = None) -> DataFrame:
    """(recording_id, path, sample_rate, duration_sec, samples, error): unreadable files keep their row, with an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                out = {"recording_id": row.path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "path": row.path, "sample_rate": None, "duration_sec": None, "samples": None, "error": None}
                try:
                    x, r = parse_wav(bytes(row.content), rate)
                    out |= {"sample_rate": r, "duration_sec": len(x) / r, "samples": x.tobytes()}
                except ValueError as e:
                    out["error"] = str(e)
                yield pd.DataFrame([out])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{wav,WAV}").load(folder)
    return files.select("path", "content").mapInPandas(run, "recording_id string, path string, sample_rate int, duration_sec double, samples binary, error string")


def _resolve(columns: list[str], names: tuple[str, ...]) -> str | None:
    exact = {c.lower(): c for c in columns}
    packed = {c.lower().replace("_", "").replace(" ", ""): c for c in columns}
    return next((exact[n] for n in names if n in exact), None) or next((packed[q] for n in names if (q := n.replace("_", "")) in packed), None)


def annotations(spark: SparkSession, path: str, positive: str = "POS") -> DataFrame:
    """(file_id, start_sec, end_sec, label, raw_label): negative, unknown and empty intervals left out, a null label is ``event``."""
    df = spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(path).withColumn("_file", F.input_file_name())
    start, end, label = (_resolve(df.columns, SYNONYMS[n]) for n in ("start", "end", "label"))
    if not start or not end:
        raise ValueError(f"no start and end among {df.columns}")
    raw = F.coalesce(F.col(f"`{label}`").cast("string"), F.lit("event")) if label else F.lit("event")
    out = df.select(F.regexp_extract("_file", r"([^/]+)\.[^./]+$", 1).alias("file_id"), F.col(f"`{start}`").try_cast("double").alias("start_sec"), F.col(f"`{end}`").try_cast("double").alias("end_sec"), raw.alias("raw_label"))
    name = F.trim("raw_label")
    kept = out.where(~F.upper(name).isin("NEG", "UNK") & (F.col("end_sec") > F.col("start_sec")))
    label_of = F.when(F.upper(name) == positive, positive).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit("event")))
    return kept.select("file_id", "start_sec", "end_sec", label_of.alias("label"), "raw_label")


def read_if_present(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """A stored result of the given schema, or an empty table where there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.option("header", "true").csv(path) if kind == "csv" else reader.json(path)


def pair(files: DataFrame, notes: DataFrame) -> DataFrame:
    """Annotation of each recording: equal stems first, then a stem that contains the other, first path on ties.

    ``notes`` has (note_path, note_stem). Containment cannot be an equi-join; it runs only for recordings left over and
    against the distinct stems, which are file names, not rows.
    """
    exact = files.join(notes, files.stem == notes.note_stem).select(files["*"], "note_path", F.lit(0).alias("_p"))
    rest = files.join(notes, files.stem == notes.note_stem, "left_anti")
    loose = rest.join(notes, rest.stem.contains(notes.note_stem) | notes.note_stem.contains(rest.stem)).select(rest["*"], "note_path", F.lit(1).alias("_p"))
    best = exact.unionByName(loose).withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("_p", "note_path"))).where("_r = 1")
    return files.join(best.select("path", "note_path"), "path", "left")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, label) of a JSON object; anything else raises when read."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    return text.select(F.explode(parsed).alias("event_id", "label"))
