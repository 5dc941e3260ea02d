"""The interval pipeline: recordings to detections, routes, clusters. One lazy plan over all recordings.

Signal work happens in one kernel per recording, which gives rows of numbers and embeddings; everything after that is
DataFrame work partitioned by recording. Samples never go through a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalyn.config import DiscoveryConfig, adapted, fingerprint
from stratalyn.functions import kernels as k
from stratalyn.functions import plugins
from stratalyn.functions import scores as sc
from stratalyn.operators import intervals as iv
from stratalyn.operators import routing as rt
from stratalyn.operators import tagging as tg
from stratalyn.operators import vectors as vx
from stratalyn.plans.session import shared_dir

EVENTS = (
    "recording_id string, event_id string, parent_event_id string, start_sec double, end_sec double, duration_sec double, is_component boolean, is_mixed boolean, n_components int, polyphony_score double, "
    "purity_score double, snr_db double, detection_score double, rms_db double, peak_db double, spectral_centroid double, bandwidth_hz double, spectral_flatness double, tonality_score double, peak_band_snr_db double, "
    "temporal_contrast_db double, active_ratio double, zero_crossing double, modulation_hz double, embedding_stability double, bandwidth_ratio double, embedding array<float>, mix_reason string, "
    "component_energy_ratio double, component_snr_db double, component_compactness double"
)
#: Bands in Hz; the last one ends at the highest frequency.
BANDS = ((100.0, 800.0), (800.0, 3000.0), (3000.0, 8000.0), (8000.0, float("inf")))


def band_activity(x: np.ndarray, rate: int, c: DiscoveryConfig, n: int) -> np.ndarray:
    """Frames in which any band is well above its own floor and either rises sharply or is concentrated."""
    out, top = np.zeros(n, bool), rate / 2
    for low, high in BANDS:
        high = min(high, top * 0.98)
        if low >= top * 0.95 or high <= low:
            continue
        y = k.band_pass(x, rate, low, high)
        db, flat = k.rms_db(y, c.frame, c.hop)[:n], k.flatness(np.abs(k.stft(y, c.frame, c.hop)))[:n]
        rise = np.pad(np.maximum(np.diff(db), 0), (1, 0), mode="edge") if n > 1 else np.zeros(n)
        mid = np.median(rise)
        z = (rise - mid) / (1.4826 * (np.median(np.abs(rise - mid)) + 1e-9))
        above = db - k.rolling_floor(db, max(5, int(round(c.band_window * rate / c.hop))))
        out |= (above >= c.band_snr) & ((z >= c.band_flux_z) | (flat < c.max_flatness))
    return k.opened_closed(out, 1, max(1, int(round(c.band_gap * rate / c.hop))))


def detect(x: np.ndarray, rate: int, c: DiscoveryConfig) -> list[dict]:
    """Intervals in which at least ``votes`` of energy, change and concentration are active, or any band is, with their frame scores."""
    db = k.rms_db(x, c.frame, c.hop)
    floor = k.rolling_floor(db, int(c.floor_window * rate / c.hop))
    mel, mag = k.log_mel(x, rate, c.frame, c.hop, 64), np.abs(k.stft(x, c.frame, c.hop))
    n = min(len(db), mel.shape[1], mag.shape[1])
    db, floor, fl, flat = db[:n], floor[:n], k.flux(mel)[:n], k.flatness(mag)[:n]
    mad = np.median(np.abs(fl - np.median(fl)))
    limit, strong = max(np.percentile(fl, c.flux_percentile), np.median(fl) + c.flux_mads * mad), max(float(np.percentile(fl, 95)), 1e-9)
    above = db > floor + c.flux_snr
    votes = [db > floor + c.threshold_db] + [(fl > limit) & above] * c.flux + [(flat < c.max_flatness) & above] * c.concentration
    mask = np.sum(votes, axis=0) >= min(c.votes, len(votes))
    if c.multiband:
        mask |= band_activity(x, rate, c, n)
    step, length = c.hop / rate, len(x) / rate
    mask = k.opened_closed(mask, max(1, int(0.04 / step)), max(1, int(c.merge_gap / step)))
    spans, out = [(max(0.0, a - c.pad), min(length, b + c.pad)) for a, b in k.intervals(mask, step, length) if b - a >= c.min_event * 0.5], []
    merged: list[list[float]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1] + c.merge_gap:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        at = a
        while True:
            end = min(b, at + c.max_event)
            if end - at >= c.min_event or at == a:
                s = slice(int(at / step), max(int(at / step) + 1, int(end / step)))
                snr, change = float((db[s] - floor[s]).mean()), float(np.clip(fl[s] / strong, 0, 1).mean())
                out.append({"start": at, "end": end, "snr": snr, "score": float(np.clip(0.45 * np.clip(snr / 20, 0, 1) + 0.35 * change + 0.20 * mask[s].mean(), 0, 1))})
            if end >= b:
                break
            at += c.max_event / 2
    return out


def separate(x: np.ndarray, rate: int, c: DiscoveryConfig) -> tuple[list[dict], float]:
    """Time-frequency components above their band's floor, strongest first, and their temporal overlap."""
    n = max(256, min(1024, 1 << int(np.log2(max(256, len(x))))))
    hop = max(64, n // 4)
    z = k.stft(x, n, hop)
    db = k.to_db(np.abs(z))
    mask = k.cleaned_mask(db > np.percentile(db, 20, axis=1, keepdims=True) + c.component_snr)
    lab, count = k.label_2d(mask)
    power, out = np.abs(z) ** 2, []
    total = power[mask].sum() + 1e-12
    for i in range(1, count + 1):
        f, t = np.nonzero(lab == i)
        if len(f) < c.component_area:
            continue
        box = (f.max() - f.min() + 1) * (t.max() - t.min() + 1)
        around = power[f.min() : f.max() + 1, t.min() : t.max() + 1].sum()
        energy, compact = float(power[f, t].sum()), len(f) / box
        snr = float(np.median(db[f, t]) - np.median(db))
        out.append({"f0": f.min(), "f1": f.max(), "t0": int(t.min()), "t1": int(t.max()), "from": int(t.min()) * hop, "to": min(len(x), (int(t.max()) + 1) * hop), "energy": energy, "ratio": energy / total, "compact": compact, "duration": (t.max() - t.min() + 1) * hop / rate, "bandwidth": (f.max() - f.min() + 1) * rate / n, "snr": snr, "purity": 0.45 * min(1.0, energy / max(around, 1e-12)) + 0.35 * compact + 0.20 * min(1.0, max(0.0, snr) / 20), "mask": lab == i})
    strong = [p for p in out if p["duration"] >= c.component_duration and p["ratio"] >= c.component_ratio and (p["bandwidth"] >= c.component_bandwidth or p["ratio"] >= max(0.02, 2 * c.component_ratio))]
    strong = sorted(strong, key=lambda p: -p["energy"])[: c.max_components]
    cover = np.zeros(z.shape[1], int)
    for p in strong:
        cover[p["t0"] : p["t1"] + 1] += 1
        y = np.nan_to_num(k.istft(z * k.smoothed(p.pop("mask")), n, hop, len(x)))
        p["audio"] = (y / max(1.0, float(np.abs(y).max(initial=0.0)))).astype(np.float32)
        parts = (p["purity"], p["snr"] / 16, p["ratio"] / 0.24, p["compact"] / 0.45, p["duration"] / 0.24)
        p["quality"] = float(np.clip(sum(w * np.clip(v, 0, 1) for w, v in zip((0.30, 0.25, 0.20, 0.15, 0.10), parts)), 0, 1))
    return strong, float((cover > 1).sum() / max(1, (cover > 0).sum()))


def measure(x: np.ndarray, rate: int, band_floor: np.ndarray, c: DiscoveryConfig) -> dict:
    """Features and embedding of one clip."""
    n = max(256, min(c.frame, 1 << int(np.log2(max(256, len(x))))))
    hop = max(64, min(c.hop, n // 4))
    mag, db = np.abs(k.stft(x, n, hop)), k.rms_db(x, n, hop)
    centre, width = k.centroid_bandwidth(mag, rate)
    p20, p95 = np.percentile(db, [20, 95])
    bands = np.percentile(k.log_mel(x, rate, n, hop, 32, None), 75, axis=1) - band_floor
    env, dur = db - db.mean(), len(x) / rate
    peaks = ((env[1:-1] > env[:-2]) & (env[1:-1] >= env[2:]) & (env[1:-1] > 0)).sum() if len(env) >= 4 else 0
    c0 = float(np.median(centre))
    vectors = [k.embedding(v, rate, c.mels) for f in plugins.VIEWS.values() if len(v := f(x, rate, c0))]
    cos = [float((np.dot(vectors[0], v) / max(np.linalg.norm(vectors[0]) * np.linalg.norm(v), 1e-12) + 1) / 2) for v in vectors[1:]]
    return {
        "rms_db": float(db.mean()), "peak_db": float(db.max()), "spectral_centroid": c0, "bandwidth_hz": float(np.median(width)), "spectral_flatness": float(np.median(k.flatness(mag))), "tonality_score": k.tonality(mag),
        "peak_band_snr_db": float(bands.max() - np.median(bands)), "temporal_contrast_db": float(max(0.0, p95 - p20)), "active_ratio": float((db >= p20 + 4).mean()), "zero_crossing": float(np.median(k.zero_crossings(x, n, hop))),
        "modulation_hz": float(peaks / max(dur, 1e-9)), "embedding_stability": float(np.mean(cos)) if cos else 0.75, "bandwidth_ratio": float(np.median(width) / (rate / 2)), "embedding": vectors[0] if vectors else np.zeros(6 * c.mels + 13, np.float32),
    }


#: Settings that the routers need of each recording; with ``adaptive`` they differ between recordings.
SETTINGS = ("min_event", "max_event", "short_review", "review_short", "noise_mode", "min_quality", "min_eventness", "tonality_floor", "keep_clusterability", "review_clusterability")
SETTINGS_TYPE = "settings struct<min_event:double,max_event:double,short_review:double,review_short:boolean,noise_mode:string,min_quality:double,min_eventness:double,tonality_floor:double,keep_clusterability:double,review_clusterability:double>"


def settled(x: np.ndarray, rate: int, c: DiscoveryConfig, hint: str | None = None) -> DiscoveryConfig:
    """The settings of one recording: those of the run, adapted to its profile if the run is adaptive."""
    if not c.adaptive:
        return c
    p = k.profile(x, rate, c.frame, c.hop)
    return adapted(c, p | {"regime": k.regime_of(p), "hint": hint})


def events_of(recording: str, x: np.ndarray, rate: int, c: DiscoveryConfig, hint: str | None = None) -> list[dict]:
    c = settled(x, rate, c, hint)
    settings = {name: getattr(c, name) for name in SETTINGS}
    return [e | {"settings": settings} for e in _events_of(recording, x, rate, c)]


def _events_of(recording: str, x: np.ndarray, rate: int, c: DiscoveryConfig) -> list[dict]:
    band_floor = np.percentile(k.log_mel(x, rate, c.frame, c.hop, 32, None), 20, axis=1)
    out: list[dict] = []
    for d in detect(x, rate, c):
        clip = x[int(round(d["start"] * rate)) : int(round(d["end"] * rate))]
        a, b = k.refine_energy(clip, rate, c.refine_above_floor, c.refine_below_peak, least=min(c.min_event, len(clip) / rate))
        d["end"], d["start"] = d["start"] + b, d["start"] + a
        clip = x[int(round(d["start"] * rate)) : int(round(d["end"] * rate))]
        if len(clip) < 64:
            continue
        parts, overlap = separate(clip, rate, c)
        ident = f"event_{len(out):06d}"
        top = max((p["ratio"] for p in parts), default=1.0)
        pure = [p for p in parts if p["purity"] >= 0.55]
        poly = 0.0 if len(parts) <= 1 else float(np.clip(0.45 * min(1, (len(parts) - 1) / 3) + 0.35 * (1 - top) + 0.20 * overlap, 0, 1))
        base = {"recording_id": recording, "event_id": ident, "parent_event_id": None, "start_sec": d["start"], "end_sec": d["end"], "duration_sec": d["end"] - d["start"], "is_component": False, "is_mixed": False, "n_components": max(1, len(parts)), "polyphony_score": poly, "purity_score": max([0.85, *(p["purity"] for p in parts)]) if len(parts) <= 1 else max(p["purity"] for p in parts), "snr_db": d["snr"], "detection_score": d["score"], "mix_reason": None}
        if len(parts) <= 1 or top >= 1 - c.component_ratio:
            out.append(base | measure(clip, rate, band_floor, c))
            continue
        mean_purity = float(np.mean([p["purity"] for p in parts]))
        apart = poly >= 0.25 and (overlap <= 0.65 or mean_purity >= 0.55) and len(pure) >= 2
        reasons = {"too_many_significant_components": len(parts) > c.max_components, "components_too_overlapping": overlap > 0.45, "component_masks_not_compact": any(p["compact"] < 0.15 for p in pure), "not_separable": not apart}
        reason = next((name for name, holds in reasons.items() if holds), None)
        if reason:
            out.append(base | measure(clip, rate, band_floor, c) | {"is_mixed": True, "mix_reason": reason, "purity_score": mean_purity})
            continue
        pure = [p for p in pure if p["to"] - p["from"] >= max(1, round(c.component_duration * rate))]
        if not pure:
            out.append(base | measure(clip, rate, band_floor, c) | {"is_mixed": True, "mix_reason": "not_separable", "purity_score": mean_purity})
        for i, p in enumerate(sorted(pure, key=lambda p: -p["quality"])):
            own = {"start_sec": d["start"] + p["from"] / rate, "end_sec": d["start"] + p["to"] / rate, "duration_sec": (p["to"] - p["from"]) / rate}
            gate = {"component_energy_ratio": p["ratio"], "component_snr_db": p["snr"], "component_compactness": p["compact"]}
            out.append(base | measure(p["audio"][p["from"] : p["to"]], rate, band_floor, c) | own | gate | {"event_id": f"{ident}_c{i}", "parent_event_id": ident, "is_component": True, "purity_score": p["purity"]})
    return out


def detections(recordings: DataFrame, c: DiscoveryConfig) -> DataFrame:
    """Events of all recordings. A column ``hint`` of ``recordings``, the tagger's regime, counts in adaptive runs."""
    names = [*(f.split()[0] for f in EVENTS.replace("array<float>", "a").split(", ")), "settings"]
    tagged = recordings if "hint" in recordings.columns else recordings.withColumn("hint", F.lit(None).cast("string"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                found = events_of(row.recording_id, np.frombuffer(row.samples, np.float32), int(row.sample_rate), c, row.hint)
                yield pd.DataFrame(found, columns=names)

    return tagged.where("samples is not null").select("recording_id", "sample_rate", "samples", "hint").mapInPandas(run, f"{EVENTS}, {SETTINGS_TYPE}")


def profiles(recordings: DataFrame, c: DiscoveryConfig) -> DataFrame:
    """The profile of every recording, its regime, and the parameters that the adaptive rules set (null: none)."""
    names = [*k.profile(np.zeros(0), 1), "regime"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                p = k.profile(np.frombuffer(row.samples, np.float32), int(row.sample_rate), c.frame, c.hop)
                yield pd.DataFrame([{"recording_id": row.recording_id} | p | {"regime": k.regime_of(p)}])

    schema = "recording_id string, " + ", ".join(f"{n} {'string' if n == 'regime' else 'double'}" for n in names)
    found = recordings.where("samples is not null").select("recording_id", "sample_rate", "samples").mapInPandas(run, schema)
    return tg.adaptive(found, "dynamic_range", "median_tonality", "regime")


def gated(events: DataFrame) -> DataFrame:
    """Quality, rank within the parent and the gate's reason of every component; null for other events."""
    from pyspark.sql import Window

    col = F.col
    q = sc.component_quality(col("purity_score"), col("component_snr_db"), col("component_energy_ratio"), col("component_compactness"), col("duration_sec"))
    x = events.withColumn("component_quality_score", F.when(col("is_component"), q))
    w = Window.partitionBy("recording_id", F.coalesce("parent_event_id", "event_id")).orderBy(col("component_quality_score").desc(), "event_id")
    x = x.withColumn("component_rank", F.when(col("is_component"), F.row_number().over(w) - 1))
    why = sc.component_gate(col("component_rank"), col("purity_score"), col("component_energy_ratio"), col("component_snr_db"), col("component_compactness"), col("component_quality_score"))
    return x.withColumn("component_reason", F.when(col("is_component"), why))


def scored(events: DataFrame, c: DiscoveryConfig) -> DataFrame:
    col, events = F.col, gated(events)
    low, high = col("settings.min_event"), col("settings.max_event")
    duration = sc.duration_window(col("duration_sec"), (low * 0.6, F.greatest(low * 2, F.lit(0.12))), (high * 0.75, high))
    q = sc.quality(col("snr_db"), col("spectral_flatness"), col("tonality_score"), col("bandwidth_ratio"), col("peak_band_snr_db"), c.min_snr, c.noise_flatness, c.min_tonality)
    x = events.withColumn("quality_score", q).withColumn("eventness_score", sc.eventness(col("temporal_contrast_db"), col("active_ratio"), duration, col("is_component"), col("purity_score")))
    x = x.withColumn("duration_confidence", duration).withColumn("local_snr_score", sc.smoothstep(c.min_snr, c.min_snr + 18, F.greatest(sc.safe(col("snr_db"), 0), sc.safe(col("peak_band_snr_db"), 0))))
    x = x.withColumn("overlap_penalty", sc.overlap_penalty(col("is_mixed"), F.lit(False), col("polyphony_score"), col("purity_score"))).withColumn("edge_penalty", sc.edge_penalty(col("duration_sec"), col("active_ratio"), col("settings.short_review"), high))
    x = x.withColumn("structure_score", sc.structure(col("tonality_score"), col("spectral_flatness"), col("peak_band_snr_db"))).withColumn("broadband_penalty", sc.broadband(col("spectral_flatness"), col("bandwidth_hz"), col("spectral_centroid"), col("tonality_score")))
    x = x.withColumn("selection_score", sc.selection(col("eventness_score"), col("purity_score"), col("quality_score"), col("duration_sec"), col("peak_db"), col("is_component")))
    clu = sc.clusterability(col("eventness_score"), col("local_snr_score"), col("structure_score"), col("duration_confidence"), col("embedding_stability"), col("broadband_penalty"), col("overlap_penalty"), col("edge_penalty"))
    fam = sc.prefamily(col("duration_sec"), col("spectral_flatness"), col("bandwidth_hz"), col("spectral_centroid"), col("tonality_score"), col("modulation_hz"), col("zero_crossing"))
    return x.withColumn("clusterability_score", clu).withColumn("family", fam)


def routed(events: DataFrame, c: DiscoveryConfig) -> DataFrame:
    """Refinement suppression, then the routers in order; every detection that survives refinement keeps a row."""
    x = iv.suppress(events, ["recording_id"], "start_sec", "end_sec", "event_id", [-F.coalesce("peak_db", "rms_db", "duration_sec")], c.refine_nms, "parent_event_id")
    x = rt.route(rt.start(x), F.col("is_mixed"), rt.MIXED, F.coalesce("mix_reason", F.lit("mixed")))
    x = rt.route(x, F.col("component_reason") != "clusterable_component", rt.COMPONENT_REVIEW, F.col("component_reason"))
    x = rt.route(x, F.col("detection_score") < c.min_detection, rt.LOW_DETECTION, "low_detection")
    low = sc.low_confidence(F.col("quality_score"), F.col("snr_db"), F.col("spectral_flatness"), F.col("tonality_score"), F.col("settings.noise_mode"), F.col("settings.min_quality"), c.min_snr, c.noise_flatness, c.min_tonality, F.col("settings.tonality_floor"))
    x = rt.route(x, low, rt.LOW_NOISE, "noise_quality")
    limit = F.when(F.col("is_component"), c.min_component_eventness).otherwise(F.col("settings.min_eventness"))
    x = rt.route(x, (F.col("eventness_score") < limit) | ((F.col("active_ratio") > 0.92) & (F.col("temporal_contrast_db") < 7)), rt.LOW_NOISE, "eventness")
    x = rt.route_candidates(x, ["recording_id"], "parent_event_id", "event_id", "start_sec", "end_sec", "selection_score", c.max_per_parent, c.candidate_nms)
    x = rt.route_short(x, "duration_sec", F.when(F.col("settings.review_short"), F.col("settings.short_review")))
    return rt.finish(rt.route_clusterability(x, "clusterability_score", F.col("settings.keep_clusterability"), F.col("settings.review_clusterability")))


def clustered(events: DataFrame, c: DiscoveryConfig) -> DataFrame:
    """cluster_id and cluster_probability of clusterable events: density clustering in blocks of a family.

    A block is one recording's family of at least ``family_block`` events; small families share one, or join the last
    block if they are few. Ids are dense within a recording.
    """
    from pyspark.sql import Window

    blocks = vx.family_blocks(events.where("clusterable"), ["recording_id"], "family", c.family_block).select("recording_id", "block", "event_id", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        labels, p = k.cluster_block(np.stack(pdf.embedding.to_numpy()), c.cluster_dims, c.min_cluster, max(2, c.min_cluster // 2))
        return pd.DataFrame({"recording_id": pdf.recording_id, "block": pdf.block, "event_id": pdf.event_id, "local": labels, "cluster_probability": p})

    local = blocks.groupBy("recording_id", "block").applyInPandas(run, "recording_id string, block string, event_id string, local int, cluster_probability double")
    dense = F.dense_rank().over(Window.partitionBy("recording_id", F.col("local") >= 0).orderBy("block", "local")) - 1
    named = local.withColumn("cluster_id", F.when(F.col("local") >= 0, dense).otherwise(-1)).drop("local", "block")
    joined = events.join(named, ["recording_id", "event_id"], "left")
    return represented(joined, c)


def represented(events: DataFrame, c: DiscoveryConfig) -> DataFrame:
    own = events.where("cluster_id >= 0")
    mean = vx.centroids(own, ["recording_id", "cluster_id"], "embedding", unit=False).drop("n")
    away = F.sqrt(F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    near = own.join(mean, ["recording_id", "cluster_id"]).select("recording_id", "cluster_id", "event_id", away.alias("_d"), "eventness_score", "local_snr_score", "embedding_stability", "duration_confidence", "overlap_penalty")
    far = near.groupBy("recording_id", "cluster_id").agg(F.max("_d").alias("_far"))
    sim = 1 - F.col("_d") / F.greatest(F.col("_far"), F.lit(1e-9))
    score = sc.representative(sim, F.col("eventness_score"), F.col("local_snr_score"), F.col("embedding_stability"), F.col("duration_confidence"), F.col("overlap_penalty"))
    scored_ = near.join(far, ["recording_id", "cluster_id"]).select("recording_id", "event_id", score.alias("representative_score"))
    return events.join(scored_, ["recording_id", "event_id"], "left")


def clusters(events: DataFrame, c: DiscoveryConfig) -> DataFrame:
    own = events.where("cluster_id >= 0").withColumn("_at", F.col("start_sec"))
    summary = vx.summarise_clusters(own, ["recording_id", "cluster_id"], "_at", "family", "is_component", mean_probability="cluster_probability", mean_purity="purity_score", mean_clusterability="clusterability_score", mean_stability="embedding_stability")
    top = vx.ranked(own, ["recording_id", "cluster_id"], "representative_score", "event_id", c.representatives)
    reps = top.groupBy("recording_id", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"]).alias("representative_event_ids"))
    return summary.join(reps, ["recording_id", "cluster_id"])


def run(recordings: DataFrame, c: DiscoveryConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, clusters) of all recordings.

    Kernels run once: detections, routed events and clustered events are checkpointed (rows of numbers, never samples),
    because the routers and cluster summaries join a table with what they derive from it.
    """
    c = c or DiscoveryConfig()
    shared_dir(recordings.sparkSession)
    found = detections(recordings, c).checkpoint()
    sorted_out = routed(scored(found, c), c).checkpoint()
    events = clustered(sorted_out, c).withColumn("config_hash", F.lit(fingerprint(c))).drop("settings").checkpoint()
    return events, clusters(events, c)
