"""Scoring expressions as Columns. Null and NaN take a stated default before any arithmetic.

``greatest`` and ``least`` skip nulls and order NaN last, so values pass through ``safe`` first.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe(c: Column, default: float) -> Column:
    """Null, NaN and infinities become ``default``."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(float(default))).otherwise(c)


def unit(c: Column) -> Column:
    """Clipped to [0, 1]. Null would become 0 and NaN 1, so both take their default before.

    The argument occurs once: these expressions nest, and every repetition multiplies the plan.
    """
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def smoothstep(low: float | Column, high: float | Column, x: Column) -> Column:
    """Cubic ramp from 0 at ``low`` to 1 at ``high``; a step where the edges meet."""
    if isinstance(low, Column) or isinstance(high, Column):
        low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
        t = unit(F.try_divide(x - low, high - low))
        return F.when(high <= low, F.when(x >= high, 1.0).otherwise(0.0)).otherwise(t * t * (3.0 - 2.0 * t))
    if high <= low:
        return F.when(x >= high, 1.0).otherwise(0.0)
    t = unit((x - low) / (high - low))
    return t * t * (3.0 - 2.0 * t)


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over the hull of two intervals; 0 for an empty hull."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2)) / hull).otherwise(0.0)


def coverage(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The part of the second interval that the first one covers."""
    return F.when(e2 > s2, F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2)) / (e2 - s2)).otherwise(0.0)


def quality(snr: Column, flatness: Column, tonality: Column, bandwidth_ratio: Column, peak_snr: Column, min_snr: float = 3.0, max_flatness: float = 0.72, min_tonality: float = 0.08) -> Column:
    parts = ((0.15, smoothstep(min_snr, min_snr + 12, snr)), (0.30, 1 - smoothstep(0.35, max_flatness, flatness)), (0.20, smoothstep(min_tonality, 0.42, tonality)), (0.05, 1 - smoothstep(0.45, 0.95, bandwidth_ratio)), (0.30, smoothstep(min_snr, min_snr + 18, peak_snr)))
    return sum((w * c for w, c in parts[1:]), parts[0][0] * parts[0][1])


#: What each noise mode adds to the quality threshold.
MODES = {"exploratory": -0.12, "balanced": 0.0, "conservative": 0.15}


def low_confidence(q: Column, snr: Column, flatness: Column, tonality: Column, mode: str | Column = "balanced", threshold: float | Column = 0.55, min_snr: float = 3.0, max_flatness: float = 0.72, min_tonality: float = 0.08, floor: float | Column = 0.20) -> Column:
    """``mode`` and the limits may be columns, where recordings differ.

    The limit is the decimal sum of threshold and mode: as doubles, 0.55 + 0.15 is above 0.7 and would reject a score of 0.7.
    """
    if isinstance(mode, Column) or isinstance(threshold, Column):
        added = F.element_at(F.create_map(*[F.lit(v) for pair in MODES.items() for v in pair]), mode) if isinstance(mode, Column) else F.lit(MODES[mode])
        limit = unit(F.round(added + threshold, 12))
    else:
        limit = min(1.0, max(0.0, round(threshold + MODES[mode], 12)))
    return (q < limit) | ((snr < min_snr) & (flatness > max_flatness) & (tonality < min_tonality)) | (tonality < floor)


def eventness(contrast: Column, occupancy: Column, duration: Column, is_component: Column, purity: Column, min_contrast: float = 4.0, max_active: float = 0.92) -> Column:
    base = 0.55 * smoothstep(min_contrast, min_contrast + 14, contrast) + 0.25 * (1 - smoothstep(0.55, max_active, occupancy)) + 0.20 * duration
    pure = is_component & purity.isNotNull()
    return unit(F.when(pure, 0.75).otherwise(1.0) * base + F.when(pure, 0.25 * unit(purity)).otherwise(0.0))


def duration_window(duration: Column, rise: tuple[float, float], fall: tuple[float, float]) -> Column:
    """Rises over the first pair of durations, falls over the second."""
    return unit(smoothstep(*rise, duration) * (1 - smoothstep(*fall, duration)))


def selection(event: Column, purity: Column, q: Column, duration: Column, peak_db: Column, is_component: Column) -> Column:
    clipped = lambda c, d: unit(F.coalesce(c, d if isinstance(d, Column) else F.lit(d)))
    preferred = F.when(duration <= 0, 0.0).otherwise(duration_window(duration, (0.08, 0.25), (5.0, 8.0)))
    peak = unit(F.coalesce((peak_db + 60) / 60, F.lit(0.5)))
    return 0.40 * clipped(event, 0.5) + 0.25 * clipped(purity, F.when(is_component, 0.5).otherwise(0.7)) + 0.20 * clipped(q, 0.7) + 0.10 * preferred + 0.05 * peak


def clusterability(event: Column, snr: Column, structure: Column, duration: Column, stability: Column, broadband: Column, overlap: Column, edge: Column, min_stability: float = 0.60) -> Column:
    score = 0.24 * safe(event, 0.55) + 0.22 * snr + 0.20 * structure + 0.14 * duration + 0.14 * F.coalesce(stability, F.lit(0.75)) - 0.18 * broadband - 0.08 * overlap - 0.06 * edge
    return unit(score - F.when(stability < min_stability, 0.08 * (1 - stability)).otherwise(0.0))


def structure(tonality: Column, flatness: Column, peak_snr: Column) -> Column:
    return unit(0.45 * safe(tonality, 0.35) + 0.35 * (1 - safe(flatness, 0.5)) + 0.20 * smoothstep(0.0, 18.0, safe(peak_snr, 6.0)))


def broadband(flatness: Column, bandwidth: Column, centroid: Column, tonality: Column) -> Column:
    ratio = unit(safe(bandwidth, 0.0) / F.greatest(F.greatest(safe(centroid, 0.0), F.lit(1.0)) * 2, F.lit(1.0)))
    return unit(0.50 * safe(flatness, 0.0) + 0.30 * ratio + 0.20 * (1 - safe(tonality, 0.5)))


def overlap_penalty(is_mixed: Column, is_overlapping: Column, polyphony: Column, purity: Column) -> Column:
    worst = F.greatest(F.when(is_overlapping, 0.4).otherwise(0.0), 0.5 * safe(polyphony, 0.0), 0.5 * (1 - safe(purity, 1.0)))
    return F.when(is_mixed, 1.0).otherwise(unit(worst))


def edge_penalty(duration: Column, active: Column, min_review: float = 0.20, max_duration: float = 8.0, max_active: float = 0.92) -> Column:
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    return unit(when(duration < min_review, 0.45) + when(duration > max_duration * 0.9, 0.35) + when(active > max_active, 0.25))


def representative(similarity: Column, event: Column, snr: Column, stability: Column, duration: Column, overlap: Column) -> Column:
    return unit(0.30 * similarity + 0.25 * safe(event, 0.55) + 0.20 * safe(snr, 0.55) + 0.15 * safe(stability, 0.70) + 0.10 * safe(duration, 0.65) - 0.20 * safe(overlap, 0.0))


def component_quality(purity: Column, snr: Column, ratio: Column, compactness: Column, duration: Column, min_snr: float = 8.0, min_ratio: float = 0.12, min_compact: float = 0.15, min_duration: float = 0.08) -> Column:
    return unit(0.30 * unit(purity) + 0.25 * unit(snr / (2 * min_snr)) + 0.20 * unit(ratio / (2 * min_ratio)) + 0.15 * unit(compactness / (3 * min_compact)) + 0.10 * unit(duration / (3 * min_duration)))


def component_gate(rank: Column, purity: Column, ratio: Column, snr: Column, compactness: Column, q: Column, limit: int = 2) -> Column:
    """The first reason against a component, or ``clusterable_component``."""
    return (
        F.when(rank >= limit, "component_rank_exceeds_clustering_limit")
        .when(purity < 0.72, "component_purity_below_threshold")
        .when(ratio < 0.12, "component_energy_ratio_below_threshold")
        .when(snr < 8.0, "component_snr_below_threshold")
        .when(compactness < 0.15, "component_compactness_below_threshold")
        .when(q < 0.62, "component_quality_below_threshold")
        .otherwise("clusterable_component")
    )


def polyphony(n: Column, dominant: Column, overlap: Column) -> Column:
    return F.when(n <= 1, 0.0).otherwise(unit(0.45 * F.least(F.lit(1.0), (n - 1) / 3) + 0.35 * (1 - dominant) + 0.20 * overlap))


#: The families, and the one of what fits none.
FAMILIES = ("tonal_whistle", "harmonic_call", "pulse_train", "broadband_click", "noisy_burst", "insect_trill", "low_frequency_call", "unknown")


def prefamily(duration: Column, flatness: Column, bandwidth: Column, centroid: Column, tonality: Column, modulation: Column, zcr: Column) -> Column:
    """Morphology family: the first family of this order whose tests all hold, else ``unknown``."""
    flatness, bandwidth, centroid, tonality = safe(flatness, 0.5), safe(bandwidth, 0.0), safe(centroid, 0.0), safe(tonality, 0.3)
    narrow = lambda least, share: bandwidth < F.greatest(F.lit(least), share * centroid)
    tests = {
        "broadband_click": (duration < 0.12, flatness > 0.45, bandwidth > 1500),
        "low_frequency_call": (centroid < 900, duration >= 0.18, tonality >= 0.12),
        "insect_trill": (duration >= 0.45, centroid >= 3000, tonality >= 0.18, modulation >= 8),
        "noisy_burst": (flatness >= 0.62, tonality < 0.18),
        "tonal_whistle": (tonality >= 0.48, narrow(900.0, 0.55)),
        "harmonic_call": (tonality >= 0.22, narrow(1800.0, 1.25)),
        "pulse_train": (modulation >= 5, zcr > 0.08),
    }
    return F.coalesce(*[F.when(reduce(and_, each), name) for name, each in tests.items()], F.lit("unknown"))


def regime(sustained: Column, stationarity: Column, density: Column, active: Column, dynamic: Column) -> Column:
    return (
        F.when((sustained >= 1.5) & (stationarity >= 0.85), "sustained_narrowband")
        .when((density >= 6) & (active < 0.40), "transient_dense")
        .when(dynamic < 18, "low_dynamic_range")
        .when((active >= 0.20) & (stationarity < 0.70), "dense_variable")
        .otherwise("default_sparse")
    )


def global_score(f1: Column, purity: Column, compression: Column, mean_iou: Column, poly: Column) -> Column:
    packed = F.least(F.lit(1.0), F.ln(1 + compression) / F.ln(F.lit(21.0)))
    return 100 * (0.40 * f1 + 0.25 * purity + 0.15 * packed + 0.10 * mean_iou + 0.10 * F.coalesce(poly, F.lit(0.5)))


def slug(c: Column, default: str = "cluster") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def weight(distance: Column, metric: str = "cosine") -> Column:
    """Edge weight of a neighbour distance."""
    return F.least(F.greatest(1 - distance, F.lit(0.0)), F.lit(2.0)) if metric == "cosine" else 1 / (1 + distance)
