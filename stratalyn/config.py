"""Parameters of both pipelines, validated at construction, with a fingerprint for reuse of results."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class DiscoveryConfig:
    """The interval pipeline. Times in seconds, levels in dB."""

    rate: int = 32000
    frame: int = 2048
    hop: int = 512
    threshold_db: float = 8.0
    max_flatness: float = 0.40
    votes: int = 2
    flux: bool = True
    concentration: bool = True
    flux_percentile: float = 90.0
    flux_mads: float = 4.0
    flux_snr: float = 1.5
    adaptive: bool = False
    review_short: bool = True
    floor_window: float = 8.0
    min_event: float = 0.25
    max_event: float = 8.0
    merge_gap: float = 0.4
    pad: float = 0.15
    multiband: bool = True
    band_window: float = 8.0
    band_snr: float = 6.0
    band_flux_z: float = 2.0
    band_gap: float = 0.08
    refine_above_floor: float = 3.0
    refine_below_peak: float = 18.0
    refine_nms: float = 0.85
    min_detection: float = 0.35
    min_quality: float = 0.55
    noise_mode: str = "balanced"
    min_snr: float = 3.0
    noise_flatness: float = 0.72
    min_tonality: float = 0.08
    tonality_floor: float = 0.20
    min_eventness: float = 0.28
    min_component_eventness: float = 0.50
    max_per_parent: int = 3
    candidate_nms: float = 0.98
    short_review: float = 0.20
    keep_clusterability: float = 0.55
    review_clusterability: float = 0.30
    component_snr: float = 10.0
    component_area: int = 20
    component_duration: float = 0.08
    component_bandwidth: float = 150.0
    component_ratio: float = 0.12
    max_components: int = 4
    min_cluster: int = 10
    cluster_dims: int = 10
    family_block: int = 15
    mels: int = 96
    representatives: int = 5
    seed: int = 42

    def __post_init__(self) -> None:
        unit = ("max_flatness", "refine_nms", "min_detection", "min_quality", "noise_flatness", "min_tonality", "tonality_floor", "min_eventness", "min_component_eventness", "candidate_nms", "keep_clusterability", "review_clusterability", "component_ratio")
        positive = ("rate", "frame", "hop", "threshold_db", "floor_window", "min_event", "max_event", "component_area", "max_components", "min_cluster", "cluster_dims", "mels", "max_per_parent", "representatives")
        for k in unit:
            if not 0 <= getattr(self, k) <= 1:
                raise ValueError(f"{k} must lie in [0, 1]")
        for k in positive:
            if getattr(self, k) <= 0:
                raise ValueError(f"{k} must be positive")
        if self.min_event > self.max_event or self.review_clusterability > self.keep_clusterability:
            raise ValueError("a lower limit lies above its upper limit")
        if self.noise_mode not in ("exploratory", "balanced", "conservative") or not 1 <= self.votes <= 3:
            raise ValueError("unknown noise mode, or votes outside 1 to 3")


@dataclass(frozen=True)
class WindowConfig:
    """The window-graph pipeline."""

    rate: int = 32000
    window: float = 5.0
    hop: float = 1.0
    silence_db: float = -55.0
    neighbours: int = 15
    resolution: float = 1.0
    min_cluster: int = 5
    subsamples: int = 5
    fraction: float = 0.8
    min_event: float = 0.10
    max_event: float = 30.0
    max_gap: float = 1.0
    nms: float = 0.5
    refine: bool = True
    envelope_db: float = 8.0
    envelope_pad: float = 0.05
    smoothing: float = 0.02
    few_shot: float = 0.45
    representatives: int = 16
    encoder: str = "mock"
    denoiser: str = "identity"
    seed: int = 42

    def __post_init__(self) -> None:
        for k in ("rate", "window", "hop", "neighbours", "resolution", "min_cluster", "max_event", "representatives"):
            if getattr(self, k) <= 0:
                raise ValueError(f"{k} must be positive")
        if not 0 < self.fraction <= 1 or not 0 <= self.few_shot <= 1 or self.min_event > self.max_event:
            raise ValueError("fraction, few_shot or the event limits are out of range")


def fingerprint(config) -> str:
    """First 16 hex digits of the SHA-256 of the sorted JSON."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


INF = float("inf")
#: Rules of the adaptive parameters as (what is tested, from, below, parameters); words are tested for equality.
RULES: tuple[tuple[str, float | str, float, dict], ...] = (
    ("dynamic_range", -INF, 12.0, {"threshold_db": 4.0, "flux_percentile": 82.0, "flux_snr": 0.5, "band_snr": 3.0, "band_flux_z": 1.0}),
    ("dynamic_range", 12.0, 18.0, {"threshold_db": 3.5}),
    ("dynamic_range", 18.0, 25.0, {"threshold_db": 5.0}),
    ("dynamic_range", 25.0, INF, {"threshold_db": 8.0}),
    ("regime", "sustained_narrowband", INF, {"min_event": 0.5, "max_event": 30.0, "short_review": 0.40, "merge_gap": 0.6, "flux": False, "concentration": True, "votes": 1}),
    ("regime", "transient_dense", INF, {"min_event": 0.08, "max_event": 2.0, "short_review": 0.06, "merge_gap": 0.1}),
    ("regime", "dense_variable", INF, {"min_event": 0.25, "max_event": 8.0, "short_review": 0.20, "merge_gap": 0.4}),
    ("regime", "low_dynamic_range", INF, {"votes": 1}),
    ("median_tonality", -INF, 0.10, {"tonality_floor": 0.05}),
    ("median_tonality", 0.10, 0.20, {"tonality_floor": 0.10}),
    ("dynamic_range", -INF, 12.0, {"noise_mode": "exploratory", "min_quality": 0.25, "min_eventness": 0.10, "keep_clusterability": 0.30, "review_clusterability": 0.10, "review_short": False}),
    ("dynamic_range", 12.0, 18.0, {"min_quality": 0.40}),
    ("hint", "insect_sustained", INF, {"flux": False, "min_event": 0.5, "max_event": 60.0, "votes": 1, "tonality_floor": 0.05}),
    ("hint", "marine_mammal", INF, {"min_event": 0.05, "max_event": 2.0, "merge_gap": 0.08, "tonality_floor": 0.05, "min_quality": 0.40}),
    ("hint", "bird_calls", INF, {"threshold_db": 3.0, "min_event": 0.10, "max_event": 3.0, "min_quality": 0.45}),
    ("hint", "wind_dominant", INF, {"min_quality": 0.65}),
)


def adapted(base: DiscoveryConfig, profile: dict) -> DiscoveryConfig:
    """``base`` with what the rules set for a recording's ``profile`` (dynamic_range, median_tonality, regime, hint)."""
    changes: dict = {}
    for what, low, high, each in RULES:
        x = profile.get(what)
        if x is not None and (x == low if isinstance(low, str) else low <= x < high):
            changes |= each
    return replace(base, **changes)


def described(base: DiscoveryConfig, profile: dict) -> str:
    """What the rules change for a recording, a line a parameter."""
    before, after = asdict(base), asdict(adapted(base, profile))
    lines = [f"  {k}: {before[k]} -> {after[k]}" for k in before if before[k] != after[k]]
    head = f"regime {profile.get('regime')}, hint {profile.get('hint') or 'none'}:"
    return "\n".join([head, *(lines or ["  nothing changes"])])


#: Settings of a tuning sweep. A pair (max or min, number) is taken against the base setting.
SWEEP: dict[str, dict] = {
    "baseline_current": {},
    "tight_temporal_precision": {"threshold_db": (max, 8.0), "flux_percentile": 94.0, "flux_mads": 5.0, "flux_snr": 2.0, "merge_gap": (min, 0.15), "pad": (min, 0.05), "max_event": (min, 4.0), "noise_mode": "balanced", "min_quality": (max, 0.48), "min_eventness": (max, 0.30), "max_per_parent": (min, 2)},
    "energy_only_precision": {"flux": False, "threshold_db": (max, 8.0), "merge_gap": (min, 0.15), "pad": (min, 0.05), "max_event": (min, 4.0), "noise_mode": "balanced", "min_quality": (max, 0.48), "min_eventness": (max, 0.32), "max_per_parent": 1},
    "precision_balanced": {"threshold_db": (max, 9.0), "flux_percentile": 92.0, "flux_mads": 4.5, "flux_snr": 2.0, "noise_mode": "balanced", "min_quality": (max, 0.50), "min_eventness": (max, 0.34), "max_per_parent": (min, 2)},
    "rare_event_guard": {"threshold_db": (min, 7.0), "flux_percentile": 94.0, "flux_mads": 5.0, "flux_snr": 1.5, "noise_mode": "exploratory", "min_quality": (min, 0.40), "min_eventness": (min, 0.24), "max_per_parent": (max, 3)},
    "clean_clusters": {"threshold_db": (max, 10.0), "flux_percentile": 94.0, "flux_mads": 5.0, "flux_snr": 2.5, "noise_mode": "conservative", "min_quality": (max, 0.55), "min_eventness": (max, 0.38), "max_per_parent": 1},
}
#: Three more of a balanced sweep.
SWEEP_BALANCED: dict[str, dict] = {
    "high_recall_structured": {"threshold_db": 6.0, "flux_percentile": 90.0, "flux_mads": 4.0, "flux_snr": 1.0, "noise_mode": "exploratory", "min_quality": 0.38},
    "strict_flux": {"threshold_db": 8.0, "flux_percentile": 96.0, "flux_mads": 5.5, "flux_snr": 2.0, "noise_mode": "balanced", "min_quality": 0.48},
    "stable_medium_clusters": {"threshold_db": 9.0, "flux_percentile": 93.0, "flux_mads": 4.5, "flux_snr": 2.0, "noise_mode": "balanced", "min_quality": 0.50},
}


def variants(base: DiscoveryConfig, budget: str = "quick") -> dict[str, DiscoveryConfig]:
    """Named settings of a tuning sweep, equal ones left out."""
    if budget not in ("quick", "balanced"):
        raise ValueError("the budget is quick or balanced")
    out, seen = {}, set()
    for name, change in (SWEEP | (SWEEP_BALANCED if budget == "balanced" else {})).items():
        c = replace(base, **{k: v[0](getattr(base, k), v[1]) if isinstance(v, tuple) else v for k, v in change.items()})
        if (f := fingerprint(c)) not in seen:
            seen.add(f)
            out[name] = c
    return out


#: Names that a web form may use for parameters of the interval pipeline.
FORM = {"threshold_db": float, "merge_gap": float, "pad": float, "min_event": float, "max_event": float, "noise_mode": str, "min_quality": float, "min_eventness": float, "min_cluster": int, "representatives": int, "adaptive": bool, "review_short": bool, "short_review": float, "max_components": int, "multiband": bool, "keep_clusterability": float, "review_clusterability": float}


def from_form(form: dict[str, str | None], base: DiscoveryConfig | None = None) -> DiscoveryConfig:
    """A configuration from the texts of a form: blank fields keep the base, wrong ones raise ValueError with their name."""
    changes: dict = {}
    for name, kind in FORM.items():
        text = (form.get(name) or "").strip()
        if not text:
            continue
        try:
            changes[name] = text.lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
        except ValueError:
            raise ValueError(f"{name}: {text!r} is not a valid {kind.__name__}") from None
    return replace(base or DiscoveryConfig(), **changes)
