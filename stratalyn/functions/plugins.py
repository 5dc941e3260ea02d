"""Named kernels that users may add: encoders, denoisers, views of a clip."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from stratalyn.functions import kernels as k


@dataclass(frozen=True)
class Encoder:
    name: str
    rate: int
    window: float
    dims: int
    embed: Callable[[np.ndarray], np.ndarray]  # windows x samples to windows x dims


def _mock(windows: np.ndarray) -> np.ndarray:
    """Statistics of 64 mel bands, standardised, through a seeded projection to 256 unit-norm numbers."""
    projection = np.random.default_rng(1234).standard_normal((256, 256)) / 16
    out = []
    for w in windows:
        m = k.log_mel(w, 32000, 1024, 512, 64)
        v = np.concatenate([m.mean(1), m.std(1), m.max(1), m.min(1)])
        v = ((v - v.mean()) / (v.std() + 1e-9)) @ projection
        out.append(v / (np.linalg.norm(v) + 1e-9))
    return np.array(out, np.float32).reshape(-1, 256)


ENCODERS = {"mock": Encoder("mock", 32000, 5.0, 256, _mock)}
DENOISERS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"identity": lambda x, rate: x}


def _crop(x: np.ndarray, rate: int, centre: float) -> np.ndarray:
    n = int(len(x) * 0.7)
    return x[(len(x) - n) // 2 :][:n]


VIEWS: dict[str, Callable[[np.ndarray, int, float], np.ndarray]] = {"original": lambda x, rate, centre: x, "centre_crop": _crop, "band_limited": lambda x, rate, centre: k.band_pass(x, rate, max(20.0, centre / 3), centre * 3)}


def find(registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"unknown: {name}; there are {sorted(registry)}")
    return registry[name]
