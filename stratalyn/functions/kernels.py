"""Signal kernels in numpy: what a relational plan cannot say. All take and give plain arrays."""

from __future__ import annotations

import numpy as np


def frames_of(x: np.ndarray, size: int, hop: int, centre: bool = True) -> np.ndarray:
    if centre:
        x = np.pad(x, size // 2)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def to_db(amplitude: np.ndarray, top_db: float | None = None, floor: float = 1e-10) -> np.ndarray:
    db = 20 * np.log10(np.maximum(np.abs(amplitude), floor))
    return np.maximum(db, db.max(initial=-np.inf) - top_db) if top_db is not None and db.size else db


def rms_db(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    return to_db(np.sqrt((frames_of(x, size, hop).astype(np.float64) ** 2).mean(axis=1)))


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frequency x time, Hann window, centred."""
    return np.fft.rfft(frames_of(x, size, hop) * np.hanning(size + 1)[:-1], axis=1).T


def istft(z: np.ndarray, size: int, hop: int, length: int) -> np.ndarray:
    w = np.hanning(size + 1)[:-1]
    blocks = np.fft.irfft(z.T, size, axis=1) * w
    out, weight = np.zeros(size + hop * (len(blocks) - 1)), np.zeros(size + hop * (len(blocks) - 1))
    for i, b in enumerate(blocks):
        out[i * hop : i * hop + size] += b
        weight[i * hop : i * hop + size] += w * w
    y = (out / np.maximum(weight, 1e-8))[size // 2 :][:length]
    return np.pad(y, (0, max(0, length - len(y))))


def mel_bank(rate: int, size: int, mels: int) -> np.ndarray:
    """Triangles equally spaced on the mel scale, each of unit area."""
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = to_hz(np.linspace(0, to_mel(rate / 2), mels + 2))
    f = np.fft.rfftfreq(size, 1 / rate)
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x: np.ndarray, rate: int, size: int, hop: int, mels: int, top_db: float | None = 80.0) -> np.ndarray:
    power = mel_bank(rate, size, mels) @ np.abs(stft(x, size, hop)) ** 2
    db = 10 * np.log10(np.maximum(power, 1e-10))
    return np.maximum(db, db.max() - top_db) if top_db is not None else db


def flatness(mag: np.ndarray) -> np.ndarray:
    p = np.maximum(np.abs(mag) ** 2, 1e-10)
    return np.exp(np.log(p).mean(axis=0)) / p.mean(axis=0)


def tonality(mag: np.ndarray) -> float:
    """One less the normalised spectral entropy, median over frames."""
    p = np.maximum(np.abs(mag).astype(np.float64) ** 2, 1e-20)
    p = p / p.sum(axis=0, keepdims=True)
    return float(np.median(1 + (p * np.log(p)).sum(axis=0) / np.log(max(2, len(p))))) if p.size else 0.0


def centroid_bandwidth(mag: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    f = np.linspace(0, rate / 2, len(mag))[:, None]
    w = np.abs(mag) / np.maximum(np.abs(mag).sum(axis=0, keepdims=True), 1e-12)
    c = (f * w).sum(axis=0)
    return c, np.sqrt((w * (f - c) ** 2).sum(axis=0))


def rolloff(mag: np.ndarray, rate: int, share: float = 0.85) -> np.ndarray:
    total = np.cumsum(np.abs(mag), axis=0)
    return np.linspace(0, rate / 2, len(mag))[(total >= share * total[-1:]).argmax(axis=0)]


def zero_crossings(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    s = np.signbit(frames_of(x, size, hop))
    return (s[:, 1:] != s[:, :-1]).mean(axis=1)


def band_pass(x: np.ndarray, rate: int, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth response applied in the frequency domain; passes x through where the band is void."""
    high = min(high, rate / 2 * 0.98)
    if low >= high or len(x) < 16:
        return x
    f = np.fft.rfftfreq(len(x), 1 / rate)
    with np.errstate(divide="ignore"):
        gain = 1 / (1 + (low / np.maximum(f, 1e-9)) ** (2 * order)) / (1 + (f / high) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(x) * gain, len(x)).astype(x.dtype)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited by the spectrum."""
    if rate == target or not len(x):
        return x
    n = max(1, int(round(len(x) * target / rate)))
    z, y = np.fft.rfft(x), np.zeros(n // 2 + 1, complex)
    k = min(len(z), len(y))
    y[:k] = z[:k]
    return np.fft.irfft(y, n) * (n / len(x))


def flux(mel_db: np.ndarray) -> np.ndarray:
    rise = np.sqrt((np.maximum(0, np.diff(mel_db, axis=1)) ** 2).mean(axis=0)) if mel_db.shape[1] > 1 else np.zeros(0)
    return np.concatenate((rise[:1] if len(rise) else np.zeros(mel_db.shape[1]), rise))


def rolling_floor(x: np.ndarray, width: int, percent: float = 20) -> np.ndarray:
    width = max(3, width | 1)
    v = np.lib.stride_tricks.sliding_window_view(np.pad(x, width // 2, mode="edge"), width)
    k = int(width * percent / 100)
    return np.partition(v, k, axis=1)[:, k]


def opened_closed(mask: np.ndarray, opening: int, closing: int) -> np.ndarray:
    def sweep(m: np.ndarray, width: int, grow: bool) -> np.ndarray:
        before, after = ((width - 1) // 2, width // 2) if not grow else (width // 2, (width - 1) // 2)
        v = np.lib.stride_tricks.sliding_window_view(np.pad(m, (before, after)), width)
        return v.any(axis=1) if grow else v.all(axis=1)

    for width, first in ((opening, False), (closing, True)):
        if width > 1:
            mask = sweep(sweep(mask, width, first), width, not first)
    return mask


def intervals(mask: np.ndarray, step: float, duration: float) -> list[tuple[float, float]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(a * step, min(b * step, duration)) for a, b in edge.reshape(-1, 2)]


def _spread_3x3(mask: np.ndarray, grow: bool) -> np.ndarray:
    """Largest (grow) or smallest value of the 3 x 3 neighbourhood; nothing is active outside."""
    padded = np.pad(mask, 1)
    around = [padded[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)]
    return np.logical_or.reduce(around) if grow else np.logical_and.reduce(around)


def cleaned_mask(mask: np.ndarray) -> np.ndarray:
    """3 x 3 opening, then closing."""
    for grow in (False, True, True, False):
        mask = _spread_3x3(mask, grow)
    return mask


def smoothed(mask: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """A mask blurred by a Gaussian (mirrored at the edges) and scaled to a peak of one."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    out = mask.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (reach, reach)
        padded = np.pad(out, pad, mode="symmetric")
        out = sum(v / w.sum() * np.take(padded, range(i, i + out.shape[axis]), axis=axis) for i, v in enumerate(w))
    return np.clip(out / max(float(out.max(initial=0.0)), 1e-12), 0.0, 1.0)


def profile(x: np.ndarray, rate: int, size: int = 2048, hop: int = 512) -> dict:
    """What a whole recording is like: levels, activity, runs, transients, spectrum, stationarity, tonality."""
    out = {"duration": len(x) / rate, "p10": -120.0, "p50": -120.0, "p90": -120.0, "dynamic_range": 0.0, "active": 0.0, "active_run": 0.0, "inactive_run": 0.0, "sustained": 0.0, "density": 0.0, "dominant_hz": 0.0, "spread_hz": 0.0, "stationarity": 1.0, "median_tonality": 0.0}
    if not len(x):
        return out
    db = rms_db(x, size, hop)
    p10, p50, p90 = (float(v) for v in np.percentile(db, [10, 50, 90]))
    on = db > p10 + 8.0
    edges = np.flatnonzero(np.diff(on.astype(int))) + 1
    lengths, first = np.diff([0, *edges.tolist(), len(on)]), on[[0, *edges.tolist()]]
    median = lambda v: float(np.median(v)) * hop / rate if len(v) else 0.0
    active, quiet = median(lengths[first]), median(lengths[~first])
    mel = log_mel(x, rate, size, hop, 64, None)
    rise = flux(mel)[1:] if mel.shape[1] > 1 else np.zeros(0)
    centre, width = centroid_bandwidth(np.abs(stft(x, size, hop)), rate)
    unit = mel / np.maximum(np.linalg.norm(mel, axis=0), 1e-12)
    share = 10 ** (mel / 10)
    share = np.maximum(share, 1e-20) / np.maximum(share.sum(axis=0), 1e-20)
    peaky = 1 + (share * np.log(share + 1e-20)).sum(axis=0) / np.log(max(2, len(mel)))
    return out | {
        "p10": p10, "p50": p50, "p90": p90, "dynamic_range": p90 - p10, "active": float(on.mean()), "active_run": active, "inactive_run": quiet, "sustained": active / quiet if quiet > 0 else active,
        "density": float((rise > np.percentile(rise, 95)).sum() / (len(x) / rate)) if len(rise) else 0.0, "dominant_hz": float(np.nanmedian(centre)), "spread_hz": float(np.nanmedian(width)),
        "stationarity": float(np.nanmean((unit[:, :-1] * unit[:, 1:]).sum(axis=0))) if mel.shape[1] > 1 else 1.0, "median_tonality": float(np.nanmedian(np.nan_to_num(peaky))),
    }


def regime_of(p: dict) -> str:
    """The regime of a profile; ``scores.regime`` says the same of columns."""
    tests = {
        "sustained_narrowband": p["sustained"] >= 1.5 and p["stationarity"] >= 0.85,
        "transient_dense": p["density"] >= 6 and p["active"] < 0.40,
        "low_dynamic_range": p["dynamic_range"] < 18,
        "dense_variable": p["active"] >= 0.20 and p["stationarity"] < 0.70,
    }
    return next((name for name, holds in tests.items() if holds), "default_sparse")


def label_2d(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Four-neighbour components: runs of each column joined by union-find."""
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = np.zeros(mask.shape, np.int32)
    for t in range(mask.shape[1]):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[:, t].astype(np.int8), [0]))))
        for a, b in edge.reshape(-1, 2):
            parent.append(len(parent))
            own = len(parent) - 1
            if t:
                for other in np.unique(out[a:b, t - 1]):
                    if other:
                        x, y = find(own), find(other - 1)
                        parent[max(x, y)] = min(x, y)
            out[a:b, t] = own + 1
    roots = np.array([find(i) for i in range(len(parent))], np.int64)
    kept, dense = np.unique(roots, return_inverse=True)
    table = np.concatenate(([0], dense + 1)).astype(np.int32)
    return table[out], len(kept)


def embedding(x: np.ndarray, rate: int, mels: int = 96, size: int = 2048, hop: int = 512) -> np.ndarray:
    """6 x mels + 13 numbers: mean, deviation, maximum and 90th percentile of each mel band, mean and deviation of its
    change, three of level, and mean and deviation of five spectral descriptors. NaN and infinities become 0."""
    n = max(256, min(size, 1 << int(np.log2(max(256, len(x))))))
    step = min(hop, n // 4)
    m, z = log_mel(x, rate, n, step, mels), np.abs(stft(x, n, step))
    d = np.diff(m, axis=1) if m.shape[1] > 1 else np.zeros_like(m)
    level = np.sqrt((frames_of(x, n, step).astype(np.float64) ** 2).mean(axis=1))
    c, b = centroid_bandwidth(z, rate)
    five = [c, b, rolloff(z, rate), flatness(z), zero_crossings(x, n, step)]
    out = np.concatenate([m.mean(1), m.std(1), m.max(1), np.percentile(m, 90, axis=1), d.mean(1), d.std(1), [level.mean(), level.std(), level.max()], *[[v.mean(), v.std()] for v in five]])
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32)


def refine_energy(x: np.ndarray, rate: int, above: float = 3.0, below: float = 18.0, pad: float = 0.03, least: float = 0.25) -> tuple[float, float]:
    """Start and end of the loud part of a clip, at least ``least`` long and never outside it."""
    n = max(64, min(1024, len(x)))
    hop, length = max(1, n // 4), len(x) / rate
    db = rms_db(x, n, hop)
    on = np.flatnonzero(db >= max(np.percentile(db, 20) + above, db.max() - below)) if len(db) else []
    if not len(on):
        return 0.0, length
    a, b = max(0.0, on[0] * hop / rate - pad), min(length, (on[-1] + 1) * hop / rate + pad)
    if b - a < least:
        mid = (a + b) / 2
        a, b = max(0.0, mid - least / 2), min(length, mid + least / 2)
    return a, b


def refine_envelope(x: np.ndarray, rate: int, drop_db: float = 8.0, pad: float = 0.05, smoothing: float = 0.02) -> tuple[float, float]:
    """Where the smoothed envelope exceeds its peak less ``drop_db``; never expands."""
    if not len(x):
        return 0.0, 0.0
    w = max(1, int(smoothing * rate))
    env = np.convolve(np.abs(x), np.ones(w) / w, mode="same")
    on = np.flatnonzero(env > env.max() * 10 ** (-drop_db / 20))
    return (max(0.0, on[0] / rate - pad), min(len(x) / rate, (on[-1] + 1) / rate + pad)) if len(on) else (0.0, len(x) / rate)


def pca(x: np.ndarray, dims: int) -> np.ndarray:
    x = np.nan_to_num(x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    k = min(dims, len(s))
    sign = np.where(np.abs(u[:, :k]).argmax(axis=0) >= 0, np.sign(u[np.abs(u[:, :k]).argmax(axis=0), np.arange(k)]), 1)
    return u[:, :k] * s[:k] * sign


def _distances(x: np.ndarray, i: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((x - x[i]) ** 2).sum(axis=1)))


def _core(x: np.ndarray, samples: int) -> np.ndarray:
    """Distance of every point to its ``samples``-th neighbour, itself the 0th."""
    k = min(samples, len(x) - 1)
    return np.array([np.partition(_distances(x, i), k)[k] for i in range(len(x))])


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def density_clusters(x: np.ndarray, least: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and membership strength by a density hierarchy.

    The spanning tree of mutual reachability is taken apart from its longest edge down. Sides of at least ``least``
    points are clusters, smaller ones fall out; the clusters of the largest total excess of mass are chosen, the whole
    set never. Distances are taken a row at a time, so memory follows the points. Up to ``least`` points (or four) are
    one cluster.
    """
    n = len(x)
    if n <= max(4, least):
        return np.zeros(n, int), np.ones(n)
    core, best, at, out = _core(x, samples), np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, j = [], 0
    for _ in range(n - 1):  # Prim's tree
        out[j] = True
        reach = np.maximum(np.maximum(_distances(x, j), core), core[j])
        closer = (reach < best) & ~out
        best[closer], at[closer] = reach[closer], j
        j = int(np.where(out, np.inf, best).argmin())
        edges.append((float(best[j]), int(at[j]), j))
    parent, sides, size, height = list(range(2 * n - 1)), {}, [1] * n, {}
    for d, a, b in sorted(edges):
        a, b, node = _find(parent, a), _find(parent, b), len(size)
        parent[a] = parent[b] = node
        sides[node], height[node] = (a, b), d
        size.append(size[a] + size[b])

    def points(node: int) -> list[int]:
        found, todo = [], [node]
        while todo:
            k = todo.pop()
            if k < n:
                found.append(k)
            else:
                todo += sides[k]
        return found

    birth, mass, children, owner, leaves, todo = [0.0], [0.0], [[]], np.zeros(n, int), np.zeros(n), [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        density = 1 / max(height[node], 1e-12)
        large = [k for k in sides[node] if size[k] >= least]
        for k in sides[node]:
            mass[c] += size[k] * (density - birth[c]) if k not in large or len(large) == 2 else 0.0
            if k not in large:
                fallen = points(k)
                owner[fallen], leaves[fallen] = c, density
        for k in large:
            if len(large) == 2:
                children[c].append(len(birth))
                birth.append(density)
                mass.append(0.0)
                children.append([])
            todo.append((k, children[c][-1] if len(large) == 2 else c))
    chosen, total = [False] * len(birth), list(mass)
    for c in range(len(birth) - 1, 0, -1):
        below = sum(total[k] for k in children[c])
        chosen[c] = mass[c] >= below
        total[c] = max(mass[c], below)
    label, names, todo = [-1] * len(birth), 0, [(k, -1) for k in children[0]]
    while todo:  # a chosen cluster takes all below it
        c, above = todo.pop()
        if above < 0 and chosen[c]:
            above, names = names, names + 1
        label[c] = above
        todo += [(k, above) for k in children[c]]
    labels = np.array([label[c] for c in owner.tolist()])
    order = {v: i for i, v in enumerate(dict.fromkeys(v for v in labels.tolist() if v >= 0))}
    labels = np.array([order.get(v, -1) for v in labels.tolist()])
    top = np.array([leaves[labels == k].max() for k in range(len(order))] or [1.0])
    return labels, np.where(labels >= 0, np.minimum(1.0, leaves / top[np.maximum(labels, 0)]), 0.0)


def near_clusters(x: np.ndarray, radius: float, samples: int) -> np.ndarray:
    """Labels (-1: noise): points with at least ``samples`` points within ``radius``, themselves included, and what they reach."""
    near = [np.flatnonzero(_distances(x, i) <= radius) for i in range(len(x))]
    dense, labels, names = np.array([len(v) >= samples for v in near]), np.full(len(x), -1), 0
    for i in range(len(x)):
        if labels[i] >= 0 or not dense[i]:
            continue
        labels[i], todo = names, [i]
        while todo:
            k = todo.pop()
            if dense[k]:
                new = near[k][labels[near[k]] < 0]
                labels[new] = names
                todo += new.tolist()
        names += 1
    return labels


def ward_clusters(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` groups by least growth of the squared error, from chains of nearest neighbours."""
    n = len(x)
    centre, size, alive, merges, chain = x.astype(float).copy(), np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            cost = size * size[i] / (size + size[i]) * ((centre - centre[i]) ** 2).sum(axis=1)
            cost[~alive] = np.inf
            cost[i] = np.inf
            j = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        merges.append((float(cost[j]), i, j))
        centre[j] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[j] += size[i]
        alive[i] = False
    parent = list(range(n))
    for _, a, b in sorted(merges)[: n - k]:
        parent[_find(parent, a)] = _find(parent, b)
    return np.unique([_find(parent, i) for i in range(n)], return_inverse=True)[1]


def fallback_clusters(x: np.ndarray, least: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the hierarchy finds noise only: neighbourhoods of radius 2, or else one to four groups."""
    labels = near_clusters(x, 2.0, max(2, samples))
    if len(set(labels.tolist())) <= 1 and len(x) >= least:
        labels = ward_clusters(x, max(1, min(4, len(x) // least)))
    return labels, (labels >= 0).astype(float)


def cluster_block(x: np.ndarray, dims: int, least: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and strengths of a block of embeddings: standardised, reduced, clustered by density or else by fallback."""
    x = np.nan_to_num(x.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    if len(x) <= max(4, least):
        return np.zeros(len(x), int), np.ones(len(x))
    spread = x.std(axis=0)
    reduced = pca((x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0), dims)
    labels, strength = density_clusters(reduced, least, samples)
    return (labels, strength) if (labels >= 0).any() else fallback_clusters(reduced, least, samples)


def modularity_groups(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, resolution: float = 1.0, seed: int = 42, least: int = 1) -> np.ndarray:
    """Seeded local moving with aggregation (Louvain); groups under ``least`` become -1, the rest 0, 1, ..."""
    rng, member = np.random.default_rng(seed), np.arange(n)
    a, b, weight = src.astype(int), dst.astype(int), w.astype(float)
    while True:
        size = int(max(a.max(initial=-1), b.max(initial=-1), member.max(initial=-1))) + 1
        near: list[dict[int, float]] = [{} for _ in range(size)]
        for i, j, x in zip(a.tolist(), b.tolist(), weight.tolist()):
            near[i][j] = near[i].get(j, 0) + x
            if i != j:
                near[j][i] = near[j].get(i, 0) + x
        degree = np.array([sum(v.values()) + v.get(i, 0) for i, v in enumerate(near)])
        total, group = degree.sum(), np.arange(size)
        if total <= 0:
            break
        inside, moved = degree.copy(), False
        for _ in range(10):
            changed = False
            for i in rng.permutation(size).tolist():
                own, links = group[i], {}
                for j, x in near[i].items():
                    if j != i:
                        links[group[j]] = links.get(group[j], 0) + x
                inside[own] -= degree[i]
                best, gain = own, links.get(own, 0) - resolution * inside[own] * degree[i] / total
                for g in sorted(links):
                    if (q := links[g] - resolution * inside[g] * degree[i] / total) > gain + 1e-12:
                        best, gain = g, q
                inside[best] += degree[i]
                if best != own:
                    group[i], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            break
        _, dense = np.unique(group, return_inverse=True)
        member, a, b = dense[member], dense[a], dense[b]
    _, labels, sizes = np.unique(member, return_inverse=True, return_counts=True)
    good = sizes >= least
    return np.where(good[labels], np.cumsum(good)[labels] - 1, -1)
