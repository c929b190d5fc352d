"""Pixel kernels on (height, width, 3) uint8 rasters, in numpy; Spark runs them in Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np

Raster = np.ndarray


def key_seed(*parts: object) -> int:
    """A seed of 64 bits from keys alone, so that order and partitioning don't matter."""
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def quantised(x: np.ndarray) -> Raster:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def to_rgb(a: np.ndarray) -> Raster:
    """Any raster to 8-bit RGB: grey is repeated, alpha blends on black, 16-bit and float values are rescaled by
    the range they use."""
    a = np.asarray(a)
    if a.dtype == bool:
        a = a.astype(np.uint8) * 255
    elif a.dtype != np.uint8:
        x = a.astype(np.float64)
        lo, hi = float(x.min(initial=0)), float(x.max(initial=0))
        a = quantised((x - lo) * (255 / (hi - lo)) if hi > lo else np.zeros_like(x))
    if a.ndim == 2:
        a = a[:, :, None]
    if a.shape[2] in (2, 4):
        a = quantised(a[:, :, :-1].astype(np.float64) * a[:, :, -1:] / 255)
    return np.ascontiguousarray(np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3])


def luminance(a: Raster) -> np.ndarray:
    return a.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def oriented(a: Raster, orientation: int) -> Raster:
    """By the orientation number that cameras write."""
    steps = {2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.transpose(1, 0, 2), 6: lambda x: x.transpose(1, 0, 2)[:, ::-1], 7: lambda x: x[::-1, ::-1].transpose(1, 0, 2), 8: lambda x: x.transpose(1, 0, 2)[::-1]}
    return np.ascontiguousarray(steps[orientation](a)) if orientation in steps else a


# --- resampling

_SUPPORT = {"box": 0.5, "area": 0.5, "bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}


def _weight(name: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    if name in ("box", "area"):
        return (x <= 0.5).astype(float)
    if name == "bilinear":
        return np.maximum(0, 1 - x)
    if name == "bicubic":  # Keys' kernel with a = -1/2
        return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))
    return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)


def _matrix(n: int, m: int, name: str) -> np.ndarray:
    """m rows that blend n samples; going down, the kernel widens."""
    scale = max(n / m, 1.0)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    w = _weight(name, (np.arange(n)[None, :] - centre[:, None]) / scale)
    return w / w.sum(axis=1, keepdims=True)


def resized(a: np.ndarray, height: int, width: int, name: str = "bicubic") -> np.ndarray:
    """In float; quantise where bytes are wanted."""
    rows, cols = _matrix(a.shape[0], height, name), _matrix(a.shape[1], width, name)
    return np.einsum("ij,jk...->ik...", rows, np.einsum("kj,ij...->ik...", cols, a.astype(np.float64)))


def thumbnail(a: Raster, most: int, name: str = "bicubic") -> Raster:
    h, w = a.shape[:2]
    if max(h, w) <= most:
        return a
    s = most / max(h, w)
    return quantised(resized(a, max(1, round(h * s)), max(1, round(w * s)), name))


# --- degradations

#: The luminance and chrominance tables of the JPEG standard's annex K.
LUMA = np.array([[16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62], [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99]])
CHROMA = np.array([[17, 18, 24, 47, 99, 99, 99, 99], [18, 21, 26, 66, 99, 99, 99, 99], [24, 26, 56, 99, 99, 99, 99, 99], [47, 66, 99, 99, 99, 99, 99, 99], *[[99] * 8] * 4])


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


_D8, _D32 = dct_matrix(8), dct_matrix(32)


def quant_table(base: np.ndarray, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def blocks(x: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8), the edges repeated up to whole blocks."""
    h, w = -(-x.shape[0] // 8) * 8, -(-x.shape[1] // 8) * 8
    x = np.pad(x, ((0, h - x.shape[0]), (0, w - x.shape[1])), mode="edge")
    return x.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)


def coefficients(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.rint(_D8 @ blocks(plane - 128) @ _D8.T / table)


def _plane_back(q: np.ndarray, table: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    x = _D8.T @ (q * table) @ _D8 + 128
    return np.clip(x.transpose(0, 2, 1, 3).reshape(q.shape[0] * 8, q.shape[1] * 8)[: shape[0], : shape[1]], 0, 255)


_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def jpeg_planes(a: Raster, quality: int, subsample: bool = True) -> list[tuple[np.ndarray, np.ndarray, tuple[int, int]]]:
    """Quantised coefficients, tables and sizes of the three planes; chroma by means of 2x2 if subsampled."""
    ycc = a.astype(np.float64) @ _YCC.T + np.array([0, 128, 128])
    out = []
    for k in range(3):
        plane = ycc[:, :, k]
        if k and subsample:
            plane = np.pad(plane, ((0, plane.shape[0] % 2), (0, plane.shape[1] % 2)), mode="edge")
            plane = plane.reshape(plane.shape[0] // 2, 2, plane.shape[1] // 2, 2).mean(axis=(1, 3))
        table = quant_table(CHROMA if k else LUMA, quality)
        out.append((coefficients(plane, table), table, plane.shape))
    return out


def jpeg(a: Raster, quality: int, subsample: bool = True) -> Raster:
    """What JPEG does to pixels; its entropy coding loses nothing, and is left out."""
    planes = []
    for q, table, shape in jpeg_planes(a, int(quality), subsample):
        plane = _plane_back(q, table, shape)
        if plane.shape != a.shape[:2]:
            plane = np.repeat(np.repeat(plane, 2, axis=0), 2, axis=1)[: a.shape[0], : a.shape[1]]
        planes.append(plane)
    ycc = np.stack(planes, axis=2) - np.array([0, 128, 128])
    return quantised(ycc @ np.linalg.inv(_YCC).T)


def blur(a: Raster, sigma: float) -> Raster:
    if sigma <= 0:
        return a
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    x = np.pad(a.astype(np.float64), ((r, r), (r, r), (0, 0)), mode="edge")
    x = np.lib.stride_tricks.sliding_window_view(x, 2 * r + 1, axis=0) @ k
    return quantised(np.lib.stride_tricks.sliding_window_view(x, 2 * r + 1, axis=1) @ k)


def down_up(a: Raster, scale: float) -> Raster:
    h, w = a.shape[:2]
    small = quantised(resized(a, max(1, round(h * scale)), max(1, round(w * scale))))
    return quantised(resized(small, h, w))


def noise(a: Raster, sd: float, rng: np.random.Generator) -> Raster:
    return quantised(np.clip(a / 255 + rng.normal(0, sd, a.shape), 0, 1) * 255) if sd > 0 else a


def jitter(a: Raster, amount: float, rng: np.random.Generator) -> Raster:
    """Brightness, contrast and saturation, in that order, by factors around 1."""
    b, c, s = rng.uniform(1 - amount, 1 + amount, 3)
    x = quantised(a * b).astype(np.float64)
    mean = round(float(luminance(x).mean()))
    x = quantised(mean + (x - mean) * c).astype(np.float64)
    grey = luminance(x)[:, :, None]
    return quantised(grey + (x - grey) * s)


def center_crop(a: Raster, keep: float) -> Raster:
    h, w = a.shape[:2]
    ch, cw = max(1, round(h * keep)), max(1, round(w * keep))
    y, x = (h - ch) // 2, (w - cw) // 2
    return quantised(resized(a[y : y + ch, x : x + cw], h, w))


OPS = {"jpeg": lambda a, s, g: jpeg(a, int(s)), "blur": lambda a, s, g: blur(a, s), "resize": lambda a, s, g: down_up(a, s), "noise": noise, "jitter": jitter, "center_crop": lambda a, s, g: center_crop(a, s), "crop": lambda a, s, g: center_crop(a, s)}


def apply_chain(a: Raster, ops: tuple[tuple[str, float], ...], seed: int) -> Raster:
    """All operations in order, with one generator for all."""
    rng = np.random.default_rng(seed)
    for family, severity in ops:
        a = OPS[family](a, severity, rng)
    return a


def degraded(a: Raster, item: str, cell: str, ops: tuple[tuple[str, float], ...], base_seed: int = 0) -> Raster:
    return apply_chain(a, ops, key_seed(base_seed, item, cell))


# --- augmentation

#: Ranges of severity, the chance of any degradation, and how many families it takes.
RANGES = {"jpeg": (20, 95), "blur": (0.0, 3.0), "resize": (0.2, 1.0), "noise": (0.0, 0.12), "jitter": (0.0, 0.3), "crop": (0.7, 1.0)}
P_APPLY, LEAST_OPS, MOST_OPS = 0.8, 1, 3


def sample_plan(item: str, k: int, base_seed: int = 0, p: float = P_APPLY, least: int = LEAST_OPS, most: int = MOST_OPS) -> tuple[tuple[str, float], ...]:
    """The degradations of an item's k-th copy: none, or distinct families in random order."""
    if not (0 <= p <= 1 and 1 <= least <= most <= len(RANGES)):
        raise ValueError("p must be a probability, and 1 <= least <= most <= families")
    rng = np.random.default_rng(key_seed(base_seed, item, f"randaug{k}"))
    if rng.random() >= p:
        return ()
    names = list(rng.choice(list(RANGES), size=int(rng.integers(least, most + 1)), replace=False))
    plan = []
    for n in names:
        s = rng.uniform(*RANGES[n])
        plan.append((str(n), float(round(s)) if n == "jpeg" else float(s)))
    return tuple(plan)


def plan_vector(plan: tuple[tuple[str, float], ...]) -> list[float]:
    """For each family whether it applies, then each severity from 0 to 1 of its range, 0 where it doesn't."""
    at = dict(plan)
    applied = [float(f in at) for f in RANGES]
    return applied + [(at[f] - lo) / (hi - lo) if f in at else 0.0 for f, (lo, hi) in RANGES.items()]


def augmented(a: Raster, item: str, k: int, base_seed: int = 0) -> tuple[Raster, list[float]]:
    plan = sample_plan(item, k, base_seed)
    return apply_chain(a, plan, key_seed(base_seed, item, f"randaug{k}", "apply")), plan_vector(plan)


def random_resample(a: Raster, item: str, size: int, base_seed: int = 0) -> tuple[Raster, dict]:
    """A random square crop resized by a random filter, with what was drawn; for training only."""
    rng = np.random.default_rng(key_seed(base_seed, item, "resample"))
    name = str(rng.choice(["bilinear", "bicubic", "lanczos", "area"]))
    h, w = a.shape[:2]
    side = int(rng.integers(max(1, min(h, w) // 2), min(h, w) + 1))
    y, x = int(rng.integers(h - side + 1)), int(rng.integers(w - side + 1))
    return quantised(resized(a[y : y + side, x : x + side], size, size, name)), {"filter": name, "side": side, "x": x, "y": y}


def normalised(a: Raster, item: str, synthetic: bool, qualities: list[int], *, size: int = 512, step: int = 16, quality: int = 95, base_seed: int = 0) -> tuple[Raster | None, dict]:
    """The canonical form: for synthetic items a first JPEG generation, drawn from what real ones have, then a random
    crop on a grid, then JPEG. Too small ones have none."""
    h, w = a.shape[:2]
    if min(h, w) < size:
        return None, {"status": "too_small"}
    rng = np.random.default_rng(key_seed(base_seed, item))
    first = int(qualities[int(rng.integers(len(qualities)))]) if synthetic and qualities else 0
    if first:
        a = jpeg(a, first)
    y, x = (int(rng.integers(n - size + 1)) // step * step for n in (h, w))
    return jpeg(a[y : y + size, x : x + size], quality), {"status": "ok", "crop_x": x, "crop_y": y, "first_gen_quality": first}


# --- hashes and features


def phash(a: Raster) -> int:
    """64 bits, signed: which of the 8x8 lowest frequencies are over the median of all but the first."""
    low = (_D32 @ np.rint(resized(luminance(a), 32, 32, "lanczos")) @ _D32.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    out = int("".join("1" if b else "0" for b in bits), 2)
    return out - (1 << 64) if out >= 1 << 63 else out


RINGS = 12
FREQUENCY_NAMES = [*(f"fft_ring_{i}" for i in range(RINGS)), "fft_hf_ratio", "fft_ring_peakiness", "dct_low", "dct_mid", "dct_high", "hf_energy", "flat_frac"]
#: What each feature is divided by.
FREQUENCY_SCALE = np.array([8.0] * RINGS + [0.3, 3.0, 15.0, 4.0, 2.0, 12.0, 1.0])
_SIDE = 256
_radius = np.hypot(*(np.mgrid[:_SIDE, :_SIDE] - _SIDE / 2))
_edges = np.linspace(0, _SIDE / 2, RINGS + 2)
_ring = np.where(_radius < _edges[-1], np.searchsorted(_edges, _radius, side="right") - 2, -1)
_outer = _radius >= _edges[-2]
_band = np.add.outer(np.arange(8), np.arange(8))


def gradients(grey: np.ndarray) -> tuple[float, float]:
    """Mean of absolute differences, and the share of flat steps along rows."""
    across, down = np.abs(np.diff(grey, axis=1)), np.abs(np.diff(grey, axis=0))
    mean = lambda x: float(x.mean()) if x.size else 0.0
    return mean(across) + mean(down), float((across < 1).mean()) if across.size else 1.0


def frequency_features(a: Raster) -> np.ndarray:
    """19 numbers, each over its scale: Fourier rings without the innermost, block frequencies, gradients."""
    grey = resized(luminance(a), _SIDE, _SIDE, "bicubic")
    mag = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(grey))))
    ok = _ring >= 0
    rings = np.bincount(_ring[ok], mag[ok], RINGS) / np.maximum(np.bincount(_ring[ok], minlength=RINGS), 1)
    ratio = mag[_outer].sum() / max(mag.sum(), 1e-12)
    d = np.abs(_D8 @ blocks(grey) @ _D8.T)
    bands = [float(d[..., m].mean()) for m in ((_band > 0) & (_band <= 4), (_band > 4) & (_band <= 9), _band > 9)]
    peak = (rings.max() - rings.mean()) / rings.std() if rings.std() > 1e-6 else 0.0
    return np.array([*rings, ratio, peak, *bands, *gradients(grey)]) / FREQUENCY_SCALE


def content_features(a: Raster) -> dict[str, float]:
    """Evidence of drawings and screens against photographs."""
    x = thumbnail(a, 512, "bilinear")
    flat = x.reshape(-1, 3).astype(np.float64)
    hi, lo = flat.max(axis=1), flat.min(axis=1)
    energy, still = gradients(x.astype(np.float64).mean(axis=2))
    return {
        "aspect": x.shape[1] / max(x.shape[0], 1),
        "uniq_colors_k": len(np.unique(x.reshape(-1, 3) // 8, axis=0)) / 1000,
        "hf_energy": energy,
        "flat_frac": still,
        "pure_bw_frac": float(((hi < 4) | (lo > 251)).mean()),
        "sat_mean": float(np.where(hi > 0, (hi - lo) / np.maximum(hi, 1), 0).mean()),
    }


UNIQUE, DOMINANT, GUARD_SIDE = 0.06, 0.35, 256


def domain_guard(a: Raster) -> tuple[float, float, bool]:
    """(share of distinct colours, share of the most frequent, unlike a photograph), at five bits a channel."""
    x = thumbnail(a, GUARD_SIDE).reshape(-1, 3).astype(np.int64) >> 3
    n = np.unique(x[:, 0] << 10 | x[:, 1] << 5 | x[:, 2], return_counts=True)[1]
    unique, most = len(n) / len(x), float(n.max() / len(x))
    return unique, most, bool(unique < UNIQUE or most > DOMINANT)


def constant_rows(a: Raster) -> float:
    """The share of rows of one colour, over some 256 rows: what a decoder pads truncated files with."""
    rows = a[:: max(1, a.shape[0] // 256)]
    return float((rows == rows[:, :1]).all(axis=(1, 2)).mean()) if len(rows) else 0.0


def ela(a: Raster, quality: int = 85) -> tuple[np.ndarray, Raster]:
    """(mean difference to its JPEG, heat map from black over purple and red to yellow, scaled by the 99th percentile)."""
    diff = np.abs(a.astype(np.float64) - jpeg(a, quality)).mean(axis=2)
    top = max(float(np.percentile(diff, 99)), 1.0)
    t = np.clip(diff / top * 204, 0, 255) / 255
    stops, colours = [0, 0.33, 0.66, 1.0], np.array([[0, 0, 0], [120, 0, 120], [255, 0, 0], [255, 255, 0]])
    return diff, np.stack([np.interp(t, stops, colours[:, c]) for c in range(3)], axis=2).astype(np.uint8)


# --- scorers without a model


def random_score(a: Raster, seed: int = 0) -> float:
    """Uniform in [0, 1), by a generator that the pixels seed."""
    pixels = hashlib.sha256(np.ascontiguousarray(a)).hexdigest()
    return float(np.random.default_rng(key_seed("score", seed, a.shape, pixels)).random())


def brightness_score(a: Raster) -> float:
    return float(luminance(a).mean() / 255)


def synthetic_raster(index: int, side: int = 64, lift: float = 0.0) -> Raster:
    """A smooth texture by its index alone; lift plants brightness."""
    rng = np.random.default_rng(key_seed("texture", index))
    x = sum(resized(rng.uniform(0, 255, (n, n, 3)), side, side) / (k + 1) for k, n in enumerate((4, 8, 16)))
    return quantised(x / 1.9 + lift)
