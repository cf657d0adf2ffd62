"""Peak detection on dense images: Arrow kernels run by mapInPandas, one image a row.

A detector is a set of parameters over the same steps: radial background, top-hat, band
thresholds, components of hot pixels, shape rules, suppression, the best k. The window
forms in image.py give the same filters for sparse images.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import MAD_SIGMA

PEAKS = "gi bigint, label string, x double, y double, snr double, npix int, compactness double, peak_val double, integrated double"


@dataclass(frozen=True)
class Detector:
    """Parameters of a detector; images are rows of pixels of the given shape."""

    height: int
    width: int
    smooth: int = 15
    hats: tuple[int, ...] = (15,)
    tolerance: float = 0.4
    k_sigma: float = 4.0
    min_pixels: int = 3
    max_pixels: int = 150
    min_compactness: float = 0.12
    edge: int = 3
    separation: float = 15.0
    most: int = 25
    clip_rounds: int = 0
    blob_sigmas: tuple[float, ...] = ()
    blob_threshold: float = 5.0


#: Named detectors by the parameters that tell them apart, as fixed values.
VARIANTS = {
    "band_adaptive": {},
    "dual_snr": {"smooth": 5, "hats": (11,), "tolerance": 0.35, "k_sigma": 7.0, "edge": 5},
    "multiscale": {"hats": (7, 11, 15), "tolerance": 0.35, "k_sigma": 5.8, "min_pixels": 4, "max_pixels": 200, "separation": 8.0, "clip_rounds": 2},
    "blob_hybrid": {"hats": (15,), "tolerance": 0.35, "k_sigma": 3.5, "blob_sigmas": (2.0, 4.0, 7.0), "most": 40},
    "tight_bands": {"hats": (9, 15, 21), "tolerance": 0.30, "k_sigma": 4.8, "min_pixels": 2, "max_pixels": 200, "min_compactness": 0.08, "separation": 12.0, "most": 50, "clip_rounds": 3},
}


def running(a: np.ndarray, size: int, axis: int, fn) -> np.ndarray:
    """Moving minimum, maximum or mean of odd size along an axis, the border mirrored.

    Minima and maxima of a window are those of two overlapping windows of a power of two,
    each found by doubling; means are differences of a running sum.
    """
    pad = [(size // 2, size // 2) if i == axis else (0, 0) for i in range(a.ndim)]
    rows = np.moveaxis(np.pad(a, pad, mode="symmetric"), axis, 0)
    n = len(rows) - size + 1
    if fn is np.mean:
        total = np.concatenate([np.zeros((1, *rows.shape[1:])), np.cumsum(rows, axis=0, dtype=float)])
        return np.moveaxis((total[size:] - total[:-size]) / size, 0, axis)
    pick, width = (np.minimum if fn is np.min else np.maximum), 1
    while 2 * width <= size:
        rows, width = pick(rows[:-width], rows[width:]), 2 * width
    return np.moveaxis(pick(rows[:n], rows[size - width : size - width + n]), 0, axis)


def top_hat(image: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    out = np.full(image.shape, -np.inf)
    for s in sizes:
        low = running(running(image, s, 0, np.min), s, 1, np.min)
        out = np.maximum(out, image - running(running(low, s, 0, np.max), s, 1, np.max))
    return out


def smoothed(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """A separable convolution along both axes, the border mirrored."""
    half = len(kernel) // 2
    for axis in (0, 1):
        pad = [(half, half) if i == axis else (0, 0) for i in (0, 1)]
        view = np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="symmetric"), len(kernel), axis=axis)
        image = view @ kernel
    return image


def blob_response(image: np.ndarray, sigmas: tuple[float, ...] = (2.0, 4.0, 7.0)) -> np.ndarray:
    """Largest scale-normalised negative Laplacian of Gaussian over sigmas, in units of its own robust noise."""
    best = np.full(image.shape, -np.inf)
    for s in sigmas:
        t = np.arange(-int(4 * s + 0.5), int(4 * s + 0.5) + 1)
        g = np.exp(-0.5 * (t / s) ** 2)
        soft = np.pad(smoothed(image, g / g.sum()), 1, mode="symmetric")
        response = -(s**2) * (soft[2:, 1:-1] + soft[:-2, 1:-1] + soft[1:-1, 2:] + soft[1:-1, :-2] - 4 * soft[1:-1, 1:-1])
        level, sigma = threshold(response.ravel(), 3.0, 0)
        best = np.maximum(best, (response - level) / max(sigma, 1e-12))
    return best


def profile_peaks(profile: np.ndarray, share: float = 0.03, apart: int = 3, most: int = 20) -> list[int]:
    """Places of local maxima whose prominence is a share of the range, the highest first and not closer than apart."""
    v = np.asarray(profile, dtype=float)
    span = float(np.ptp(v)) if len(v) else 0.0
    found = []
    for k in np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] >= v[2:])) + 1:
        sides = []
        for side in (v[:k][::-1], v[k + 1 :]):
            higher = np.flatnonzero(side > v[k])
            sides.append(side[: higher[0] if len(higher) else len(side)].min(initial=v[k]))
        if span and v[k] - max(sides) >= share * span:
            found.append(int(k))
    kept: list[int] = []
    for k in sorted(found, key=lambda k: (-v[k], k)):
        if all(abs(k - q) >= apart for q in kept):
            kept.append(k)
    return kept[:most]


def radial_background(image: np.ndarray, ring: np.ndarray, smooth: int) -> np.ndarray:
    """Median of each ring, smoothed over rings, laid back on the image."""
    order = np.argsort(ring, axis=None, kind="stable")
    cuts = np.flatnonzero(np.diff(ring.ravel()[order])) + 1
    medians = np.array([np.median(part) for part in np.split(image.ravel()[order], cuts)])
    size = min(smooth, len(medians)) | 1
    if size <= len(medians):
        medians = running(medians, size, 0, np.mean)
    names = ring.ravel()[order][np.concatenate([[0], cuts])]
    return medians[np.searchsorted(names, ring)]


def threshold(values: np.ndarray, k: float, rounds: int) -> tuple[float, float]:
    """Robust level and sigma, clipped at k sigma for rounds."""
    for step in range(rounds + 1):
        level = float(np.median(values))
        mad = float(np.median(np.abs(values - level)))
        sigma = MAD_SIGMA * mad if mad > 0 else float(values.std())
        if step < rounds and sigma > 0:
            values = values[np.abs(values - level) <= k * sigma]
    return level, sigma


def label_components(mask: np.ndarray) -> np.ndarray:
    """Component numbers from 1 of the 4-connected true pixels, 0 elsewhere."""
    out = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        best = out.copy()
        for axis in (0, 1):
            a, b = (best[:-1], best[1:]) if axis == 0 else (best[:, :-1], best[:, 1:])
            both = (a > 0) & (b > 0)
            top = np.where(both, np.maximum(a, b), 0)
            for side in (a, b):
                np.maximum(side, top, out=side)
        if (best == out).all():
            return np.unique(out, return_inverse=True)[1].reshape(mask.shape) + (0 if (out == 0).any() else 1)
        out = best


def sparse_components(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Component numbers from 0 of pixels given by their places in reading order; side neighbours connect."""
    n = len(y)
    if not n:
        return np.zeros(0, dtype=np.int64)
    at = y.astype(np.int64) * (int(x.max()) + 2) + x
    pairs = []
    for step in (1, int(x.max()) + 2):
        to = np.searchsorted(at, at + step)
        hit = np.flatnonzero((to < n) & (at[np.minimum(to, n - 1)] == at + step))
        pairs.append((hit, to[hit]))
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    root = np.arange(n)
    while True:  # hang the larger root under the smaller, then point every pixel at its root
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return np.unique(root, return_inverse=True)[1]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def find_peaks(image: np.ndarray, tth: np.ndarray, ring: np.ndarray, bands: list[tuple[str, float]], d: Detector) -> list[tuple]:
    """(label, x, y, snr, npix, compactness, peak_val, integrated) of one image, strongest first."""
    hat = top_hat(image - radial_background(image, ring, d.smooth), d.hats)
    blobs = blob_response(image, d.blob_sigmas) if d.blob_sigmas else None
    inside = np.zeros(image.shape, bool)
    inside[d.edge : d.height - d.edge, d.edge : d.width - d.edge] = True
    found = []
    for name, centre in bands:
        band = np.abs(tth - centre) <= d.tolerance
        if not band.any():
            continue
        level, sigma = threshold(hat[band], d.k_sigma, d.clip_rounds)
        if sigma <= 0:
            continue
        hot = hat > level + d.k_sigma * sigma
        if blobs is not None:  # a weaker top-hat counts where the blob filter agrees
            hot |= (hat > level + 0.6 * d.k_sigma * sigma) & (blobs > d.blob_threshold)
        ys, xs = np.nonzero(band & inside & hot)
        part = sparse_components(ys, xs)
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=1)
        ends = np.cumsum(sizes)
        for k in np.flatnonzero((sizes >= d.min_pixels) & (sizes <= d.max_pixels)).tolist():
            mine = order[ends[k] - sizes[k] : ends[k]]
            y, x = ys[mine], xs[mine]
            h, w = np.ptp(y) + 1, np.ptp(x) + 1
            compact = min(h, w) / max(h, w) * len(y) / (h * w)
            if compact < d.min_compactness:
                continue
            v = hat[y, x]
            weight = v if v.sum() > 0 else np.ones(len(v))
            found.append((name, float((x * weight).sum() / weight.sum()), float((y * weight).sum() / weight.sum()), float((v.max() - level) / sigma), len(y), float(compact), float(image[y, x].max()), float(v.sum())))
    found.sort(key=lambda p: -p[3])
    kept: list[tuple] = []
    for p in found:
        if all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 >= d.separation**2 for q in kept):
            kept.append(p)
    return kept[: d.most]


def detect(images: DataFrame, tth: np.ndarray, bands: list[tuple[str, float]], detector: Detector, ring_width: float = 0.5) -> DataFrame:
    """Peaks of every image row (gi, pixels). tth, one angle a pixel, and bands go out with the code."""
    ring = np.floor(tth / ring_width).astype(int)

    def run(frames):
        for pdf in frames:
            rows = []
            for gi, flat in zip(pdf.gi, pdf.pixels, strict=True):
                image = np.asarray(flat, dtype=float).reshape(detector.height, detector.width)
                rows += [(gi, *p) for p in find_peaks(image, tth, ring, bands, detector)]
            yield pd.DataFrame(rows, columns=["gi", "label", "x", "y", "snr", "npix", "compactness", "peak_val", "integrated"])

    return images.select("gi", "pixels").mapInPandas(run, PEAKS)


def bin_images(images: DataFrame, bins: DataFrame, keys: list[str], blocks: int = 32) -> DataFrame:
    """Element-wise sums of dense frames by bin, in two levels so that a bin's frames meet as partial sums."""
    joined = images.join(bins, "gi").withColumn("_part", F.pmod(F.xxhash64("gi"), F.lit(blocks)))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf.pixels.to_numpy()), axis=0)
        return pdf.iloc[:1].drop(columns="pixels").assign(pixels=[total.tolist()], n=pdf["n"].sum())

    fields = ", ".join(f"{n} {t}" for n, t in joined.select(*keys).dtypes)
    rows = joined.select(*keys, "_part", F.col("pixels").cast("array<double>").alias("pixels"), F.lit(1).cast("bigint").alias("n"))
    level = rows.groupBy(*keys, "_part").applyInPandas(add, f"{fields}, _part bigint, n bigint, pixels array<double>")
    return level.drop("_part").select(*keys, "pixels", "n").groupBy(*keys).applyInPandas(add, f"{fields}, n bigint, pixels array<double>")
