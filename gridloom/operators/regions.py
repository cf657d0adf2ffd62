"""Regions of hot pixels on frames of any size, and detectors built from table steps.

Pixels are rows (gi, y, x, v). Components are labelled tile by tile and tiles meet along
their edges only, so a frame is never whole in one task: within a tile numpy labels the
hot pixels, pixels that touch across an edge become edges between tile regions, and
connected components of those name every region by its first pixel in reading order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import MAD_SIGMA
from gridloom.operators import image, spatial
from gridloom.operators.detect import sparse_components
from gridloom.operators.graph import connected_components
from gridloom.session import cut

TILE = 256
#: Parts that tiles and bands are dealt to; thousands of small ones cost a call each otherwise.
BUCKETS = 128
REGION = ["gi", "root_y", "root_x"]


def pixel_components(hot: DataFrame, tile: int = TILE) -> DataFrame:
    """hot (gi, y, x, ...) with root_y and root_x, the first pixel of each pixel's 4-connected region."""
    places = hot.select("gi", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")).distinct()
    tiled = places.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=pdf.groupby(["gi", "ty", "tx"], sort=False, dropna=False).ngroup()).sort_values(["n", "y", "x"], ignore_index=True)
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        # tiles lie below each other with an empty row between them
        part = sparse_components(pdf.n.to_numpy() * (tile + 1) + y - pdf.ty.to_numpy() * tile, x - pdf.tx.to_numpy() * tile)
        first = np.unique(part, return_index=True)[1][part]
        return pdf.assign(ry=y[first], rx=x[first])[["gi", "y", "x", "ry", "rx"]]

    gi = dict(hot.dtypes)["gi"]
    dealt = tiled.withColumn("_bucket", F.pmod(F.xxhash64("gi", "ty", "tx"), F.lit(BUCKETS))).groupBy("_bucket")
    own = cut(dealt.applyInPandas(label, f"gi {gi}, y bigint, x bigint, ry bigint, rx bigint"))
    node = lambda p="": F.struct(F.col("gi"), F.col(f"{p}ry").alias("y"), F.col(f"{p}rx").alias("x"))
    over = own.select("gi", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("ry").alias("o_ry"), F.col("rx").alias("o_rx"))
    right = own.filter(F.pmod("x", F.lit(tile)) == tile - 1).withColumns({"ny": F.col("y"), "nx": F.col("x") + 1})
    below = own.filter(F.pmod("y", F.lit(tile)) == tile - 1).withColumns({"ny": F.col("y") + 1, "nx": F.col("x")})
    edges = right.unionByName(below).join(over, ["gi", "ny", "nx"]).select(node().alias("src"), node("o_").alias("dst")).distinct()
    merged = connected_components(edges).select(F.col("node.gi").alias("gi"), F.col("node.y").alias("ry"), F.col("node.x").alias("rx"), F.col("component.y").alias("my"), F.col("component.x").alias("mx"))
    named = own.join(merged, ["gi", "ry", "rx"], "left").select("gi", "y", "x", F.coalesce("my", "ry").alias("root_y"), F.coalesce("mx", "rx").alias("root_x"))
    return hot.join(named, ["gi", "y", "x"])


def region_stats(pixels: DataFrame, strength: str, light: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """npix, bounding box, compactness, aspect, fill, light-weighted centre (plain without light), strongest and brightest pixel."""
    w = F.greatest(F.col(light), F.lit(0.0))
    centre = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * w), F.sum(w)), F.avg(c))
    out = pixels.groupBy(*REGION, *keys).agg(
        F.count("*").alias("npix"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        centre("x").alias("cx"), centre("y").alias("cy"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.max(strength).alias("strength"), F.max(light).alias("peak"),
    )
    h, wd = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    fill = F.col("npix") / (h * wd)
    return out.withColumns({"aspect": F.greatest(h, wd) / F.least(h, wd), "fill": fill, "compactness": F.least(h, wd) / F.greatest(h, wd) * fill})


def well_formed(stats: DataFrame, least: int, most: int, aspect: tuple[float, int] | None = (6.0, 15), fill: tuple[float, int] | None = None) -> DataFrame:
    """Regions of least to most pixels, without those over aspect or under fill that have more pixels than its second number."""
    keep = F.col("npix").between(least, most)
    if aspect:
        keep &= ~((F.col("aspect") > aspect[0]) & (F.col("npix") > aspect[1]))
    if fill:
        keep &= ~((F.col("fill") < fill[0]) & (F.col("npix") > fill[1]))
    return stats.filter(keep)


def ringed(pixels: DataFrame, low: float, width: float) -> DataFrame:
    """pixels with ring: steps of width from the angle low on."""
    return pixels.withColumn("ring", F.greatest(F.lit(0), F.floor((F.col("tth") - low) / width)).cast("bigint"))


def _smooth(values: DataFrame, half: int) -> DataFrame:
    """gi, ring, mean over all rings from 0 to the frame's last, empty rings 0, smoothed over rings."""
    last = values.groupBy("gi").agg(F.max("ring").alias("_last"))
    rings = last.select("gi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("ring"))
    return image.smooth_profile(rings.join(values, ["gi", "ring"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0))), half)


def less_ring_median(pixels: DataFrame, low: float, width: float, half: int) -> DataFrame:
    """pixels with ring, and v less the smoothed median of its ring."""
    rows = ringed(pixels, low, width)
    medians = _smooth(rows.groupBy("gi", "ring").agg(F.median("v").alias("mean")), half)
    return rows.join(medians, ["gi", "ring"]).withColumn("v", F.col("v") - F.col("mean")).drop("mean")


def ring_noise(pixels: DataFrame, half: int, floor: float = 0.01) -> DataFrame:
    """gi, ring, noise: the median deviation from the median of each ring, smoothed over rings, at least floor."""
    middle = pixels.groupBy("gi", "ring").agg(F.median("v").alias("_m"))
    spread = pixels.join(middle, ["gi", "ring"]).groupBy("gi", "ring").agg(F.median(F.abs(F.col("v") - F.col("_m"))).alias("mean"))
    return _smooth(spread, half).select("gi", "ring", F.greatest("mean", F.lit(floor)).alias("noise"))


def annular_snr(points: DataFrame, pixels: DataFrame, inner: float, outer: float, least: int = 10, floor: float = 0.01) -> DataFrame:
    """gi, py, px, snr: how far the pixel at each point stands out of the ring of pixels inner to outer away.

    The ring's median and 1.4826 median deviations, at least floor, are the scale; 0 with
    under least pixels in the ring. Points (gi, py, px) meet pixels (gi, y, x, v) by place.
    """
    far = int(outer)
    offsets = [(a, b) for a in range(-far, far + 1) for b in range(-far, far + 1) if inner**2 <= a * a + b * b <= outer**2]
    # pixels are dealt to tiles with a rim as wide as the ring, so the ring's values never travel
    rim = lambda c: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - far) / TILE), F.floor((F.col(c) + far) / TILE))))
    bucket = lambda gi: F.pmod(F.xxhash64(gi, "_ty", "_tx"), F.lit(BUCKETS)).alias("_bucket")
    held = pixels.select(F.col("gi").alias("_gi"), F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("v").cast("double").alias("v"))
    held = held.withColumn("_ty", rim("y")).withColumn("_tx", rim("x")).select("*", bucket("_gi"))
    own = points.select("gi", F.col("py").cast("bigint").alias("py"), F.col("px").cast("bigint").alias("px")).distinct()
    own = own.withColumns({"_ty": F.floor(F.col("py") / TILE), "_tx": F.floor(F.col("px") / TILE)}).select("*", bucket("gi"))
    side = TILE + 2 * far + 2

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"gi": [], "py": [], "px": [], "snr": []})
        b = b.rename(columns={"_gi": "gi"})
        tile = pd.concat([a[["gi", "_ty", "_tx"]], b[["gi", "_ty", "_tx"]]]).groupby(["gi", "_ty", "_tx"], sort=False).ngroup().to_numpy()
        place = lambda p, n, y, x: (n * side + p[y].to_numpy() - p["_ty"].to_numpy() * TILE + far) * side + p["_tx"].to_numpy() * -TILE + p[x].to_numpy() + far
        seek, code = place(a, tile[: len(a)], "py", "px"), place(b, tile[len(a) :], "y", "x")
        order = np.argsort(code, kind="stable")
        code, v = code[order], b["v"].to_numpy(dtype=float)[order]
        steps = np.array([i * side + j for i, j in offsets], dtype=np.int64)

        def look(want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(code, want), len(code) - 1)
            hit = code[at] == want
            return hit, np.where(hit, v[at], np.nan)

        out = np.zeros(len(a))
        there, value = look(seek)
        for m in range(0, len(a), step := max(1, 1_000_000 // len(steps))):
            hit, ring = look(seek[m : m + step, None] + steps)
            n = hit.sum(axis=1)
            row, low, high = np.arange(len(n)), np.maximum((n + 1) // 2 - 1, 0), np.minimum(n // 2, len(steps) - 1)
            middle = lambda s, row=row, low=low, high=high: (s[row, low] + s[row, high]) / 2
            m0 = middle(np.sort(ring, axis=1))
            scale = np.fmax(MAD_SIGMA * middle(np.sort(np.abs(ring - m0[:, None]), axis=1)), floor)
            out[m : m + step] = np.where(n >= least, (value[m : m + step] - m0) / scale, 0.0)
        return a[["gi", "py", "px"]].assign(snr=out)[there]

    found = own.groupBy("_bucket").cogroup(held.groupBy("_bucket")).applyInPandas(run, f"gi {dict(points.dtypes)['gi']}, py bigint, px bigint, snr double")
    return found.withColumn("snr", F.coalesce("snr", F.lit(0.0)))


def band_levels(pixels: DataFrame, keys: list[str], k: float = 5.0, rounds: int = 3, least: int = 100, fewest: int = 50) -> DataFrame:
    """keys, level and sigma of the values that lie under level + k sigma, found again rounds times.

    Groups of under least values, or without spread, are out; clipping stops where under
    fewest values would stay. A group is a band of one frame, which bounds it.
    """
    kinds = dict(pixels.dtypes)

    def one(key: tuple, v: np.ndarray) -> list[tuple]:
        scale = lambda: (m := float(np.median(v)), MAD_SIGMA * d if (d := float(np.median(np.abs(v - m)))) > 0 else float(v.std()))
        level = sigma = 0.0
        if len(v) >= least:
            for _ in range(rounds):
                level, sigma = scale()
                under = v < level + k * sigma
                if sigma <= 0 or under.sum() < fewest:
                    break
                v = v[under]
            level, sigma = scale()
        return [(*key, level, sigma)] if sigma > 0 else []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [row for key, v in pdf.groupby(keys, sort=False, dropna=False)["v"] for row in one(key, v.to_numpy(dtype=float))]
        return pd.DataFrame(rows, columns=[*keys, "level", "sigma"])

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    return pixels.select(*keys, "v", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")).groupBy("_bucket").applyInPandas(run, f"{fields}, level double, sigma double")


def _labelled(stats: DataFrame, pixels: DataFrame, labels: DataFrame, most: float | None) -> DataFrame:
    """stats (gi, x, y) with the nearest label of the angle at their place, `unknown` beyond most."""
    tth = pixels.select("gi", "y", "x", "tth")
    return spatial.nearest_label(stats.join(tth, ["gi", "y", "x"], "left"), labels, most).withColumnRenamed("nearest", "label")


def percentile_peaks(pixels: DataFrame, labels: DataFrame, height: int, width: int, share: float = 0.97, least: int = 3, edge: int = 2, tile: int = TILE) -> DataFrame:
    """gi, x, y, npix, label: regions at or above a percentile of their frame, at their plain centres cut to whole pixels."""
    level = pixels.groupBy("gi").agg(F.percentile("v", share).alias("_t"))
    hot = image.drop_edge(pixels.join(level, "gi").filter(F.col("v") >= F.col("_t")), edge, height, width)
    stats = region_stats(pixel_components(hot.select("gi", "y", "x", "v"), tile), "v").filter(F.col("npix") >= least)
    rows = stats.select("gi", F.col("mean_x").cast("bigint").alias("x"), F.col("mean_y").cast("bigint").alias("y"), "npix", *REGION[1:])
    return _labelled(rows, pixels, labels, None).select("gi", "x", "y", "npix", "label")


def dual_snr_pixels(pixels: DataFrame, bands: DataFrame, height: int, width: int, low: float, ring: float = 0.05, hat: int = 11, window: int = 41, tolerance: float = 0.35, annular: float = 7.0, local: float = 3.5, floor: float = 2.5, dark: float = 0.5, edge: int = 5, half: int = 2) -> DataFrame:
    """gi, y, x, v, snr: pixels that stand out of their ring's noise and of their neighbourhood, over the frame's floor.

    v is less the smoothed ring median, snr is the top-hat over the ring's noise. Pixels at the
    frame's edge, near dark rows or outside all bands are out.
    """
    clean = cut(less_ring_median(pixels, low, ring, half))
    frame = image.robust_threshold(clean, ["gi"], floor).select("gi", "threshold")
    noise = ring_noise(clean, half)
    hats = image.top_hat(clean, hat, floor=True).join(noise, ["gi", "ring"]).withColumn("snr_ring", F.col("hat") / F.col("noise"))
    near = image.local_snr(clean.select("gi", "y", "x", "v"), window // 2, height, width).select("gi", "y", "x", "snr")
    lit = hats.filter(F.col("snr_ring") >= annular).join(near.filter(F.col("snr") >= local).select("gi", "y", "x"), ["gi", "y", "x"])
    lit = lit.join(frame, "gi").filter(F.col("v") >= F.col("threshold"))
    open_rows = image.without_gaps(pixels.select("gi", "y", "x", "v"), dark, hat + 2).select("gi", "y", "x")
    lit = image.in_any_band(image.drop_edge(lit, edge, height, width), bands, tolerance).join(open_rows, ["gi", "y", "x"], "left_semi")
    return lit.select("gi", "y", "x", "v", F.col("snr_ring").alias("snr"))


def _apart(rows: DataFrame, distance: float, xy: tuple[str, str] = ("cx", "cy")) -> DataFrame:
    """The strongest regions of each frame, none nearer to a kept one than distance; adds rank."""
    order = Window.partitionBy("gi").orderBy(F.desc("strength"), "root_y", "root_x")
    ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("x", F.col(xy[0])).withColumn("y", F.col(xy[1]))
    return spatial.suppress(cut(ranked), distance, ("gi",))


def dual_snr_peaks(pixels: DataFrame, bands: DataFrame, height: int, width: int, low: float, least: int = 3, most: int = 150, separation: float = 15.0, tolerance: float = 0.35, fill: tuple[float, int] | None = None, tile: int = TILE, **rules) -> DataFrame:
    """gi, x, y, label, snr, npix: regions of dual_snr_pixels that are well formed, kept apart, in a band."""
    hot = cut(dual_snr_pixels(pixels, bands, height, width, low, tolerance=tolerance, **rules))
    good = well_formed(region_stats(pixel_components(hot, tile), "snr"), least, most, (6.0, 15), fill)
    kept = _apart(good, separation)
    whole = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(c))).cast("bigint")
    rows = kept.select("gi", whole("cx", width).alias("x"), whole("cy", height).alias("y"), F.col("strength").alias("snr"), "npix")
    return _labelled(rows, pixels, bands, tolerance).filter("label <> 'unknown'").select("gi", "x", "y", "label", "snr", "npix")


def tight_band_peaks(
    pixels: DataFrame, bands: DataFrame, height: int, width: int, low: float, ring: float = 0.05, half: int = 7, hats: tuple[int, ...] = (9, 15, 21), tolerance: float = 0.30, k: float = 4.8, rescue_k: float = 99.0,
    rescue_snr: float = 99.0, rescue_ring: tuple[float, float] = (4, 15), least: int = 2, most: int = 200, compactness: float = 0.08, faintest: float = 6.0, empty: float = 5.0, edge: int = 5, separation: float = 12.0, top: int = 50, least_band: int = 100, fewest: int = 50, tile: int = TILE,
) -> DataFrame:
    """gi, x, y, label, snr, npix, rescued: strong regions of each band, and weaker ones that stand out of the ring around them.

    Frames without a pixel of at least empty are out. A region needs a top-hat of faintest; over
    rescue_k, but not over k, sigmas it is kept where its strongest pixel has an annular SNR of rescue_snr.
    """
    full = pixels.join(pixels.groupBy("gi").agg(F.max("v").alias("_top")).filter(F.col("_top") >= empty).select("gi"), "gi", "left_semi")
    clean = cut(image.multiscale_top_hat(less_ring_median(full, low, ring, half), hats))
    inside = image.drop_edge(clean, edge, height, width)
    banded = cut(image.band_mask(inside.select("gi", "y", "x", "tth", "v", "hat"), bands, tolerance))
    levels = band_levels(banded.select("gi", "band", F.col("hat").alias("v")), ["gi", "band"], least=least_band, fewest=fewest)
    over = banded.join(levels, ["gi", "band"]).withColumn("strength", (F.col("hat") - F.col("level")) / F.col("sigma"))
    hot = cut(over.filter(F.col("strength") > min(k, rescue_k)))
    # bands may overlap, and regions are sought in each alone: a frame's band counts as a frame of its own
    place = F.struct("gi", "band")
    parts = pixel_components(hot.withColumn("frame", F.col("gi")).withColumn("gi", F.to_json(place)).select("gi", "frame", "band", "y", "x", "v", "hat", "strength"), tile)
    stats = region_stats(parts, "strength", "v", ("frame", "band"))
    best = parts.groupBy(*REGION).agg(F.max("hat").alias("hat"), F.max_by(F.struct("y", "x"), F.struct("hat", -F.col("y"), -F.col("x"))).alias("_at"))
    good = cut(stats.join(best, REGION).filter(F.col("npix").between(least, most) & (F.col("compactness") >= compactness) & (F.col("hat") >= faintest)).drop("gi").withColumnRenamed("frame", "gi"))
    weak = good.filter(F.col("strength") <= k).select("gi", F.col("_at.y").alias("py"), F.col("_at.x").alias("px"))
    rescue = annular_snr(weak, clean.select("gi", "y", "x", F.col("hat").alias("v")), *rescue_ring).filter(F.col("snr") >= rescue_snr)
    rescued = good.filter(F.col("strength") <= k).join(rescue.select("gi", F.struct(F.col("py").alias("y"), F.col("px").alias("x")).alias("_at")), ["gi", "_at"], "left_semi")
    both = good.filter(F.col("strength") > k).withColumn("rescued", F.lit(False)).unionByName(rescued.select(*good.columns).withColumn("rescued", F.lit(True)))
    whole = both.withColumn("cx", F.rint("cx")).withColumn("cy", F.rint("cy"))
    kept = _apart(whole, separation)
    place = F.row_number().over(Window.partitionBy("gi").orderBy("rank"))
    first = kept.withColumn("_n", place).filter(F.col("_n") <= top)
    return first.select("gi", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), F.col("band").alias("label"), F.col("strength").alias("snr"), "npix", "rescued")
