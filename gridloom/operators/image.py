"""Image operators on pixel rows (gi, y, x, v): bands, backgrounds, thresholds and filters.

The window forms below suit sparse or small images; dense detector frames go through the
Arrow kernels of detect.py, which compute the same filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import MAD_SIGMA


def band_mask(pixels: DataFrame, bands: DataFrame, tolerance: float) -> DataFrame:
    """Pixels within tolerance of a band's two_theta, one row per pixel and label. Bands are a small table."""
    near = F.abs(F.col("tth") - F.col("two_theta")) <= tolerance
    return pixels.join(F.broadcast(bands.select(F.col("reflection").alias("band"), "two_theta")), near).drop("two_theta").distinct()


def in_any_band(pixels: DataFrame, bands: DataFrame, tolerance: float) -> DataFrame:
    near = F.abs(F.col("tth") - F.col("two_theta")) <= tolerance
    return pixels.join(F.broadcast(bands.select("two_theta")), near, "left_semi")


def drop_edge(pixels: DataFrame, k: int, height: int, width: int) -> DataFrame:
    return pixels.filter(F.col("y").between(k, height - 1 - k) & F.col("x").between(k, width - 1 - k))


def without_gaps(pixels: DataFrame, dark: float, margin: int) -> DataFrame:
    """Pixels outside rows whose mean is below dark, widened by margin rows."""
    rows = pixels.groupBy("gi", "y").agg(F.avg("v").alias("m")).filter(F.col("m") < dark)
    gap = rows.select("gi", F.explode(F.sequence(F.col("y") - margin, F.col("y") + margin)).alias("y")).distinct()
    return pixels.join(gap, ["gi", "y"], "left_anti")


def annulus(tth: Column, low: Column | float, width: float, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor((tth - low) / width), F.lit(n - 1))).cast("bigint")


def radial_profile(pixels: DataFrame, n: int) -> DataFrame:
    """Mean of each of n equal scattering-angle bins of every image, empty bins 0."""
    ends = F.broadcast(pixels.agg(F.min("tth").alias("lo"), F.max("tth").alias("hi")))
    binned = pixels.crossJoin(ends).withColumn("ring", F.greatest(F.lit(0), F.least(F.floor((F.col("tth") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n)), F.lit(n - 1))).cast("bigint"))
    means = binned.groupBy("gi", "ring").agg(F.avg("v").alias("mean"))
    rings = pixels.select("gi").distinct().withColumn("ring", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return rings.join(means, ["gi", "ring"], "left").select("gi", "ring", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def subtract_radial_median(pixels: DataFrame, width: float) -> DataFrame:
    """v less the median of its ring of every image; adds ring and background."""
    ringed = pixels.withColumn("ring", F.floor(F.col("tth") / width).cast("bigint"))
    medians = ringed.groupBy("gi", "ring").agg(F.median("v").alias("background"))
    return ringed.join(medians, ["gi", "ring"]).withColumn("v", F.col("v") - F.col("background"))


def smooth_profile(profile: DataFrame, half: int) -> DataFrame:
    """Moving mean over rings, the profile mirrored at its ends (the end ring repeats)."""
    n = profile.groupBy("gi").agg(F.max("ring").alias("_top"))
    both = profile.join(n, "gi")
    low = both.filter(F.col("ring") < half).withColumn("ring", -1 - F.col("ring"))
    high = both.filter(F.col("ring") > F.col("_top") - half).withColumn("ring", 2 * F.col("_top") + 1 - F.col("ring"))
    run = Window.partitionBy("gi").orderBy("ring").rowsBetween(-half, half)
    padded = both.unionByName(low).unionByName(high).withColumn("mean", F.avg("mean").over(run))
    return padded.filter(F.col("ring").between(0, F.col("_top"))).drop("_top")


def robust_threshold(pixels: DataFrame, keys: list[str], k: float, least: int = 1) -> DataFrame:
    """median, sigma (1.4826 MAD, the population deviation where that is 0) and median + k sigma per group."""
    centre = pixels.groupBy(*keys).agg(F.median("v").alias("median"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n"))
    spread = pixels.join(centre, keys).groupBy(*keys).agg(F.median(F.abs(F.col("v") - F.col("median"))).alias("mad"))
    both = centre.join(spread, keys).withColumn("sigma", F.when(F.col("mad") > 0, MAD_SIGMA * F.col("mad")).otherwise(F.col("sd")))
    return both.filter((F.col("n") >= least) & (F.col("sigma") > 0)).select(*keys, "median", "sigma", (F.col("median") + k * F.col("sigma")).alias("threshold"))


def clipped_sigma(pixels: DataFrame, keys: list[str], k: float, rounds: int) -> DataFrame:
    """Robust median and sigma after dropping values beyond k sigma, rounds times."""
    cur = pixels
    for _ in range(rounds):
        stats = robust_threshold(cur, keys, k)
        cur = cur.join(stats, keys).filter(F.abs(F.col("v") - F.col("median")) <= k * F.col("sigma")).select(pixels.columns)
    return robust_threshold(cur, keys, k)


def _along(value: Column, partition: list[str], order: str, half: int) -> Column:
    return value.over(Window.partitionBy(*partition).orderBy(order).rowsBetween(-half, half))


def opened(pixels: DataFrame, size: int) -> DataFrame:
    """Grey opening by a square: minimum then maximum filter, each along rows then columns.

    Mirrored borders add nothing to a minimum or maximum, so windows are simply cut off.
    """
    half = size // 2
    out = pixels.withColumn("o", F.col("v"))
    for fn in (F.min, F.max):
        out = out.withColumn("o", _along(fn("o"), ["gi", "y"], "x", half))
        out = out.withColumn("o", _along(fn("o"), ["gi", "x"], "y", half))
    return out


def top_hat(pixels: DataFrame, size: int, floor: bool = False) -> DataFrame:
    """v less its opening; never below 0 if floor."""
    hat = F.col("v") - F.col("o")
    return opened(pixels, size).withColumn("hat", F.greatest(hat, F.lit(0.0)) if floor else hat).drop("o")


def multiscale_top_hat(pixels: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """The greatest top-hat over sizes."""
    out = pixels
    for s in sizes:
        out = opened(out, s).withColumn(f"_h{s}", F.col("v") - F.col("o")).drop("o")
    return out.withColumn("hat", F.greatest(*[F.col(f"_h{s}") for s in sizes])).drop(*[f"_h{s}" for s in sizes])


def local_snr(pixels: DataFrame, half: int, height: int, width: int) -> DataFrame:
    """(v - local mean) / local deviation in a square, the image mirrored at its borders."""
    def mirrored(df: DataFrame, axis: str, n: int) -> DataFrame:
        low = df.filter(F.col(axis) < half).withColumn(axis, -1 - F.col(axis))
        high = df.filter(F.col(axis) > n - 1 - half).withColumn(axis, 2 * n - 1 - F.col(axis))
        return df.unionByName(low).unionByName(high)

    sums = pixels.select("gi", "y", "x", F.col("v").alias("s1"), (F.col("v") * F.col("v")).alias("s2"))
    for axis, other, n in (("x", "y", width), ("y", "x", height)):
        padded = mirrored(sums, axis, n)
        for c in ("s1", "s2"):
            padded = padded.withColumn(c, _along(F.sum(c), ["gi", other], axis, half))
        sums = padded.filter(F.col(axis).between(0, n - 1))
    area = (2 * half + 1) ** 2
    mean, square = F.col("s1") / area, F.col("s2") / area
    sd = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    return pixels.join(sums, ["gi", "y", "x"]).withColumn("snr", (F.col("v") - mean) / F.greatest(sd, F.lit(0.01))).drop("s1", "s2")


def window_max(points: DataFrame, pixels: DataFrame, half: int) -> DataFrame:
    """The largest pixel in the square around each point (gi, py, px)."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    cells = points.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).withColumn("y", F.col("py") + F.col("_dy")).withColumn("x", F.col("px") + F.col("_dx"))
    return cells.join(pixels.select("gi", "y", "x", "v"), ["gi", "y", "x"]).groupBy("gi", "py", "px").agg(F.max("v").alias("top"))


def display_range(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """log1p of v (at least 0), clipped to the percentiles low and high of its image."""
    logged = pixels.withColumn("v", F.log1p(F.greatest(F.col("v"), F.lit(0.0))))
    ends = logged.groupBy("gi").agg(F.percentile("v", low).alias("_lo"), F.percentile("v", high).alias("_hi"))
    return logged.join(ends, "gi").withColumn("v", F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col("v")))).drop("_lo", "_hi")


def local_maximum(points: DataFrame, pixels: DataFrame, half: int) -> DataFrame:
    """The brightest pixel within half of each point, the first in reading order on ties."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    cells = points.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).withColumn("y", F.col("py") + F.col("_dy")).withColumn("x", F.col("px") + F.col("_dx"))
    rank = F.struct("v", -F.col("y"), -F.col("x"))
    return cells.join(pixels.select("gi", "y", "x", "v"), ["gi", "y", "x"]).groupBy("gi", "py", "px").agg(F.max_by("y", rank).alias("y"), F.max_by("x", rank).alias("x"), F.max("v").alias("v"))
