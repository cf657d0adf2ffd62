"""Row selections: catalog filters, split rules, samples, galleries and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catalog_rows(rows: DataFrame, scans: list[str] | None = None, bin_sizes: list[int] | None = None) -> DataFrame:
    """Rows of the named scans and bin sizes; None names all. Both filters reach the scan of the files."""
    if scans is not None:
        rows = rows.filter(F.col("scan").isin(scans))
    return rows if bin_sizes is None else rows.filter(F.col("bin_size").isin(bin_sizes))


def prepared(features: DataFrame, thetas: DataFrame) -> DataFrame:
    """Features that have a centre and a scan of known theta, with the first intensity that is known."""
    known = thetas.filter("theta is not null").select("scan", "theta")
    value = F.coalesce("sum_integrated", "peak_intensity", "mean_intensity")
    return features.filter("center_row is not null and center_col is not null").join(known, "scan").withColumn("intensity", value.cast("double"))


def shift_metric(two_theta: str, reference: str) -> Column:
    """Difference of a measured angle from its reference, null where either is."""
    return F.col(two_theta) - F.col(reference)


def calibrated(angle: Column, scale: float, offset: float) -> Column:
    return angle * F.lit(float(scale)) + F.lit(float(offset))


def kept(reason: Column) -> Column:
    """Whether a reason text names none of the grounds for rejection; no reason keeps."""
    return ~F.coalesce(F.lower(reason).rlike("^(non-gaussian|isolated|flat|non-positive)"), F.lit(False))


def verified_bins(bins: DataFrame) -> DataFrame:
    """Reviewed bins with whether they hold labels: one of empty and labelled is true."""
    return bins.filter("reviewed").select("scan", "brow", "bcol", "n", (F.col("n") == 0).alias("empty"), (F.col("n") > 0).alias("labelled"))


def peak_annotations(peaks: DataFrame) -> DataFrame:
    """Per scan and bin the detector places of its peaks as [row, col] pairs, in order."""
    return peaks.groupBy("scan", "brow", "bcol").agg(F.array_sort(F.collect_set(F.array("y", "x"))).alias("places"))


def every_kth(bins: DataFrame, group: list[str], order: list[str], step: int, most: int) -> DataFrame:
    """Every step-th row of each group in order, the first included, up to most rows: a sampling operator."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return bins.withColumn("_at", at).filter((F.col("_at") % step == 0) & (F.col("_at") < step * most)).drop("_at")


def gallery(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their place from 1."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def brightest(rows: DataFrame, group: list[str], what: list[str], value: str) -> DataFrame:
    """The row of the largest value of each group; the least place wins ties."""
    best = F.min_by(F.struct(*what, value), F.struct((-F.col(value)).alias("v"), *what))
    return rows.groupBy(*group).agg(best.alias("b")).select(*group, "b.*")


def leaderboard(scores: DataFrame, bin_sizes: DataFrame, fallback: int, skip: list[str]) -> DataFrame:
    """The best algorithm for each bin size: its own scores first, then those at fallback, then any.

    Algorithms in skip never lead. The highest score wins, the name breaks ties.
    """
    able = scores.filter(~F.col("algorithm").isin(skip)).groupBy("bin_size", "algorithm").agg(F.max("f1").alias("f1"))
    own = bin_sizes.join(able, "bin_size").select("bin_size", F.lit(0).alias("rank"), "algorithm", "f1")
    # scores are one row an algorithm and size, so these one-row sides are small by definition
    lead = lambda rows: rows.agg(F.min(F.struct((-F.col("f1")).alias("v"), "algorithm")).alias("b")).filter("b is not null").select(F.col("b.algorithm").alias("algorithm"), (-F.col("b.v")).alias("f1"))
    spare = [bin_sizes.crossJoin(F.broadcast(lead(r))).select("bin_size", F.lit(k).alias("rank"), "algorithm", "f1") for k, r in ((1, able.filter(F.col("bin_size") == fallback)), (2, able))]
    both = own.unionByName(spare[0]).unionByName(spare[1])
    best = F.min(F.struct("rank", (-F.col("f1")).alias("v"), "algorithm")).alias("b")
    return both.groupBy("bin_size").agg(best).select("bin_size", F.col("b.algorithm").alias("algorithm"), (-F.col("b.v")).alias("f1"), F.col("b.rank").alias("fallback"))


def variant_name(base: Column, sensitivity: Column, row_noise: Column) -> Column:
    """Name of a frozen variant: base, sensitivity with p for the point, and nr where row noise is off."""
    sens = F.regexp_replace(F.format_string("%.1f", sensitivity), r"\.", "p")
    return F.concat(base, F.lit("__sens"), sens, F.when(row_noise, F.lit("")).otherwise(F.lit("__nr")))


def clipped_window(y: Column, x: Column, half: int, rows: int, cols: int) -> Column:
    """Bounds y0, y1, x0, x1 (both ends inside) of the window around a place, clipped to the frame."""
    low = lambda c: F.greatest(c - half, F.lit(0)).cast("bigint")
    high = lambda c, n: F.least(c + half, F.lit(n - 1)).cast("bigint")
    return F.struct(low(y).alias("y0"), high(y, rows).alias("y1"), low(x).alias("x0"), high(x, cols).alias("x1"))


def summed_frames(images: DataFrame, chosen: DataFrame, frame: str = "gi") -> DataFrame:
    """Pixel sums over the frames chosen for each gallery; chosen has gallery and frame."""
    return images.join(chosen.select("gallery", frame).distinct(), frame).groupBy("gallery", "y", "x").agg(F.sum("v").alias("v"), F.count("*").alias("n_frames"))
