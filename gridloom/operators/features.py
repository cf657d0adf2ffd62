"""Features from linked peaks: characterisation, profiles, widths and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import GAUSS_FWHM


def characterize(members: DataFrame, order: tuple[str, ...], group: tuple[str, ...] = ("component",)) -> DataFrame:
    """One row per component: brightest member's label and cell (first by order on ties), integer mean place, intensity, SNR, cells."""
    best = F.struct("intensity", *[-F.col(c) for c in order])
    cell = F.struct("brow", "bcol")
    return members.groupBy(*group).agg(
        F.max_by("label", best).alias("label"), F.max_by("brow", best).alias("center_row"), F.max_by("bcol", best).alias("center_col"),
        F.avg("x").cast("int").alias("detector_x"), F.avg("y").cast("int").alias("detector_y"), F.max("intensity").alias("peak_intensity"),
        F.avg("snr").alias("mean_snr"), F.count("*").alias("n_members"), F.countDistinct(cell).alias("n_bins"), F.sort_array(F.collect_set(cell)).alias("extent"),
    )


def best_per_bin(members: DataFrame, order: tuple[str, ...], group: tuple[str, ...] = ("component",)) -> DataFrame:
    """The strongest member of each cell of each component."""
    best = F.struct("intensity", *[-F.col(c) for c in order])
    return members.groupBy(*group, "brow", "bcol").agg(F.max("intensity").alias("intensity"), F.max_by("x", best).alias("det_x"), F.max_by("y", best).alias("det_y"), F.max_by("snr", best).alias("snr"))


def weighted_fwhm(profile: DataFrame, value: str, weight: str, group: tuple[str, ...] = ("component",), least: int = 3) -> DataFrame:
    """2.3548 times the weighted deviation of value, over positive weights, from `least` rows on; two passes."""
    used = profile.filter((F.col(weight) > 0) & F.col(value).isNotNull())
    mean = used.groupBy(*group).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("_m"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    spread = F.sum(F.col(weight) * (F.col(value) - F.col("_m")) ** 2) / F.sum(weight)
    return used.join(mean, list(group)).groupBy(*group).agg((GAUSS_FWHM * F.sqrt(spread)).alias("fwhm"))


def profile_check(profile: DataFrame, centres: DataFrame, least_cv: float = 0.05, least_share: float = 0.4, step: float = 0.1, group: tuple[str, ...] = ("component",)) -> DataFrame:
    """reason per component: single, non_positive, flat, non_gaussian or null for accepted.

    A profile is accepted if enough pairs of cells fall off with their distance from the
    centre; pairs of nearly equal distance don't count. Pairs form inside a component only,
    each member with those further out.
    """
    stats = profile.groupBy(*group).agg(F.count("*").alias("n"), F.max("intensity").alias("top"), F.avg("intensity").alias("mean"), F.stddev_pop("intensity").alias("sd"))
    keys = list(group)
    d = F.sqrt((F.col("brow") - F.col("center_row")) ** 2 + (F.col("bcol") - F.col("center_col")) ** 2)
    far = profile.join(centres.select(*keys, "center_row", "center_col"), keys).select(*keys, d.alias("d"), F.col("intensity").alias("v"))
    listed = far.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("p"))
    counted = F.expr(
        f"aggregate(p, named_struct('n', 0L, 'ok', 0L), (acc, a) -> named_struct('n', acc.n + size(filter(p, b -> b.d - a.d >= {step})), "
        f"'ok', acc.ok + size(filter(p, b -> b.d - a.d >= {step} and b.v <= a.v))))"
    )
    pairs = listed.select(*keys, counted.alias("c"))
    cv = F.try_divide("sd", "mean")
    share = F.try_divide("c.ok", "c.n")
    reason = F.when(F.col("n") < 2, "single").when(F.col("top") <= 0, "non_positive").when(cv < least_cv, "flat").when(share < least_share, "non_gaussian")
    return stats.join(pairs, keys, "left").select(*keys, "n", cv.alias("cv"), share.alias("falling"), reason.alias("reason"))


def number(rows: DataFrame, order: list[str | Column], partition: list[str], name: str = "feature_id") -> DataFrame:
    """Ids from 1 within partition, in the given order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def top_per_group(rows: DataFrame, k: int, partition: list[str], order: list[str | Column]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("place") <= k)
