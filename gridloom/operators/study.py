"""Cross-scan study: fused device maps, tracks, rocking metrics and prediction reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import upper_median


def combined_device(device_map: DataFrame, value: str = "integrated", order: str = "ord") -> DataFrame:
    """Per cell, over all reflections and for each: the largest value, its theta and the number of thetas.

    Only positive values count, the first row wins ties. reflection is null on the fused level.
    """
    used = device_map.filter(F.col(value) > 0)
    best = F.struct(value, -F.col(order))
    aggs = [F.max(value).alias("max_intensity"), F.max_by("theta", best).alias("argmax_theta"), F.countDistinct("theta").alias("n_theta")]
    columns = ["level", "reflection", "brow", "bcol", "max_intensity", "argmax_theta", "n_theta"]
    sets = used.groupingSets([[F.col("brow"), F.col("bcol")], [F.col("reflection"), F.col("brow"), F.col("bcol")]], F.col("reflection"), F.col("brow"), F.col("bcol"))
    return sets.agg(F.when(F.grouping("reflection") == 1, "fused").otherwise("reflection").alias("level"), *aggs).select(*columns)


def device_summary(combined: DataFrame) -> DataFrame:
    fused = combined.filter("level = 'fused'")
    return fused.agg(F.count("*").alias("cells"), F.count_if(F.col("n_theta") > 1).alias("multi_theta"), F.max("max_intensity").alias("top"))


def device_grid(device_map: DataFrame, metric: str, value: str, order: str = "ord") -> DataFrame:
    """Per reflection and cell: max, the value of largest magnitude, or the last by order."""
    agg = {"max": F.max(value), "extreme": F.max_by(value, F.struct(F.abs(value), -F.col(order))), "last": F.max_by(value, order)}[metric]
    return device_map.groupBy("reflection", "brow", "bcol").agg(agg.alias("value"))


def feature_rows(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and summed intensity and the intensity-weighted 2theta centre of each feature's profile."""
    weighted = F.try_divide(F.sum(F.col("tth") * F.col("integrated")), F.sum("integrated"))
    return profile.groupBy(*keys).agg(F.avg("intensity").alias("mean_intensity"), F.sum("integrated").alias("sum_integrated"), F.coalesce(weighted, F.avg("tth")).alias("tth_com"), F.count("*").alias("n_bins"))


def islands(features: DataFrame, tolerance: float, keys: list[str], rounds: int = 4) -> DataFrame:
    """features with an island: no two features of different islands can ever match within tolerance.

    Rows are split at gaps over tolerance along one axis, then the other, in turn.
    """
    out = features.withColumn("island", F.lit("").cast("string"))
    for k in range(rounds):
        axis = ("center_row", "center_col")[k % 2]
        run = Window.partitionBy(*keys, "island").orderBy(axis)
        gap = F.when(F.col(axis) - F.lag(axis).over(run) > tolerance, 1).otherwise(0)
        out = out.withColumn("_g", gap).withColumn("_n", F.sum("_g").over(run.rangeBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("island", F.concat_ws(".", "island", F.col("_n").cast("string"))).drop("_g", "_n")
    return out


TRACKED = "reflection string, island string, seed bigint, feature_id bigint"


def tracks(features: DataFrame, tolerance: float) -> DataFrame:
    """reflection, island, seed, feature_id: which track each feature belongs to.

    Strongest first, a feature joins the nearest running centroid of its reflection within
    tolerance, the later on ties, or starts a track named by its feature_id. The loop runs
    per island, which no match can leave.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["peak_intensity", "feature_id"], ascending=[False, True])
        places = pdf[["center_row", "center_col"]].to_numpy(dtype=float)
        sums, counts, seeds, mine = np.zeros((len(pdf), 2)), np.zeros(len(pdf)), [], []
        for ident, place in zip(pdf.feature_id.tolist(), places, strict=True):
            n = len(seeds)
            k = n
            if n:
                apart = np.hypot(*(sums[:n] / counts[:n, None] - place).T)
                near = np.flatnonzero(apart <= tolerance)
                if len(near):
                    least = apart[near].min()
                    k = int(near[apart[near] <= least][-1])
            if k == n:
                seeds.append(ident)
            sums[k] += place
            counts[k] += 1
            mine.append(k)
        return pd.DataFrame({"reflection": pdf.reflection, "island": pdf.island, "seed": [seeds[k] for k in mine], "feature_id": pdf.feature_id})

    dealt = islands(features, tolerance, ["reflection"])
    return dealt.groupBy("reflection", "island").applyInPandas(run, TRACKED)


def unwrapped(rows: DataFrame, angle: str, partition: list[str], order: list[str]) -> DataFrame:
    """rows with angle_unwrapped: the angle continued the short way along order."""
    run = Window.partitionBy(*partition).orderBy(*order)
    step = F.pmod(F.col(angle) - F.lag(angle).over(run) + 180, F.lit(360.0)) - 180
    total = F.sum(F.coalesce("_step", F.lit(0.0))).over(run.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_step", step).withColumn(f"{angle}_unwrapped", F.first(angle).over(run) + total).withColumn(f"{angle}_step", F.abs("_step")).drop("_step")


def track_summary(members: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Centroid, drift, theta range, angle span and largest step, and recurrence of each track."""
    steps = unwrapped(members, "chi_deg", keys, order)
    mid = steps.groupBy(*keys).agg(F.avg("center_row").alias("_r"), F.avg("center_col").alias("_c"))
    apart = (F.col("center_row") - F.col("_r")) ** 2 + (F.col("center_col") - F.col("_c")) ** 2
    return steps.join(mid, keys).groupBy(*keys).agg(
        F.avg("center_row").alias("row"), F.avg("center_col").alias("col"), F.sqrt(F.avg(apart)).alias("rms_drift"), F.min("theta").alias("theta_min"), F.max("theta").alias("theta_max"),
        F.max_by("theta", F.struct("peak_intensity", -F.col("theta"))).alias("theta_at_max"), F.max("peak_intensity").alias("max_intensity"), F.countDistinct("theta").alias("n_theta"),
        (F.max("chi_deg_unwrapped") - F.min("chi_deg_unwrapped")).alias("chi_span"), F.coalesce(F.max("chi_deg_step"), F.lit(0.0)).alias("chi_max_step"),
    ).withColumn("recurrent", F.col("n_theta") > 1)


def intensity_curve(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    return members.groupBy(*keys, "theta").agg(F.greatest(F.max(value), F.lit(0.0)).alias("intensity"))


def curve_moments(curve: DataFrame, keys: list[str]) -> DataFrame:
    """theta at the maximum (the first on ties), weighted mean theta and trapezoid area of each curve."""
    run = Window.partitionBy(*keys).orderBy("theta")
    piece = (F.col("theta") - F.lag("theta").over(run)) * (F.col("intensity") + F.lag("intensity").over(run)) / 2
    return curve.withColumn("_a", piece).groupBy(*keys).agg(
        F.max_by("theta", F.struct("intensity", -F.col("theta"))).alias("theta_at_max"), F.try_divide(F.sum(F.col("theta") * F.col("intensity")), F.sum("intensity")).alias("theta_mean"),
        F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"), F.count("*").alias("n"),
    )


def rocking_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """count, minimum, upper median and maximum of each metric."""
    return rows.agg(*[a for m in metrics for a in (F.count(m).alias(f"{m}_n"), F.min(m).alias(f"{m}_min"), upper_median(m).alias(f"{m}_median"), F.max(m).alias(f"{m}_max"))])


def predicted_vs_observed(members: DataFrame, summary: DataFrame, thetas: DataFrame, keys: list[str], slack: float = 1e-9) -> DataFrame:
    """Per recurrent track: sampled thetas inside its range, those observed, and gaps. Thetas are few."""
    ranged = summary.filter("recurrent").select(*keys, "theta_min", "theta_max")
    expected = ranged.join(F.broadcast(thetas.select("theta").distinct()), F.col("theta").between(F.col("theta_min") - slack, F.col("theta_max") + slack)).select(*keys, "theta")
    seen = members.select(*keys, "theta", F.lit(1).alias("seen")).distinct()
    return expected.join(seen, [*keys, "theta"], "left").groupBy(*keys).agg(F.count("*").alias("expected"), F.count("seen").alias("observed"), F.count_if(F.col("seen").isNull()).alias("gaps"))


def retention(features: DataFrame, first: str, second: str, substrate: list[str]) -> DataFrame:
    """Counts per reflection in two scans and the share that remains, the substrate marked."""
    two = features.groupBy("reflection").agg(F.count_if(F.col("scan") == first).alias("n_first"), F.count_if(F.col("scan") == second).alias("n_second"))
    return two.withColumn("retention", F.try_divide("n_second", "n_first")).withColumn("kind", F.when(F.col("reflection").isin(substrate), "substrate").otherwise("film"))
