"""Reciprocal space: geometry recovery, Q maps and the three-dimensional intensity histogram."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import q_vector, rotate_z


def recover_geometry(tth: DataFrame, start: tuple[float, float, float], pixel: float, rounds: int = 12) -> tuple[float, float, float]:
    """(beam row, beam column, distance) that fit tth (y, x, tth) best.

    Gauss-Newton with a flat detector; the sums of the normal equations are one Spark
    aggregate a round, and the driver solves three by three.
    """
    row, col, dist = start
    for _ in range(rounds):
        dy, dx = F.col("y") - row, F.col("x") - col
        rho = F.greatest(F.hypot(dy, dx), F.lit(1e-9))
        a = pixel * rho
        r = F.col("tth") - F.degrees(F.atan2(a, F.lit(dist)))
        scale = (180 / math.pi) * dist / (dist * dist + a * a)
        j = [-scale * pixel * dy / rho, -scale * pixel * dx / rho, -(180 / math.pi) * a / (dist * dist + a * a)]
        sums = tth.select(*[c.alias(f"j{i}") for i, c in enumerate(j)], r.alias("r")).agg(
            *[F.sum(F.col(f"j{p}") * F.col(f"j{q}")).alias(f"a{p}{q}") for p in range(3) for q in range(3)], *[F.sum(F.col(f"j{p}") * F.col("r")).alias(f"b{p}") for p in range(3)]
        ).first()
        normal = np.array([[sums[f"a{p}{q}"] for q in range(3)] for p in range(3)])
        step = np.linalg.solve(normal + 1e-12 * np.diag(np.diag(normal)), [sums[f"b{p}"] for p in range(3)])
        row, col, dist = row + float(step[0]), col + float(step[1]), max(1e-9, dist + float(step[2]))
    return row, col, dist


def q_map(pixels: DataFrame, beam: tuple[float, float, float], pixel: float, wave: float, theta: str = "theta") -> DataFrame:
    """pixels with qx, qy, qz (rotated about z by theta) and q_mag."""
    qx, qy, qz = q_vector(F.col("y"), F.col("x"), beam[0], beam[1], beam[2], pixel, wave)
    flat = pixels.withColumn("_qx", qx).withColumn("_qy", qy).withColumn("qz", qz)
    rx, ry = rotate_z(F.col("_qx"), F.col("_qy"), F.col(theta))
    return flat.withColumn("qx", rx).withColumn("qy", ry).withColumn("q_mag", F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2)).drop("_qx", "_qy")


def at_pixels(features: DataFrame, qmap: DataFrame, height: int, width: int) -> DataFrame:
    """features with the Q of their rounded (half to even), clamped detector pixel; rows without one are dropped."""
    place = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(c))).cast("bigint")
    return features.filter("detector_x is not null and detector_y is not null").withColumn("x", place("detector_x", width)).withColumn("y", place("detector_y", height)).join(qmap, ["y", "x"])


def q_histogram(qmap: DataFrame, bins: tuple[int, int, int], scan: str, least: float = 0.0) -> DataFrame:
    """ix, iy, iz, intensity, n: intensity above the scan's median summed on a common grid."""
    axes = ("qx", "qy", "qz")
    ends = F.broadcast(qmap.agg(*[f(a).alias(f"_{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]))
    medians = qmap.groupBy(scan).agg(F.median("v").alias("_m"))
    level = qmap.join(medians, scan).withColumn("v", F.col("v") - F.col("_m")).filter(F.col("v") > least).crossJoin(ends)
    index = lambda a, n: F.coalesce(F.greatest(F.lit(0), F.least(F.floor(F.try_divide(F.col(a) - F.col(f"_lo{a}"), (F.col(f"_hi{a}") - F.col(f"_lo{a}")) / n)), F.lit(n - 1))), F.lit(0)).cast("bigint")
    return level.groupBy(*[index(a, n).alias(f"i{a[1]}") for a, n in zip(axes, bins, strict=True)]).agg(F.sum("v").alias("intensity"), F.count("*").alias("n"))


def projections(volume: DataFrame) -> DataFrame:
    """Largest voxel along each axis: plane, a, b, top."""
    out = None
    for plane, (a, b) in {"xy": ("ix", "iy"), "xz": ("ix", "iz"), "yz": ("iy", "iz")}.items():
        one = volume.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.max("intensity").alias("top")).select(F.lit(plane).alias("plane"), "a", "b", "top")
        out = one if out is None else out.unionByName(one)
    return out
