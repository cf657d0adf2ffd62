"""Spatial profiles of candidate spots: cheap tests as expressions, then a pseudo-Voigt fit of what passes.

A candidate's profile is its net intensity in every cell around its centre, at most
(2 * radius + 1)^2 of them, so it travels as one array and the tests need no shuffle
beyond the one that collects it. Only profiles that no test decides reach the fit, and a
profile that the fit does not explain is kept where enough pairs of cells fall off
with their distance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import MAD_SIGMA
from gridloom.operators.fit import levenberg
from gridloom.session import cut, default_parallelism

TINY = 1e-10
#: Pairs of cells up to which the falling-off rule compares them directly.
PAIRS = 1_000_000


@dataclass(frozen=True)
class Rules:
    """Limits of the profile tests and of the fit."""

    least_r2: float = 0.25
    least_signal: int = 2
    falling: float = 0.60
    centre_share: float = 0.12
    inner_outer: float = 1.15
    widest: float = 8.0
    flat_cv: float = 0.10
    core: float = 2.5
    compact: float = 3.5
    least_cells: int = 3


def _median(values: Column) -> Column:
    """Median of an array without nulls."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.element_at(ordered, ((n + 1) / 2).cast("int")) + F.element_at(ordered, (n / 2).cast("int") + 1)) / 2


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _mean(values: Column) -> Column:
    return F.try_divide(_total(values), F.size(values))


def profiles(probes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, center_row, center_col and the profile: cell and net of every probed cell, in order of cells."""
    cells = F.collect_list(F.struct("brow", "bcol", F.col("net").cast("double").alias("net")))
    return probes.filter(F.col("net").isNotNull()).groupBy(*keys, "center_row", "center_col").agg(F.array_sort(cells).alias("profile"))


def pretests(probes: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """keys, center_row, center_col, reason, n_signal, cv, io_ratio, and norm and dist of every cell.

    reason is the first test that decides: few, neg, no_center, weak, few_signal, flat,
    flat_io, compact (kept) or spread; fit where none does. norm is a share of the
    highest net, dist the distance from the intensity-weighted centre.
    """
    p = profiles(probes, keys)
    p = p.withColumn("top", F.array_max(F.transform("profile", lambda c: c["net"])))
    p = p.withColumn("norm", F.transform("profile", lambda c: c["net"] / (F.col("top") + TINY)))
    own = F.filter("profile", lambda c: (c["brow"] == F.col("center_row")) & (c["bcol"] == F.col("center_col")))
    p = p.withColumn("centre", F.get(own, F.lit(0))["net"] / (F.col("top") + TINY))
    weight = F.transform("norm", lambda v: F.greatest(v, F.lit(0.0)))
    along = lambda axis: F.try_divide(_total(F.zip_with("profile", weight, lambda c, w: c[axis] * w)), _total(weight))
    p = p.withColumn("_r", along("brow")).withColumn("_c", along("bcol"))
    p = p.withColumn("dist", F.transform("profile", lambda c: F.hypot(c["brow"] - F.col("_r"), c["bcol"] - F.col("_c"))))
    p = p.withColumn("_m", _median(F.col("norm")))
    noise = MAD_SIGMA * _median(F.transform("norm", lambda v: F.abs(v - F.col("_m"))))
    p = p.withColumn("_n", noise).withColumn("level", F.when(F.col("_n") > 0, F.greatest(F.lit(0.08), F.col("_m") + 1.5 * F.col("_n"))).otherwise(0.08))
    p = p.withColumn("n_signal", F.size(F.filter("norm", lambda v: v > F.col("level"))).cast("long"))
    p = p.withColumn("_a", _mean(F.col("norm")))
    p = p.withColumn("cv", F.sqrt(_mean(F.transform("norm", lambda v: (v - F.col("_a")) * (v - F.col("_a"))))) / (F.col("_a") + TINY))
    p = p.withColumn("_p", F.arrays_zip("norm", "dist"))
    inner = F.transform(F.filter("_p", lambda c: c["dist"] <= rules.core), lambda c: c["norm"])
    outer = F.transform(F.filter("_p", lambda c: c["dist"] > rules.core), lambda c: c["norm"])
    p = p.withColumn("_i", inner).withColumn("_o", outer)
    p = p.withColumn("io_ratio", F.when((F.size("_i") >= 2) & (F.size("_o") >= 3), _mean(F.col("_i")) / (_mean(F.col("_o")) + TINY)))
    far = F.array_max(F.transform(F.filter("_p", lambda c: c["norm"] > F.col("level")), lambda c: c["dist"]))
    share = F.size(F.filter("norm", lambda v: v <= F.col("centre"))) / F.size("norm")
    tight = (far <= rules.compact) & (F.col("centre") > 0.3 * F.col("level"))
    reason = (
        F.when(F.size("profile") < rules.least_cells, "few").when(F.col("top") <= 0, "neg").when(F.col("centre").isNull(), "no_center").when(share < rules.centre_share, "weak")
        .when(F.col("n_signal") < rules.least_signal, "few_signal").when(F.col("cv") < rules.flat_cv, "flat").when(F.col("io_ratio") < rules.inner_outer, "flat_io")
        .when((F.col("n_signal") <= 2) & tight, "compact").when(F.col("n_signal") <= 2, "spread").otherwise("fit")
    )
    return p.select(*keys, "center_row", "center_col", reason.alias("reason"), "n_signal", "cv", "io_ratio", "norm", "dist")


def pseudo_voigt(r: np.ndarray, height: float, sigma: float, gamma: float) -> np.ndarray:
    """height at r = 0 of a mixture whose share follows both widths (fixed values of the mixing rule)."""
    gauss, lorentz = 2 * sigma * math.sqrt(2 * math.log(2)), 2 * gamma
    f = (gauss**5 + 2.69269 * gauss**4 * lorentz + 2.42843 * gauss**3 * lorentz**2 + 4.47163 * gauss**2 * lorentz**3 + 0.07842 * gauss * lorentz**4 + lorentz**5) ** 0.2
    if f < TINY:
        return np.zeros_like(r)
    share = float(np.clip(1.36603 * (lorentz / f) - 0.47719 * (lorentz / f) ** 2 + 0.11116 * (lorentz / f) ** 3, 0, 1))
    return height * (share / (1 + (r / (gamma + TINY)) ** 2) + (1 - share) * np.exp(-(r**2) / (2 * sigma**2 + TINY)))


def falling_share(dist: np.ndarray, norm: np.ndarray, apart: float = 0.1) -> tuple[int, float]:
    """Pairs of cells whose distances differ by apart, and the share of them whose nearer cell is brighter."""
    order = np.argsort(dist, kind="stable")
    d, v = dist[order], norm[order]
    if len(d) ** 2 <= PAIRS:
        far = d[None, :] - d[:, None] >= apart
        pairs = int(far.sum())
        return pairs, int((far & (v[None, :] < v[:, None])).sum()) / pairs if pairs else 0.0
    # the cells further out are the tail of the order from `tail` on, the same one for equal distances
    each, first, at = np.unique(d, return_index=True, return_inverse=True)
    to = np.searchsorted(each, each + apart)
    while (back := (to > 0) & (each[np.maximum(to - 1, 0)] - each >= apart)).any():
        to -= back
    while (on := (to < len(each)) & (each[np.minimum(to, len(each) - 1)] - each < apart)).any():
        to += on
    tail = np.r_[first, len(d)][to][at]
    pairs = int((len(d) - tail).sum())
    # a tail is a few blocks of powers of two; in each, sorted by rank, the fainter cells are counted by bisection
    rank, n = np.unique(v, return_inverse=True)[1].astype(np.int64), 1 << len(d).bit_length()
    falls, size, low = 0, 1, tail.copy()
    padded = np.concatenate([rank, np.full(n - len(d), len(d), dtype=np.int64)])
    while size <= n:
        odd = np.flatnonzero((low & size > 0) & (low < len(d)))
        if len(odd):
            block = low[odd] // size
            keys = (np.sort(padded.reshape(-1, size), axis=1) + np.arange(n // size)[:, None] * (len(d) + 1)).ravel()
            falls += int((np.searchsorted(keys, block * (len(d) + 1) + rank[odd]) - block * size).sum())
            low[odd] += size
        if size == n:
            whole = np.flatnonzero(tail == 0)
            falls += int(np.searchsorted(np.sort(rank), rank[whole]).sum())
        size *= 2
    return pairs, falls / pairs if pairs else 0.0


def _folded(dist: np.ndarray, norm: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """dist, norm and w with the cells of one distance as one of the same weighted squares, and the squares that no model of the distance explains."""
    each, at = np.unique(dist, return_inverse=True)
    if len(each) == len(dist):
        return dist, norm, w, 0.0
    weight = np.bincount(at, w * w)
    mean = np.bincount(at, w * w * norm) / weight
    return each, mean, np.sqrt(weight), float(((w * (norm - mean[at])) ** 2).sum())


def fit_profile(dist: np.ndarray, norm: np.ndarray, n_signal: int, rules: Rules) -> tuple:
    """(kept, reason, r2, sigma, gamma, falling) of one profile; bright cells weigh more, by their norm."""
    reach, w = float(dist.max()) + 1, np.maximum(norm, 0.05)
    low, high = np.array([0.1, 0.1, 0.01, -0.3]), np.array([2.0, 2 * reach, 2 * reach, 0.7])
    d, v, weight, rest = _folded(dist, norm, w)
    aside = [math.sqrt(rest)] if rest else []  # keeps the cost that of all cells
    goal = np.concatenate([weight * v, aside])
    model = lambda p: np.concatenate([weight * (p[3] + pseudo_voigt(d, p[0], p[1], p[2])), [0.0] * len(aside)])
    starts = ([1.0, reach / 3, reach / 3, 0.0], [1.0, reach / 6, 0.05, 0.0], [1.0, 0.3, reach / 6, 0.0])
    fits = [levenberg(model, np.array(s), low, high, goal, rounds=300) for s in starts]
    p = min(fits, key=lambda q: float(((model(q) - goal) ** 2).sum()))
    left = float(((model(p) - goal) ** 2).sum())
    r2 = 1 - left / (float((((norm - norm.mean()) * w) ** 2).sum()) + TINY)
    sigma, gamma = float(p[1]), float(p[2])
    if sigma > rules.widest and gamma > rules.widest:
        return False, "wide", r2, sigma, gamma, None
    if r2 > (rules.least_r2 if n_signal > 4 else max(0.10, rules.least_r2 - 0.10)):
        return True, "voigt", r2, sigma, gamma, None
    pairs, share = falling_share(dist, norm)
    enough = rules.falling if n_signal >= 5 else max(0.50, rules.falling - 0.05)
    kept = pairs > 3 and share > enough
    return kept, "falling" if kept else "poor_fit", r2, sigma, gamma, share


FITTED = "kept boolean, reason string, r2 double, sigma double, gamma double, falling double"


def _fitted(rows: DataFrame, keys: list[str], rules: Rules, passed: list[str]) -> DataFrame:
    """keys, passed columns and the fit of every row's norm and dist."""

    def run(frames):
        for pdf in frames:
            found = [fit_profile(np.asarray(d, dtype=float), np.asarray(v, dtype=float), int(n), rules) for d, v, n in zip(pdf.dist, pdf.norm, pdf.n_signal, strict=True)]
            fits = pd.DataFrame(found, columns=["kept", "reason", "r2", "sigma", "gamma", "falling"], index=pdf.index)
            yield pd.concat([pdf[[*keys, *passed]], fits], axis=1)

    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *passed])
    # few rows of much work each: dealt by count, as their bytes would leave them in one task
    dealt = rows.select(*keys, *passed, "norm", "dist").repartition(default_parallelism(rows.sparkSession), *keys)
    return dealt.mapInPandas(run, f"{fields}, {FITTED}")


def verify(probes: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """keys, center_row, center_col, n_signal, kept, reason, r2, sigma, gamma and falling of every candidate.

    probes: keys, center_row, center_col, brow, bcol, net; a cell a row, null nets out.
    keys must hold no nulls. A candidate without rows does not occur.
    """
    tested = cut(pretests(probes, keys, rules))
    columns = ["center_row", "center_col", "n_signal"]
    decided = tested.filter("reason <> 'fit'").select(*keys, *columns, (F.col("reason") == "compact").alias("kept"), "reason", *[F.lit(None).cast("double").alias(c) for c in ("r2", "sigma", "gamma", "falling")])
    return decided.unionByName(_fitted(tested.filter("reason = 'fit'"), keys, rules, columns))


def verify_members(members: DataFrame, keys: list[str], value: str = "intensity", rules: Rules = Rules(flat_cv=0.05)) -> DataFrame:  # noqa: B008
    """keys, n, kept, reason, r2, sigma, gamma and falling of linked features by their own members' intensities.

    One member: isolated; no positive intensity: neg; little spread: flat; two members: compact,
    kept. The fit takes the others; up to four members are held to a lower r2. A feature's
    members lie in one scan, whose grid bounds them.
    """
    used = members.filter(F.col(value).isNotNull())
    light = F.greatest(F.col(value), F.lit(0.0))
    stats = used.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(value).alias("top"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
        F.try_divide(F.sum(F.col("brow") * light), F.sum(light)).alias("_r"), F.try_divide(F.sum(F.col("bcol") * light), F.sum(light)).alias("_c"),
    )
    cv = F.col("sd") / (F.col("mean") + TINY * F.col("top"))
    reason = F.when(F.col("n") < 2, "isolated").when(F.col("top") <= 0, "neg").when(cv < rules.flat_cv, "flat").when(F.col("n") <= 2, "compact").otherwise("fit")
    tested = cut(stats.select(*keys, "n", "top", "_r", "_c", reason.alias("reason")))
    decided = tested.filter("reason <> 'fit'").select(*keys, "n", (F.col("reason") == "compact").alias("kept"), "reason", *[F.lit(None).cast("double").alias(c) for c in ("r2", "sigma", "gamma", "falling")])
    point = F.struct(F.hypot(F.col("brow") - F.col("_r"), F.col("bcol") - F.col("_c")).alias("d"), (F.col(value) / (F.col("top") + TINY)).cast("double").alias("v"))
    listed = used.join(tested.filter("reason = 'fit'").drop("reason"), keys).groupBy(*keys, "n").agg(F.array_sort(F.collect_list(point)).alias("points"))
    arrays = listed.select(*keys, "n", F.col("n").alias("n_signal"), F.col("points.v").alias("norm"), F.col("points.d").alias("dist"))
    return decided.unionByName(_fitted(arrays.withColumn("n_signal", F.col("n")), keys, rules, ["n", "n_signal"]).drop("n_signal"))
