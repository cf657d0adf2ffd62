"""Comparison and statistics of catalogs: histograms, ranks, scores, novelty and trade-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import bin_index, f_score


def histogram(rows: DataFrame, value: str, low: float, high: float, n: int, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Counts (or summed weights) of n equal bins on [low, high]; the last bin is closed, others outside are dropped."""
    width = (high - low) / n
    inside = rows.filter(F.col(value).between(low, high))
    total = F.sum(weight) if weight else F.count("*")
    return inside.groupBy(*keys, bin_index(F.col(value), F.lit(low), F.lit(width), n).alias("bin")).agg(total.alias("n"))


def log_histogram(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Counts and densities of n bins of equal ratio between the least and largest positive value."""
    used = rows.filter(F.col(value) > 0).withColumn("_l", F.log10(value))
    ends = F.broadcast(used.agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi"), F.count("*").alias("_n")))
    binned = used.crossJoin(ends).withColumn("bin", bin_index(F.col("_l"), F.col("_lo"), (F.col("_hi") - F.col("_lo")) / n, n))
    return binned.groupBy("bin", "_n").agg(F.count("*").alias("n")).select("bin", "n", (F.col("n") / F.col("_n")).alias("share"))


def quantile_summary(rows: DataFrame, keys: list[str], value: str, near: tuple[float, float]) -> DataFrame:
    """Count, median, 90th percentile and the percentage of values in [near)."""
    inside = (F.col(value) >= near[0]) & (F.col(value) < near[1])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.percentile(value, 0.9).alias("p90"), (100 * F.count_if(inside) / F.count("*")).alias("near_pct"))


def spearman(rows: DataFrame, a: str, b: str, partition: list[str], constant: float = 0.0) -> DataFrame:
    """Rank correlation of a and b per partition, ties by average rank, nulls last; constant where either does not vary, for which corr divides by zero."""
    for c in (a, b):
        rank = F.rank().over(Window.partitionBy(*partition).orderBy(F.asc_nulls_last(c)))
        ties = F.count("*").over(Window.partitionBy(*partition, c))
        rows = rows.withColumn(f"_{c}", rank + (ties - 1) / 2)
    rho = F.try_divide(F.covar_pop(f"_{a}", f"_{b}"), F.stddev_pop(f"_{a}") * F.stddev_pop(f"_{b}"))
    return rows.groupBy(*partition).agg(F.coalesce(rho, F.lit(float(constant))).alias("rho"))


def score_bins(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Mean F-beta over bins (tp, fp, fn); a bin without truth scores 1 if nothing was found, else 0."""
    empty = F.col("tp") + F.col("fn") == 0
    score = F.when(empty, F.when(F.col("fp") == 0, 1.0).otherwise(0.0)).otherwise(f_score(F.col("tp"), F.col("fp"), F.col("fn"), beta))
    return counts.agg(F.avg(score).alias("mean_score"), F.count("*").alias("bins"), F.count_if(empty).alias("empty_bins"))


def confusion(truth: DataFrame, found: DataFrame, keys: list[str], item: str) -> DataFrame:
    """tp, fp, fn per keys from truth and found items."""
    t = truth.select(*keys, item).distinct().withColumn("_t", F.lit(1))
    f = found.select(*keys, item).distinct().withColumn("_f", F.lit(1))
    both = t.join(f, [*keys, item], "full")
    count = lambda a, b: F.count_if(a & b)
    is_t, is_f = F.col("_t").isNotNull(), F.col("_f").isNotNull()
    return both.groupBy(*keys).agg(count(is_t, is_f).alias("tp"), count(~is_t, is_f).alias("fp"), count(is_t, ~is_f).alias("fn"))


def split(rows: DataFrame, key: str, seed: str, percent: float, partition: list[str]) -> DataFrame:
    """rows with holdout: the first round(n * percent) keys of each partition by seeded md5."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key))
    n = F.count("*").over(Window.partitionBy(*partition))
    return rows.withColumn("holdout", rank <= F.rint(n * percent / 100))


def trade_off(rows: DataFrame, gain: str, others: list[str]) -> DataFrame:
    """Score gain * (0.5 + 0.5 * mean of others) over min-max scaled columns."""
    ends = F.broadcast(rows.agg(*[f(c).alias(f"_{n}_{c}") for c in [gain, *others] for n, f in (("lo", F.min), ("hi", F.max))]))
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))
    rest = sum((scaled(c) for c in others[1:]), scaled(others[0])) / len(others)
    return rows.crossJoin(ends).withColumn("score", scaled(gain) * (0.5 + 0.5 * rest)).select(*rows.columns, "score")


def spans(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Row and column span, cells, empty share of the bounding box and whether it is one row."""
    box = (F.col("row_span") * F.col("col_span")).cast("double")
    out = cells.groupBy(*keys).agg((F.max("brow") - F.min("brow") + 1).alias("row_span"), (F.max("bcol") - F.min("bcol") + 1).alias("col_span"), F.countDistinct("brow", "bcol").alias("n_bins"))
    return out.withColumn("gap_share", 1 - F.col("n_bins") / box).withColumn("one_row", (F.col("row_span") == 1) & (F.col("n_bins") > 1))


def circular_density(rows: DataFrame, angle: str, sigma: float, keys: list[str], weight: str | None = None) -> DataFrame:
    """Gaussian-smoothed density of whole degrees around the circle, cut off at four sigma."""
    degree = F.pmod(F.floor(angle).cast("bigint"), F.lit(360))
    counts = rows.groupBy(*keys, degree.alias("d")).agg((F.sum(weight) if weight else F.count("*")).alias("w"))
    reach = int(4 * sigma + 0.5)
    norm = sum(2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1))
    spread = counts.withColumn("k", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    kernel = F.exp(-0.5 * (F.col("k") / sigma) ** 2) / norm
    return spread.groupBy(*keys, F.pmod(F.col("d") + F.col("k"), F.lit(360)).alias("degree")).agg(F.sum(F.col("w") * kernel).alias("density"))
