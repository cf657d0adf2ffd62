"""Joins of catalogs by lineage, and the summaries that reports are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import upper_median
from gridloom.operators import spatial, study
from gridloom.session import cut


def lineage(shapes: DataFrame, peaks: DataFrame) -> DataFrame:
    """shape, peak, by: the peak catalog of each shape catalog, by its recorded file, else the first of its bin size and tag."""
    named = shapes.join(peaks.select(F.col("file").alias("source")), "source").select(F.col("file").alias("shape"), F.col("source").alias("peak"), F.lit("source").alias("by"))
    first = peaks.groupBy("bin_size", "tag").agg(F.min_by("file", "ord").alias("peak"))
    rest = shapes.join(named.select(F.col("shape").alias("file")), "file", "left_anti").join(first, ["bin_size", "tag"])
    return named.unionByName(rest.select(F.col("file").alias("shape"), "peak", F.lit("tag").alias("by")))


def across_sizes(catalogs: DataFrame) -> DataFrame:
    """file, other, bin_size, other_size: catalogs of one kind, algorithm and tag at two bin sizes."""
    keys = ["kind", "algo", "tag"]
    one = catalogs.groupBy(*keys, "bin_size").agg(F.min_by("file", "ord").alias("file"))
    two = one.select(*keys, F.col("bin_size").alias("other_size"), F.col("file").alias("other"))
    return one.join(two, keys).filter("bin_size <> other_size").select("file", "other", "bin_size", "other_size")


def inferred_source(shapes: DataFrame, peaks: DataFrame, raw: str = "rawgrid") -> DataFrame:
    """shape, peak: of the peak catalogs of a size, the first whose tag is part of the shape's tag, else the first untagged one that isn't raw."""
    first = peaks.groupBy("bin_size", "tag", "algo").agg(F.min("ord").alias("ord"), F.min_by("file", "ord").alias("peak"))
    both = shapes.select("file", "bin_size", F.col("tag").alias("want")).join(first, "bin_size")
    hit = (F.col("tag") != "") & F.contains("want", F.col("tag"))
    spare = (F.col("tag") == "") & (F.col("algo") != raw)
    ranked = both.withColumn("rank", F.when(hit, 0).when(spare, 1)).filter("rank is not null")
    return ranked.groupBy(F.col("file").alias("shape")).agg(F.min_by("peak", F.struct("rank", "ord")).alias("peak"))


def best_grid(catalogs: DataFrame, grids: DataFrame) -> DataFrame:
    """catalog, grid, covered: the grid whose cells hold most of a catalog's cells; the first wins ties."""
    held = catalogs.select("catalog", "brow", "bcol").distinct().join(grids.select("grid", "brow", "bcol").distinct(), ["brow", "bcol"])
    count = held.groupBy("catalog", "grid").agg(F.count("*").alias("covered"))
    best = F.min(F.struct((-F.col("covered")).alias("v"), "grid")).alias("b")
    return count.groupBy("catalog").agg(best).select("catalog", F.col("b.grid").alias("grid"), (-F.col("b.v")).alias("covered"))


def nearest_feature(points: DataFrame, features: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """point, feature_id, distance: the nearest feature within radius of each point of the same keys; the least id wins ties.

    Candidates meet in cells of the radius, a point in its cell and the eight around.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    p = points.select(*keys, "point", F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("gx0"), cell("y").alias("gy0"))
    p = p.select("*", near.alias("dx")).select("*", near.alias("dy")).withColumn("gx", F.col("gx0") + F.col("dx")).withColumn("gy", F.col("gy0") + F.col("dy"))
    f = features.select(*keys, "feature_id", "x", "y", cell("x").alias("gx"), cell("y").alias("gy"))
    apart = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    met = p.join(f, [*keys, "gx", "gy"]).withColumn("distance", apart).filter(F.col("distance") <= radius)
    best = F.min(F.struct("distance", "feature_id")).alias("b")
    return met.groupBy("point").agg(best).select("point", "b.feature_id", "b.distance")


def fine_fill(coarse: DataFrame, fine: DataFrame, n: int, pad: int) -> DataFrame:
    """feature_id, brow, bcol, value: fine cells of the same scan and reflection in the padded box of n by n cells of a coarse one; the maximum counts."""
    span = lambda c: F.explode(F.sequence(F.col(c) * n - pad, F.col(c) * n + n - 1 + pad))
    cells = coarse.select("scan", "reflection", "feature_id", "crow", "ccol", span("crow").alias("brow")).select("*", span("ccol").alias("bcol"))
    top = fine.groupBy("scan", "reflection", "brow", "bcol").agg(F.max("value").alias("value"))
    return cells.join(top, ["scan", "reflection", "brow", "bcol"]).groupBy("feature_id", "brow", "bcol").agg(F.max("value").alias("value"))


def scan_report(features: DataFrame, tracks: DataFrame, min_tracks: int = 1) -> DataFrame:
    """Per scan: features, reflections, those in recurrent tracks, and a verdict."""
    back = tracks.filter("n_theta > 1").select("track")
    marked = features.join(back.withColumn("_back", F.lit(1)), "track", "left")
    out = marked.groupBy("scan").agg(F.count("*").alias("n_features"), F.countDistinct("reflection").alias("n_reflections"), F.count("_back").alias("n_recurrent"))
    verdict = F.when(F.col("n_recurrent") == F.col("n_features"), "stable").when(F.col("n_recurrent") >= min_tracks, "mixed").otherwise("transient")
    return out.withColumn("verdict", verdict)


def noise_scaling(images: DataFrame, sizes: list[int]) -> DataFrame:
    """bin_size, signal, noise and their ratios to the first size: the 99.5th percentile and the scaled median deviation
    of each image whose pixels are means of n by n, medians over images.
    """
    size = F.explode(F.array(*[F.lit(n) for n in sizes])).alias("bin_size")
    reduced = images.select("*", size).groupBy("bin_size", "gi", F.floor(F.col("y") / F.col("bin_size")).alias("r"), F.floor(F.col("x") / F.col("bin_size")).alias("c")).agg(F.avg("v").alias("v"))
    mid = reduced.groupBy("bin_size", "gi").agg(F.median("v").alias("mid"), F.percentile("v", F.lit(0.995)).alias("top"))
    spread = reduced.join(mid, ["bin_size", "gi"]).groupBy("bin_size", "gi").agg((1.4826 * F.median(F.abs(F.col("v") - F.col("mid")))).alias("noise"), F.max("top").alias("top"))
    out = spread.groupBy("bin_size").agg(F.median("top").alias("signal"), F.median("noise").alias("noise"))
    # one row a bin size
    first = Window.partitionBy(F.lit(0)).orderBy("bin_size")
    return out.withColumn("signal_ratio", F.try_divide("signal", F.first("signal").over(first))).withColumn("noise_ratio", F.try_divide("noise", F.first("noise").over(first)))


def mean_offset(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean offset of matched places and its length, a group."""
    dx, dy = F.avg(F.col("x2") - F.col("x1")), F.avg(F.col("y2") - F.col("y1"))
    return pairs.groupBy(*keys).agg(dx.alias("dx"), dy.alias("dy"), F.count("*").alias("n")).withColumn("length", F.hypot("dx", "dy"))


def aperture_sums(centres: DataFrame, pixels: DataFrame, half: int) -> DataFrame:
    """feature_id, gi, net, n: sum over the window around a centre less the image's median for each of its pixels."""
    low = pixels.groupBy("gi").agg(F.median("v").alias("background"))
    span = lambda c: F.explode(F.sequence(F.col(c) - half, F.col(c) + half))
    window = centres.select("gi", "feature_id", "cx", span("cy").alias("y")).select("gi", "feature_id", "y", span("cx").alias("x"))
    met = window.join(pixels.select("gi", "y", "x", "v"), ["gi", "y", "x"]).join(low, "gi")
    return met.groupBy("feature_id", "gi").agg(F.sum(F.col("v") - F.col("background")).alias("net"), F.count("*").alias("n"))


def supplement(have: DataFrame, extra: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """have, and those rows of extra (same columns: keys, id, x, y) that are further than reach from all of have in their group."""
    cell = lambda c: F.floor(F.col(c) / reach)
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    wide = extra.select(*keys, "id", "x", "y", near.alias("dx")).select("*", near.alias("dy")).withColumn("gx", cell("x") + F.col("dx")).withColumn("gy", cell("y") + F.col("dy"))
    old = have.select(*keys, F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("gx"), cell("y").alias("gy"))
    close = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 <= reach * reach
    covered = wide.join(old, [*keys, "gx", "gy"]).filter(close).select("id").distinct()
    return have.withColumn("added", F.lit(False)).unionByName(extra.join(covered, "id", "left_anti").withColumn("added", F.lit(True)))


def prediction_report(features: DataFrame, first: str, second: str, tolerance: float, substrate: list[str]) -> DataFrame:
    """section, item, metric and value: a study of tracked features over scans, assembled.

    features: scan, theta, reflection, track, feature_id, center_row, center_col, chi_deg, peak_intensity.
    Sections are scans (features of each), predicted (sampled angles inside recurrent tracks, those observed,
    gaps and recall), repeatability (features of two scans of one orientation, matched one by one within
    tolerance, and 2 m / (a + b)), retention by reflection, angles, rocking, and verdict: recall against
    repeatability, 1 if it reaches it, 0 if not, null without either.
    """
    summary = cut(study.track_summary(features, ["track"], ["theta", "feature_id"]))
    seen = study.predicted_vs_observed(features, summary, features.select("theta"), ["track"])
    predicted = seen.agg(*[F.sum(c).cast("double").alias(c) for c in ("expected", "observed", "gaps")]).withColumn("recall", F.try_divide("observed", "expected"))
    place = ["reflection", "feature_id", "center_row", "center_col"]
    a, b = (features.filter(F.col("scan") == s).select(*place) for s in (first, second))
    pairs = spatial.distance_join(a, b, tolerance, ("reflection",), ("center_row", "center_col"))
    matched = spatial.serial_match(pairs.select(F.col("feature_id").alias("i"), F.col("r_feature_id").alias("j"), "d"), later_wins=True)
    sizes = features.agg(F.count_if(F.col("scan") == first).cast("double").alias("first"), F.count_if(F.col("scan") == second).cast("double").alias("second"))
    repeat = cut(sizes.crossJoin(matched.agg(F.count("*").cast("double").alias("matched"))).withColumn("reproducibility", F.try_divide(2 * F.col("matched"), F.col("first") + F.col("second"))))
    predicted = cut(predicted)
    steps = summary.agg(upper_median("chi_max_step").cast("double").alias("median_step"))
    rocking = study.rocking_summary(summary, ["max_intensity"])
    kept = study.retention(features, first, second, substrate)
    verdict = predicted.crossJoin(repeat).select(F.when(F.col("recall") >= F.col("reproducibility"), 1.0).when(F.col("recall") < F.col("reproducibility"), 0.0).alias("meets_floor"))

    def long(df: DataFrame, section: str, metrics: list[str], item: str | None = None) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
        return df.select(F.lit(section).alias("section"), (F.lit("all") if item is None else F.col(item)).alias("item"), cells.alias("c")).select("section", "item", "c.*")

    parts = [
        long(features.groupBy("scan").agg(F.count("*").alias("features")), "scans", ["features"], "scan"), long(predicted, "predicted", ["expected", "observed", "gaps", "recall"]),
        long(repeat, "repeatability", ["first", "second", "matched", "reproducibility"]), long(kept, "retention", ["n_first", "n_second", "retention"], "reflection"), long(steps, "angles", ["median_step"]),
        long(rocking, "rocking", ["max_intensity_n", "max_intensity_min", "max_intensity_median", "max_intensity_max"]), long(verdict, "verdict", ["meets_floor"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
