"""Queries of selections, catalog lineage and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import report, select
from gridloom.plans.registry import register
from gridloom.plans.study_queries import QMAP, SUMMARY, TRACK, qmap, r6, tracked
from gridloom.sources import adapters as A

oracle = A.oracle

CATALOG = """cat AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'peaks' ELSE 'shapes' END AS kind, event_type AS algo, CASE WHEN user_id % 4 = 0 THEN '' ELSE 't' || user_id % 7 END AS tag,
  1 + hour(ts)::BIGINT % 5 AS bin_size, 'f' || event_id AS file, CASE WHEN event_id % 3 = 0 THEN 'f' || (event_id - 1) END AS source, event_id AS ord FROM events)"""


def catalogs(spark, sf_dir) -> DataFrame:
    """Events as catalog files: kind, algorithm, tag, bin size, file, the recorded source and an order."""
    e = A.table(spark, sf_dir, "events")
    file = lambda c: F.concat(F.lit("f"), c.cast("string"))
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "peaks").otherwise("shapes").alias("kind"), F.col("event_type").alias("algo"), F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string"))).alias("tag"),
        (1 + F.hour("ts").cast("bigint") % 5).alias("bin_size"), file(F.col("event_id")).alias("file"), F.when(F.col("event_id") % 3 == 0, file(F.col("event_id") - 1)).alias("source"), F.col("event_id").alias("ord"),
    )


@register("b5_catalog_rows", oracle(f"WITH {CATALOG} SELECT bin_size, kind, count(*) AS n, min(ord) AS first_ord FROM (SELECT algo AS scan, * FROM cat) WHERE scan IN ('click', 'view', 'purchase') AND bin_size IN (1, 3, 5) GROUP BY ALL"))
def catalog_rows(spark, sf_dir):
    rows = select.catalog_rows(catalogs(spark, sf_dir).withColumn("scan", F.col("algo")), ["click", "view", "purchase"], [1, 3, 5])
    return rows.groupBy("bin_size", "kind").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@register("b6_prepared_features", oracle("SELECT feature_id, (regexp_extract(scan, '(\\d+)', 1)::INT - 1) * 0.5::DOUBLE AS theta, round(coalesce(CASE WHEN feature_id % 3 > 0 THEN sum_integrated END, CASE WHEN feature_id % 2 > 0 THEN peak_intensity END, mean_intensity), 6) AS intensity FROM features WHERE regexp_extract(scan, '(\\d+)', 1)::INT % 4 > 0 AND prow > 0", "features"))
def prepared(spark, sf_dir):
    f = A.features(spark, sf_dir)
    blank = lambda c, m: F.when(F.col("feature_id") % m > 0, F.col(c))
    f = f.drop("theta").withColumn("sum_integrated", blank("sum_integrated", 3)).withColumn("peak_intensity", blank("peak_intensity", 2)).withColumn("center_row", F.when(F.col("prow") > 0, F.col("center_row")))
    number = F.regexp_extract("scan", r"(\d+)", 1).cast("int")
    thetas = A.device_map(spark, sf_dir).select("scan").distinct().select("scan", F.when(number % 4 > 0, (number - 1) * 0.5).cast("double").alias("theta"))
    return r6(select.prepared(f, thetas).select("feature_id", "theta", "intensity"), "intensity")


@register("b15_shift_metric", oracle("SELECT feature_id, round(detector_x / 8 - two_theta, 6) AS shift, round(detector_x / 8 * 1.01::DOUBLE + 0.25::DOUBLE, 6) AS calibrated FROM features JOIN reflections USING (reflection)", "features", "reflections"))
def shift_metric(spark, sf_dir):
    """Angle shifts of features from their reflections, and recalibrated angles (B24)."""
    f = A.features(spark, sf_dir).withColumn("tth", F.col("detector_x") / 8).join(A.reflections(spark, sf_dir), "reflection")
    return r6(f.select("feature_id", select.shift_metric("tth", "two_theta").alias("shift"), select.calibrated(F.col("tth"), 1.01, 0.25).alias("calibrated")), "shift", "calibrated")


REASON = "CASE feature_id % 6 WHEN 0 THEN 'Isolated: one bin' WHEN 1 THEN 'non-Gaussian profile' WHEN 2 THEN 'ok' WHEN 3 THEN 'flat' WHEN 4 THEN 'not flat' END"


@register("b16_kept_split", oracle(f"SELECT scan, kept, count(*) AS n FROM (SELECT scan, coalesce(NOT regexp_matches(lower({REASON}), '^(non-gaussian|isolated|flat|non-positive)'), true) AS kept FROM features) GROUP BY ALL", "features"))
def kept_split(spark, sf_dir):
    f = A.features(spark, sf_dir).select("scan", select.kept(F.expr(REASON)).alias("kept"))
    return f.groupBy("scan", "kept").agg(F.count("*").alias("n"))


BINS = "bins AS (SELECT scan, brow, bcol, count_if(integrated > 50) AS n, bool_or(ord % 3 = 0) AS reviewed FROM device_map GROUP BY ALL)"


@register("b19_verified_bins", oracle(f"WITH {BINS} SELECT scan, brow, bcol, n, n = 0 AS empty, n > 0 AS labelled FROM bins WHERE reviewed", "device_map"))
def verified_bins(spark, sf_dir):
    bins = A.device_map(spark, sf_dir).groupBy("scan", "brow", "bcol").agg(F.count_if(F.col("integrated") > 50).alias("n"), F.bool_or(F.col("ord") % 3 == 0).alias("reviewed"))
    return select.verified_bins(bins)


@register("b20_peak_annotations", oracle("SELECT scan, brow, bcol, list_sort(list(DISTINCT [y, x])) AS places FROM peaks GROUP BY ALL", "peaks"))
def peak_annotations(spark, sf_dir):
    return select.peak_annotations(A.peaks(spark, sf_dir))


@register("b23_every_kth_bin", oracle("SELECT scan, brow, bcol FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY brow, bcol) - 1 AS k FROM (SELECT DISTINCT scan, brow, bcol FROM device_map)) WHERE k % 7 = 0 AND k < 280", "device_map"))
def every_kth(spark, sf_dir):
    """Every seventh occupied bin of a scan, numerically ordered (F4), up to forty."""
    return select.every_kth(A.device_map(spark, sf_dir).select("scan", "brow", "bcol").distinct(), ["scan"], ["brow", "bcol"], 7, 40)


@register("f5_galleries", oracle("SELECT label, place, intensity, snr FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY snr, intensity DESC, k1, k2, k3, scan) AS place FROM peaks) WHERE place <= 20", "peaks"))
def galleries(spark, sf_dir):
    order = [F.col("snr"), F.col("intensity").desc(), *map(F.col, ("k1", "k2", "k3", "scan"))]
    return select.gallery(A.peaks(spark, sf_dir), ["label"], order, 20).select("label", "place", "intensity", "snr")


@register("f6_brightest_bin", oracle("SELECT scan, brow, bcol, total FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY total DESC, brow, bcol) AS k FROM (SELECT scan, brow, bcol, round(sum(integrated), 4) AS total FROM device_map WHERE det_x BETWEEN 20 AND 60 GROUP BY ALL)) WHERE k = 1", "device_map"))
def brightest_bin(spark, sf_dir):
    sums = A.device_map(spark, sf_dir).filter("det_x between 20 and 60").groupBy("scan", "brow", "bcol").agg(F.round(F.sum("integrated"), 4).alias("total"))
    return select.brightest(sums, ["scan"], ["brow", "bcol"], "total")


@register("f7_best_frame", oracle("SELECT brow, bcol, gi, top FROM (SELECT *, row_number() OVER (PARTITION BY brow, bcol ORDER BY top DESC, gi) AS k FROM (SELECT gi // 20 AS brow, gi % 4 AS bcol, gi, round(max(v), 6) AS top FROM pixels WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY gi)) WHERE k = 1", "pixels"))
def best_frame(spark, sf_dir):
    """The frame of the largest window maximum in each footprint."""
    inside = A.pixels(spark, sf_dir).filter("y between 2 and 5 and x between 2 and 5")
    tops = inside.groupBy("gi").agg(F.round(F.max("v"), 6).alias("top")).select(F.expr("gi div 20").alias("brow"), (F.col("gi") % 4).alias("bcol"), "gi", "top")
    return select.brightest(tops, ["brow", "bcol"], ["gi"], "top")


SCORES = "sc AS (SELECT label AS algorithm, CASE WHEN scan = 5 THEN 6 ELSE scan END AS bin_size, round(avg(snr) / 20, 4) AS f1 FROM peaks WHERE scan NOT IN (2, 4) GROUP BY ALL)"


@register("f3_leaderboard", oracle(f"""WITH {SCORES}, ok AS (SELECT * FROM sc WHERE algorithm <> 'RF'), sizes AS (SELECT DISTINCT scan AS bin_size FROM peaks),
c AS (SELECT z.bin_size, 0 AS fallback, algorithm, f1 FROM sizes z JOIN ok USING (bin_size) UNION ALL SELECT z.bin_size, 1, algorithm, f1 FROM sizes z, ok WHERE ok.bin_size = 3 UNION ALL SELECT z.bin_size, 2, algorithm, f1 FROM sizes z, ok)
SELECT bin_size, algorithm, f1, fallback FROM c QUALIFY row_number() OVER (PARTITION BY bin_size ORDER BY fallback, f1 DESC, algorithm) = 1""", "peaks"))
def leaderboard(spark, sf_dir):
    p = A.peaks(spark, sf_dir)
    scores = p.filter("scan not in (2, 4)").groupBy(F.col("label").alias("algorithm"), F.when(F.col("scan") == 5, 6).otherwise(F.col("scan")).alias("bin_size")).agg(F.round(F.avg("snr") / 20, 4).alias("f1"))
    return select.leaderboard(scores, p.select(F.col("scan").alias("bin_size")).distinct(), 3, ["RF"])


@register("h4_variant_names", oracle("SELECT DISTINCT label || '__sens' || replace(printf('%.1f', round(snr, 1)), '.', 'p') || CASE WHEN scan % 2 = 0 THEN '' ELSE '__nr' END AS name FROM peaks", "peaks"))
def variant_names(spark, sf_dir):
    return A.peaks(spark, sf_dir).select(select.variant_name(F.col("label"), F.round("snr", 1), F.col("scan") % 2 == 0).alias("name")).distinct()


@register("c18_shape_lineage", oracle(f"""WITH {CATALOG}, p AS (SELECT * FROM cat WHERE kind = 'peaks'), s AS (SELECT * FROM cat WHERE kind = 'shapes'), n AS (SELECT s.file AS shape, p.file AS peak, 'source' AS "by" FROM s JOIN p ON p.file = s.source)
SELECT * FROM n UNION ALL SELECT s.file, q.peak, 'tag' FROM s JOIN (SELECT bin_size, tag, arg_min(file, ord) AS peak FROM p GROUP BY ALL) q USING (bin_size, tag) WHERE s.file NOT IN (SELECT shape FROM n)"""))
def shape_lineage(spark, sf_dir):
    c = catalogs(spark, sf_dir)
    return report.lineage(c.filter("kind = 'shapes'"), c.filter("kind = 'peaks'"))


@register("c19_across_sizes", oracle(f"WITH {CATALOG}, o AS (SELECT kind, algo, tag, bin_size, arg_min(file, ord) AS file FROM cat GROUP BY ALL) SELECT a.file, b.file AS other, a.bin_size, b.bin_size AS other_size FROM o a JOIN o b USING (kind, algo, tag) WHERE a.bin_size <> b.bin_size"))
def across_sizes(spark, sf_dir):
    return report.across_sizes(catalogs(spark, sf_dir))


@register("c20_inferred_source", oracle(f"""WITH {CATALOG}, p AS (SELECT bin_size, tag, algo, min(ord) AS ord, arg_min(file, ord) AS peak FROM cat WHERE kind = 'peaks' GROUP BY ALL), s AS (SELECT file, bin_size, algo || '_' || tag || '_x' AS want FROM cat WHERE kind = 'shapes'),
r AS (SELECT s.file AS shape, p.peak, p.ord, CASE WHEN tag <> '' AND contains(want, tag) THEN 0 WHEN tag = '' AND algo <> 'click' THEN 1 END AS rank FROM s JOIN p USING (bin_size))
SELECT shape, peak FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY shape ORDER BY rank, ord) = 1"""))
def inferred_source(spark, sf_dir):
    c = catalogs(spark, sf_dir)
    shapes = c.filter("kind = 'shapes'").withColumn("tag", F.concat("algo", F.lit("_"), "tag", F.lit("_x")))
    return report.inferred_source(shapes, c.filter("kind = 'peaks'"), "click")


@register("c21_best_grid", oracle("""WITH cells AS (SELECT DISTINCT scan, brow, bcol FROM device_map), n AS (SELECT a.scan AS catalog, b.scan AS grid, count(*) AS covered FROM cells a JOIN cells b USING (brow, bcol) GROUP BY ALL)
SELECT catalog, grid, covered FROM n QUALIFY row_number() OVER (PARTITION BY catalog ORDER BY covered DESC, grid) = 1""", "device_map"))
def best_grid(spark, sf_dir):
    """For each scan's catalog, the scan whose grid holds most of its cells; earlier scans win ties."""
    cells = A.device_map(spark, sf_dir).select("scan", "brow", "bcol").distinct()
    return report.best_grid(cells.withColumnRenamed("scan", "catalog"), cells.withColumnRenamed("scan", "grid"))


@register("c25_nearest_feature", oracle("""WITH q AS (SELECT ord AS point, scan, reflection, det_x::DOUBLE AS px, det_y::DOUBLE AS py FROM device_map)
SELECT point, feature_id, round(d, 6) AS distance FROM (SELECT point, feature_id, sqrt((detector_x - px) * (detector_x - px) + (detector_y - py) * (detector_y - py)) AS d FROM q JOIN features USING (scan, reflection)) WHERE d <= 25 QUALIFY row_number() OVER (PARTITION BY point ORDER BY d, feature_id) = 1""", "features"))
def nearest_feature(spark, sf_dir):
    points = A.device_map(spark, sf_dir).select("scan", "reflection", F.col("ord").alias("point"), F.col("det_x").cast("double").alias("x"), F.col("det_y").cast("double").alias("y"))
    found = A.features(spark, sf_dir).select("scan", "reflection", "feature_id", F.col("detector_x").alias("x"), F.col("detector_y").alias("y"))
    return r6(report.nearest_feature(points, found, 25.0, ["scan", "reflection"]), "distance")


@register("c27_fine_fill", oracle("""WITH c AS (SELECT scan, reflection, feature_id, prow, pcol FROM features), t AS (SELECT scan, reflection, brow, bcol, max(integrated) AS value FROM device_map GROUP BY ALL)
SELECT feature_id, brow, bcol, round(max(value), 6) AS value FROM c JOIN t USING (scan, reflection) WHERE brow BETWEEN prow * 5 - 1 AND prow * 5 + 5 AND bcol BETWEEN pcol * 5 - 1 AND pcol * 5 + 5 GROUP BY ALL""", "device_map", "features"))
def fine_fill(spark, sf_dir):
    coarse = A.features(spark, sf_dir).select("scan", "reflection", "feature_id", F.col("prow").alias("crow"), F.col("pcol").alias("ccol"))
    return r6(report.fine_fill(coarse, A.device_map(spark, sf_dir).withColumn("value", F.col("integrated")), 5, 1), "value")


@register("d30_scan_report", oracle(f"""WITH {TRACK}, tr AS (SELECT track, count(DISTINCT theta) AS n_theta FROM tk GROUP BY track), r AS (SELECT scan, count(*) AS n_features, count(DISTINCT reflection) AS n_reflections, count_if(n_theta > 1) AS n_recurrent FROM tk JOIN tr USING (track) GROUP BY scan)
SELECT *, CASE WHEN n_recurrent = n_features THEN 'stable' WHEN n_recurrent >= 1 THEN 'mixed' ELSE 'transient' END AS verdict FROM r""", "features"))
def scan_report(spark, sf_dir):
    t = tracked(spark, sf_dir)
    return report.scan_report(t, t.groupBy("track").agg(F.countDistinct("theta").alias("n_theta")))


@register("d42_noise_scaling", oracle("""WITH z AS (SELECT unnest([1, 2, 4])::INT AS bin_size), r AS (SELECT bin_size, gi, y // bin_size AS r, x // bin_size AS c, avg(v) AS v FROM pixels, z GROUP BY ALL), m AS (SELECT bin_size, gi, median(v) AS mid, quantile_cont(v, 0.995) AS top FROM r GROUP BY ALL),
s AS (SELECT bin_size, gi, 1.4826::DOUBLE * median(abs(v - mid)) AS noise, max(top) AS top FROM r JOIN m USING (bin_size, gi) GROUP BY ALL), o AS (SELECT bin_size, median(top) AS signal, median(noise) AS noise FROM s GROUP BY ALL)
SELECT bin_size, round(signal, 6) AS signal, round(noise, 6) AS noise, round(signal / first_value(signal) OVER w, 6) AS signal_ratio, round(noise / first_value(noise) OVER w, 6) AS noise_ratio FROM o WINDOW w AS (ORDER BY bin_size)""", "pixels"))
def noise_scaling(spark, sf_dir):
    return r6(report.noise_scaling(A.pixels(spark, sf_dir), [1, 2, 4]), "signal", "noise", "signal_ratio", "noise_ratio")


@register("d50_mean_offset", oracle("SELECT reflection, round(avg(center_col - pcol * 4.0::DOUBLE), 6) AS dx, round(avg(center_row - prow * 5.0::DOUBLE), 6) AS dy, count(*) AS n, round(sqrt(avg(center_col - pcol * 4.0::DOUBLE)**2 + avg(center_row - prow * 5.0::DOUBLE)**2), 6) AS length FROM features GROUP BY reflection", "features"))
def mean_offset(spark, sf_dir):
    pairs = A.features(spark, sf_dir).select("reflection", (F.col("pcol") * 4.0).alias("x1"), (F.col("prow") * 5.0).alias("y1"), F.col("center_col").alias("x2"), F.col("center_row").alias("y2"))
    return r6(report.mean_offset(pairs, ["reflection"]), "dx", "dy", "length")


def brightest_pixels(p: DataFrame) -> DataFrame:
    best = F.struct("v", -F.col("y"), -F.col("x"))
    return p.groupBy("gi").agg(F.max(F.col("gi") * 10 + F.col("label")).alias("feature_id"), F.max_by("y", best).alias("cy"), F.max_by("x", best).alias("cx"), F.max("v").alias("top"))


@register("d54_aperture_sums", oracle("""WITH c AS (SELECT gi, any_value(gi * 10 + label) AS feature_id, arg_max(y, row(v, -y, -x)) AS cy, arg_max(x, row(v, -y, -x)) AS cx FROM pixels GROUP BY gi), b AS (SELECT gi, median(v) AS background FROM pixels GROUP BY gi)
SELECT feature_id, gi, round(sum(v - background), 5) AS net, count(*) AS n FROM c JOIN pixels USING (gi) JOIN b USING (gi) WHERE abs(y - cy) <= 2 AND abs(x - cx) <= 2 GROUP BY ALL""", "pixels"))
def aperture_sums(spark, sf_dir):
    """Windows around the brightest pixel of every frame."""
    p = A.pixels(spark, sf_dir)
    return report.aperture_sums(brightest_pixels(p), p, 2).withColumn("net", F.round("net", 5))


@register("d56_component_counts", oracle("SELECT scan, count_if(n_bins = 1) AS n_single, count_if(n_bins > 1) AS n_multi FROM features GROUP BY scan", "features"))
def component_counts(spark, sf_dir):
    return A.features(spark, sf_dir).groupBy("scan").agg(F.count_if(F.col("n_bins") == 1).alias("n_single"), F.count_if(F.col("n_bins") > 1).alias("n_multi"))


@register("d60_footprint_fidelity", oracle("""WITH c AS (SELECT gi, any_value(label) AS label, arg_max(y, row(v, -y, -x)) AS cy, arg_max(x, row(v, -y, -x)) AS cx, max(v) AS top FROM pixels GROUP BY gi), b AS (SELECT gi, median(v) AS background FROM pixels GROUP BY gi),
m AS (SELECT gi, any_value(c.label) AS label, any_value(top) AS top, sum(v - background) AS net FROM c JOIN pixels USING (gi) JOIN b USING (gi) WHERE abs(y - cy) <= 1 AND abs(x - cx) <= 1 GROUP BY gi)
SELECT label, round(corr(net, top), 6) AS fidelity, count(*) AS n FROM m GROUP BY label""", "pixels"))
def footprint_fidelity(spark, sf_dir):
    """Correlation of net sums measured around each frame's brightest pixel with its stored intensity, by label."""
    p = A.pixels(spark, sf_dir)
    stored = brightest_pixels(p)
    both = report.aperture_sums(stored, p, 1).join(stored.select("gi", "top"), "gi").join(p.select("gi", "label").distinct(), "gi")
    return r6(both.groupBy("label").agg(F.corr("net", "top").alias("fidelity"), F.count("*").alias("n")), "fidelity")


@register("g1_union_of_catalogs", oracle("SELECT scan, source, count(*) AS n, round(sum(intensity), 2) AS total FROM (SELECT scan::VARCHAR AS scan, 'peaks' AS source, intensity FROM peaks UNION ALL SELECT scan, 'features', peak_intensity FROM features) GROUP BY ALL", "peaks", "features"))
def union_of_catalogs(spark, sf_dir):
    one = A.peaks(spark, sf_dir).select(F.col("scan").cast("string").alias("scan"), F.lit("peaks").alias("source"), "intensity")
    two = A.features(spark, sf_dir).select("scan", F.lit("features").alias("source"), F.col("peak_intensity").alias("intensity"))
    return one.unionByName(two).groupBy("scan", "source").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 2).alias("total"))


@register("g4_common_reflections", oracle("SELECT bcol, reflection FROM device_map WHERE ord % 2 = 0 INTERSECT SELECT bcol, reflection FROM device_map WHERE integrated > 150", "device_map"))
def common_reflections(spark, sf_dir):
    d = A.device_map(spark, sf_dir)
    return d.filter("ord % 2 = 0").select("bcol", "reflection").intersect(d.filter("integrated > 150").select("bcol", "reflection"))


@register("g6_supplement", oracle("""WITH h AS (SELECT scan, ord AS id, det_x::DOUBLE AS x, det_y::DOUBLE AS y FROM device_map WHERE ord % 5 = 0), e AS (SELECT scan, ord AS id, det_x::DOUBLE AS x, det_y::DOUBLE AS y FROM device_map WHERE ord % 5 = 1)
SELECT *, false AS added FROM h UNION ALL SELECT *, true FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.scan = e.scan AND (h.x - e.x) * (h.x - e.x) + (h.y - e.y) * (h.y - e.y) <= 9)""", "device_map"))
def supplement(spark, sf_dir):
    d = A.device_map(spark, sf_dir).select("scan", F.col("ord").alias("id"), F.col("det_x").cast("double").alias("x"), F.col("det_y").cast("double").alias("y"))
    return report.supplement(d.filter("id % 5 = 0"), d.filter("id % 5 = 1"), 3.0, ["scan"])


@register("a14_peaks_as_features", oracle("SELECT scan, k1, k2, k3, x, y, round(intensity, 2) AS peak_intensity, 1 AS n_bins, brow AS center_row, bcol AS center_col FROM peaks", "peaks"))
def peaks_as_features(spark, sf_dir):
    """Raw peaks as features of a single bin."""
    return A.peaks(spark, sf_dir).select("scan", "k1", "k2", "k3", "x", "y", F.round("intensity", 2).alias("peak_intensity"), F.lit(1).alias("n_bins"), F.col("brow").alias("center_row"), F.col("bcol").alias("center_col"))


@register("a34_records_by_size", oracle("SELECT z.n AS bin_size, label, count(*) AS n, round(avg(intensity), 4) AS intensity, round(avg(snr), 6) AS snr FROM (SELECT n, label, brow // n AS r, bcol // n AS c, x, y, max(intensity) AS intensity, max(snr) AS snr FROM peaks, (SELECT unnest([1, 3, 5])::INT AS n) GROUP BY ALL) z GROUP BY ALL", "peaks"))
def records_by_size(spark, sf_dir):
    size = F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("bin_size")
    rows = A.peaks(spark, sf_dir).select("*", size).groupBy("bin_size", "label", F.expr("brow div bin_size").alias("r"), F.expr("bcol div bin_size").alias("c"), "x", "y").agg(F.max("intensity").alias("intensity"), F.max("snr").alias("snr"))
    return rows.groupBy("bin_size", "label").agg(F.count("*").alias("n"), F.round(F.avg("intensity"), 4).alias("intensity"), F.round(F.avg("snr"), 6).alias("snr"))


@register("b11_clipped_window", oracle("SELECT gi, label, greatest(gi % 8 - 2, 0)::BIGINT AS y0, least(gi % 8 + 2, 7)::BIGINT AS y1, greatest(gi % 5 - 2, 0)::BIGINT AS x0, least(gi % 5 + 2, 7)::BIGINT AS x1, round(sum(v), 5) AS total FROM pixels WHERE abs(y - gi % 8) <= 2 AND abs(x - gi % 5) <= 2 GROUP BY gi, label", "pixels"))
def clipped_window(spark, sf_dir):
    p = A.pixels(spark, sf_dir).withColumn("w", select.clipped_window(F.col("gi") % 8, F.col("gi") % 5, 2, 8, 8))
    return p.filter("y between w.y0 and w.y1 and x between w.x0 and w.x1").groupBy("gi", "label", "w.y0", "w.y1", "w.x0", "w.x1").agg(F.round(F.sum("v"), 5).alias("total"))


@register("d59_qmap_summary", oracle(f"WITH {QMAP} SELECT gi % 4 AS scan, round(min(qx), 6) AS qx_min, round(max(qx), 6) AS qx_max, round(min(qz), 6) AS qz_min, round(max(qz), 6) AS qz_max, count(*) AS n FROM qm GROUP BY gi % 4", "pixels"))
def qmap_summary(spark, sf_dir):
    q = qmap(spark, sf_dir)
    ends = [F.round(f(c), 6).alias(f"{c}_{name}") for c in ("qx", "qz") for f, name in ((F.min, "min"), (F.max, "max"))]
    return q.groupBy((F.col("gi") % 4).alias("scan")).agg(*ends, F.count("*").alias("n"))


@register("d63_summed_frames", oracle("SELECT label AS gallery, y, x, round(sum(v), 5) + 0.0::DOUBLE AS v, count(*) AS n_frames FROM pixels WHERE gi % 3 > 0 GROUP BY ALL", "pixels"))
def summed_frames(spark, sf_dir):
    """Sum images of the frames chosen for each gallery."""
    p = A.pixels(spark, sf_dir)
    chosen = p.filter("gi % 3 > 0").select(F.col("label").alias("gallery"), "gi")
    return select.summed_frames(p.drop("label"), chosen).withColumn("v", F.round("v", 5) + F.lit(0.0))


@register("d30_prediction_report", oracle(f"""
WITH RECURSIVE {SUMMARY}, pe AS (SELECT track, t.theta FROM ts JOIN (SELECT DISTINCT theta FROM features) t ON t.theta BETWEEN theta_min - 1e-9 AND theta_max + 1e-9 WHERE recurrent),
pp AS (SELECT count(*)::DOUBLE AS expected, count(seen)::DOUBLE AS observed FROM pe LEFT JOIN (SELECT DISTINCT track, theta, 1 AS seen FROM tk) USING (track, theta)),
o AS MATERIALIZED (SELECT a.reflection, a.feature_id AS i, b.feature_id AS j, row_number() OVER (PARTITION BY a.reflection ORDER BY a.feature_id, sqrt((a.center_row - b.center_row) ** 2 + (a.center_col - b.center_col) ** 2), b.feature_id DESC) AS n
  FROM features a JOIN features b ON a.scan = 'Scan_0001' AND b.scan = 'Scan_0002' AND a.reflection = b.reflection AND (a.center_row - b.center_row) ** 2 + (a.center_col - b.center_col) ** 2 <= 4),
g(reflection, n, li, lj) AS (SELECT DISTINCT reflection, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM o UNION ALL
  SELECT g.reflection, g.n + 1, CASE WHEN NOT list_contains(li, o.i) AND NOT list_contains(lj, o.j) THEN list_append(li, o.i) ELSE li END, CASE WHEN NOT list_contains(li, o.i) AND NOT list_contains(lj, o.j) THEN list_append(lj, o.j) ELSE lj END FROM g JOIN o ON o.reflection = g.reflection AND o.n = g.n + 1),
rp AS (SELECT count_if(scan = 'Scan_0001')::DOUBLE AS a, count_if(scan = 'Scan_0002')::DOUBLE AS b, (SELECT coalesce(sum(len(l)), 0)::DOUBLE FROM (SELECT arg_max(li, n) AS l FROM g GROUP BY reflection)) AS m FROM features),
re AS (SELECT reflection, count_if(scan = 'Scan_0001')::DOUBLE AS a, count_if(scan = 'Scan_0002')::DOUBLE AS b FROM features GROUP BY reflection),
mi AS (SELECT list_sort(list(max_intensity)) AS a, list_sort(list(chi_max_step)) AS s, count(*) AS n FROM ts),
u AS (SELECT 'scans' AS section, scan AS item, 'features' AS metric, count(*)::DOUBLE AS value FROM features GROUP BY scan
  UNION ALL SELECT 'predicted', 'all', unnest(['expected', 'observed', 'gaps', 'recall']), unnest([expected, observed, expected - observed, observed / nullif(expected, 0)]) FROM pp
  UNION ALL SELECT 'repeatability', 'all', unnest(['first', 'second', 'matched', 'reproducibility']), unnest([a, b, m, 2 * m / nullif(a + b, 0)]) FROM rp
  UNION ALL SELECT 'retention', reflection, unnest(['n_first', 'n_second', 'retention']), unnest([a, b, b / nullif(a, 0)]) FROM re
  UNION ALL SELECT 'angles', 'all', 'median_step', s[n // 2 + 1] FROM mi
  UNION ALL SELECT 'rocking', 'all', unnest(['max_intensity_n', 'max_intensity_min', 'max_intensity_median', 'max_intensity_max']), unnest([n::DOUBLE, a[1], a[n // 2 + 1], a[n]]) FROM mi
  UNION ALL SELECT 'verdict', 'all', 'meets_floor', CASE WHEN observed / nullif(expected, 0) >= 2 * m / nullif(a + b, 0) THEN 1.0 WHEN observed / nullif(expected, 0) < 2 * m / nullif(a + b, 0) THEN 0.0 END FROM pp, rp)
SELECT section, item, metric, round(value, 5) AS value FROM u""", "features"))
def prediction_report(spark, sf_dir):
    out = report.prediction_report(tracked(spark, sf_dir), "Scan_0001", "Scan_0002", 2.0, ["view"])
    return out.withColumn("value", F.round("value", 5))
