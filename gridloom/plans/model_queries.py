"""Queries of detectors, fits, territories, catalogs and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import detect, fit, image, study, territory
from gridloom.plans.grid_queries import _opened
from gridloom.plans.registry import register
from gridloom.session import shared_dir
from gridloom.sources import adapters as A
from gridloom.sources import catalogs
from gridloom.streaming import jobs

oracle = A.oracle
TTH = np.degrees(np.arctan2(0.5 * np.hypot(*(np.mgrid[0:8, 0:8] + 0.5)), 20.0))
BANDS = [("inner", 3.0), ("middle", 6.0), ("outer", 9.0)]


def _images(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gi"), F.col("embedding").alias("pixels"), "label")


def _detector(**changes) -> detect.Detector:
    small = {"height": 8, "width": 8, "smooth": 3, "hats": (3,), "tolerance": 1.5, "k_sigma": 1.5, "min_pixels": 1, "edge": 0, "separation": 2.0, "min_compactness": 0.05}
    return detect.Detector(**(small | changes))


@register("l2_band_adaptive_peaks")
def band_adaptive(spark, sf_dir):
    return detect.detect(_images(spark, sf_dir), TTH, BANDS, _detector())


@register("l4_multiscale_peaks")
def multiscale(spark, sf_dir):
    return detect.detect(_images(spark, sf_dir), TTH, BANDS, _detector(hats=(3, 5), clip_rounds=2))


@register("l6_blob_hybrid_peaks")
def blob_hybrid(spark, sf_dir):
    return detect.detect(_images(spark, sf_dir), TTH, BANDS, _detector(blob_sigmas=(1.0,)))


@register("j1_top_hat_kernel", oracle(f"SELECT gi, y, x, round(v - o, 6) AS hat FROM {_opened(3)}", "pixels"))
def kernel_top_hat(spark, sf_dir):
    """The dense top-hat of every frame, by pixel."""
    def run(frames):
        import pandas as pd

        for pdf in frames:
            hats = [detect.top_hat(np.asarray(v, dtype=float).reshape(8, 8), (3,)).ravel().tolist() for v in pdf.pixels]
            yield pd.DataFrame({"gi": pdf.gi, "hats": hats})

    dense = _images(spark, sf_dir).select("gi", "pixels").mapInPandas(run, "gi bigint, hats array<double>").select("gi", F.posexplode("hats").alias("pos", "a"))
    return dense.select("gi", F.expr("cast(pos div 8 as bigint)").alias("y"), (F.col("pos") % 8).cast("bigint").alias("x"), F.round("a", 6).alias("hat"))


@register("d1_dense_bin_images", oracle("SELECT label, p - 1 AS pos, round(sum(embedding[p]::DOUBLE), 5) AS v, count(*) AS n FROM embeddings, unnest(range(1, 65)) AS r(p) GROUP BY label, p"))
def dense_bins(spark, sf_dir):
    im = _images(spark, sf_dir)
    out = detect.bin_images(im.select("gi", "pixels"), im.select("gi", "label"), ["label"])
    return out.select("label", "n", F.posexplode("pixels").alias("pos", "v")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("v", 5).alias("v"), "n")


@register("j5_rocking_fits")
def rocking_fits(spark, sf_dir):
    f = A.features(spark, sf_dir).withColumn("track", F.concat_ws(":", "reflection", F.col("prow").cast("string"), F.col("pcol").cast("string")))
    return fit.fit_curves(study.intensity_curve(f, ["track"], "peak_intensity"), "track")


@register("j6_radial_backgrounds")
def backgrounds(spark, sf_dir):
    return fit.fit_backgrounds(image.radial_profile(A.tth_pixels(spark, sf_dir), 16))


def _points(spark, sf_dir) -> DataFrame:
    f = A.frames(spark, sf_dir)
    return f.select(F.expr("file_idx div 20").alias("scan"), F.col("gi").alias("id"), F.col("x_um").alias("x"), (F.col("y_um") % 20).alias("y"))


@register("j11_territories")
def territories(spark, sf_dir):
    return territory.grow(_points(spark, sf_dir), 25, 2.5)


@register("d48_territory_geometry")
def territory_geometry(spark, sf_dir):
    p = _points(spark, sf_dir)
    return territory.geometry(territory.grow(p, 25, 2.5), p)


@register("d44_angle_clusters")
def angle_clusters(spark, sf_dir):
    return territory.angle_clusters(A.features(spark, sf_dir), "chi_deg", "sum_integrated", "reflection")


@register("a12_peak_json_round_trip", oracle("SELECT scan, brow, bcol, count(*) AS n, round(sum(x), 4) AS sx, round(sum(snr), 4) AS ssnr FROM peaks GROUP BY scan, brow, bcol", "peaks"))
def peak_json(spark, sf_dir):
    """Peak catalogs written as JSON text and read back."""
    folder = f"{shared_dir(spark)}/peaks-{uuid.uuid4().hex}"
    catalogs.peak_json(A.peaks(spark, sf_dir)).write.partitionBy("scan").text(folder)
    back = catalogs.read_peaks(spark, folder, lines=True)
    return back.groupBy("scan", F.col("brow").cast("bigint").alias("brow"), F.col("bcol").cast("bigint").alias("bcol")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("snr"), 4).alias("ssnr"))


@register("a4_scan_summary", oracle("SELECT scan, count(*) AS n_files, sum(n)::BIGINT AS n_frames FROM (SELECT file_idx // 10 AS scan, file_idx, count(*) AS n FROM frames GROUP BY file_idx) GROUP BY scan", "frames"))
def scan_summary(spark, sf_dir):
    files = A.frames(spark, sf_dir).groupBy("file_idx").agg(F.count("*").alias("n")).withColumn("scan", F.expr("file_idx div 10")).withColumn("shape", F.lit("8x8"))
    return catalogs.scan_summary(files).select("scan", "n_files", "n_frames")


@register("a16_default_sources", oracle("WITH c AS (SELECT DISTINCT l_linenumber AS scan, l_suppkey % 5 AS bin, CASE l_partkey % 3 WHEN 0 THEN 'combined' WHEN 1 THEN 'shapes' ELSE 'peaks' END AS kind, l_shipmode AS name FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)) SELECT scan, bin, kind, name FROM c QUALIFY row_number() OVER (PARTITION BY scan, bin ORDER BY CASE kind WHEN 'combined' THEN 0 WHEN 'shapes' THEN 1 ELSE 2 END, name DESC) = 1"))
def default_sources(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_partkey") % 3 == 0, "combined").when(F.col("l_partkey") % 3 == 1, "shapes").otherwise("peaks")
    c = li.select(F.col("l_linenumber").alias("scan"), (F.col("l_suppkey") % 5).alias("bin"), kind.alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("name")).distinct()
    return catalogs.default_sources(c)


@register("a27_append_features", oracle("WITH o AS (SELECT scan, feature_id FROM features WHERE reflection = 'view'), m AS (SELECT scan, max(feature_id) AS top FROM o GROUP BY scan), n AS (SELECT f.scan, coalesce(top, 0) + row_number() OVER (PARTITION BY f.scan ORDER BY f.feature_id) AS feature_id FROM features f LEFT JOIN m USING (scan) WHERE reflection = 'click') SELECT * FROM o UNION ALL SELECT * FROM n", "features"))
def append(spark, sf_dir):
    f = A.features(spark, sf_dir)
    old = f.filter("reflection = 'view'").select("scan", "feature_id")
    new = f.filter("reflection = 'click'").select("scan", F.col("feature_id").alias("source"))
    return catalogs.append_numbered(old.withColumn("source", F.lit(None).cast("bigint")), new, "feature_id", "source", "scan").select("scan", "feature_id")


@register("a28_manifest_merge", oracle("SELECT user_id, arg_max(event_type, row(ts, event_id)) AS event_type FROM events GROUP BY user_id"))
def manifest(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("version"))
    return jobs.merge_latest(e.filter("version.event_id % 2 = 0"), e.filter("version.event_id % 2 = 1"), "user_id", "version").select("user_id", "event_type")




@register("i4_live_device_map", oracle("SELECT brow, bcol, max(integrated) AS max_intensity, arg_max(theta, row(integrated, -ord)) AS argmax_theta, count(DISTINCT theta) AS n_theta FROM device_map WHERE integrated > 0 GROUP BY brow, bcol", "device_map"))
def live_map(spark, sf_dir):
    """The streaming aggregate, here on the table as a batch; tests run it as a stream."""
    return jobs.live_device_map(A.device_map(spark, sf_dir))


@register("i2_running_bins", oracle("SELECT file_idx // 5 AS brow, within_idx // 5 AS bcol, round(sum(v), 5) AS total, count(*) AS n_frames FROM frames GROUP BY ALL", "frames"))
def running_bins(spark, sf_dir):
    f = A.frames(spark, sf_dir).withColumn("row", F.col("file_idx")).withColumn("col", F.col("within_idx"))
    return jobs.running_bins(f, 5).withColumn("total", F.round("total", 5))


@register("i1_trigger_windows", oracle("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id AS trigger, round(avg(value), 6) AS c0, count(*) AS n FROM events GROUP BY ALL"))
def trigger_windows(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("trigger"), F.col("value").alias("c0"), F.col("value").alias("c1"))
    return jobs.trigger_averages(e).select(F.col("window.start").alias("start"), "trigger", F.round("c0", 6).alias("c0"), "n")
