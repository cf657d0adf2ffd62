"""Queries of grids, bins and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import grid, image
from gridloom.plans.registry import register
from gridloom.sources import adapters as A

oracle = A.oracle


@register("e2_regular_grid", oracle("SELECT gi, gi // 50 AS row, CASE WHEN (gi // 50) % 2 = 0 THEN gi % 50 ELSE 49 - gi % 50 END AS col FROM frames", "frames"))
def regular_grid(spark, sf_dir):
    return grid.regular_grid(A.frames(spark, sf_dir), 50).select("gi", "row", "col")


FILE_ROWS = "fr AS (SELECT *, file_idx AS row, CASE WHEN file_idx % 2 = 0 THEN rk ELSE nf - 1 - rk END AS col FROM (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY within_idx) - 1 AS rk, count(*) OVER (PARTITION BY file_idx) AS nf FROM frames))"


@register("e3_file_rows", oracle(f"WITH {FILE_ROWS} SELECT gi, row, col FROM fr", "frames"))
def file_rows(spark, sf_dir):
    return grid.file_rows(A.frames(spark, sf_dir)).select("gi", "row", "col")


@register("e3_is_file_per_row", oracle("WITH s AS (SELECT file_idx, count(*) AS n FROM frames GROUP BY file_idx), m AS (SELECT n, count(*) AS files FROM s GROUP BY n) SELECT sum(files)::BIGINT AS files, arg_max(n, row(files, n)) AS modal, max(files) >= 0.9 * sum(files) AS per_row FROM m", "frames"))
def is_file_per_row(spark, sf_dir):
    return grid.is_file_per_row(A.frames(spark, sf_dir))


@register("e1_serpentine_rows", oracle("""
WITH s AS (SELECT *, sum(x_um) OVER (PARTITION BY blk ORDER BY gi ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) / 20 AS sm FROM (SELECT *, gi // 2000 AS blk FROM frames)),
t AS (SELECT *, CASE WHEN (round(sm, 6) > max(round(sm, 6)) OVER b AND round(sm, 6) > max(round(sm, 6)) OVER a) OR (round(sm, 6) < min(round(sm, 6)) OVER b AND round(sm, 6) < min(round(sm, 6)) OVER a) THEN 1 ELSE 0 END AS turn FROM s
  WINDOW b AS (PARTITION BY blk ORDER BY gi ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY blk ORDER BY gi ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY blk ORDER BY gi)::BIGINT AS row FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY blk, row ORDER BY gi) - 1 AS rk, count(*) OVER (PARTITION BY blk, row) AS n FROM r)
SELECT gi, row, CASE WHEN row % 2 = 0 THEN rk ELSE n - 1 - rk END AS col FROM p""", "frames"))
def serpentine(spark, sf_dir):
    frames = A.frames(spark, sf_dir).withColumn("blk", F.expr("gi div 2000"))
    return grid.serpentine_rows(frames, reach=20, partition="blk").select("gi", "row", "col")


@register("d1_bin_sum", oracle(f"WITH {FILE_ROWS} SELECT row // 5 AS brow, col // 5 AS bcol, round(sum(v), 6) AS total, count(*) AS n_frames FROM fr GROUP BY ALL", "frames"))
def bin_sum(spark, sf_dir):
    return grid.bin_sum(grid.file_rows(A.frames(spark, sf_dir)), 5).withColumn("total", F.round("total", 6))


@register("c4_frame_to_bin", oracle(f"WITH {FILE_ROWS} SELECT gi, row // 5 AS brow, col // 5 AS bcol FROM fr", "frames"))
def frame_to_bin(spark, sf_dir):
    return grid.file_rows(A.frames(spark, sf_dir)).select("gi", grid.to_bin(F.col("row"), 5).alias("brow"), grid.to_bin(F.col("col"), 5).alias("bcol"))


@register("c16_bin_mean_position", oracle(f"WITH {FILE_ROWS} SELECT row // 5 AS brow, col // 5 AS bcol, round(avg(x_um), 6) AS x, round(avg(y_um), 6) AS y FROM fr GROUP BY ALL", "frames"))
def bin_positions(spark, sf_dir):
    f = grid.file_rows(A.frames(spark, sf_dir))
    return f.groupBy(grid.to_bin(F.col("row"), 5).alias("brow"), grid.to_bin(F.col("col"), 5).alias("bcol")).agg(F.round(F.avg("x_um"), 6).alias("x"), F.round(F.avg("y_um"), 6).alias("y"))


@register("c22_reroute_bins", oracle(f"WITH {FILE_ROWS} SELECT row // 5 AS brow, col // 5 AS bcol, row // 3 AS brow3, col // 3 AS bcol3, count(*) AS n FROM fr GROUP BY ALL", "frames"))
def reroute(spark, sf_dir):
    f = grid.file_rows(A.frames(spark, sf_dir))
    coarse = f.select("gi", grid.to_bin(F.col("row"), 5).alias("brow"), grid.to_bin(F.col("col"), 5).alias("bcol"))
    fine = f.select("gi", grid.to_bin(F.col("row"), 3).alias("brow3"), grid.to_bin(F.col("col"), 3).alias("bcol3"))
    return coarse.join(fine, "gi").groupBy("brow", "bcol", "brow3", "bcol3").agg(F.count("*").alias("n"))


@register("b12_subbin_keys", oracle("SELECT DISTINCT scan, brow, bcol, brow * 3 + r.r AS row, bcol * 3 + c.c AS col FROM peaks, range(0, 3) AS r(r), range(0, 3) AS c(c)", "peaks"))
def subbins(spark, sf_dir):
    return grid.cells_of_bins(A.peaks(spark, sf_dir).select("scan", "brow", "bcol").distinct(), 3)


@register("b13_bin_centres", oracle("SELECT DISTINCT scan, brow, bcol, brow * 5 + 2 AS row, bcol * 5 + 2 AS col FROM peaks", "peaks"))
def centres(spark, sf_dir):
    return grid.bin_centres(A.peaks(spark, sf_dir).select("scan", "brow", "bcol").distinct(), 5)


@register("d41_occupancy", oracle("SELECT scan, brow AS row, count(DISTINCT bcol) AS n, max(bcol) AS rightmost, round(count(DISTINCT bcol) / (max(bcol) + 1)::DOUBLE, 6) AS fill FROM peaks GROUP BY scan, brow", "peaks"))
def occupancy(spark, sf_dir):
    cells = A.peaks(spark, sf_dir).select("scan", F.col("brow").alias("row"), F.col("bcol").alias("col"))
    return grid.occupancy(cells, ("scan",)).withColumn("fill", F.round("fill", 6))


@register("e11_fill_gaps", oracle("""
WITH g AS (SELECT gi, file_idx, CASE WHEN gi % 7 < 3 THEN NULL ELSE x_um END AS x FROM frames),
k AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN gi END) OVER (PARTITION BY file_idx ORDER BY gi) AS a, min(CASE WHEN x IS NOT NULL THEN gi END) OVER (PARTITION BY file_idx ORDER BY gi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)
SELECT k.gi, round(CASE WHEN k.x IS NOT NULL THEN k.x WHEN ga.x IS NULL THEN gb.x WHEN gb.x IS NULL THEN ga.x ELSE ga.x + (gb.x - ga.x) * (k.gi - k.a) / (k.b - k.a)::DOUBLE END, 6) AS x
FROM k LEFT JOIN g ga ON ga.gi = k.a LEFT JOIN g gb ON gb.gi = k.b""", "frames"))
def gaps(spark, sf_dir):
    holes = A.frames(spark, sf_dir).select("gi", "file_idx", F.when(F.col("gi") % 7 >= 3, F.col("x_um")).alias("x"))
    return grid.fill_gaps(holes, "x", "gi", "file_idx").select("gi", F.round("x", 6).alias("x"))


@register("e12_snap_to_lattice", oracle("SELECT gi, greatest(0, least(50, round_even((x_um - lo) / (hi - lo) * 50, 0)))::BIGINT AS index FROM frames, (SELECT quantile_cont(x_um, 0.002) AS lo, quantile_cont(x_um, 0.998) AS hi FROM frames)", "frames"))
def lattice(spark, sf_dir):
    return grid.snap_to_lattice(A.frames(spark, sf_dir), "x_um", 51).select("gi", "index")


@register("e23_fill_holes", oracle("""
WITH c AS (SELECT brow AS row, bcol AS col, sum(integrated) AS v FROM device_map GROUP BY ALL),
n AS (SELECT row + r.r AS row, col + d.d AS col, v FROM c, range(-1, 2) AS r(r), range(-1, 2) AS d(d) WHERE v <> 0)
SELECT row, col, round(avg(v) * 0.3::DOUBLE, 6) AS v FROM n ANTI JOIN c USING (row, col) WHERE row >= 0 AND col >= 0 GROUP BY row, col""", "device_map"))
def holes(spark, sf_dir):
    cells = A.device_map(spark, sf_dir).groupBy(F.col("brow").alias("row"), F.col("bcol").alias("col")).agg(F.sum("integrated").alias("v"))
    return grid.fill_holes(cells, "v").withColumn("v", F.round("v", 6))


@register("d2_image_sum", oracle("SELECT y, x, round(sum(v), 5) AS v FROM pixels GROUP BY y, x", "pixels"))
def image_sum(spark, sf_dir):
    return grid.image_sum(A.pixels(spark, sf_dir)).withColumn("v", F.round("v", 5))


@register("d53_block_mean", oracle("SELECT gi, y // 3 AS y, x // 3 AS x, round(avg(v), 6) AS v FROM pixels WHERE y < 6 AND x < 6 GROUP BY gi, y // 3, x // 3", "pixels"))
def block_mean(spark, sf_dir):
    return grid.block_mean(A.pixels(spark, sf_dir), 3, 8, 8).withColumn("v", F.round("v", 6))


@register("a3_frame_index", oracle("WITH f AS (SELECT file_idx, count(*) AS n FROM frames GROUP BY file_idx), s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM f) SELECT file_idx, k::INT AS within_idx, st + k AS gi FROM s, unnest(range(0, n)) AS r(k)", "frames"))
def frame_index(spark, sf_dir):
    return grid.frame_index(A.frames(spark, sf_dir).groupBy("file_idx").agg(F.count("*").alias("n")))


@register("b1_band_mask", oracle("SELECT DISTINCT gi, y, x, band FROM tth_pixels JOIN (SELECT reflection AS band, two_theta FROM reflections) ON abs(tth - two_theta) <= 1.0", "tth_pixels", "reflections"))
def band_mask(spark, sf_dir):
    return image.band_mask(A.tth_pixels(spark, sf_dir).select("gi", "y", "x", "tth"), A.reflections(spark, sf_dir), 1.0).select("gi", "y", "x", "band")


@register("b2_any_band", oracle("SELECT gi, y, x FROM tth_pixels WHERE EXISTS (SELECT 1 FROM reflections WHERE abs(tth - two_theta) <= 0.5)", "tth_pixels", "reflections"))
def any_band(spark, sf_dir):
    return image.in_any_band(A.tth_pixels(spark, sf_dir), A.reflections(spark, sf_dir), 0.5).select("gi", "y", "x")


@register("b3_edge_mask", oracle("SELECT gi, y, x, v FROM pixels WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5", "pixels"))
def edge(spark, sf_dir):
    return image.drop_edge(A.pixels(spark, sf_dir), 2, 8, 8).drop("label")


@register("b4_gap_mask", oracle("WITH r AS (SELECT gi, y FROM pixels GROUP BY gi, y HAVING avg(v) < -0.05), g AS (SELECT DISTINCT gi, y + k AS y FROM r, range(-1, 2) AS t(k)) SELECT gi, y, x FROM pixels ANTI JOIN g USING (gi, y)", "pixels"))
def gap_mask(spark, sf_dir):
    return image.without_gaps(A.pixels(spark, sf_dir), -0.05, 1).select("gi", "y", "x")


@register("d3_radial_profile", oracle("""
WITH e AS (SELECT min(tth) AS lo, max(tth) AS hi FROM tth_pixels), b AS (SELECT gi, greatest(0, least(9, floor((tth - lo) / ((hi - lo) / 10))))::BIGINT AS ring, v FROM tth_pixels, e), m AS (SELECT gi, ring, avg(v) AS mean FROM b GROUP BY gi, ring)
SELECT gi, ring, round(coalesce(mean, 0), 6) AS mean FROM (SELECT DISTINCT gi FROM pixels) CROSS JOIN range(0, 10) AS r(ring) LEFT JOIN m USING (gi, ring)""", "tth_pixels"))
def radial(spark, sf_dir):
    return image.radial_profile(A.tth_pixels(spark, sf_dir), 10).withColumn("mean", F.round("mean", 6))


@register("d5_radial_median", oracle("WITH r AS (SELECT *, floor(tth / 2)::BIGINT AS ring FROM tth_pixels), m AS (SELECT gi, ring, median(v) AS bg FROM r GROUP BY gi, ring) SELECT gi, y, x, round(v - bg, 6) AS v FROM r JOIN m USING (gi, ring)", "tth_pixels"))
def radial_median(spark, sf_dir):
    return image.subtract_radial_median(A.tth_pixels(spark, sf_dir), 2.0).select("gi", "y", "x", F.round("v", 6).alias("v"))


@register("e4_smooth_profile", oracle("""
WITH e AS (SELECT min(tth) AS lo, max(tth) AS hi FROM tth_pixels), b AS (SELECT gi, greatest(0, least(9, floor((tth - lo) / ((hi - lo) / 10))))::BIGINT AS ring, v FROM tth_pixels, e), m AS (SELECT gi, ring, avg(v) AS mean FROM b GROUP BY gi, ring),
f AS (SELECT gi, ring, coalesce(mean, 0) AS mean FROM (SELECT DISTINCT gi FROM pixels) CROSS JOIN range(0, 10) AS r(ring) LEFT JOIN m USING (gi, ring)),
p AS (SELECT * FROM f UNION ALL SELECT gi, -1 - ring, mean FROM f WHERE ring < 2 UNION ALL SELECT gi, 19 - ring, mean FROM f WHERE ring > 7),
s AS (SELECT gi, ring, avg(mean) OVER (PARTITION BY gi ORDER BY ring ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mean FROM p) SELECT gi, ring, round(mean, 6) AS mean FROM s WHERE ring BETWEEN 0 AND 9""", "tth_pixels"))
def smooth(spark, sf_dir):
    return image.smooth_profile(image.radial_profile(A.tth_pixels(spark, sf_dir), 10), 2).withColumn("mean", F.round("mean", 6))


THRESH = "SELECT gi, round(md, 6) AS median, round(sg, 6) AS sigma, round(md + {k} * sg, 6) AS threshold FROM (SELECT gi, md, CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad ELSE sd END AS sg FROM (SELECT gi, any_value(md) AS md, any_value(sd) AS sd, median(abs(v - md)) AS mad FROM {src} JOIN (SELECT gi, median(v) AS md, stddev_pop(v) AS sd FROM {src} GROUP BY gi) USING (gi) GROUP BY gi)) WHERE sg > 0"


@register("d6_band_threshold", oracle(THRESH.format(k=4, src="pixels"), "pixels"))
def threshold(spark, sf_dir):
    out = image.robust_threshold(A.pixels(spark, sf_dir), ["gi"], 4.0)
    return out.select("gi", *[F.round(c, 6).alias(c) for c in ("median", "sigma", "threshold")])


@register("d8_clipped_sigma", oracle("WITH t AS (" + THRESH.format(k=2, src="pixels").replace("round(md, 6)", "md").replace("round(sg, 6)", "sg").replace("round(md + 2 * sg, 6)", "md + 2 * sg") + "), c AS (SELECT p.gi, p.v FROM pixels p JOIN t USING (gi) WHERE abs(v - median) <= 2 * sigma) " + THRESH.format(k=2, src="c"), "pixels"))
def clipped(spark, sf_dir):
    out = image.clipped_sigma(A.pixels(spark, sf_dir), ["gi"], 2.0, 1)
    return out.select("gi", *[F.round(c, 6).alias(c) for c in ("median", "sigma", "threshold")])


def _opened(size: int, src: str = "pixels") -> str:
    h = size // 2
    w = f"ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING"
    return (
        f"(SELECT gi, y, x, v, max(o) OVER (PARTITION BY gi, x ORDER BY y {w}) AS o FROM (SELECT gi, y, x, v, max(o) OVER (PARTITION BY gi, y ORDER BY x {w}) AS o FROM "
        f"(SELECT gi, y, x, v, min(o) OVER (PARTITION BY gi, x ORDER BY y {w}) AS o FROM (SELECT gi, y, x, v, min(v) OVER (PARTITION BY gi, y ORDER BY x {w}) AS o FROM {src}))))"
    )


@register("e5_top_hat", oracle(f"SELECT gi, y, x, round(v - o, 6) AS hat FROM {_opened(3)}", "pixels"))
def top_hat(spark, sf_dir):
    return image.top_hat(A.pixels(spark, sf_dir), 3).select("gi", "y", "x", F.round("hat", 6).alias("hat"))


@register("e6_multiscale_top_hat", oracle(f"SELECT a.gi, a.y, a.x, round(greatest(a.v - a.o, b.v - b.o), 6) AS hat FROM {_opened(3)} a JOIN {_opened(5)} b USING (gi, y, x)", "pixels"))
def multiscale(spark, sf_dir):
    return image.multiscale_top_hat(A.pixels(spark, sf_dir), (3, 5)).select("gi", "y", "x", F.round("hat", 6).alias("hat"))


@register("e7_local_snr", oracle("""
WITH m AS (SELECT y.k AS y0, x.k AS x0, y.k + dy.d AS yy, x.k + dx.d AS xx FROM range(0, 8) AS y(k), range(0, 8) AS x(k), range(-2, 3) AS dy(d), range(-2, 3) AS dx(d)),
r AS (SELECT y0, x0, CASE WHEN yy < 0 THEN -1 - yy WHEN yy > 7 THEN 15 - yy ELSE yy END AS y, CASE WHEN xx < 0 THEN -1 - xx WHEN xx > 7 THEN 15 - xx ELSE xx END AS x FROM m),
s AS (SELECT gi, y0, x0, sum(v) / 25 AS mean, sum(v * v) / 25 AS sq FROM r JOIN pixels USING (y, x) GROUP BY gi, y0, x0)
SELECT p.gi, p.y, p.x, round((v - mean) / greatest(sqrt(greatest(sq - mean * mean, 0)), 0.01), 4) AS snr FROM pixels p JOIN s ON p.gi = s.gi AND p.y = y0 AND p.x = x0""", "pixels"))
def snr(spark, sf_dir):
    return image.local_snr(A.pixels(spark, sf_dir), 2, 8, 8).select("gi", "y", "x", F.round("snr", 4).alias("snr"))


@register("d57_image_statistics", oracle("SELECT gi, round(any_value(md), 6) AS median, round(median(abs(v - md)), 6) AS mad FROM pixels JOIN (SELECT gi, median(v) AS md FROM pixels GROUP BY gi) USING (gi) GROUP BY gi", "pixels"))
def image_statistics(spark, sf_dir):
    p = A.pixels(spark, sf_dir)
    m = p.groupBy("gi").agg(F.median("v").alias("median"))
    return p.join(m, "gi").groupBy("gi", "median").agg(F.round(F.median(F.abs(F.col("v") - F.col("median"))), 6).alias("mad")).withColumn("median", F.round("median", 6))


@register("b18_display_range", oracle("WITH l AS (SELECT gi, y, x, ln(1 + greatest(v, 0)) AS v FROM pixels), q AS (SELECT gi, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM l GROUP BY gi) SELECT gi, y, x, round(greatest(lo, least(hi, v)), 6) AS v FROM l JOIN q USING (gi)", "pixels"))
def display(spark, sf_dir):
    return image.display_range(A.pixels(spark, sf_dir), 0.1, 0.9).select("gi", "y", "x", F.round("v", 6).alias("v"))


POINTS = "pts AS (SELECT gi, max(k1) % 8 AS py, max(k1) // 8 % 8 AS px FROM (SELECT vec_id AS gi, vec_id * 13 + label AS k1 FROM embeddings) GROUP BY gi)"


def _points(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    k = F.col("vec_id") * 13 + F.col("label")
    return e.select(F.col("vec_id").alias("gi"), (k % 8).alias("py"), (F.expr("(vec_id * 13 + label) div 8") % 8).alias("px"))


@register("b10_window_max", oracle(f"WITH {POINTS} SELECT gi, py, px, round(max(v), 6) AS top FROM pts JOIN pixels USING (gi) WHERE abs(y - py) <= 2 AND abs(x - px) <= 2 GROUP BY gi, py, px", "pixels"))
def window_max(spark, sf_dir):
    return image.window_max(_points(spark, sf_dir), A.pixels(spark, sf_dir), 2).withColumn("top", F.round("top", 6))


@register("b25_local_maximum", oracle(f"WITH {POINTS} SELECT gi, py, px, arg_max(y, row(v, -y, -x)) AS y, arg_max(x, row(v, -y, -x)) AS x, round(max(v), 6) AS v FROM pts JOIN pixels USING (gi) WHERE abs(y - py) <= 3 AND abs(x - px) <= 3 GROUP BY gi, py, px", "pixels"))
def local_maximum(spark, sf_dir):
    return image.local_maximum(_points(spark, sf_dir), A.pixels(spark, sf_dir), 3).withColumn("v", F.round("v", 6))


@register("e13_grid_from_positions", oracle("""
WITH q AS (SELECT quantile_cont(x_um, 0.002) AS x0, quantile_cont(x_um, 0.998) AS x1, quantile_cont(y_um, 0.002) AS y0, quantile_cont(y_um, 0.998) AS y1, corr(gi, y_um) AS sy, corr(within_idx, x_um) AS sx FROM frames),
c AS (SELECT gi, greatest(0, least(199, round_even((y_um - y0) / (y1 - y0) * 199, 0)))::BIGINT AS row, greatest(0, least(50, round_even((x_um - x0) / (x1 - x0) * 50, 0)))::BIGINT AS col, sx, sy FROM frames, q)
SELECT gi, CASE WHEN round(sy, 9) < 0 THEN 199 - row ELSE row END AS row, CASE WHEN round(sx, 9) < 0 THEN 50 - col ELSE col END AS col FROM c""", "frames"))
def grid_from_positions(spark, sf_dir):
    return grid.grid_from_positions(A.frames(spark, sf_dir), 200, 51).select("gi", "row", "col")


@register("e15_row_offsets", oracle("WITH f AS (SELECT file_idx AS row, x_um, row_number() OVER (PARTITION BY file_idx ORDER BY x_um) - 1 AS rank FROM frames) SELECT row, round_even(median(floor(x_um + 0.6)::BIGINT - rank), 0)::BIGINT AS \"offset\" FROM f GROUP BY row", "frames"))
def row_offsets(spark, sf_dir):
    from pyspark.sql import Window

    f = A.frames(spark, sf_dir).withColumn("row", F.col("file_idx")).withColumn("col", F.floor(F.col("x_um") + 0.6))
    ranked = f.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("x_um")) - 1)
    return grid.row_offsets(ranked)
