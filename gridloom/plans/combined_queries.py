"""Queries of the whole-scan search, profile verification, stacks, regions and the table detectors."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import batch, combined, grid, image, mapping, regions, spatial, voigt
from gridloom.plans.grid_queries import _opened
from gridloom.plans.model_queries import BANDS, TTH
from gridloom.plans.registry import register
from gridloom.plans.spatial_queries import PATCH, UNIQUE, patches, unique_peaks
from gridloom.session import shared_dir
from gridloom.sources import adapters as A

oracle = A.oracle


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def patch_probes(spark, sf_dir) -> DataFrame:
    """Net intensity of every cell of every patch of peaks, around its brightest cell."""
    cells = patches(spark, sf_dir).groupBy("component", "brow", "bcol").agg((F.sum("intensity") - 30000).alias("net"))
    best = F.struct("net", -F.col("brow"), -F.col("bcol"))
    centres = cells.groupBy("component").agg(F.max_by("brow", best).alias("center_row"), F.max_by("bcol", best).alias("center_col"))
    return cells.join(centres, "component")


@register("j7_voigt_pretests", oracle(f"""
WITH {UNIQUE}, {PATCH}, n AS (SELECT component, brow, bcol, sum(intensity) - 30000 AS net FROM mem GROUP BY ALL),
ce AS (SELECT component, arg_max(brow, row(net, -brow, -bcol)) AS r, arg_max(bcol, row(net, -brow, -bcol)) AS c, max(net) AS top FROM n GROUP BY component),
b AS (SELECT n.*, r, c, top, net / (top + 1e-10) AS norm FROM n JOIN ce USING (component)),
m AS (SELECT component, r, c, count(*) AS cells, any_value(top) AS top, max(norm) FILTER (brow = r AND bcol = c) AS cn, sum(brow * greatest(norm, 0)) / sum(greatest(norm, 0)) AS pr,
  sum(bcol * greatest(norm, 0)) / sum(greatest(norm, 0)) AS pc, median(norm) AS md, stddev_pop(norm) / (avg(norm) + 1e-10) AS cv FROM b GROUP BY component, r, c),
q AS (SELECT component, 1.4826::DOUBLE * median(abs(norm - md)) AS noise FROM b JOIN m USING (component) GROUP BY component),
l AS (SELECT m.*, CASE WHEN noise > 0 THEN greatest(0.08, md + 1.5 * noise) ELSE 0.08 END AS level FROM m JOIN q USING (component)),
s AS (SELECT component, l.r AS center_row, l.c AS center_col, cells, l.top, cv, level, cn, count_if(norm > level)::BIGINT AS n_signal, avg((norm <= cn)::INT) AS share, max(d) FILTER (norm > level) AS far,
  CASE WHEN count_if(d <= 2.5) >= 2 AND count_if(d > 2.5) >= 3 THEN avg(norm) FILTER (d <= 2.5) / (avg(norm) FILTER (d > 2.5) + 1e-10) END AS io
  FROM (SELECT b.component, norm, sqrt((brow - pr) * (brow - pr) + (bcol - pc) * (bcol - pc)) AS d FROM b JOIN l USING (component)) JOIN l USING (component) GROUP BY ALL)
SELECT component, center_row, center_col, n_signal, round(cv, 4) AS cv, round(io, 4) AS io_ratio,
  CASE WHEN cells < 3 THEN 'few' WHEN top <= 0 THEN 'neg' WHEN share < 0.12 THEN 'weak' WHEN n_signal < 2 THEN 'few_signal' WHEN cv < 0.1 THEN 'flat' WHEN io < 1.15 THEN 'flat_io'
   WHEN n_signal <= 2 AND far <= 3.5 AND cn > 0.3 * level THEN 'compact' WHEN n_signal <= 2 THEN 'spread' ELSE 'fit' END AS reason FROM s""", "peaks"))
def pretests(spark, sf_dir):
    out = voigt.pretests(patch_probes(spark, sf_dir), ["component"])
    return _rounded(out.select("component", "center_row", "center_col", "n_signal", "cv", "io_ratio", "reason"), ["cv", "io_ratio"], 4)


@register("j7_voigt_verification")
def verification(spark, sf_dir):
    return voigt.verify(patch_probes(spark, sf_dir), ["component"])


@register("l16_voigt_shapes")
def voigt_shapes(spark, sf_dir):
    return voigt.verify_members(patches(spark, sf_dir), ["component"])


WIDE = 25
SMALL = combined.Search(TTH, tuple(BANDS), ring_width=0.5, smooth=3, tolerance=1.5, hats=(3,), k_sigma=2.5, min_pixels=1, min_band=1, edge=0, separation=2.0, link=1.0, min_cells=2, radius=3, aperture=1, rules=voigt.Rules(least_r2=0.0, least_signal=1, centre_share=0.0, inner_outer=-1e9, flat_cv=-1e9))


def cell_frames(spark, sf_dir) -> DataFrame:
    """The embeddings as frames of a scan of WIDE columns; they are unrelated, so SMALL's rules are wide open."""
    e = A.table(spark, sf_dir, "embeddings")
    return e.select(F.expr(f"vec_id div {WIDE}").alias("brow"), (F.col("vec_id") % WIDE).alias("bcol"), F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))


CELLS = f"cp AS (SELECT gi // {WIDE} AS brow, gi % {WIDE} AS bcol, y, x, v FROM pixels)"


def cell_pixels(spark, sf_dir) -> DataFrame:
    return A.pixels(spark, sf_dir).select(F.expr(f"gi div {WIDE}").alias("brow"), (F.col("gi") % WIDE).alias("bcol"), "y", "x", "v")


@register("l11_full_scan_features")
def full_scan(spark, sf_dir):
    return combined.full_scan(cell_frames(spark, sf_dir), SMALL)[0]


@register("l11_full_scan_verdicts")
def full_scan_verdicts(spark, sf_dir):
    return combined.full_scan(cell_frames(spark, sf_dir), SMALL)[1]


def _centre_spots(spark, sf_dir, kind: str) -> DataFrame:
    """Around every fourth cell of every fourth row."""
    f = cell_frames(spark, sf_dir)
    centres = f.filter("brow % 4 = 0 and bcol % 4 = 0").select(F.col("brow").alias("center_row"), F.col("bcol").alias("center_col"))
    return combined.centre_search(f, centres, SMALL, kind)


@register("l8_hybrid_spots")
def hybrid_spots(spark, sf_dir):
    return _centre_spots(spark, sf_dir, "hybrid")


@register("l10_concentric_spots")
def concentric_spots(spark, sf_dir):
    return _centre_spots(spark, sf_dir, "concentric")


@register("d2_scan_sum", oracle("SELECT y * 8 + x AS pos, round(sum(greatest(v, 0)), 5) AS total, count(*) AS n FROM pixels GROUP BY ALL", "pixels"))
def scan_sum(spark, sf_dir):
    out = combined.summed(cell_frames(spark, sf_dir), 64)
    return out.select(F.col("pos").cast("bigint").alias("pos"), F.round("total", 5).alias("total"), "n")


@register("d54_aperture_probe", oracle(f"""
WITH {CELLS}, f AS (SELECT gi // {WIDE} AS r, gi % {WIDE} AS c, arg_max(x, row(v, -y, -x)) AS px, arg_max(y, row(v, -y, -x)) AS py, gi AS component FROM pixels GROUP BY gi)
SELECT component, r AS center_row, c AS center_col, brow, bcol, round(sum(CASE WHEN abs(x - px) <= 1 AND abs(y - py) <= 1 THEN greatest(v, 0) END), 5) AS net
FROM f JOIN cp ON abs(brow - r) <= 1 AND abs(bcol - c) <= 1 GROUP BY ALL""", "pixels"))
def aperture_probe(spark, sf_dir):
    """The brightest pixel of every frame, probed in all frames around it."""
    best = F.struct("v", -F.col("y"), -F.col("x"))
    spots = A.pixels(spark, sf_dir).groupBy(F.col("gi").alias("component")).agg(F.max_by("x", best).cast("int").alias("px"), F.max_by("y", best).cast("int").alias("py"))
    found = spots.withColumns({"center_row": F.expr(f"component div {WIDE}"), "center_col": F.col("component") % WIDE})
    return _rounded(combined.probe(cell_frames(spark, sf_dir), found, np.zeros((8, 8)), 1, 1), ["net"], 5)


@register("j13_concentric_sums", oracle(f"""
WITH {CELLS}, c AS (SELECT DISTINCT brow AS r, bcol AS c FROM cp WHERE brow % 4 = 0 AND bcol % 4 = 0),
d AS (SELECT r, c, y, x, v, greatest(abs(brow - r), abs(bcol - c)) AS d FROM cp JOIN c ON abs(brow - r) <= 5 AND abs(bcol - c) <= 5)
SELECT r AS center_row, c AS center_col, y, x, round(sum(v) FILTER (d <= 1), 5) AS s1, count_if(d <= 1)::BIGINT AS n1, round(sum(v) FILTER (d <= 3), 5) AS s3, count_if(d <= 3)::BIGINT AS n3, round(sum(v), 5) AS s5, count(*)::BIGINT AS n5
FROM d GROUP BY ALL""", "pixels"))
def concentric(spark, sf_dir):
    """Stacks around every fourth cell of every fourth row of the scan, over all frames around them."""
    p = cell_pixels(spark, sf_dir)
    centres = p.filter("brow % 4 = 0 and bcol % 4 = 0").select(F.col("brow").alias("center_row"), F.col("bcol").alias("center_col")).distinct()
    return _rounded(combined.concentric_sums(p, centres, (1, 3, 5)), ["s1", "s3", "s5"], 5)


@register("j13_stack_spots")
def stack_spots(spark, sf_dir):
    p = cell_pixels(spark, sf_dir).withColumn("v", F.greatest("v", F.lit(0.0)))
    centres = p.filter("brow % 4 = 0 and bcol % 4 = 0").select(F.col("brow").alias("center_row"), F.col("bcol").alias("center_col")).distinct()
    return combined.stack_spots(p, centres, SMALL, separation=2.0)


@register("j15_refined_points", oracle("""
WITH p AS (SELECT gi, arg_max(y, row(v, -y, -x)) AS py, arg_max(x, row(v, -y, -x)) AS px, max(v) AS top FROM pixels GROUP BY gi),
n AS (SELECT p.gi, px, py, round_even(sum(x * greatest(v, 0)) / sum(greatest(v, 0)), 0)::BIGINT AS nx, round_even(sum(y * greatest(v, 0)) / sum(greatest(v, 0)), 0)::BIGINT AS ny
  FROM p JOIN pixels q ON q.gi = p.gi AND abs(q.x - px) <= 2 AND abs(q.y - py) <= 2 GROUP BY ALL)
SELECT gi, CASE WHEN abs(nx - px) <= 1 AND abs(ny - py) <= 1 THEN nx ELSE px END AS x, CASE WHEN abs(nx - px) <= 1 AND abs(ny - py) <= 1 THEN ny ELSE py END AS y FROM n""", "pixels"))
def refined_points(spark, sf_dir):
    p = A.pixels(spark, sf_dir)
    best = F.struct("v", -F.col("y"), -F.col("x"))
    points = p.groupBy("gi").agg(F.max_by("x", best).alias("x"), F.max_by("y", best).alias("y"))
    return combined.refined(points, p, 2, 1)


@register("j15_best_of_close")
def best_of_close(spark, sf_dir):
    p = A.peaks(spark, sf_dir).groupBy("scan", "brow", "bcol", "x", "y").agg(F.max("snr").alias("quality"), F.max("k1").alias("id"))
    keyed = p.withColumn("id", F.struct("id", "x", "y"))
    return combined.best_of_close(keyed, 25.0, ("scan", "brow", "bcol")).drop("id")


# Angles of the 8 by 8 frames start at the centre of the corner pixel.
LOW, RING = float(TTH.min()), 1.0
RINGED = f"rp AS (SELECT *, greatest(0, floor((tth - {LOW!r}::DOUBLE) / {RING!r}::DOUBLE))::BIGINT AS ring FROM tth_pixels)"


def _smoothed(values: str, half: int) -> str:
    """SQL of gi, ring, m: values (gi, ring, m) over all rings, mirrored at the ends and averaged over 2 half + 1."""
    return f"""(WITH w AS ({values}), t AS (SELECT gi, max(ring) AS top FROM w GROUP BY gi), a AS (SELECT t.gi, r.k AS ring, top, coalesce(m, 0) AS m FROM t, LATERAL (SELECT unnest(range(0, top + 1)) AS k) r LEFT JOIN w ON w.gi = t.gi AND w.ring = r.k),
 p AS (SELECT * FROM a UNION ALL SELECT gi, -1 - ring, top, m FROM a WHERE ring < {half} UNION ALL SELECT gi, 2 * top + 1 - ring, top, m FROM a WHERE ring > top - {half})
 SELECT gi, ring, m FROM (SELECT gi, ring, top, avg(m) OVER (PARTITION BY gi ORDER BY ring ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS m FROM p) WHERE ring BETWEEN 0 AND top)"""


CLEAN = f"cl AS (SELECT rp.* REPLACE (v - m AS v) FROM rp JOIN {_smoothed('SELECT gi, ring, median(v) AS m FROM rp GROUP BY gi, ring', 1)} USING (gi, ring))"
NOISE = f"ns AS (SELECT gi, ring, greatest(m, 0.001) AS noise FROM {_smoothed('SELECT gi, ring, median(abs(v - md)) AS m FROM cl JOIN (SELECT gi, ring, median(v) AS md FROM cl GROUP BY gi, ring) USING (gi, ring) GROUP BY gi, ring', 1)})"


@register("d7_ring_noise", oracle(f"WITH {RINGED}, {CLEAN}, {NOISE} SELECT gi, ring, round(noise, 6) AS noise FROM ns", "tth_pixels"))
def ring_noise(spark, sf_dir):
    clean = regions.less_ring_median(A.tth_pixels(spark, sf_dir), LOW, RING, 1)
    return _rounded(regions.ring_noise(clean, 1, 0.001), ["noise"])


@register("j14_annular_snr", oracle("""
WITH r AS (SELECT p.gi, p.y AS py, p.x AS px, p.v AS own, q.v FROM pixels p JOIN pixels q ON q.gi = p.gi AND (q.y - p.y) * (q.y - p.y) + (q.x - p.x) * (q.x - p.x) BETWEEN 2 AND 9),
m AS (SELECT gi, py, px, any_value(own) AS own, median(v) AS md, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT gi, py, px, any_value(m.own) AS own, any_value(md) AS md, any_value(n) AS n, median(abs(v - md)) AS mad FROM r JOIN m USING (gi, py, px) GROUP BY gi, py, px)
SELECT gi, py, px, round(CASE WHEN n < 10 THEN 0 ELSE (own - md) / greatest(1.4826::DOUBLE * mad, 0.01) END, 5) AS snr FROM s""", "pixels"))
def annular_snr(spark, sf_dir):
    p = A.pixels(spark, sf_dir)
    return _rounded(regions.annular_snr(p.select("gi", F.col("y").alias("py"), F.col("x").alias("px")), p, 1.4, 3), ["snr"], 5)


# Regions of the hot pixels `hot`: every pixel takes the least place that it can reach by side neighbours.
REGIONS = """hn AS MATERIALIZED (SELECT a.gi, a.y * 8 + a.x AS p, b.y * 8 + b.x AS q FROM hot a JOIN hot b ON a.gi = b.gi AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
 rc(gi, p, root) AS (SELECT gi, y * 8 + x, y * 8 + x FROM hot UNION SELECT rc.gi, hn.q, rc.root FROM rc JOIN hn ON hn.gi = rc.gi AND hn.p = rc.p WHERE rc.root < hn.q),
 rg AS MATERIALIZED (SELECT hot.*, root FROM hot JOIN (SELECT gi, p, min(root) AS root FROM rc GROUP BY gi, p) c ON hot.gi = c.gi AND hot.y * 8 + hot.x = c.p)"""


@register("l1_percentile_peaks", oracle(f"""
WITH RECURSIVE hot AS MATERIALIZED (SELECT p.* FROM tth_pixels p JOIN (SELECT gi, quantile_cont(v, 0.7) AS t FROM pixels GROUP BY gi) USING (gi) WHERE v >= t AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6), {REGIONS},
s AS (SELECT gi, root, trunc(avg(x))::BIGINT AS x, trunc(avg(y))::BIGINT AS y, count(*) AS npix FROM rg GROUP BY gi, root HAVING count(*) >= 3)
SELECT s.gi, s.x, s.y, npix, arg_min(reflection, row(abs(tth - two_theta), ord)) AS label FROM s JOIN tth_pixels p ON p.gi = s.gi AND p.y = s.y AND p.x = s.x, reflections GROUP BY s.gi, root, s.x, s.y, npix""", "tth_pixels", "reflections"))
def percentile_peaks(spark, sf_dir):
    return regions.percentile_peaks(A.tth_pixels(spark, sf_dir), A.reflections(spark, sf_dir), 8, 8, 0.7, edge=1, tile=3)


@register("d12_region_rules", oracle(f"""
WITH RECURSIVE hot AS MATERIALIZED (SELECT p.* FROM pixels p JOIN (SELECT gi, quantile_cont(v, 0.5) AS t FROM pixels GROUP BY gi) USING (gi) WHERE v >= t), {REGIONS},
s AS (SELECT gi, root, count(*) AS npix, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w, max(v) AS peak, sum(x * greatest(v, 0)) / nullif(sum(greatest(v, 0)), 0) AS lx, avg(x) AS ax FROM rg GROUP BY gi, root)
SELECT gi, root // 8 AS root_y, root % 8 AS root_x, npix, round(greatest(h, w) / least(h, w)::DOUBLE, 6) AS aspect, round(npix / (h * w)::DOUBLE, 6) AS fill, round(coalesce(lx, ax), 5) AS cx, round(peak, 6) AS peak
FROM s WHERE npix BETWEEN 2 AND 40 AND NOT (greatest(h, w) / least(h, w)::DOUBLE > 2 AND npix > 3) AND NOT (npix / (h * w)::DOUBLE < 0.5 AND npix > 8)""", "pixels"))
def region_rules(spark, sf_dir):
    p = A.pixels(spark, sf_dir)
    hot = p.join(p.groupBy("gi").agg(F.percentile("v", 0.5).alias("t")), "gi").filter("v >= t").select("gi", "y", "x", "v")
    good = regions.well_formed(regions.region_stats(regions.pixel_components(hot, 3), "v"), 2, 40, (2.0, 3), (0.5, 8))
    return _rounded(_rounded(good.select("gi", "root_y", "root_x", "npix", "aspect", "fill", "cx", "peak"), ["aspect", "fill", "peak"]), ["cx"], 5)


DUAL = {"ring": RING, "hat": 3, "window": 5, "tolerance": 1.0, "annular": 1.5, "local": 0.5, "floor": 0.5, "dark": -0.05, "edge": 1, "half": 1}


@register("l3_dual_snr_pixels", oracle(f"""
WITH {RINGED}, {CLEAN}, {NOISE.replace("0.001", "0.01")},
fm AS (SELECT gi, median(v) AS md, stddev_pop(v) AS sd FROM cl GROUP BY gi), ft AS (SELECT gi, md + 0.5 * CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad ELSE sd END AS threshold FROM (SELECT gi, any_value(md) AS md, any_value(sd) AS sd, median(abs(v - md)) AS mad FROM cl JOIN fm USING (gi) GROUP BY gi)),
ho AS (SELECT gi, y, x, greatest(v - o, 0) AS hat FROM {_opened(3, "cl")}),
mi AS (SELECT yk.k AS y0, xk.k AS x0, yk.k + dy.d AS yy, xk.k + dx.d AS xx FROM range(0, 8) AS yk(k), range(0, 8) AS xk(k), range(-2, 3) AS dy(d), range(-2, 3) AS dx(d)),
mr AS (SELECT y0, x0, CASE WHEN yy < 0 THEN -1 - yy WHEN yy > 7 THEN 15 - yy ELSE yy END AS y, CASE WHEN xx < 0 THEN -1 - xx WHEN xx > 7 THEN 15 - xx ELSE xx END AS x FROM mi),
lo AS (SELECT gi, y0 AS y, x0 AS x, sum(v) / 25 AS mean, sum(v * v) / 25 AS sq FROM mr JOIN cl USING (y, x) GROUP BY gi, y0, x0),
ro AS (SELECT gi, y FROM pixels GROUP BY gi, y HAVING avg(v) < -0.05), ga AS (SELECT DISTINCT gi, y + k AS y FROM ro, range(-5, 6) AS t(k))
SELECT cl.gi, cl.y, cl.x, round(cl.v, 5) AS v, round(hat / noise, 4) AS snr FROM cl JOIN ns USING (gi, ring) JOIN ho USING (gi, y, x) JOIN lo USING (gi, y, x) JOIN ft USING (gi) ANTI JOIN ga ON ga.gi = cl.gi AND ga.y = cl.y
WHERE hat / noise >= 1.5 AND (cl.v - mean) / greatest(sqrt(greatest(sq - mean * mean, 0)), 0.01) >= 0.5 AND cl.v >= threshold AND cl.y BETWEEN 1 AND 6 AND cl.x BETWEEN 1 AND 6
 AND EXISTS (SELECT 1 FROM reflections WHERE abs(tth - two_theta) <= 1.0)""", "tth_pixels", "reflections"))
def dual_snr_pixels(spark, sf_dir):
    out = regions.dual_snr_pixels(A.tth_pixels(spark, sf_dir), A.reflections(spark, sf_dir), 8, 8, LOW, **DUAL)
    return _rounded(_rounded(out, ["v"], 5), ["snr"], 4)


@register("l3_dual_snr_peaks")
def dual_snr_peaks(spark, sf_dir):
    return regions.dual_snr_peaks(A.tth_pixels(spark, sf_dir), A.reflections(spark, sf_dir), 8, 8, LOW, least=1, separation=3.0, fill=(0.08, 20), tile=4, **DUAL)


@register("l5_tight_band_peaks")
def tight_band_peaks(spark, sf_dir):
    scaled = A.tth_pixels(spark, sf_dir).withColumn("v", F.col("v") * 100)
    return regions.tight_band_peaks(scaled, A.reflections(spark, sf_dir), 8, 8, LOW, ring=RING, half=1, hats=(3, 5), tolerance=1.0, k=2.0, rescue_k=1.2, rescue_snr=2.0, rescue_ring=(1.5, 3), least=1, edge=1, separation=3.0, least_band=5, fewest=3, tile=4)


@register("d57_frame_floor", oracle("WITH m AS (SELECT gi, median(v) AS md, stddev_pop(v) AS sd FROM pixels GROUP BY gi) SELECT gi, round(md + 2.5 * CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad ELSE sd END, 6) AS threshold FROM (SELECT gi, any_value(md) AS md, any_value(sd) AS sd, median(abs(v - md)) AS mad FROM pixels JOIN m USING (gi) GROUP BY gi)", "pixels"))
def frame_floor(spark, sf_dir):
    return _rounded(image.robust_threshold(A.pixels(spark, sf_dir), ["gi"], 2.5).select("gi", "threshold"), ["threshold"])


SEEDS = "se AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY scan, label, brow ORDER BY snr DESC, id) = 1)"


@register("c26_seed_expansion", oracle(f"""
WITH RECURSIVE {UNIQUE}, {SEEDS}, ce AS MATERIALIZED (SELECT s.id AS seed, p.id, p.brow, p.bcol, p.x, p.y, p.snr FROM se s JOIN pk p ON p.scan = s.scan AND p.label = s.label AND (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 400
  AND greatest(abs(p.brow - s.brow), abs(p.bcol - s.bcol)) BETWEEN 1 AND 10 QUALIFY row_number() OVER (PARTITION BY s.id, p.brow, p.bcol ORDER BY p.snr DESC, p.id) = 1),
ex(seed, id, brow, bcol, x, y, snr) AS (SELECT id, id, brow, bcol, x, y, snr FROM se UNION SELECT ce.* FROM ex JOIN ce ON ce.seed = ex.seed AND abs(ce.brow - ex.brow) <= 1 AND abs(ce.bcol - ex.bcol) <= 1)
SELECT seed, id, brow, bcol, x, y, snr FROM ex""", "peaks"))
def seed_expansion(spark, sf_dir):
    """From the strongest peak of every scan, label and row of cells."""
    p = unique_peaks(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("scan", "label", "brow").orderBy(F.desc("snr"), "id"))
    seeds = p.withColumn("_n", first).filter("_n = 1").drop("_n")
    return spatial.expand_seeds(p, seeds, 20.0).drop("step")


def scan_frames(spark, sf_dir) -> DataFrame:
    """The frames as scans of 20 files each; every third scan's positions are marked recreated, every fourth has no y."""
    f, number = A.frames(spark, sf_dir), F.expr("file_idx div 20")
    return f.select(number.alias("scan"), "gi", "file_idx", "within_idx", "x_um", F.when(number % 4 != 1, F.col("y_um")).alias("y_um"), (number % 3 == 0).alias("recreated"))


SCANS = "sf AS (SELECT file_idx // 20 AS scan, gi, file_idx, within_idx, x_um, CASE WHEN (file_idx // 20) % 4 <> 1 THEN y_um END AS y_um, (file_idx // 20) % 3 = 0 AS recreated FROM frames)"
TURNS = """ss AS (SELECT *, sum(x_um) OVER (PARTITION BY scan ORDER BY gi ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) / 20 AS sm FROM sf),
st AS (SELECT *, CASE WHEN (round(sm, 6) > max(round(sm, 6)) OVER b AND round(sm, 6) > max(round(sm, 6)) OVER a) OR (round(sm, 6) < min(round(sm, 6)) OVER b AND round(sm, 6) < min(round(sm, 6)) OVER a) THEN 1 ELSE 0 END AS turn FROM ss
  WINDOW b AS (PARTITION BY scan ORDER BY gi ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY scan ORDER BY gi ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
sr AS (SELECT *, sum(turn) OVER (PARTITION BY scan ORDER BY gi)::BIGINT AS srow FROM st),
sp AS (SELECT * EXCLUDE (sm, turn), CASE WHEN srow % 2 = 0 THEN rk ELSE n - 1 - rk END AS scol FROM (SELECT *, row_number() OVER (PARTITION BY scan, srow ORDER BY gi) - 1 AS rk, count(*) OVER (PARTITION BY scan, srow) AS n FROM sr))"""


def _faithful_sql(n_cols: str) -> str:
    r = lambda a, b: f"round(coalesce(corr({a}, {b}), 0), 9)"
    return f"""
WITH {SCANS.replace("CASE WHEN (file_idx // 20) % 4 <> 1 THEN y_um END", "y_um")}, {TURNS}, ax AS (SELECT scan, abs({r("file_idx", "x_um")}) >= abs({r("file_idx", "y_um")}) AS rx FROM sp GROUP BY scan),
va AS (SELECT sp.*, CASE WHEN rx THEN x_um ELSE y_um END AS rv, CASE WHEN rx THEN y_um ELSE x_um END AS cv FROM sp JOIN ax USING (scan)),
sz AS (SELECT scan, floor(median(n)) AS med FROM (SELECT scan, file_idx, count(*) AS n FROM sf GROUP BY ALL) GROUP BY scan),
sa AS (SELECT scan, min(file_idx) AS r0, max(file_idx) AS r1, max(file_idx) - min(file_idx) + 1 AS n_rows, quantile_cont(rv, 0.002) AS ra, quantile_cont(rv, 0.998) AS rb, quantile_cont(cv, 0.002) AS ca, quantile_cont(cv, 0.998) AS cb,
  {r("scol", "cv")} < 0 AS back, {r("file_idx", "rv")} * {r("srow", "rv")} < 0 AS turned FROM va GROUP BY scan),
sb AS (SELECT *, greatest(1, {n_cols})::BIGINT AS n_cols FROM sa JOIN sz USING (scan)),
sc AS (SELECT va.scan, gi, file_idx, r0, r1, turned, n_rows, n_cols, back, cb > ca AS wide, CASE WHEN cb > ca THEN (cv - ca) / (cb - ca) ELSE 0 END AS share FROM va JOIN sb USING (scan))
SELECT scan, gi, CASE WHEN turned THEN r1 - file_idx ELSE file_idx - r0 END AS row, greatest(0, least(n_cols - 1, round_even(CASE WHEN back AND wide THEN 1 - share ELSE share END * (n_cols - 1), 0)))::BIGINT AS col, n_rows, n_cols FROM sc"""


def _faithful(spark, sf_dir, native: bool) -> DataFrame:
    f = scan_frames(spark, sf_dir).drop("y_um").join(A.frames(spark, sf_dir).select("gi", "y_um"), "gi")
    return mapping.faithful_grid(f, native, 20, 20).select("scan", "gi", "row", "col", "n_rows", "n_cols")


@register("e14_faithful_square", oracle(_faithful_sql("round_even(1 + (n_rows - 1) * greatest(cb - ca, 1e-9) / greatest(rb - ra, 1e-9), 0)"), "frames"))
def faithful_square(spark, sf_dir):
    return _faithful(spark, sf_dir, False)


@register("e14_faithful_native", oracle(_faithful_sql("med"), "frames"))
def faithful_native(spark, sf_dir):
    return _faithful(spark, sf_dir, True)


@register("e16_grid_sources", oracle(f"""
WITH {SCANS}, z AS (SELECT scan, file_idx, count(*) AS n FROM sf GROUP BY ALL), m AS (SELECT scan, n, count(*) AS k FROM z GROUP BY ALL), o AS (SELECT scan, arg_max(n, row(k, n)) AS modal, max(k) >= 0.9 * sum(k) AS per_row, sum(k)::BIGINT AS files FROM m GROUP BY scan),
k AS (SELECT scan, count(x_um) FILTER (NOT recreated) AS nx, count(y_um) FILTER (NOT recreated) AS ny FROM sf GROUP BY scan)
SELECT scan, files, modal, per_row, CASE WHEN nx > 0 AND ny = 0 THEN 'serpentine' WHEN nx > 0 AND per_row THEN 'file_per_row' WHEN nx > 0 THEN 'positions_xy' WHEN per_row THEN 'file_per_row' ELSE 'none' END AS coordinate_source FROM o JOIN k USING (scan)""", "frames"))
def grid_sources(spark, sf_dir):
    return mapping.grid_sources(scan_frames(spark, sf_dir))


@register("e16_grid_mapping", oracle(f"""
WITH {SCANS}, {TURNS}, y AS (SELECT scan, count(y_um) FILTER (NOT recreated) = 0 AND count(x_um) FILTER (NOT recreated) > 0 AS serp, min(file_idx) AS r0 FROM sf GROUP BY scan),
f AS (SELECT gi, row_number() OVER (PARTITION BY scan, file_idx ORDER BY within_idx) - 1 AS rk, count(*) OVER (PARTITION BY scan, file_idx) AS nf FROM sf)
SELECT sp.scan, gi, CASE WHEN serp THEN 'serpentine' ELSE 'file_per_row' END AS coordinate_source, CASE WHEN serp THEN srow ELSE file_idx - r0 END AS row,
  CASE WHEN serp THEN scol WHEN file_idx % 2 = 0 THEN f.rk ELSE nf - 1 - f.rk END AS col FROM sp JOIN y USING (scan) JOIN f USING (gi)""", "frames"))
def grid_mapping(spark, sf_dir):
    return mapping.grid_mapping(scan_frames(spark, sf_dir), reach=20, box=20).select("scan", "gi", "coordinate_source", "row", "col")


@register("k4_batch_bins", oracle("""
WITH f AS (SELECT (file_idx // 100)::VARCHAR AS scan, gi, file_idx - file_idx // 100 * 100 AS row, within_idx, file_idx % 2 AS odd, v, count(*) OVER (PARTITION BY file_idx) AS n, row_number() OVER (PARTITION BY file_idx ORDER BY within_idx) - 1 AS rk FROM frames)
SELECT scan, row // 5 AS brow, (CASE WHEN odd = 0 THEN rk ELSE n - 1 - rk END) // 5 AS bcol, round(sum(v), 5) AS total, count(*) AS n_frames FROM f GROUP BY ALL""", "frames"))
def batch_bins(spark, sf_dir):
    """Scans of 100 files laid out and binned as a resumable batch, a job a stage for all scans."""
    f = A.frames(spark, sf_dir)
    frames = f.select(F.expr("file_idx div 100").cast("string").alias("scan"), "gi", "file_idx", "within_idx", "x_um", "y_um", F.lit(False).alias("recreated"), "v")
    scans = [r.scan for r in frames.select("scan").distinct().orderBy("scan").collect()]  # names of scans, a few hundred frames each at least
    bins = ("bins", lambda _, done: grid.bin_sum(done["grid"], 5, ("scan",)))
    work = batch.Batch(spark, f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}")
    work.run_together(scans, [batch.grids_stage(frames), bins])
    return work.output("bins").select("scan", "brow", "bcol", F.round("total", 5).alias("total"), "n_frames")
