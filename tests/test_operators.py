"""Operators against known values and short sequential models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import detect, fit, graph, grid, qspace, spatial, study, territory
from gridloom.streaming import jobs


def test_regular_grid_runs_back_and_forth(spark):
    rows = {r.gi: (r.row, r.col) for r in grid.regular_grid(spark.range(100).withColumnRenamed("id", "gi"), 10).collect()}
    assert rows[10] == (1, 9) and rows[19] == (1, 0) and len(set(rows.values())) == 100


def test_links_and_components(spark):
    peaks = spark.createDataFrame([(1, 1, 0, 0, 50, 50), (1, 2, 0, 1, 51, 49), (1, 3, 1, 0, 200, 200)], "scan int, id long, brow int, bcol int, x int, y int")
    found = spatial.link_components(peaks, spatial.grid_links(peaks, 5.0)).groupBy("component").count().collect()
    assert sorted(r["count"] for r in found) == [1, 2]


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)] + [(7777, 7777)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_suppression_and_matching_equal_loops(spark):
    rng = random.Random(3)
    pts = [(0, k, float(rng.randrange(30)), float(rng.randrange(30))) for k in range(120)]
    kept = []
    for p in pts:
        if all((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 >= 25 for q in kept):
            kept.append(p)
    df = spark.createDataFrame(pts, "g int, rank long, x double, y double")
    assert sorted(r["rank"] for r in spatial.suppress(df, 5.0, ("g",)).collect()) == [k[1] for k in kept]
    pairs = [(rng.randrange(15), rng.randrange(15), float(rng.randrange(4))) for _ in range(90)]
    pairs = sorted({(i, j): d for i, j, d in pairs}.items())
    rows = spark.createDataFrame([(i, j, d) for (i, j), d in pairs], "i long, j long, d double")

    def loop(order):
        used_i, used_j, out = set(), set(), set()
        for (i, j), _ in sorted(pairs, key=order):
            if i not in used_i and j not in used_j:
                used_i.add(i), used_j.add(j), out.add((i, j))
        return out

    assert {(r.i, r.j) for r in spatial.greedy_match(rows).collect()} == loop(lambda p: (p[1], p[0]))
    assert {(r.i, r.j) for r in spatial.serial_match(rows).collect()} == loop(lambda p: (p[0][0], p[1], p[0][1]))
    assert {(r.i, r.j) for r in spatial.serial_match(rows, True).collect()} == loop(lambda p: (p[0][0], p[1], -p[0][1]))


def test_combined_device_values(spark):
    rows = [(0.0, "(001)", 2, 3, 50.0, 0), (20.5, "(001)", 2, 3, 200.0, 1), (4.0, "(001)", 2, 3, 120.0, 2), (4.0, "(002)", 0, 0, 80.0, 3)]
    out = study.combined_device(spark.createDataFrame(rows, "theta double, reflection string, brow int, bcol int, integrated double, ord long"))
    fused = {(r.brow, r.bcol): (r.max_intensity, r.argmax_theta, r.n_theta) for r in out.filter("level = 'fused'").collect()}
    assert fused == {(2, 3): (200.0, 20.5, 3), (0, 0): (80.0, 4.0, 1)}


def test_tracks_values(spark):
    rows = [(1, "(001)", 10.0, 20.0, 100.0), (2, "(001)", 10.4, 20.2, 200.0), (3, "(001)", 9.7, 19.8, 120.0), (4, "(001)", 40.0, 20.0, 50.0), (5, "(002)", 10.0, 20.0, 60.0)]
    df = spark.createDataFrame(rows, "feature_id long, reflection string, center_row double, center_col double, peak_intensity double")
    seeds = {r.feature_id: (r.reflection, r.seed) for r in study.tracks(df, 2.0).collect()}
    assert seeds == {1: ("(001)", 2), 2: ("(001)", 2), 3: ("(001)", 2), 4: ("(001)", 4), 5: ("(002)", 5)}


def test_unwrap(spark):
    df = spark.createDataFrame([("a", 0, -179.0), ("a", 1, 179.0)], "t string, o int, chi double")
    assert [r.chi_unwrapped for r in study.unwrapped(df, "chi", ["t"], ["o"]).orderBy("o").collect()] == [-179.0, -181.0]


def test_rocking_fit():
    t = np.arange(3.0, 6.01, 0.5)
    status, t0, fwhm, _, _, r2 = fit.fit_rocking(t, 5 + 100 * np.exp(-4 * math.log(2) * ((t - 4.5) / 1.5) ** 2))
    assert status == "fit" and abs(t0 - 4.5) < 0.05 and abs(fwhm - 1.5) < 0.1 and r2 > 0.999
    assert fit.fit_rocking(np.array([0.0, 20.5]), np.array([10.0, 80.0]))[:2] == ("too_sparse", 20.5)
    assert fit.fit_rocking(np.arange(5.0), np.arange(5.0))[0] == "monotonic"
    assert fit.fit_rocking(np.array([]), np.array([]))[0] == "empty"


def test_scalars(spark):
    row = spark.range(1).select(
        S.wavelength(F.lit(15000.0)).alias("w"), S.microstrain(F.lit(7.6), F.lit(7.5)).alias("e"), S.microstrain(F.lit(None).cast("double"), F.lit(7.5)).alias("n"),
        S.wrap180(F.lit(190.0)).alias("a"), S.cell_key(F.lit(3), F.lit(4)).alias("k"), S.duration(F.lit(3725)).alias("d"),
    ).first()
    assert abs(row.w - 0.8266) < 1e-4 and row.e < 0 and row.n is None and row.a == -170.0 and row.k == "3_4" and row.d == "1h 02m"


def test_geometry_recovery(spark):
    beam, pixel = (30.5, -4.0, 0.33), 75e-4
    px = spark.range(40 * 30).select((F.col("id") % 30).alias("x"), F.expr("id div 30").alias("y"))
    tth = px.withColumn("tth", S.flat_tth(F.col("y"), F.col("x"), *beam, pixel))
    row, col, dist = qspace.recover_geometry(tth, (20.0, 0.0, 0.3), pixel)
    assert abs(row - beam[0]) < 0.5 and abs(col - beam[1]) < 0.5 and abs(dist - beam[2]) < 1e-3


def test_detector_finds_a_spot():
    rng = np.random.default_rng(0)
    image = rng.random((60, 60))
    image[28:32, 28:32] = 100
    tth = np.full((60, 60), 13.0)
    peaks = detect.find_peaks(image, tth, np.zeros((60, 60), int), [("a", 13.0)], detect.Detector(60, 60))
    assert len(peaks) == 1 and abs(peaks[0][1] - 29.5) < 1 and peaks[0][4] == 16


def test_pixel_components_are_4_connected():
    mask = np.array([[1, 1, 0], [0, 0, 1], [1, 0, 1]], bool)
    assert detect.label_components(mask).max() == 3


def test_territories_hold_every_point(spark, data):
    pts = spark.createDataFrame([(1, k, float(k % 10), float(k // 10)) for k in range(100)], "scan int, id long, x double, y double")
    got = territory.grow(pts, 12, 1.5).collect()
    assert len(got) == 100 and len({r.id for r in got}) == 100
    assert max(sum(1 for r in got if r.tid == t) for t in {r.tid for r in got}) <= 12


def test_territories_find_their_neighbours_in_their_task(spark):
    rng = np.random.default_rng(4)
    rows = [(int(s), int(i), float(x), float(y)) for s in range(3) for i, (x, y) in enumerate(rng.integers(0, (9, 30)[s % 2], (120, 2)) * 0.5)]
    rows += [(3, 0, 1.0, 1.0), (4, 0, 1.0, 1.0), (4, 1, 90.0, 1.0), (4, 2, None, 1.0), (5, 0, 2.0, 2.0), (5, 1, 2.0, 2.0), (5, 2, 2.0, 2.0), (6, 1, 0.0, 0.0), (6, 2, 5e3, 0.0), (6, 3, 5e3, 7.0)]
    pts = spark.createDataFrame(rows, "scan int, id long, x double, y double")
    for k in (3, 8):
        want = {(r.scan, r.id, r.r_id) for r in spatial.nearest_neighbours(pts, k, 2.5, ("scan",)).collect()}
        got = set()
        for s in range(7):
            own = [r for r in rows if r[0] == s]
            ids, x, y = np.array([r[1] for r in own]), np.array([r[2] for r in own], dtype=float), np.array([r[3] for r in own], dtype=float)
            got |= {(s, int(ids[a]), int(ids[b])) for a, b in zip(*territory.near_pairs(ids, x, y, k, 2.5), strict=True)}
        assert got == want
    plan = territory.grow(pts, 12, 1.5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("mode", ["update", "complete"])
def test_stream_equals_batch(spark, data, tmp_path, mode):
    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = f"rates_{mode}"
    jobs.run_to_table(jobs.event_rates(stream.withColumn("ts", F.date_trunc("hour", "ts")), late="60 days"), name, mode, str(tmp_path / "cp")).awaitTermination(120)
    want = {(r.window.start, r.event_type): r.n for r in jobs.event_rates(events).collect()}
    got: dict = {}
    for r in spark.table(name).collect():
        got[(r.window.start, r.event_type)] = max(r.n, got.get((r.window.start, r.event_type), 0))
    assert got == want


def test_ingest_merges_latest(spark, data, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 5)], "k string, v int").write.parquet(src)
    stream = spark.readStream.schema("k string, v int").parquet(src)

    def upsert(batch, n):
        jobs.merge_latest(spark.createDataFrame([("a", 9)], "k string, v int"), batch, "k", "v").write.parquet(f"{out}/{n}")

    jobs.ingest(stream, upsert, str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.k, r.v) for r in spark.read.parquet(f"{out}/0").collect()} == {("a", 9), ("b", 5)}


def test_no_cross_joins_in_distance_plans(spark, data):
    from gridloom.plans.spatial_queries import candidate_pairs

    plan = candidate_pairs(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_profile_peaks_and_blobs():
    v = np.array([0, 1, 0, 5, 4.9, 5.2, 0, 0.1, 0, 9, 0], dtype=float)
    assert detect.profile_peaks(v, share=0.1) == [9, 5, 1]
    image = np.zeros((40, 40))
    image[20, 20] = 10
    assert np.unravel_index(detect.blob_response(image + np.random.default_rng(1).random((40, 40)) * 0.1).argmax(), image.shape) == (20, 20)


def test_nearest_neighbours_reach_sparse_points(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(30)] + [(1, 30, 400.0, 0.0), (1, 31, 0.0, -90.0), (2, 0, 0.0, 0.0), (2, 1, 7000.0, 5.0), (3, 0, 1.0, 1.0), (1, 40, None, 0.0), (1, 41, float("nan"), 0.0)]
    got = spatial.nearest_neighbours(spark.createDataFrame(rows, "scan long, id long, x double, y double"), 3, 2.5, ("scan",)).collect()
    want = set()
    for s, i, x, y in rows[:-2]:
        others = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for t, j, u, v in rows[:-2] if t == s and j != i)
        want |= {(s, i, j, n + 1) for n, (_, j) in enumerate(others[:3])}
    assert {(r.scan, r.id, r.r_id, r["rank"]) for r in got} == want and len(got) == len(want)
