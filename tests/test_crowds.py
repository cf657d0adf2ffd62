"""Crowded tables: many rows on one place, whose pairs must not be listed, against plain loops."""

import math
import random

import pytest

from gridloom.operators import compare, spatial


def crowd(n, seed, places=6):
    rng = random.Random(seed)
    return [(rng.randrange(2), k, float(rng.randrange(places)), float(rng.randrange(places))) for k in range(n)]


def rows(spark, pts):
    return spark.createDataFrame(pts, "g int, id long, x double, y double")


def no_pairs(monkeypatch):
    def stop(*_, **__):
        raise AssertionError("lists all pairs")

    monkeypatch.setattr(spatial, "distance_join", stop)


def test_nearest_neighbours_of_a_crowd(spark, monkeypatch):
    no_pairs(monkeypatch)
    pts = crowd(90, 1) + [(5, 500, 0.0, 0.0), (5, 501, 1e6, 0.0), (6, 502, 1.0, 1.0)]
    got = sorted((r.id, r.r_id, r["rank"]) for r in spatial.nearest_neighbours(rows(spark, pts), 3, 10.0, ("g",)).collect())
    want = []
    for p in pts:
        near = sorted((math.dist(p[2:], q[2:]), q[1]) for q in pts if q[0] == p[0] and q[1] != p[1])[:3]
        want += [(p[1], q, n + 1) for n, (_, q) in enumerate(near)]
    assert got == sorted(want)


def test_nearest_match_of_a_crowd(spark):
    a, b = crowd(80, 2, 30), crowd(40, 3, 30) + [(7, 900, 1.0, 1.0)]
    for most in (1.0, 4.0, 9.0):
        got = sorted((r.i, r.j, r.d) for r in spatial.nearest_match(rows(spark, a), rows(spark, b), most, ("g",)).collect())
        want = [(p[1], *min((math.dist(p[2:], q[2:]), q[1]) for q in b if q[0] == p[0])[::-1]) for p in a if any(q[0] == p[0] for q in b)]
        assert got == sorted(w for w in want if w[2] <= most)


def test_suppression_of_a_crowd(spark, monkeypatch):
    no_pairs(monkeypatch)
    for seed, distance in ((4, 2.0), (5, 5.0), (6, 7.5)):
        pts = crowd(150, seed, 25)
        kept = []
        for p in pts:
            if all(q[0] != p[0] or math.dist(p[2:], q[2:]) >= distance for q in kept):
                kept.append(p)
        df = rows(spark, pts).withColumnRenamed("id", "rank")
        assert sorted(r["rank"] for r in spatial.suppress(df, distance, ("g",)).collect()) == [p[1] for p in kept]


def test_matches_of_a_crowd_equal_loops(spark, monkeypatch):
    no_pairs(monkeypatch)
    for places in (4, 15):
        a, b = crowd(70, 8, places), [(g, k + 1000, x, y) for g, k, x, y in crowd(60, 9, places)]
        pairs = [(math.dist(p[2:], q[2:]), p[1], q[1]) for p in a for q in b if p[0] == q[0] and math.dist(p[2:], q[2:]) <= 3.0]
        orders = {"greedy": lambda t: t, "serial": lambda t: (t[1], t[0], t[2]), "serial_last": lambda t: (t[1], t[0], -t[2])}
        for order, key in orders.items():
            taken_i, taken_j, want = set(), set(), []
            for d, i, j in sorted(pairs, key=key):
                if i not in taken_i and j not in taken_j:
                    taken_i.add(i), taken_j.add(j), want.append((i, j, d))
            got = spatial.match_points(rows(spark, a), rows(spark, b), 3.0, ("g",), order).collect()
            assert sorted((r.i, r.j, r.d) for r in got) == sorted(want)


def test_rank_correlation_of_a_constant(spark):
    df = spark.createDataFrame([("a", 20, 1.0), ("a", 20, 2.0), ("b", 1, 1.0), ("b", 2, 3.0), ("b", 3, 2.0), ("c", 1, 1.0)], "g string, n long, v double")
    got = {r.g: round(r.rho, 6) for r in compare.spearman(df, "n", "v", ["g"]).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_rank_correlation_equals_sql_where_every_patch_is_full(spark, tmp_path):
    import datetime

    import duckdb

    from gridloom.plans import registry

    start, rng, rows = datetime.datetime(2024, 1, 1), random.Random(14), []
    for day in range(6):
        for hour in range(4):
            for user in range(5):
                for kind in ("full", "gaps"):
                    if kind == "full" or rng.random() < 0.3 + 0.1 * day:
                        rows.append((len(rows), start + datetime.timedelta(days=day, hours=hour), user, kind, None if kind == "gaps" and day == 5 else rng.random(), '{"k": 1}'))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.sql(registry.oracle_sql()["d46_spearman"]).fetchall())
    got = {r.reflection: r.rho for r in registry.queries()["d46_spearman"](spark, str(tmp_path)).collect()}
    assert math.isnan(want["full"]) and math.isnan(got["full"])
    assert abs(want["gaps"]) < 1 and abs(got["gaps"] - want["gaps"]) < 1e-9


def test_components_of_a_crowd_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "grid_links", None)
    rng = random.Random(11)
    for n, tolerance, span in ((120, 2.0, 60.0), (400, 5.0, 100.0), (300, 3.0, 8.0)):
        pts = [(rng.randrange(2), rng.randrange(12), rng.randrange(20), round(rng.uniform(-5, span), 1), float(rng.randrange(int(span))), k) for k in range(n)]
        pts += [(*p[:5], n + k) for k, p in enumerate(pts[:30])] + [(0, 11, 19, 700.0, 0.0, 3), (1, 3, 3, float("nan"), 1.0, 5000), (1, 3, None, 1.0, 1.0, 5001)]
        root = {p[5]: p[5] for p in pts}

        def top(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for p in pts:
            for q in pts:
                if p[0] == q[0] and None not in (p[2], q[2]) and p[1:3] != q[1:3] and max(abs(p[1] - q[1]), abs(p[2] - q[2])) <= 1 and (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 <= tolerance**2:
                    a, b = top(p[5]), top(q[5])
                    root[max(a, b)] = min(a, b)
        df = spark.createDataFrame(pts, "scan int, brow long, bcol long, x double, y double, id long")
        got = spatial.grid_components(df, tolerance).collect()
        assert sorted((r.id, r.component) for r in got) == sorted((p[5], top(p[5])) for p in pts)


def test_boxes_of_a_crowd_equal_loops(spark):
    rng = random.Random(12)
    for n, span in ((300, 40), (6000, 12)):
        boxes = [(rng.randrange(2), k, x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)) for k, x, y in ((k, rng.randrange(-span, span), rng.randrange(span)) for k in range(n))]
        want, kept = [], {0: set(), 1: set()}
        for g, k, *b in boxes:
            if not any(o[0] <= b[0] and o[1] <= b[1] and o[2] >= b[2] and o[3] >= b[3] for o in kept[g]):
                kept[g].add(tuple(b))
                want.append(k)
        got = spatial.containing_boxes(spark.createDataFrame(boxes, "g int, rank long, x0 long, y0 long, x1 long, y1 long"), ("g",))
        assert sorted(r["rank"] for r in got.collect()) == want
        assert "explode(sequence" not in got._jdf.queryExecution().logical().toString()


def test_batch_runs_scans_together(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridloom.operators import batch

    calls = []

    def one(scans, _):
        calls.append(len(scans))
        if "bad" in scans:
            raise RuntimeError("broken")
        return spark.createDataFrame([(s, k) for s in scans for k in range(3)], "scan string, k int")

    def two(scans, done):
        assert {r.scan for r in done["one"].collect()} == set(scans)
        return done["one"].groupBy("scan").agg(F.sum("k").alias("k"))

    names = [f"s{n}" for n in range(15)] + ["bad"]
    work = batch.Batch(spark, str(tmp_path / "b"))
    state = {(r.scan, r.stage): r.state for r in work.run_together(names, [("one", one), ("two", two)]).collect()}
    assert state["bad", "one"] == "failed" and ("bad", "two") not in state and sum(v == "done" for v in state.values()) == 30
    assert len(calls) <= 9 and sorted((r.scan, r.k) for r in work.output("two").collect()) == sorted((n, 3) for n in names[:15])
    calls.clear()
    work.run_together(names[:15], [("one", one), ("two", two)])
    assert calls == []


def test_small_tiles_and_rings_cost_no_call_each(spark):
    from gridloom.operators import regions

    rng = random.Random(13)
    px = spark.createDataFrame([(g, y, x, rng.random()) for g in range(40) for y in range(7) for x in range(7) if rng.random() < 0.9], "gi long, y long, x long, v double")
    plan = regions.annular_snr(px.selectExpr("gi", "y as py", "x as px"), px, 1.4, 3)._jdf.queryExecution().logical().toString()
    assert "explode(array(struct" not in plan
    v = {(r.gi, r.y, r.x): r.v for r in px.collect()}
    got = {(r.gi, r.py, r.px): r.snr for r in regions.annular_snr(px.selectExpr("gi", "y as py", "x as px"), px, 1.4, 3).collect()}
    assert set(got) == set(v)
    middle = lambda s: (s[(len(s) + 1) // 2 - 1] + s[len(s) // 2]) / 2
    for (g, y, x), own in v.items():
        ring = sorted(v[g, b, a] for b in range(7) for a in range(7) if (g, b, a) in v and 1.4**2 <= (a - x) ** 2 + (b - y) ** 2 <= 9)
        m = middle(ring) if ring else 0
        want = (own - m) / max(1.4826 * middle(sorted(abs(q - m) for q in ring)), 0.01) if len(ring) >= 10 else 0.0
        assert abs(got[g, y, x] - want) < 1e-9


def test_graph_links_meet_by_place(spark):
    pts = rows(spark, [(g, k, x * 7, y * 7) for g, k, x, y in crowd(60, 21, 12)]).withColumnRenamed("g", "tid")
    edges = spark.createDataFrame([(0, 1)], "a int, b int")
    links = spatial.graph_links(pts, edges, 8.0)
    assert "cx" in links._jdf.queryExecution().optimizedPlan().toString()
    p = pts.collect()
    assert sorted(map(tuple, links.collect())) == sorted((a.id, b.id) for a in p for b in p if a.id < b.id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 64)


def test_falling_pairs_of_a_crowd_are_counted_without_comparing_them(monkeypatch):
    import numpy as np

    from gridloom.operators import voigt

    monkeypatch.setattr(voigt, "PAIRS", 0)
    rng = np.random.default_rng(3)
    for n in (1, 2, 8, 65, 300):
        d, v = rng.integers(0, 9, n) * 0.1, rng.integers(0, 5, n) / 4
        far = d[None, :] - d[:, None] >= 0.1
        falls = (far & (v[None, :] < v[:, None])).sum()
        assert voigt.falling_share(d, v) == (far.sum(), falls / far.sum() if far.sum() else 0.0)
    assert voigt.falling_share(rng.random(200_000), rng.random(200_000))[0] > 1e10


def test_fit_of_repeated_distances_is_folded():
    import numpy as np

    from gridloom.operators import voigt

    d, v, w = np.array([0.0, 1, 1, 1, 2]), np.array([1.0, 0.5, 0.7, 0.2, 0.1]), np.array([1.0, 0.5, 0.7, 0.2, 0.1])
    each, mean, weight, rest = voigt._folded(d, v, w)
    f = lambda r: 0.9 * np.exp(-r)
    assert len(each) == 3 and abs(((weight * (f(each) - mean)) ** 2).sum() + rest - ((w * (f(d) - v)) ** 2).sum()) < 1e-12


def banded(spark, n, seed, span):
    rng = random.Random(seed)
    pts = [(rng.randrange(2), k, rng.randrange(14), rng.randrange(30), rng.choice([rng.uniform(-span, span), float(rng.randrange(4))]), rng.uniform(0, span)) for k in range(n)]
    return pts, spark.createDataFrame([*pts, (0, 9000, 1, 1, math.nan, 0.0), (1, 9001, None, 1, 1.0, 1.0)], "scan int, id long, brow long, bcol long, x double, y double")


def near(a, b, tolerance):
    return a[0] == b[0] and (a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2 <= tolerance**2


def test_row_reach_links_deal_no_point_to_nine_cells(spark):
    for n, span in ((500, 90.0), (400, 3.0)):
        pts, df = banded(spark, n, 31, span)
        links = spatial.row_reach_links(df, 3.0, 16)
        assert "Join" not in links._jdf.queryExecution().optimizedPlan().toString()
        want = [(a[0], a[1], b[1]) for a in pts for b in pts if near(a, b, 3.0) and abs(a[3] - b[3]) <= 16 and (b[2] == a[2] + 1 or b[2] == a[2] and a[3] < b[3])]
        assert sorted(map(tuple, links.collect())) == sorted(want)


def test_grid_links_deal_no_point_to_nine_cells(spark):
    for n, span in ((500, 90.0), (400, 3.0)):
        pts, df = banded(spark, n, 33, span)
        links = spatial.grid_links(df, 5.0)
        assert "Join" not in links._jdf.queryExecution().optimizedPlan().toString()
        want = [(a[0], a[1], b[1]) for a in pts for b in pts if near(a, b, 5.0) and (b[2] - a[2], b[3] - a[3]) in ((0, 1), (1, -1), (1, 0), (1, 1))]
        assert sorted(map(tuple, links.collect())) == sorted(want)


def test_candidate_pairs_deal_no_point_to_nine_cells(spark, data):
    from gridloom.plans import spatial_queries

    assert "Join" not in spatial_queries.candidate_pairs(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    pts, df = banded(spark, 400, 34, 30.0)
    got = spatial.banded_pairs(df.select("id", "x", "y", "brow", "bcol", "scan").withColumnsRenamed({"brow": "row", "bcol": "col"}), ((1, 0, 0),), 20.0, ("scan",)).collect()
    assert sorted((r.src, r.dst, r.d) for r in got) == sorted((a[1], b[1], math.sqrt((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2)) for a in pts for b in pts if near(a, b, 20.0) and b[2] == a[2] + 1 and b[3] == a[3])


def test_links_of_a_peak_follow_each_other(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(spatial, "PAIR_POINTS", 50)
    for span, most in ((90.0, 300), (3.0, 40)):
        pts, df = banded(spark, 600, 35, span)
        for tolerance, rows in ((5.0, most), (0.5, 7)):
            monkeypatch.setattr(spatial, "PAIR_ROWS", rows)
            got = spatial.grid_links(df, tolerance).withColumn("part", F.spark_partition_id()).collect()
            want = [(a[0], a[1], b[1]) for a in pts for b in pts if near(a, b, tolerance) and (b[2] - a[2], b[3] - a[3]) in ((0, 1), (1, -1), (1, 0), (1, 1))]
            assert sorted(r[:3] for r in got) == sorted(want)
            runs = [r[1] for last, r in zip([None, *got], got, strict=False) if last is None or (last.part, last.src) != (r.part, r.src)]
            assert len(runs) == len(set(runs))


def odd_items(spark, folder):
    """Line items of which some share their keys, with and without a quantity."""
    import datetime

    import duckdb

    rng, rows = random.Random(36), []
    for k in range(400):
        keys = (rng.randrange(6), rng.randrange(5), rng.randrange(40))
        rows += [(*keys, k % 3, q, 1.0, 0.05, 0.0, "A", "F", datetime.datetime(2024, 1, 1)) for q in rng.choice([(7.0,), (9.0, None), (None,), (12.0, 8.0, None)])]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["c1_grid_links", "c3_row_reach_links", "c8_candidate_pairs", "c2_graph_links"])
def test_links_of_peaks_without_a_place_equal_sql(spark, tmp_path, name):
    from conftest import same_as_oracle

    from gridloom.plans import registry

    con = odd_items(spark, str(tmp_path))
    assert len(con.sql(registry.oracle_sql()[name]).fetchall()) > 100
    same_as_oracle(spark, con, str(tmp_path), registry.queries()[name], registry.oracle_sql()[name])


def test_graph_links_deal_no_peak_to_nine_cells(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(37)
    monkeypatch.setattr(spatial, "PAIR_PARTS", 3)
    pts = [(rng.randrange(6), rng.randrange(500), rng.uniform(-40, 300) if k % 2 else float(rng.randrange(5)), float(rng.randrange(8))) for k in range(500)]
    edges = [(0, 1), (1, 0), (1, 2), (3, 3), (4, 9), (5, 0), (None, 2)]
    df = spark.createDataFrame([*pts, (None, 900, 1.0, 1.0), (2, 901, math.nan, 1.0)], "tid int, id long, x double, y double")
    links = spatial.graph_links(df, spark.createDataFrame(edges, "a int, b int"), 3.0)
    assert "explode(sequence(-1, 1" not in links._jdf.queryExecution().logical().toString().lower()
    beside = {(a, a) for a in range(6)} | {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    want = [(a[1], b[1]) for a in pts for b in pts if a[1] < b[1] and (a[0], b[0]) in beside and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 9]
    got = links.withColumn("part", F.spark_partition_id()).collect()
    assert len(want) > 1000 and sorted(r[:2] for r in got) == sorted(want)
