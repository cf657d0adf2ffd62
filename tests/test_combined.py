"""The whole-scan search against a plain loop, stacks, refinement and deduplication against serial versions."""

import math
from collections import defaultdict

import numpy as np
import pytest

from gridloom.operators import combined, detect, voigt

H = W = 40
TTH = np.degrees(np.arctan2(0.5 * np.hypot(*(np.mgrid[0:H, 0:W] + 0.5)), 60.0))
SEARCH = combined.Search(TTH, (("a", 5.0), ("b", 10.0)), ring_width=0.5, tolerance=3.0, hats=(7,), k_sigma=5.0, edge=1, separation=6.0, min_band=20)


@pytest.fixture(scope="module")
def scan():
    """12 by 12 frames with three spots that fade over cells, one that does not, and noise."""
    rng, out = np.random.default_rng(8), {}
    y, x = np.mgrid[0:H, 0:W]
    spots = [(3, 3, 10, 12, 1.5), (8, 7, 18, 16, 2.0), (6, 2, 4, 24, 1.2), (5, 5, 22, 6, 50.0)]
    for r in range(12):
        for c in range(12):
            image = 20 + 5 * np.cos(TTH) + rng.normal(0, 1.0, (H, W))
            for sr, sc, py, px, wide in spots:
                image += 400 * math.exp(-((r - sr) ** 2 + (c - sc) ** 2) / (2 * wide**2)) * np.exp(-((y - py) ** 2 + (x - px) ** 2) / 2.5)
            out[r, c] = image
    return out


@pytest.fixture(scope="module")
def frames(spark, scan):
    return spark.createDataFrame([(r, c, i.ravel().tolist()) for (r, c), i in scan.items()], "brow int, bcol int, pixels array<double>").cache()


def brute(scan, s):
    clipped = {k: np.clip(i, 0, 1e9) for k, i in scan.items()}
    bg = detect.radial_background(sum(clipped.values()), s.ring, s.smooth) / len(scan)
    nodes = [(k, p) for k in sorted(clipped) for p in combined.spots(clipped[k] - bg, s)]
    group = list(range(len(nodes)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, ((r, c), p) in enumerate(nodes):
        for j, ((q, d), o) in enumerate(nodes[:i]):
            if 0 < max(abs(r - q), abs(c - d)) <= 1 and (p[1] - o[1]) ** 2 + (p[2] - o[2]) ** 2 <= s.link**2:
                group[find(i)] = find(j)
    parts = defaultdict(list)
    for i, n in enumerate(nodes):
        parts[find(i)].append(n)
    kept = []
    for part in parts.values():
        if len({k for k, _ in part}) < s.min_cells:
            continue
        w = np.maximum([p[3] for _, p in part], 0.1)
        px, py = (round(float(np.dot(w, [p[i] for _, p in part]) / w.sum())) for i in (1, 2))
        (cr, cc), _ = max(part, key=lambda n: n[1][3])
        a = s.aperture
        box = (slice(max(0, py - a), py + a + 1), slice(max(0, px - a), px + a + 1))
        net = {k: float((clipped[k][box] - bg[box]).sum()) for k in clipped if max(abs(k[0] - cr), abs(k[1] - cc)) <= s.radius}
        v = np.array(list(net.values()))
        norm = v / (v.max() + 1e-10)
        at = np.array(list(net))
        light = np.maximum(norm, 0)
        dist = np.hypot(*(at - (at * light[:, None]).sum(0) / light.sum()).T)
        md = np.median(norm)
        noise = 1.4826 * np.median(np.abs(norm - md))
        level = max(0.08, md + 1.5 * noise)
        n_signal = int((norm > level).sum())
        inner, outer = norm[dist <= 2.5], norm[dist > 2.5]
        if np.mean(norm <= norm[list(net).index((cr, cc))]) < 0.12 or n_signal < 2 or norm.std() / norm.mean() < 0.1:
            continue
        if len(inner) >= 2 and len(outer) >= 3 and inner.mean() / outer.mean() < 1.15:
            continue
        if n_signal > 2 and voigt.fit_profile(dist, norm, n_signal, s.rules)[0]:
            kept += [(p[0], p[1], p[2], *k) for k, p in part]
    return sorted(kept)


def test_full_scan_equals_a_loop_over_frames(spark, frames, scan):
    rows, verdict = combined.full_scan(frames, SEARCH)
    rows = rows.collect()
    want = brute(scan, SEARCH)
    assert len(want) > 20 and sorted((r.label, r.x, r.y, r.brow, r.bcol) for r in rows) == want
    assert sorted(r.feature_id for r in rows) == list(range(1, len(rows) + 1))
    assert [(r.brow, r.bcol) for r in sorted(rows, key=lambda r: r.feature_id)] == sorted((r.brow, r.bcol) for r in rows)
    kept = {(r.center_row, r.center_col) for r in verdict.filter("kept").collect()}
    assert kept == {(3, 3), (8, 7), (6, 2)} and verdict.filter("reason like 'flat%'").count() >= 1
    assert combined.full_scan(frames.limit(0), SEARCH)[0].count() == 0


def test_frames_of_one_small_file_are_searched_in_all_tasks(spark, frames, scan):
    one, background = frames.coalesce(1), np.full((H, W), 20.0)
    found = combined.detect_frames(one, background, SEARCH)
    assert found.rdd.getNumPartitions() == combined.detect_stacks(one, SEARCH).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = sorted((*k, *s[:3]) for k, i in scan.items() for s in combined.spots(np.clip(i, 0, 1e9) - background, SEARCH))
    assert want and sorted((r.brow, r.bcol, r.label, r.x, r.y) for r in found.collect()) == want


def test_probe_reads_the_frames_once(spark, frames, tmp_path):
    frames.write.parquet(str(tmp_path / "f"))
    found = spark.createDataFrame([(1, 10, 12, 3, 3), (2, 20, 25, 8, 7)], "component long, px int, py int, center_row int, center_col int")
    out = combined.probe(spark.read.parquet(str(tmp_path / "f")), found, np.zeros((H, W)), 2, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and out.groupBy("component").count().filter("count = 25").count() == 2


def test_running_windows():
    rng = np.random.default_rng(9)
    for shape in ((30, 41), (7, 50), (64,)):
        a = rng.normal(0, 1, shape)
        for size in (1, 3, 5, 7, 13, 15):
            for axis in range(a.ndim):
                pad = [(size // 2, size // 2) if i == axis else (0, 0) for i in range(a.ndim)]
                view = np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, mode="symmetric"), size, axis=axis)
                for fn in (np.min, np.max, np.mean):
                    assert np.allclose(detect.running(a, size, axis, fn), fn(view, axis=-1), atol=1e-12)


def test_labels_of_sparse_pixels():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.4, 0.6, 0.9):
        mask = rng.random((30, 23)) < share
        y, x = np.nonzero(mask)
        dense, sparse = detect.label_components(mask)[y, x], detect.sparse_components(y, x)
        assert len(set(zip(dense, sparse))) == len(set(dense)) == len(set(sparse))
    assert len(detect.sparse_components(np.zeros(0, int), np.zeros(0, int))) == 0


def test_stacks_show_what_single_frames_hide(spark, scan):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:H, 0:W]
    faint = {k: 20 + rng.normal(0, 4, (H, W)) + 9 * np.exp(-((y - 15) ** 2 + (x - 22) ** 2) / 3) * (max(abs(k[0] - 5), abs(k[1] - 5)) <= 3) for k in scan}
    rows = [(*k, int(a), int(b), float(i[a, b])) for k, i in faint.items() for a in range(H) for b in range(W)]
    pixels = spark.createDataFrame(rows, "brow int, bcol int, y int, x int, v double")
    centres = spark.createDataFrame([(5, 5), (5, 5), (0, 0)], "center_row int, center_col int")
    sums = combined.concentric_sums(pixels, centres, (1, 3, 5)).filter("y = 15 and x = 22").collect()
    for r in sums:
        for k in (1, 3, 5):
            cells = [c for c in faint if max(abs(c[0] - r.center_row), abs(c[1] - r.center_col)) <= k]
            assert r[f"n{k}"] == len(cells) and r[f"s{k}"] == pytest.approx(sum(faint[c][15, 22] for c in cells))
    found = combined.stack_spots(pixels, centres, SEARCH, (3, 5)).collect()
    assert any(abs(s.x - 22) <= 1 and abs(s.y - 15) <= 1 for s in found if (s.brow, s.bcol) == (5, 5))
    alone = combined.spots(faint[5, 5] - detect.radial_background(faint[5, 5], SEARCH.ring, 15), SEARCH)
    assert not any(abs(s[1] - 22) <= 1 and abs(s[2] - 15) <= 1 for s in alone)


def test_refinement_and_close_points_equal_a_serial_version(spark):
    rng = np.random.default_rng(6)
    image = rng.normal(0, 1, (60, 60))
    pixels = spark.createDataFrame([(g, int(a), int(b), float(image[a, b])) for g in (1, 2) for a in range(60) for b in range(60)], "gi int, y long, x long, v double")
    rows = [(k, int(rng.integers(1, 3)), int(rng.integers(0, 60)), int(rng.integers(0, 60)), float(rng.integers(0, 20))) for k in range(120)] + [(500, 9, 5, 5, 1.0)]
    points = spark.createDataFrame(rows, "id int, gi int, x long, y long, quality double")
    moved = {}
    for k, g, x, y, q in rows:
        a, b, c, d = max(0, y - 3), min(60, y + 4), max(0, x - 3), min(60, x + 4)
        w = np.maximum(image[a:b, c:d], 0)
        yy, xx = np.mgrid[a:b, c:d]
        nx, ny = round(float((xx * w).sum() / w.sum())), round(float((yy * w).sum() / w.sum()))
        moved[k] = (g, nx, ny, q) if g < 9 and abs(nx - x) <= 1 and abs(ny - y) <= 1 else (g, x, y, q)
    out = combined.refined(points, pixels, 3, 1)
    assert {r.id: (r.gi, r.x, r.y, r.quality) for r in out.collect()} == moved
    kept: list = []
    for k, (g, x, y, q) in sorted(moved.items(), key=lambda m: (-m[1][3], m[0])):
        if all(g != moved[o][0] or (x - moved[o][1]) ** 2 + (y - moved[o][2]) ** 2 >= 64 for o in kept):
            kept.append(k)
    assert sorted(r.id for r in combined.best_of_close(out, 8.0).collect()) == sorted(kept)


def test_seeds_grow_through_connected_cells(spark):
    from gridloom.operators import spatial

    rng = np.random.default_rng(2)
    rows = [(k, int(rng.integers(1, 3)), "ab"[int(rng.integers(0, 2))], int(rng.integers(0, 26)), int(rng.integers(0, 26)), float(rng.integers(0, 30)), float(rng.integers(0, 30)), float(rng.integers(1, 9))) for k in range(2500)]
    peaks = spark.createDataFrame(rows, "id long, scan int, label string, brow int, bcol int, x double, y double, snr double")
    seeds = [rows[k] for k in (3, 77, 400, 1200)]
    want = set()
    for s in seeds:
        best: dict = {}
        for p in sorted(rows, key=lambda p: (-p[7], p[0])):
            if p[1:3] == s[1:3] and math.hypot(p[5] - s[5], p[6] - s[6]) <= 14 and 0 < max(abs(p[3] - s[3]), abs(p[4] - s[4])) <= 10:
                best.setdefault((p[3], p[4]), p[0])
        seen, todo = {(s[3], s[4]): (s[0], 0)}, [(s[3], s[4])]
        while todo:
            r, c = todo.pop(0)
            for cell in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if cell in best and cell not in seen:
                    seen[cell] = (best[cell], seen[r, c][1] + 1)
                    todo.append(cell)
        want |= {(s[0], i, step) for i, step in seen.values()}
    got = spatial.expand_seeds(peaks, peaks.filter(peaks.id.isin([s[0] for s in seeds])), 14.0).collect()
    assert {(r.seed, r.id, r.step) for r in got} == want and len(got) == len(want) > 20
    assert spatial.expand_seeds(peaks, peaks.limit(0)).count() == 0


@pytest.mark.parametrize("kind", sorted(combined.CENTRE_SEARCHES))
def test_spots_of_centres(spark, frames, kind, monkeypatch):
    """Three planted spots fade around their cells, a fourth is everywhere: each centre has its own, moved to its light."""
    monkeypatch.setitem(combined.CENTRE_SEARCHES, kind, combined.CENTRE_SEARCHES[kind] | {"apart": 9.0})  # as the frames are small
    centres = spark.createDataFrame([(3, 3), (8, 7), (8, 7), (6, 2), (11, 0)], "center_row int, center_col int")
    out = {}
    for r in combined.centre_search(frames, centres, SEARCH, kind).collect():
        out.setdefault((r.center_row, r.center_col), []).append((r.x, r.y))
    near = lambda cell, x, y: any(abs(a - x) <= 1 and abs(b - y) <= 1 for a, b in out.get(cell, []))
    assert near((3, 3), 12, 10) and near((8, 7), 16, 18) and near((6, 2), 24, 4)
    assert not any(near(c, 6, 22) for c in out) and not near((11, 0), 12, 10)
    assert all(math.hypot(a[0] - b[0], a[1] - b[1]) >= 9 for p in out.values() for i, a in enumerate(p) for b in p[:i])
    assert combined.centre_search(frames, centres.limit(0), SEARCH, kind).count() == 0
