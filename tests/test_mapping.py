"""Grid mappings of several scans against plain arrays."""

import numpy as np
import pytest

from gridloom.operators import mapping

FIELDS = "scan string, gi long, file_idx int, within_idx int, x_um double, y_um double, recreated boolean"


def raster(scan, rows, cols, fast="y", step=(1.0, 1.0), back=False, noise=0.05, seed=0, missing=(), recreated=False, uneven=False):
    """A back-and-forth raster; fast names the axis that runs within a file."""
    rng, out, g = np.random.default_rng(seed), [], 0
    for r in range(rows):
        n = cols + (int(rng.integers(-3, 4)) if uneven else 0)
        for k in range(n):
            along = (k if r % 2 == 0 else n - 1 - k) * step[1] + (0.4 if r % 2 else 0.0)
            across = (rows - 1 - r if back else r) * step[0]
            x, y = (across, along) if fast == "y" else (along, across)
            x, y = x + rng.normal(0, noise), y + rng.normal(0, noise)
            out.append((scan, g, r, k, None if "x" in missing or g == 7 else float(x), None if "y" in missing else float(y), recreated))
            g += 1
    return out


def turns(x, reach, box):
    n = len(x)
    s = np.array([sum(x[max(0, i - box // 2) : i + box // 2]) / box for i in range(n)])
    row, rows = 0, []
    for i in range(n):
        b, a = s[max(0, i - reach) : i], s[i + 1 : i + 1 + reach]
        if len(b) and len(a) and ((s[i] > b.max() and s[i] > a.max()) or (s[i] < b.min() and s[i] < a.min())):
            row += 1
        rows.append(row)
    rows = np.array(rows)
    cols = np.zeros(n, int)
    for r in np.unique(rows):
        at = np.flatnonzero(rows == r)
        cols[at] = np.arange(len(at)) if r % 2 == 0 else np.arange(len(at))[::-1]
    return rows, cols


def corr(a, b):
    return 0.0 if np.std(a) == 0 or np.std(b) == 0 else round(float(np.corrcoef(a, b)[0, 1]), 9)


def faithful(rows, native, reach, box):
    gi = np.arange(len(rows))
    fill = lambda v: np.interp(gi, gi[np.isfinite(v)], v[np.isfinite(v)])
    x, y = (fill(np.array([np.nan if r[k] is None else r[k] for r in rows])) for k in (4, 5))
    row = np.array([r[2] for r in rows])
    rv, cv = (x, y) if abs(corr(row, x)) >= abs(corr(row, y)) else (y, x)
    span = lambda v: max(np.percentile(v, 99.8) - np.percentile(v, 0.2), 1e-9)
    n_rows = row.max() + 1
    n_cols = int(np.median(np.bincount(row))) if native else max(round(1 + (n_rows - 1) * span(cv) / span(rv)), 1)
    s_row, s_col = turns(x, reach, box)
    v = cv * (np.sign(corr(s_col, cv)) or 1)
    lo, hi = np.percentile(v, 0.2), np.percentile(v, 99.8)
    col = np.clip(np.round((v - lo) / (hi - lo) * (n_cols - 1)), 0, n_cols - 1).astype(int)
    if corr(row, rv) * corr(s_row, rv) < 0:
        row = row.max() - row
    return {(r[0], r[1]): (int(a), int(b), int(n_rows), n_cols) for r, a, b in zip(rows, row, col, strict=True)}


SCANS = [raster("a", 12, 30), raster("b", 9, 25, "x", (2.0, 1.0), seed=1), raster("c", 14, 40, "y", (1.0, 0.5), True, seed=2), raster("d", 10, 31, "x", (1.0, 0.7), True, seed=3)]


@pytest.mark.parametrize("native", [False, True])
def test_faithful_grid(spark, native):
    frames = spark.createDataFrame([r for s in SCANS for r in s], FIELDS)
    want = {k: v for s in SCANS for k, v in faithful(s, native, 20, 10).items()}
    got = {(r.scan, r.gi): (r.row, r.col, r.n_rows, r.n_cols) for r in mapping.faithful_grid(frames, native, 20, 10).collect()}
    assert got == want


def test_sources_and_mapping(spark):
    scans = {
        "fpr": raster("fpr", 8, 20), "xonly": raster("xonly", 8, 20, "x", missing="y"), "bare": raster("bare", 8, 20, missing="xy"), "again": raster("again", 8, 20, recreated=True),
        "uneven": raster("uneven", 12, 30, "x", seed=5, uneven=True), "lost": raster("lost", 12, 30, seed=5, uneven=True, missing="xy"),
    }
    frames = spark.createDataFrame([r for s in scans.values() for r in s], FIELDS)
    source = lambda **k: {r.scan: r.coordinate_source for r in mapping.grid_sources(frames, **k).collect()}
    base = {"fpr": "file_per_row", "xonly": "serpentine", "bare": "file_per_row", "again": "file_per_row", "uneven": "positions_xy", "lost": "none"}
    assert source() == base and source(n_cols=30) == base | {"lost": "synthetic"}
    assert source(deskew=False) == base | {"fpr": "serpentine", "uneven": "serpentine"}
    assert source(method="faithful") == base | {"fpr": "positions_faithful"} and source(method="perrow_offset")["fpr"] == "perrow_offset"
    out: dict = {}
    for r in mapping.grid_mapping(frames, n_cols=30, reach=10, box=4).collect():
        out.setdefault(r.scan, {})[r.gi] = (r.row, r.col)
    assert {k: len(v) for k, v in out.items()} == {k: len(v) for k, v in scans.items()}
    for name in ("fpr", "bare", "again"):
        assert out[name] == {r[1]: (r[2], r[3] if r[2] % 2 == 0 else 19 - r[3]) for r in scans[name]}
    assert out["lost"][31] == (1, 28) and out["lost"][29] == (0, 29)
    rows, cols = turns(np.interp(np.arange(160), [k for k in range(160) if k != 7], [r[4] for r in scans["xonly"] if r[4] is not None]), 10, 4)
    assert [out["xonly"][k] for k in range(160)] == list(zip(rows.tolist(), cols.tolist()))
    assert len({c for c in out["uneven"].values()}) > 0.7 * len(out["uneven"])
    shifted = {r.gi: (r.row, r.col) for r in mapping.grid_mapping(frames.filter("scan = 'fpr'"), "perrow_offset").collect()}
    assert len(shifted) == 160 and min(shifted.values()) >= (0, 0)
    assert mapping.grid_mapping(frames.filter("scan = 'lost'")).filter("row is null and coordinate_source = 'none'").count() == len(scans["lost"])


def test_gaps_are_filled_without_a_window_to_the_end(spark):
    from gridloom.operators import grid

    values = [None, 2.0, None, None, 8.0, None, 5.0, None]
    df = spark.createDataFrame([(s, k, None if s == "c" else v) for s in "abc" for k, v in enumerate(values)], "scan string, gi int, v double")
    out = grid.fill_gaps(df, "v", "gi", "scan")
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    want = [2.0, 2.0, 4.0, 6.0, 8.0, 6.5, 5.0, 5.0]
    got = {(r.scan, r.gi): r.v for r in out.collect()}
    assert got == {(s, k): None if s == "c" else want[k] for s in "abc" for k in range(8)}


def test_frames_are_laid_out_once_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(mapping, "FRAMES_PER_TASK", 20)
    frames = spark.createDataFrame([r for s in SCANS for r in s], FIELDS)
    for out in (mapping.faithful_grid(frames, reach=20, box=10), mapping.grid_mapping(frames, reach=20, box=10)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert f"RepartitionByExpression [scan#{frames._jdf.queryExecution().analyzed().output().head().exprId().id()}], {-(-frames.count() // 20)}" in plan
    plan = mapping.faithful_grid(frames, reach=20, box=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(x_um") <= 1
