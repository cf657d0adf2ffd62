"""Batches that go on after a failing scan, and the catalog source that opens named scans only."""

import json

import numpy as np
import pytest
from test_mapping import FIELDS, raster

from gridloom.operators import batch, combined
from gridloom.sources import catalog_source as source

H = W = 24
TTH = np.degrees(np.arctan2(0.5 * np.hypot(*(np.mgrid[0:H, 0:W] + 0.5)), 40.0))
SEARCH = combined.Search(TTH, (("a", 6.0), ("b", 12.0)), ring_width=1.0, tolerance=4.0, hats=(5,), k_sigma=6.0, edge=1, separation=5.0, min_band=20)


@pytest.fixture(scope="module")
def scans(spark):
    """Frames and images of two good scans, one without files as rows and one without frames."""
    rows = raster("good", 8, 8) + raster("late", 8, 8, seed=4) + raster("odd", 8, 8, seed=5, uneven=True, missing="xy")
    frames = spark.createDataFrame(rows, FIELDS).cache()
    rng, images = np.random.default_rng(1), []
    y, x = np.mgrid[0:H, 0:W]
    for scan, gi, r, k, *_ in rows:
        c = k if r % 2 == 0 else 7 - k
        spot = 300 * np.exp(-((r - 3) ** 2 + (c - 4) ** 2) / 3) * np.exp(-((y - 10) ** 2 + (x - 12) ** 2) / 2.5)
        images.append((scan, gi, (20 + rng.normal(0, 1, (H, W)) + spot).ravel().tolist()))
    return frames, spark.createDataFrame(images, "scan string, gi long, pixels array<double>").cache()


def test_a_failing_scan_leaves_the_rest_and_is_resumed(spark, scans, tmp_path):
    frames, images = scans
    calls: list = []

    def counted(stage):
        name, fn = stage

        def run(scan, done):
            calls.append((scan, name))
            if scan == "late" and name == "peaks" and broken:
                raise RuntimeError("disk is full")
            return fn(scan, done)

        return name, run

    stages = [counted(s) for s in (batch.grid_stage(frames), batch.bins_stage(images, 1), batch.peaks_stage(SEARCH), batch.shapes_stage(4.0), batch.combined_stage(images, SEARCH))]
    names = ["good", "late", "odd", "empty"]
    held = {r.scan for r in frames.select("scan").distinct().collect()}
    ready = lambda scan: None if scan in held else "no frames"
    work, broken = batch.Batch(spark, str(tmp_path / "b")), True
    assert work.status().count() == 0 and work.output("grid") is None
    state = lambda: {(r.scan, r.stage): r.state for r in work.status().collect()}
    work.run(names, stages, ready)
    first = state()
    assert first["good", "combined"] == "done" and first["late", "bins"] == "done" and first["late", "peaks"] == "failed"
    assert first["odd", "grid"] == "failed" and first["empty", ""] == "skipped" and ("late", "shapes") not in first
    assert "disk is full" in work.status().filter("state = 'failed' and scan = 'late'").first().note
    calls.clear()
    broken = False
    work.run(names, stages, ready)
    assert calls == [("late", "peaks"), ("late", "shapes"), ("late", "combined"), ("odd", "grid")]
    assert state()["late", "combined"] == "done"
    shapes = work.output("shapes").filter("kept").collect()
    assert {(r.scan, r.detector_x, r.detector_y) for r in shapes if r.n_bins > 5} == {("good", 12, 10), ("late", 12, 10)}
    assert {r.scan for r in work.output("combined").collect()} == {"good", "late"}
    calls.clear()
    work.run(["good", "late"], stages)
    assert calls == []


def test_catalogs_of_unnamed_scans_are_not_opened(spark, tmp_path):
    names = ["peaks_5x5_x__hat.json", "shapes_5x5_x__gauss.json", "combined_1x1__scan.json", "shapes_1x1_a__gauss.json", "notes.txt", "feature_5x5_x.json", "feature_1x1_q.json", "peaks_1x1__hat.json"]
    for scan in ("Scan_0010", "Scan_0009", "Scan_0002"):
        (tmp_path / scan).mkdir()
        for name in names:
            (tmp_path / scan / name).write_text(json.dumps({"scan": scan, "name": name}))
    (tmp_path / "Scan_0002" / "shapes_9x9__bad.json").write_bytes(b"\xff\xfe")  # opening it fails
    both = source.iter_catalogs(spark, str(tmp_path), ["Scan_0009", "Scan_0010"]).collect()
    assert {(r.scan, r.bin, r.name) for r in both} == {(s, b, n) for s in ("Scan_0009", "Scan_0010") for b, n in ((5, names[1]), (1, names[2]))}
    assert all(json.loads(r.value) == {"scan": r.scan, "name": r.name} for r in both)
    assert source.iter_catalogs(spark, str(tmp_path), None, 5).count() == 3
    with pytest.raises(Exception, match="codec|decode"):
        source.read_catalogs(spark, str(tmp_path)).collect()
    reader = source.Reader(f"file://{tmp_path}")
    assert list(reader.pushFilters([source.EqualTo(("scan",), "Scan_0010"), source.In(("kind",), ("peaks", "feature"))])) == []
    assert [r[5] for p in reader.partitions() for r in p.rows] == sorted(n for n in names if n[:4] in ("peak", "feat"))
    (tmp_path / "Scan_0002" / "shapes_9x9__bad.json").unlink()
    assert [r.number for r in source.project_scans(spark, str(tmp_path)).collect()] == [2, 9, 10]
    assert source.iter_catalogs(spark, str(tmp_path / "none")).count() == 0


def test_projects_shapes_and_lineage(spark, tmp_path):
    (tmp_path / "scans.json").write_text("\n".join(json.dumps(r) for r in [{"scan": "Scan_0011", "n_files": 3, "n_frames": 9}, {"scan": "Scan_0004", "n_files": 0}, {"scan": "Scan_0005", "n_files": 2, "n_frames": 4}]))
    names = lambda **k: [r.scan for r in source.project_scans(spark, str(tmp_path), str(tmp_path / "scans.json"), **k).collect()]
    assert names() == ["Scan_0004", "Scan_0005", "Scan_0011"] and names(usable_only=True) == ["Scan_0005", "Scan_0011"]
    frames = spark.createDataFrame([("a", 1, 0, 5, 6), ("a", 0, 1, 7, 8), ("a", 0, 0, None, None), ("b", 0, 0, 1, 2)], "scan string, file_idx int, within_idx int, h int, w int")
    assert sorted(tuple(r) for r in source.frame_shape(frames).collect()) == [("a", 7, 8), ("b", 1, 2)]
    rows = [("s", "peaks_5x5_x__hat.json", "peaks", 5, "x", "hat", None), ("s", "peaks_5x5__raw.json", "peaks", 5, None, "raw", None), ("s", "shapes_5x5_x__g.json", "shapes", 5, "x", "g", "peaks_5x5_x__hat.json"), ("s", "feature_5x5_x.json", "feature", 5, "x", None, None), ("s", "feature_5x5_y.json", "feature", 5, "y", None, None), ("s", "feature_1x1.json", "feature", 1, None, None, None)]
    catalogs = spark.createDataFrame(rows, "scan string, name string, kind string, bin int, tag string, algorithm string, source string")
    records = {r.name: (r.parent, json.loads(r.lineage)) for r in source.lineage_records(catalogs).collect()}
    assert records["shapes_5x5_x__g.json"] == ("peaks_5x5_x__hat.json", {"stage": "shapes", "scan": "s", "bin_size": 5, "algorithm": "g", "peak_source_file": "peaks_5x5_x__hat.json"})
    assert set(records) == {r[1] for r in rows[:3]}
    manifest = source.lineage_records(catalogs).select("scan", "name", "lineage")
    filled = source.backfill(catalogs, manifest)
    found = {r.name: json.loads(r.lineage) for r in filled.collect()}
    assert len(found) == 6 and found["feature_5x5_x.json"]["peak_source"] == {"stage": "peaks", "bin_size": 5, "algorithm": "hat"}
    assert found["feature_5x5_y.json"]["peak_source_inference"] == "untagged" and "peak_source_file" not in found["feature_1x1.json"]
    assert source.backfill(catalogs, filled).count() == 6
