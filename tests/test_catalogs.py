"""Sources and sinks on small files."""

from pyspark.sql import functions as F

from gridloom.sources import catalogs


def test_positions_and_marker(spark, tmp_path):
    p = tmp_path / "pos_203.csv"
    p.write_text("# Recreated by hand\nTrigger,X_Position,Y_Position\n1,0.5,2\n2,bad,\n")
    rows = catalogs.read_positions(spark, str(p)).orderBy("trigger").collect()
    assert [(r.trigger, r.x_um, r.y_um) for r in rows] == [(1, 0.5, 2.0), (2, None, None)]
    assert catalogs.is_recreated(spark, str(p)).first().recreated
    files = catalogs.list_files(spark, str(tmp_path))
    assert [r.name for r in catalogs.scan_files(files, 203).collect()] == ["pos_203.csv"] and not catalogs.scan_files(files, 20).count()


def test_features_in_several_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "b.json").write_text('{"features": [{"id": 3}]}')
    (tmp_path / "c.json").write_text('{"shapes": [{"id": 4, "x": [1]}]}')
    got = catalogs.read_features(spark, str(tmp_path)).select(F.try_variant_get("feature", "$.id", "int").alias("i")).collect()
    assert sorted(r.i for r in got) == [1, 2, 3, 4]


def test_reflections(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"name": "(001)", "two_theta": 7.123456789, "width": null}]')
    r = catalogs.read_reflections(spark, str(tmp_path)).first()
    assert (r.two_theta, r.width) == (7.12346, 0.4)


def test_names_lineage_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("shapes_5x5_fast__tuned.json",), ("peaks_1x1.json",), ("x",)], "n string")
    got = [r.p for r in df.select(catalogs.parse_name(F.col("n")).alias("p")).collect()]
    assert (got[0].kind, got[0].bin, got[0].tag, got[0].algorithm) == ("shapes", 5, "fast", "tuned") and got[1].bin == 1 and got[2].kind is None
    rec = spark.createDataFrame([("p", "peaks", "a", None), ("s", "shapes", "b", "p"), ("c", "combined", "d", "s")], "name string, stage string, algorithm string, parent string")
    assert {r.name: r.lineage for r in catalogs.lineage_lines(rec).collect()}["c"] == "combined d < shapes b < peaks a"
    catalogs.write_table(rec, str(tmp_path / "o"), ["stage", "name"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns == ["stage", "name"]
    bad = spark.createDataFrame([(1, 0, 0, ["4x4"])], "scan int, n_files long, n_frames long, shapes array<string>")
    assert catalogs.scan_problems(bad, "8x8").first().problems == ["no files", "no frames", "unexpected shape"]
