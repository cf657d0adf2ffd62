"""The given tables read as raster tables, and the same views as SQL text for the oracles.

A raster frame has a scan, a grid cell (brow, bcol) and detector places (x, y); see the
column lists below. Every view is a projection or one aggregate of a given table, so its
size follows the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def device_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan, theta, reflection, brow, bcol, det_x, det_y, integrated, ord: one row per event."""
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    return e.select(
        F.concat(F.lit("Scan_"), F.lpad(day.cast("string"), 4, "0")).alias("scan"), ((day - 1) * 0.5).cast("double").alias("theta"), F.col("event_type").alias("reflection"),
        (F.col("user_id") % 50).alias("brow"), F.hour("ts").cast("bigint").alias("bcol"), F.get_json_object("props", "$.k").cast("int").alias("det_x"),
        (F.col("event_id") % 100).alias("det_y"), F.col("value").alias("integrated"), F.col("event_id").alias("ord"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature per scan, reflection and 5 by 4 patch of cells; its centre is its brightest row."""
    d = device_map(spark, sf_dir)
    best = lambda c: F.max_by(c, F.struct("integrated", -F.col("ord")))
    return d.groupBy("scan", "theta", "reflection", F.expr("brow div 5").alias("prow"), F.expr("bcol div 4").alias("pcol")).agg(
        best("brow").alias("center_row"), best("bcol").alias("center_col"), (best("det_x") * 3.6 - 180).cast("double").alias("chi_deg"), best("det_x").cast("double").alias("detector_x"), best("det_y").cast("double").alias("detector_y"),
        F.max("integrated").alias("peak_intensity"), F.sum("integrated").alias("sum_integrated"), F.avg("integrated").alias("mean_intensity"), F.countDistinct("brow", "bcol").alias("n_bins"), F.min("ord").alias("feature_id"),
    )


def peak_places(k1: Column, k2: Column, k3: Column) -> dict[str, Column]:
    """brow, bcol and x of a peak, which its keys fix."""
    return {"brow": k1 % 40, "bcol": k2 % 40, "x": k3 * 7 % 100}


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan, label, brow, bcol, x, y, intensity, snr and the keys k1, k2, k3: one row per line item."""
    li = table(spark, sf_dir, "lineitem")
    place = peak_places(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"))
    return li.select(
        F.col("l_linenumber").alias("scan"), F.concat("l_returnflag", "l_linestatus").alias("label"), *[place[c].alias(c) for c in place], F.col("l_quantity").cast("bigint").alias("y"), F.col("l_extendedprice").alias("intensity"), (F.col("l_discount") * 100 + 4).alias("snr"),
        F.col("l_orderkey").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gi, file_idx, within_idx, x_um, y_um, v: one row per event, as 50 frames a file on a serpentine raster."""
    e = table(spark, sf_dir, "events")
    file, within = F.expr("event_id div 50"), F.col("event_id") % 50
    x = F.when(file % 2 == 0, within).otherwise(49 - within) + (file % 2) * 0.3
    return e.select(F.col("event_id").alias("gi"), file.alias("file_idx"), within.alias("within_idx"), x.cast("double").alias("x_um"), file.cast("double").alias("y_um"), F.col("value").alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gi, y, x, v, label: the embeddings as images of 8 by 8 pixels."""
    e = table(spark, sf_dir, "embeddings")
    flat = e.select(F.col("vec_id").alias("gi"), "label", F.posexplode("embedding").alias("pos", "v"))
    return flat.select("gi", F.expr("cast(pos div 8 as bigint)").alias("y"), (F.col("pos") % 8).cast("bigint").alias("x"), F.col("v").cast("double").alias("v"), "label")


def tth_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels with the scattering angle tth of their place."""
    radius = F.sqrt((F.col("y") + 0.5) * (F.col("y") + 0.5) + (F.col("x") + 0.5) * (F.col("x") + 0.5))
    return pixels(spark, sf_dir).withColumn("tth", F.degrees(F.atan2(0.5 * radius, F.lit(20.0))))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trigger, c0..c3: line items as interferometer samples."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 1000).alias("trigger"), F.col("l_quantity").cast("double").alias("c0"), F.col("l_extendedprice").alias("c1"), F.col("l_discount").alias("c2"), F.col("l_tax").alias("c3"))




def reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reflection, two_theta, width, ord for the event types that occur, 3 degrees apart in order of name."""
    from pyspark.sql import Window

    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("reflection")).distinct()
    ranked = kinds.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("reflection")))
    return ranked.select("reflection", (F.col("ord") * 3.0).cast("double").alias("two_theta"), F.lit(1.0).alias("width"), F.col("ord").cast("bigint").alias("ord"))


SQL = {
    "device_map": """SELECT 'Scan_' || lpad(day(ts)::VARCHAR, 4, '0') AS scan, (day(ts) - 1) * 0.5::DOUBLE AS theta, event_type AS reflection, user_id % 50 AS brow, hour(ts)::BIGINT AS bcol,
        json_extract_string(props, '$.k')::INT AS det_x, event_id % 100 AS det_y, value AS integrated, event_id AS ord FROM events""",
    "features": """SELECT scan, theta, reflection, brow // 5 AS prow, bcol // 4 AS pcol, arg_max(brow, row(integrated, -ord)) AS center_row, arg_max(bcol, row(integrated, -ord)) AS center_col,
        arg_max(det_x, row(integrated, -ord)) * 3.6::DOUBLE - 180 AS chi_deg, arg_max(det_x, row(integrated, -ord))::DOUBLE AS detector_x, arg_max(det_y, row(integrated, -ord))::DOUBLE AS detector_y,
        max(integrated) AS peak_intensity, sum(integrated) AS sum_integrated, avg(integrated) AS mean_intensity, count(DISTINCT (brow, bcol)) AS n_bins, min(ord) AS feature_id
        FROM device_map GROUP BY scan, theta, reflection, brow // 5, bcol // 4""",
    "peaks": """SELECT l_linenumber AS scan, l_returnflag || l_linestatus AS label, l_orderkey % 40 AS brow, l_partkey % 40 AS bcol, l_suppkey * 7 % 100 AS x, l_quantity::BIGINT AS y,
        l_extendedprice AS intensity, l_discount * 100 + 4 AS snr, l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3 FROM lineitem""",
    "frames": """SELECT event_id AS gi, event_id // 50 AS file_idx, event_id % 50 AS within_idx,
        (CASE WHEN (event_id // 50) % 2 = 0 THEN event_id % 50 ELSE 49 - event_id % 50 END + ((event_id // 50) % 2) * 0.3::DOUBLE)::DOUBLE AS x_um, (event_id // 50)::DOUBLE AS y_um, value AS v FROM events""",
    "pixels": """SELECT vec_id AS gi, label, ((p - 1) // 8)::BIGINT AS y, ((p - 1) % 8)::BIGINT AS x, embedding[p]::DOUBLE AS v FROM embeddings, unnest(range(1, 65)) AS r(p)""",
    "tth_pixels": """SELECT *, degrees(atan2(0.5::DOUBLE * sqrt((y + 0.5::DOUBLE) * (y + 0.5::DOUBLE) + (x + 0.5::DOUBLE) * (x + 0.5::DOUBLE)), 20.0::DOUBLE)) AS tth FROM pixels""",
    "samples": "SELECT l_orderkey % 1000 AS trigger, l_quantity::DOUBLE AS c0, l_extendedprice AS c1, l_discount AS c2, l_tax AS c3 FROM lineitem",
    "reflections": "SELECT reflection, ord * 3.0::DOUBLE AS two_theta, 1.0::DOUBLE AS width, ord FROM (SELECT reflection, row_number() OVER (ORDER BY reflection) AS ord FROM (SELECT DISTINCT event_type AS reflection FROM events))",
}
_NEEDS = {"features": ("device_map",), "tth_pixels": ("pixels",)}


def oracle(sql: str, *views: str) -> str:
    """SQL over the named views, as common table expressions before it."""
    order: list[str] = []
    for v in views:
        order += [x for x in (*_NEEDS.get(v, ()), v) if x not in order]
    ctes = ", ".join(f"{v} AS ({SQL[v]})" for v in order)
    sql = sql.strip()
    if not ctes:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes} {sql}"
