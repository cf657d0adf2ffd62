"""Catalog files: listings, JSON and CSV readers, writers, manifests and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PEAK = "array<struct<x:double,y:double,snr:double,label:string,npix:int,compactness:double,peak_val:double,integrated_intensity:double,cleaned_intensity:double>>"


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, name and length of the files below folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def scan_files(files: DataFrame, scan: int) -> DataFrame:
    """Non-empty files whose name holds the scan's number, padded or not, in order of name."""
    mine = files.filter((F.col("length") > 0) & F.col("name").rlike(rf"(?<!\d)0*{scan}(?!\d)"))
    return mine.withColumn("file_idx", F.row_number().over(Window.partitionBy(F.lit(scan)).orderBy("name")) - 1)


def scan_summary(files: DataFrame, deep: bool = True) -> DataFrame:
    """Per scan: files, frames and shapes. Without deep, frames are those of the first file times files."""
    out = files.groupBy("scan").agg(F.count("*").alias("n_files"), F.sum("n").alias("total"), F.min_by("n", "file_idx").alias("first"), F.sort_array(F.collect_set("shape")).alias("shapes"))
    return out.select("scan", "n_files", (F.col("total") if deep else F.col("first") * F.col("n_files")).alias("n_frames"), "shapes")


def scan_problems(summary: DataFrame, shape: str) -> DataFrame:
    """What is wrong with each scan, as a list of texts."""
    checks = [F.when(F.col("n_files") == 0, "no files"), F.when(F.col("n_frames") == 0, "no frames"), F.when(F.size("shapes") > 1, "mixed shapes"), F.when(~F.array_contains("shapes", shape), "unexpected shape")]
    return summary.withColumn("problems", F.array_compact(F.array(*checks)))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """trigger, x_um, y_um of a positions file; lines from # on are comments, a missing column is null."""
    raw = spark.read.option("comment", "#").option("header", True).option("nullValue", "").csv(path)
    named = {c.lower(): c for c in raw.columns}
    pick = lambda name, kind: (F.col(named[name]).try_cast(kind) if name in named else F.lit(None).cast(kind))
    return raw.select(pick("trigger", "bigint").alias("trigger"), pick("x_position", "double").alias("x_um"), pick("y_position", "double").alias("y_um"))


def is_recreated(spark: SparkSession, path: str, marker: str = "# recreated") -> DataFrame:
    """One row: whether the file's first line starts with marker."""
    return spark.read.text(path, wholetext=True).select(F.lower("value").startswith(marker).alias("recreated"))


def read_peaks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Peaks of {"peaks_by_bin": {"r_c": [...]}} texts, a file or (lines) a line each, one row a peak with its cell and place in the list."""
    raw = spark.read.text(path, wholetext=not lines)
    keep = [c for c in raw.columns if c != "value"]
    raw = raw.select(*keep, F.from_json("value", f"peaks_by_bin map<string,{PEAK}>").alias("j"))
    flat = raw.select(*keep, F.explode("j.peaks_by_bin").alias("key", "peaks")).select(*keep, "key", F.posexplode("peaks").alias("peak_idx", "p"))
    cell = F.split("key", "_")
    return flat.select(*keep, cell[0].try_cast("int").alias("brow"), cell[1].try_cast("int").alias("bcol"), "peak_idx", "p.*")


def peak_json(peaks: DataFrame, rows_per_text: int = 8) -> DataFrame:
    """The same as JSON text: a {"peaks_by_bin": ...} per scan and block of bin rows, so that no text grows with its scan."""
    fields = [c for c in ("x", "y", "snr", "label", "intensity") if c in peaks.columns]
    cells = peaks.groupBy("scan", "brow", "bcol").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("p"))
    key = F.concat_ws("_", F.col("brow").cast("string"), F.col("bcol").cast("string"))
    keyed = cells.groupBy("scan", F.floor(F.col("brow") / rows_per_text).alias("block")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "p")))).alias("peaks_by_bin"))
    return keyed.select("scan", F.to_json(F.struct("peaks_by_bin")).alias("value"))


def read_reflections(spark: SparkSession, path: str, width: float = 0.4) -> DataFrame:
    raw = spark.read.option("multiLine", True).schema("name string, two_theta double, width double").json(path)
    return raw.select("name", F.round("two_theta", 5).alias("two_theta"), F.round(F.coalesce("width", F.lit(width)), 4).alias("width"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of catalogs that are a list, or an object with features, shapes or peaks; one variant a row."""
    v = F.try_parse_json("value")
    raw = spark.read.text(path, wholetext=True).select(v.alias("v"))
    lists = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.features", "$.shapes", "$.kept")])
    return raw.select(F.explode(lists).alias("feature"))


def parse_name(name: Column) -> Column:
    """Struct of kind, bin, tag and algorithm in a catalog name like shapes_5x5_tag__algo.json."""
    stem = F.regexp_replace(name, r"\.json$", "")
    part = lambda g: F.nullif(F.regexp_extract(stem, r"^([a-z]+)_(\d+)x(\d+)(?:_((?:(?!__).)+))?(?:__(.+))?$", g), F.lit(""))
    return F.struct(part(1).alias("kind"), part(2).try_cast("int").alias("bin"), part(4).alias("tag"), part(5).alias("algorithm"))


def default_sources(catalogs: DataFrame) -> DataFrame:
    """One catalog per scan and bin: combined before shapes before others, the last by name."""
    rank = F.when(F.col("kind") == "combined", 0).when(F.col("kind") == "shapes", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("scan", "bin").orderBy(rank, F.desc("name")))
    return catalogs.withColumn("_p", place).filter("_p = 1").drop("_p")


def append_numbered(old: DataFrame, new: DataFrame, ident: str, order: str, partition: str) -> DataFrame:
    """old and new rows together, the new ones numbered on from the largest id of their partition."""
    top = old.groupBy(partition).agg(F.max(ident).alias("_top"))
    place = F.row_number().over(Window.partitionBy(partition).orderBy(order))
    numbered = new.join(top, partition, "left").withColumn(ident, F.coalesce("_top", F.lit(0)) + place).drop("_top")
    return old.unionByName(numbered, allowMissingColumns=True)


def write_table(rows: DataFrame, path: str, columns: list[str], fmt: str = "csv", by: str | None = None) -> None:
    """Write columns in order, as CSV with a header, JSON or Parquet."""
    out = rows.select(*columns).write.mode("overwrite")
    if by:
        out = out.partitionBy(by)
    (out.option("header", True) if fmt == "csv" else out).format(fmt).save(path)


def lineage_lines(records: DataFrame) -> DataFrame:
    """name and a text of each record with its parents: combined, shapes and peaks, three deep at most."""
    text = lambda p: F.concat_ws(" ", F.col(f"{p}stage"), F.col(f"{p}algorithm"))
    own = records.select("name", "stage", "algorithm", "parent")
    up = lambda k: own.select(F.col("name").alias(f"n{k}"), F.col("stage").alias(f"p{k}_stage"), F.col("algorithm").alias(f"p{k}_algorithm"), F.col("parent").alias(f"q{k}"))
    chain = own.join(up(1), F.col("parent") == F.col("n1"), "left").join(up(2), F.col("q1") == F.col("n2"), "left")
    shown = [text(""), F.when(F.col("n1").isNotNull(), text("p1_")), F.when(F.col("n2").isNotNull(), text("p2_"))]
    return chain.select("name", F.concat_ws(" < ", *shown).alias("lineage"))
