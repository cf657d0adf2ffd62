"""Catalog folders as a data source: listed when a query is planned, opened by tasks.

root holds a folder for every scan, and in it catalog files like shapes_5x5_tag__algo.json.
Filters on scan, kind, bin, tag and algorithm are settled by names while partitions are
planned, so files that a query does not name are never opened.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from gridloom.sources.catalogs import default_sources

NAME = re.compile(r"([a-z]+)_(\d+)x\d+(?:_((?:(?!__).)+))?(?:__(.+))?\.json")
FIELDS = "scan string, kind string, bin int, tag string, algorithm string, name string, path string, length bigint, value string"
PRUNED = ("scan", "kind", "bin", "tag", "algorithm", "name")
FORMAT = "gridloom_catalogs"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
FILES_PER_TASK = 64


@dataclass
class Files(InputPartition):
    rows: list[tuple]


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.wanted = root, {}

    def pushFilters(self, filters):  # noqa: N802
        """Keep equality and membership of what names tell; hand the rest back to Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column in PRUNED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def _keeps(self, row: tuple) -> bool:
        return all(row[PRUNED.index(c)] in values for c, values in self.wanted.items())

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, base = _filesystem(self.root)
        scans = [d for d in fs.get_file_info(FileSelector(base, allow_not_found=True)) if d.type == FileType.Directory]
        if "scan" in self.wanted:
            scans = [d for d in scans if d.base_name in self.wanted["scan"]]
        rows = []
        for scan in sorted(scans, key=lambda d: d.base_name):
            for file in sorted(fs.get_file_info(FileSelector(scan.path)), key=lambda f: f.base_name):
                if file.type == FileType.File and (m := NAME.fullmatch(file.base_name)):
                    row = (scan.base_name, m[1], int(m[2]), m[3], m[4], file.base_name, file.path, file.size)
                    rows += [row] * self._keeps(row)
        return [Files(rows[k : k + FILES_PER_TASK]) for k in range(0, len(rows), FILES_PER_TASK)] or [Files([])]

    def read(self, partition):
        fs, _ = _filesystem(self.root)
        for row in partition.rows:
            with fs.open_input_file(row[6]) as source:
                yield (*row, source.read().decode())


class Catalogs(DataSource):
    """option root: a folder, as a path or a URI that every machine can open."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        root = self.options["root"]
        return Reader(root if "://" in root or root.startswith("file:") else f"file://{root}")


def read_catalogs(spark: SparkSession, root: str) -> DataFrame:
    """All catalog files below root, a row each; see the module for the filters that reach the listing."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Catalogs)
    return spark.read.format(FORMAT).option("root", root).load()


def iter_catalogs(spark: SparkSession, root: str, scans: list[str] | None = None, bin_size: int | None = None) -> DataFrame:
    """The one catalog that counts for each scan and bin, of the named scans and bin."""
    found = read_catalogs(spark, root)
    if scans is not None:
        found = found.filter(F.col("scan").isin(scans))
    if bin_size is not None:
        found = found.filter(F.col("bin") == bin_size)
    return default_sources(found)


def project_scans(spark: SparkSession, root: str, registry: str | None = None, usable_only: bool = False) -> DataFrame:
    """scan and number, in numeric order: those of the registry table, or else the folders that hold catalogs.

    usable_only leaves out registered scans without files or frames.
    """
    number = F.regexp_extract("scan", r"(\d+)", 1).try_cast("int").alias("number")
    if registry:
        rows = spark.read.json(registry)
        if usable_only:
            rows = rows.filter((F.coalesce("n_files", F.lit(0)) > 0) & (F.coalesce("n_frames", F.lit(0)) > 0))
        rows = rows.select("scan", number)
    else:
        rows = read_catalogs(spark, root).select("scan", number).distinct().filter(F.col("scan").rlike(r"^Scan_\d+$"))
    return rows.orderBy("number", "scan")


def frame_shape(frames: DataFrame, keys: tuple[str, ...] = ("scan",)) -> DataFrame:
    """keys, h, w of the first frame by file and place, among those with a shape."""
    known = frames.filter("h is not null and w is not null")
    return known.groupBy(*keys).agg(F.min_by(F.struct("h", "w"), F.struct("file_idx", "within_idx")).alias("s")).select(*keys, "s.h", "s.w")


def lineage_records(catalogs: DataFrame) -> DataFrame:
    """scan, name, parent and lineage (JSON) of peaks, combined and shapes catalogs.

    catalogs: scan, name, kind, bin, algorithm and source, the file that shapes were made of
    (null for none). Nulls leave their fields out.
    """
    note = F.when(F.col("kind") == "combined", "peak and shape in one pass over frames")
    parent = F.when(F.col("kind") == "shapes", F.col("source"))
    fields = F.struct(F.col("kind").alias("stage"), F.col("scan"), F.col("bin").alias("bin_size"), F.col("algorithm"), parent.alias("peak_source_file"), note.alias("note"))
    return catalogs.filter(F.col("kind").isin("peaks", "combined", "shapes")).select("scan", "name", parent.alias("parent"), F.to_json(fields).alias("lineage"))


def backfill(catalogs: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (scan, name, lineage) with a record for every feature catalog that has none.

    The peaks they were made of are inferred: of the same scan and bin, those of the same tag, else an
    untagged catalog; the first by name. Running it again adds nothing.
    """
    plain = catalogs.filter(F.col("kind") == "feature").join(manifest.select("scan", "name"), ["scan", "name"], "left_anti")
    peaks = catalogs.filter(F.col("kind") == "peaks").select("scan", "bin", F.col("tag").alias("_tag"), F.col("name").alias("_name"), F.col("algorithm").alias("_algorithm"))
    how = F.when(F.col("_tag") == F.col("tag"), 0).when(F.col("_tag").isNull(), 1)
    ranked = plain.join(peaks, ["scan", "bin"], "left").withColumn("_how", how)
    first = F.struct(F.coalesce("_how", F.lit(9)), "_name")
    chosen = ranked.groupBy("scan", "name", "bin", "tag").agg(F.min_by(F.struct("_how", "_name", "_algorithm"), first).alias("s"))
    known = F.col("s._how").isNotNull()
    source = F.when(known, F.struct(F.lit("peaks").alias("stage"), F.col("bin").alias("bin_size"), F.col("s._algorithm").alias("algorithm")))
    fields = F.struct(
        F.lit("feature").alias("stage"), F.col("scan"), F.col("bin").alias("bin_size"), F.col("tag"), F.lit(True).alias("lineage_backfilled"), F.when(known, F.col("s._name")).alias("peak_source_file"),
        F.when(known, F.lit(True)).alias("peak_source_inferred"), F.when(known, F.when(F.col("s._how") == 0, "tag").otherwise("untagged")).alias("peak_source_inference"), source.alias("peak_source"),
    )
    return manifest.select("scan", "name", "lineage").unionByName(chosen.select("scan", "name", F.to_json(fields).alias("lineage")))
