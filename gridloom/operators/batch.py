"""Chained jobs over many scans: what is done is on record, a failing scan leaves the others alone.

A stage is a function of the scan's name and the outputs of its earlier stages. Its result is
written to a folder of its own attempt, and a row of the status table names that folder only
after the write ended, so a lost or repeated attempt is never read. A later run of the same
batch skips what the table has as done and goes on from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import combined, detect, features, mapping, spatial, voigt
from gridloom.session import cut

Stage = tuple[str, Callable[[str, dict[str, DataFrame]], DataFrame]]
STATUS = "scan string, stage string, state string, note string, path string, at timestamp"


class Batch:
    """A batch in a shared folder: a status table, and the outputs of stages by scan.

    States are done, failed and skipped. The status table only grows; the latest row of a
    scan and stage counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _note(self, scan: str, stage: str, state: str, note: str | None = None, path: str | None = None) -> None:
        self._notes([scan], stage, state, note, path)

    def _notes(self, scans: list[str], stage: str, state: str, note: str | None = None, path: str | None = None) -> None:
        rows = [(scan, stage, state, note, path, datetime.now(UTC)) for scan in scans]
        self.spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("append").parquet(f"{self.folder}/status")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/status")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def status(self) -> DataFrame:
        """scan, stage, state, note, path, at: the latest row of every scan and stage."""
        if not self._exists():
            return self.spark.createDataFrame([], STATUS)
        last = F.row_number().over(Window.partitionBy("scan", "stage").orderBy(F.desc("at")))
        return self.spark.read.schema(STATUS).parquet(f"{self.folder}/status").withColumn("_n", last).filter("_n = 1").drop("_n")

    def output(self, stage: str) -> DataFrame | None:
        """All scans' output of a stage, with their scan; None if no scan has one."""
        paths = [r.path for r in self.status().filter((F.col("stage") == stage) & (F.col("state") == "done")).select("path").distinct().collect()]
        return self.spark.read.parquet(*paths) if paths else None

    def run(self, scans: list[str], stages: list[Stage], ready: Callable[[str], str | None] | None = None) -> DataFrame:
        """Run the stages of each scan that are not done yet; returns the status.

        ready names what is missing of a scan, which is then skipped; it is asked again
        by the next run. A stage that fails ends its scan for this run.
        """
        known = {(r.scan, r.stage): r for r in self.status().collect()}  # a few rows a scan
        for scan in scans:
            missing = ready(scan) if ready else None
            if missing:
                self._note(scan, "", "skipped", missing)
                continue
            done: dict[str, DataFrame] = {}
            for name, stage in stages:
                row = known.get((scan, name))
                path = row.path if row and row.state == "done" else None
                if path is None:
                    path = f"{self.folder}/out/{name}/{uuid.uuid4().hex}"
                    try:
                        stage(scan, done).withColumn("scan", F.lit(scan)).write.parquet(path)
                    except Exception as e:  # whatever a scan's data does must not end the others
                        self._note(scan, name, "failed", f"{type(e).__name__}: {e}"[:500])
                        break
                    self._note(scan, name, "done", None, path)
                done[name] = self.spark.read.parquet(path).filter(F.col("scan") == scan)
        return self.status()

    def run_together(self, scans: list[str], stages: list[Stage]) -> DataFrame:
        """Run the stages that are not done yet, each for all its scans in one job; returns the status.

        A stage is a function of a list of scans and the outputs of earlier stages for these, and keeps their scan. If it
        fails it is tried on halves of the list, so a failing scan costs a few jobs and leaves the others alone.
        """
        known = {(r.scan, r.stage): r.path for r in self.status().filter("state = 'done'").collect()}  # a few rows a scan
        live = list(scans)
        for number, (name, stage) in enumerate(stages):
            parts, failed = [[s for s in live if (s, name) not in known]], set()
            while parts:
                part = parts.pop()
                if not part:
                    continue
                path = f"{self.folder}/out/{name}/{uuid.uuid4().hex}"
                try:
                    done = {}
                    for before, _ in stages[:number]:
                        own = self.spark.createDataFrame([(s,) for s in part], "scan string")
                        done[before] = self.spark.read.parquet(*sorted({known[s, before] for s in part})).join(F.broadcast(own), "scan", "left_semi")
                    stage(part, done).write.parquet(path)
                except Exception as e:  # whatever a scan's data does must not end the others
                    if len(part) == 1:
                        self._notes(part, name, "failed", f"{type(e).__name__}: {e}"[:500])
                        failed |= set(part)
                    else:
                        parts += [part[: len(part) // 2], part[len(part) // 2 :]]
                    continue
                self._notes(part, name, "done", None, path)
                known |= {(s, name): path for s in part}
            live = [s for s in live if s not in failed]
        return self.status()


def grid_stage(frames: DataFrame, **options) -> Stage:
    """Cells of the scan's frames; fails for a scan that nothing lays out."""

    def run(scan: str, _: dict[str, DataFrame]) -> DataFrame:
        out = cut(mapping.grid_mapping(frames.filter(F.col("scan") == scan), **options))
        if out.filter("coordinate_source = 'none'").limit(1).count():
            raise ValueError(f"{scan} has neither positions nor one file a row")
        return out

    return "grid", run


def grids_stage(frames: DataFrame, **options) -> Stage:
    """grid_stage of many scans in one plan, for run_together."""

    def run(scans: list[str], _: dict[str, DataFrame]) -> DataFrame:
        out = cut(mapping.grid_mapping(frames.filter(F.col("scan").isin(scans)), **options))
        lost = [r.scan for r in out.filter("coordinate_source = 'none'").select("scan").distinct().limit(5).collect()]
        if lost:
            raise ValueError(f"{', '.join(lost)} have neither positions nor one file a row")
        return out

    return "grid", run


def bins_stage(images: DataFrame, size: int) -> Stage:
    """Summed images of size by size cells: brow, bcol, pixels, n."""

    def run(scan: str, done: dict[str, DataFrame]) -> DataFrame:
        cells = done["grid"].select("gi", F.floor(F.col("row") / size).alias("brow"), F.floor(F.col("col") / size).alias("bcol"))
        return detect.bin_images(images.filter(F.col("scan") == scan).select("gi", "pixels"), cells, ["brow", "bcol"])

    return "bins", run


def peaks_stage(search: combined.Search) -> Stage:
    """Spots of every bin's image, cleaned by its own radial median, with an id."""

    def run(_: str, done: dict[str, DataFrame]) -> DataFrame:
        return combined.detect_stacks(done["bins"], search).withColumn("id", F.monotonically_increasing_id())

    return "peaks", run


def shapes_stage(tolerance: float, rules: voigt.Rules = voigt.Rules(flat_cv=0.05)) -> Stage:  # noqa: B008
    """Linked spots as features: characteristics, the profile verdict and an id by cell."""

    def run(_: str, done: dict[str, DataFrame]) -> DataFrame:
        peaks = done["peaks"].withColumn("intensity", F.col("snr"))
        members = cut(spatial.grid_components(peaks, tolerance, ()))
        shape = features.characterize(members, ("id",))
        verdict = voigt.verify_members(features.best_per_bin(members, ("id",)), ["component"], "intensity", rules)
        both = shape.join(verdict.select("component", "kept", "reason", "r2"), "component")
        return both.withColumn("feature_id", F.row_number().over(Window.orderBy("center_row", "center_col", "component")))

    return "shapes", run


def combined_stage(images: DataFrame, search: combined.Search) -> Stage:
    """The whole-scan search on single frames at their cells."""

    def run(scan: str, done: dict[str, DataFrame]) -> DataFrame:
        cells = done["grid"].select("gi", F.col("row").alias("brow"), F.col("col").alias("bcol"))
        return combined.full_scan(images.filter(F.col("scan") == scan).join(cells, "gi").select("brow", "bcol", "pixels"), search)[0]

    return "combined", run
