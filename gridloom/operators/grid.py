"""Raster grids: frame positions to cells, cells to bins, bin sums and occupancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regular_grid(frames: DataFrame, n_cols: int, index: str = "gi") -> DataFrame:
    """Rows and columns of a raster that runs back and forth: odd rows count down."""
    row, place = F.floor(F.col(index) / n_cols).cast("bigint"), F.col(index) % n_cols
    return frames.withColumn("row", row).withColumn("col", F.when(row % 2 == 0, place).otherwise(n_cols - 1 - place))


def file_rows(frames: DataFrame, file: str = "file_idx", order: str = "within_idx", keys: tuple[str, ...] = ()) -> DataFrame:
    """One file (of the same keys) a row: the column is the frame's rank in its file, reversed on odd files."""
    rank = F.row_number().over(Window.partitionBy(*keys, file).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(*keys, file))
    return frames.withColumn("row", F.col(file)).withColumn("col", F.when(F.col(file) % 2 == 0, rank).otherwise(n - 1 - rank))


def is_file_per_row(frames: DataFrame, share: float = 0.9, file: str = "file_idx") -> DataFrame:
    """One row: the number of files, the commonest frame count and whether share of the files have it."""
    sizes = frames.groupBy(file).agg(F.count("*").alias("n"))
    modes = sizes.groupBy("n").agg(F.count("*").alias("files")).agg(F.max_by("n", F.struct("files", "n")).alias("modal"), F.max("files").alias("top"), F.sum("files").alias("files"))
    return modes.select("files", "modal", (F.col("top") >= share * F.col("files")).alias("per_row"))


def serpentine_rows(frames: DataFrame, reach: int = 50, box: int = 20, partition: str = "file_idx", order: str = "gi", x: str = "x_um") -> DataFrame:
    """Rows of a continuous back-and-forth scan, cut at turns of the smoothed position.

    A turn is a strict extremum over `reach` frames either side of the zero-padded moving
    mean of `box` frames. Windows stay inside `partition`.
    """
    run = Window.partitionBy(partition).orderBy(order)
    smooth = frames.withColumn("_s", F.sum(x).over(run.rowsBetween(-(box // 2), box // 2 - 1)) / box)
    before, after = run.rowsBetween(-reach, -1), run.rowsBetween(1, reach)
    peak = (F.col("_s") > F.max("_s").over(before)) & (F.col("_s") > F.max("_s").over(after))
    dip = (F.col("_s") < F.min("_s").over(before)) & (F.col("_s") < F.min("_s").over(after))
    turned = smooth.withColumn("row", F.sum(F.when(peak | dip, 1).otherwise(0)).over(run.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    place = F.row_number().over(Window.partitionBy(partition, "row").orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(partition, "row"))
    return turned.withColumn("col", F.when(F.col("row") % 2 == 0, place).otherwise(n - 1 - place)).drop("_s")


def to_bin(cell: Column, size: int) -> Column:
    return F.floor(cell / size).cast("bigint")


def bin_sum(frames: DataFrame, size: int, keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """Sum and frame count of size by size bins of cells."""
    return frames.groupBy(*keys, to_bin(F.col("row"), size).alias("brow"), to_bin(F.col("col"), size).alias("bcol")).agg(F.sum(value).alias("total"), F.count("*").alias("n_frames"))


def cells_of_bins(bins: DataFrame, size: int) -> DataFrame:
    """The cells that each bin covers."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    return bins.withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps)).withColumn("row", F.col("brow") * size + F.col("_r")).withColumn("col", F.col("bcol") * size + F.col("_c")).drop("_r", "_c")


def bin_centres(bins: DataFrame, size: int) -> DataFrame:
    return bins.withColumn("row", F.col("brow") * size + size // 2).withColumn("col", F.col("bcol") * size + size // 2)


def occupancy(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per row: occupied cells, rightmost column and the filled share of the span up to it."""
    return cells.select(*keys, "row", "col").distinct().groupBy(*keys, "row").agg(F.count("*").alias("n"), F.max("col").alias("rightmost")).withColumn("fill", F.col("n") / (F.col("rightmost") + 1))


def fill_gaps(rows: DataFrame, value: str, order: str, partition: str) -> DataFrame:
    """value with nulls replaced by linear interpolation over order, held at the ends.

    The value ahead is sought from the end backwards, as a window that runs to the end of its group is read anew for every row.
    """
    run = Window.partitionBy(partition)
    back, ahead = run.orderBy(order).rowsBetween(Window.unboundedPreceding, 0), run.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    out = rows.withColumn("_b", F.last(known, ignorenulls=True).over(ahead)).withColumn("_a", F.last(known, ignorenulls=True).over(back))
    span = F.col("_b.o") - F.col("_a.o")
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.try_divide(F.col(order) - F.col("_a.o"), span)
    return out.withColumn(value, F.coalesce(F.col(value), line, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")


def snap_to_lattice(rows: DataFrame, value: str, n: int, low: float = 0.002, high: float = 0.998) -> DataFrame:
    """Lattice index 0 to n - 1 of value, scaled by its percentile span."""
    ends = rows.agg(F.percentile(value, low).alias("_lo"), F.percentile(value, high).alias("_hi"))
    scaled = F.rint((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (n - 1))
    return rows.crossJoin(F.broadcast(ends)).withColumn("index", F.greatest(F.lit(0), F.least(F.lit(n - 1), scaled)).cast("bigint")).drop("_lo", "_hi")


def fill_holes(cells: DataFrame, value: str, share: float = 0.3) -> DataFrame:
    """Empty cells beside data, valued share of the mean of their non-zero neighbours."""
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), r -> transform(sequence(-1, 1), c -> struct(r, c))))"))
    lit = cells.filter(F.col(value) != 0).select("row", "col", value, near.alias("d"))
    around = lit.select((F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col"), value)
    return around.filter("row >= 0 and col >= 0").join(cells, ["row", "col"], "left_anti").groupBy("row", "col").agg((F.avg(value) * share).alias(value))


def block_mean(pixels: DataFrame, factor: int, height: int, width: int, image: str = "gi") -> DataFrame:
    """Means of factor by factor pixel blocks; a remainder at the edge is dropped."""
    inside = pixels.filter((F.col("y") < height // factor * factor) & (F.col("x") < width // factor * factor))
    return inside.groupBy(image, F.floor(F.col("y") / factor).cast("bigint").alias("y"), F.floor(F.col("x") / factor).cast("bigint").alias("x")).agg(F.avg("v").alias("v"))


def image_sum(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("y", "x").agg(F.sum("v").alias("v"))


def frame_index(files: DataFrame, file: str = "file_idx", count: str = "n") -> DataFrame:
    """Global frame numbers from frame counts per file: files follow each other in order.

    Files are few against frames; their running count is one ordered window over files.
    """
    start = F.sum(count).over(Window.partitionBy(F.lit(0)).orderBy(file).rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.withColumn("_start", F.coalesce(start, F.lit(0)))
    return offsets.filter(F.col(count) > 0).select(file, "_start", F.explode(F.expr(f"sequence(0, cast({count} - 1 as int))")).alias("within_idx")).select(file, "within_idx", (F.col("_start") + F.col("within_idx")).alias("gi"))


def grid_from_positions(frames: DataFrame, n_rows: int, n_cols: int, order: str = "gi") -> DataFrame:
    """Cells from measured positions: lattice indices of y and x, flipped where they fall with the frame number.

    The signs come from correlations, one aggregate over the scan; a constant, or float noise
    below a billionth, correlates 0.
    """
    signs = frames.agg(F.coalesce(F.nanvl(F.corr(order, "y_um"), F.lit(0.0)), F.lit(0.0)).alias("_sy"), F.coalesce(F.nanvl(F.corr("within_idx", "x_um"), F.lit(0.0)), F.lit(0.0)).alias("_sx"))
    rows = snap_to_lattice(frames, "y_um", n_rows).withColumnRenamed("index", "row")
    cells = snap_to_lattice(rows, "x_um", n_cols).withColumnRenamed("index", "col").crossJoin(F.broadcast(signs))
    flipped = lambda c, n, s: F.when(F.round(F.col(s), 9) < 0, n - 1 - F.col(c)).otherwise(F.col(c))
    return cells.withColumn("row", flipped("row", n_rows, "_sy")).withColumn("col", flipped("col", n_cols, "_sx")).drop("_sy", "_sx")


def row_offsets(cells: DataFrame, rank: str = "rank", place: str = "col") -> DataFrame:
    """Per row, the offset of its lattice places from their ranks: the rounded (half to even) median difference."""
    return cells.groupBy("row").agg(F.rint(F.median(F.col(place) - F.col(rank))).cast("bigint").alias("offset"))

