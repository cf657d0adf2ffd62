"""Grid mappings of many scans at once: which coordinates a scan has, and the cells that follow from them.

Frames are rows (scan, gi, file_idx, within_idx, x_um, y_um, recreated); every choice is an
aggregate per scan that is joined back, so one plan lays out all scans. Scans are bounded by
their rasters, and what orders the frames of one scan is a window over that scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.operators.grid import file_rows, fill_gaps, regular_grid, serpentine_rows
from gridloom.session import default_parallelism

KEY = "scan"
#: Frames that a task takes, about, besides those of a scan that is larger.
FRAMES_PER_TASK = 250_000
LOW, HIGH = 0.002, 0.998
LEAST_SPAN = 1e-9


def _dealt(frames: DataFrame) -> DataFrame:
    """frames by scan in parts of a bounded number of frames: their bytes shrink so well that Spark would join the parts to a few."""
    return frames.repartition(max(default_parallelism(frames.sparkSession), -(-frames.count() // FRAMES_PER_TASK)), KEY)


def _corr(a: str, b: str, over: WindowSpec | None = None) -> Column:
    """Correlation, 0 where either is constant or the rest is float noise."""
    r = F.corr(a, b)
    r = r if over is None else r.over(over)
    return F.round(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)), 9)


def _finite(c: str) -> Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))


def positioned(frames: DataFrame) -> DataFrame:
    """frames with x_um and y_um filled between neighbours of their scan; a scan without a value keeps nulls."""
    out = frames.withColumns({c: _finite(c) for c in ("x_um", "y_um")})
    for c in ("x_um", "y_um"):
        out = fill_gaps(out, c, "gi", KEY)
    return out


def faithful_grid(frames: DataFrame, native: bool = False, reach: int = 50, box: int = 20) -> DataFrame:
    """frames with row, col, n_rows and n_cols: file rows, and columns snapped to the true position along the row.

    The column axis is the one that follows the files less. Its lattice has as many cells
    as make pixels square, or (native) as the median file has frames. Directions are those of
    the rows that turns of x give, so the map keeps its orientation. Positions are scaled by
    their 0.2 to 99.8 percentile span; a scan without a span has one column.
    """
    return _faithful(_dealt(frames.select(*frames.columns)), native, reach, box)


def _faithful(frames: DataFrame, native: bool, reach: int, box: int) -> DataFrame:
    """faithful_grid of frames that are dealt by scan. What a scan tells is a window over it, so its frames are laid out once."""
    turned = serpentine_rows(positioned(frames), reach, box, partition=KEY).withColumnsRenamed({"row": "serp_row", "col": "serp_col"})
    rows = file_rows(turned, keys=(KEY,)).drop("col")
    scan = Window.partitionBy(KEY)
    told = rows.withColumn("_rx", F.abs(_corr("row", "x_um", scan)) >= F.abs(_corr("row", "y_um", scan)))
    told = told.withColumn("_rv", F.when(F.col("_rx"), F.col("x_um")).otherwise(F.col("y_um"))).withColumn("_cv", F.when(F.col("_rx"), F.col("y_um")).otherwise(F.col("x_um")))
    ends = lambda c: F.percentile(c, F.array(F.lit(LOW), F.lit(HIGH))).over(scan)
    stats = {
        "_r0": F.min("row").over(scan), "_r1": F.max("row").over(scan), "_re": ends("_rv"), "_ce": ends("_cv"), "_sc": _corr("serp_col", "_cv", scan),
        "_s1": _corr("row", "_rv", scan), "_s2": _corr("serp_row", "_rv", scan),
    }
    sizes = frames.groupBy(KEY, "file_idx").agg(F.count("*").alias("n")).groupBy(KEY).agg(F.floor(F.median("n")).alias("_median"))
    n_rows = F.col("_r1") - F.col("_r0") + 1
    span = lambda e: F.greatest(F.get(e, F.lit(1)) - F.get(e, F.lit(0)), F.lit(LEAST_SPAN))
    square = F.rint(1 + (n_rows - 1) * span("_ce") / span("_re"))
    n_cols = F.greatest(F.lit(1), F.col("_median") if native else square).cast("bigint")
    shape = {"n_rows": n_rows, "n_cols": n_cols, "_lo": F.get("_ce", F.lit(0)), "_hi": F.get("_ce", F.lit(1)), "_back": F.col("_sc") < 0, "_turn": F.col("_s1") * F.col("_s2") < 0}
    both = told.withColumns(stats).join(sizes, KEY).withColumns(shape)
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_cv") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    place = F.rint(F.when(F.col("_back") & (F.col("_hi") > F.col("_lo")), 1 - share).otherwise(share) * (F.col("n_cols") - 1))
    col = F.greatest(F.lit(0), F.least(F.col("n_cols") - 1, place)).cast("bigint")
    row = F.when(F.col("_turn"), F.col("_r1") - F.col("row")).otherwise(F.col("row") - F.col("_r0"))
    return both.select(*frames.columns, row.alias("row"), col.alias("col"), "n_rows", "n_cols")


def grid_sources(frames: DataFrame, method: str = "commanded", deskew: bool = True, share: float = 0.9, n_cols: int | None = None) -> DataFrame:
    """scan, files, modal, per_row and coordinate_source of every scan.

    Real positions are those of scans that are not marked recreated. With both axes: file_per_row
    where files are rows (positions_faithful, positions_faithful_native or perrow_offset by method), else
    positions_xy. With x only, or without deskew: serpentine. Without positions: file_per_row, else
    synthetic if n_cols is given, else none.
    """
    sizes = frames.groupBy(KEY, "file_idx").agg(F.count("*").alias("n"))
    modes = sizes.groupBy(KEY, "n").agg(F.count("*").alias("k")).groupBy(KEY).agg(F.max_by("n", F.struct("k", "n")).alias("modal"), (F.max("k") >= share * F.sum("k")).alias("per_row"), F.sum("k").alias("files"))
    real = ~F.coalesce(F.col("recreated"), F.lit(False))
    known = frames.groupBy(KEY).agg(F.count_if(real & _finite("x_um").isNotNull()).alias("_x"), F.count_if(real & _finite("y_um").isNotNull()).alias("_y"))
    by_file = {"commanded": "file_per_row", "faithful": "positions_faithful", "faithful_native": "positions_faithful_native", "perrow_offset": "perrow_offset"}[method]
    source = (
        F.when((F.col("_x") > 0) & ((F.col("_y") == 0) | F.lit(not deskew)), "serpentine").when(F.col("_x") > 0, F.when(F.col("per_row"), by_file).otherwise("positions_xy"))
        .when(F.col("per_row"), "file_per_row").otherwise("synthetic" if n_cols else "none")
    )
    return modes.join(known, KEY).select(KEY, "files", "modal", "per_row", source.alias("coordinate_source"))


def _snapped(frames: DataFrame, reach: int, box: int) -> DataFrame:
    """row and col by turns of x, snapped to measured positions of as many rows and columns."""
    turned = serpentine_rows(positioned(frames), reach, box, partition=KEY).withColumnsRenamed({"row": "_r", "col": "_c"})
    axis = turned.groupBy(KEY).agg((F.abs(_corr("_r", "x_um")) >= F.abs(_corr("_r", "y_um"))).alias("_rx"), (F.max("_r") + 1).alias("_n"), (F.max("_c") + 1).alias("_m"))
    told = turned.join(axis, KEY).withColumn("_rv", F.when(F.col("_rx"), F.col("x_um")).otherwise(F.col("y_um"))).withColumn("_cv", F.when(F.col("_rx"), F.col("y_um")).otherwise(F.col("x_um")))
    out = told
    for value, ref, n, name in (("_rv", "_r", "_n", "row"), ("_cv", "_c", "_m", "col")):
        ends = told.groupBy(KEY).agg(F.percentile(value, LOW).alias("_lo"), F.percentile(value, HIGH).alias("_hi"), _corr(ref, value).alias("_s"))
        share = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
        place = F.rint(F.when(F.col("_s") < 0, 1 - share).otherwise(share) * (F.col(n) - 1))
        out = out.join(ends, KEY).withColumn(name, F.coalesce(F.greatest(F.lit(0), F.least(F.col(n) - 1, place)), F.lit(0)).cast("bigint")).drop("_lo", "_hi", "_s")
    return out.select(*frames.columns, "row", "col")


def _offset_rows(frames: DataFrame) -> DataFrame:
    """File rows whose columns are ranks along x plus the row's offset: the median of position in steps less rank.

    The step is the median spacing of neighbours of a row. Kept for comparison with the others.
    """
    base = positioned(frames).withColumn("row", F.col("file_idx"))
    line = Window.partitionBy(KEY, "row").orderBy("x_um", "gi")
    spaced = base.withColumn("_rank", F.row_number().over(line) - 1).withColumn("_gap", F.col("x_um") - F.lag("x_um").over(line))
    step = spaced.filter("_gap > 0").groupBy(KEY).agg(F.median("_gap").alias("_step"))
    low = base.groupBy(KEY).agg(F.min("x_um").alias("_x0"))
    placed = spaced.join(step, KEY, "left").join(low, KEY).withColumn("_at", F.try_divide(F.col("x_um") - F.col("_x0"), "_step"))
    offsets = placed.groupBy(KEY, "row").agg(F.rint(F.median(F.col("_at") - F.col("_rank"))).cast("bigint").alias("_off"))
    both = placed.join(offsets, [KEY, "row"])
    shifted = both.withColumn("col", F.col("_rank") + F.coalesce("_off", F.lit(0)))
    first = shifted.groupBy(KEY).agg(F.min("col").alias("_c0"), F.min("row").alias("_r0"))
    return shifted.join(first, KEY).select(*frames.columns, (F.col("row") - F.col("_r0")).alias("row"), (F.col("col") - F.col("_c0")).cast("bigint").alias("col"))


def grid_mapping(frames: DataFrame, method: str = "commanded", deskew: bool = True, n_cols: int | None = None, reach: int = 50, box: int = 20) -> DataFrame:
    """frames with row, col and coordinate_source; scans that nothing lays out have null cells.

    Each scan goes the way that grid_sources names. Rows start at 0 in every scan; frames of a raster of n_cols
    run back and forth in order of gi, which starts at 0 in every scan.
    """
    frames = _dealt(frames.select(*frames.columns))
    routed = frames.join(grid_sources(frames, method, deskew, n_cols=n_cols).select(KEY, "coordinate_source"), KEY)
    of = lambda *names: routed.filter(F.col("coordinate_source").isin(*names))
    cells = lambda df: df.select(*routed.columns, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"))
    by_file = file_rows(of("file_per_row"), keys=(KEY,))
    least = by_file.groupBy(KEY).agg(F.min("row").alias("_r0"))
    parts = [
        cells(by_file.join(least, KEY).withColumn("row", F.col("row") - F.col("_r0"))), cells(_snapped(of("positions_xy"), reach, box)), cells(serpentine_rows(positioned(of("serpentine")), reach, box, partition=KEY)),
        cells(_faithful(of("positions_faithful"), False, reach, box)), cells(_faithful(of("positions_faithful_native"), True, reach, box)), cells(_offset_rows(of("perrow_offset"))),
        cells(of("none").withColumns({"row": F.lit(None), "col": F.lit(None)})),
    ]
    if n_cols:
        first = of("synthetic").groupBy(KEY).agg(F.min("gi").alias("_g0"))
        parts.append(cells(regular_grid(of("synthetic").join(first, KEY).withColumn("_k", F.col("gi") - F.col("_g0")), n_cols, "_k")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
