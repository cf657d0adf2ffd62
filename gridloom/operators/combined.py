"""Whole-scan search for spots: each frame is detected once, linked, probed around its candidates and verified.

Frames are rows (brow, bcol, pixels) of one scan and meet candidates by cell key. A pass
over the frames sums them for a background that all share, a second detects spots, and a
third takes the aperture sums of all candidates near a frame in one go. What is kept in
memory beside a batch of frames is one detector image.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import detect, spatial, voigt
from gridloom.session import cut, default_parallelism

CELL_LIMIT = 1e9


@dataclass(frozen=True)
class Search:
    """Parameters of a search. tth: an angle a pixel; bands: names and angles."""

    tth: np.ndarray
    bands: tuple[tuple[str, float], ...]
    ring_width: float = 0.05
    smooth: int = 15
    tolerance: float = 0.5
    hats: tuple[int, ...] = (13,)
    k_sigma: float = 3.0
    min_pixels: int = 2
    max_pixels: int = 250
    min_compactness: float = 0.03
    min_band: int = 100
    edge: int = 3
    separation: float = 15.0
    most: int = 30
    link: float = 5.0
    min_cells: int = 3
    radius: int = 5
    aperture: int = 4
    rules: voigt.Rules = field(default_factory=voigt.Rules)

    @property
    def ring(self) -> np.ndarray:
        """Ring of each pixel, from the least angle on."""
        return np.floor((self.tth - self.tth.min()) / self.ring_width).astype(int)


def _image(flat, shape: tuple[int, int]) -> np.ndarray:
    return np.clip(np.asarray(flat, dtype=float), 0, CELL_LIMIT).reshape(shape)


def summed(frames: DataFrame, size: int) -> DataFrame:
    """pos, total and n: sums of the clipped frames by pixel; a task passes on one partial image."""

    def run(batches):
        total, n = np.zeros(size), 0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            total += np.clip(flat, 0, CELL_LIMIT).reshape(-1, size).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["total", "n"])

    parts = frames.filter(F.size("pixels") == size).select("pixels").mapInArrow(run, "total array<double>, n bigint")
    return parts.select("n", F.posexplode("total").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("total"), F.sum("n").alias("n"))


def shared_background(frames: DataFrame, search: Search) -> np.ndarray:
    """Background of one frame: ring medians of the sum of all frames, smoothed over rings, by their number.

    The sum is one detector image, which the driver holds.
    """
    rows = summed(frames, search.tth.size).orderBy("pos").toPandas()
    if rows.empty:
        return np.zeros(search.tth.shape)
    image = rows.total.to_numpy().reshape(search.tth.shape)
    return detect.radial_background(image, search.ring, search.smooth) / int(rows.n.iloc[0])


def spots(cleaned: np.ndarray, search: Search) -> list[tuple]:
    """(label, x, y, snr, npix, compactness) of one cleaned image, strongest first, none nearer than separation."""
    hat = detect.top_hat(cleaned, search.hats)
    inside, e = np.zeros(cleaned.shape, dtype=bool), search.edge
    inside[e : cleaned.shape[0] - e, e : cleaned.shape[1] - e] = True
    found = []
    for label, centre in search.bands:
        band = inside & (np.abs(search.tth - centre) <= search.tolerance)
        if band.sum() < max(1, search.min_band):
            continue
        level, sigma = detect.threshold(hat[band], search.k_sigma, 0)
        if sigma <= 0:
            continue
        y, x = np.nonzero(band & (hat > level + search.k_sigma * sigma))
        part = detect.sparse_components(y, x)
        order, sizes = np.argsort(part, kind="stable"), np.bincount(part, minlength=1)
        ends = np.cumsum(sizes)
        for k in np.flatnonzero((sizes >= search.min_pixels) & (sizes <= search.max_pixels)).tolist():
            mine = order[ends[k] - sizes[k] : ends[k]]
            py, px = y[mine], x[mine]
            h, w = np.ptp(py) + 1, np.ptp(px) + 1
            compact = min(h, w) / max(h, w) * len(py) / (h * w)
            if compact < search.min_compactness:
                continue
            weight = np.maximum(cleaned[py, px], 0)
            cx, cy = (round(float((v * weight).sum() / weight.sum())) if weight.sum() > 0 else int(v.mean()) for v in (px, py))
            found.append((label, cx, cy, float((hat[py, px].max() - level) / sigma), len(py), float(compact)))
    found.sort(key=lambda s: -s[3])
    kept: list[tuple] = []
    for s in found:
        if all((s[1] - o[1]) ** 2 + (s[2] - o[2]) ** 2 >= search.separation**2 for o in kept):
            kept.append(s)
    return kept[: search.most]


def _dealt(frames: DataFrame, *columns: Column | str) -> DataFrame:
    """brow, bcol and columns of frames, dealt by count: little to read and much work each, so files and bytes would leave them in a few tasks."""
    cells = [F.col(c).cast("bigint").alias(c) for c in ("brow", "bcol")]
    return frames.select(*cells, *columns).repartition(default_parallelism(frames.sparkSession), "brow", "bcol")


SPOTS = "brow bigint, bcol bigint, label string, x int, y int, snr double, npix int, compactness double"


def detect_frames(frames: DataFrame, background: np.ndarray, search: Search, scale: Column | None = None) -> DataFrame:
    """Spots of every frame less scale (1 if none) backgrounds; the fit of frames of another size than tth is left out."""
    shape = search.tth.shape
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64())
    names = [f.split()[0] for f in SPOTS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for r, c, flat, times in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                rows += [(r, c, *s) for s in spots(_image(flat, shape) - times * background, search)]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], k) for i, k in enumerate(kinds)], names)

    used = frames.filter(F.size("pixels") == search.tth.size)
    times = (F.lit(1.0) if scale is None else scale).cast("double")
    return _dealt(used, "pixels", times.alias("times")).mapInArrow(run, SPOTS)


def candidates(members: DataFrame, least: int) -> DataFrame:
    """component, px, py (centre weighted by snr), center_row, center_col (strongest member) of components over least cells."""
    weight = F.greatest(F.col("snr"), F.lit(0.1))
    best = F.struct("snr", -F.col("brow"), -F.col("bcol"), -F.col("id"))
    centre = lambda c: F.rint(F.sum(F.col(c) * weight) / F.sum(weight)).cast("int")
    grouped = members.groupBy("component").agg(F.countDistinct("brow", "bcol").alias("n_cells"), centre("x").alias("px"), centre("y").alias("py"), F.max_by("brow", best).alias("center_row"), F.max_by("bcol", best).alias("center_col"))
    return grouped.filter(F.col("n_cells") >= least)


def probe(frames: DataFrame, found: DataFrame, background: np.ndarray, radius: int, aperture: int) -> DataFrame:
    """component, center_row, center_col, brow, bcol, net: aperture sums less background in all cells around each candidate.

    A frame meets all candidates near it as one list; they are at most the detections of
    the cells around it, so the list is bounded. Frames are read once.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = found.withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps))
    point = F.struct("component", "center_row", "center_col", "px", "py")
    asked = spread.groupBy((F.col("center_row") + F.col("_r")).alias("brow"), (F.col("center_col") + F.col("_c")).alias("bcol")).agg(F.collect_list(point).alias("points"))
    met = frames.filter(F.size("pixels") == background.size).join(asked, ["brow", "bcol"]).select("brow", "bcol", "pixels", "points")

    def window(image: np.ndarray, x: int, y: int) -> float:
        return float(image[max(0, y - aperture) : max(0, y + aperture + 1), max(0, x - aperture) : max(0, x + aperture + 1)].sum())

    def run(batches):
        for batch in batches:
            rows = []
            for r, c, flat, points in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                image = _image(flat, background.shape)
                rows += [(p["component"], p["center_row"], p["center_col"], r, c, window(image, p["px"], p["py"]) - window(background, p["px"], p["py"])) for p in points]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], k) for i, k in enumerate(kinds)], ["component", "center_row", "center_col", "brow", "bcol", "net"])

    typed = met.select(F.col("brow").cast("bigint"), F.col("bcol").cast("bigint"), "pixels", "points")
    return typed.mapInArrow(run, "component bigint, center_row bigint, center_col bigint, brow bigint, bcol bigint, net double")


def numbered_by_cell(rows: DataFrame, order: list[str], name: str = "feature_id") -> DataFrame:
    """Ids from 1 over all rows in order of cells, then of order. Only the cells' counts are sorted in one place."""
    cells = rows.groupBy("brow", "bcol").agg(F.count("*").alias("_n"))
    before = Window.orderBy("brow", "bcol").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("brow", "bcol").orderBy(*order))
    return rows.withColumn("_k", place).join(starts, ["brow", "bcol"]).withColumn(name, F.col("_start") + F.col("_k")).drop("_k", "_start")


def full_scan(frames: DataFrame, search: Search) -> tuple[DataFrame, DataFrame]:
    """Verified spots of a scan (feature rows), and the verdict on every candidate.

    Feature rows, one a member of a kept candidate: feature_id, label, x, y, brow, bcol, component, with
    null peak_intensity and mean_snr, as single detections carry no profile.
    """
    background = shared_background(frames, search)
    found = cut(detect_frames(frames, background, search).withColumn("id", F.monotonically_increasing_id()))
    members = cut(spatial.grid_components(found, search.link, ()))
    chosen = cut(candidates(members, search.min_cells))
    verdict = voigt.verify(probe(frames, chosen, background, search.radius, search.aperture), ["component"], search.rules)
    kept = members.join(verdict.filter("kept").select("component"), "component", "left_semi")
    rows = kept.select("component", "label", "x", "y", "brow", "bcol", "id", F.lit(None).cast("double").alias("peak_intensity"), F.lit(None).cast("double").alias("mean_snr"), F.lit(1).cast("bigint").alias("n_bins"))
    return numbered_by_cell(rows, ["label", "id"]).drop("id"), verdict


def concentric_sums(pixels: DataFrame, centres: DataFrame, radii: tuple[int, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """center_row, center_col, y, x, and s<r> and n<r> for each radius: sums of the cells within r steps.

    pixels: brow, bcol, y, x, v. Cells go to the centres around them by key, each is added
    at its own distance, and one aggregate takes all nested sums.
    """
    far = max(radii)
    steps = F.sequence(F.lit(-far), F.lit(far))
    around = centres.select(*keys, "center_row", "center_col").distinct().withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps))
    around = around.select(*keys, "center_row", "center_col", (F.col("center_row") + F.col("_r")).alias("brow"), (F.col("center_col") + F.col("_c")).alias("bcol"), F.greatest(F.abs("_r"), F.abs("_c")).alias("_d"))
    met = pixels.join(around, [*keys, "brow", "bcol"])
    sums = [a for r in radii for a in (F.sum(F.when(F.col("_d") <= r, F.col("v"))).alias(f"s{r}"), F.count_if(F.col("_d") <= r).alias(f"n{r}"))]
    return met.groupBy(*keys, "center_row", "center_col", "y", "x").agg(*sums)


def stacked_frames(sums: DataFrame, radius: int) -> DataFrame:
    """brow, bcol, pixels and n: the stack of one radius around each centre as a frame at the centre's cell."""
    cell = F.struct("y", "x", F.coalesce(f"s{radius}", F.lit(0.0)).alias("v"))
    return sums.groupBy("center_row", "center_col").agg(F.array_sort(F.collect_list(cell)).alias("_p"), F.max(f"n{radius}").alias("n")).select(F.col("center_row").alias("brow"), F.col("center_col").alias("bcol"), F.col("_p.v").alias("pixels"), "n")


#: The named searches around centres by what tells them apart, as fixed values: stack radii and separation, cells a
#: feature needs, least r2 and inner to outer ratio, and how far points move and must be apart.
CENTRE_SEARCHES = {
    "baseline": {"stacks": (), "least_r2": 0.30, "inner_outer": 1.15, "half": 0, "most": 0, "apart": 25.0},
    "hybrid": {"stacks": (2,), "stack_apart": 15.0, "least_r2": 0.25, "inner_outer": 1.15, "half": 3, "most": 5, "apart": 25.0},
    "tuned": {"stacks": (3,), "stack_apart": 15.0, "least_r2": 0.20, "inner_outer": 1.15, "half": 5, "most": 5, "apart": 20.0},
    "concentric": {"stacks": (3, 5), "stack_apart": 14.0, "least_r2": 0.20, "inner_outer": 1.20, "half": 5, "most": 7, "apart": 20.0},
}


def centre_search(frames: DataFrame, centres: DataFrame, search: Search, kind: str = "hybrid", least_cells: int = 2) -> DataFrame:
    """center_row, center_col, label, x, y, quality: verified spots of every centre cell, for all centres in one plan.

    Frames near a centre are detected once, however many centres they are near; stacks
    around the centres add what single frames hide. Features that reach a centre are probed
    around it and verified, their strongest spot there moves to the centre of light of the centre's frame, and
    of points that are close the better stays. centres: center_row, center_col, of any number.
    """
    rule = CENTRE_SEARCHES[kind]
    background = shared_background(frames, search)
    wanted = centres.select(F.col("center_row").cast("bigint").alias("center_row"), F.col("center_col").cast("bigint").alias("center_col")).distinct()
    steps = F.sequence(F.lit(-search.radius), F.lit(search.radius))
    near = wanted.withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps)).select((F.col("center_row") + F.col("_r")).alias("brow"), (F.col("center_col") + F.col("_c")).alias("bcol")).distinct()
    used = frames.join(near, ["brow", "bcol"], "left_semi")
    found = cut(detect_frames(used, background, search))
    if rule["stacks"]:
        width = search.tth.shape[1]
        flat = used.select("brow", "bcol", F.posexplode("pixels").alias("_p", "v"))
        pixels = flat.select("brow", "bcol", F.floor(F.col("_p") / width).cast("int").alias("y"), (F.col("_p") % width).alias("x"), F.least(F.greatest("v", F.lit(0.0)), F.lit(CELL_LIMIT)).alias("v"))
        found = merged_spots(found, stack_spots(pixels, wanted, search, rule["stacks"], separation=rule["stack_apart"]), rule["stack_apart"])
    found = cut(found.withColumn("id", F.monotonically_increasing_id()))
    members = cut(spatial.grid_components(found, search.link, ()))
    at_centre = members.join(wanted, (F.col("brow") == F.col("center_row")) & (F.col("bcol") == F.col("center_col"))).drop("brow", "bcol")
    best = F.struct("snr", -F.col("id"))
    heads = at_centre.groupBy("component", "center_row", "center_col").agg(*[F.max_by(c, best).alias(c) for c in ("label", "x", "y")])
    places = candidates(members, least_cells).select("component", "px", "py")
    chosen = cut(heads.join(places, "component"))
    # a component may reach several centres, and is a candidate of each
    numbered = cut(chosen.withColumn("candidate", F.monotonically_increasing_id()))
    asked = numbered.select(F.col("candidate").alias("component"), "center_row", "center_col", "px", "py")
    rules = replace(search.rules, least_r2=rule["least_r2"], inner_outer=rule["inner_outer"])
    verdict = voigt.verify(probe(used, asked, background, search.radius, search.aperture), ["component"], rules)
    quality = F.coalesce("r2", "falling", F.lit(0.0)).alias("quality")
    kept = numbered.join(verdict.filter("kept").select(F.col("component").alias("candidate"), quality), "candidate").select("candidate", "center_row", "center_col", "label", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "quality")
    if rule["half"]:
        light = cleaned_pixels(used.join(wanted.select(F.col("center_row").alias("brow"), F.col("center_col").alias("bcol")), ["brow", "bcol"], "left_semi"), background)
        kept = refined(kept, light.withColumnsRenamed({"brow": "center_row", "bcol": "center_col"}), rule["half"], rule["most"], ("center_row", "center_col"))
    return best_of_close(kept, rule["apart"], ("center_row", "center_col"), "quality", "candidate").drop("candidate")


def cleaned_pixels(frames: DataFrame, background: np.ndarray) -> DataFrame:
    """brow, bcol, y, x, v: the pixels of frames less the background."""
    width = background.shape[1]

    def run(batches):
        for batch in batches:
            clean = [(_image(flat, background.shape) - background).ravel().tolist() for flat in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(clean, pa.list_(pa.float64()))], ["brow", "bcol", "v"])

    used = frames.filter(F.size("pixels") == background.size).select(F.col("brow").cast("bigint"), F.col("bcol").cast("bigint"), "pixels")
    flat = used.mapInArrow(run, "brow bigint, bcol bigint, v array<double>").select("brow", "bcol", F.posexplode("v").alias("_p", "v"))
    return flat.select("brow", "bcol", F.floor(F.col("_p") / width).alias("y"), (F.col("_p") % width).cast("bigint").alias("x"), "v")


def merged_spots(first: DataFrame, more: DataFrame, separation: float) -> DataFrame:
    """first, and those of more that have none of first nearer than separation in their cell; more's own may be close."""
    near = spatial.distance_join(more, first.select("brow", "bcol", "x", "y"), separation, ("brow", "bcol"), strict=True)
    return first.unionByName(more.join(near.select("brow", "bcol", "x", "y").distinct(), ["brow", "bcol", "x", "y"], "left_anti"))


def stack_spots(pixels: DataFrame, centres: DataFrame, search: Search, radii: tuple[int, ...] = (3, 5), least_frames: int = 5, separation: float = 14.0) -> DataFrame:
    """Spots of concentric stacks around centres: those of the smallest radius, then others of each wider stack.

    A stack's background is its own radial median. Stacks of fewer than least_frames cells are left out.
    """
    sums = cut(concentric_sums(pixels, centres, radii))
    out = None
    for r in sorted(radii):
        frames = stacked_frames(sums.filter(F.col(f"n{r}") >= least_frames), r)
        found = cut(detect_stacks(frames, search))
        out = found if out is None else merged_spots(out, found, separation)
    return out


def detect_stacks(frames: DataFrame, search: Search) -> DataFrame:
    """Spots of frames that are each cleaned by their own radial median."""
    shape, ring = search.tth.shape, search.ring
    names = [f.split()[0] for f in SPOTS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64())

    def run(batches):
        for batch in batches:
            rows = []
            for r, c, flat in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                image = _image(flat, shape)
                rows += [(r, c, *s) for s in spots(image - detect.radial_background(image, ring, search.smooth), search)]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], k) for i, k in enumerate(kinds)], names)

    used = frames.filter(F.size("pixels") == search.tth.size)
    return _dealt(used, "pixels").mapInArrow(run, SPOTS)


def refined(points: DataFrame, pixels: DataFrame, half: int, most: int, keys: tuple[str, ...] = ("gi",)) -> DataFrame:
    """points with x and y at the centre of light of the square around them, unless that moves an axis over most.

    Light is what is over 0; without any, or without pixels, a point stays. pixels: keys, y, x, v.
    """
    steps = F.sequence(F.lit(-half), F.lit(half))
    asked = points.select(*keys, "x", "y").distinct().select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), F.explode(steps).alias("_a")).withColumn("_b", F.explode(steps))
    cells = asked.select(*keys, "_x", "_y", (F.col("_y") + F.col("_a")).alias("y"), (F.col("_x") + F.col("_b")).alias("x"))
    w = F.greatest(F.col("v"), F.lit(0.0))
    lit = cells.join(pixels.select(*keys, "y", "x", "v"), [*keys, "y", "x"]).groupBy(*keys, "_x", "_y").agg(*[F.rint(F.try_divide(F.sum(F.col(c) * w), F.sum(w))).cast("bigint").alias(f"_n{c}") for c in ("x", "y")])
    both = points.withColumn("_x", F.col("x")).withColumn("_y", F.col("y")).join(lit, [*keys, "_x", "_y"], "left")
    moves = (F.abs(F.col("_nx") - F.col("x")) <= most) & (F.abs(F.col("_ny") - F.col("y")) <= most)
    return both.withColumn("_ok", F.coalesce(moves, F.lit(False))).withColumns({"x": F.when(F.col("_ok"), F.col("_nx")).otherwise(F.col("x")), "y": F.when(F.col("_ok"), F.col("_ny")).otherwise(F.col("y"))}).drop("_x", "_y", "_nx", "_ny", "_ok")


def best_of_close(points: DataFrame, distance: float, keys: tuple[str, ...] = ("gi",), quality: str = "quality", ident: str = "id") -> DataFrame:
    """points that no better kept point is nearer to than distance; equal quality goes to the smaller id.

    Settled in rounds until nothing changes, which is what going through the points from the best on gives.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(quality), ident))
    ranked = cut(points.withColumn("_rank", place))
    return spatial.suppress(ranked, distance, keys, "_rank").drop("_rank")
