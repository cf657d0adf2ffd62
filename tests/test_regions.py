"""Tiled components, ring statistics and the table detectors against plain array versions."""

import numpy as np
import pytest

from gridloom.operators import detect, regions

H, W = 48, 56
TTH = np.degrees(np.arctan2(0.5 * np.hypot(*(np.mgrid[0:H, 0:W] + 0.5)), 60.0))
BANDS = [("a", 6.0), ("b", 12.0), ("c", 18.0)]
LOW, RING = float(TTH.min()), 1.0


def rows_of(images):
    return [(g, y, x, float(i[y, x]), float(TTH[y, x])) for g, i in images.items() for y in range(H) for x in range(W)]


@pytest.fixture(scope="module")
def images():
    rng, out = np.random.default_rng(4), {}
    yy, xx = np.mgrid[0:H, 0:W]
    for g in range(3):
        image = 50 + 4 * np.cos(TTH) + rng.normal(0, 1.5, (H, W))
        for k in range(9):
            y, x = rng.integers(4, H - 4), rng.integers(4, W - 4)
            image += rng.uniform(8, 60) * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / rng.uniform(1.5, 4))
        image[30, 10:40] += 30 * (g == 1)  # a streak
        out[g] = image
    out[2][20:22] = 0.0  # a dark gap
    out[3] = np.zeros((H, W))
    return out


@pytest.fixture(scope="module")
def pixels(spark, images):
    return spark.createDataFrame(rows_of(images), "gi int, y long, x long, v double, tth double").cache()


@pytest.fixture(scope="module")
def bands(spark):
    return spark.createDataFrame([(n, t, k) for k, (n, t) in enumerate(BANDS)], "reflection string, two_theta double, ord long")


@pytest.mark.parametrize(("shape", "share", "tile"), [((40, 33), 0.5, 8), ((40, 33), 0.62, 5), ((1062, 1028), 0.3, 256)])
def test_components_across_tiles_equal_one_array(spark, shape, share, tile):
    mask = np.random.default_rng(7).random(shape) < share
    y, x = np.nonzero(mask)
    part = detect.sparse_components(y, x)
    first = np.unique(part, return_index=True)[1][part]
    want = {(5, int(a), int(b), int(y[f]), int(x[f])) for a, b, f in zip(y, x, first, strict=True)}
    import pandas as pd

    hot = spark.createDataFrame(pd.DataFrame({"gi": 5, "y": y, "x": x}))
    assert {tuple(r) for r in regions.pixel_components(hot, tile).select("gi", "y", "x", "root_y", "root_x").collect()} == want


def test_no_pixels(spark, pixels, bands):
    assert regions.pixel_components(pixels.limit(0)).count() == 0
    assert regions.percentile_peaks(pixels.limit(0), bands, H, W).count() == 0


def less_median(image, half):
    ring = np.floor((TTH - LOW) / RING).astype(int)
    medians = np.array([np.median(image[ring == k]) for k in range(ring.max() + 1)])
    size = 2 * half + 1
    return image - detect.running(medians, size, 0, np.mean)[ring], ring


def apart(found, distance):
    kept = []
    for f in sorted(found, key=lambda f: -f["s"]):
        if all((f["cx"] - k["cx"]) ** 2 + (f["cy"] - k["cy"]) ** 2 >= distance**2 for k in kept):
            kept.append(f)
    return kept


def shapes(mask, strength, light):
    y, x = np.nonzero(mask)
    part = detect.sparse_components(y, x)
    for k in range(part.max(initial=-1) + 1):
        py, px = y[part == k], x[part == k]
        w = np.maximum(light[py, px], 0)
        h, wd = np.ptp(py) + 1, np.ptp(px) + 1
        cx, cy = ((v * w).sum() / w.sum() if w.sum() > 0 else v.mean() for v in (px, py))
        yield {"n": len(py), "h": h, "w": wd, "cx": cx, "cy": cy, "s": strength[py, px].max(), "y": py, "x": px}


def label(cx, cy, most):
    gaps = [abs(TTH[cy, cx] - t) for _, t in BANDS]
    return BANDS[int(np.argmin(gaps))][0] if most is None or min(gaps) <= most else "unknown"


def test_percentile_peaks(pixels, bands, images):
    want = []
    for g, image in images.items():
        hot = image >= np.percentile(image, 95)
        hot[:2] = hot[-2:] = hot[:, :2] = hot[:, -2:] = False
        for s in shapes(hot, image, image):
            if s["n"] >= 3:
                cx, cy = int(s["x"].mean()), int(s["y"].mean())
                want.append((g, cx, cy, s["n"], label(cx, cy, None)))
    got = regions.percentile_peaks(pixels, bands, H, W, 0.95, tile=16)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_dual_snr_peaks(pixels, bands, images):
    want = []
    for g, image in images.items():
        clean, ring = less_median(image, 2)
        m = np.median(clean)
        mad = np.median(np.abs(clean - m))
        floor = m + 2.5 * (1.4826 * mad if mad > 0 else clean.std())
        noise = np.array([np.median(np.abs(clean[ring == k] - np.median(clean[ring == k]))) for k in range(ring.max() + 1)])
        noise = np.maximum(detect.running(noise, 5, 0, np.mean), 0.01)[ring]
        annular = np.maximum(detect.top_hat(clean, (7,)), 0) / noise
        box = lambda a: detect.running(detect.running(a, 13, 0, np.mean), 13, 1, np.mean)
        mean = box(clean)
        local = (clean - mean) / np.maximum(np.sqrt(np.maximum(box(clean**2) - mean**2, 0)), 0.01)
        hot = (annular >= 7) & (local >= 2.5) & (clean >= floor) & (np.min([np.abs(TTH - t) for _, t in BANDS], axis=0) <= 2.5)
        for r in np.flatnonzero(image.mean(axis=1) < 0.5):
            hot[max(0, r - 9) : r + 10] = False
        hot[:3] = hot[-3:] = hot[:, :3] = hot[:, -3:] = False
        good = [s for s in shapes(hot, annular, clean) if 3 <= s["n"] <= 150 and not (max(s["h"], s["w"]) / min(s["h"], s["w"]) > 6 and s["n"] > 15)]
        for s in apart(good, 8.0):
            cx, cy = round(s["cx"]), round(s["cy"])
            if label(cx, cy, 2.5) != "unknown":
                want.append((g, cx, cy, label(cx, cy, 2.5), round(float(s["s"]), 6), s["n"]))
    got = regions.dual_snr_peaks(pixels, bands, H, W, LOW, ring=RING, hat=7, window=13, tolerance=2.5, local=2.5, edge=3, separation=8.0, tile=16)
    assert len(want) >= 5 and sorted((r.gi, r.x, r.y, r.label, round(r.snr, 6), r.npix) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize(("k", "rescue_k"), [(4.8, 99.0), (12.0, 4.0)])
def test_tight_band_peaks(pixels, bands, images, k, rescue_k):
    want = []
    for g, image in images.items():
        if image.max() < 5:
            continue
        clean, _ = less_median(image, 3)
        hat = detect.top_hat(clean, (5, 9))
        found = []
        for name, t in BANDS:
            band = np.abs(TTH - t) <= 2.0
            band[:3] = band[-3:] = band[:, :3] = band[:, -3:] = False
            v = hat[band]
            for _ in range(3):
                m, s = detect.threshold(v, 1, 0)
                if (v < m + 5 * s).sum() < 50:
                    break
                v = v[v < m + 5 * s]
            m, s = detect.threshold(v, 1, 0)
            strength = (hat - m) / s
            for r in shapes(band & (hat > m + min(k, rescue_k) * s), strength, clean):
                compact = min(r["h"], r["w"]) / max(r["h"], r["w"]) * r["n"] / (r["h"] * r["w"])
                top = hat[r["y"], r["x"]]
                if not (2 <= r["n"] <= 200 and compact >= 0.08 and top.max() >= 6):
                    continue
                rescued = r["s"] <= k
                if rescued:
                    py, px = r["y"][top.argmax()], r["x"][top.argmax()]
                    yy, xx = np.mgrid[0:H, 0:W]
                    d2 = (yy - py) ** 2 + (xx - px) ** 2
                    values = hat[(d2 >= 9) & (d2 <= 36)]
                    mid = np.median(values)
                    if (hat[py, px] - mid) / max(1.4826 * np.median(np.abs(values - mid)), 0.01) < 5:
                        continue
                found.append(r | {"cx": round(r["cx"]), "cy": round(r["cy"]), "label": name, "rescued": bool(rescued)})
        want += [(g, f["cx"], f["cy"], f["label"], round(float(f["s"]), 6), f["n"], f["rescued"]) for f in apart(found, 6.0)]
    got = regions.tight_band_peaks(pixels, bands, H, W, LOW, ring=RING, half=3, hats=(5, 9), tolerance=2.0, k=k, rescue_k=rescue_k, rescue_snr=5.0, rescue_ring=(3, 6), edge=3, separation=6.0, tile=16)
    assert sorted((r.gi, r.x, r.y, r.label, round(r.snr, 6), r.npix, r.rescued) for r in got.collect()) == sorted(want)
    assert len(want) >= 5 and (rescue_k > k or any(w[-1] for w in want))


def test_region_rules(spark):
    rows = [(k, 1, 1, *v) for k, v in enumerate([(2, 1.0, 1.0), (20, 7.0, 0.5), (14, 7.0, 0.5), (25, 1.0, 0.05), (19, 1.0, 0.05), (300, 1.0, 0.9)])]
    stats = spark.createDataFrame(rows, "gi int, root_y int, root_x int, npix int, aspect double, fill double")
    assert [r.gi for r in regions.well_formed(stats, 3, 150).orderBy("gi").collect()] == [2, 3, 4]
    assert [r.gi for r in regions.well_formed(stats, 3, 150, (6.0, 15), (0.08, 20)).orderBy("gi").collect()] == [2, 4]
