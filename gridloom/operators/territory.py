"""Territories: grown regions of a scan's positions, their neighbours and geometry."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import default_parallelism

#: Pairs of places whose distances are taken at once.
PAIRS = 1_000_000


def near_pairs(ident: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the place in the arrays of every point with those of its k nearest others, ties by ident, as spatial.nearest_neighbours gives them.

    Points on one place ask once, and of them only the first by ident can be among the nearest. The ring starts
    where it holds about 2 k places (at cell at most) and doubles for the places that are short.
    """
    order = np.lexsort((ident, y, x))
    order = order[np.isfinite(x[order]) & np.isfinite(y[order])]
    if len(order) < 2:
        return order[:0], order[:0]
    px, py = x[order], y[order]
    new = np.r_[True, (px[1:] != px[:-1]) | (py[1:] != py[:-1])]
    start, site = np.flatnonzero(new), np.cumsum(new) - 1
    held = np.arange(len(order)) - start[site] <= k
    ident, cx, cy, target = ident[order], px - px.min(), py - py.min(), np.flatnonzero(held)  # distances are taken of px and py as they came
    sx, sy, tx, ty = cx[start], cy[start], cx[held], cy[held]
    wide, high, sites = float(cx.max()), float(cy.max()), len(start)
    ring = max(np.sqrt(wide * high * (2.0 * (k + 1) / 3.14) / sites), max(wide, high) * (k + 1) / sites)
    ring = min(ring, cell) if ring > 0 else cell
    wanted, reach = min(len(target), k + 1), np.hypot(np.maximum(sx, wide - sx), np.maximum(sy, high - sy))
    open_, found = np.arange(sites), []
    while len(open_):
        size = ring * 1.000001
        across = int(wide // size) + 3
        code = (ty // size).astype(np.int64) * across + (tx // size).astype(np.int64) + 1
        by = np.argsort(code, kind="stable")
        own = (sy[open_] // size).astype(np.int64) * across + (sx[open_] // size).astype(np.int64) + 1
        rows = own[:, None] + across * np.arange(-1, 2)
        first, last = np.searchsorted(code[by], rows - 1), np.searchsorted(code[by], rows + 1, side="right")
        total, at, short = np.cumsum((last - first).sum(axis=1)), 0, []
        while at < len(open_):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            n = (last - first)[at:end].ravel()
            p = np.repeat(np.repeat(open_[at:end], 3), n)
            q = by[np.repeat(first[at:end].ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())]
            d = np.sqrt((px[start[p]] - px[target[q]]) ** 2 + (py[start[p]] - py[target[q]]) ** 2)
            close = d <= np.minimum(ring, reach[p])
            p, q, d = p[close], q[close], d[close]
            sort = np.lexsort((ident[target[q]], d, p))
            p, q = p[sort], q[sort]
            count = np.bincount(p - open_[at], minlength=open_[end - 1] - open_[at] + 1)[open_[at:end] - open_[at]]
            lacking = (count < wanted) & (ring < reach[open_[at:end]])
            rank = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
            take = (rank <= k) & ~np.repeat(lacking, count)
            found.append((p[take], target[q[take]]))
            short.append(open_[at:end][lacking])
            at = end
        open_, ring = np.concatenate(short), 2 * ring
    p, q = (np.concatenate(c) for c in zip(*found, strict=True))
    sort = np.argsort(p, kind="stable")
    p, q = p[sort], q[sort]
    # every point of a place takes the list of the place but for itself
    low = np.searchsorted(p, site)
    n = np.searchsorted(p, site, side="right") - low
    a = np.repeat(np.arange(len(order)), n)
    b = q[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    other = ident[a] != ident[b]
    a, b = a[other], b[other]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return order[a[rank < k]], order[b[rank < k]]


def grow(points: DataFrame, size: int, cell: float, k: int = 8, key: str = "scan") -> DataFrame:
    """scan, id, tid: each point's territory.

    Seeds are taken in order of id; a territory takes free neighbours nearest to its seed
    until it holds size points. The order makes this one task a scan, over positions and
    ids only, and so the scan's neighbours are found in that task too.
    """
    kind = dict(points.dtypes)[key]

    def run(group, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id").reset_index(drop=True)
        ids = own.id.to_numpy()
        place = {i: n for n, i in enumerate(ids.tolist())}
        xy = own[["x", "y"]].to_numpy(dtype=float)
        links: list[set] = [set() for _ in ids]
        if not pd.isna(group[0]):
            for a, b in zip(*[ids[c].tolist() for c in near_pairs(ids, xy[:, 0], xy[:, 1], k, cell)], strict=True):
                links[place[a]].add(place[b])
                links[place[b]].add(place[a])
        tid = [-1] * len(ids)
        for seed in range(len(ids)):
            if tid[seed] >= 0:
                continue
            heap, count = [(0.0, seed)], 0
            while heap and count < size:
                _, at = heapq.heappop(heap)
                if tid[at] >= 0:
                    continue
                tid[at] = seed
                count += 1
                free = [n for n in links[at] if tid[n] < 0]
                for d, n in zip(np.hypot(*(xy[free] - xy[seed]).T).tolist(), free, strict=True):
                    heapq.heappush(heap, (d, n))
        return pd.DataFrame({key: group[0], "id": ids, "tid": ids[np.array(tid, dtype=int)]})

    # by count: their bytes would leave many scans in few tasks
    dealt = points.select(key, "id", "x", "y").repartition(default_parallelism(points.sparkSession), key)
    return dealt.groupBy(key).applyInPandas(run, f"{key} {kind}, id bigint, tid bigint")


def neighbours(members: DataFrame, near: DataFrame, key: str = "scan") -> DataFrame:
    """Territories that adjoin: any two of their points are neighbours."""
    a = members.select(key, "id", F.col("tid").alias("a"))
    b = members.select(key, F.col("id").alias("r_id"), F.col("tid").alias("b"))
    return near.join(a, [key, "id"]).join(b, [key, "r_id"]).filter("a <> b").select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def geometry(members: DataFrame, points: DataFrame, key: str = "scan") -> DataFrame:
    """Centroid, count and box area of each territory."""
    places = points.select(F.col(key).alias(key), F.col("id").alias("id"), "x", "y")
    return members.join(places, [key, "id"]).groupBy(key, "tid").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("box"))


def angle_clusters(rows: DataFrame, angle: str, weight: str, key: str, width: float = 8.0, prominence: float = 0.05) -> DataFrame:
    """key, degree, density, cluster: a circular kernel density on 360 degrees, cut at its prominent valleys.

    Rows are first summed by whole degree, so a group is 360 rows whatever the input.
    """
    degree = F.pmod(F.floor(angle).cast("bigint"), F.lit(360))
    counts = rows.groupBy(key, degree.alias("degree")).agg(F.sum(F.col(weight).cast("double")).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros(360)
        w[pdf.degree.to_numpy(dtype=int)] = pdf.w
        apart = np.minimum(np.arange(360), 360 - np.arange(360))
        kernel = np.exp(-0.5 * (apart / width) ** 2)
        dens = np.real(np.fft.ifft(np.fft.fft(w) * np.fft.fft(kernel / kernel.sum())))
        low = (dens <= np.roll(dens, 1)) & (dens < np.roll(dens, -1))
        cuts = [v for v in np.flatnonzero(low) if dens.max() - dens[v] > prominence * max(dens.max(), 1e-12)]
        cluster = np.searchsorted(cuts, np.arange(360), side="right") % max(1, len(cuts))
        return pd.DataFrame({key: pdf[key].iloc[0], "degree": np.arange(360), "density": dens, "cluster": cluster})

    kind = dict(rows.dtypes)[key]
    return counts.groupBy(key).applyInPandas(run, f"{key} {kind}, degree bigint, density double, cluster bigint")
