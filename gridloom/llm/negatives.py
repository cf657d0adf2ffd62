"""Hard negatives by threshold joins of vectors, with an inverted index that leaves out weak dimensions.

Rows are dealt into blocks by their ids and every anchor visits every block. A block orders
its dimensions by their weight and cuts them into panels; a row is posted in the panels
before its suffix norm falls below a share of its norm, and what is left out is only known
by that norm. Rows are in the order of how many panels they are posted in, so a panel's
postings are the first rows of the block, and partial scores of many anchors accumulate
panel by panel. A partial score and the remaining norms bound the score from above: rows
whose bound is under an anchor's threshold are pruned, the others verified in full, and the
threshold is lowered until every window of scores has as many rows as it asks for or lies
above it whole. What a block passes on is bounded by the windows; the best of all blocks win.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut

SCALE = 256
CLASSES = 10
POSITIVES, NEGATIVES = 5, 10
#: Windows of negative scores, in hundredths of the positive's score.
LOW, HIGH = 30, 90
PANEL = 8
#: A row is left out of the panels after which its norm is at most this share of the whole.
OMITTED = 0.5
#: Rows of a block: this many, or more to keep the copies of an anchor within BLOCKS, but never over MAX_ROWS.
MIN_ROWS, BLOCKS, MAX_ROWS = 1024, 100, 200_000
#: Scores that a task holds at once.
CELLS = 4_000_000
FIRST_CANDIDATES = 64
ANY = 2**63 - 1
FOUND = "anchor_id bigint, window bigint, id bigint, score bigint"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label (moved on where 7 divides vec_id) and q, the components' floors at SCALE.

    Rows with a null vec_id, label, vector or component, or a component that isn't finite, are out.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    known = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % CLASSES).otherwise(label)
    return known.select(F.col("vec_id").cast("bigint"), moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")).alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of width whole numbers, padded with zeros or cut."""
    sizes = pc.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    for i, (end, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
        out[i, : min(n, width)] = flat[end - n : end - n + min(n, width)]
    return out


class BlockIndex:
    """The rows of a block, posted by panels of dimensions; of rows that share an id the least label and vector counts."""

    def __init__(self, ids: pa.Array, labels: pa.Array, vectors: pa.Array):
        width = int(pc.max(pc.list_value_length(vectors)).as_py() or 0)
        id_, label, x = ids.to_numpy(), labels.to_numpy(), _matrix(vectors, width)
        unique, count = np.unique(id_, return_counts=True)
        if len(unique) < len(id_):
            again = np.isin(id_, unique[count > 1])
            least: dict[int, tuple] = {}
            for i in np.flatnonzero(again).tolist():
                mine = (int(label[i]), vectors[i].as_py(), i)
                least[int(id_[i])] = min(least.get(int(id_[i]), mine), mine)
            keep = ~again
            keep[[i for _, _, i in least.values()]] = True
            id_, label, x = id_[keep], label[keep], x[keep]
        square = x.astype(np.float64) ** 2
        self.dims = np.argsort(-square.sum(axis=0), kind="stable")
        self.panels = [slice(k, min(k + PANEL, width)) for k in range(0, width, PANEL)]
        ends = np.cumsum(square[:, self.dims][:, ::-1], axis=1)[:, ::-1]
        rest = np.sqrt(np.concatenate([ends[:, :: PANEL], np.zeros((len(x), 1))], axis=1))  # norm from each panel on
        posted = np.maximum((rest > OMITTED * rest[:, :1]).sum(axis=1), min(1, len(self.panels)))
        order = np.argsort(-posted, kind="stable")
        self.ids, self.labels, self.x = id_[order], label[order], x[order][:, self.dims]
        self.posted, self.rest = posted[order], rest[order, posted[order]]
        self.most = float(np.abs(x.astype(np.float64)).max(initial=0))
        self.cast: dict = {}

    def rows_as(self, kind) -> np.ndarray:
        if kind not in self.cast:
            self.cast[kind] = self.x.astype(kind)
        return self.cast[kind]

    def search(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, windows: list, same: bool, most: int) -> list[tuple]:
        """(anchor, window, id, score) of the first most rows in every window (key, low, high) of each anchor."""
        q, out = q[:, self.dims], []
        reach = self.most * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, len(self.dims))
        kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64 if reach < 2**63 else object
        x, q = self.rows_as(kind), q.astype(kind)
        partial = np.zeros((len(q), len(x)), dtype=kind)
        for k, panel in enumerate(self.panels):
            n = int(np.searchsorted(-self.posted, -k, side="left"))  # rows posted in more than k panels
            partial[:, :n] += q[:, panel] @ x[:n, panel].T
        square = np.cumsum((q.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
        q_rest = np.sqrt(np.concatenate([square[:, ::PANEL], np.zeros((len(q), 1))], axis=1))
        for i, own in enumerate(windows):
            rows = np.flatnonzero(((self.labels == labels[i]) == same) & (self.ids != ids[i]))
            known = partial[i, rows].astype(np.float64)
            bound = known + q_rest[i, self.posted[rows]] * self.rest[rows] * (1 + 1e-9) + np.abs(known) * 1e-12 + 1e-3  # above all rounding
            out += self._windows(int(ids[i]), rows, bound, x, q[i], own, most)
        return out

    def _windows(self, anchor: int, rows: np.ndarray, bound: np.ndarray, x: np.ndarray, q: np.ndarray, windows: list, most: int) -> list[tuple]:
        lowest, tried = min(low for _, low, _ in windows), FIRST_CANDIDATES
        while True:
            threshold = lowest if tried >= len(rows) else max(lowest, float(np.partition(bound, -tried)[-tried]))
            picked = rows[bound >= threshold]
            exact = (x[picked] @ q).astype(np.int64)
            order = np.lexsort((self.ids[picked], -exact))
            picked, exact = picked[order], exact[order]
            out, full = [], True
            for key, low, high in windows:
                a = int(np.searchsorted(-exact, -high, side="left"))
                b = min(a + most, int(np.searchsorted(-exact, -low, side="right")))
                full &= threshold <= low or (b - a == most and exact[b - 1] >= threshold)
                out += [(anchor, key, int(self.ids[r]), int(s)) for r, s in zip(picked[a:b], exact[a:b], strict=True)]
            if full:
                return out
            tried *= 4


def _visited(same: bool, most: int):
    """Per block: index its rows, which come first, then search for the anchors as they come."""

    def found(index: BlockIndex, part: pa.RecordBatch):
        q = _matrix(part.column("q"), len(index.dims))
        ids, labels, windows = part.column("id").to_numpy(), part.column("label").to_numpy(), part.column("windows").to_pylist()
        step = max(1, CELLS // max(1, len(index.ids)))
        for a in range(0, len(ids), step):
            own = [[(w["key"], w["low"], w["high"]) for w in ws] for ws in windows[a : a + step]]
            hits = index.search(ids[a : a + step], labels[a : a + step], q[a : a + step], own, same, most)
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits, strict=True)], ["anchor_id", "window", "id", "score"])

    def run(batches):
        now, held, index = None, [], None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if block[a] != now:
                    now, held, index = block[a], [], None
                if kind[a] == 0:
                    held.append(part.select(["id", "label", "q"]))
                elif held or index is not None:
                    if index is None:
                        whole = pa.Table.from_batches(held).combine_chunks()
                        index, held = BlockIndex(*(whole[c].combine_chunks() for c in ("id", "label", "q"))), []
                    yield from found(index, part)

    return run


def threshold_join(anchors: DataFrame, rows: DataFrame, blocks: int, same: bool, most: int) -> DataFrame:
    """anchor_id, window, id, score and rank: the first most rows of each anchor's windows.

    anchors: vec_id, label, q and windows (array of key, low, high); rows: vec_id, label, q.
    same: whether rows of the anchor's label are sought, or all others. Higher scores
    come first, ties by id. Anchors are copied to every block, rows are dealt once.
    """
    at = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("array<struct<key:bigint,low:bigint,high:bigint>>")
    own = rows.select(at.alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "q", none.alias("windows"))
    copies = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "label", "q", "windows")
    met = own.unionByName(copies).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_visited(same, most), FOUND)
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _windows(key, low, high):
    return F.struct(key.cast("bigint").alias("key"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are rows whose vec_id every divides. Their positives are the first positives
    other rows of their label by inner product, and of each the negatives are the first
    rows of other labels with a score of low to high hundredths of the positive's. Ties go to
    the smaller vec_id. Rows with nulls or components that aren't finite are out. Of rows
    that repeat a vec_id the least label and vector counts. Vectors of unequal lengths
    meet in the dimensions that both have. Scores must fit 64 bits. Other columns are ignored.
    """
    rows = whole_vectors(vectors)
    total = vectors.count()
    blocks = max(1, -(-total // MAX_ROWS), min(BLOCKS, -(-total // MIN_ROWS)))
    anchors = cut(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("least")).select("vec_id", "least.*"))

    anywhere = F.array(_windows(F.lit(0), F.lit(-ANY), F.lit(ANY)))
    best = threshold_join(anchors.withColumn("windows", anywhere), rows, blocks, True, positives)
    best = cut(best.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    score, hundred = F.col("positive_score").cast("decimal(20,0)"), F.lit(100).cast("decimal(20,0)")
    # no window is open under a negative score
    window = _windows(F.col("positive_id"), F.call_function("div", score * low + 99, hundred), F.call_function("div", score * high, hundred))
    asked = best.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(window).alias("windows"))
    hits = threshold_join(anchors.join(asked, "vec_id"), rows, blocks, False, negatives)
    hits = hits.select("anchor_id", F.col("window").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hits.join(best, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
