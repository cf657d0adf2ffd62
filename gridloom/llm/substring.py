"""Substring deduplication by fixed-block anchors.

A window of 20 words that occurs twice has, in its reference occurrence, an aligned
block of 10 words (blocks start at every tenth word of a document). So the aligned
blocks are the index, and every rolling 10-word window of every document probes it. A
probe that meets an aligned block elsewhere is an anchor; anchors are extended to the
20-word windows around them, whose hashes are compared over all documents. A window
that also starts earlier is a repeat, and adjoining repeats are the maximal exact
repeats whose words are removed.

Documents are kept as blocks of about two megabytes of text, compressed, and everything
between them travels as packed arrays: a block sends each different hash once, in order
of hash, so a passage that a third of all documents share costs one entry a block, and
the answer is one bit an entry. No pairs are formed.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import LANES, Words, chunked, mix, texts_of
from gridloom.session import cut

WINDOW = 20
ANCHOR = 10
BLOCK_BYTES = 2 << 20
BUCKET_ENTRIES = 2_000_000
BLOCKS = "n_words bigint, doc_ids binary, null_ids binary, sizes binary, body binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class Block:
    """Some documents: ids and texts."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.doc_ids, dtype="<i8")
        self.null_ids = np.frombuffer(row.null_ids, dtype=bool)
        sizes = np.frombuffer(row.sizes, dtype="<i8")
        body = pa.decompress(row.body, int(sizes.sum()), codec="zstd", asbytes=True) if sizes.sum() else b""
        ends = np.cumsum(sizes)
        self.texts = [body[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block (unique), n_words and the packed documents of runs of rows; null texts are empty."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in chunked(texts, block_bytes):
                part = texts[a:b]
                body = b"".join(part)
                null = np.array([x is None for x in ids[a:b]], dtype=bool)
                known = np.array([x or 0 for x in ids[a:b]], dtype="<i8")
                sizes = np.array([len(t) for t in part], dtype="<i8")
                packed = pa.compress(body, codec="zstd", asbytes=True) if body else b""
                columns = [[len(Words(part))], [known.tobytes()], [null.tobytes()], [sizes.tobytes()], [packed]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["n_words", "doc_ids", "null_ids", "sizes", "body"])

    packed = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, BLOCKS)
    return packed.withColumn("block", F.monotonically_increasing_id())


def planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned values, byte by byte, so that they compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), dtype=np.uint8)
    out[:, :width] = flat.T
    return out.reshape(-1).view("<u8")


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each hash: n equal slices of the hash space, so sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _slices(buckets: np.ndarray):
    """(bucket, from, to) of the runs of a sorted bucket array."""
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(buckets)], strict=True):
        if b > a:
            yield int(buckets[a]), a, b


class Anchors:
    """The different rolling 10-word hashes of a block, sorted, with where they start."""

    def __init__(self, words: Words, hashes: np.ndarray):
        self.at, grams = words.grams(hashes, ANCHOR)
        order = np.argsort(grams, kind="stable")
        self.sorted_at, grams = self.at[order], grams[order]
        new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, bool)
        self.rank = np.cumsum(new) - 1  # of each sorted window, its hash's rank
        self.unique = grams[new]
        first = np.repeat(words.first[:-1], np.diff(words.first))
        in_text = self.sorted_at - (first[self.sorted_at] if len(first) else 0)
        self.aligned = np.bincount(self.rank[in_text % ANCHOR == 0], minlength=len(self.unique)) > 0
        self.several = np.bincount(self.rank, minlength=len(self.unique)) > 1


PROBES = "bucket int, block bigint, hashes binary, aligned binary, several binary"


def _probe(n_buckets: int):
    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                words = Words(Block(row).texts)
                anchors = Anchors(words, words.hashes())
                rows = [
                    (k, row.block, planes(anchors.unique[a:b], 6), np.packbits(anchors.aligned[a:b]).tobytes(), np.packbits(anchors.several[a:b]).tobytes())
                    for k, a, b in _slices(_buckets(anchors.unique, n_buckets))
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=["bucket", "block", "hashes", "aligned", "several"])

    return run


def _by_bucket(frames):
    """All rows of each bucket of a partition that is sorted by bucket."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        for bucket, rows in pdf.groupby("bucket", sort=True):
            if held and held[-1].bucket.iloc[0] != bucket:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held, ignore_index=True)


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)


def _answers(rows: pd.DataFrame, sizes: list[int], mask: np.ndarray):
    at = np.concatenate([[0], np.cumsum(sizes)])
    keep = [(b, k, np.packbits(mask[s:e]).tobytes()) for b, k, s, e in zip(rows.block, rows.bucket, at[:-1], at[1:], strict=True) if mask[s:e].any()]
    return pd.DataFrame(keep, columns=["block", "bucket", "mask"])


def _meet(frames):
    """Per bucket: which entries' hash is an aligned block somewhere and occurs more than once."""
    for rows in _by_bucket(frames):
        hashes = [unplanes(h, 6) for h in rows.hashes]
        sizes = [len(h) for h in hashes]
        aligned = np.concatenate([_bits(x, n) for x, n in zip(rows.aligned, sizes, strict=True)])
        several = np.concatenate([_bits(x, n) for x, n in zip(rows.several, sizes, strict=True)])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        group = np.empty(len(flat), dtype=np.int64)
        group[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        count = np.bincount(group)
        again = (count > 1) | (np.bincount(group, weights=several) > 0)
        hit = again & (np.bincount(group, weights=aligned) > 0)
        yield _answers(rows, sizes, hit[group])


MASKS = "block bigint, bucket int, mask binary"


def _masked(n: int, unique: np.ndarray, n_buckets: int, answer) -> np.ndarray:
    """A block's answers as one mask over its different hashes."""
    out = np.zeros(n, dtype=bool)
    if answer is None:
        return out
    masks = {int(x["bucket"]): bytes(x["mask"]) for x in answer}
    for k, a, b in _slices(_buckets(unique, n_buckets)):
        if k in masks:
            out[a:b] = _bits(masks[k], b - a)
    return out


class Windows:
    """The different 20-word windows of a block around its anchors, sorted by hash."""

    def __init__(self, block: Block, words: Words, hashes: np.ndarray, hit: np.ndarray, anchors: Anchors):
        near = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.bincount(anchors.sorted_at[hit[anchors.rank]], minlength=len(words))[: len(words)] > 0, out=near[1:])
        last = np.repeat(words.first[1:], np.diff(words.first)) - WINDOW
        at = np.flatnonzero(np.arange(len(words)) <= last)
        # anchors that lie inside the window start at its words 0 to WINDOW - ANCHOR
        at = at[near[at + WINDOW - ANCHOR + 1] > near[at]]
        high = np.zeros(len(at), dtype=np.uint64)
        low = np.zeros(len(at), dtype=np.uint64)
        for k in range(WINDOW):
            high += hashes[at + k] * LANES[0, k]
            low += hashes[at + k] * LANES[1, k]
        high, low = mix(high), mix(low) & np.uint64(0xFFFF)
        text = words.text_of_word()[at]
        ids = block.ids[text]
        start = at - words.first[text]
        order = np.lexsort((start, ids, low, high))
        self.at, high, low, ids, start = at[order], high[order], low[order], ids[order], start[order]
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(at) else np.zeros(0, bool)
        self.rank = np.cumsum(new) - 1
        self.high, self.low, self.least_id, self.least_start = high[new], low[new], ids[new], start[new]
        # repeats within the block: windows that don't start where their hash's earliest does
        self.later = (ids != self.least_id[self.rank]) | (start != self.least_start[self.rank])


def _around(row, n_buckets: int) -> tuple[Block, Words, Windows]:
    block = Block(row)
    words = Words(block.texts)
    hashes = words.hashes()
    anchors = Anchors(words, hashes)
    hit = _masked(len(anchors.unique), anchors.unique, n_buckets, row.anchors)
    return block, words, Windows(block, words, hashes, hit, anchors)


CANDIDATES = "bucket int, block bigint, high binary, low binary, ids binary, starts binary"


def _extend(n_buckets: int):
    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                _, _, w = _around(row, n_buckets)
                rows = [
                    (k, row.block, planes(w.high[a:b], 8), planes(w.low[a:b], 2), planes(w.least_id[a:b].view(np.uint64), 8), planes(w.least_start[a:b], 4))
                    for k, a, b in _slices(_buckets(w.high, n_buckets))
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=["bucket", "block", "high", "low", "ids", "starts"])

    return run


def _earliest(frames):
    """Per bucket: which entries' window starts earlier in another block."""
    for rows in _by_bucket(frames):
        high = [unplanes(h, 8) for h in rows.high]
        sizes = [len(h) for h in high]
        high = np.concatenate(high)
        low = np.concatenate([unplanes(x, 2) for x in rows.low])
        ids = np.concatenate([unplanes(x, 8).view(np.int64) for x in rows.ids])
        starts = np.concatenate([unplanes(x, 4) for x in rows.starts])
        order = np.lexsort((starts, ids, low, high))
        new = np.concatenate([[True], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)])
        group = np.cumsum(new) - 1
        least = order[new]
        later = np.empty(len(high), dtype=bool)
        later[order] = (ids[order] != ids[least][group]) | (starts[order] != starts[least][group])
        yield _answers(rows, sizes, later)


def _removed(n_buckets: int):
    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                block = Block(row)
                if row.anchors is None:
                    words, gone = Words(block.texts), None
                else:
                    block, words, w = _around(row, n_buckets)
                    repeat = _masked(len(w.high), w.high, n_buckets, row.repeats)[w.rank] | w.later
                    steps = np.zeros(len(words) + WINDOW + 1, dtype=np.int64)
                    np.add.at(steps, w.at[repeat], 1)
                    np.add.at(steps, w.at[repeat] + WINDOW, -1)
                    gone = np.cumsum(steps)[: len(words)] > 0
                out = []
                for i, text in enumerate(block.texts):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    kept, lost = text.split(), 0
                    if gone is not None and (mine := gone[a:b]).any():
                        lost = int(mine.sum())
                        kept = [w for w, x in zip(kept, mine.tolist(), strict=True) if not x]
                    out.append((None if block.null_ids[i] else int(block.ids[i]), b - a, lost, hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
                yield pd.DataFrame(out, columns=names, dtype=object).astype({"doc_id": "Int64"})  # never floats, which lose digits of ids

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row of docs.

    A word goes if it lies in a window of 20 words of its document whose words also
    start earlier: in a document with a smaller doc_id, or in the same one. Rows that
    repeat a doc_id start equally early and don't remove each other's windows at equal
    places; a null doc_id counts as 0. Null texts are empty. Documents of under 20
    words keep all. Windows are judged on the input. Other columns are ignored.
    """
    blocks = cut(text_blocks(docs, block_bytes))
    total = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BUCKET_ENTRIES))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket")

    def gathered(masks: DataFrame, name: str) -> DataFrame:
        return masks.groupBy("block").agg(F.collect_list(F.struct("bucket", "mask")).alias(name))

    anchors = cut(by_bucket(blocks.mapInPandas(_probe(n), PROBES)).mapInPandas(_meet, MASKS))
    _free(blocks)
    known = blocks.join(gathered(anchors, "anchors"), "block")
    repeats = cut(by_bucket(known.mapInPandas(_extend(n), CANDIDATES)).mapInPandas(_earliest, MASKS))
    _free(blocks)
    both = blocks.join(gathered(anchors, "anchors"), "block", "left").join(gathered(repeats, "repeats"), "block", "left")
    columns = RESULT + (", kept_text string" if with_text else "")

    def final(frames):
        for pdf in _removed(n)(frames):
            yield pdf if with_text else pdf.drop(columns="kept_text")

    return both.mapInPandas(final, columns)


def _free(df: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
