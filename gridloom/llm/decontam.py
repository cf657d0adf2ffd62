"""Benchmark decontamination by spaced-seed hashing.

Texts are loose words: runs of ASCII letters, digits and other Unicode, lower-cased.
Masks pick 3 of at most 5 neighbouring words in every way; the others are ignored, so
substituted words don't hide a passage. Training windows and benchmark windows meet by
the hash of the picked words, and a hit names a diagonal (where the item would start in
the document). Were no 5 neighbours to hold 3 equal words, under MIN_SHARE of the words
would be equal, so no leak is without hits; diagonals with fewer hits than a leak must
have are dropped, the others are verified word by word over the whole overlap.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import LOOSE, Words, chunked, texts_of
from gridloom.session import cut

SPAN = 12
#: All picks of 3 of 5 neighbouring words, by the first one picked.
BLOCK = 5
MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
MIN_SHARE = 0.6
LONG_RUN = 20
MISMATCH = -2
#: Benchmarks up to this many seeds, and bytes of seeds and words, are looked up in a broadcast table; larger ones are joined.
BROADCAST_SEEDS = 1_000_000
BROADCAST_BYTES = 32 << 20
SEED_BYTES = 8 + 8 + 4
CHUNK_BYTES = 2 << 20
SEEDS = "key bigint, pos int, seed bigint"


def _lane(k: int) -> int:
    return k % 2


def _seed_grams(words: Words, hashes: np.ndarray, short: tuple[int, ...]):
    """(starts, seeds) of every mask, and of whole windows of the lengths in short."""
    for k, mask in enumerate(MASKS):
        at, h = words.grams(hashes, mask[-1] + 1, _lane(k), list(mask))
        yield SPAN, at, h ^ np.uint64(k + 1)
    for n in short:
        at, h = words.grams(hashes, n)
        yield n, at, h ^ np.uint64(n << 32)


def benchmark_items(items: DataFrame) -> DataFrame:
    """key, item and the item's word hashes: a row for each different text of an item_id.

    Items with a null id or without words have none.
    """

    def run(frames):
        for pdf in frames:
            texts = [(text or "").encode() for text in pdf.text]
            raw = [Words([text], LOOSE).hashes(lower=True).tobytes() for text in texts]
            yield pd.DataFrame({"item": pdf.item, "words": raw})

    found = items.select(F.col("item_id").cast("bigint").alias("item"), "text").filter("item is not null").mapInPandas(run, "item bigint, words binary")
    return cut(found.filter("octet_length(words) > 0").distinct().withColumn("key", F.monotonically_increasing_id()))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """key, pos and seed, for every masked window of every row of benchmark_items.

    Items under SPAN words have one seed, the whole item.
    """

    def run(frames):
        for pdf in frames:
            for key, raw in zip(pdf.key, pdf.words, strict=True):
                hashes = np.frombuffer(raw, dtype=np.uint64)
                words = Words([b""], LOOSE)
                words.first = np.array([0, len(hashes)])
                short = () if len(hashes) >= SPAN else (len(hashes),)
                for _, at, seeds in _seed_grams(words, hashes, short):
                    yield pd.DataFrame({"key": key, "pos": at.astype(np.int32), "seed": seeds.view(np.int64)})

    return items.select("key", "words").mapInPandas(run, SEEDS)


def _region(equal: np.ndarray) -> tuple[int, int, int]:
    """start, end, matches of the best-scoring run of an aligned overlap: +1 a match, MISMATCH otherwise."""
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, MISMATCH))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[-1])
    return start, end, int(equal[start:end].sum())


def least_hits(n: int) -> int:
    """Hits that the diagonal of a leak of an item of n words has at least.

    Blocks of 5 words with 3, 4 and 5 equal ones have 1, 4 and 10 hits, so a run of L
    words with m equal has m - 2 * (L // 5) - min(L % 5, 2) or more. That is 8 or more
    for a region with LONG_RUN matches, as it has at most half as many other words.
    """
    if n < SPAN:
        return 1
    share = math.ceil(MIN_SHARE * n - 1e-9) - 2 * (n // BLOCK) - min(n % BLOCK, 2)
    return max(1, min(share, LONG_RUN - 2 * (3 * LONG_RUN // 2 // BLOCK)))


def leaked(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """start, end in the document's words and matches, if the diagonal holds a leak of the item.

    A leak matches MIN_SHARE of the item's words in the whole overlap, or LONG_RUN words in one region.
    """
    a, b = max(0, shift), min(len(doc), shift + len(item))
    if b <= a:
        return None
    equal = doc[a:b] == item[a - shift : b - shift]
    at = np.flatnonzero(equal)
    if len(at) and len(at) >= MIN_SHARE * len(item):
        return a + int(at[0]), a + int(at[-1]) + 1, len(at)
    start, end, matches = _region(equal)
    return (a + start, a + end, matches) if matches >= LONG_RUN else None


LEAK = ("item", "start", "end", "matches", "item_words")
LEAKS = "array<struct<item:bigint,start:int,end:int,matches:int,item_words:int>>"


def _verified(doc: np.ndarray, item: int, words: np.ndarray, shifts) -> list[dict]:
    best = max((x for s in shifts if (x := leaked(doc, words, int(s)))), key=lambda x: x[2], default=None)
    return [dict(zip(LEAK, (item, *best, len(words)), strict=True))] if best else []


def _best(leaks: list[dict]) -> list[dict]:
    """The leak with the largest share of each item_id, whichever of its texts leaks."""
    best: dict[int, dict] = {}
    for x in leaks:
        had = best.get(x["item"])
        if had is None or x["matches"] * had["item_words"] > had["matches"] * x["item_words"]:
            best[x["item"]] = x
    return list(best.values())


def _lookup(docs: DataFrame, items: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, leaks of every row, looking document windows up in a broadcast table of all seeds."""
    seeds, items = seeds.select("seed", "key", "pos").toPandas(), items.select("key", "item", "words").toPandas().sort_values("key")
    order = np.argsort(seeds.seed.to_numpy().view(np.uint64), kind="stable")
    names, known = items["item"].to_numpy(), np.searchsorted(items.key.to_numpy(), seeds.key.to_numpy())
    words_of = [np.frombuffer(raw, dtype=np.uint64) for raw in items.words]
    short = tuple(sorted({len(w) for w in words_of if len(w) < SPAN}))
    table = seeds.seed.to_numpy().view(np.uint64)[order]
    filled = np.zeros(1 << 20, dtype=bool)
    filled[(table >> np.uint64(44)).astype(np.int64)] = True
    least = np.array([least_hits(len(w)) for w in words_of], dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((table, known[order], seeds.pos.to_numpy()[order], names, words_of, filled, least))

    def run(batches):
        table, items, places, names, words_of, filled, least = shared.value
        for batch in batches:
            texts = texts_of(batch.column(1))
            out: list[list[dict]] = [[] for _ in texts]
            for a, b in chunked(texts, CHUNK_BYTES):
                words = Words(texts[a:b], LOOSE)
                hashes = words.hashes(lower=True)
                hits = []
                for _, at, h in _seed_grams(words, hashes, short):
                    may = filled[(h >> np.uint64(44)).astype(np.int64)]
                    at, h = at[may], h[may]
                    low, high = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
                    n = high - low
                    if n.any():
                        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        place = np.repeat(at, n)
                        hits.append(np.stack([np.repeat(words.text_of_word()[at], n), items[entry], place - places[entry]], axis=1))
                if not hits:
                    continue
                rows, n = np.unique(np.concatenate(hits), axis=0, return_counts=True)
                rows = rows[n >= least[rows[:, 1]]]
                if not len(rows):
                    continue
                cuts = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
                for part in np.split(rows, cuts):
                    t, i = int(part[0, 0]), int(part[0, 1])
                    first, last = words.first[t], words.first[t + 1]
                    out[a + t] += _verified(hashes[first:last], int(names[i]), words_of[i], part[:, 2] - first)
            out = [_best(x) for x in out]
            kind = pa.list_(pa.struct([("item", pa.int64()), *((x, pa.int32()) for x in LEAK[1:])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "leaks"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, leaks {LEAKS}")


def _joined(docs: DataFrame, items: DataFrame, seeds: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """The same by an equi-join of all document windows with all seeds, then of hits with the texts."""
    docs = cut(docs.withColumn("uid", F.monotonically_increasing_id()))

    def windows(batches):
        for batch in batches:
            uids, texts = np.array(batch.column(0).to_pylist(), dtype=np.int64), texts_of(batch.column(1))
            for a, b in chunked(texts, CHUNK_BYTES):
                words = Words(texts[a:b], LOOSE)
                hashes = words.hashes(lower=True)
                for _, at, h in _seed_grams(words, hashes, short):
                    text = words.text_of_word()[at]
                    yield pa.RecordBatch.from_arrays([pa.array(uids[a:b][text]), pa.array((at - words.first[text]).astype(np.int32)), pa.array(h.view(np.int64))], ["uid", "at", "seed"])

    grams = docs.select("uid", "text").mapInArrow(windows, "uid bigint, at int, seed bigint")
    hits = grams.join(seeds.select("seed", "key", "pos"), "seed").select("uid", "key", (F.col("at") - F.col("pos")).alias("shift")).groupBy("uid", "key", "shift").agg(F.count("*").alias("hits"))
    sizes = items.select("key", (F.octet_length("words") / 8).cast("int").alias("n"))
    share = F.ceil(MIN_SHARE * F.col("n") - 1e-9) - 2 * F.floor(F.col("n") / BLOCK) - F.least(F.col("n") % BLOCK, F.lit(2))
    least = F.when(F.col("n") < SPAN, 1).otherwise(F.greatest(F.lit(1), F.least(share, F.lit(least_hits(10**6)))))
    hits = hits.join(sizes, "key").filter(F.col("hits") >= least)
    diagonals = hits.groupBy("uid", "key").agg(F.collect_set("shift").alias("shifts"))

    def verify(frames):
        for pdf in frames:
            out: list[dict] = []
            for uid, text, item, raw, shifts in zip(pdf.uid, pdf.text, pdf.item, pdf.words, pdf.shifts, strict=True):
                doc = Words([(text or "").encode()], LOOSE).hashes(lower=True)
                out += [x | {"uid": uid} for x in _verified(doc, item, np.frombuffer(raw, dtype=np.uint64), shifts)]
            yield pd.DataFrame(out, columns=["uid", *LEAK])

    both = diagonals.join(items, "key").join(docs.select("uid", "text"), "uid").select("uid", "text", "item", "words", "shifts")
    found = both.mapInPandas(verify, "uid bigint, item bigint, start int, end int, matches int, item_words int")
    best = F.max_by(F.struct(*LEAK), F.col("matches") / F.col("item_words")).alias("leak")
    leaks = found.groupBy("uid", "item").agg(best).groupBy("uid").agg(F.collect_list("leak").alias("leaks"))
    return docs.select("uid", "doc_id").join(leaks, "uid", "left").select("doc_id", F.coalesce("leaks", F.expr(f"cast(array() as {LEAKS})")).alias("leaks"))


def find_leaks(docs: DataFrame, items: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id and the best leak of each item, for every row of docs; places count loose words."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    known = benchmark_items(items)
    seeds = cut(benchmark_seeds(known))
    n = seeds.count()
    held = n * SEED_BYTES + (known.agg(F.sum(F.octet_length("words").cast("bigint"))).first()[0] or 0)
    if n <= broadcast_seeds and held <= broadcast_bytes:
        return _lookup(rows, known, seeds)
    lengths = known.select((F.octet_length("words") / 8).cast("int").alias("n")).filter(F.col("n") < SPAN).distinct().collect()
    return _joined(rows, known, seeds, tuple(sorted(r.n for r in lengths)))


def contamination(docs: DataFrame, items: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, max_share and leaks of every row of docs.

    item_ids are the benchmark items that leak, ascending; max_share is the largest share
    of an item's words that is matched, 0 without a leak; leaks hold the places. Null
    and empty texts are clean. Rows are judged one by one, repeats too. Items with a null
    id or without words match nothing. Other columns are ignored.
    """
    found = find_leaks(docs, items, broadcast_seeds)
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("bigint").alias("n_items"),
        F.array_sort(F.transform("leaks", lambda x: x["item"])).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["matches"] / x["item_words"])), F.lit(0.0)).alias("max_share"),
        "leaks",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that leak a benchmark item.

    A doc_id goes where any of its rows leaks; the texts are read again by an anti-join on ids.
    """
    bad = contamination(docs, items).filter("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
