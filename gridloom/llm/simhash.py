"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ
in three bits at most, one of the segments differs in one bit at most, so some variant
of it with one bit deleted is equal on both sides. Every different fingerprint is
indexed under its 64 variants (segment, deleted bit, rest); equal variants are verified
on the whole fingerprints, and links join into components.

Rows are reduced to different fingerprints before they are indexed, so copies cost
nothing. In a bucket only a spanning forest of the links leaves the task, never all
pairs. Buckets over HOT_BUCKET are dealt again by the bytes of the other segment, one
of which must be equal, which splits them over many tasks without losing a link.
"""

from __future__ import annotations

import itertools
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import CHUNK_BYTES, LANES, Words, chunked, mix, texts_of
from gridloom.operators.graph import connected_components
from gridloom.session import cut, release

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
HOT_BUCKET = 4096
#: Byte lanes hold this many set bits; hashes that are counted at once.
LANE_ROWS = 255
COUNTED_ROWS = 1 << 16


def shingle_hashes(words: list[bytes], n: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every n-word shingle, repeats included; of the whole where words are fewer."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(n, len(words))
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), dtype=np.uint64, count=len(words) - n + 1)


def fingerprints_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signed 64-bit SimHashes of the runs hashes[bounds[i]:bounds[i + 1]]; an empty run gives 0.

    A bit is set where over half of the run's hashes set it. Bits are counted in byte lanes
    of up to LANE_ROWS hashes, COUNTED_ROWS at a time, so long runs take no more memory.
    """
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), dtype=np.int64)
    busy = np.flatnonzero(sizes)
    if not len(busy):
        return out
    parts = -(-sizes[busy] // LANE_ROWS)
    heads = np.cumsum(parts) - parts
    cuts = np.repeat(bounds[:-1][busy], parts) + LANE_ROWS * (np.arange(parts.sum()) - np.repeat(heads, parts))
    ends = np.append(cuts[1:], bounds[-1])
    lanes = np.empty((len(cuts), 64), dtype=np.uint8)
    at = 0
    while at < len(cuts):
        to = max(at + 1, int(np.searchsorted(ends, cuts[at] + COUNTED_ROWS, side="right")))
        bits = np.unpackbits(hashes[cuts[at] : ends[to - 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        lanes[at:to] = np.add.reduceat(bits, cuts[at:to] - cuts[at], axis=0).view(np.uint8)
        at = to
    over = np.add.reduceat(lanes, heads, axis=0, dtype=np.int64) * 2 > sizes[busy, None]
    out[busy] = np.packbits(over, axis=1, bitorder="little").view(np.int64)[:, 0]
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of one text's shingle hashes."""
    return int(fingerprints_of(hashes, np.array([0, len(hashes)]))[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp for every row; null texts have no words and the fingerprint 0."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in chunked(texts, CHUNK_BYTES):
                hashes = [shingle_hashes(t.lower().split(), shingle_words) for t in texts[a:b]]
                bounds = np.cumsum([0, *map(len, hashes)])
                fps = pa.array(fingerprints_of(np.concatenate(hashes), bounds), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _variants(fps: DataFrame, *keep: str) -> DataFrame:
    """key, family, fp and the columns in keep: the 64 one-bit-deleted segments of each fingerprint.

    A key holds, from the top, the family (under 2**20; fingerprints meet within theirs only),
    the deleted bit's place (0-63, which also names the segment) and the segment's other bits.
    """
    place = F.col("place")
    segment = F.when(place < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    rest = segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, place % 32)")))
    head = F.shiftleft(F.col("family").cast("bigint") * 64 + place, 32)
    return fps.select("family", *keep, "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place")).select(head.bitwiseOR(rest).alias("key"), "family", *keep, "fp")


def _other() -> Column:
    """The segment of fp that key does not name."""
    first = F.expr("shiftright(key, 32) & 63") < 32
    return F.when(first, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))


def _rekeyed(hot: DataFrame) -> DataFrame:
    """Deal hot buckets by one byte of the other segment; three differing bits leave one of four bytes equal."""
    byte = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("byte")
    dealt = hot.select("key", "family", "fp", _other().alias("other"), byte).withColumn("value", F.expr("shiftrightunsigned(other, byte * 8) & 255"))
    return dealt.select(F.xxhash64("key", "byte", "value").alias("key"), "family", "fp")


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the components of one bucket; each row meets the unreached rest once."""
    links: list[tuple[int, int]] = []
    rest = np.unique(fps)
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count(rest ^ np.int64(front.pop())) <= max_bits
            if near.any():
                reached = rest[near].tolist()
                links.extend((root, x) for x in reached)
                front.extend(reached)
                rest = rest[~near]
    return links


def _stars(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of one bucket that are worth verifying one by one: to the nearest other and to a hub.

    Hubs are taken by their number of neighbours, so the original of a family of copies
    meets them all. At most two links a fingerprint, each within max_bits. A fingerprint
    that has more neighbours than links is linked to itself: its other pairs are open.
    """
    fps = np.unique(fps)
    n = len(fps)
    degree, nearest, distance = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for a in range(0, n, 256):
        apart = np.bitwise_count(fps[a : a + 256, None] ^ fps[None, :]).astype(np.int64)
        apart[np.arange(len(apart)), np.arange(a, a + len(apart))] = 99
        degree[a : a + 256] = (apart <= max_bits).sum(axis=1)
        nearest[a : a + 256] = apart.argmin(axis=1)
        distance[a : a + 256] = apart.min(axis=1)
    links = {(int(fps[i]), int(fps[nearest[i]])) for i in np.flatnonzero(distance <= max_bits)}
    free = np.ones(n, dtype=bool)
    for hub in np.argsort(-degree, kind="stable").tolist():
        if not degree[hub]:
            break
        if free[hub]:
            near = free & (np.bitwise_count(fps ^ fps[hub]) <= max_bits)
            near[hub] = False
            links.update((int(fps[hub]), x) for x in fps[near].tolist())
            free &= ~near
            free[hub] = False
    links = {(min(a, b), max(a, b)) for a, b in links}
    linked = np.bincount(np.searchsorted(fps, [x for pair in links for x in pair]).astype(np.int64), minlength=n)
    return sorted(links) + [(x, x) for x in fps[linked < degree].tolist()]


def _whole_buckets(frames, where: list[str]):
    """(rows, starts, ends) of buckets that are complete; rows come sorted by the columns in where."""
    held: list[pd.DataFrame] = []
    for pdf in itertools.chain(frames, [None]):
        if pdf is not None:
            if not len(pdf):
                continue
            held.append(pdf)
            if (pdf[where].iloc[-1] == held[0][where].iloc[0]).all():
                continue  # one bucket so far
        if not held:
            return
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        at = rows[where].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1])
        ends = np.append(starts[1:], len(rows))
        if pdf is not None:
            held = [rows.iloc[starts[-1] :]]
            starts, ends = starts[:-1], ends[:-1]
        if len(starts):
            yield rows, starts, ends


def _bucket_links(max_bits: int, hot_bucket: int | None, within=_forest):
    """Links within the buckets of a partition that is sorted by key.

    Rows are family, src and dst; for buckets over hot_bucket, rows with a key and src
    but no dst, to be dealt again.
    """

    def frame(family, src, dst, key) -> pd.DataFrame:
        none = [None] * len(src)
        return pd.DataFrame({"family": family, "src": src, "dst": pd.array(none if dst is None else dst, "Int64"), "key": pd.array(none if key is None else [key] * len(src), "Int64")})

    def run(frames):
        for rows, starts, ends in _whole_buckets(frames, ["key"]):
            fps, families = rows.fp.to_numpy(), rows.family.to_numpy()
            size = ends - starts
            two = starts[size == 2]
            a, b = fps[two], fps[two + 1]
            near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
            links = [(families[two][near], a[near], b[near])]
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                if hot_bucket and e - s > hot_bucket:
                    yield frame(families[s:e], fps[s:e], None, int(rows.key.iat[s]))
                else:
                    found = np.array(within(fps[s:e], max_bits), dtype=np.int64).reshape(-1, 2).T
                    links.append((np.full(found.shape[1], families[s]), found[0], found[1]))
            family, src, dst = (np.concatenate(x) for x in zip(*links, strict=True))
            if len(src):
                yield frame(family, src, dst, None)

    return run


LINKS = "family int, src bigint, dst bigint, key bigint"


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, within=_forest) -> DataFrame:
    """family, src, dst: links of fps (family int, fp bigint) within max_bits (3 at most).

    With _forest they join the same components as all such pairs would.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one deleted bit find at most three differing bits")
    dealt = _variants(fps.distinct()).repartition("key").sortWithinPartitions("key")
    found = cut(dealt.mapInPandas(_bucket_links(max_bits, HOT_BUCKET, within), LINKS))
    links = found.filter("dst is not null")
    hot = found.filter("dst is null")
    if hot.limit(1).count():
        again = _rekeyed(hot.select("key", "family", F.col("src").alias("fp"))).repartition("key").sortWithinPartitions("key")
        links = links.unionByName(again.mapInPandas(_bucket_links(max_bits, None, within), LINKS))
    return links.select("family", "src", "dst").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    Fingerprints link at max_bits differing bits or fewer; component_id is the least
    doc_id reachable, the row's own included. Rows with no words share the fingerprint
    0 and link like any other. Repeated rows come back as often as they occur; null
    doc_ids never name a component. Other columns are ignored.
    """
    marks = cut(fingerprints(docs, shingle_words))
    classes = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_links(classes.select(F.lit(0).alias("family"), "fp"), max_bits)
    parts = connected_components(links).select(F.col("node").alias("fp"), "component")
    named = classes.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(least, "component").select("fp", "component_id")
    return marks.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of a text in the near-copy stage, each over its different words under a hash function of its own.
FAMILIES = 6
SIMILARITY = 0.8
VERIFY_WORDS = 5


def _lowered(batches):
    """Batches (doc_id, text) as (doc_ids, texts, Words) of about CHUNK_BYTES each, A-Z lower-cased."""
    for batch in batches:
        texts = texts_of(batch.column(1))
        for a, b in chunked(texts, CHUNK_BYTES):
            part = [t.lower() for t in texts[a:b]]
            yield batch.column(0).slice(a, b - a), part, Words(part)


def _families(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the words, and FAMILIES fingerprints f0, f1, ... of its different words."""
    names = [f"f{i}" for i in range(FAMILIES)]

    def run(batches):
        for ids, texts, words in _lowered(batches):
            owner, hashes = words.text_of_word(), words.hashes()
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))[: len(owner)]
            hashes, bounds = hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))
            fps = [pa.array(fingerprints_of(mix(hashes * LANES[1, k]), bounds), pa.int64()) for k in range(len(names))]
            digests = [blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), *fps], ["doc_id", "digest", *names])

    return docs.mapInArrow(run, "doc_id bigint, digest binary, " + ", ".join(f"{n} bigint" for n in names))


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted different 32-bit hashes of its VERIFY_WORDS-word shingles."""

    def run(batches):
        for ids, texts, words in _lowered(batches):
            hashes = words.hashes()
            out = []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                n = min(VERIFY_WORDS, b - a)
                own = sum((hashes[a + k : b - n + 1 + k] * LANES[0, k] for k in range(n)), np.zeros(max(0, b - a - n + 1), dtype=np.uint64))
                out.append(np.unique((mix(own) >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, shingles binary")


def _similar(similarity: float):
    def run(frames):
        for pdf in frames:
            keep = []
            for a, b in zip(pdf.left, pdf.right, strict=True):
                a, b = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield pdf.loc[np.array(keep, dtype=bool), ["src", "dst"]]

    return run


def _apart(low: int, high: int, similarity: float, hot_bucket: int | None):
    """Pairs of different components in the buckets of a partition that is sorted by BUCKET, fp and node.

    Buckets of one component are settled. Of those over hot_bucket the rows come back, to be dealt again by bytes.

    A pair is taken in one bucket of those it shares, and where its places in the bucket
    are low to high - 1 apart; a row without dst says that pairs further apart are left.
    Pairs whose sizes alone rule the similarity out are not candidates.
    """
    full = np.uint64(0xFFFFFFFF)

    def pairs(key: int, byte: int, fps: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, parts: np.ndarray):
        segment, bit = divmod((key >> 32) & 63, 32)
        names, counts = np.unique(parts, return_counts=True)
        major = names[counts.argmax()]
        rest, place = np.flatnonzero(parts != major), np.arange(len(fps))
        step = max(1, (1 << 20) // len(fps))
        for k in range(0, len(rest), step):
            i = rest[k : k + step, None]
            x = fps[i] ^ fps[None, :]
            own, other = (x >> np.uint64(32 * segment)) & full, (x >> np.uint64(32 * (1 - segment))) & full
            take = (np.bitwise_count(x) <= MAX_BITS) & (parts[i] != parts[None, :]) & ((parts == major)[None, :] | (place[None, :] > i))
            take &= (own == np.uint64(1 << bit)) | ((own == 0) & (bit == 0))
            if segment:
                take &= np.bitwise_count(other) > 1
            for earlier in range(byte):
                take &= ((other >> np.uint64(8 * earlier)) & np.uint64(255)) != 0
            take &= np.minimum(sizes[i], sizes[None, :]) >= similarity * np.maximum(sizes[i], sizes[None, :]) - 1e-6
            a, b = np.nonzero(take)
            a = i[a, 0]
            far = np.abs(a - b)
            now = (far >= low) & (far < high)
            if (far >= high).any():
                yield nodes[:1], None
            yield nodes[a[now]], nodes[b[now]]

    def run(frames):
        for rows, starts, ends in _whole_buckets(frames, BUCKET):
            where, parts = rows[BUCKET].to_numpy(), rows.component.to_numpy()
            mixed = np.minimum.reduceat(parts[: ends[-1]], starts) != np.maximum.reduceat(parts[: ends[-1]], starts)
            fps, nodes, sizes = rows.fp.to_numpy().view(np.uint64), rows.node.to_numpy(), rows["size"].to_numpy()
            for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
                if hot_bucket and e - s > hot_bucket:
                    yield rows.iloc[s:e][["family", "key", "fp", "node", "size", "component"]].assign(src=None, dst=None)[APART_COLUMNS]
                    continue
                for src, dst in pairs(int(where[s, 1]), int(where[s, 2]), fps[s:e], nodes[s:e], sizes[s:e], parts[s:e]):
                    if len(src):
                        found = pd.DataFrame({"src": src, "dst": pd.array([None] * len(src) if dst is None else dst, "Int64")})
                        yield found.reindex(columns=APART_COLUMNS)

    return run


#: A bucket of the rounds: family, key, and for hot keys a byte of the other segment and its value.
BUCKET = ["family", "key", "byte", "value"]
#: Places apart that the first round of open pairs covers; each later round covers as many times more.
REACH = 8


#: Rows of a round: pairs, or a src alone where pairs further apart are left, or rows of hot buckets.
APART = "src bigint, dst bigint, family int, key bigint, fp bigint, node bigint, size bigint, component bigint"
APART_COLUMNS = [f.split()[0] for f in APART.split(", ")]


def _open_pairs(members: DataFrame, low: int, high: int, similarity: float) -> DataFrame:
    """src, dst: what _apart gives for members (family, fp, node, size, component).

    Members are dealt to their buckets with their component at hand, so the rows of buckets meet no other table.
    """

    def taken(dealt: DataFrame, hot_bucket: int | None) -> DataFrame:
        rows = dealt.select(*BUCKET, "fp", "node", "size", "component").repartition(*BUCKET).sortWithinPartitions(*BUCKET, "fp", "node")
        return cut(rows.mapInPandas(_apart(low, high, similarity, hot_bucket), APART))

    found = taken(_variants(members, "node", "size", "component").withColumns({"byte": F.lit(-1).cast("bigint"), "value": F.lit(0).cast("bigint")}), HOT_BUCKET)
    hot = found.filter("key is not null")
    if hot.limit(1).count():
        byte = F.explode(F.expr("sequence(0L, 3L)")).alias("byte")
        dealt = hot.select("family", "key", "fp", "node", "size", "component", _other().alias("other"), byte)
        found = found.filter("key is null").unionByName(taken(dealt.withColumn("value", F.expr("shiftrightunsigned(other, cast(byte * 8 as int)) & 255")), None))
    return found.select("src", "dst")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """src, dst: links of doc_ids whose five-word shingle sets are similar, found by SimHash.

    Candidates are all pairs within MAX_BITS in one of several fingerprints of a text. The
    links join the same components as all candidates that are similar: texts of equal words
    are linked outright, a few links a fingerprint are verified on whole texts first, then
    open pairs are dealt and verified in rounds until none is left that could join two
    components. Rows without a doc_id are left out. A doc_id with several texts is one
    document, which links where any of its texts does.
    """
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")
    marks = cut(_families(texts))
    names = [f"f{i}" for i in range(FAMILIES)]
    first = marks.groupBy("digest").agg(F.min(F.struct("doc_id", *names)).alias("first"))
    equal = marks.select("digest", "doc_id").join(first.select("digest", F.col("first.doc_id").alias("src")), "digest").filter("doc_id <> src").select("src", F.col("doc_id").alias("dst"))
    reps = cut(first.select("first.*"))
    own = reps.select("doc_id", F.posexplode(F.array(*names)).alias("family", "fp"))
    classes = cut(own.groupBy("family", "fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    links = near_links(classes.select("family", "fp"), within=_stars)
    one = classes.select("family", F.col("fp").alias("src"), F.col("least").alias("a"), F.col("n").alias("n1"))
    two = classes.select("family", F.col("fp").alias("dst"), F.col("least").alias("b"), F.col("n").alias("n2"))
    across = links.join(one, ["family", "src"]).join(two, ["family", "dst"]).select("family", "a", "b", "src", "dst", F.expr("src = dst or n1 > 1 or n2 > 1").alias("open"))
    same = own.join(classes.filter("n > 1"), ["family", "fp"]).filter("doc_id <> least").select("family", F.col("least").alias("a"), F.col("doc_id").alias("b"), F.col("fp").alias("src"), F.col("fp").alias("dst"), (F.col("n") > 2).alias("open"))
    found = cut(across.unionByName(same))
    both = found.filter("a <> b").select("a", "b")
    open_fps = found.filter("open").select("family", F.explode(F.array("src", "dst")).alias("fp")).distinct()
    members = cut(own.join(open_fps, ["family", "fp"], "left_semi").select("family", "fp", F.col("doc_id").alias("node")))
    del links, one, two, across, same
    release(texts.sparkSession)
    both = cut(both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    ids = both.select(F.col("src").alias("doc_id")).unionByName(both.select(F.col("dst").alias("doc_id"))).unionByName(members.select(F.col("node").alias("doc_id"))).distinct()
    sets = cut(_shingle_sets(texts.join(ids, "doc_id", "left_semi").select("doc_id", "text")))
    left = sets.select(F.col("doc_id").alias("src"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("dst"), F.col("shingles").alias("right"))

    def verified(candidates: DataFrame) -> DataFrame:
        both = candidates.join(left, "src").join(right, "dst").select("src", "dst", "left", "right")
        return cut(both.mapInPandas(_similar(similarity), "src bigint, dst bigint"))

    links = verified(both)
    if members.limit(1).count():
        sizes = sets.select(F.col("doc_id").alias("node"), (F.octet_length("shingles") / 4).cast("bigint").alias("size"))
        parts = cut(connected_components(links))
        members = cut(members.join(sizes, "node"))
        low, high = 1, REACH
        while True:
            release(texts.sparkSession)
            rows = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
            left_apart = _open_pairs(rows, low, high, similarity)
            fresh = left_apart.filter("dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
            links = links.unionByName(verified(fresh))
            if not left_apart.filter("dst is null").limit(1).count():
                break
            del rows, left_apart, fresh
            parts = cut(connected_components(links))
            low, high = high, high * REACH
    return links.unionByName(equal)


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document, that of the least doc_id, of each group of near copies.

    Rows with a null doc_id stay; the rows of a repeated doc_id stay or go together.
    Null and empty texts are near copies of each other. Other columns come back unchanged.
    """
    groups = connected_components(near_copies(docs, similarity))
    gone = groups.filter("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
