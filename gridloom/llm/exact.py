"""Exact deduplication with a sharded cuckoo-filter index of live digests.

Rows are reduced to one (digest, count, largest id) per digest before anything is
shuffled by digest, so a digest that a third of all rows share costs one row per
map task. The index is a DataFrame with one row per shard: the cuckoo filter and,
beside it, the bucketed content (digest, count, keep id) that verifies its hits.
A batch is inserted or deleted by a cogroup of the shards with the batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import cut

SLOTS = 4
MAX_KICKS = 256
LIVE_DIGESTS_PER_SHARD = 50_000
#: A keeper that is not known, and the rank of a null doc_id.
UNKNOWN = -(2**63)
LOWEST = UNKNOWN + 1
STATE = "shard int, n_buckets int, slots binary, digests binary, counts array<bigint>, keep_ids array<bigint>"


class CuckooFilter:
    """Partial-key cuckoo filter of 16-bit fingerprints, four slots a bucket.

    A digest's bytes 0-7 give its first bucket, bytes 8-9 its fingerprint. insert()
    returns False when the kick chain overflows; the owner then rebuilds a larger
    filter from its stored keys.
    """

    def __init__(self, n_buckets: int, slots: bytes | None = None):
        self.n = n_buckets
        self.slots = list(np.frombuffer(slots, dtype="<u2")) if slots else [0] * (n_buckets * SLOTS)

    @staticmethod
    def for_keys(n_keys: int) -> int:
        """Buckets, a power of two, that hold n_keys at a load of 0.85 at most."""
        return 1 << max(3, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.85)))))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def contains(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.slots[a * SLOTS : a * SLOTS + SLOTS] or mark in self.slots[b * SLOTS : b * SLOTS + SLOTS]

    def _put(self, bucket: int, mark: int) -> bool:
        for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[k]:
                self.slots[k] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        if self._put(a, mark) or self._put(b, mark):
            return True
        bucket = b
        for kick in range(MAX_KICKS):
            k = bucket * SLOTS + kick % SLOTS
            mark, self.slots[k] = self.slots[k], mark
            bucket = self._other(bucket, int(mark))
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[k] == mark:
                    self.slots[k] = 0
                    return True
        return False

    def dump(self) -> bytes:
        return np.array(self.slots, dtype="<u2").tobytes()


class Shard:
    """One shard in memory: the filter and the content that verifies its hits."""

    def __init__(self, row=None, expected: int = 0):
        self.content: dict[bytes, list[int]] = {}
        if row is not None:
            raw = bytes(row.digests)
            for i, (n, keep) in enumerate(zip(row.counts, row.keep_ids, strict=True)):
                self.content[raw[32 * i : 32 * i + 32]] = [int(n), int(keep)]
            self.filter = CuckooFilter(int(row.n_buckets), bytes(row.slots))
        else:
            self.filter = CuckooFilter(CuckooFilter.for_keys(expected))

    def insert(self, digest: bytes, n: int, keep: int) -> None:
        if self.filter.contains(digest) and (known := self.content.get(digest)):
            known[0] += n
            known[1] = max(known[1], keep)
            return
        self.content[digest] = [n, keep]
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: bytes, n: int, keep: int) -> None:
        """Take n rows away, keep being the largest doc_id among them; the keeper of what is left may be unknown then."""
        if self.filter.contains(digest) and (known := self.content.get(digest)):
            known[0] -= n
            if keep >= known[1]:
                known[1] = UNKNOWN
            if known[0] <= 0:
                del self.content[digest]
                self.filter.delete(digest)

    def _resize(self) -> None:
        buckets = self.filter.n
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(d) for d in self.content):
                return

    def frame(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "shard": [shard],
                "n_buckets": [self.filter.n],
                "slots": [self.filter.dump()],
                "digests": [b"".join(self.content)],
                "counts": [[n for n, _ in self.content.values()]],
                "keep_ids": [[k for _, k in self.content.values()]],
            }
        )


def _update(change: str):
    def fn(key, state: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(state.iloc[0] if len(state) else None, len(batch))
        for digest, n, keep in zip(batch.digest, batch.n, batch.keep_id, strict=True):
            if change == "insert":
                shard.insert(bytes(digest), int(n), int(keep))
            else:
                shard.delete(bytes(digest), int(n), int(keep))
        return shard.frame(int(key[0]))

    return fn


class CuckooIndex:
    """Index of live digests, a DataFrame of shards.

    insert() and delete() take rows of (digest binary(32), n, keep_id), as many a digest
    as there are, and return a new index: a row whose digest the filter knows is looked
    up in the content and merged there, any other enters both. Where the keeper itself is
    deleted, delete() looks the next one up in the rows that are left. entries() gives the
    live content. may_contain() is the filter's answer without it: no false negatives.
    """

    def __init__(self, spark: SparkSession, shards: int, state: DataFrame | None = None):
        self.spark, self.shards = spark, shards
        self.state = spark.createDataFrame([], STATE) if state is None else state

    def _sharded(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int"))

    def _changed(self, batch: DataFrame, change: str) -> CuckooIndex:
        rows = self._sharded(batch).select("shard", "digest", "n", "keep_id")
        state = self.state.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(_update(change), STATE)
        return CuckooIndex(self.spark, self.shards, state)

    def insert(self, batch: DataFrame) -> CuckooIndex:
        return self._changed(batch, "insert")

    def delete(self, batch: DataFrame, left: DataFrame | None = None) -> CuckooIndex:
        """left: rows of the digests that are still live after the deletion."""
        index = CuckooIndex(self.spark, self.shards, cut(self._changed(batch, "delete").state))
        if left is None:
            return index
        open_ = index.entries().filter(F.col("keep_id") == UNKNOWN).select("digest")
        found = left.join(open_, "digest", "left_semi").groupBy("digest").agg(F.lit(0).cast("bigint").alias("n"), F.max("keep_id").alias("keep_id"))
        return index.insert(found)

    def entries(self) -> DataFrame:
        """digest, n, keep_id of every live digest."""

        def unpack(frames):
            for pdf in frames:
                for row in pdf.itertuples(index=False):
                    raw = bytes(row.digests)
                    yield pd.DataFrame({"digest": [raw[i : i + 32] for i in range(0, len(raw), 32)], "n": row.counts, "keep_id": row.keep_ids})

        return self.state.mapInPandas(unpack, "digest binary, n bigint, keep_id bigint")

    def may_contain(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (with a column digest) that the filter doesn't rule out."""
        schema = ", ".join(f"`{n}` {t}" for n, t in keys.dtypes)

        def probe(key, state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop(columns="shard")
            if not len(state):
                return rows.iloc[:0]
            cuckoo = CuckooFilter(int(state.n_buckets[0]), bytes(state.slots[0]))
            return rows[[cuckoo.contains(bytes(d)) for d in rows.digest]]

        slim = self.state.select("shard", "n_buckets", "slots")
        return slim.groupBy("shard").cogroup(self._sharded(keys).groupBy("shard")).applyInPandas(probe, schema)


def digest_of(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, null as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digest_rows(docs: DataFrame) -> DataFrame:
    """digest, n and keep_id (the largest doc_id; null ids rank lowest), once per text and Arrow batch.

    Copies are counted together before anything is shuffled, so a text that a third of all
    rows repeat comes to its shard once a batch.
    """

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by("digest").aggregate([("doc_id", "count"), ("doc_id", "max")])
            yield from table.select(["digest", "doc_id_count", "doc_id_max"]).rename_columns(["digest", "n", "keep_id"]).to_batches()

    rows = docs.select(digest_of(F.col("text")).alias("digest"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("doc_id"))
    return rows.mapInArrow(run, "digest binary, n bigint, keep_id bigint")


def build_index(docs: DataFrame, digests_per_shard: int = LIVE_DIGESTS_PER_SHARD) -> CuckooIndex:
    """Index of all live digests of docs; shards are sized as if all texts were different."""
    return CuckooIndex(docs.sparkSession, max(1, -(-docs.count() // digests_per_shard))).insert(digest_rows(docs))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of docs with its group of equal texts.

    Adds keep_id, group_size, kept and text_sha256 to doc_id. Null texts equal the
    empty text. Of equal texts the row with the largest doc_id is kept; of repeated
    rows with that doc_id, exactly one. A null doc_id ranks below all others. Other
    columns of docs are not used. An empty table gives an empty result.
    """
    from pyspark.sql import Window

    entries = build_index(docs).entries()
    lowest = F.lit(LOWEST).cast("bigint")
    rows = docs.select("doc_id", digest_of(F.col("text")).alias("digest"))
    twin = Window.partitionBy("doc_id", "digest").orderBy(F.lit(0))
    rows = rows.withColumn("_twin", F.row_number().over(twin))
    joined = rows.join(entries, "digest")
    return joined.select(
        "doc_id",
        F.when(F.col("keep_id") != lowest, F.col("keep_id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.coalesce("doc_id", lowest) == F.col("keep_id")) & (F.col("_twin") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, that with the largest doc_id.

    Only doc_ids and digests are shuffled; texts meet the decision in one join.
    Repeated rows of a kept doc_id and text collapse to one.
    """
    from pyspark.sql import Window

    keep = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("keep_id"), F.unhex("text_sha256").alias("keep_digest"))
    # the row travels whole, so that none of its names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col("row.doc_id").alias("id"), digest_of(F.col("row.text")).alias("digest"))
    one = Window.partitionBy("id", "digest").orderBy(F.lit(0))
    found = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest")), "left_semi")
    return found.withColumn("place", F.row_number().over(one)).filter("place = 1").select("row.*")
