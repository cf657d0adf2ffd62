"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokenising is one pass over the texts and leaves small rows (piece, length, crc).
Packing then is bulk-synchronous best-fit decreasing over those rows. A round

1. deals items and open gaps together into ranges of size and sorts them, largest
   first, gaps before items; the ranges come from a histogram of sizes, and a size
   that very many rows have is split over several,
2. sweeps each range: an item takes the smallest free gap at least as large (its
   successor), and what is left of the gap stays free for later items,
3. resolves what the sweeps left over across ranges: every range reports a few
   counts, and its leftover items get, by rank, the tightest runs of leftover gaps,
4. updates the gaps, opens sequences where nothing fitted, and starts over.

The driver sees a histogram of sizes and a few numbers per range, never items or gaps.
"""

from __future__ import annotations

import bisect
import itertools
import json
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.words import CHECK, CHUNK_BYTES, chunked, span_hashes
from gridloom.session import cut

CAPACITY = 4096
EOS_ID = 1
#: Words whose ids a task keeps; about 20 MB.
KNOWN_WORDS = 500_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
ROWS_PER_SPAN = 200
MAX_SPANS = 20_000
#: Rows of a few bytes that one task of a round holds.
ROWS_PER_TASK = 500_000
ROUND_SHARE = 0.94
LAST_SHARE = 0.004
SWEPT = "span int, role string, id bigint, size int, seq bigint, off int, room int, idx bigint"


def byte_spelling() -> dict[int, str]:
    """How a byte-level vocabulary spells each Latin-1 character.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    byte = {b: chr(b if b in plain else next(rest)) for b in range(256)}
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(256)}


# The rules of the tokenizers whose texts can be encoded word by word.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

SPACE, LETTER, DIGIT, OTHER = range(4)


def _kind(c: int) -> int:
    if chr(c) in "\t\n\v\f\r \x85\xa0":
        return SPACE
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER)


_KIND = np.array([_kind(c) for c in range(256)], dtype=np.uint8)
_LOWER = np.array([ord(chr(c).lower()) for c in range(256)], dtype=np.uint8)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts and ends of the words that SPLIT finds in lower-case Latin-1 bytes that end in a space."""
    data = np.append(data, np.full(2, ord(" "), dtype=np.uint8))  # every quote has three bytes after it
    kind = _KIND[data]
    before = np.append(SPACE, kind[:-1])
    start = (kind == DIGIT) | ((kind != SPACE) & (kind != before))
    quotes = np.flatnonzero((data == ord("'")) & start)
    if len(quotes):  # a quote that starts a word takes the ending of a contraction with it
        one, two = data[quotes + 1], data[quotes + 2]
        short, long = np.zeros(len(quotes), dtype=bool), np.zeros(len(quotes), dtype=bool)
        for c in SHORT:
            short |= one == ord(c)
        for a, b in LONG:
            long |= (one == ord(a)) & (two == ord(b))
        for at, size in ((quotes[short], 2), (quotes[long], 3)):
            start[at + 1] = False
            start[at + size] |= kind[at + size] == LETTER
    bounds = np.flatnonzero(start | (kind == SPACE))
    firsts = np.flatnonzero(start[bounds])
    return bounds[firsts], bounds[firsts + 1]


class KnownWords:
    """Token ids of words under two 64-bit hashes of each, in sorted arrays; about 40 bytes a word."""

    def __init__(self):
        self.key, self.check, self.begin = (np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64))
        self.count, self.ids = np.zeros(0, dtype=np.int32), np.zeros(0, dtype="<u4")

    def __len__(self) -> int:
        return len(self.key)

    def missing(self, key: np.ndarray) -> np.ndarray:
        """Places in key (ascending) of words that are not known."""
        at = np.searchsorted(self.key, key)
        inside = at < len(self.key)
        inside[inside] = self.key[at[inside]] == key[inside]
        return np.flatnonzero(~inside)

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[bytes]) -> None:
        """Take up words that are not known yet; key is ascending."""
        at, count = np.searchsorted(self.key, key), np.array([len(x) // 4 for x in ids], dtype=np.int32)
        begin = len(self.ids) + np.cumsum(count, dtype=np.int64) - count
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), dtype="<u4")])
        for name, values in (("key", key), ("check", check), ("begin", begin), ("count", count)):
            setattr(self, name, np.insert(getattr(self, name), at, values))


class WordEncoder:
    """Token ids of texts, as little-endian 32-bit arrays, with the ids of known words kept.

    Tokenizers of the rules above lower-case, split into words and encode each word alone.
    So the ids of a text in Latin-1 are those of its words in order, and the model is asked
    for unknown words only. Words are found and told apart by numpy over many texts at
    once, by 128 bits of hashes. Other texts, those that hold special tokens, and all texts
    of other tokenizers are encoded whole. Dropping the known words changes speed only.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = KnownWords()
        self.spelling = byte_spelling()
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        rules = json.loads(self.tokenizer.to_str())
        parts = {"normalizer": {"type": "Sequence", "normalizers": NORMALIZERS}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, BYTES]}}
        self.by_words = rules["model"]["type"] == "BPE" and all(rules[name] == part for name, part in parts.items())

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("latin-1")
        if not (text.isascii() and text.isprintable()):
            text = text.translate(self.spelling)
        return b"".join([self.raw[t.id] for t in self.tokenizer.model.tokenize(text)])

    def _plain(self, text: str) -> bytes | None:
        """The text in Latin-1 if its words can be encoded alone."""
        if not self.by_words or any(s in text for s in self.special):
            return None
        try:
            return text.encode("latin-1")
        except UnicodeEncodeError:
            return None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _by_words(self, texts: list[bytes]) -> list[np.ndarray] | None:
        """Ids of each text; None if two different words share the first hash."""
        data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
        starts, ends = word_spans(data)
        first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        check = span_hashes(data, starts, ends, CHECK)
        key, example, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        known = self.known
        new = known.missing(key)
        if len(new):
            lower = data.tobytes()
            words = [lower[a:b] for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)]
            known.add(key[new], check[example[new]], list(map(self._ids, words)))
        at = np.searchsorted(known.key, key)[which]
        if (known.check[at] != check).any():
            return None
        count = known.count[at].astype(np.int64)
        total = np.append(0, np.cumsum(count))
        out = known.ids[np.arange(total[-1]) + np.repeat(known.begin[at] - total[:-1], count)]
        return [out[a:b] for a, b in itertools.pairwise(total[first].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > KNOWN_WORDS:
            self.known = KnownWords()
        plain = [self._plain(t) for t in texts]
        done = self._by_words([t for t in plain if t is not None])
        if done is None:
            return [self._whole(t) for t in texts]
        rest = iter(done)
        return [self._whole(t) if p is None else next(rest) for t, p in zip(texts, plain, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eos_id: int = EOS_ID) -> DataFrame:
    """doc_id, piece, start, length and the ids' crc32 of every piece of every document.

    A document is its token ids and then eos_id; a null text is empty. Documents over
    the capacity are cut into pieces of exactly the capacity, the last may be shorter.
    """
    end = int(eos_id).to_bytes(4, "little")

    def run(batches):
        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, WordEncoder(tokenizer_path))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunked(texts, CHUNK_BYTES):
                for doc, ids in zip(docs[a:b], encoder.encode(texts[a:b]), strict=True):
                    ids = ids.tobytes() + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def _sweep(capacity: int):
    """Best fit within each size range; rows come range by range, largest first, gaps before items."""

    def run(frames):
        sizes: list[int] = []  # the different sizes of free gaps, ascending
        free: dict[int, list[int]] = {}
        rows: list[tuple] = []
        left: list[tuple[int, int]] = []
        now = None

        def push(size: int, seq: int) -> None:
            if size not in free:
                bisect.insort(sizes, size)
                free[size] = []
            free[size].append(seq)

        def close() -> None:
            rows.extend((now, "item", ident, size, None, None, None, i) for i, (ident, size) in enumerate(left))
            at: dict[int, int] = {}
            for size in reversed(sizes):
                room = _room_class(size)
                for seq in free[size]:
                    rows.append((now, "gap", seq, size, None, None, room, at.get(room, 0)))
                    at[room] = at.get(room, 0) + 1
            sizes.clear(), free.clear(), left.clear()

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["span", "role", "id", "size", "seq", "off", "room", "idx"], dtype=object)
            rows.clear()
            return out.astype({"id": "int64", "seq": "Int64", "off": "Int32", "room": "Int32", "idx": "Int64"})

        for pdf in frames:
            for span, is_item, ident, size in zip(pdf.span.tolist(), pdf.is_item.tolist(), pdf.id.tolist(), pdf["size"].tolist(), strict=True):
                if span != now:
                    close()
                    now = span
                if not is_item:
                    push(size, ident)
                    continue
                at = bisect.bisect_left(sizes, size)
                if at == len(sizes):
                    left.append((ident, size))
                    continue
                gap = sizes[at]
                seq = free[gap].pop()
                if not free[gap]:
                    del free[gap]
                    del sizes[at]
                rows.append((now, "placed", ident, size, seq, capacity - gap, None, None))
                if gap > size:
                    push(gap - size, seq)
            if rows:
                yield frame()
        close()
        if rows:
            yield frame()

    return run


def _room_class(size: int) -> int:
    """Gaps whose sizes lie within an eighth of each other share a class."""
    k = max(0, size.bit_length() - 4)
    return (k << 4) + (size >> k)


def _resolve(items: list[tuple], gaps: list[tuple]) -> list[tuple]:
    """Which leftover items get which leftover gaps: best fit over runs, not rows.

    items: (span, count, largest); gaps: (span, room class, count, least size). Ranges
    with larger items go first; each takes the run of gaps with the least room that
    holds its largest item. A gap takes one item fewer than it could, so that its last
    one is chosen by an exact sweep of a later round. A segment (span, i0, i1, gap_span,
    room, top, fit) sends item i to gap top - (i - i0) // fit.
    """
    runs = sorted((least, span, room, 0, count) for span, room, count, least in gaps)
    segments: list[tuple] = []
    for span, count, largest in sorted(items, key=lambda r: (-r[2], r[0])):
        done = 0
        while done < count:
            at = bisect.bisect_left(runs, (largest,))
            if at == len(runs):
                break
            size, owner, room, low, high = runs.pop(at)
            fit = max(1, size // largest - 1)
            bins = min(high - low, -(-(count - done) // fit))
            upto = min(count, done + bins * fit)
            segments.append((span, done, upto, owner, room, high - 1, fit))
            done = upto
            if bins < high - low:
                bisect.insort(runs, (size, owner, room, low, high - bins))
    return segments


def _spans(hist: dict[int, int], rows_per_span: int) -> list[tuple[int, int, int]]:
    """(size, first span, spans): ranges of about equal rows, larger sizes first; a frequent size is split."""
    out, span, room = [], 0, rows_per_span
    for size in sorted(hist, reverse=True):
        parts = -(-hist[size] // rows_per_span)
        if parts > 1:
            span += room < rows_per_span
            out.append((size, span, parts))
            span, room = span + parts, rows_per_span
            continue
        if room < hist[size]:
            span, room = span + 1, rows_per_span
        out.append((size, span, 1))
        room -= hist[size]
    return out


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """id, seq and off for items (id bigint, size int; 0 < size < capacity) by bulk-synchronous best fit."""
    spark = items.sparkSession
    state = items.select(F.lit(True).alias("is_item"), "id", "size")
    placements: list[DataFrame] = []
    opened, placed, mass = 0, None, None
    while True:
        # at most two rows a size, so the capacity bounds it
        hist = state.groupBy("is_item", "size").count().collect()
        todo = {r["size"]: r["count"] for r in hist if r.is_item}
        n = sum(todo.values())
        if not n:
            break
        left = sum(s * c for s, c in todo.items())
        mass = mass or left
        # small items fill what larger ones leave, so they wait while the rest is placed
        least = min(todo) if left < LAST_SHARE * mass else _waiting(todo, left)
        due = sum(c for s, c in todo.items() if s >= least)
        gaps = {r["size"]: r["count"] for r in hist if not r.is_item and r["size"] >= min(todo)}
        # what fits nowhere needs new sequences, and so does the rest where rounds place little
        stuck = placed is not None and placed * 20 < due
        homeless = {s: c for s, c in todo.items() if stuck or s > max(gaps, default=0)}
        new = max(-(-sum(s * c for s, c in homeless.items()) // capacity), sum(c for s, c in homeless.items() if 2 * s > capacity))
        rows = spark.range(opened, opened + new).select(F.lit(False).alias("is_item"), "id", F.lit(capacity).alias("size"))
        opened += new
        gaps[capacity] = gaps.get(capacity, 0) + new
        both = {s: (todo.get(s, 0) if s >= least else 0) + gaps.get(s, 0) for s in {*todo, *gaps}}
        both = {s: c for s, c in both.items() if c}
        total = sum(both.values())
        ranges = spark.createDataFrame(_spans(both, max(ROWS_PER_SPAN, total // MAX_SPANS)), "size int, first int, spans int")
        waiting = state.filter(F.col("is_item") & (F.col("size") < least))
        held = n - due
        pool = state.filter(F.col("size") >= F.when(F.col("is_item"), least).otherwise(min(todo))).unionByName(rows).join(F.broadcast(ranges), "size")
        pool = pool.withColumn("span", (F.col("first") + F.pmod(F.xxhash64("id", "is_item"), F.col("spans"))).cast("int")).select("span", "is_item", "id", "size")
        order = [F.col("span"), F.col("size").desc(), F.col("is_item"), F.col("id")]
        swept = pool.repartition("span").sortWithinPartitions(*order).mapInPandas(_sweep(capacity), SWEPT)
        swept = cut(swept.coalesce(max(1, -(-total // ROWS_PER_TASK))))
        counts = swept.groupBy("role", F.when(F.col("role") != "placed", F.col("span")).alias("span"), "room").agg(F.count("*").alias("n"), F.max("size").alias("most"), F.min("size").alias("least")).collect()
        segments = _resolve([(r.span, r.n, r.most) for r in counts if r.role == "item"], [(r.span, r.room, r.n, r.least) for r in counts if r.role == "gap"])
        placed = sum(r.n for r in counts if r.role == "placed") + sum(s[2] - s[1] for s in segments)
        held += sum(r.n for r in counts if r.role != "placed")
        after = _apply(swept, segments, waiting, capacity, max(1, -(-held // ROWS_PER_TASK)))
        state = after.filter("seq is null").select("is_item", "id", "size")
        placements += [swept.filter("role = 'placed'").select("id", "seq", "off"), after.filter("seq is not null").select("id", "seq", "off")]
    out = spark.createDataFrame([], "id bigint, seq bigint, off int")
    for p in placements:
        out = out.unionByName(p)
    return out


def _waiting(todo: dict[int, int], left: int) -> int:
    """The least size that takes part in a round; smaller ones hold 1 - ROUND_SHARE of the tokens."""
    seen = 0
    for size in sorted(todo, reverse=True):
        seen += size * todo[size]
        if seen >= ROUND_SHARE * left:
            return size
    return min(todo)


def _apply(swept: DataFrame, segments: list[tuple], waiting: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """is_item, id, size, seq, off: items placed across ranges (with seq), and the items and gaps that are left.

    Written in as many partitions as its rows need, so rounds over few rows make few files.
    """
    spark = swept.sparkSession
    items = swept.filter("role = 'item'").select("span", "id", "size", "idx")
    gaps = swept.filter("role = 'gap'").select("span", "id", "size", "room", "idx")
    # a few segments a range, and the number of ranges is bounded
    plan = F.broadcast(spark.createDataFrame(segments, "span int, i0 bigint, i1 bigint, gap_span int, room int, top bigint, fit int"))
    ends = F.broadcast(plan.groupBy("span").agg(F.max("i1").alias("upto")))
    sent = items.join(plan, "span").filter("idx >= i0 and idx < i1").select("span", "id", "size", "idx", "gap_span", "room", (F.col("top") - F.floor((F.col("idx") - F.col("i0")) / F.col("fit"))).cast("bigint").alias("gap_idx"))
    target = gaps.select(F.col("span").alias("gap_span"), "room", F.col("idx").alias("gap_idx"), F.col("id").alias("seq"), F.col("size").alias("free"))
    before = Window.partitionBy("seq").orderBy(F.col("size").desc(), "span", "idx").rowsBetween(Window.unboundedPreceding, -1)
    met = sent.join(target, ["gap_span", "room", "gap_idx"])
    across = met.select(F.lit(True).alias("is_item"), "id", "size", "seq", (F.lit(capacity) - F.col("free") + F.coalesce(F.sum("size").over(before), F.lit(0))).cast("int").alias("off"))
    used = met.groupBy(F.col("seq").alias("id")).agg(F.sum("size").alias("used"))
    open_ = [F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("int").alias("off")]
    todo = items.join(ends, "span", "left").filter("upto is null or idx >= upto").select(F.lit(True).alias("is_item"), "id", "size", *open_)
    gaps = gaps.join(used, "id", "left").select(F.lit(False).alias("is_item"), "id", (F.col("size") - F.coalesce("used", F.lit(0))).cast("int").alias("size"), *open_).filter("size > 0")
    return cut(across.unionByName(todo).unionByName(gaps).unionByName(waiting.select("is_item", "id", "size", *open_)).coalesce(tasks))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eos_id: int = EOS_ID) -> DataFrame:
    """Every piece of docs with the sequence that holds it and its place there.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts
    are one eos token. Repeated rows are packed as often as they occur; ties in length
    fall in any order. Other columns are ignored; an empty table gives an empty result.
    """
    uid = F.monotonically_increasing_id()
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, eos_id).withColumn("id", uid))
    part = F.col("length") < capacity
    spots = place(pieces.filter(part).select("id", F.col("length").cast("int").alias("size")), capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.filter(~part).select(*columns, (-1 - F.col("id")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pieces.filter(part).join(spots, "id").select(*columns, F.col("seq").alias("sequence_id"), F.col("off").cast("bigint").alias("offset"))
    return whole.unionByName(rest)
