"""SentencePiece encoding that keeps, for every piece, the bytes of the text it came from.

A text is normalised here, not in the library: at every place the longest prefix that the
model's compiled character map holds is replaced, anything else is copied a character at a
time, and every normalised byte records the source byte at which its unit starts. White
space is then collapsed, escaped and prefixed as the model says, with the records carried
along. Pieces are runs of normalised bytes, so their ends name source spans at once.

Merging is left to the library, on normalised text. Where no piece of the vocabulary
crosses the start of a word, words are encoded once each and told apart by 128 bits of
hashes, as in the packing operator; otherwise texts are encoded whole.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.packing import KNOWN_WORDS, KnownWords
from gridloom.llm.words import CHECK, CHUNK_BYTES, chunked, span_hashes, texts_of

ESCAPED = "▁".encode()
TOKENS = "doc_id bigint, ids array<int>, begins array<int>, ends array<int>"


class CharMap:
    """A compiled character map: a double-array trie of keys, then their replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return unit >> 10 << (unit >> 6 & 8)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes and replacement of the longest key that text holds at a place."""
        node, found = self._jump(self.units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != text[i]:
                break
            leaf, node = self.units[node] >> 8 & 1, node ^ self._jump(self.units[node])
            if leaf:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return found and (found[0], self.texts[found[1] : self.texts.index(0, found[1])])

    def first_bytes(self) -> bytes:
        """The bytes that keys start with."""
        root = self._jump(self.units[0])
        return bytes(b for b in range(1, 256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b)


@dataclass
class Normalizer:
    """The model's rules for text before pieces are sought.

    keep: texts that stay as they are wherever they occur (symbols that users defined).
    """

    charmap: CharMap | None = None
    keep: tuple[bytes, ...] = ()
    collapse: bool = True
    prefix: bool = True
    suffix: bool = False
    escape: bool = True

    def __post_init__(self):
        starts = {k[:1] for k in self.keep} | {bytes([b]) for b in (self.charmap.first_bytes() if self.charmap else b"")}
        self.may_start = re.compile(b"[" + b"".join(map(re.escape, sorted(starts))) + b"]") if starts else None
        self.kept = re.compile(b"|".join(map(re.escape, sorted(self.keep, key=len, reverse=True)))) if self.keep else None

    def _replaced(self, text: bytes):
        """(from, to, replacement) of the units that aren't single copied characters."""
        at = 0
        while self.may_start and (start := self.may_start.search(text, at)):
            at = start.start()
            if self.kept and (same := self.kept.match(text, at)):
                yield at, same.end(), same.group()
                at = same.end()
            elif self.charmap and (hit := self.charmap.longest(text, at)):
                yield at, at + hit[0], hit[1]
                at += hit[0]
            else:
                at += 1

    def _units(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Bytes after replacement, the source byte of each one's unit, whether it starts a unit, and where units vanish."""
        data = np.frombuffer(text, dtype=np.uint8)
        head = (data & 0xC0) != 0x80
        source = np.maximum.accumulate(np.where(head, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        gone, done = [], 0
        for a, b, new in self._replaced(text):
            if a > done:
                parts.append((data[done:a], source[done:a], head[done:a]))
            parts.append((np.frombuffer(new, dtype=np.uint8), np.full(len(new), a), np.arange(len(new)) == 0))
            if not new:
                gone.append(a)
            done = b
        if not parts:
            return data, source, head, gone
        parts.append((data[done:], source[done:], head[done:]))
        return *(np.concatenate(x) for x in zip(*parts, strict=True)), gone

    def normalise(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes, and for each and for the end the source byte where its unit starts."""
        out, source, head, gone = self._units(text)
        space, begin, end = out == 32, 0, len(text)
        if self.collapse:
            blank = space & head & np.append(head[1:], True)
            solid = np.flatnonzero(~blank)
            firsts = [*source[solid[:1]].tolist(), *gone[:1]]
            if not firsts:
                return out[:0], np.zeros(1, dtype=np.int64)
            begin = min(firsts)
            unit = np.maximum.accumulate(np.where(head, np.arange(len(out)), 0)) if len(out) else source
            after_space = np.append(True, space)[unit]  # what stands before the unit, or the start
            filled = np.cumsum(~space)
            leading = space & (filled == (filled - ~space)[unit]) if len(out) else space
            keep = ~(leading & after_space)
            out, source, space = out[keep], source[keep], space[keep]
        elif not text:
            return out, np.zeros(1, dtype=np.int64)
        mark = np.frombuffer(ESCAPED if self.escape else b" ", dtype=np.uint8)
        if self.escape and space.any():
            times = np.where(space, 3, 1)
            at = np.cumsum(times) - times
            out, source, where = np.repeat(out, times), np.repeat(source, times), at[space]
            for k in range(3):
                out[where + k] = mark[k]
        if self.prefix and not self.suffix:
            out, source = np.concatenate([mark, out]), np.concatenate([np.full(len(mark), begin), source])
        if self.collapse:
            n, raw = len(out), out[-4096:].tobytes()
            while raw.endswith(mark.tobytes()):
                n, raw = n - len(mark), raw[: -len(mark)]
                end = int(source[n])
                raw = raw or out[max(0, n - 4096) : n].tobytes()
            out, source = out[:n], source[:n]
        if self.prefix and self.suffix:
            out, source = np.concatenate([out, mark]), np.concatenate([source, np.full(len(mark), end)])
        return out, np.append(source, end)


class PieceEncoder:
    """Ids and source spans of texts under a SentencePiece model."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        proto = ModelProto.FromString(model)
        rules, pieces = proto.normalizer_spec, proto.pieces
        kinds = type(pieces[0])
        user = tuple(p.piece.encode() for p in pieces if p.type == kinds.USER_DEFINED)
        charmap = CharMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.normalizer = Normalizer(charmap, user, rules.remove_extra_whitespaces, rules.add_dummy_prefix, proto.trainer_spec.treat_whitespace_as_suffix, rules.escape_whitespaces)
        self.size = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in pieces], dtype=np.int64)
        self.library = SentencePieceProcessor(model_proto=model)
        plain = ModelProto.FromString(model)
        plain.normalizer_spec.Clear()
        plain.normalizer_spec.name, plain.normalizer_spec.add_dummy_prefix, plain.normalizer_spec.remove_extra_whitespaces = "identity", False, False
        self.plain = SentencePieceProcessor(model_proto=plain.SerializeToString())
        trainer, mark = proto.trainer_spec, ESCAPED.decode()
        bytes_known = sum(p.type == kinds.BYTE for p in pieces) == 256
        inside = any(mark in p.piece.lstrip(mark) for p in pieces if p.type == kinds.NORMAL)
        self.by_words = trainer.model_type == trainer.BPE and trainer.byte_fallback and bytes_known and not user and not inside and rules.escape_whitespaces
        joined = {c for p in pieces if p.type == kinds.NORMAL and len(p.piece) > 1 for c in p.piece}
        #: ASCII characters that no longer piece holds are words of their own.
        self.alone = np.array([b < 128 and chr(b) not in joined for b in range(256)])
        self.known = KnownWords()

    def _word_starts(self, data: np.ndarray) -> np.ndarray:
        """Whether a byte starts a word: an escaped space after other text, or a character that stands alone or follows one."""
        starts, alone = np.zeros(len(data), dtype=bool), self.alone[data]
        mark = np.flatnonzero((data[:-2] == ESCAPED[0]) & (data[1:-1] == ESCAPED[1]) & (data[2:] == ESCAPED[2]))
        starts[mark] = True
        starts[mark[1:][np.diff(mark) == 3]] = False
        starts |= alone
        starts[1:] |= alone[:-1]
        return starts

    def _words(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        """Flat ids of all texts, and the ids up to each text; None if two different words share the first hash."""
        data = np.concatenate(texts)
        ends_of_texts = np.cumsum([len(t) for t in texts])
        starts = self._word_starts(data)
        starts[np.append(0, ends_of_texts[:-1])[np.diff(np.append(0, ends_of_texts)) > 0]] = True
        starts = np.flatnonzero(starts)
        ends = np.append(starts[1:], len(data))
        check = span_hashes(data, starts, ends, CHECK)
        key, example, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        known = self.known
        new = known.missing(key)
        if len(new):
            words = [data[a:b].tobytes().decode() for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)]
            known.add(key[new], check[example[new]], [np.array(ids, dtype="<u4").tobytes() for ids in self.plain.encode(words, num_threads=1)])
        at = np.searchsorted(known.key, key)[which]
        if (known.check[at] != check).any():
            return None
        count = known.count[at].astype(np.int64)
        total = np.append(0, np.cumsum(count))
        ids = known.ids[np.arange(total[-1]) + np.repeat(known.begin[at] - total[:-1], count)]
        return ids.astype(np.int64), total[np.searchsorted(starts, np.append(0, ends_of_texts))]

    def _whole(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, the ids up to each text, and normalised bytes of each piece, from the library's own pieces."""
        found = [self.plain.encode(t.tobytes().decode(), return_type="proto").pieces if len(t) else [] for t in texts]
        flat = [p for pieces in found for p in pieces]
        sizes = np.array([len(p.surface.encode()) for p in flat], dtype=np.int64)
        return np.array([p.id for p in flat], dtype=np.int64), np.cumsum([0, *map(len, found)]), sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends of the pieces of all texts, and the number of pieces up to each text."""
        if len(self.known) > KNOWN_WORDS:
            self.known = KnownWords()
        normal, sources = zip(*map(self.normalizer.normalise, texts), strict=True)
        done = self._words(list(normal)) if self.by_words and any(map(len, normal)) else None
        ids, upto, sizes = (*done, self.size[done[0]]) if done else self._whole(list(normal))
        # the records of a text have an entry more than its bytes, so those of the k-th text lie k further on
        text = np.repeat(np.arange(len(texts)), np.diff(upto))
        source, last = np.concatenate(sources), np.cumsum(sizes) + text
        return ids, source[last - sizes], source[last], upto


_encoders: dict[str, PieceEncoder] = {}


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _texts(library, ids: np.ndarray, upto: np.ndarray) -> list[str]:
    return [library.decode(ids[a:b].tolist()) if b > a else "" for a, b in itertools.pairwise(upto.tolist())]


def encode(docs: DataFrame, model_path: str, with_text: bool = False) -> DataFrame:
    """doc_id, ids, begins and ends of every row of docs: a piece i stands for text bytes begins[i] to ends[i].

    with_text adds decoded, the library's text of the ids, as decode does, without another
    pass of Python workers.

    Ids are those of the library without begin and end ids. Null and empty texts have no
    pieces. Rows that repeat a doc_id are encoded one by one; doc_id may be null. Texts
    may be of any length. Pieces of a character that is spelled in bytes are empty but for
    the last, which has the whole character. Other columns are ignored. model_path must
    name the model on every executor.
    """

    names = ["doc_id", "ids", "begins", "ends", *["decoded"] * with_text]

    def run(batches):
        encoder = _encoders.get(model_path) or _encoders.setdefault(model_path, PieceEncoder(_model(model_path)))
        for batch in batches:
            docs, texts = batch.column(0), texts_of(batch.column(1))
            for a, b in chunked(texts, CHUNK_BYTES):
                ids, begins, ends, upto = encoder.encode(texts[a:b])
                lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begins, ends)]
                back = [pa.array(_texts(encoder.library, ids, upto), pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), *lists, *back], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, TOKENS + ", decoded string" * with_text)


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """tokens with a column decoded: the library's text of each row's ids, empty for null.

    All other columns pass; an older column of this name goes. Ids must be of the model.
    """
    tokens = tokens.drop("decoded")
    column = tokens.columns.index("ids")

    def run(batches):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            ids = batch.column(column)
            upto = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()))
            texts = _texts(library, ids.flatten().to_numpy(), upto)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))


def tokens_and_text(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_hash (64 bits over begins and ends) of every row."""
    rows = encode(docs, model_path, with_text=True)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha(F.array_join("ids", ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"), F.xxhash64("begins", "ends").alias("spans_hash"))
