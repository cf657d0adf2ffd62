"""Words of many texts at once: spans and hashes by numpy over an Arrow buffer.

A word is a run of bytes other than space and 0x09-0x0D, as in `[^\\x20\\x09-\\x0D]+`
on the text. Hashes are polynomial in randomly mapped bytes, then mixed; they are the
same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
LANES = _rng.integers(1, 2**63, (2, 64), dtype=np.int64).astype(np.uint64) | np.uint64(1)
#: A second byte table, for hashes that check the first.
CHECK = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators for loose words: all ASCII but letters and digits.
LOOSE = np.ones(256, dtype=bool)
LOOSE[128:] = False
LOOSE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Bytes hashed at once, and the longest table of powers that is kept.
BLOCK = 1 << 18
#: Bytes of texts that operators hand to Words at once.
CHUNK_BYTES = 1 << 20


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    table = np.full(n, base, dtype=np.uint64)
    table[:1] = 1
    return np.cumprod(table, dtype=np.uint64)


_UP, _DOWN = _power_table(_BASE, BLOCK), _power_table(_INVERSE, BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each span of data; spans are in order and do not overlap.

    Works through blocks of BLOCK bytes, each from the start of a span, so that memory is
    bounded by a block or by the longest span, whichever is more.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        n = int(ends[to - 1] - low)
        up, down = (_UP, _DOWN) if n <= BLOCK else (_power_table(_BASE, n), _power_table(_INVERSE, n))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[data[low : low + n]] * up[:n], dtype=np.uint64, out=total[1:])
        first, last = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[last] - total[first]) * down[first])
        at = to
    return out


class Words:
    """Words of a list of texts.

    starts, ends: byte spans in data; first[i]:first[i+1] are the words of text i.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = _SPACE):
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        solid = ~separators[self.data]
        before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
        inner = self.offsets[1:-1]
        before = before.copy()
        before[inner[inner < len(solid)]] = False
        self.starts = np.flatnonzero(solid & ~before)
        after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
        after = after.copy()
        edge = inner[(inner > 0) & (inner <= len(solid))] - 1
        after[edge] = False
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z lower-cased if lower."""
        return span_hashes(self.data, self.starts, self.ends, _BYTE[_LOWER] if lower else _BYTE)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, hashes: np.ndarray, n: int, lane: int = 0, offsets: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starting words and hashes of all n-word windows inside one text.

        offsets names the words of the window that count; by default all do.
        """
        last = np.repeat(self.first[1:], np.diff(self.first)) - n
        at = np.flatnonzero(np.arange(len(hashes)) <= last)
        total = np.zeros(len(at), dtype=np.uint64)
        for k in range(n) if offsets is None else offsets:
            total += hashes[at + k] * LANES[lane, k]
        return at, mix(total)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 texts of an Arrow string column, null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def chunked(texts: list[bytes], most: int):
    """(from, to) runs of texts of about most bytes; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
