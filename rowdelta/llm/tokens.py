"""Word splitting and word hashing over whole Arrow string columns at once, with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
#: An odd base of polynomials modulo 2**64.
WORD_BASE = 0xD1342543DE82EF95
#: Words at a time, and the bytes of a word beyond which it is hashed by a digest.
_PIECE, LONG = 1 << 19, 256
#: The first n bytes of eight, for n from 0 to 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_upper = np.arange(256, dtype=np.uint8)
_upper[65:91] += 32
#: Byte to byte, A-Z lower-cased.
ASCII_LOWER = _upper
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial sum(values[s + j] * base**j) modulo 2**64 of each range [s, e): Rabin-Karp from prefix sums."""
    p = powers(base, len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p, dtype=np.uint64, out=prefix[1:])
    back = powers(pow(base, -1, 1 << 64), len(values))
    return (prefix[ends] - prefix[starts]) * back[starts]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and len + 1 offsets into them. Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    return data, offsets - offsets[0]


class Words:
    """The words of a column of texts: byte ranges, and each document's range of words."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = utf8(column)
        if lower:
            self.data = ASCII_LOWER[self.data]
        inside = IN_WORD[self.data]
        first = np.zeros(len(self.data) + 1, bool)
        first[self.offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        #: words of document d are those from by_doc[d] to by_doc[d + 1]
        self.by_doc = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight bytes at a time through ``mix``, so that no sum of terms can be
        made to agree as in a polynomial; words of over ``LONG`` bytes by a digest of the whole."""
        size = self.ends - self.starts
        out = mix(size.astype(np.uint64) * BYTE_BASE)
        open_ = np.flatnonzero(size <= LONG)
        raw = np.concatenate([self.data, np.zeros(8, np.uint8)])
        step = 0
        while len(open_):
            for at in range(0, len(open_), _PIECE):
                own = open_[at : at + _PIECE]
                begin = self.starts[own] + step
                eight = np.lib.stride_tricks.sliding_window_view(raw, 8)[begin].view("<u8").ravel()
                left = np.minimum(size[own] - step, 8)
                out[own] = mix((out[own] ^ (eight & _FIRST[left])) + BYTE_BASE)
            step += 8
            open_ = open_[size[open_] > step]
        for i in np.flatnonzero(size > LONG).tolist():
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def joined(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """The document's words (those where keep is true) with one space between."""
        a, b = self.by_doc[doc], self.by_doc[doc + 1]
        s, e = self.starts[a:b], self.ends[a:b]
        if keep is not None:
            s, e = s[keep], e[keep]
        raw = self.data
        return b" ".join([raw[i:j].tobytes() for i, j in zip(s.tolist(), e.tolist(), strict=True)])


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts reach about ``most`` bytes, so that working arrays stay small."""
    texts = batch.column(column).cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
