"""Words of whole texts as NumPy arrays: byte spans and 64-bit hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which on UTF-8
equals the pattern ``[^\\x20\\x09-\\x0D]+``. All work is vectorised over the
value buffer of an Arrow string column, so a batch costs a few array passes
and no Python object per word.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: glibc's malloc_trim, where the C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def released(fn):
    """``fn``, a function from batches to batches, that releases a task's memory at its end."""
    def run(batches):
        yield from fn(batches)
        release()
    return run


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes hashed at once; bounds the 8-byte-per-byte temporaries.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection that spreads every input bit)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(31)
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], _U))[0])


#: A polynomial modulo 2**64 is a sound hash of words up to this length only: patterns such as the
#: Thue-Morse sequence make it vanish for longer ones.
POLYNOMIAL = 64


class WordHash:
    """A 64-bit hash of byte strings: a polynomial modulo 2**64, finalised by ``mix``, or BLAKE2 of longer words.

    Byte values go through a seeded table of random odd 64-bit numbers; prefix
    sums over a chunk give every word's hash in a few array operations. Words of
    more than POLYNOMIAL bytes are hashed one by one.
    """

    def __init__(self, seed: int, lower: bool = False):
        rng = np.random.default_rng(seed)
        table = rng.integers(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        self.table = table[LOWER] if lower else table
        self.lower, self.key = lower, seed.to_bytes(8, "little")
        self.p = int(rng.integers(2**40, 2**60)) * 8 + 5
        self.inv = pow(self.p, -1, 2**64)
        self._pow = self._ipow = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self._pow) < n:
            with np.errstate(over="ignore"):
                self._pow = np.cumprod(np.r_[_U(1), np.full(n, self.p, _U)])
                self._ipow = np.cumprod(np.r_[_U(1), np.full(n, self.inv, _U)])

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), _U)
        i = 0
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            n = int(ends[j - 1]) - base
            self._powers(max(n, CHUNK) + 1)
            sums = np.empty(n + 1, _U)
            sums[0] = 0
            np.cumsum(self.table[buf[base:base + n]] * self._pow[:n], out=sums[1:])
            a, b = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * self._ipow[a] + (b - a).astype(_U)
            i = j
        out = mix(out)
        for i in np.flatnonzero(ends - starts > POLYNOMIAL).tolist():
            word = LOWER[buf[starts[i]:ends[i]]] if self.lower else buf[starts[i]:ends[i]]
            out[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8, key=self.key).digest(), "little")
        return out


@dataclass
class Texts:
    """A batch of texts: bytes, document offsets, and the words in them."""

    buf: np.ndarray       #: uint8, the bytes of all documents, end to end
    offsets: np.ndarray   #: int64, document i is buf[offsets[i]:offsets[i + 1]]
    starts: np.ndarray    #: int64, first byte of each word
    ends: np.ndarray      #: int64, byte after each word
    first: np.ndarray     #: int64, document i has words first[i]:first[i + 1]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)


def texts_of(column: pa.Array) -> Texts:
    """Words of an Arrow string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, val = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    buf = np.frombuffer(val, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return spans(buf, offsets - lo if len(column) else np.zeros(1, np.int64))


def spans(buf: np.ndarray, offsets: np.ndarray) -> Texts:
    solid = np.zeros(len(buf) + 1, bool)
    np.logical_not(SPACE[buf], out=solid[:-1])
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:]
    end = solid[:-1] & (~solid[1:] | edge[1:])
    starts = np.flatnonzero(begin).astype(np.int64)
    ends = np.flatnonzero(end).astype(np.int64) + 1
    return Texts(buf, offsets, starts, ends, np.searchsorted(starts, offsets, "left"))


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text (one document at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    size = np.array(pc.binary_length(column).fill_null(0), dtype=np.int64)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def rolling(values: np.ndarray, first: np.ndarray, width: int, mult: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` consecutive values that lie inside one document.

    Returns (position of the run's first value, hash).
    """
    n = np.diff(first)
    if not len(values) or width > len(values):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    acc = values[:len(values) - width + 1].copy()
    for k in range(1, width):
        acc *= _U(mult)
        acc += values[k:len(values) - width + 1 + k]
    left = np.repeat(first[1:], n) - np.arange(len(values))
    at = np.flatnonzero(left[:len(acc)] >= width)
    return at, mix(acc[at])
