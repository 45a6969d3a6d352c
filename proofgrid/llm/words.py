"""Words and hashes of whole Arrow batches at once.

A batch's texts are one byte buffer. Words are runs of word bytes (every separator is ASCII, so UTF-8 bytes and
characters agree). A word's hash mixes eight bytes a step, all words of a chunk at once; a very long word has a digest of its
own. Its keys come from a secret that an operator draws for each run (draw()), so that nobody can write words that agree; with
secret 0 they are fixed, for hashes that must be the same in every run. Runs of k words are polynomials modulo 2**64 of these hashes, from prefix sums, so k costs nothing; k stays far below
the lengths from which such polynomials can be made to agree.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Arrays of 8 bytes for each byte of a chunk stand in memory several times over; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the output."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Powers:
    """Powers of an odd number and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            steps = np.full(n, self.base, U64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=U64)
            steps[1:] = self.inverse
            self.down = np.cumprod(steps, dtype=U64)
        return self.up, self.down


#: Words of more bytes are digested one by one.
LONG_WORD = 256
LANE_KEY, LENGTH_KEY = U64(0x9FB21C651E98DF25), U64(0xA0761D6478BD642F)
TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def draw() -> int:
    """A secret for hashes that are compared within one run only; the driver draws it, all tasks of the run get it."""
    return secrets.randbits(63) + 1


def keys(secret: int) -> tuple[np.uint64, np.uint64]:
    """(the multiplier of eight bytes, odd; what a word's length is added to)."""
    if not secret:
        return LANE_KEY, LENGTH_KEY
    raw = np.frombuffer(hashlib.blake2b(secret.to_bytes(8, "little"), digest_size=16).digest(), "<u8")
    return raw[0] | U64(1), raw[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, secret: int = 0) -> np.ndarray:
    """A hash of 64 bits of the bytes data[starts[i]:ends[i]] for every i."""
    lane_key, length_key = keys(secret)
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(size.astype(U64) + length_key)
    live, at = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(live):
        left = size[live] - at
        out[live] = mix(out[live] ^ ((lanes[starts[live] + at] & TAIL[np.minimum(left, 8)]) * lane_key))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=secret.to_bytes(8, "little")).digest(), "little")
    return out


BYTE_POWERS, WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x5851F42D4C957F2D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(lower: bool, alphanumeric: bool) -> tuple[np.ndarray, bool]:
    """(is a word byte of each byte, lower); lower folds A-Z, alphanumeric takes digits, letters and non-ASCII only."""
    word = np.ones(256, bool)
    if alphanumeric:
        word[:128] = False
        word[ord("0") : ord("9") + 1] = word[ord("a") : ord("z") + 1] = True
        if lower:
            word[ord("A") : ord("Z") + 1] = True
    else:
        word[[0x20, *range(0x09, 0x0E)]] = False
    return word, lower


class Words:
    """The words of a chunk of texts: data, starts and ends of words, first[i]:first[i + 1] the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, bool]):
        is_word, self.lower = kind
        self.data, self.offsets = data, offsets
        w = is_word[data]
        before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        inner = offsets[(offsets > 0) & (offsets < len(w))]
        before[inner] = False
        after[inner - 1] = False
        self.starts, self.ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, secret: int = 0) -> np.ndarray:
        return span_hashes(LOWER[self.data] if self.lower else self.data, self.starts, self.ends, secret)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of words[i:i + k] for every i that has k words left; the caller drops those that cross a text's end."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = WORD_POWERS(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n] + U64(k))


def within(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n gram starts have all k words inside their text."""
    ok = np.zeros(n, bool)
    step = np.zeros(n + 1, np.int32)
    a, b = first[:-1], first[1:] - k + 1
    keep = b > a
    np.add.at(step, a[keep], 1)
    np.add.at(step, np.minimum(b[keep], n), -1)
    ok[:] = np.cumsum(step[:-1]) > 0
    return ok


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of slices of a string column of about most bytes; a longer text stands alone. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, at, buf = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def release() -> None:
    """Give back what Arrow keeps for later, at the end of a task: idle Python workers stay beside the next stage's."""
    pa.default_memory_pool().release_unused()


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and lengths."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
