"""Vectorised byte-level text kernels shared by the corpus operators.

Texts arrive as Arrow string columns.  Every kernel works on the UTF-8 bytes of a
slice of documents at once, so no Python object is made per word.  All word
classes below are unions of ASCII ranges with "every byte >= 0x80", which makes
the byte view agree with the code-point view.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one kernel call handles; one longer document is its own slice.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch that whole-document filters handle and return at once.
ROWS = 1000


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a bijection on 64-bit words)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream64(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit words: mix64 of a Weyl sequence."""
    with np.errstate(over="ignore"):
        return mix64(U64(seed) + U64(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=U64))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = stream64(11, 256)[_FOLD]  # A-Z hash as a-z
_BASE = int(stream64(12, 1)[0]) | 1
_INV = pow(_BASE, -1, 1 << 64)


def _members(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Lower-cased alphanumeric runs: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z -> a-z.
ALNUM = _members((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Runs without ASCII white space: [^\x20\x09-\x0D]+.
NONSPACE = ~_members((0x20, 0x20), (0x09, 0x0D))
#: Runs of ASCII letters and non-ASCII characters.
LETTERS = _members((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of consecutive documents: byte start and end, document index, 64-bit hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def bytes_at(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    bounds = np.frombuffer(offs, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of at most ``limit`` bytes (one document at least)."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of ROWS rows, so that what is made of them stays small on both sides."""
    return (batch.slice(at, ROWS) for at in range(0, len(batch), ROWS))


def release() -> None:
    """Give memory that nothing uses back to the system: idle workers stay beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(scan: Callable) -> Callable:
    """``scan`` (a generator over the batches of a partition), followed by ``release``."""

    @functools.wraps(scan)
    def run(batches):
        try:
            yield from scan(batches)
        finally:
            release()

    return run


def words_of(data: np.ndarray, bounds: np.ndarray, member: np.ndarray, cut: np.ndarray | None = None) -> Words:
    """Maximal runs of ``member`` bytes inside each document, hashed by a polynomial
    over a random byte table (mod 2^64) and a final mixer.  A-Z hash as a-z.  ``cut``
    (256 * 256 flags) also ends a run between two bytes."""
    n, n_docs = len(data), len(bounds) - 1
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, none, none.astype(U64), n_docs)
    inside = member[data]
    first = np.empty(n, dtype=bool)
    first[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
    heads = bounds[:-1][(bounds[:-1] < bounds[1:])]
    first[heads] = inside[heads]
    last = np.empty(n, dtype=bool)
    last[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    if cut is not None:
        apart = cut[data[:-1].astype(np.int32) * 256 + data[1:]] & inside[:-1] & inside[1:]
        first[1:] |= apart
        last[:-1] |= apart
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], dtype=U64, out=total[1:])
    value = (total[end] - total[start]) * down[start]
    doc = np.searchsorted(bounds, start, "right") - 1
    return Words(data, start, end, doc, mix64(value + (end - start).astype(U64)), n_docs)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (the caller masks runs across documents)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    factor = stream64(101, k) | U64(1)
    out = hashes[:n] * factor[0]
    for j in range(1, k):
        out += hashes[j : j + n] * factor[j]
    return mix64(out)


def shingles_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the k-word shingles; a document of fewer words, but not
    none, has its whole sequence as one."""
    h = shingle_hashes(words.hash, k)
    if len(h):
        same = words.doc[: len(h)] == words.doc[k - 1 :]
        h, doc = h[same], words.doc[: len(same)][same]
    else:
        doc = np.zeros(0, dtype=np.int64)
    count = words.counts()
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        heads = np.searchsorted(words.doc, short)
        own = np.array([_whole(words.hash[a : a + c]) for a, c in zip(heads, count[short], strict=True)], dtype=U64)
        h, doc = np.concatenate([h, own]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def _whole(hashes: np.ndarray) -> np.uint64:
    factor = stream64(7000 + len(hashes), len(hashes)) | U64(1)
    return mix64(np.array([(hashes * factor).sum(dtype=U64)], dtype=U64))[0]


def distinct_by_doc(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, and n_docs + 1 offsets (doc ascends)."""
    edge = np.searchsorted(doc, np.arange(n_docs + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    size = np.fromiter(map(len, parts), dtype=np.int64, count=n_docs)
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum(size)])
