"""Benchmark decontamination with suffix arrays over training shards.

A shard is a slice of the documents that a task reads.  Its words become ids of the
benchmark vocabulary (0: not in it); suffixes that cannot reach a full window of
benchmark words are left out, the rest are sorted to their ends into a suffix array by
doubling, and every test suffix (window start of a benchmark item) is binary-searched in it.
Hits of neighbouring suffixes of one item are joined into the longest verbatim matches, with
their locations.

The documents are never shuffled: each task searches its own shards.  The benchmark is
split into blocks of at most ``block_bytes`` of text; each block's index is one
broadcast, and a task holds one block at a time, so memory does not grow with it.

Cases: null or empty text has no words (never contaminated).  An item without words has
no window; an item of fewer words than ``window`` is one window.  Rows are kept one for
one, so repeated rows and repeated or null doc_ids each give their own row.  Items with a
null item_id mark words but are not listed; repeated item_ids count once.  Extra columns
pass through ``remove_contaminated`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _text as T

WINDOW = 10
#: Benchmark text that one broadcast block covers at most (the index takes about twice as much).
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20


@dataclass
class Block:
    """Index of one block of the benchmark."""

    vocab: np.ndarray  # sorted word hashes; id = place + 1
    seen: np.ndarray  # bitmap over the top 16 bits of a hash
    tests: np.ndarray  # ids of all items, each followed by 0
    owner: np.ndarray  # item of each place of tests
    items: list  # item ids
    starts: dict[int, np.ndarray] = field(default_factory=dict)  # window length -> places in tests


def build_block(rows: list[tuple], window: int = WINDOW) -> Block | None:
    """Index of (item_id, text) rows."""
    texts = pa.array([t or "" for _, t in rows], type=pa.large_string())
    data, bounds = T.buffers(texts)
    words = T.words_of(data, bounds, T.ALNUM)
    if not len(words.hash):
        return None
    vocab, ids = np.unique(words.hash, return_inverse=True)
    seen = np.zeros(1 << 16, dtype=bool)
    seen[(vocab >> np.uint64(48)).astype(np.int64)] = True
    place = np.arange(len(ids)) + words.doc  # one gap after each item
    tests = np.zeros(len(ids) + len(rows), dtype=np.int32)
    owner = np.zeros(len(tests), dtype=np.int32)
    tests[place] = ids + 1
    owner[place] = words.doc
    block = Block(vocab, seen, tests, owner, [i for i, _ in rows])
    count = words.counts()
    size = np.minimum(count, window)[words.doc]
    left = np.cumsum(count)[words.doc] - np.arange(len(ids))  # words to the item's end
    for m in np.unique(size):
        block.starts[int(m)] = place[(size == m) & (left >= m)]
    return block


def _packed(ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    rows = ids[at[:, None] + np.arange(m)].astype(">i4")
    return np.ascontiguousarray(rows).view(f"S{4 * m}").ravel()


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value of each range [lo, hi)."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def suffix_array(ids: np.ndarray, run: np.ndarray, least: int) -> np.ndarray:
    """Places p of at least ``least`` words, in the order of the suffixes ids[p : p + run[p]]."""
    n = len(run)
    head = np.append(True, run[1:] != run[:-1] - 1)
    size = run[np.flatnonzero(head)][np.cumsum(head) - 1]  # of the run that a place lies in
    place = np.flatnonzero((run > 0) & (size >= least))
    rank = np.zeros(n + 1, np.int64)
    rank[place] = ids[place]
    d, longest = 1, int(run.max(initial=0))
    while len(place):
        ahead = np.where(run[place] > d, rank[np.minimum(place + d, n)], 0)
        keys, inverse = np.unique(rank[place] * (rank.max() + 1) + ahead, return_inverse=True)
        rank[place] = inverse + 1
        if len(keys) == len(place) or d >= longest:
            break
        d *= 2
    place = place[run[place] >= least]
    return place[np.argsort(rank[place], kind="stable")]


@dataclass
class Found:
    """What a shard's documents share with the benchmark; longest_at: the first word of the
    longest match (the first one), -1 without."""

    n_words: np.ndarray
    n_hit: np.ndarray
    longest: np.ndarray
    longest_at: np.ndarray
    items: list[set]
    matches: list[tuple]  # (document, item, first document word, first item word, words)


def search_shard(words: T.Words, blocks: Iterator[Block], want_matches: bool = False) -> Found:
    n, d = len(words.hash), words.n_docs
    cover = np.zeros(n + 1, dtype=np.int32)
    longest, longest_at = np.zeros(d, dtype=np.int64), np.full(d, -1, dtype=np.int64)
    items: dict[int, set] = {}
    matches: list[tuple] = []
    for block in blocks if n else ():
        ids = np.zeros(n + 1, dtype=np.int32)
        maybe = np.flatnonzero(block.seen[(words.hash >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(block.vocab, words.hash[maybe]), len(block.vocab) - 1)
        ids[maybe] = np.where(block.vocab[at] == words.hash[maybe], at + 1, 0)
        # words from each place on that are in the vocabulary and in the same document
        stop = ids[:n] == 0
        # a document's end stops the run that comes before it, not the one that starts there
        ends = np.searchsorted(words.doc, np.arange(d), "right")[words.doc]
        zero = np.flatnonzero(stop)
        zero = np.append(zero, n)
        nxt = zero[np.searchsorted(zero, np.arange(n), "left")]
        run = np.minimum(nxt, ends) - np.arange(n)
        for m, starts in block.starts.items():
            sa = suffix_array(ids, run, m)
            if not len(sa):
                continue
            key = _packed(ids, sa, m)
            tests = _packed(block.tests, starts, m)
            lo, hi = np.searchsorted(key, tests, "left"), np.searchsorted(key, tests, "right")
            row, rank = _spread(lo, hi)
            if not len(row):
                continue
            p, t = sa[rank], starts[row]
            once = np.unique(p)
            np.add.at(cover, once, 1)
            np.add.at(cover, once + m, -1)
            doc, item = words.doc[p], block.owner[t]
            for a, b in set(zip(doc.tolist(), item.tolist(), strict=True)):
                items.setdefault(a, set()).add(block.items[b])
            by = np.lexsort((p, p - t))  # consecutive places of one diagonal make one match
            p, t, doc = p[by], t[by], doc[by]
            new = np.append(True, (np.diff(p) != 1) | (np.diff(p - t) != 0) | (np.diff(doc) != 0))
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(p))) + m - 1
            base = np.searchsorted(words.doc, doc[head])
            best = np.lexsort((p[head], -length, doc[head]))
            best = best[np.append(True, np.diff(doc[head][best]) != 0)]
            own, size, at = doc[head][best], length[best], (p[head] - base)[best]
            better = (size > longest[own]) | ((size == longest[own]) & (at < longest_at[own]))
            longest[own[better]], longest_at[own[better]] = size[better], at[better]
            if want_matches:
                tbase = np.searchsorted(block.owner[block.tests > 0], block.owner[t[head]]) + block.owner[t[head]]
                matches += [(int(a), block.items[int(i)], int(x), int(y), int(z)) for a, i, x, y, z in zip(doc[head], block.owner[t[head]], p[head] - base, t[head] - tbase, length, strict=True)]
    hit = np.cumsum(cover[:n]) > 0
    n_hit = np.bincount(words.doc, weights=hit, minlength=d).astype(np.int64) if n else np.zeros(d, np.int64)
    return Found(words.counts() if n else np.zeros(d, np.int64), n_hit, longest, longest_at, [items.get(i, set()) for i in range(d)], matches)


def _blocks(held: list[Broadcast]) -> Iterator[Block]:
    for b in held:
        block = b.value
        if block is not None:
            yield block
        if len(held) > 1:  # one block in memory at a time; the file of the broadcast stays
            b.__dict__.pop("_value", None)


def index(bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """Broadcast indexes of blocks of the benchmark, each of about ``block_bytes`` of text."""
    sc = bench.sparkSession.sparkContext
    bench = bench.select("item_id", "text")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    out = []
    for k in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        out.append(sc.broadcast(build_block([tuple(r) for r in part.collect()], window)))
    return out


def _searched(batch: pa.RecordBatch, held: list[Broadcast], want_matches: bool = False) -> Found:
    data, bounds = T.buffers(batch.column("text"))
    parts = []
    for i, j in T.slices(bounds, SHARD_BYTES if len(held) > 1 else T.SLICE_BYTES):
        words = T.words_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], T.ALNUM)
        found = search_shard(words, _blocks(held), want_matches)
        found.matches = [(a + i, *rest) for a, *rest in found.matches]
        parts.append(found)
    if not parts:
        none = np.zeros(0, np.int64)
        return Found(none, none, none, none, [], [])
    return Found(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("n_words", "n_hit", "longest", "longest_at")), sum((p.items for p in parts), []), sum((p.matches for p in parts), []))


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    longest (words of the longest verbatim match) and longest_at (its first word in the
    document, counted from 0; the first such match; -1 without one)."""
    held = index(bench, window, block_bytes)

    def scan(batches):
        for batch in batches:
            f = _searched(batch, held)
            listed = [sorted(str(x) for x in s if x is not None) for s in f.items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(f.n_words, pa.int64()), pa.array(f.n_hit, pa.int64()), pa.array(map(len, listed), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()), pa.array(f.n_hit > 0), pa.array(f.longest, pa.int64()), pa.array(f.longest_at, pa.int64())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long")


def longest_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every maximal verbatim match of at least ``window`` words (or a whole shorter item):
    doc_id, item_id, doc_word, item_word, n_words (places count from 0)."""
    held = index(bench, window, block_bytes)
    kinds = {c: t.schema[c].dataType for t, c in ((docs, "doc_id"), (bench, "item_id"))}
    item = to_arrow_type(kinds["item_id"])

    def scan(batches):
        for batch in batches:
            rows = _searched(batch, held, True).matches
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array([r[1] for r in rows], item), *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4))], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kinds['doc_id'].simpleString()}, item_id {kinds['item_id'].simpleString()}, doc_word long, item_word long, n_words long")


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark."""
    held = index(bench, window, block_bytes)

    @T.tidy
    def keep(batches):
        for batch in batches:
            hit = _searched(batch, held).n_hit
            for k, part in enumerate(T.parts(batch)):
                yield part.filter(pa.array(hit[k * T.ROWS : k * T.ROWS + len(part)] == 0))

    return docs.mapInArrow(keep, docs.schema)
