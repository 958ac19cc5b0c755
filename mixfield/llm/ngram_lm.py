"""Stupid-backoff document scores over word-pair counts partitioned by hash.

    S(w | v) = count(v w) / count(v)      if count(v w) > 0
             = ALPHA * count(w) / N       otherwise;  the first word has no v and no ALPHA

The counts are those of the whole corpus less the document's own (leave one out), so the
score says how well the rest predicts the document; a word found nowhere else counts as
one.  N is the corpus length less the document's.  A document's score is the sum of ln S.

Plan.  (1) Word counts by a combined count; words with at least ``total / HOT_SHARE``
uses are hot: at most HOT_SHARE of them, so their table may be broadcast.  Likewise pairs
with ``total / HOT_PAIRS`` uses: slices name those that reach half that share in them, at most
2 * HOT_PAIRS pass on their sums, and a second look counts them in full.  Hot pairs are scored
where they stand, so a pair that is in every document crosses no shuffle.  (2) A task
explodes its documents' other word pairs into packed lists (v, w, document, times, own counts),
one per hash partition of v - of the pair, where v is hot, so that no frequent word fills
a partition.  (3) In a partition the pair counts and the counts of its words are complete:
seen pairs are scored there, unseen ones ask for count(w): hot words at once, the others
in the partition of w.  (4) Both kinds of partial sums are added per chunk of documents.
Every shuffled row is a packed array of bounded size, and a pair has one entry per
document, so groups stay even.  Questions go out as one row per asking and asked partition.

Cases: null and empty texts have no words: n_words 0, score and mean null.  Rows are
scored one by one (repeated and null doc_ids too).  Extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import stash

ALPHA = 0.4
#: Hot words are those with at least 1 / HOT_SHARE of all words; so there are at most that many.
HOT_SHARE = 1 << 20
#: Hot pairs are those with at least 1 / HOT_PAIRS of all words, and some with half of that.
HOT_PAIRS = 1 << 14
#: Words that one hash partition takes, about.
PART_WORDS = 1_500_000
#: Shares of a partition that are counted one after the other, to save memory.
LOTS = 6
#: Bytes of text that a packed row covers.
SLICE = 2 << 20
_END = T.stream64(901, 2)[1]
_PAIR = T.stream64(902, 2) | np.uint64(1)


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def _dump(*columns: np.ndarray) -> bytes:
    """Columns packed and compressed; wide columns of mostly small numbers are split."""
    raw = pickle.dumps([_split(c) for c in columns], protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _load(body: bytes) -> list[np.ndarray]:
    size = int.from_bytes(body[:8], "little")
    return [_joined(c) for c in pickle.loads(pa.Codec("zstd").decompress(body[8:], size, asbytes=True))]


def _split(c: np.ndarray) -> np.ndarray | tuple:
    """A uint16 or uint32 column as bytes, and the few values that do not fit them."""
    if c.dtype in (np.uint16, np.uint32) and len(c) > 64:
        big = np.flatnonzero(c > 254)
        if len(big) * 8 < len(c):
            low = np.minimum(c, 255).astype(np.uint8)
            return low, big.astype(np.uint32), c[big]
    return c


def _joined(c: np.ndarray | tuple) -> np.ndarray:
    if isinstance(c, tuple):
        out = c[0].astype(c[2].dtype)
        out[c[1]] = c[2]
        return out
    return c


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return T.mix64(a * _PAIR[0] + b * _PAIR[1])


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _find(table: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Counts of h in a sorted table; 0 if not there."""
    if not len(table):
        return np.zeros(len(h), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, values[at], 0)


def _scanned(docs: DataFrame, each) -> DataFrame:
    """(kind, h, n) of what ``each`` counts in the words of every slice, summed."""

    def scan(batches):
        for batch in batches:
            data, bounds = T.buffers(batch.column("text"))
            for i, j in T.slices(bounds, SLICE):
                words = T.words_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], T.NONSPACE)
                for kind, h, n in each(words):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["kind", "h", "n"])

    return docs.select("text").mapInArrow(scan, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))


def _pairs_of(words: T.Words) -> np.ndarray:
    """Hashes of the word pairs inside documents."""
    same = words.doc[1:] == words.doc[:-1]
    return _pair(words.hash[:-1][same], words.hash[1:][same])


def word_counts(docs: DataFrame) -> DataFrame:
    """kind 0: h (hash of a word), n; kind 1: pairs that may be hot, n at least."""

    def each(words):
        yield 0, *np.unique(words.hash, return_counts=True)
        pairs, n = np.unique(_pairs_of(words), return_counts=True)
        some = n * 2 * HOT_PAIRS >= len(words.hash)
        yield 1, pairs[some], n[some]

    return _scanned(docs, each)


def hot_pairs(docs: DataFrame, counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of hot pairs: 2 * HOT_PAIRS at most."""
    named = counts.where((F.col("kind") == 1) & (F.col("n") * 2 * HOT_PAIRS >= total)).select("h").toPandas()
    held = docs.sparkSession.sparkContext.broadcast(np.sort(named.h.to_numpy().view(np.uint64)))

    def each(words):
        at = _place(held.value, _pairs_of(words))
        n = np.bincount(at[at >= 0], minlength=len(held.value))
        yield 1, held.value[n > 0], n[n > 0]

    found = _scanned(docs, each).where(F.col("n") >= max(2, -(-total // (2 * HOT_PAIRS)))).toPandas()
    h, n = found.h.to_numpy().view(np.uint64), found.n.to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def _chunk(words: T.Words, hot: tuple, pairs: tuple, parts: int, alpha: float) -> tuple[list[tuple[int, bytes]], list[np.ndarray]]:
    """(partition, packed pairs) of the documents of one slice, and what hot pairs add to them:
    documents, sums, words over N."""
    hot, hot_n = hot
    vocab, w = np.unique(words.hash, return_inverse=True)
    v, n = len(vocab), len(w)
    if not n:
        return [], [np.zeros(0, np.uint8), np.zeros(0), np.zeros(0, np.uint8)]
    _, inv, times = np.unique(words.doc * v + w, return_inverse=True, return_counts=True)
    own = times[inv]  # uses of this word in this document
    nxt = np.append(w[1:], v)
    nxt[np.flatnonzero(np.append(np.diff(words.doc) != 0, True))] = v  # a document's last word is followed by the end
    order = np.argsort((w * (v + 1) + nxt) * words.n_docs + words.doc, kind="stable")
    a, b, d = w[order], nxt[order], words.doc[order]
    head = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(d) != 0)))
    times = np.diff(np.append(head, n))
    own_a = own[order][head]
    follow = np.minimum(order[head] + 1, n - 1)
    a, b, d = a[head], b[head], d[head]
    own_b = np.where(b < v, own[follow], 0)
    firsts = np.flatnonzero(np.append(True, np.diff(words.doc) != 0))
    full = np.append(vocab, _END)
    code = np.append(_place(hot, vocab), -1)  # place among the hot words, or -1
    here = np.where(b < v, _place(pairs[0], _pair(full[a], full[b])), -1)
    at = np.flatnonzero(here >= 0)  # both words of a hot pair are hot
    others, t = pairs[1][here[at]] - times[at], times[at]
    seen = others > 0
    known = np.where(seen, others, np.maximum(hot_n[code[b[at]]] - own_b[at], 1))
    under = np.where(seen, np.log(np.maximum(hot_n[code[a[at]]] - own_a[at], 1)), -math.log(alpha))
    docs, inv = np.unique(d[at], return_inverse=True)
    added = [_narrow(docs), np.bincount(inv, weights=t * (np.log(known) - under), minlength=len(docs)), _narrow(np.bincount(inv, weights=t * ~seen, minlength=len(docs)).astype(np.int64))]
    rest = np.flatnonzero(here < 0)
    a, b, d, times, own_a, own_b = (x[rest] for x in (a, b, d, times, own_a, own_b))
    part = np.where(code[a] >= 0, _part(_pair(full[a], full[b]), parts), _part(full[a], parts))
    first_part = _part(vocab[w[firsts]], parts)
    out = []
    by = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[by], np.arange(parts + 1))
    fby = np.argsort(first_part, kind="stable")
    fedge = np.searchsorted(first_part[fby], np.arange(parts + 1))
    for p in range(parts):
        s, f = by[edge[p] : edge[p + 1]], firsts[fby[fedge[p] : fedge[p + 1]]]
        if len(s) or len(f):
            da, na = np.unique(a[s], return_counts=True)
            db, ib = np.unique(b[s], return_inverse=True)
            out.append((p, _dump(*_words(da, full, code), _narrow(na), *_words(db, full, code), _narrow(ib), *map(_narrow, (d[s], times[s], own_a[s], own_b[s])), words.hash[f], _narrow(words.doc[f]), _narrow(own[f]))))
    return out, added


def _place(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of h in a sorted table; -1 where it is not there."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def _words(ids: np.ndarray, full: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a row in short: whether each is hot, places of the hot ones, other hashes."""
    c = code[ids]
    return np.packbits(c >= 0), _narrow(c[c >= 0]), full[ids[c < 0]]


def _hashes(flags: np.ndarray, places: np.ndarray, others: np.ndarray, hot: np.ndarray) -> np.ndarray:
    is_hot = np.unpackbits(flags, count=len(places) + len(others)).astype(bool)
    out = np.empty(len(is_hot), dtype=np.uint64)
    out[is_hot], out[~is_hot] = hot[places.astype(np.int64)], others
    return out


def score(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, score (sum of ln S), mean (score / n_words), row for row."""
    spark = docs.sparkSession
    counted = stash(word_counts(docs), "words")
    counts = counted.where("kind = 0")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // HOT_SHARE))
    top = counts.where(F.col("n") >= least).toPandas() if total else None
    hot, hot_n = (top.h.to_numpy().view(np.uint64), top.n.to_numpy()) if total else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    by = np.argsort(hot)
    table = spark.sparkContext.broadcast((hot[by], hot_n[by]))
    pair_table = spark.sparkContext.broadcast(hot_pairs(docs, counted, total))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_WORDS))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def explode(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, bounds = T.buffers(batch.column("text"))
            for i, j in T.slices(bounds, SLICE):
                words = T.words_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], T.NONSPACE)
                rows, added = _chunk(words, table.value, pair_table.value, parts, alpha)
                rows.append((chunk % parts, _dump(words.counts(), *added)))
                names = batch.column("doc_id").slice(i, j - i)
                sizes = [0] * (len(rows) - 1) + [j - i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), names)],
                    ["part", "chunk", "body", "doc_ids"],
                )
                chunk += 1

    exploded = docs.select("doc_id", "text").mapInArrow(explode, f"part int, chunk long, body binary, doc_ids array<{kind}>")

    def whole(batches) -> pa.Table | None:
        """All rows of a partition."""
        held = [b for b in batches if len(b)]
        return pa.Table.from_batches(held) if held else None

    def pairs(batches):
        """kind 0: documents of a chunk; 1: sums of a chunk; 2: words asked for; 3: word counts."""
        t = whole(batches)
        if t is None:
            return
        hot, hot_n = table.value
        out, mine = [], t["part"][0].as_py()
        rows = [(c, *_load(b)) for c, b, x in zip(t["chunk"].to_pylist(), t["body"].to_pylist(), pa.compute.list_value_length(t["doc_ids"]).to_pylist(), strict=True) if not x]
        names = t.filter(pa.compute.greater(pa.compute.list_value_length(t["doc_ids"]), 0))
        for c, b, x in zip(names["chunk"].to_pylist(), names["body"].to_pylist(), names["doc_ids"].to_pylist(), strict=True):
            out.append((0, 0, c, b, x))
        if rows:
            index, chunks = [r[0] for r in rows], np.unique([r[0] for r in rows])
            a = np.concatenate([np.repeat(_hashes(*r[1:4], hot), r[4]) for r in rows])
            b = np.concatenate([_hashes(*r[5:8], hot)[r[8]] for r in rows])
            row = np.repeat(np.searchsorted(chunks, index), [len(r[8]) for r in rows]).astype(np.int32)
            d, times, own_a, own_b = (np.concatenate([r[k] for r in rows]).astype(np.int32) for k in (9, 10, 11, 12))
            first = [np.repeat(np.searchsorted(chunks, index), [len(r[13]) for r in rows]).astype(np.int32), *(np.concatenate([r[k] for r in rows]) for k in (14, 13, 15))]
            del rows
            # firsts ask like unseen pairs, without ALPHA
            asks = [[first[0], first[1].astype(np.int32), first[2], np.ones(len(first[0]), np.int32), first[3].astype(np.int32), np.zeros(len(first[0]), np.int8)]]
            sums, known_words, known_n = [], [], []
            pair = _pair(a, b)
            lot = ((np.where(_place(hot, a) >= 0, pair, a) >> np.uint64(20)) % np.uint64(LOTS)).astype(np.int8)
            for k in range(LOTS):  # a lot has all uses of its pairs, and of its words that are not hot
                at = np.flatnonzero(lot == k)
                if not len(at):
                    continue
                _, inv = np.unique(pair[at], return_inverse=True)
                t = times[at].astype(np.int64)
                others = np.bincount(inv, weights=t).astype(np.int64)[inv] - t
                ctx = _find(hot, hot_n, a[at])
                rare = ctx == 0
                words, winv = np.unique(a[at][rare], return_inverse=True)
                n_word = np.bincount(winv, weights=t[rare], minlength=len(words)).astype(np.int64)
                ctx[rare] = n_word[winv]
                known_words.append(words)
                known_n.append(n_word)
                ends = b[at] == _END
                seen = (others > 0) & ~ends
                gain = t[seen] * (np.log(others[seen]) - np.log(np.maximum(ctx[seen] - own_a[at][seen], 1)))
                sums.append((row[at][seen], d[at][seen], gain, np.zeros(len(gain), np.int32)))
                ask = at[~seen & ~ends]
                asks.append([row[ask], d[ask], b[ask], times[ask], own_b[ask], np.ones(len(ask), np.int8)])
            out.append((3, mine, -1, _dump(np.concatenate(known_words) if known_words else np.zeros(0, np.uint64), np.concatenate(known_n) if known_n else np.zeros(0, np.int64)), []))
            del a, b, pair, lot
            r_, d_, w_, t_, o_, l_ = (np.concatenate(x) for x in zip(*asks, strict=True))
            known = _find(hot, hot_n, w_)
            at = known > 0
            sums.append((r_[at], d_[at], t_[at] * (np.log(np.maximum(known[at] - o_[at], 1)) + l_[at] * math.log(alpha)), t_[at]))
            row, d, gain, low = (np.concatenate(x) for x in zip(*sums, strict=True))
            out += _per_chunk(1, 0, chunks[row], d, gain, low)
            r_, d_, w_, t_, o_, l_ = (x[~at] for x in (r_, d_, w_, t_, o_, l_))
            q = _part(w_, parts)
            order = np.lexsort((r_, q))
            r_, d_, w_, t_, o_, l_, q = (x[order] for x in (r_, d_, w_, t_, o_, l_, q))
            heads = np.flatnonzero(np.append(True, np.diff(q) != 0)) if len(q) else []
            for i, j in zip(heads, [*heads[1:], len(q)], strict=True) if len(q) else ():
                # all that this partition asks of another one is one row: chunks and their numbers of words lead
                own, many = np.unique(r_[i:j], return_counts=True)
                out.append((2, int(q[i]), -1, _dump(chunks[own], _narrow(many), _narrow(d_[i:j]), w_[i:j], *map(_narrow, (t_[i:j], o_[i:j], l_[i:j]))), []))
        yield from _batches(out)

    def _batches(out: list[tuple]) -> list[pa.RecordBatch]:
        return _table(out).to_batches()

    def _table(out: list[tuple]) -> pa.Table:
        return pa.table({"kind": pa.array([r[0] for r in out], pa.int32()), "part": pa.array([r[1] for r in out], pa.int32()), "chunk": pa.array([r[2] for r in out], pa.int64()), "body": pa.array([r[3] for r in out], pa.binary()), "doc_ids": pa.array([r[4] for r in out], pa.list_(id_type))})

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"kind int, part int, chunk long, body binary, doc_ids array<{kind}>"
    # a partition is a part, so that no task gets several by chance
    scored = stash(exploded.repartitionById(parts, F.col("part")).mapInArrow(pairs, schema), "pairs")

    def answer(batches):
        t = whole(batches)
        if t is None:
            return
        kinds, bodies = t["kind"].to_pylist(), t["body"].to_pylist()
        known = [_load(b) for k, b in zip(kinds, bodies, strict=True) if k == 3]
        words, n = (np.concatenate([k[0] for k in known]), np.concatenate([k[1] for k in known])) if known else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        by = np.argsort(words)
        words, n = words[by], n[by]
        asked = [_load(b) for k, b in zip(kinds, bodies, strict=True) if k == 2]
        out = []
        if asked:
            chunk = np.concatenate([np.repeat(r[0], r[1]) for r in asked])
            d, h, times, own, low = (np.concatenate([r[k] for r in asked]) for k in (2, 3, 4, 5, 6))
            times = times.astype(np.int64)
            got = _find(words, n, h) - own.astype(np.int64)
            sums = times * (np.log(np.maximum(got, 1)) + low * math.log(alpha))
            out = _per_chunk(1, 0, chunk, d.astype(np.int64), sums, times)
        yield from _batches(out)

    answered = scored.where("kind IN (2, 3)").repartitionById(parts, F.col("part")).mapInArrow(answer, schema)

    def finish(key, t):
        names, n, parts_ = None, None, []
        for k, b, x in zip(t["kind"].to_pylist(), t["body"].to_pylist(), range(len(t)), strict=True):
            if k == 0:
                own, *added = _load(b)
                names, n = t["doc_ids"].combine_chunks()[x].values, own.astype(np.int64)
                parts_.append(added)
            else:
                parts_.append(_load(b))
        sums, lows = np.zeros(len(n)), np.zeros(len(n))
        for d, s, low in parts_:
            sums[d] += s
            lows[d] += low
        sums -= lows * np.log(np.maximum(total - n, 1))
        some = pa.array(n == 0)
        mean = sums / np.maximum(n, 1)
        return pa.table({"doc_id": names, "n_words": pa.array(n, pa.int64()), "score": pa.array(sums, pa.float64(), mask=n == 0), "mean": pa.array(mean, pa.float64(), mask=some.to_numpy(zero_copy_only=False))})

    both = scored.where("kind IN (0, 1)").unionByName(answered)
    return both.groupBy("chunk").applyInArrow(finish, f"doc_id {kind}, n_words long, score double, mean double")


def _per_chunk(kind: int, part: int, chunk: np.ndarray, d: np.ndarray, sums: np.ndarray, lows: np.ndarray) -> list[tuple]:
    """Packed (documents, sums, words over N) for each chunk."""
    out = []
    order = np.argsort(chunk, kind="stable")
    chunk, d, sums, lows = chunk[order], d[order], sums[order], lows[order]
    heads = np.flatnonzero(np.append(True, np.diff(chunk) != 0)) if len(chunk) else []
    for i, j in zip(heads, [*heads[1:], len(chunk)], strict=True) if len(chunk) else ():
        u, inv = np.unique(d[i:j], return_inverse=True)
        s, low = np.bincount(inv, weights=sums[i:j]), np.bincount(inv, weights=lows[i:j])
        out.append((kind, part, int(chunk[i]), _dump(_narrow(u), s, _narrow(low.astype(np.int64))), []))
    return out


def score_by_tables(docs: DataFrame, order: int = 3, alpha: float = ALPHA) -> DataFrame:
    """The scores of a model of any order, in joins of tables: doc_id, n_words, score, mean, row
    for row.  Each document's n-grams are exploded, one row for equal ones; counts of all n-grams
    are one table; from the longest n-gram on, rows are joined with it, scored where the n-gram
    occurs in other documents, and passed on to the next shorter one, at a factor ``alpha``,
    where not.  With order 2 this is ``score``, which shuffles far less."""

    def explode(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        kind = pa.list_(pa.int64())
        for batch in batches:
            data, bounds = T.buffers(batch.column("text"))
            names = batch.column("doc_id")
            for i, j in T.slices(bounds, SLICE // 8):
                w = T.words_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], T.NONSPACE)
                n = w.counts() if len(w.hash) else np.zeros(j - i, np.int64)
                none = pa.array([[]] * (j - i), kind)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(j - i)), names.slice(i, j - i), pa.array(np.zeros(j - i, np.int32)), pa.array(n), none, none, none, none], _TABLE)
                if len(w.hash):
                    at = np.arange(len(w.hash)) - np.searchsorted(w.doc, w.doc)
                    gram, own = [], []  # of each length that ends at each word, and its uses in the document
                    for k in range(1, order + 1):
                        h = np.zeros(len(w.hash), np.uint64)
                        h[k - 1 :] = T.mix64(T.shingle_hashes(w.hash, k) + np.uint64(k))
                        _, inverse, times = np.unique(T.mix64(h) + w.doc.astype(np.uint64) * _PAIR[0], return_inverse=True, return_counts=True)
                        gram.append(h.view(np.int64))
                        own.append(times[inverse])
                    g, o = np.stack(gram, axis=1), np.stack(own, axis=1)
                    before, o_before = np.roll(g, 1, axis=0), np.roll(o, 1, axis=0)
                    top = np.minimum(at + 1, order)
                    longest = g[np.arange(len(top)), top - 1]
                    by = np.lexsort((longest, top, w.doc))
                    head = np.flatnonzero(np.append(True, (np.diff(w.doc[by]) != 0) | (np.diff(top[by]) != 0) | (longest[by][1:] != longest[by][:-1])))
                    times, pick = np.diff(np.append(head, len(by))), by[head]
                    edge = pa.array(np.arange(len(pick) + 1) * order, pa.int32())
                    lists = [pa.ListArray.from_arrays(edge, pa.array(np.ascontiguousarray(x[pick]).ravel())) for x in (g, o, before, o_before)]
                    yield pa.RecordBatch.from_arrays([pa.array(row + w.doc[pick]), names.slice(i, j - i).take(pa.array(w.doc[pick])), pa.array(top[pick], pa.int32()), pa.array(times), *lists], _TABLE)
                row += j - i

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stash(docs.select("doc_id", "text").mapInArrow(explode, f"row long, doc_id {kind}, top int, times long, g array<long>, own array<long>, c array<long>, cown array<long>"), "grams")
    grams = rows.where("top > 0").drop("doc_id")
    # a position has an n-gram of each length up to its top
    each = grams.select("times", F.posexplode(F.slice("g", 1, F.col("top"))).alias("k", "h"))
    counts = stash(each.groupBy("h").agg(F.sum("times").alias("n")), "counts")
    meta = rows.where("top = 0").select("row", "doc_id", F.col("times").alias("n_words"))
    total = meta.agg(F.sum("n_words")).first()[0] or 0
    todo, parts = grams.withColumn("back", F.lit(0)), []
    for k in range(order, 1, -1):
        met = todo.where(F.col("top") >= k).join(counts.withColumnRenamed("h", "gk"), F.element_at("g", k) == F.col("gk")).withColumn("others", F.col("n") - F.element_at("own", k)).drop("n", "gk")
        met = stash(met, "met")
        found = met.where("others > 0").join(counts.withColumnRenamed("h", "ck"), F.element_at("c", k - 1) == F.col("ck"))
        gain = F.ln("others") - F.ln(F.greatest(F.col("n") - F.element_at("cown", k - 1), F.lit(1))) + F.col("back") * F.lit(math.log(alpha))
        parts.append(found.select("row", (F.col("times") * gain).alias("s"), F.lit(0).cast("long").alias("low")))
        todo = todo.where(F.col("top") < k).unionByName(met.where("others <= 0").drop("others").withColumn("back", F.col("back") + 1))
    last = todo.join(counts.withColumnRenamed("h", "gk"), F.element_at("g", 1) == F.col("gk"))
    gain = F.ln(F.greatest(F.col("n") - F.element_at("own", 1), F.lit(1))) + F.col("back") * F.lit(math.log(alpha))
    parts.append(last.select("row", (F.col("times") * gain).alias("s"), F.col("times").alias("low")))
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    sums = sums.groupBy("row").agg(F.sum("s").alias("s"), F.sum("low").alias("low"))
    score = F.col("s") - F.col("low") * F.ln(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)))
    return meta.join(sums, "row", "left").select("doc_id", "n_words", score.alias("score"), (score / F.col("n_words")).alias("mean"))


_TABLE = ["row", "doc_id", "top", "times", "g", "own", "c", "cown"]

#: DuckDB: the same scores, rounded as the query rounds them.
ORACLE = r"""
WITH t AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM t),
p AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w),
cw AS (SELECT w, count(*) AS n FROM w GROUP BY w), dw AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
cp AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY ALL), dp AS (SELECT doc_id, v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY ALL),
tot AS (SELECT count(*) AS n FROM w), dn AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
s AS (SELECT p.doc_id, CASE
    WHEN p.v IS NOT NULL AND cp.n - dp.n > 0 THEN ln(cp.n - dp.n) - ln(greatest(cv.n - dv.n, 1))
    ELSE CASE WHEN p.v IS NULL THEN 0 ELSE ln(0.4) END + ln(greatest(cw.n - dw.n, 1)) - ln(greatest(tot.n - dn.n, 1)) END AS s
  FROM p JOIN cw ON cw.w = p.w JOIN dw ON dw.doc_id = p.doc_id AND dw.w = p.w JOIN dn ON dn.doc_id = p.doc_id, tot
  LEFT JOIN cp ON cp.v = p.v AND cp.w = p.w LEFT JOIN dp ON dp.doc_id = p.doc_id AND dp.v = p.v AND dp.w = p.w
  LEFT JOIN cw cv ON cv.w = p.v LEFT JOIN dw dv ON dv.doc_id = p.doc_id AND dv.w = p.v)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, round(sum(s.s), 4) AS score, round(sum(s.s) / len(t.ws), 6) AS mean
FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id, t.ws
"""
