"""Quality classifier: a generalised additive model with pairwise interactions.

    logit P(good) = b + sum_i f_i(x_i) + sum_(i,j) f_ij(x_i, x_j)

Each f is a lookup table over quantile bins.  The tables are learned by boosting shallow
trees cyclically: one small step per feature and round, then the same over the pairs that
explain most of what is left.  Scoring adds table cells, vectorised over documents.

Features come from the text alone (byte shares, word, line and repetition statistics of
the whole text).  Fitting takes at most about ``TRAIN_ROWS`` labelled rows, chosen by a
hash; features and scores cover every document.

Cases: null text is an empty one and gets the score of its (zero) features.  A null
doc_id is never held out and has no label.  Several labels of one doc_id are averaged and
count as 1 from one half up; null labels are none.  Rows that repeat a labelled doc_id
are learned from once.  With labels of one class only, or
none, every document gets that class's share (or 0.5).  Repeated rows are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import stash

#: Labelled rows that fitting takes, about.
TRAIN_ROWS = 20_000
#: Bytes of text whose features are computed at once.
SLICE = 1 << 18
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, L2 = 300, 100, 0.08, 2.0

NAMES = ("log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "wide", "marks", "symbols", "bangs", "pipes", "newlines", "commas", "stops", "entropy", "distinct_words", "distinct_pairs", "repeated_lines", "line_length", "short_words", "top_word", "brackets")

_SETS = {
    "upper": range(65, 91), "digits": range(48, 58), "wide": range(128, 256), "marks": b"!\"'(),-.:;?", "symbols": b"#$%&*+/<=>@\\^_`|~",
    "bangs": b"!", "pipes": b"|", "newlines": b"\n", "commas": b",", "stops": b".", "brackets": b"[]{}()<>",
}
_NOT_NEWLINE = ~T._members((0x0A, 0x0A), (0x0D, 0x0D))


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Feature rows of a slice of documents."""
    d = len(bounds) - 1
    size = np.diff(bounds)
    hist = np.bincount(np.repeat(np.arange(d), size) * 256 + data, minlength=d * 256).reshape(d, 256)
    safe = np.maximum(size, 1)[:, None]
    share = hist / safe
    words = T.words_of(data, bounds, T.NONSPACE)
    n = words.counts() if len(words.hash) else np.zeros(d, np.int64)
    length = words.end - words.start
    some = np.maximum(n, 1)

    def per(x: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, weights=x, minlength=d) if len(x) else np.zeros(d)

    def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of each document over all, and the largest count."""
        if not len(h):
            return np.ones(d), np.zeros(d)
        key = np.sort((h & ~np.uint64(0xFFFFF)) | (doc.astype(np.uint64) & np.uint64(0xFFFFF)))
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        own = (key[head] & np.uint64(0xFFFFF)).astype(np.int64)
        most = np.zeros(d)
        np.maximum.at(most, own, np.diff(np.append(head, len(key))))
        all_ = np.bincount(doc, minlength=d)
        return np.where(all_ > 0, np.bincount(own, minlength=d) / np.maximum(all_, 1), 1.0), most / np.maximum(all_, 1)

    longest = np.zeros(d)
    if len(length):
        np.maximum.at(longest, words.doc, length)
    lines = T.words_of(data, bounds, _NOT_NEWLINE)
    n_lines = lines.counts() if len(lines.hash) else np.zeros(d, np.int64)
    two = T.shingle_hashes(words.hash, 2)
    same = words.doc[: len(two)] == words.doc[1:] if len(two) else np.zeros(0, bool)
    word_share, top = distinct(words.hash, words.doc)
    columns = {k: share[:, np.array(list(v))].sum(axis=1) for k, v in _SETS.items()}
    columns |= {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n), "word_length": per(length) / some, "longest_word": np.log1p(longest),
        "entropy": -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1), "distinct_words": word_share, "distinct_pairs": distinct(two[same], words.doc[: len(two)][same])[0],
        "repeated_lines": 1 - distinct(lines.hash, lines.doc)[0], "line_length": np.log1p(size / np.maximum(n_lines, 1)), "short_words": per(length <= 3) / some, "top_word": top,
    }
    return np.stack([columns[k] for k in NAMES], axis=1)


@dataclass
class Gam:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if self.cuts:
            bins = _binned(x, self.cuts)
            for i, t in enumerate(self.tables):
                z += t[bins[:, i]]
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                z += t[_coarse(bins[:, i], len(self.cuts[i])), _coarse(bins[:, j], len(self.cuts[j]))]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)], axis=1)


def _coarse(b: np.ndarray, n_cuts: int) -> np.ndarray:
    return b * PAIR_BINS // (n_cuts + 1)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton values of a tree of at most three leaves over ordered bins."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))

    def gain(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        if not len(at):
            return 0.0, a
        left, right = (cg[at] - cg[a]) ** 2 / (ch[at] - ch[a] + L2), (cg[b] - cg[at]) ** 2 / (ch[b] - ch[at] + L2)
        k = int(np.argmax(left + right))
        return float((left + right)[k] - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + L2)), int(at[k])

    edges = [0, len(g)]
    for _ in range(2):
        best = max(((*gain(a, b), i) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))), key=lambda x: x[0])
        if best[0] <= 0:
            break
        edges.insert(best[2] + 1, best[1])
    out = np.zeros(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + L2)
    return out


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton values of the best tree with one cut on each axis, and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n = PAIR_BINS
    best, out = 0.0, np.zeros((n, n))
    for a in range(1, n):
        b = np.arange(1, n)
        gs = np.stack([cg[a, b], cg[a, n] - cg[a, b], cg[n, b] - cg[a, b], cg[n, n] - cg[a, n] - cg[n, b] + cg[a, b]])
        hs = np.stack([ch[a, b], ch[a, n] - ch[a, b], ch[n, b] - ch[a, b], ch[n, n] - ch[a, n] - ch[n, b] + ch[a, b]])
        gain = (gs**2 / (hs + L2)).sum(axis=0)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, v = float(gain[k]), gs[:, k] / (hs[:, k] + L2)
            out = np.empty((n, n))
            out[:a, : b[k]], out[:a, b[k] :], out[a:, : b[k]], out[a:, b[k] :] = v
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Learn the tables from feature rows and 0/1 labels."""
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Gam(float(np.log(share / (1 - share))))
    share = y.mean()
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = _binned(x, cuts)
    size = [len(c) + 1 for c in cuts]
    gam = Gam(float(np.log(share / (1 - share))), cuts, [np.zeros(s) for s in size])
    z = np.full(len(y), gam.base)
    for _ in range(ROUNDS):
        for i in range(x.shape[1]):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(bins[:, i], y - p, size[i]), np.bincount(bins[:, i], p * (1 - p), size[i]))
            gam.tables[i] += step
            z += step[bins[:, i]]
    coarse = np.stack([_coarse(bins[:, i], len(cuts[i])) for i in range(x.shape[1])], axis=1)

    def grid(i: int, j: int, z: np.ndarray) -> tuple[np.ndarray, float]:
        p, key = 1 / (1 + np.exp(-z)), coarse[:, i] * PAIR_BINS + coarse[:, j]
        shape = (PAIR_BINS, PAIR_BINS)
        return _grid(np.bincount(key, y - p, PAIR_BINS**2).reshape(shape), np.bincount(key, p * (1 - p), PAIR_BINS**2).reshape(shape))

    ranked = sorted(((-grid(i, j, z)[1], i, j) for i in range(x.shape[1]) for j in range(i)))
    gam.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    gam.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in gam.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(gam.pairs):
            step = RATE * grid(i, j, z)[0]
            gam.pair_tables[k] += step
            z += step[coarse[:, i], coarse[:, j]]
    return gam


def held_out(column: str = "doc_id"):
    """crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of features), row for row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @T.tidy
    def scan(batches):
        for batch in (x for whole in batches for x in T.parts(whole)):
            data, bounds = T.buffers(batch.column("text"))
            for i, j in T.slices(bounds, SLICE):
                x = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, x array<double>")


def chosen(labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, y of labelled documents that are not held out: ``train_rows``, about."""
    own = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).where(~held_out())
    share = min(1.0, train_rows / max(own.count(), 1))
    return own.where(F.pmod(F.xxhash64("doc_id", F.lit("gam")), F.lit(1 << 30)) < share * (1 << 30))


def train(table: DataFrame, own: DataFrame) -> Gam:
    """The model, from the rows of a feature table that ``chosen`` names.  Rows that repeat a
    doc_id count as one, that of the least features, so what is gathered stays bounded."""
    rows = table.join(own, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas()
    if not len(rows):
        return Gam(0.0)
    rows = rows.sort_values("doc_id")
    return fit(np.stack(rows.x.to_numpy()), rows.y.to_numpy().astype(float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, row for row."""
    table = stash(feature_table(docs), "quality")
    gam = train(table, chosen(labels, train_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @T.tidy
    def scan(batches):
        for batch in batches:
            s = gam.score(batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], ["doc_id", "score", "predicted"])

    return table.mapInArrow(scan, f"doc_id {kind}, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns kept."""
    own = stash(chosen(labels, train_rows), "chosen")  # so many rows, about, so a broadcast holds them
    gam = train(feature_table(docs.join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi")), own)

    @T.tidy
    def keep(batches):
        for batch in (x for whole in batches for x in T.parts(whole)):
            data, bounds = T.buffers(batch.column("text"))
            s = [gam.score(features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])) for i, j in T.slices(bounds, SLICE)]
            yield batch.filter(pa.array(np.concatenate(s) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
