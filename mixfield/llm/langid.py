"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a public tokenizer's pieces (fixed; never trained), plus the 256 single
bytes.  For each language the pieces get probabilities by expectation-maximisation on the
words of labelled documents.  A word's probability sums over all its segmentations by a
forward algorithm; a text's is the product over its words.  The forward pass runs over all
distinct words of a batch at once: one numpy step per (end, length).  Words longer than
``MAX_WORD`` bytes are run through one by one, with the same sums.  Both scale as they go,
so no probability falls to 0.

Training takes at most about ``TRAIN_DOCS`` labelled documents of each of the ``MAX_LANGS``
most frequent languages (those whose hash falls under that share; languages of as many
documents go by name); word counts are combined in Spark, and each language is fitted in a
task of its own.  Languages of fewer documents are fitted on all they have.  There, and only
there, words longer than MAX_WORD count in parts of that length.

Cases: null text, or one without a letter, gives ``und`` with score 0.  Ties go to the
language first in sorted order.  With no labelled document at all every text is ``und``.
Rows are scored one by one, over whole words of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Labelled documents of a language that training takes, about, and languages at most.
TRAIN_DOCS, MAX_LANGS = 2000, 256
#: Bytes of the longest word of the pass over many words.
MAX_WORD = 48
#: Factor per byte that keeps sums of up to MAX_WORD bytes inside the range of a double.
SCALE = 1e4
#: Bytes from which few pieces are left, which their first bytes tell.
STEM = 12
ROUNDS = 4
FLOOR = 1e-7
_MUL = np.uint64(0x100000001B3)
_CACHE = 400_000


def pieces_of(model: str) -> list[bytes]:
    """Distinct lower-cased letter pieces of a sentencepiece vocabulary, and all bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            raw = sp.id_to_piece(i).replace("▁", "").encode().lower()
            if raw and T.LETTERS[np.frombuffer(raw, np.uint8)].all():
                out.add(raw)
    return sorted(out)


def _key(raw: bytes) -> int:
    h = 0
    for b in raw:
        h = (h * int(_MUL) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Pieces:
    """Keys of the pieces, by the recurrence that Lattice uses; their order; the longest one's
    bytes; and the (unmixed) keys of the first STEM bytes of longer ones."""

    keys: np.ndarray
    order: np.ndarray
    longest: int
    stems: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        keys = T.mix64(np.array([_key(p) for p in pieces], dtype=np.uint64))
        stems = np.array(sorted({_key(p[:STEM]) for p in pieces if len(p) > STEM}), dtype=np.uint64)
        return cls(keys, np.argsort(keys), max(map(len, pieces)), stems)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each (unmixed) key, or -1."""
        m = T.mix64(h)
        at = self.order[np.minimum(np.searchsorted(self.keys, m, sorter=self.order), len(self.keys) - 1)]
        return np.where(self.keys[at] == m, at, -1)


class Lattice:
    """Pieces that end at each byte of each of a set of words of at most MAX_WORD bytes."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        self.n, self.size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        top = int(self.size.max())
        self.top = top
        chars = np.zeros((self.n, top), dtype=np.uint64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(self.n), self.size)
        chars[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = flat
        self.edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # start, end, words, piece
        for s in range(top):
            live = np.flatnonzero(self.size > s)
            h = np.zeros(len(live), dtype=np.uint64)
            for e in range(s + 1, min(top, s + pieces.longest) + 1):
                ok = self.size[live] >= e
                live, h = live[ok], h[ok]
                if not len(live):
                    break
                h = h * _MUL + chars[live, e - 1] + np.uint64(1)
                found = pieces.find(h)
                hit = found >= 0
                if hit.any():
                    self.edges.append((s, e, live[hit], found[hit]))
                if e - s == STEM:
                    ok = np.isin(h, pieces.stems)
                    live, h = live[ok], h[ok]

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[word, end, language] for piece probabilities (piece, language), each byte
        times SCALE."""
        alpha = np.zeros((self.n, self.top + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for s, e, w, p in self.edges:  # by start: alpha of a start is complete
            alpha[w, e] += alpha[w, s] * (prob[p] * SCALE ** (e - s))
        return alpha

    def log_total(self, prob: np.ndarray) -> np.ndarray:
        """ln of the probability of each word under each language."""
        return np.log(self.forward(prob)[np.arange(self.n), self.size]) - (self.size * np.log(SCALE))[:, None]

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, for one language."""
        alpha = self.forward(prob[:, None])[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.size] = 1
        z = alpha[np.arange(self.n), self.size]
        scale = weight / z
        out = np.zeros(len(prob))
        for s, e, w, p in reversed(self.edges):  # by start from the last: beta of an end is complete
            part = prob[p] * SCALE ** (e - s) * beta[w, e]
            beta[w, s] += part
            out += np.bincount(p, weights=alpha[w, s] * part * scale[w], minlength=len(prob))
        return out


def long_word(word: bytes, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """ln of a word's probability under each language, for a word of any length."""
    chars = np.frombuffer(word, np.uint8).astype(np.uint64)
    n = len(chars)
    h, found = np.zeros(n, np.uint64), np.full((pieces.longest, n), -1, np.int64)  # by length and end
    live = np.arange(n)
    for size in range(1, min(pieces.longest, n) + 1):
        live = live[live + size <= n]
        h[live] = h[live] * _MUL + chars[live + size - 1] + np.uint64(1)
        found[size - 1, live + size - 1] = pieces.find(h[live])
        if size == STEM:
            live = live[np.isin(h[live], pieces.stems)]
        if not len(live):
            break
    end, size = np.nonzero(found.T >= 0)
    piece = found[size, end]
    heads = np.searchsorted(end, np.arange(n + 1)).tolist()
    # sums of the last ends, relative to 2 ** shift
    width = pieces.longest + 1
    held, shift = np.zeros((width, prob.shape[1])), np.zeros(prob.shape[1])
    held[0] = 1
    for e in range(n):
        i, j = heads[e], heads[e + 1]
        now = (held[(e - size[i:j]) % width] * prob[piece[i:j]]).sum(axis=0)
        held[(e + 1) % width] = now
        if e % 16 == 15:
            top = held.max(axis=0)
            held /= top
            shift += np.log(top)
    return np.log(held[n % width]) + shift


def _cut(word: bytes) -> list[bytes]:
    return [word[i : i + MAX_WORD] for i in range(0, len(word), MAX_WORD)]


def fit_language(words: list[bytes], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Piece probabilities by EM from word counts; every piece keeps at least FLOOR."""
    keys = pieces.keys
    prob = np.full(len(keys), 1.0 / len(keys))
    parts = [p for w in words for p in _cut(w)]
    weight = np.repeat(counts, [len(_cut(w)) for w in words]).astype(float)
    by = np.argsort([len(p) for p in parts], kind="stable")
    for _ in range(ROUNDS):
        expected = np.zeros(len(keys))
        for i in range(0, len(by), 20_000):
            at = by[i : i + 20_000]
            expected += Lattice([parts[k] for k in at], pieces).expected(prob, weight[at])
        prob = expected / max(expected.sum(), 1e-300)
        prob = np.maximum(prob, FLOOR)
        prob /= prob.sum()
    return prob


def _count_words(column: pa.Array) -> dict[bytes, int]:
    data, bounds = T.buffers(column)
    out: dict[bytes, int] = {}
    for i, j in T.slices(bounds):
        w = T.words_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], T.LETTERS)
        _, at, n = np.unique(w.hash, return_index=True, return_counts=True)
        for k, c in zip(at, n, strict=True):
            b = w.bytes_at(k).lower()
            out[b] = out.get(b, 0) + int(c)
    return out


def train(docs: DataFrame, model: str, train_docs: int = TRAIN_DOCS, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray, Pieces, np.ndarray]:
    """(languages, log priors, pieces, probabilities (piece, language)) from the rows of
    ``docs`` with a lang.  The driver gets max_langs x pieces numbers at most."""
    pieces = Pieces.of(pieces_of(model))
    n = len(pieces.keys)
    own = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    have = {r[0]: r[1] for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    langs = sorted(have)
    if not langs:
        return [], np.zeros(0), pieces, np.zeros((n, 0))
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, train_docs / have[x])) for x in langs], "lang string, share double")  # max_langs rows
    chosen = own.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")

    def count(batches):
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                got = _count_words(batch.filter(pa.compute.equal(batch.column("lang"), lang)).column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(got.keys(), pa.binary()), pa.array(got.values(), pa.int64())], ["lang", "word", "n"])

    words = chosen.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(key, t):
        order = pa.compute.sort_indices(t, [("word", "ascending")])
        t = t.take(order)
        prob = fit_language(t["word"].to_pylist(), t["n"].to_numpy(), pieces)
        return pa.table({"lang": pa.array([key[0].as_py()]), "prob": pa.array([prob.tolist()], pa.list_(pa.float64()))})

    fitted = {r.lang: r.prob for r in words.groupBy("lang").applyInArrow(fit, "lang string, prob array<double>").collect()}
    uniform = np.full(n, 1 / n)
    prob = np.stack([np.array(fitted[x]) if x in fitted else uniform for x in langs], axis=1)
    prior = np.log(np.array([have[x] for x in langs]) / sum(have.values()))
    return langs, prior, pieces, prob


class Scorer:
    """ln P of words by language, remembered while the worker lives."""

    def __init__(self, pieces: Pieces, prob: np.ndarray):
        self.pieces, self.prob = pieces, prob
        self.cache: dict[bytes, int] = {}
        self.rows = np.zeros((0, prob.shape[1]))

    def words(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > _CACHE:
            self.cache, self.rows, new = {}, self.rows[:0], list(words)
        if new:
            logs = np.zeros((len(new), self.prob.shape[1]))
            size = np.array([len(w) for w in new])
            by = np.argsort(size, kind="stable")
            by = by[size[by] <= MAX_WORD]
            for i in range(0, len(by), 8000):
                at = by[i : i + 8000]
                logs[at] = Lattice([new[k] for k in at], self.pieces).log_total(self.prob)
            for k in np.flatnonzero(size > MAX_WORD):
                logs[k] = long_word(new[k], self.pieces, self.prob)
            base = len(self.cache)
            self.cache.update({w: base + i for i, w in enumerate(new)})
            self.rows = np.concatenate([self.rows, logs])
        return self.rows[[self.cache[w] for w in words]]


def predict(docs: DataFrame, trained: tuple) -> DataFrame:
    """doc_id, lang_pred, score (posterior probability of lang_pred), row for row."""
    langs, prior, pieces, prob = trained
    held = docs.sparkSession.sparkContext.broadcast((prior, pieces, prob))  # pieces x languages: fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        prior, pieces, prob = held.value
        scorer = Scorer(pieces, prob)
        for batch in batches:
            data, bounds = T.buffers(batch.column("text"))
            texts = batch.column("text")
            for i, j in T.slices(bounds, 2 << 20):
                part = data[bounds[i] : bounds[j]]
                w = T.words_of(part, bounds[i : j + 1] - bounds[i], T.LETTERS)
                name, best = ["und"] * (j - i), np.zeros(j - i)
                if len(w.hash) and langs:
                    _, at, inv = np.unique(w.hash, return_index=True, return_inverse=True)
                    logs = scorer.words([w.bytes_at(k).lower() for k in at])
                    per = np.stack([np.bincount(w.doc, weights=logs[inv, c], minlength=j - i) for c in range(len(langs))], axis=1) + prior
                    top = per.argmax(axis=1)
                    post = 1 / np.exp(per - per.max(axis=1, keepdims=True)).sum(axis=1)
                    ascii_letter = np.zeros(len(part), bool) if not len(part) else T.LETTERS[part] & (part < 128)
                    has = np.bincount(np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1])), weights=ascii_letter, minlength=j - i) > 0
                    for k in np.flatnonzero(w.counts() > 0):
                        if has[k] or any(c.isalpha() for c in texts[i + k].as_py()):
                            name[k], best[k] = langs[top[k]], post[k]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(name, pa.string()), pa.array(best, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, lang_pred string, score double")
