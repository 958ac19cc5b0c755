"""Near-duplicate documents by min-max hashing.

Each hash function gives two signature values, the least and the greatest hash of a
document's shingle set, so ``N_HASHES`` evaluations give twice as many values.  They are
cut into bands of as many rows as leave a pair at the threshold without a common band with
probability MISS at most; documents that agree in a band are candidates, and every link is
confirmed on the full shingle sets.

1. Documents of one shingle set become one node (the least doc_id), found by a combined
   minimum over the set's digest: copies never meet in pairs.
2. In each band bucket all nodes are compared with one only, its hub: the node that shares
   most buckets with others.
3. Buckets whose nodes still lie in several components are compared across components, in
   blocks of bounded size.  Blocks hold ids, bands and a byte of each signature value; pairs
   of other components that may be similar by those (see ``promising``) name the nodes whose
   texts are needed, and these meet once more, in blocks again, where links found on the way
   spare further comparisons.  Only confirmed links leave a block.  So no link between
   different sets is lost.
4. Components of the confirmed links.

A pair at the threshold misses all bands with probability 8e-7 at 0.85 (24 bands of 5) and
1.4e-7 at 0.80 (30 bands of 4); step 3 passes over one with less than 1e-6.  Where many
sets are similar in part but not enough, step 3 takes time with the square of a bucket.

Cases: a document without words or text has an empty set and is linked with nothing
(component_id = doc_id).  A row whose doc_id is null takes no part: component_id null,
kept true.  Repeated rows give one row each.  Different texts filed under one doc_id are
one document: what is linked with one of them is linked with all.  Ties go to the smaller
doc_id.  Extra columns pass through ``keep_one`` untouched.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._graph import components
from ._keys import with_least
from ._store import drop, stash

N_HASHES = 60
#: Greatest probability that a pair at the threshold has no common band.
MISS = 1e-6
#: Nodes of one bucket that one task compares with one another at once, by signature and by text.
BLOCK, TEXT_BLOCK = 2048, 512
#: Nodes of small buckets that one task takes together, about.
DEAL = 4000

_MULT = T.stream64(501, N_HASHES) | np.uint64(1)
_PLUS = T.stream64(502, N_HASHES)
_FOLD = T.stream64(503, 2 * N_HASHES) | np.uint64(1)
_SALT = T.stream64(504, 2 * N_HASHES)


def _sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    words = T.words_of(data, bounds, T.NONSPACE)
    return T.distinct_by_doc(*T.shingles_of(words, k), words.n_docs)


def band_rows(percent: int) -> int:
    """Most rows of a band that keep to MISS at this similarity."""
    values = 2 * N_HASHES
    ok = [r for r in range(1, values) if (1 - (percent / 100) ** r) ** (values // r) <= MISS]
    return max(ok, default=1)


def signatures(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Signature values (values x documents) of the non-empty sets."""
    full = np.flatnonzero(np.diff(edge))
    heads = edge[:-1][full]
    sig = np.empty((2 * N_HASHES, len(full)), dtype=np.uint64)
    for i in range(N_HASHES):
        v = (h * _MULT[i] + _PLUS[i]) >> np.uint64(20)
        sig[2 * i] = np.minimum.reduceat(v, heads)
        sig[2 * i + 1] = np.maximum.reduceat(v, heads)
    return T.mix64(sig)


def bands_of(sig: np.ndarray, rows: int) -> np.ndarray:
    """Band keys (documents x bands) of mixed signature values."""
    n = len(sig) // rows
    out = np.empty((sig.shape[1], n), dtype=np.uint64)
    for b in range(n):
        out[:, b] = T.mix64((sig[b * rows : (b + 1) * rows] * _FOLD[:rows, None]).sum(axis=0, dtype=np.uint64) + _SALT[b])
    return out


def features(docs: DataFrame, shingle: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (binary, of the set), bands (array of long), sketch (a byte of
    each signature value), row for row."""
    n_bands = 2 * N_HASHES // rows

    @T.tidy
    def scan(batches):
        for batch in batches:
            data, bounds = T.buffers(batch.column("text"))
            for i, j in T.slices(bounds):
                h, edge = _sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle)
                n = np.diff(edge)
                full = np.flatnonzero(n)
                digest, keys, sketch = np.zeros((j - i, 2), dtype=np.uint64), np.zeros(0, np.int64), [b""] * (j - i)
                if len(full):
                    sig = signatures(h, edge)
                    keys = bands_of(sig, rows).view(np.int64).ravel()
                    for k, x in zip(full.tolist(), np.ascontiguousarray(sig.T.astype(np.uint8)), strict=True):
                        sketch[k] = x.tobytes()
                    for c in (0, 1):
                        digest[full, c] = np.add.reduceat(T.mix64(h + np.uint64(7 + c)), edge[:-1][full])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in digest], pa.binary()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, n_bands, 0))]), pa.int32()), pa.array(keys, pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def promising(percent: int) -> int:
    """Least number of equal sketch bytes of a pair that may be similar: five deviations below
    what the threshold lets expect (a minimum and a maximum of one hash fall together less
    often than two hashes, so the deviation is no larger than that of as many hashes)."""
    s, n = percent / 100, 2 * N_HASHES
    return int(n * s - 5 * (n * s * (1 - s)) ** 0.5)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar.  A hub's text meets its many
    pairs in a join that adaptive execution may split."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    @T.tidy
    def check(batches):
        held: OrderedDict = OrderedDict()

        def sets(column: pa.Array, ids: pa.Array) -> list[np.ndarray]:
            """Sets of a column's texts; the last few nodes' are kept."""
            ids = ids.to_pylist()
            new = list({n: k for k, n in enumerate(ids) if n not in held}.items())
            own = {n: held[n] for n in set(ids) if n in held}
            if new:
                data, bounds = T.buffers(column.take(pa.array([k for _, k in new], pa.int64())))
                for i, j in T.slices(bounds):
                    h, edge = _sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle)
                    for k in range(i, j):
                        own[new[k][0]] = h[edge[k - i] : edge[k - i + 1]].copy()
            for n in list(dict.fromkeys(ids))[-8:]:
                held[n] = own[n]
            while len(held) > 16:
                held.popitem(last=False)
            return [own[n] for n in ids]

        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                ok = [similar(x, y, percent) for x, y in zip(sets(batch.column("ta"), batch.column("a")), sets(batch.column("tb"), batch.column("b")), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(check, "a long, b long")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """members (key, n: the bucket's size, node, ...) once for each other block of their bucket;
    mine: a node's own block, lo and hi: the pair of blocks; deal: buckets of one block are dealt
    out many at a time."""
    deals = max(1, members.count() // DEAL)
    own = members.withColumn("k", F.ceil(F.col("n") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    own = own.withColumn("deal", F.when(F.col("k") == 1, F.pmod(F.xxhash64("key"), F.lit(deals))).otherwise(F.col("key")))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return spread.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other", "k", "n")


def _pairs(df, lo: int, hi: int, least: int):
    """Arrays (i, j) of rows (sorted by key and node) of one bucket, one of either block, that
    lie in different components, have ``least`` sketch bytes in common, and of whose common
    bands this bucket is the first.  The s-th step takes rows that lie s apart."""
    bands, sketch = np.stack(df.bands.to_numpy()), np.frombuffer(b"".join(df.sketch), np.uint8).reshape(len(df), -1)
    key, node, comp, mine = (df[c].to_numpy() for c in ("key", "node", "component", "mine"))
    live = np.arange(len(df))
    for s in range(1, len(df)):
        live = live[live + s < len(df)]
        live = live[key[live] == key[live + s]]
        if not len(live):
            return
        ok = (comp[live] != comp[live + s]) & (node[live] != node[live + s])
        if lo != hi:
            ok &= mine[live] != mine[live + s]
        i = live[ok]
        for at in range(0, len(i), 1 << 14):
            a = i[at : at + (1 << 14)]
            a = a[(sketch[a] == sketch[a + s]).sum(axis=1) >= least]
            if len(a):
                same = bands[a] == bands[a + s]
                a = a[bands[a, same.argmax(axis=1)] == key[a]]
                yield a, a + s


def _across(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between nodes of one bucket that lie in different components.
    members: key, n (the bucket's size), node, component, bands, sketch; texts: node, text.
    A pair is looked at in the first of its common buckets only."""
    least = promising(percent)

    def wanted(key, df):
        import pandas as pd

        df = df.sort_values(["key", "node"]).reset_index(drop=True)
        found = np.zeros(len(df), bool)
        for i, j in _pairs(df, key[1], key[2], least):
            found[i] = found[j] = True
        return pd.DataFrame({"key": df.key[found], "node": df.node[found]}).astype("int64")

    some = stash(_blocks(members, BLOCK).groupBy("deal", "lo", "hi").applyInPandas(wanted, "key long, node long").distinct(), "wanted")
    sized = some.join(some.groupBy("key").agg(F.count("*").alias("n")), "key")
    rows = stash(sized.join(members.drop("n"), ["key", "node"]), "wanted")

    def links(key, df):
        import pandas as pd

        df = df.sort_values(["key", "node", "text"]).reset_index(drop=True)
        node, comp, texts, root = df.node.to_numpy(), df.component.to_numpy(), df.text.tolist(), {}
        sets: dict[int, np.ndarray] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        def of(i: int) -> np.ndarray:
            if i not in sets:
                data, bounds = T.buffers(pa.array([texts[i]], pa.large_string()))
                sets[i] = _sets(data, bounds, shingle)[0]
            return sets[i]

        out: list[tuple[int, int]] = []
        for left, right in _pairs(df, key[1], key[2], least):
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                x, y = find(comp[i]), find(comp[j])
                if x != y and similar(of(i), of(j), percent):
                    root[max(x, y)] = min(x, y)
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return _blocks(rows, TEXT_BLOCK).join(texts, "node").groupBy("deal", "lo", "hi").applyInPandas(links, "a long, b long").distinct()


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    feats = stash(features(docs, shingle, band_rows(percent)), "feats")
    full = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    met = with_least(feats.where(full), "digest", "doc_id", "node")
    first = F.col("doc_id") == F.col("node")
    met = met.select("doc_id", "n_shingles", "node", F.when(first, F.col("bands")).alias("bands"), F.when(first, F.col("sketch")).alias("sketch"))
    lone = feats.where(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("node"))
    met = stash(met.unionByName(lone, allowMissingColumns=True), "met")
    drop(feats)
    placed = met.select("doc_id", "n_shingles", "node")
    # a doc_id of several texts may stand for several sets
    reps = met.where("bands IS NOT NULL").select("node", "bands", "sketch").distinct()
    keyed = reps.select("node", F.explode("bands").alias("key")).distinct()
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least < most").select("key", "n")
    shared = stash(keyed.join(buckets, "key"), "shared")
    # a bucket's hub is the node that meets most others over all its buckets
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("neg"))).alias("hub")).select("key", (-F.col("hub.neg")).alias("hub"))
    pairs = stash(shared.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = stash(docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("text IS NOT NULL").join(ids.hint("merge"), "node", "left_semi").distinct(), "texts")  # one strategy at every size
    links = confirm(pairs, texts, shingle, percent).distinct()
    # texts of one doc_id are one document
    several = placed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").drop("most")
    links = stash(links.unionByName(several.join(placed, "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct()), "links")
    found = stash(components(links), "found")
    # what is left: buckets over several components
    label = shared.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    open_ = label.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    rest = stash(label.join(open_, "key").join(reps, "node"), "rest")
    more_links = stash(_across(rest, texts, shingle, percent), "links")
    drop(texts, shared, pairs, rest)
    if more_links.isEmpty():
        final = found
    else:
        final = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more_links))
    out = placed.join(final, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one of the least doc_id.  Rows without
    a doc_id stay; of rows that repeat a doc_id one stays (the least text, then the least
    digest of the row)."""
    gone = groups(docs, shingle, percent).where("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    named = kept.where("doc_id IS NOT NULL")
    many = named.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    again = named.join(many, "doc_id", "left_semi")
    one = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias("__row")).select("__row.*")
    return kept.join(many, "doc_id", "left_anti").unionByName(one).select(docs.columns)
