"""Approximate nearest neighbours by balanced posting lists.

Inner products are turned into distances by one more coordinate, sqrt(M^2 - |x|^2) for the
largest norm M (0 for a query), which keeps their order.  Centroids are fitted on a
bounded sample by Lloyd rounds in which large lists pay.  Every vector goes to the posting
list of its nearest centroid; one near a boundary goes to up to ``REPLICAS`` lists, those
within ``REPLICA_RATIO`` of the least distance whose centroids are not closer to one another
than neighbouring centroids usually are.

Centroids are searched by a walk over a graph in memory, in which each is joined to its
``DEGREE`` nearest ones.  Which lists a query probes is measured, not set: the exact
neighbours of ``TRIALS`` queries are found by a pass over all vectors; the least number of
nearest lists that holds ``RECALL`` of them bounds the walk, and lists whose distance exceeds
the least one by more than nearly all of those neighbours need (``PRUNED``) are pruned.  On
vectors without clusters that leaves a large share of all lists.

Lists whose centroids are close form a group; a query is sent once to each group with a
probed list, together with the numbers of those lists, and scans them only.  Large groups
are cut into blocks of ``BLOCK`` rows and many queries of one group into blocks too, so a
list that holds a third of all vectors is spread.

Scores are the inner products of the original vectors in double precision, summed the same
way for every pair, so that equal vectors tie exactly and the smaller vec_id wins.

Cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part.  Rows of a null vec_id take no part; rows that repeat
a vec_id count once per distinct vector, the better one.  Of equal vectors a block looks at
the k + 1 of least vec_id, as no others can be among the k nearest.  Fewer candidates than
k give all of them: a query probes further lists until they hold k other ids.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import stash

#: Vectors that fitting takes, about, and centroids at most (both bound the driver).
SAMPLE, MAX_LISTS = 40_000, 16_384
LIST_ROWS = 64
REPLICAS, REPLICA_RATIO = 4, 1.06
#: Neighbours of a centroid in the graph, entry points of a walk, and its least beam.
DEGREE, ENTRIES, BEAM = 24, 32, 32
#: The share of true neighbours of the trial queries that the nearest lists hold, the share of
#: these that pruning by distance ratio keeps, and the trial queries.
RECALL, PRUNED, TRIALS = 0.95, 0.995, 256
#: Groups that lists fall into, about, and lists of a group at least and at most.
GROUPS, GROUP_LISTS = 16, (4, 64)
BLOCK, QUERY_BLOCK = 16_384, 2048
#: Values of a matrix product that a task holds at once.
CELLS = 1 << 22


@dataclass
class Index:
    centroids: np.ndarray
    group: np.ndarray
    norm2: float
    edges: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # neighbours, one after another
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where those of each begin
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    gap: float = 0.0

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    def near(self, x: np.ndarray, want: int):
        """The ``want`` nearest centroids of each row, nearest first, and their squared
        distances, in slices of rows, from all distances."""
        c2 = (self.centroids * self.centroids).sum(axis=1)
        want, step = min(want, len(c2)), max(1, CELLS // len(c2))
        for i in range(0, len(x), step):
            y = x[i : i + step]
            d = c2[None] - 2 * y @ self.centroids.T
            at = np.argpartition(d, want - 1, axis=1)[:, :want]
            own = np.take_along_axis(d, at, axis=1)
            by = np.argsort(own, axis=1, kind="stable")
            yield np.take_along_axis(at, by, axis=1), np.maximum(np.take_along_axis(own, by, axis=1) + (y * y).sum(axis=1)[:, None], 0)

    def walk(self, x: np.ndarray, want: int):
        """The same by a best-first walk over the graph, many rows at a time: each keeps a beam of
        the nearest centroids met and visits the neighbours of those not yet left."""
        c2 = (self.centroids * self.centroids).sum(axis=1)
        n = len(c2)
        want = min(want, n)
        beam = min(max(want, BEAM), n)
        at_once = 8
        step = max(1, CELLS // (self.centroids.shape[1] * DEGREE * 2 * at_once))
        for i in range(0, len(x), step):
            y = x[i : i + step]
            met = np.zeros((len(y), n), bool)
            met[:, self.entries] = True
            ids = np.full((len(y), beam), -1, np.int64)
            far = np.full((len(y), beam), np.inf)
            left = np.ones((len(y), beam), bool)  # nothing to visit there
            new_ids = np.repeat(self.entries[None].astype(np.int64), len(y), axis=0)
            while True:
                d = np.full(new_ids.shape, np.inf)
                r, k = np.nonzero(new_ids >= 0)
                for top in range(0, len(r), CELLS // 64):
                    a, b = r[top : top + CELLS // 64], k[top : top + CELLS // 64]
                    d[a, b] = c2[new_ids[a, b]] - 2 * (self.centroids[new_ids[a, b]] * y[a]).sum(axis=1)
                ids, far, left = np.concatenate([ids, new_ids], axis=1), np.concatenate([far, d], axis=1), np.concatenate([left, ~np.isfinite(d)], axis=1)
                by = np.argsort(far, axis=1, kind="stable")[:, :beam]
                ids, far, left = (np.take_along_axis(z, by, axis=1) for z in (ids, far, left))
                order = np.argsort(left, axis=1, kind="stable")[:, :at_once]  # nearest that are not left
                live = ~np.take_along_axis(left, order, axis=1)
                if not live.any():
                    break
                np.put_along_axis(left, order, True, axis=1)
                r, k = np.nonzero(live)
                nodes = np.take_along_axis(ids, order, axis=1)[r, k]
                many = self.start[nodes + 1] - self.start[nodes]
                r = np.repeat(r, many)
                around = self.edges[np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[nodes], many)]
                fresh = ~met[r, around]
                pair = np.unique(r[fresh] * np.int64(n) + around[fresh])
                r, around = pair // n, pair % n
                met[r, around] = True
                place = np.arange(len(r)) - np.searchsorted(r, r)
                new_ids = np.full((len(y), max(1, int(place.max(initial=0)) + 1)), -1, np.int64)
                new_ids[r, place] = around
            yield ids[:, :want], np.maximum(far[:, :want] + (y * y).sum(axis=1)[:, None], 0)


def grouped(c: np.ndarray, size: int) -> np.ndarray:
    """A group number for each centroid: halves along the widest direction, to ``size`` at most."""
    out, todo, n = np.zeros(len(c), dtype=np.int32), [np.arange(len(c))], 0
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out[own], n = n, n + 1
            continue
        y = c[own] - c[own].mean(axis=0)
        along = np.argsort(y @ np.linalg.eigh(y.T @ y)[1][:, -1], kind="stable")
        todo += [own[along[: len(own) // 2]], own[along[len(own) // 2 :]]]
    return out


def fit(sample: np.ndarray, n_lists: int, norm2: float, rounds: int = 8) -> Index:
    """Centroids by balanced Lloyd rounds, their groups and their graph.  Distances are held
    in slices of CELLS values."""
    index = Index(np.zeros((0, 0)), np.zeros(0, np.int32), norm2)
    x = index.lift(sample)
    x = np.unique(x, axis=0)  # one vector of many copies is one point
    k = min(n_lists, len(x))
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    weight, step = np.zeros(k), max(1, CELLS // k)
    for _ in range(rounds):
        sums, n = np.zeros_like(c), np.zeros(k)
        for i in range(0, len(x), step):
            y = x[i : i + step]
            d = (c * c).sum(axis=1)[None] - 2 * y @ c.T
            own = (d + weight * d.std()).argmin(axis=1)  # large lists pay, so lists even out
            np.add.at(sums, own, y)
            n += np.bincount(own, minlength=k)
        weight = 0.02 * (n / max(n.mean(), 1) - 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    index = Index(c, grouped(c, min(GROUP_LISTS[1], max(GROUP_LISTS[0], -(-k // GROUPS)))), norm2)
    near = [(ids, far) for ids, far in index.near(c, DEGREE + 1)]
    ids, far = (np.concatenate(z) for z in zip(*near, strict=True))
    # edges both ways, so that each is found from those it is near to; a ring keeps the graph whole
    ring = np.empty(k, np.int64)
    order = np.argsort(index.group, kind="stable")
    ring[order] = np.roll(order, -1)
    one = np.repeat(np.arange(k), ids.shape[1] + 1)
    two = np.concatenate([ids, ring[:, None]], axis=1).ravel()
    edges = np.unique(np.concatenate([one * k + two, two * k + one]))
    one, two = edges // k, edges % k
    index.edges, index.start = two.astype(np.int32), np.searchsorted(one, np.arange(k + 1))
    index.entries = order[np.linspace(0, k - 1, min(ENTRIES, k)).astype(np.int64)].astype(np.int32)
    index.gap = float(np.median(far[:, 1])) if k > 1 else 0.0
    return index


def _usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~bad & some).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


def _stack(column) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.asarray(v, dtype=np.float64) for v in column]))


def _scan(qids: np.ndarray, qs: np.ndarray, ids: np.ndarray, vs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, score): the k best ids of each query, but itself, and all
    that may tie with the last.  An id counts by its best vector."""
    by = np.argsort(ids, kind="stable")
    vs, ids = vs[by], ids[by]
    # of equal vectors, the k + 1 of least id
    same = np.unique(vs, axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    head = np.searchsorted(same[order], np.arange(same.max() + 1))
    few = np.sort(order[np.arange(len(order)) - head[same[order]] <= k])
    vs, ids = vs[few], ids[few]
    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    out = []
    step = max(1, CELLS // len(ids))
    for i in range(0, len(qids), step):
        s = qs[i : i + step] @ vs.T
        s[qids[i : i + step, None] == ids[None]] = -np.inf
        top = s if len(heads) == len(ids) else np.maximum.reduceat(s, heads, axis=1)
        least = np.partition(top, -k, axis=1)[:, -k] if top.shape[1] > k else np.full(len(s), -np.inf)
        row, at = np.nonzero((s >= least[:, None] - 1e-9) & (s > -np.inf))
        out.append((i + row, ids[at], (vs[at] * qs[i + row]).sum(axis=1)))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _kept(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, an id once, ties to the smaller id."""
    by = np.lexsort((-score, ids, row))
    by = by[np.append(True, (np.diff(row[by]) != 0) | (np.diff(ids[by]) != 0))] if len(by) else by
    by = by[np.lexsort((ids[by], -score[by], row[by]))]
    head = np.searchsorted(row[by], row[by])
    return by[np.arange(len(by)) - head < k]


def _frame(qids, row, ids, score, at) -> pd.DataFrame:
    return pd.DataFrame({"query_id": qids[row[at]], "vec_id": ids[at], "score": score[at]})


def _trials(posted: DataFrame, q: DataFrame, index: Index, k: int) -> tuple[int, float]:
    """Nearest lists that a query has to probe, and the distance ratio beyond which they are
    pruned: see the module's text."""
    n_lists = len(index.centroids)
    trial = q.distinct().orderBy(F.xxhash64("vec_id", F.lit("trial")), "vec_id").limit(TRIALS).toPandas().drop_duplicates("vec_id")
    if not len(trial):
        return n_lists, np.inf
    spark = posted.sparkSession
    held = spark.sparkContext.broadcast((trial.vec_id.to_numpy(), _stack(trial.v)))

    def exact(frames):
        for df in frames:
            if len(df):
                row, ids, score = _scan(*held.value, df.vec_id.to_numpy(), _stack(df.v), k)
                yield _frame(held.value[0], row, ids, score, _kept(row, ids, score, k)).merge(df[["vec_id", "list"]], on="vec_id")

    near = posted.mapInPandas(exact, "query_id long, vec_id long, score double, list int")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.collect_set("list").alias("lists"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "lists").collect()
    if not true:
        return n_lists, np.inf
    v = _stack(trial.v)
    ranks, ratios = {}, {}
    at = 0
    for near, far in index.near(np.concatenate([v, np.zeros((len(v), 1))], axis=1), n_lists):
        for c, d in zip(near, far, strict=True):
            ranks[trial.vec_id.iloc[at]], ratios[trial.vec_id.iloc[at]] = np.argsort(c), np.sqrt(d / max(d[0], 1e-300))
            at += 1
    needed = np.array([min(ranks[r.query_id][r.lists]) for r in true])
    want = int(np.sort(needed)[int(np.ceil(RECALL * len(needed))) - 1]) + 1
    own = np.sort([ratios[r.query_id][k] for r, k in zip(true, needed, strict=True) if k < want])
    return want, float(own[int(np.ceil(PRUNED * len(own))) - 1]) + 1e-9


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, n_lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each row of ``queries``
    (vec_id, embedding), which is not its own neighbour."""
    spark = vectors.sparkSession
    x = _usable(vectors)
    widths = x.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)).alias("m")).orderBy(F.desc("n"), "w").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], out)
    width, n, norm2 = widths[0]
    x, q = x.where(F.size("v") == width), _usable(queries).where(F.size("v") == width)
    sample = x.where(F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30)).toPandas().sort_values("vec_id")
    if not len(sample):
        sample = x.limit(1).toPandas()
    index = fit(_stack(sample.v), n_lists or int(min(MAX_LISTS, max(1, n // LIST_ROWS))), norm2)
    held = spark.sparkContext.broadcast(index)  # MAX_LISTS rows at most

    def post(frames):
        """Posting lists of each vector, see the module's text."""
        index = held.value
        for df in frames:
            if len(df):
                lists = []
                for near, far in index.walk(index.lift(_stack(df.v)), REPLICAS * 2):
                    keep = far <= REPLICA_RATIO**2 * far[:, :1]
                    for i in range(1, near.shape[1]):
                        for j in range(i):
                            apart = ((index.centroids[near[:, i]] - index.centroids[near[:, j]]) ** 2).sum(axis=1)
                            keep[:, i] &= ~keep[:, j] | (apart >= index.gap)
                    keep[:, 0] = True
                    keep &= np.cumsum(keep, axis=1) <= REPLICAS
                    lists += [c[own].tolist() for c, own in zip(near, keep, strict=True)]
                out = df.assign(list=lists, main=[c[0] for c in lists]).explode("list").astype({"list": "int32"})
                yield out.assign(main=out.main == out.list)

    # a row that is repeated is posted once
    posted = stash(x.distinct().mapInPandas(post, "vec_id long, v array<double>, list int, main boolean"), "posts")
    want, ratio = _trials(posted.drop("main"), q, index, k)
    # ids that each list adds to those of other lists, at least: MAX_LISTS numbers
    adds = np.zeros(len(index.centroids), np.int64)
    for r in posted.where("main").groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect():
        adds[r[0]] = r[1]
    posted = posted.drop("main")

    def probe(frames):
        """Groups with a probed list, and those lists: the nearest ones, and as many more as it
        takes to meet k other ids."""
        index = held.value
        for df in frames:
            if len(df):
                v = _stack(df.v)
                v = np.concatenate([v, np.zeros((len(v), 1))], axis=1)
                rows = []
                for near, far in index.walk(v, want):
                    for c, own in zip(near, far <= ratio**2 * far[:, :1], strict=True):
                        c = c[own]
                        if adds[c].sum() <= k:
                            c = next(index.near(v[len(rows)][None], len(adds)))[0][0]
                            c = c[: int(np.searchsorted(np.cumsum(adds[c]), k + 1)) + 1]
                        c = np.sort(c)
                        places = index.group[c]
                        rows.append([(int(p), c[places == p].tolist()) for p in np.unique(places)])
                out = df.assign(to=rows).explode("to").reset_index(drop=True)
                yield out.assign(place=out.to.str[0].astype("int32"), lists=out.to.str[1]).drop(columns="to")

    probed = stash(q.distinct().mapInPandas(probe, "vec_id long, v array<double>, place int, lists array<int>"), "probes")
    places = F.broadcast(spark.createDataFrame(list(enumerate(index.group.tolist())), "list int, place int"))
    posted = posted.join(places, "list")

    def blocks(df: DataFrame, size: int) -> dict[int, int]:
        """Blocks of each group: MAX_LISTS numbers at most."""
        return {r[0]: r[1] for r in df.groupBy("place").agg(F.ceil(F.count("*") / size).cast("int")).collect()}

    nv, nq = blocks(posted, BLOCK), blocks(probed, QUERY_BLOCK)
    rows = [(c, nv[c], nq[c]) for c in nv if c in nq]
    if not rows:
        return spark.createDataFrame([], out)
    sizes, again = (F.broadcast(spark.createDataFrame(rows, "place int, nv int, nq int")) for _ in range(2))
    mine = posted.join(sizes, "place").withColumn("bv", F.pmod(F.xxhash64("vec_id"), "nv").cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    asks = probed.join(again, "place").withColumn("bq", F.pmod(F.xxhash64("vec_id"), "nq").cast("int")).withColumn("bv", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))

    def scan(left, right):
        none = np.zeros(0, np.int64)
        best = (none, none, np.zeros(0))
        qids = left.vec_id.to_numpy()
        if len(left) and len(right):
            qs, vs, ids, lists = _stack(left.v), _stack(right.v), right.vec_id.to_numpy(), right.list.to_numpy()
            asked = np.concatenate([np.asarray(z, np.int64) for z in left.lists])
            asker = np.repeat(np.arange(len(left)), left.lists.map(len).to_numpy())
            for c in np.unique(lists):
                who, rows = asker[asked == c], np.flatnonzero(lists == c)
                if len(who):
                    row, near, score = _scan(qids[who], qs[who], ids[rows], vs[rows], k)
                    best = tuple(np.concatenate(z) for z in zip(best, (who[row], near, score), strict=True))
                    if len(best[0]) > 1 << 20:
                        best = tuple(z[at] for at in [_kept(*best, k)] for z in best)
        return _frame(qids, *best, _kept(*best, k))

    keys = ["place", "bq", "bv"]
    near = asks.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
