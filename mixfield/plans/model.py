"""The whole model as one lazy plan: masks, products, fit, statistics, comparison.

Observations are read twice: once for the sums with y and the missingness patterns, once for
the design products of each pattern's first voxel.  Both are summed to cells (voxel or
pattern, and levels), from which all products are rolled up; the exchange of cells is shared.
Voxels are dealt out evenly by a hash and fitted in batches, one after the other.  The rows
that reach the solver are sufficient statistics: their size depends on levels and effects,
not on observations.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as E
from ..functions import inference, tails
from ..operators import masking, products
from ..spec import ModelSpec

FIT = "voxel_id int, n long, is_ring boolean, status string, beta array<double>, sigma2 double, vechD array<double>, llh double, nit int, converged boolean, resms double, cov_beta array<double>, contrasts array<struct<name:string,kind:string,est:double,se:double,stat:double,df:double,neglog10p:double,r2:double>>"
_NAMES = ["voxel_id", "n", "is_ring", "status", "beta", "sigma2", "vechD", "llh", "nit", "converged", "resms", "cov_beta", "contrasts"]


def statistics(obs: DataFrame, design: DataFrame, spec: ModelSpec, data_mask: DataFrame | None = None, analysis_mask: DataFrame | None = None, only=None) -> DataFrame:
    """One row per voxel that counts: n, is_ring and all products."""
    y = masking.usable(obs, spec.data_mask_thresh, data_mask, analysis_mask, only)
    effects, p = spec.effects, spec.p
    levels = [f"f_{k}" for k in range(1, len(effects) + 1)]
    found = design.agg(F.count("*"), *[F.countDistinct(f) for f in levels]).first()
    total, q = found[0], sum(a * b for a, b in zip(found[1:], effects, strict=True))
    rows = products.attached(y, design, "x", *levels, *(f"z_{k}" for k in range(1, len(effects) + 1)))

    def z(k: int, i: int):
        return F.col(f"z_{k}")[i]

    x, value = [F.col("x")[i] for i in range(p)], F.col("y")
    sums = {f"xty_{i}": x[i] * value for i in range(p)} | {"yty": value * value}
    sums |= {f"zty_{k}_{i}": z(k, i) * value for k, e in enumerate(effects, 1) for i in range(e)}
    h1, h2 = F.xxhash64("obs_id"), F.xxhash64("obs_id", F.lit("pattern"))
    cells = rows.groupBy("voxel_id", *levels).agg(F.count("*").alias("n"), F.bit_xor(h1).alias("h1"), F.bit_xor(h2).alias("h2"), F.sum(F.shiftright(h2, 24)).alias("h3"), *(F.sum(c).alias(name) for name, c in sums.items()))
    keys = ["n", "h1", "h2", "h3"]
    voxels = cells.groupBy("voxel_id").agg(F.sum("n").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("h3").alias("h3"), F.array(*[F.sum(f"xty_{i}") for i in range(p)]).alias("xty"), F.sum("yty").alias("yty"))
    first = voxels.groupBy(*keys).agg(F.min("voxel_id").alias("pattern_id"))
    keep = masking.kept(voxels.select("voxel_id", "n"), total, p, q, spec.min_percent, spec.min_n, spec.safe_mode)
    out = keep.join(voxels.join(first, keys).drop(*keys), "voxel_id")

    def collected(table: DataFrame, key: str, on: list[str], names: list[str], arrays: dict[str, list[str]], to: str) -> DataFrame:
        """Sums of ``table`` per key and levels, as one sorted array of structs per key."""
        each = table.groupBy(key, *on).agg(*(F.array(*[F.sum(c) for c in cs]).alias(a) for a, cs in arrays.items()))
        return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(F.col(f).alias(n) for f, n in zip(on, names, strict=True)), *arrays))).alias(to))

    for k, e in enumerate(effects, 1):
        out = out.join(collected(cells, "voxel_id", [f"f_{k}"], ["level"], {"zty": [f"zty_{k}_{i}" for i in range(e)]}, f"zy_{k}"), "voxel_id")
    # design products of each pattern, over the observations of its first voxel
    sums = {f"xtx_{i}_{j}": x[i] * x[j] for i in range(p) for j in range(p)}
    pairs = [(k, m) for k in range(1, len(effects) + 1) for m in range(k, len(effects) + 1)]
    for k, m in pairs:
        sums |= {f"ztz_{k}_{m}_{i}_{j}": z(k, i) * z(m, j) for i in range(effects[k - 1]) for j in range(effects[m - 1])}
    sums |= {f"ztx_{k}_{i}_{j}": z(k, i) * x[j] for k, e in enumerate(effects, 1) for i in range(e) for j in range(p)}
    lead = first.select("pattern_id")
    parts = rows.join(lead, F.col("voxel_id") == F.col("pattern_id")).groupBy("pattern_id", *levels).agg(*(F.sum(c).alias(name) for name, c in sums.items()))

    def named(lead: str) -> list[str]:
        return [name for name in sums if name.startswith(lead)]

    out = out.join(parts.groupBy("pattern_id").agg(F.array(*[F.sum(c) for c in named("xtx_")]).alias("xtx")), "pattern_id")
    for k, m in pairs:
        if k == m:
            out = out.join(collected(parts, "pattern_id", [f"f_{k}"], ["level"], {"ztz": named(f"ztz_{k}_{k}_"), "ztx": named(f"ztx_{k}_")}, f"zz_{k}"), "pattern_id")
        else:
            out = out.join(collected(parts, "pattern_id", [f"f_{k}", f"f_{m}"], ["level", "other"], {"ztz": named(f"ztz_{k}_{m}_")}, f"zw_{k}_{m}"), "pattern_id")
    return out


def system(row, effects: list[int], p: int) -> E.System:
    """The sufficient statistics of a row of ``statistics``."""
    ztx, zty, own, levels = [], [], [], []
    for k, e in enumerate(effects, 1):
        zy, zz = getattr(row, f"zy_{k}"), getattr(row, f"zz_{k}")
        levels.append({r["level"]: i for i, r in enumerate(zz)})
        ztx.append(np.array([np.asarray(r["ztx"], float) for r in zz]).reshape(-1, e, p))
        own.append(np.array([np.asarray(r["ztz"], float) for r in zz]).reshape(-1, e, e))
        y = np.zeros((len(zz), e))
        for r in zy:
            y[levels[-1][r["level"]]] = r["zty"]
        zty.append(y)
    ztz: np.ndarray | E.Crossed = own[0]
    if len(effects) > 1:
        ztz = E.Crossed.empty([len(x) for x in levels], effects)
        for k, (blocks, e) in enumerate(zip(own, effects, strict=True)):
            if k == ztz.head:
                ztz.own = blocks
            else:
                b = np.zeros((len(blocks), e, len(blocks), e))
                b[np.arange(len(blocks)), :, np.arange(len(blocks))] = blocks
                ztz.put(k, k, b.reshape(len(blocks) * e, -1))
            for m in range(k + 1, len(effects)):
                f, met = effects[m], getattr(row, f"zw_{k + 1}_{m + 1}")
                b = np.zeros((len(levels[k]), e, len(levels[m]), f))
                b[[levels[k][r["level"]] for r in met], :, [levels[m][r["other"]] for r in met]] = np.array([r["ztz"] for r in met], float).reshape(-1, e, f)
                ztz.put(k, m, b.reshape(len(levels[k]) * e, -1))
    return E.System(int(row.n), np.asarray(row.xtx, float).reshape(p, p), np.asarray(row.xty, float), float(row.yty), ztx, zty, ztz)


def _fit_batch(df: pd.DataFrame, spec: ModelSpec) -> pd.DataFrame:
    out = []
    for row in df.sort_values("voxel_id").itertuples():
        s = system(row, spec.effects, spec.p)
        base = dict.fromkeys(_NAMES) | {"voxel_id": row.voxel_id, "n": row.n, "is_ring": row.is_ring}
        if np.linalg.matrix_rank(s.xtx) < spec.p:
            out.append(base | {"status": "rank", "converged": False})
            continue
        fit = E.fit(s, spec.method, spec.reml, spec.tol, spec.max_iterations, spec.floor, spec.polish)
        st = E.state(s, fit.d)
        llh = E.log_likelihood(s, st, fit.beta, fit.sigma2, spec.reml)
        found = [{"name": c.name, "kind": c.kind} | inference.contrast(s, st, fit.beta, fit.sigma2, np.array(c.rows), c.kind, spec.min_log) for c in spec.contrasts]
        cov = inference.cov_beta(st, fit.sigma2).ravel().tolist() if spec.output_cov else None
        out.append(base | {"status": "fitted", "beta": fit.beta.tolist(), "sigma2": fit.sigma2, "vechD": fit.vech().tolist(), "llh": llh, "nit": fit.iterations, "converged": fit.converged, "resms": inference.residual_ms(s, fit.beta), "cov_beta": cov, "contrasts": found})
    frame = pd.DataFrame(out, columns=_NAMES, dtype=object).astype({"voxel_id": "int32", "n": "int64", "is_ring": "bool", "converged": "bool"})
    for c in ("sigma2", "llh", "resms"):
        frame[c] = frame[c].astype("float64")
    frame["nit"] = frame["nit"].astype("Int32")
    return frame


def fit(stats: DataFrame, spec: ModelSpec) -> DataFrame:
    """Estimates and statistics of every voxel (see FIT); a voxel whose X'X lacks rank keeps
    its n and gets status ``rank``."""
    blocks = spec.blocks or int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        for df in frames:
            for at in range(0, len(df), 256):
                yield _fit_batch(df.iloc[at : at + 256], spec)

    # by number, so that few bytes but much work are not gathered into one task
    return stats.repartition(blocks, F.xxhash64("voxel_id")).mapInPandas(run, FIT)


def results(fits: DataFrame) -> DataFrame:
    """One row per voxel and contrast."""
    return fits.select("voxel_id", F.explode("contrasts").alias("c")).select("voxel_id", "c.*")


def compare(one: DataFrame, two: DataFrame, effects_one: int, effects_two: int) -> DataFrame:
    """Likelihood-ratio test of nested one-factor fits (voxel_id, llh): chi2 and -log10 p of
    an even mixture of chi-squared distributions.  The larger model may come first.  An
    infinite -log10 p becomes the largest finite one of the map."""
    if effects_one > effects_two:
        one, two, effects_one, effects_two = two, one, effects_two, effects_one
    if effects_two != effects_one + 1:
        raise ValueError("the models differ by one random effect")
    met = one.select("voxel_id", F.col("llh").alias("l1")).join(two.select("voxel_id", F.col("llh").alias("l2")), "voxel_id")
    chi = met.select("voxel_id", F.greatest(-2 * (F.col("l1") - F.col("l2")), F.lit(0.0)).alias("chi2"))

    @F.pandas_udf("double")
    def minus_log_p(x: pd.Series) -> pd.Series:
        def one_p(v: float) -> float:
            big = tails.log_chi2_sf(v, effects_two)
            small = tails.log_chi2_sf(v, effects_one) if effects_one else -np.inf
            return float(tails.minus_log10(np.logaddexp(big, small) - np.log(2)))

        return x.map(functools.cache(one_p))

    return chi.withColumn("neglog10p", minus_log_p("chi2"))
