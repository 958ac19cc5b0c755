"""Queries of the model engine on the driver's tables, and their SQL.

V1: embeddings, each vector an image of 64 voxels; values of even voxels under -0.2 are
masked, so some voxels are whole and some are not.  V2: lineitem, (flag, status) groups as
voxels and suppliers as the factor.  V3: events by type, users as the factor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import least_squares as ls
from .operators import masking, products
from .plans import model
from .sources import views
from .spec import Contrast, Factor, ModelSpec

THRESH, BLOCKS = -0.2, 7


def _even():
    return F.col("voxel_id") % 2 == 0


def _v1(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs, design = views.embeddings(spark, sf_dir)
    return masking.usable(obs, THRESH, only=_even()), design


def _v2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs, design = views.lineitem(spark, sf_dir)
    return masking.usable(obs), design


def _r(c, alias: str):
    return F.round(c, 6).alias(alias)


def mask_filter(spark, sf_dir):
    y, _ = _v1(spark, sf_dir)
    return y.select("obs_id", F.col("voxel_id").cast("int"), _r(F.col("y"), "y"))


def zero_is_missing(spark, sf_dir):
    t = views._read(spark, sf_dir, "lineitem")
    obs = t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obs_id"), F.col("l_linenumber").alias("voxel_id"), F.col("l_discount").alias("y"))
    return masking.counts(masking.usable(obs))


def n_sv(spark, sf_dir):
    return masking.counts(_v1(spark, sf_dir)[0])


def missingness_mask(spark, sf_dir):
    y, design = _v1(spark, sf_dir)
    return masking.kept(masking.counts(y), design.count(), 2, 10, min_percent=0.89).select("voxel_id", "n")


def ring_inner(spark, sf_dir):
    y, design = _v1(spark, sf_dir)
    return masking.kept(masking.counts(y), design.count(), 2, 10).select("voxel_id", "is_ring")


def edf(spark, sf_dir):
    y, design = _v1(spark, sf_dir)
    return masking.kept(masking.counts(y), design.count(), 2, 10).select("voxel_id", "edf")


def voxel_blocks(spark, sf_dir):
    y, _ = _v1(spark, sf_dir)
    return masking.voxel_blocks(masking.counts(y).select("voxel_id"), BLOCKS).select("voxel_id", F.col("block").cast("int"))


def pattern_ids(spark, sf_dir):
    return products.patterns(_v1(spark, sf_dir)[0], numbered=True).select("voxel_id", "n", F.col("pattern_id").cast("int"))


def pattern_products(spark, sf_dir):
    y, design = _v1(spark, sf_dir)
    rows = products.pattern_rows(y, products.patterns(y, numbered=True))
    x = products.design_products(rows, design, 2)
    return x.select(F.col("pattern_id").cast("int"), *[_r(F.col("xtx")[i], f"xtx_{i}") for i in range(4)])


def xtx(spark, sf_dir):
    y, design = _v2(spark, sf_dir)
    v = products.patterns(y)
    x = products.design_products(products.pattern_rows(y, v), design, 2)
    return v.join(x, "pattern_id").select("voxel_id", *[_r(F.col("xtx")[i], f"xtx_{i}") for i in range(4)])


def xty(spark, sf_dir):
    y, design = _v2(spark, sf_dir)
    return products.y_products(y, design, 2).select("voxel_id", "n", *[_r(F.col("xty")[i], f"xty_{i}") for i in range(2)])


def yty(spark, sf_dir):
    y, design = _v2(spark, sf_dir)
    return products.y_products(y, design, 2).select("voxel_id", _r(F.col("yty"), "yty"))


def zty(spark, sf_dir):
    y, design = _v2(spark, sf_dir)
    return products.zty(y, design, 1, 1).select("voxel_id", "level", _r(F.col("zty")[0], "zty"))


def ztz_diag(spark, sf_dir):
    y, design = _v2(spark, sf_dir)
    v = products.patterns(y)
    z = products.z_products(products.pattern_rows(y, v), design, 1, 1, 2)
    return v.join(z, "pattern_id").select("voxel_id", "level", _r(F.col("ztz")[0], "ztz"))


def ztx(spark, sf_dir):
    y, design = _v2(spark, sf_dir)
    v = products.patterns(y)
    z = products.z_products(products.pattern_rows(y, v), design, 1, 1, 2)
    return v.join(z, "pattern_id").select("voxel_id", "level", *[_r(F.col("ztx")[i], f"ztx_{i}") for i in range(2)])


def ztz_cross(spark, sf_dir):
    obs, design = views.lineitem(spark, sf_dir, crossed=True)
    y = masking.usable(obs)
    v = products.patterns(y)
    z = products.cross_products(products.pattern_rows(y, v), design, 1, 2, 1, 1)
    return v.join(z, "pattern_id").select("voxel_id", "level", "other", _r(F.col("ztz")[0], "ztz"))


def _ols(spark, sf_dir) -> DataFrame:
    y, design = _v2(spark, sf_dir)
    v = products.patterns(y)
    x = products.design_products(products.pattern_rows(y, v), design, 2)
    own = products.y_products(y, design, 2).join(v.select("voxel_id", "pattern_id"), "voxel_id").join(x, "pattern_id")
    return ls.resms(ls.sigma2(ls.ssr(ls.beta2(own), 2)), 2)


def init_beta(spark, sf_dir):
    return _ols(spark, sf_dir).select("voxel_id", _r(F.col("beta")[0], "beta_0"), _r(F.col("beta")[1], "beta_1"))


def ssr(spark, sf_dir):
    return _ols(spark, sf_dir).select("voxel_id", F.round("ssr", 4).alias("ssr"))


def init_sigma2(spark, sf_dir):
    return _ols(spark, sf_dir).select("voxel_id", _r(F.col("sigma2"), "sigma2"))


def resms(spark, sf_dir):
    return _ols(spark, sf_dir).select("voxel_id", _r(F.col("resms"), "resms"))


def contrast_con(spark, sf_dir):
    """L beta and its OLS standard error for L = (0, 1)."""
    o = _ols(spark, sf_dir)
    a, b, d = (F.col("xtx")[i] for i in (0, 1, 3))
    return o.select("voxel_id", _r(F.col("beta")[1], "con"), _r(F.sqrt(F.col("resms") * a / (a * d - b * b)), "se"))


def init_d(spark, sf_dir):
    y, design = _v2(spark, sf_dir)
    o = _ols(spark, sf_dir).select("voxel_id", "pattern_id", "beta", "sigma2")
    z = products.z_products(products.pattern_rows(y, products.patterns(y)), design, 1, 1, 2)
    own = products.zty(y, design, 1, 1).join(o, "voxel_id").join(z, ["pattern_id", "level"])
    e = F.col("zty")[0] - F.col("ztx")[0] * F.col("beta")[0] - F.col("ztx")[1] * F.col("beta")[1]
    return ls.start_d(own.select("voxel_id", "sigma2", F.col("ztz")[0].alias("t"), e.alias("e"))).select("voxel_id", _r(F.col("d"), "d"))


def lrt_chi2(spark, sf_dir):
    """Chi-squared of a slope: ML fits without and with it, from their residual sums."""
    o = _ols(spark, sf_dir)
    null = F.col("yty") - F.col("xty")[0] * F.col("xty")[0] / F.col("n")
    return o.select("voxel_id", _r(F.greatest(F.col("n") * F.ln(null / F.col("ssr")), F.lit(0.0)), "chi2"))


def running_products(spark, sf_dir):
    """The statistics that a stream keeps, over the whole table at once."""
    from .streaming import incremental

    obs, design = views.events(spark, sf_dir)
    out = incremental.running_products(obs, design, 2)
    return out.select("voxel_id", "n", F.round("yty", 3).alias("yty"), F.round("xty_0", 4).alias("xty_0"), F.round("xty_1", 3).alias("xty_1"), "xtx_11")


_T = Contrast("slope", [[0.0, 1.0]])
_F = Contrast("both", [[1.0, 0.0], [0.0, 1.0]])


def _fit(spark, sf_dir, which: str = "lineitem", **changes) -> DataFrame:
    spec = ModelSpec(2, [Factor("supplier")], [_T, _F], tol=1e-10, polish=15)
    options = {k: changes.pop(k) for k in ("slopes", "crossed") if k in changes}
    if options.get("slopes"):
        spec = spec.but(factors=[Factor("supplier", 2)])
    if options.get("crossed"):
        spec = spec.but(factors=[*spec.factors, Factor("month")])
    spec = spec.but(**changes)
    obs, design = views.lineitem(spark, sf_dir, **options) if which == "lineitem" else getattr(views, which)(spark, sf_dir)
    only = _even() if which == "embeddings" else None
    return model.fit(model.statistics(obs, design, spec.but(data_mask_thresh=THRESH) if only is not None else spec, only=only), spec)


_COLUMNS = ["voxel_id", "n", "status", "converged"]


def _brief(df: DataFrame, variances: int = 1) -> DataFrame:
    betas = [F.round(F.col("beta")[i], 4).alias(f"beta_{i}") for i in range(2)]
    return df.select(*_COLUMNS, *betas, F.round("sigma2", 4).alias("sigma2"), *[F.round(F.col("vechD")[i], 4).alias(f"d_{i}") for i in range(variances)], F.round("llh", 3).alias("llh"))


def fit_psfs(spark, sf_dir):
    return _brief(_fit(spark, sf_dir))


def fit_psfs_ml(spark, sf_dir):
    return _brief(_fit(spark, sf_dir, reml=False))


def fit_embeddings(spark, sf_dir):
    return _brief(_fit(spark, sf_dir, "embeddings"))


def fit_events(spark, sf_dir):
    return _brief(_fit(spark, sf_dir, "events"))


def fit_slopes(spark, sf_dir):
    return _brief(_fit(spark, sf_dir, slopes=True), 3)


def fit_crossed(spark, sf_dir):
    return _brief(_fit(spark, sf_dir, crossed=True), 2)


def fit_sfs(spark, sf_dir):
    return _brief(_fit(spark, sf_dir, "embeddings", method="SFS"))


def fit_fs(spark, sf_dir):
    return _brief(_fit(spark, sf_dir, "embeddings", method="FS"))


def fit_pfs(spark, sf_dir):
    return _brief(_fit(spark, sf_dir, "embeddings", method="pFS"))


def fit_csfs(spark, sf_dir):
    return _brief(_fit(spark, sf_dir, "embeddings", method="cSFS", max_iterations=200))


def _tests(spark, sf_dir, kind: str, *columns: str) -> DataFrame:
    out = model.results(_fit(spark, sf_dir, "embeddings")).where(F.col("kind") == kind)
    return out.select("voxel_id", "name", *[F.round(c, 4).alias(c) for c in columns])


def infer_t(spark, sf_dir):
    return _tests(spark, sf_dir, "T", "est", "se", "stat", "df", "neglog10p")


def infer_f(spark, sf_dir):
    return _tests(spark, sf_dir, "F", "stat", "df", "neglog10p", "r2")


def compare_fits(spark, sf_dir):
    return model.compare(_fit(spark, sf_dir), _fit(spark, sf_dir, slopes=True), 1, 2).select("voxel_id", F.round("chi2", 3).alias("chi2"), F.round("neglog10p", 3).alias("neglog10p"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default model with its contrasts, over lineitem."""
    return model.results(_fit(spark, sf_dir))


_SQL = [mask_filter, zero_is_missing, n_sv, missingness_mask, ring_inner, edf, voxel_blocks, pattern_ids, pattern_products, xtx, xty, yty, zty, ztz_diag, ztx, ztz_cross, init_beta, ssr, init_sigma2, resms, contrast_con, init_d, lrt_chi2, running_products]
_REST = [fit_psfs, fit_psfs_ml, fit_embeddings, fit_events, fit_slopes, fit_crossed, fit_sfs, fit_fs, fit_pfs, fit_csfs, infer_t, infer_f, compare_fits]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [*_SQL, *_REST]}


_V1 = """WITH e AS (SELECT vec_id AS obs_id, unnest(range(0, len(embedding)))::INT AS voxel_id, unnest(embedding)::DOUBLE AS y, vec_id / 1000.0 AS x FROM embeddings),
v AS (SELECT * FROM e WHERE NOT (y < -0.2 AND voxel_id % 2 = 0) AND y IS NOT NULL AND NOT isnan(y) AND y <> 0),
c AS (SELECT voxel_id, count(*) AS n FROM v GROUP BY voxel_id), t AS (SELECT count(*) AS total FROM embeddings),
k AS (SELECT voxel_id, n, n < total AS is_ring, n - 2 AS edf, n::DOUBLE / total AS share FROM c, t WHERE n > 3 AND n > 10)
"""
_PAT = ", g AS (SELECT voxel_id, list(obs_id ORDER BY obs_id) AS ids, count(*) AS n FROM v GROUP BY voxel_id), f AS (SELECT voxel_id, n, min(voxel_id) OVER (PARTITION BY ids) AS first FROM g), q AS (SELECT voxel_id, n, first, dense_rank() OVER (ORDER BY first) AS pattern_id FROM f) "
_V2 = """WITH v AS (SELECT l_orderkey * 8 + l_linenumber AS obs_id, (ascii(l_returnflag) * 256 + ascii(l_linestatus))::INT AS voxel_id, l_extendedprice / 1000 AS y, l_quantity AS x, l_suppkey::INT AS level, month(l_shipdate)::INT AS other FROM lineitem WHERE l_extendedprice <> 0),
s AS (SELECT voxel_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy FROM v GROUP BY voxel_id),
b AS (SELECT *, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM s),
r AS (SELECT *, syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx AS ssr FROM b)
"""


_V3 = """WITH v AS (SELECT event_id AS obs_id, (ascii(event_type) * 65536 + ascii(substr(event_type, 2, 1)) * 256 + length(event_type))::INT AS voxel_id, value AS y, hour(ts)::DOUBLE AS x, user_id::INT AS level FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND value <> 0 AND abs(value) <> 'inf'::DOUBLE)
"""
_V1L = _V1.replace("vec_id / 1000.0 AS x FROM", "vec_id / 1000.0 AS x, label::INT AS level FROM")


def _one_factor(rows: str, table: str, level: str, reml: bool = True, joint: bool = False) -> str:
    """WITH ... o: the maximum of the (restricted) likelihood of y = b0 + b1 x + u_level + e of
    each voxel, from sums per level: the score of the variance ratio D, with b and sigma2 at
    their best for it, is bisected in D / (1 + D).  ``joint``: where D is 0, sigma2 is where a
    scoring step of both together leaves it unchanged."""
    p, r = (2, 1) if reml else (0, 0)
    return rows.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, lev AS (SELECT voxel_id, level, count(*)::DOUBLE AS t, sum(x) AS zx, sum(y) AS zy FROM v GROUP BY ALL),
tot AS (SELECT voxel_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy FROM v GROUP BY voxel_id
  HAVING count(*) > 3 AND count(*) > (SELECT count(DISTINCT {level}) FROM {table})),
cut(voxel_id, k, lo, hi) AS (
  SELECT voxel_id, 0, 0::DOUBLE, 1::DOUBLE FROM tot
  UNION ALL
  SELECT voxel_id, k + 1, CASE WHEN score > 0 THEN u ELSE lo END, CASE WHEN score > 0 THEN hi ELSE u END FROM (
    SELECT voxel_id, k, lo, hi, u, -((n - {p}) * -(wyy - 2 * (b0 * wty + b1 * wxy) + b0 * b0 * wtt + 2 * b0 * b1 * wtx + b1 * b1 * wxx) / (yy - b0 * c0 - b1 * c1) + ld - {r} * (a11 * wtt - 2 * a01 * wtx + a00 * wxx) / det) AS score
    FROM (SELECT *, a00 * a11 - a01 * a01 AS det, (a11 * c0 - a01 * c1) / (a00 * a11 - a01 * a01) AS b0, (a00 * c1 - a01 * c0) / (a00 * a11 - a01 * a01) AS b1
    FROM (SELECT c.voxel_id, c.k, c.lo, c.hi, c.u, any_value(t.n) AS n,
      any_value(t.n) - sum(c.d / (1 + l.t * c.d) * l.t * l.t) AS a00, any_value(t.sx) - sum(c.d / (1 + l.t * c.d) * l.t * l.zx) AS a01, any_value(t.sxx) - sum(c.d / (1 + l.t * c.d) * l.zx * l.zx) AS a11,
      any_value(t.sy) - sum(c.d / (1 + l.t * c.d) * l.t * l.zy) AS c0, any_value(t.sxy) - sum(c.d / (1 + l.t * c.d) * l.zx * l.zy) AS c1, any_value(t.syy) - sum(c.d / (1 + l.t * c.d) * l.zy * l.zy) AS yy,
      sum(l.t / (1 + l.t * c.d)) AS ld, sum(l.t * l.t / pow(1 + l.t * c.d, 2)) AS wtt, sum(l.t * l.zx / pow(1 + l.t * c.d, 2)) AS wtx, sum(l.zx * l.zx / pow(1 + l.t * c.d, 2)) AS wxx,
      sum(l.t * l.zy / pow(1 + l.t * c.d, 2)) AS wty, sum(l.zx * l.zy / pow(1 + l.t * c.d, 2)) AS wxy, sum(l.zy * l.zy / pow(1 + l.t * c.d, 2)) AS wyy
      FROM (SELECT *, (lo + hi) / 2 AS u, (lo + hi) / (2 - lo - hi) AS d FROM cut WHERE k < 60) c JOIN lev l ON l.voxel_id = c.voxel_id JOIN tot t ON t.voxel_id = c.voxel_id GROUP BY c.voxel_id, c.k, c.lo, c.hi, c.u, c.d)))),
ratio AS (SELECT voxel_id, (lo + hi) / (2 - lo - hi) AS d FROM cut WHERE k = 60),
g AS (SELECT t.voxel_id, any_value(t.n) AS n, any_value(r.d) AS d, any_value(t.n) - sum(r.d / (1 + l.t * r.d) * l.t * l.t) AS a00, any_value(t.sx) - sum(r.d / (1 + l.t * r.d) * l.t * l.zx) AS a01, any_value(t.sxx) - sum(r.d / (1 + l.t * r.d) * l.zx * l.zx) AS a11,
  any_value(t.sy) - sum(r.d / (1 + l.t * r.d) * l.t * l.zy) AS c0, any_value(t.sxy) - sum(r.d / (1 + l.t * r.d) * l.zx * l.zy) AS c1, any_value(t.syy) - sum(r.d / (1 + l.t * r.d) * l.zy * l.zy) AS yy,
  sum(ln(1 + l.t * r.d)) AS logdet, sum(l.t / (1 + l.t * r.d)) AS ld, sum(pow(l.t / (1 + l.t * r.d), 2)) AS wtt, sum(l.t * l.zx / pow(1 + l.t * r.d, 2)) AS wtx, sum(pow(l.zx / (1 + l.t * r.d), 2)) AS wxx,
  sum(l.t * l.zy / pow(1 + l.t * r.d, 2)) AS wty, sum(l.zx * l.zy / pow(1 + l.t * r.d, 2)) AS wxy, sum(pow(l.zy / (1 + l.t * r.d), 2)) AS wyy
  FROM ratio r JOIN lev l USING (voxel_id) JOIN tot t USING (voxel_id) GROUP BY t.voxel_id),
h AS (SELECT *, a00 * a11 - a01 * a01 AS det, (a11 * c0 - a01 * c1) / (a00 * a11 - a01 * a01) AS b0, (a00 * c1 - a01 * c0) / (a00 * a11 - a01 * a01) AS b1 FROM g),
best AS (SELECT *, yy - b0 * c0 - b1 * c1 AS rss, wyy - 2 * (b0 * wty + b1 * wxy) + b0 * b0 * wtt + 2 * b0 * b1 * wtx + b1 * b1 * wxx AS uu, {r} * (a11 * wtt - 2 * a01 * wtx + a00 * wxx) / det AS tr FROM h),
o AS (SELECT *, CASE WHEN {str(joint).lower()} AND d < 1e-9 THEN (wtt * rss - n * uu) / (wtt * (n - {p}) - n * (n - tr)) ELSE rss / (n - {p}) END AS s2 FROM best)
"""


def _fit_sql(rows: str, table: str, level: str, reml: bool = True, joint: bool = False) -> str:
    r = 1 if reml else 0
    return _one_factor(rows, table, level, reml, joint) + f"""SELECT voxel_id, n::BIGINT AS n, 'fitted' AS status, true AS converged, round(b0, 4) AS beta_0, round(b1, 4) AS beta_1, round(s2, 4) AS sigma2, round(d, 4) AS d_0,
  round(-0.5 * ((n - {2 * r}) * (ln(s2) + ln(2 * pi())) + rss / s2 + logdet + {r} * ln(det)), 3) AS llh FROM o"""


#: Degrees of freedom of rows (1, 0) and (0, 1): from the gradient of the variance in (s2, D) and
#: the information of both.
_DF = """, info AS (SELECT *, n / (2 * s2 * s2) AS i11, ld / (2 * s2) AS i12, wtt / 2 AS i22 FROM o),
row_ AS (SELECT *, a11 / det AS v00, -a01 / det AS v01, a00 / det AS v11 FROM info),
grad AS (SELECT *, s2 * (v00 * v00 * wtt + 2 * v00 * v01 * wtx + v01 * v01 * wxx) AS h0, s2 * (v01 * v01 * wtt + 2 * v01 * v11 * wtx + v11 * v11 * wxx) AS h1 FROM row_),
dof AS (SELECT *, 2 * pow(s2 * v00, 2) * (i11 * i22 - i12 * i12) / (i22 * v00 * v00 - 2 * i12 * v00 * h0 + i11 * h0 * h0) AS df0,
  2 * pow(s2 * v11, 2) * (i11 * i22 - i12 * i12) / (i22 * v11 * v11 - 2 * i12 * v11 * h1 + i11 * h1 * h1) AS df1 FROM grad)
"""
#: P(T > t) is the share above atan(t / sqrt(df)) of the integral of cos^(df - 1) over (-pi/2, pi/2),
#: by Simpson's rule.
_T_SQL = """, tt AS (SELECT voxel_id, b1 AS est, sqrt(s2 * v11) AS se, b1 / sqrt(s2 * v11) AS t, df1 AS df FROM dof),
grid AS (SELECT k, CASE WHEN k = 0 OR k = 20000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT unnest(range(0, 20001)) AS k)),
area AS (SELECT voxel_id, sum(w * pow(greatest(cos(atan(t / sqrt(df)) + (pi() / 2 - atan(t / sqrt(df))) * k / 20000), 0), df - 1)) * (pi() / 2 - atan(t / sqrt(df))) AS top, sum(w * pow(greatest(cos(pi() * k / 20000 - pi() / 2), 0), df - 1)) * pi() AS whole FROM tt, grid GROUP BY voxel_id, t, df)
SELECT voxel_id, 'slope' AS name, round(est, 4) AS est, round(se, 4) AS se, round(t, 4) AS stat, round(df, 4) AS df, round(-log10(top / whole), 4) AS neglog10p FROM tt JOIN area USING (voxel_id)"""
#: With two rows P(F > f) = (1 + 2 f / df) ^ (-df / 2).
_F_SQL = """, ff AS (SELECT voxel_id, (b0 * b0 * a00 + 2 * b0 * b1 * a01 + b1 * b1 * a11) / s2 / 2 AS f, 2 * (df0 / (df0 - 2) + df1 / (df1 - 2)) / (df0 / (df0 - 2) + df1 / (df1 - 2) - 2) AS df FROM dof)
SELECT voxel_id, 'both' AS name, round(f, 4) AS stat, round(df, 4) AS df, round(df / 2 * log10(1 + 2 * f / df), 4) AS neglog10p, round(2 * f / (2 * f + df), 4) AS r2 FROM ff"""


def oracle_sql() -> dict[str, str]:
    return _fit_oracles() | {
        "mask_filter": _V1 + "SELECT obs_id, voxel_id, round(y, 6) AS y FROM v",
        "zero_is_missing": "SELECT l_linenumber AS voxel_id, count(*) AS n FROM lineitem WHERE l_discount <> 0 GROUP BY 1",
        "n_sv": _V1 + "SELECT voxel_id, n FROM c",
        "missingness_mask": _V1 + "SELECT voxel_id, n FROM k, t WHERE n >= 0.89 * total",
        "ring_inner": _V1 + "SELECT voxel_id, is_ring FROM k",
        "edf": _V1 + "SELECT voxel_id, edf FROM k",
        "voxel_blocks": _V1 + "SELECT voxel_id, ntile(7) OVER (ORDER BY voxel_id)::INT AS block FROM c",
        "pattern_ids": _V1 + _PAT + "SELECT voxel_id, n, pattern_id::INT AS pattern_id FROM q",
        "pattern_products": _V1 + _PAT + "SELECT pattern_id::INT AS pattern_id, round(count(*)::DOUBLE, 6) AS xtx_0, round(sum(x), 6) AS xtx_1, round(sum(x), 6) AS xtx_2, round(sum(x * x), 6) AS xtx_3 FROM v JOIN q USING (voxel_id) WHERE voxel_id = first GROUP BY 1",
        "xtx": _V2 + "SELECT voxel_id, round(n, 6) AS xtx_0, round(sx, 6) AS xtx_1, round(sx, 6) AS xtx_2, round(sxx, 6) AS xtx_3 FROM s",
        "xty": _V2 + "SELECT voxel_id, n::BIGINT AS n, round(sy, 6) AS xty_0, round(sxy, 6) AS xty_1 FROM s",
        "yty": _V2 + "SELECT voxel_id, round(syy, 6) AS yty FROM s",
        "zty": _V2 + "SELECT voxel_id, level, round(sum(y), 6) AS zty FROM v GROUP BY ALL",
        "ztz_diag": _V2 + "SELECT voxel_id, level, round(count(*)::DOUBLE, 6) AS ztz FROM v GROUP BY ALL",
        "ztx": _V2 + "SELECT voxel_id, level, round(count(*)::DOUBLE, 6) AS ztx_0, round(sum(x), 6) AS ztx_1 FROM v GROUP BY ALL",
        "ztz_cross": _V2 + "SELECT voxel_id, level, other, round(count(*)::DOUBLE, 6) AS ztz FROM v GROUP BY ALL",
        "init_beta": _V2 + "SELECT voxel_id, round(b0, 6) AS beta_0, round(b1, 6) AS beta_1 FROM b",
        "ssr": _V2 + "SELECT voxel_id, round(ssr, 4) AS ssr FROM r",
        "init_sigma2": _V2 + "SELECT voxel_id, round(ssr / n, 6) AS sigma2 FROM r",
        "resms": _V2 + "SELECT voxel_id, round(ssr / (n - 2), 6) AS resms FROM r",
        "contrast_con": _V2 + "SELECT voxel_id, round(b1, 6) AS con, round(sqrt(ssr / (n - 2) * n / (n * sxx - sx * sx)), 6) AS se FROM r",
        "init_d": _V2 + ", z AS (SELECT voxel_id, level, count(*) AS t, sum(x) AS zx, sum(y) AS zy FROM v GROUP BY ALL) SELECT voxel_id, round(greatest(sum(pow(zy - t * b0 - zx * b1, 2) / (ssr / n) - t) / sum(t * t), 0), 6) AS d FROM z JOIN r USING (voxel_id) GROUP BY voxel_id",
        "lrt_chi2": _V2 + "SELECT voxel_id, round(greatest(n * ln((syy - sy * sy / n) / ssr), 0), 6) AS chi2 FROM r",
    }


def _fit_oracles() -> dict[str, str]:
    v1, v2, v3 = (_V1L, "embeddings", "label"), (_V2, "lineitem", "l_suppkey"), (_V3, "events", "user_id")
    out = {"fit_psfs": _fit_sql(*v2), "fit_psfs_ml": _fit_sql(*v2, reml=False), "fit_events": _fit_sql(*v3)}
    out |= dict.fromkeys(("fit_embeddings", "fit_sfs"), _fit_sql(*v1)) | dict.fromkeys(("fit_fs", "fit_pfs"), _fit_sql(*v1, joint=True))
    out |= {"infer_t": _one_factor(*v1) + _DF + _T_SQL, "infer_f": _one_factor(*v1) + _DF + _F_SQL}
    out["running_products"] = _V3 + "SELECT voxel_id, count(*) AS n, round(sum(y * y), 3) AS yty, round(sum(y), 4) AS xty_0, round(sum(x * y), 3) AS xty_1, sum(x * x) AS xtx_11 FROM v GROUP BY voxel_id"
    return out
