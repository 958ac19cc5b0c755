"""Kernels against dense n x n formulas on seeded data."""

import math

import numpy as np
import pytest

from mixfield.functions import estimators as E
from mixfield.functions import inference, tails
from mixfield.functions import matrices as M


def make(seed, n, p, levels, effects, d=None):
    r = np.random.default_rng(seed)
    x = np.column_stack([np.ones(n), r.normal(size=(n, p - 1))])
    z, zs = [], []
    for m, q in zip(levels, effects, strict=True):
        f = r.integers(0, m, n)
        f[:m] = np.arange(m)
        w = np.column_stack([np.ones(n), r.normal(size=(n, q - 1))])
        out = np.zeros((n, m, q))
        out[np.arange(n), f] = w
        z.append(out.reshape(n, m * q))
        zs.append(out)
    big = np.concatenate(z, axis=1)
    d = d or [np.eye(q) * 0.7 + 0.1 for q in effects]
    u = np.concatenate([r.multivariate_normal(np.zeros(q), dk, m).ravel() for dk, m, q in zip(d, levels, effects, strict=True)])
    y = x @ np.arange(1, p + 1) + big @ u + r.normal(size=n)
    ztz = np.einsum("nla,nlb->lab", zs[0], zs[0]) if len(levels) == 1 else big.T @ big
    s = E.System(n, x.T @ x, x.T @ y, float(y @ y), [np.einsum("nla,np->lap", a, x) for a in zs], [np.einsum("nla,n->la", a, y) for a in zs], ztz)
    return s, x, y, big


CASES = [((60,), (1,)), ((30,), (2,)), ((12, 9), (2, 1))]


@pytest.mark.parametrize("levels,effects", CASES)
def test_state_and_likelihood_match_dense(levels, effects):
    s, x, y, z = make(1, 300, 3, levels, effects)
    d = [np.eye(q) * 0.5 + 0.2 for q in effects]
    st, v = E.state(s, d), np.eye(300) + z @ E.full_d(d, list(levels)) @ z.T
    vi = np.linalg.inv(v)
    np.testing.assert_allclose(st.xvx, x.T @ vi @ x, rtol=1e-8)
    np.testing.assert_allclose(st.xvy, x.T @ vi @ y, rtol=1e-8)
    np.testing.assert_allclose(st.yvy, y @ vi @ y, rtol=1e-8)
    np.testing.assert_allclose(st.logdet, np.linalg.slogdet(v)[1], rtol=1e-8)
    b, s2 = np.array([1.0, 2.0, 2.5]), 1.3
    e = y - x @ b
    full = -0.5 * (300 * math.log(s2) + np.linalg.slogdet(v)[1] + e @ vi @ e / s2 + 300 * math.log(2 * math.pi))
    np.testing.assert_allclose(E.log_likelihood(s, st, b, s2, False), full, rtol=1e-9)
    # the gradient by differences
    for reml in (False, True):
        g = E.gradient(s, st, 0, b, s2, reml)
        h = 1e-5
        up, low = ([dk + (h if k == 0 else 0) * sign for k, dk in enumerate(d)] for sign in (1, -1))
        change = (E.log_likelihood(s, E.state(s, up), b, s2, reml) - E.log_likelihood(s, E.state(s, low), b, s2, reml)) / (2 * h)
        if reml:  # at the profile coefficients, where the restricted term is whole
            beta = np.linalg.solve(st.xvx, st.xvy)
            g = E.gradient(s, st, 0, beta, s2, True)
            change = (E.log_likelihood(s, E.state(s, up), beta, s2, True) - E.log_likelihood(s, E.state(s, low), beta, s2, True)) / (2 * h)
        np.testing.assert_allclose(g.sum(), change, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("levels,effects", [((12, 9), (2, 1)), ((5, 14), (1, 2)), ((4, 11, 6), (1, 2, 2))])
def test_crossed_state_matches_dense(levels, effects):
    s, x, y, z = make(5, 300, 2, levels, effects)
    d = [np.eye(q) * 0.5 + 0.2 for q in effects]
    st, vi = E.state(s, d), np.linalg.inv(np.eye(300) + z @ E.full_d(d, list(levels)) @ z.T)
    np.testing.assert_allclose(s.ztz, z.T @ z, atol=1e-9)
    np.testing.assert_allclose(st.r, z.T @ vi @ z, atol=1e-8)
    np.testing.assert_allclose(np.concatenate([v.reshape(-1, 2) for v in st.zvx]), z.T @ vi @ x, atol=1e-8)
    np.testing.assert_allclose(np.concatenate([v.ravel() for v in st.zvy]), z.T @ vi @ y, atol=1e-8)
    r, at = z.T @ vi @ z, np.concatenate([[0], np.cumsum(np.array(levels) * effects)])
    for k in range(len(levels)):
        for m in range(len(levels)):
            b = M.blocks(r[at[k] : at[k + 1], at[m] : at[m + 1]], effects[k], effects[m])
            want = np.einsum("ijab,ijcd->acbd", b, b).reshape(effects[k] ** 2, effects[m] ** 2)
            np.testing.assert_allclose(st.rr(s, k, m), want, rtol=1e-8, atol=1e-8)
            if k == m:
                np.testing.assert_allclose(st.rk(s, k), np.einsum("iiab->ab", b), rtol=1e-8, atol=1e-8)


def test_crossed_cost_is_linear_in_the_larger_factor():
    """20,000 levels, whose full matrix would take 3.2 GB."""
    r, n, m, k = np.random.default_rng(6), 60_000, 20_000, 4
    f, g, x, y = np.arange(n) % m, r.integers(0, k, n), np.ones((n, 1)), r.normal(size=n) + 1
    y += r.normal(size=m)[f] + r.normal(size=k)[g]
    ztz = E.Crossed.empty([m, k], [1, 1])
    ztz.own[:, 0, 0] = np.bincount(f)
    np.add.at(ztz.side, (f, g), 1.0)
    ztz.rest[...] = np.diag(np.bincount(g))
    s = E.System(n, x.T @ x, x.T @ y, float(y @ y), [np.bincount(v).astype(float)[:, None, None] for v in (f, g)], [np.bincount(v, weights=y)[:, None] for v in (f, g)], ztz)
    fit = E.fit(s)
    assert fit.converged and abs(fit.sigma2 - 1) < 0.05 and abs(fit.d[0][0, 0] - 1) < 0.05


@pytest.mark.parametrize("levels,effects", CASES)
@pytest.mark.parametrize("reml", [True, False])
def test_methods_agree(levels, effects, reml):
    s, *_ = make(2, 400, 3, levels, effects)
    fits = {m: E.fit(s, m, reml, 1e-9, 2000) for m in ("pSFS", "SFS", "FS", "pFS", "cSFS")}
    best = max(f.llh for f in fits.values())
    for m, f in fits.items():
        assert f.llh > best - 1e-3, (m, f.llh, best)
        np.testing.assert_allclose(f.beta, fits["pSFS"].beta, atol=5e-3)


def test_balanced_one_way_reml_is_anova():
    r = np.random.default_rng(3)
    m, k = 20, 15
    f = np.repeat(np.arange(m), k)
    y = 2 + np.repeat(r.normal(size=m), k) + r.normal(size=m * k)
    x, z = np.ones((m * k, 1)), np.eye(m)[f]
    s = E.System(m * k, x.T @ x, x.T @ y, float(y @ y), [np.full((m, 1, 1), float(k))], [(z.T @ y)[:, None]], np.full((m, 1, 1), float(k)))
    means = y.reshape(m, k).mean(axis=1)
    within = ((y.reshape(m, k) - means[:, None]) ** 2).sum() / (m * (k - 1))
    between = k * ((means - means.mean()) ** 2).sum() / (m - 1)
    fit = E.fit(s, "pSFS", True, 1e-12)
    np.testing.assert_allclose(fit.sigma2, within, rtol=1e-5)
    np.testing.assert_allclose(fit.sigma2 * fit.d[0][0, 0], (between - within) / k, rtol=1e-4)
    st = E.state(s, fit.d)
    np.testing.assert_allclose(inference.df_t(s, st, np.array([1.0]), fit.sigma2), m - 1, rtol=0.12)


def test_pels_is_minimal_at_the_ml_fit():
    s, *_ = make(5, 300, 2, (25,), (1,))
    f = E.fit(s, "pSFS", False, 1e-11)
    best = E.pels(s, np.sqrt(f.d[0][0]))[0]
    np.testing.assert_allclose(best, -f.llh, rtol=1e-7)
    assert all(E.pels(s, np.sqrt(f.d[0][0]) + h)[0] > best for h in (-0.05, 0.05))


def test_contrasts():
    s, x, y, z = make(6, 300, 3, (30,), (2,))
    f = E.fit(s, "pSFS", True, 1e-9)
    st = E.state(s, f.d)
    v = np.eye(300) + z @ E.full_d(f.d, [30]) @ z.T
    cov = f.sigma2 * np.linalg.inv(x.T @ np.linalg.inv(v) @ x)
    one = inference.contrast(s, st, f.beta, f.sigma2, np.array([[0, 1.0, 0]]), "T", -323)
    np.testing.assert_allclose(one["stat"], f.beta[1] / math.sqrt(cov[1, 1]), rtol=1e-6)
    two = inference.contrast(s, st, f.beta, f.sigma2, np.array([[0, 1.0, 0]]), "F", -323)
    np.testing.assert_allclose(two["stat"], one["stat"] ** 2, rtol=1e-6)
    np.testing.assert_allclose(two["df"], one["df"], rtol=1e-6)
    assert 0 < two["r2"] < 1


def test_tails():
    assert math.isclose(math.exp(tails.log_t_sf(2.0, 10)), 0.036694017, rel_tol=1e-6)
    assert math.isclose(math.exp(tails.log_t_sf(-2.0, 10)), 1 - 0.036694017, rel_tol=1e-6)
    assert math.isclose(math.exp(tails.log_f_sf(4.0, 1, 10)), 2 * 0.036694017, rel_tol=1e-6)
    assert math.isclose(math.exp(tails.log_chi2_sf(3.0, 2)), math.exp(-1.5), rel_tol=1e-10)
    assert math.isclose(math.exp(tails.log_chi2_sf(3.841458820694124, 1)), 0.05, rel_tol=1e-8)
    assert tails.log_chi2_sf(0, 1) == 0.0 and tails.log_t_sf(40.0, 50) < -60


def test_matrices():
    r = np.random.default_rng(0)
    a = M.symmetric(r.normal(size=(3, 3)))
    np.testing.assert_allclose(M.duplication(3) @ M.vech(a), M.vec(a))
    np.testing.assert_allclose(M.elimination(3) @ M.vec(a), M.vech(a))
    np.testing.assert_allclose(M.duplication_inverse(3) @ M.vec(a), M.vech(a))
    b = r.normal(size=(2, 3))
    np.testing.assert_allclose(M.commutation(2, 3) @ M.vec(b), M.vec(b.T))
    np.testing.assert_allclose(M.kron(a, b), np.kron(a, b))
    np.testing.assert_allclose(M.unvec(M.vec(a)), a)
    np.testing.assert_allclose(M.unvech(M.vech(a)), a)
    c, d = r.normal(size=(4, 6)), r.normal(size=(4, 6))
    want = sum(c[2 * i : 2 * i + 2, 3 * j : 3 * j + 3] @ d[2 * i : 2 * i + 2, 3 * j : 3 * j + 3].T for i in range(2) for j in range(2))
    np.testing.assert_allclose(M.sum_products(c, d, (2, 3), (2, 3)), want)
    want = sum(np.kron(c[2 * i : 2 * i + 2, 3 * j : 3 * j + 3], d[2 * i : 2 * i + 2, 3 * j : 3 * j + 3]) for i in range(2) for j in range(2))
    np.testing.assert_allclose(M.sum_krons(c, d, (2, 3)), want)
    m = np.kron(np.eye(3), np.array([[2.0, 1], [1, 3]]))
    np.testing.assert_allclose(M.block_inverse(m, 2), np.linalg.inv(m))
    t = r.normal(size=(20, 8))
    t = t.T @ t
    t[:6, :6] *= np.kron(np.eye(3), np.ones((2, 2)))
    t += 20 * np.eye(8)
    np.testing.assert_allclose(M.schur_inverse(t, 6, 2), np.linalg.inv(t))
    assert (np.linalg.eigvalsh(M.project(np.diag([1.0, -2.0]))) >= 0).all()
    assert M.structural_nonzero([2, 2], [1, 1]).sum() == 12
