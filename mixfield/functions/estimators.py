"""Fisher-scoring estimation of one linear mixed model from its sufficient statistics.

    y = X b + Z u + e,   e ~ N(0, s2 I),   u ~ N(0, s2 D),   D = block of D_k per level

``System`` holds X'X, X'y, Z'X, Z'y, Z'Z, y'y and n.  With one factor Z'Z is block-diagonal
and is kept as (levels, q, q), so the cost of a step is linear in the levels; with several
(``Crossed``) the factor with the most columns is eliminated by its blocks, so the cost is linear
in its levels and grows with the square of the other factors' columns.  ``State`` is everything
that depends on D.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from . import matrices as M


@dataclass
class Crossed:
    """A symmetric matrix over the columns of several factors.  The part of the factor with the
    most columns (head) is never dense: its own blocks, less low @ mid @ low.T if given."""

    head: int
    levels: list[int]
    effects: list[int]
    own: np.ndarray  # (levels, q, q) of the head
    side: np.ndarray  # head's columns x all others
    rest: np.ndarray  # all others
    low: np.ndarray | None = None  # head's columns x all others
    mid: np.ndarray | None = None

    @classmethod
    def empty(cls, levels: list[int], effects: list[int]) -> Crossed:
        sizes = [a * b for a, b in zip(levels, effects, strict=True)]
        head = int(np.argmax(sizes))
        others = sum(sizes) - sizes[head]
        return cls(head, levels, effects, np.zeros((levels[head], effects[head], effects[head])), np.zeros((sizes[head], others)), np.zeros((others, others)))

    @classmethod
    def of(cls, m: np.ndarray, levels: list[int], effects: list[int]) -> Crossed:
        """From a full matrix."""
        out = cls.empty(levels, effects)
        at = np.concatenate([[0], np.cumsum([a * b for a, b in zip(levels, effects, strict=True)])])
        a, b = at[out.head], at[out.head + 1]
        others = np.concatenate([np.arange(a), np.arange(b, at[-1])])
        i = a + np.arange(levels[out.head])[:, None, None] * effects[out.head]
        q = np.arange(effects[out.head])
        out.own, out.side, out.rest = m[i + q[:, None], i + q], m[a:b][:, others], m[np.ix_(others, others)]
        return out

    def columns(self, k: int) -> slice:
        """Columns of a factor that is not the head, among all others."""
        sizes = [0 if i == self.head else a * b for i, (a, b) in enumerate(zip(self.levels, self.effects, strict=True))]
        return slice(sum(sizes[:k]), sum(sizes[: k + 1]))

    def part(self, k: int, m: int) -> np.ndarray:
        """Rows of factor k and columns of factor m, not both the head."""
        if k == self.head:
            return self.side[:, self.columns(m)]
        return self.side[:, self.columns(k)].T if m == self.head else self.rest[self.columns(k), self.columns(m)]

    def put(self, k: int, m: int, b: np.ndarray) -> None:
        """Set the columns of two factors, and what mirrors them."""
        self.part(k, m)[...] = b
        if self.head not in (k, m):
            self.part(m, k)[...] = b.T

    def _lows(self) -> tuple[np.ndarray, np.ndarray]:
        shape = (*self.own.shape[:2], -1)
        return self.low.reshape(shape), (self.low @ self.mid).reshape(shape)

    def blocks(self, k: int) -> np.ndarray:
        """Diagonal blocks of a factor."""
        if k != self.head:
            b, i = M.blocks(self.part(k, k), self.effects[k], self.effects[k]), np.arange(self.levels[k])
            return b[i, i]
        if self.low is None:
            return self.own
        low, moved = self._lows()
        return self.own - moved @ np.swapaxes(low, 1, 2)

    def squares(self, k: int, m: int) -> np.ndarray:
        """Sum over blocks of R_ij (x) R_ij, as (q_k, q_k, q_m, q_m)."""
        if k != self.head or m != self.head:
            b = M.blocks(self.part(k, m), self.effects[k], self.effects[m])
            return np.einsum("ijab,ijcd->acbd", b, b)
        out = np.einsum("iab,icd->acbd", self.own, self.own)
        if self.low is None:
            return out
        low, moved = self._lows()
        c = moved @ np.swapaxes(low, 1, 2)
        cross = np.einsum("iab,icd->acbd", self.own, c)
        q = self.effects[k]
        pairs = np.array([[low[:, a].T @ low[:, b] for b in range(q)] for a in range(q)])
        return out - cross - cross.transpose(1, 0, 3, 2) + np.einsum("acsu,bdsu->acbd", pairs, self.mid @ pairs @ self.mid.T)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        n = self.levels[self.head]
        head = np.zeros((n, self.own.shape[1], n, self.own.shape[1]))
        head[np.arange(n), :, np.arange(n)] = self.own
        head = head.reshape(len(self.side), -1)
        if self.low is not None:
            head -= self.low @ self.mid @ self.low.T
        r = range(len(self.levels))
        return np.block([[head if k == m == self.head else self.part(k, m) for m in r] for k in r]).astype(dtype or float)


@dataclass
class System:
    n: int
    xtx: np.ndarray
    xty: np.ndarray
    yty: float
    ztx: list[np.ndarray]  # per factor (levels, q, p)
    zty: list[np.ndarray]  # per factor (levels, q)
    ztz: np.ndarray | Crossed  # one factor: (levels, q, q); several: Crossed, or a full matrix to make it of

    def __post_init__(self):
        if not self.single and isinstance(self.ztz, np.ndarray):
            self.ztz = Crossed.of(self.ztz, self.levels, self.effects)

    @property
    def p(self) -> int:
        return len(self.xty)

    @property
    def levels(self) -> list[int]:
        return [len(x) for x in self.zty]

    @property
    def effects(self) -> list[int]:
        return [x.shape[1] for x in self.zty]

    @property
    def single(self) -> bool:
        return len(self.zty) == 1

    def own(self, k: int) -> np.ndarray:
        """Diagonal blocks of Z'Z for factor k."""
        return self.ztz if self.single else self.ztz.blocks(k)

    def rss(self, b: np.ndarray) -> float:
        return float(self.yty - 2 * b @ self.xty + b @ self.xtx @ b)


@dataclass
class State:
    """X'V^-1 X, X'V^-1 y, log|V|, Z'V^-1 X, Z'V^-1 Z and Z'V^-1 y for one D."""

    xvx: np.ndarray
    xvy: np.ndarray
    yvy: float
    logdet: float
    zvx: list[np.ndarray]
    zvy: list[np.ndarray]
    r: np.ndarray | Crossed  # one factor: (levels, q, q); several: Crossed

    def rk(self, s: System, k: int) -> np.ndarray:
        """Sum of the diagonal blocks of Z'V^-1 Z of factor k."""
        return (self.r if s.single else self.r.blocks(k)).sum(axis=0)

    def rr(self, s: System, k: int, m: int) -> np.ndarray:
        """Sum over blocks of R_ij (x) R_ij for factors k and m."""
        qk, qm = s.effects[k], s.effects[m]
        out = np.einsum("iab,icd->acbd", self.r, self.r) if s.single else self.r.squares(k, m)
        return out.reshape(qk * qk, qm * qm)


def full_d(d: list[np.ndarray], levels: list[int]) -> np.ndarray:
    """Block-diagonal D with each D_k once per level."""
    size = sum(len(x) * n for x, n in zip(d, levels, strict=True))
    out, at = np.zeros((size, size)), 0
    for x, n in zip(d, levels, strict=True):
        for _ in range(n):
            out[at : at + len(x), at : at + len(x)] = x
            at += len(x)
    return out


def state(s: System, d: list[np.ndarray]) -> State:
    """With several factors, first for the one with the most columns (head) alone; the others'
    part of V is put in by Woodbury's identity."""
    h = 0 if s.single else s.ztz.head
    t, eye = s.ztz if s.single else s.ztz.own, np.eye(s.effects[h])
    m = eye + t @ d[h]
    q = np.linalg.solve(np.swapaxes(m, -1, -2), np.broadcast_to(d[h].T, m.shape))
    q = np.swapaxes(q, -1, -2)  # D (I + t D)^-1
    tq = t @ q
    zx, zy = s.ztx[h], s.zty[h]
    qzx, qzy = q @ zx, (q @ zy[..., None])[..., 0]
    zvx, zvy = zx - tq @ zx, zy - (tq @ zy[..., None])[..., 0]
    xvx = s.xtx - np.einsum("lqa,lqb->ab", zx, qzx)
    xvy = s.xty - np.einsum("lqa,lq->a", zx, qzy)
    yvy, logdet, r = float(s.yty - (zy * qzy).sum()), float(np.linalg.slogdet(m)[1].sum()), M.symmetric(t - tq @ t)
    if s.single:
        return State(M.symmetric(xvx), xvy, yvy, logdet, [zvx], [zvy], r)
    z, side = s.ztz, s.ztz.side.reshape(*t.shape[:2], -1)
    others = [k for k in range(len(d)) if k != h]
    w = (side - tq @ side).reshape(z.side.shape)
    g = M.symmetric(z.rest - z.side.T @ (q @ side).reshape(z.side.shape))
    a = np.concatenate([s.ztx[k].reshape(-1, s.p) for k in others]) - z.side.T @ qzx.reshape(-1, s.p)
    c = np.concatenate([s.zty[k].ravel() for k in others]) - z.side.T @ qzy.ravel()
    big = full_d([d[k] for k in others], [s.levels[k] for k in others])
    n = np.eye(len(g)) + g @ big
    mid = M.symmetric(np.linalg.solve(n.T, big.T).T)
    ma, mc, gm = mid @ a, mid @ c, g @ mid
    rx, ry = a - g @ ma, c - g @ mc
    zvx, zvy = zvx - (w @ ma).reshape(zvx.shape), zvy - (w @ mc).reshape(zvy.shape)
    cut = [z.columns(k) for k in range(len(d))]
    out = Crossed(h, s.levels, s.effects, r, w - w @ gm.T, M.symmetric(g - gm @ g), w, mid)
    zvxs = [zvx if k == h else rx[cut[k]].reshape(s.ztx[k].shape) for k in range(len(d))]
    zvys = [zvy if k == h else ry[cut[k]].reshape(s.zty[k].shape) for k in range(len(d))]
    return State(M.symmetric(xvx - a.T @ ma), xvy - a.T @ mc, float(yvy - c @ mc), logdet + float(np.linalg.slogdet(n)[1]), zvxs, zvys, out)


def start(s: System) -> tuple[np.ndarray, float, list[np.ndarray]]:
    """OLS coefficients, residual variance, and D by one scoring step from D = 0."""
    b = np.linalg.solve(s.xtx, s.xty)
    s2 = max(s.rss(b) / s.n, 1e-10)
    zero = [np.zeros((q, q)) for q in s.effects]
    st = state(s, zero)
    return b, s2, [start_d(s, st, k, b, s2) for k in range(len(zero))]


def start_d(s: System, st: State, k: int, b: np.ndarray, s2: float) -> np.ndarray:
    q = s.effects[k]
    u = st.zvy[k] - st.zvx[k] @ b
    g = M.duplication(q)
    right = np.einsum("la,lb->ab", u, u) / s2 - s.own(k).sum(axis=0)
    return M.project(M.unvech(_solve(g.T @ st.rr(s, k, k) @ g, g.T @ M.vec(right))))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def log_likelihood(s: System, st: State, b: np.ndarray, s2: float, reml: bool) -> float:
    """With its constant; restricted or full."""
    n = s.n - (s.p if reml else 0)
    q = st.yvy - 2 * b @ st.xvy + b @ st.xvx @ b
    extra = np.linalg.slogdet(st.xvx)[1] if reml else 0.0
    return float(-0.5 * (n * math.log(s2) + st.logdet + q / s2 + extra + n * math.log(2 * math.pi)))


def gradient(s: System, st: State, k: int, b: np.ndarray, s2: float, reml: bool) -> np.ndarray:
    """d llh / d D_k."""
    u = st.zvy[k] - st.zvx[k] @ b
    g = np.einsum("la,lb->ab", u, u) / s2 - st.rk(s, k)
    if reml:
        g = g + np.einsum("lap,pq,lbq->ab", st.zvx[k], np.linalg.inv(st.xvx), st.zvx[k])
    return g / 2


def information(s: System, st: State, s2: float, vech: bool = True) -> np.ndarray:
    """Fisher information of (s2, vech or vec D_1, ...)."""
    r = len(s.effects)
    g = [M.duplication(q) if vech else np.eye(q * q) for q in s.effects]
    rows = [[np.array([[s.n / (2 * s2 * s2)]])] + [(M.vec(st.rk(s, k)) @ g[k])[None] / (2 * s2) for k in range(r)]]
    rows += [[rows[0][k + 1].T, *(g[k].T @ st.rr(s, k, m) @ g[m] / 2 for m in range(r))] for k in range(r)]
    return np.block(rows)


@dataclass
class Fit:
    beta: np.ndarray
    sigma2: float
    d: list[np.ndarray]
    llh: float
    iterations: int
    converged: bool

    def vech(self) -> np.ndarray:
        return np.concatenate([M.vech(x) for x in self.d])


def fit(s: System, method: str = "pSFS", reml: bool = True, tol: float = 1e-6, max_iterations: int = 10_000, floor: float = 0.0, polish: int = 0) -> Fit:
    """Estimate by the named scoring method; a step length is halved where the likelihood fell.
    ``polish`` whole steps follow convergence, as they settle more digits than the likelihood."""
    b, s2, d = start(s)
    low = [np.eye(q) for q in s.effects]  # Cholesky factors of cSFS
    if method == "cSFS":
        d = [x @ x.T for x in low]
    st, step, last, done = state(s, d), 1.0, -math.inf, False
    for it in range(1, max_iterations + 1):
        b = _solve(st.xvx, st.xvy)
        quad = st.yvy - 2 * b @ st.xvy + b @ st.xvx @ b
        if method in ("FS", "pFS"):
            score = [np.array([-(s.n - (s.p if reml else 0)) / (2 * s2) + quad / (2 * s2 * s2)])]
            grads = [gradient(s, st, k, b, s2, reml) for k in range(len(d))]
            if method == "FS":
                score += [M.duplication(len(x)).T @ M.vec(g) for x, g in zip(d, grads, strict=True)]
                move = _solve(information(s, st, s2), np.concatenate(score))
            else:  # duplicated parameters: the information is singular, the shortest step is taken
                score += [M.vec(g) for g in grads]
                move = np.linalg.pinv(information(s, st, s2, vech=False)) @ np.concatenate(score)
            s2, at, new = s2 + step * move[0], 1, []
            for x in d:
                size = len(x) * (len(x) + 1) // 2 if method == "FS" else len(x) ** 2
                part = move[at : at + size]
                new.append(M.project(x + step * (M.unvech(part) if method == "FS" else M.unvec(part)), floor))
                at += size
            d = new
        else:
            s2 = quad / (s.n - (s.p if reml else 0))
            s2 = s2 if s2 > 0 else 1e-10
            new = list(d)
            for k in range(len(d)):
                g, rr = gradient(s, st, k, b, s2, reml), st.rr(s, k, k)
                if method == "pSFS":
                    new[k] = M.project(d[k] + step * M.unvec(_solve(rr / 2, M.vec(g))), floor)
                elif method == "SFS":
                    dup = M.duplication(len(d[k]))
                    new[k] = M.project(d[k] + step * M.unvech(_solve(dup.T @ rr @ dup / 2, dup.T @ M.vec(g))), floor)
                    st = state(s, new)
                else:
                    jac = _cholesky_jacobian(low[k])
                    low[k] = low[k] + step * M.unvech_lower(_solve(jac.T @ rr @ jac / 2, jac.T @ M.vec(g)))
                    new[k] = low[k] @ low[k].T
            d = new
        s2 = s2 if s2 > 0 else 1e-10
        st = state(s, d)
        now = log_likelihood(s, st, b, s2, reml)
        done = done or abs(now - last) < tol
        if done and not polish:
            return Fit(_solve(st.xvx, st.xvy), s2, d, now, it, True)
        if done:
            polish, step = polish - 1, 1.0
        elif now < last:
            step /= 2
        last = now
    return Fit(_solve(st.xvx, st.xvy), s2, d, last, max_iterations, done)


def _cholesky_jacobian(low: np.ndarray) -> np.ndarray:
    """d vec(L L') / d vech(L)."""
    q = len(low)
    out = []
    for unit in np.eye(q * (q + 1) // 2):
        e = M.unvech_lower(unit)
        out.append(M.vec(e @ low.T + low @ e.T))
    return np.array(out).T


def pels(s: System, theta: np.ndarray) -> tuple[float, np.ndarray, float, list[np.ndarray]]:
    """Profile likelihood in the Cholesky elements theta of D: (-llh, b, s2, s2 * D)."""
    d, at = [], 0
    for q in s.effects:
        size = q * (q + 1) // 2
        low = M.unvech_lower(np.asarray(theta, dtype=float)[at : at + size])
        d.append(low @ low.T)
        at += size
    st = state(s, d)
    b = _solve(st.xvx, st.xvy)
    s2 = (st.yvy - b @ st.xvy) / s.n
    return -log_likelihood(s, st, b, s2, False), b, float(s2), [s2 * x for x in d]
