"""Statistics of a fitted model: covariance, T and F contrasts, degrees of freedom, R^2."""

from __future__ import annotations

import numpy as np

from . import estimators as E
from . import matrices as M
from . import tails


def cov_beta(st: E.State, s2: float) -> np.ndarray:
    return s2 * np.linalg.inv(st.xvx)


def residual_ms(s: E.System, b: np.ndarray) -> float:
    """e'e / (n - p)."""
    return s.rss(b) / (s.n - s.p)


def variance_gradient(s: E.System, st: E.State, row: np.ndarray, s2: float) -> np.ndarray:
    """Gradient of var(row b) in (s2, vech D_1, ...)."""
    v = np.linalg.solve(st.xvx, row)
    out = [np.array([row @ v])]
    for k, q in enumerate(s.effects):
        w = st.zvx[k] @ v
        out.append(s2 * M.duplication(q).T @ M.vec(np.einsum("la,lb->ab", w, w)))
    return np.concatenate(out)


def df_t(s: E.System, st: E.State, row: np.ndarray, s2: float) -> float:
    """Satterthwaite degrees of freedom of a T contrast."""
    g = variance_gradient(s, st, row, s2)
    var = s2 * row @ np.linalg.solve(st.xvx, row)
    below = g @ np.linalg.lstsq(E.information(s, st, s2), g, rcond=None)[0]
    return float(2 * var * var / below) if below > 0 else float("nan")


def df_f(s: E.System, st: E.State, rows: np.ndarray, s2: float) -> float:
    """Degrees of freedom of an F contrast from those of its rows; NaN if one is 2 or less."""
    rank = np.linalg.matrix_rank(rows)
    each = np.array([df_t(s, st, r, s2) for r in rows[:rank]])
    if not (each > 2).all():
        return float("nan")
    e = (each / (each - 2)).sum()
    return float(2 * e / (e - rank)) if e > rank else float("nan")


def contrast(s: E.System, st: E.State, b: np.ndarray, s2: float, rows: np.ndarray, kind: str, min_log: float) -> dict:
    """est, se, stat, df, neglog10p, r2 of a contrast (est and se only for T, r2 only for F)."""
    cov = rows @ cov_beta(st, s2) @ rows.T
    lb = rows @ b
    if kind == "T":
        se = float(np.sqrt(cov[0, 0]))
        df = df_t(s, st, rows[0], s2)
        t = float(lb[0] / se) if se > 0 else float("nan")
        return {"est": float(lb[0]), "se": se, "stat": t, "df": df, "neglog10p": float(tails.t_to_p(t, df, min_log)), "r2": None}
    rank = int(np.linalg.matrix_rank(rows))
    f = float(lb @ np.linalg.solve(cov, lb) / rank)
    df = df_f(s, st, rows, s2)
    return {"est": None, "se": None, "stat": f, "df": df, "neglog10p": float(tails.f_to_p(f, rank, df, min_log)), "r2": rank * f / (rank * f + df)}
