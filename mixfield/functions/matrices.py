"""Batched matrix helpers: any leading dimensions, column-major vec and vech."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def vec(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2).reshape(*a.shape[:-2], -1)


def unvec(v: np.ndarray) -> np.ndarray:
    n = round(v.shape[-1] ** 0.5)
    return np.swapaxes(v.reshape(*v.shape[:-1], n, n), -1, -2)


@lru_cache
def _lower(n: int) -> tuple[np.ndarray, np.ndarray]:
    col, row = np.triu_indices(n)
    return row, col


def vech(a: np.ndarray) -> np.ndarray:
    row, col = _lower(a.shape[-1])
    return a[..., row, col]


def unvech(v: np.ndarray) -> np.ndarray:
    n = round(((8 * v.shape[-1] + 1) ** 0.5 - 1) / 2)
    row, col = _lower(n)
    out = np.zeros((*v.shape[:-1], n, n))
    out[..., row, col] = out[..., col, row] = v
    return out


def unvech_lower(v: np.ndarray) -> np.ndarray:
    """Lower-triangular matrix of a vech."""
    return np.tril(unvech(v))


@lru_cache
def duplication(n: int) -> np.ndarray:
    """G with G vech(A) = vec(A) for symmetric A."""
    return vec(unvech(np.eye(n * (n + 1) // 2))).T.copy()


@lru_cache
def elimination(n: int) -> np.ndarray:
    """L with L vec(A) = vech(A)."""
    row, col = _lower(n)
    out = np.zeros((len(row), n * n))
    out[np.arange(len(row)), col * n + row] = 1
    return out


@lru_cache
def duplication_inverse(n: int) -> np.ndarray:
    g = duplication(n)
    return g.T / (g * g).sum(axis=0)[:, None]


@lru_cache
def commutation(a: int, b: int) -> np.ndarray:
    """K with K vec(A) = vec(A') for A of shape (a, b)."""
    return np.eye(a * b)[np.arange(a * b).reshape(b, a).T.ravel()]


def kron(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.einsum("...ij,...kl->...ikjl", a, b)
    return out.reshape(*out.shape[:-4], a.shape[-2] * b.shape[-2], a.shape[-1] * b.shape[-1])


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + np.swapaxes(a, -1, -2)) / 2


def blocks(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """(..., i, j, rows, cols) view of a matrix cut into blocks."""
    m, n = a.shape[-2] // rows, a.shape[-1] // cols
    return np.swapaxes(a.reshape(*a.shape[:-2], m, rows, n, cols), -3, -2)


def stacked(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Blocks one below another, row of blocks by row."""
    b = blocks(a, rows, cols)
    return b.reshape(*b.shape[:-4], -1, cols)


def vec_blocks(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """vec of every block, one per row."""
    b = vec(blocks(a, rows, cols))
    return b.reshape(*b.shape[:-3], -1, rows * cols)


def sum_products(a: np.ndarray, b: np.ndarray, shape_a: tuple[int, int], shape_b: tuple[int, int]) -> np.ndarray:
    """Sum over blocks of A_ij B_ij'."""
    return np.einsum("...ijab,...ijcb->...ac", blocks(a, *shape_a), blocks(b, *shape_b))


def sum_krons(a: np.ndarray, b: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sum over blocks of A_ij (x) B_ij."""
    out = np.einsum("...ijab,...ijcd->...acbd", blocks(a, *shape), blocks(b, *shape))
    return out.reshape(*out.shape[:-4], shape[0] ** 2, shape[1] ** 2)


def block_inverse(a: np.ndarray, size: int) -> np.ndarray:
    """Inverse of a block-diagonal matrix, block by block."""
    n = a.shape[-1] // size
    parts = np.linalg.inv(np.stack([a[..., i * size : (i + 1) * size, i * size : (i + 1) * size] for i in range(n)], axis=-3))
    out = np.zeros_like(a, dtype=float)
    for i in range(n):
        out[..., i * size : (i + 1) * size, i * size : (i + 1) * size] = parts[..., i, :, :]
    return out


def schur_inverse(m: np.ndarray, head: int, size: int) -> np.ndarray:
    """Inverse of a symmetric matrix whose leading ``head`` columns are block-diagonal."""
    if head >= m.shape[-1]:
        return block_inverse(m, size)
    a, b, c = block_inverse(m[:head, :head], size), m[:head, head:], m[head:, head:]
    ab = a @ b
    s = np.linalg.inv(c - b.T @ ab)
    return np.block([[a + ab @ s @ ab.T, -ab @ s], [-s @ ab.T, s]])


def project(d: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """Nearest symmetric matrix with eigenvalues of at least ``floor``, each on its own."""
    d = symmetric(d)
    if d.shape[-1] == 1:
        return np.maximum(d, floor)
    w, v = np.linalg.eigh(d)
    return np.where((w.min(axis=-1) >= floor)[..., None, None], d, (v * np.maximum(w, floor)[..., None, :]) @ np.swapaxes(v, -1, -2))


def structural_nonzero(levels: list[int], effects: list[int]) -> np.ndarray:
    """Cells of Z'Z that may differ from zero: a level's own block, and all across factors."""
    tag = np.concatenate([np.repeat(np.arange(n), q) for n, q in zip(levels, effects, strict=True)])
    factor = np.concatenate([np.full(n * q, k) for k, (n, q) in enumerate(zip(levels, effects, strict=True))])
    return (factor[:, None] != factor[None]) | (tag[:, None] == tag[None])
