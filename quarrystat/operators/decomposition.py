"""SVD, PCA, QR and incremental PCA of row-distributed tables, dense or sparse.

Eigenpairs come from products with the (centred, stacked) Gram matrix, one scan of the table
each; that matrix itself is never built. The driver holds a basis of a few blocks of columns,
whatever the number of rounds. A table no wider than one block takes a single product.
Component signs are fixed so that the entry of largest magnitude is positive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame

from quarrystat.operators.common import MAX_MATRIX_CELLS, width
from quarrystat.operators.gram import local_moments, multiply_local
from quarrystat.operators.products import RowProducts

#: Columns multiplied in one scan, and blocks that the basis may hold.
BLOCK, BLOCKS = 64, 4


def _fix_signs(v: np.ndarray) -> np.ndarray:
    """Largest-magnitude entry of every column made positive."""
    at = np.abs(np.round(v, 10)).argmax(0)
    return v * np.where(v[at, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def _eigh(g: np.ndarray):
    """Eigenpairs of a symmetric matrix, largest first, signs fixed."""
    lam, vec = np.linalg.eigh(g)
    return lam[::-1].copy(), _fix_signs(vec[:, ::-1])


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, tol: float = 1e-10,
                  max_iter: int = 300, seed: int = 0, square: Callable[[], np.ndarray] | None = None):
    """The ``k`` leading eigenpairs of a symmetric operator ``V -> A V`` on d numbers, descending.

    A block Krylov space grows by one product a round. When it would pass ``BLOCKS`` blocks it
    is folded to its best Ritz vectors (a thick restart), and the newest block goes on from
    there, so that at most ``BLOCKS`` blocks and their images are held. It ends when the
    residual of every wanted pair is below ``tol`` times the largest value, or the space is
    invariant. Where a block can hold all of d, the first product is the whole answer, or
    ``square``, which gives A by a shorter way.
    """
    if not 0 < k <= d:
        raise ValueError(f"k must lie in 1..{d}")
    block = min(d, max(k + 4, min(BLOCK, MAX_MATRIX_CELLS // d)))
    if block == d:
        g = square() if square else times(np.eye(d))
        lam, vec = _eigh((g + g.T) / 2)
        return lam[:k], vec[:, :k]
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    basis, image = q, np.zeros((d, 0))
    for _ in range(max_iter):
        w = times(q)
        image = np.hstack([image, w])
        t = basis.T @ image
        lam, z = np.linalg.eigh((t + t.T) / 2)
        lam, z = lam[::-1], z[:, ::-1]
        vec = basis @ z[:, :k]
        gap = np.linalg.norm(image @ z[:, :k] - vec * lam[:k], axis=0)
        if (gap <= tol * max(lam[0], 1e-300)).all() or basis.shape[1] >= d:
            return lam[:k].copy(), _fix_signs(vec)
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        q, r = np.linalg.qr(w)
        live = np.abs(np.diag(r)) > 1e-12 * max(lam[0], 1e-300)
        q = q[:, live][:, :d - basis.shape[1]]
        if not q.shape[1]:
            return lam[:k].copy(), _fix_signs(vec)
        if basis.shape[1] + q.shape[1] > BLOCKS * block:
            keep = z[:, :(BLOCKS - 2) * block]
            basis, image = basis @ keep, image @ keep
            for _ in range(2):
                q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        basis = np.hstack([basis, q])
    raise RuntimeError(f"no convergence within {max_iter} rounds")


@dataclass
class Svd:
    """``s`` singular values, ``v`` right vectors (d x k), ``u`` rows ``(id, u)``."""
    s: np.ndarray
    v: np.ndarray
    u: DataFrame | None


def _floor(d: int, least: float = 0.0) -> float:
    """Singular values below this share of the largest are rounding noise of X'X."""
    return max(least, float(np.sqrt(d * np.finfo(float).eps)))


def svd(df: DataFrame, k: int, compute_u: bool = False, r_cond: float = 1e-9,
        mode: str = "auto", tol: float = 1e-10, max_iter: int = 300) -> Svd:
    """A = U S V'.  Values at or below ``r_cond`` times the largest are dropped, and those
    in the rounding noise of X'X (sqrt(d * eps) times the largest).

    ``mode``: distributed (products with X'X; auto means the same) or local (eigenpairs of
    X'X, which the driver must hold).  U comes from A V / S, row by row, and keeps the ids.
    """
    d = width(df)
    if not 0 < k <= d:
        raise ValueError(f"k must lie in 1..{d}")
    if mode == "local":
        lam, vec = _eigh(local_moments(df)[2])
    elif mode in ("auto", "distributed"):
        x = RowProducts(df, d)
        lam, vec = leading_pairs(x.times, d, k, tol, max_iter, square=x.square)
    else:
        raise ValueError(f"unknown mode {mode}")
    s = np.sqrt(np.maximum(lam[:k], 0.0))
    rank = int((s > _floor(d, r_cond) * s[0]).sum()) if s[0] > 0 else 0
    if rank == 0:
        raise ValueError("the matrix is zero")
    s, v = s[:rank], vec[:, :rank]
    u = multiply_local(df, v / s, out="u") if compute_u else None
    return Svd(s, v, u)


def top_eigen(df: DataFrame, k: int, tol: float = 1e-10, max_iter: int = 300, seed: int = 0):
    """Leading eigenpairs of X'X, descending, from products with X'X only."""
    x = RowProducts(df, width(df))
    return leading_pairs(x.times, x.d, k, tol, max_iter, seed, x.square)


@dataclass
class Pca:
    """``pc`` components (d x k), ``ratio`` explained shares, ``mean`` columns."""
    pc: np.ndarray
    ratio: np.ndarray
    variance: np.ndarray
    mean: np.ndarray


def _centred(df: DataFrame, d: int) -> tuple[RowProducts, np.ndarray]:
    """Products with the rows less their column means, and these means, from a pass of their own."""
    rows = RowProducts(df, d)
    mean = rows.means()
    centred = RowProducts(df, d, mean)
    centred.n = rows.n
    return centred, mean


def pca(df: DataFrame, k: int, tol: float = 1e-10, max_iter: int = 300) -> Pca:
    """Components of the sample covariance; shares refer to all d values. The total variance
    comes with the first product."""
    d = width(df)
    rows, mean = _centred(df, d)
    lam, vec = leading_pairs(rows.times, d, k, tol, max_iter)
    lam = np.maximum(lam, 0.0)
    return Pca(vec, lam / rows.total, lam / (rows.n - 1), mean)


def pca_project(df: DataFrame, model: Pca, centred: bool = False, keep=("id",)) -> DataFrame:
    """Rows times the components; ``centred`` takes the means off first."""
    return multiply_local(df, model.pc, out="scores", keep=keep,
                          shift=model.mean if centred else None)


def covariance_svd(df: DataFrame, k: int, tol: float = 1e-10, max_iter: int = 300) -> Svd:
    """SVD of the population covariance matrix."""
    d = width(df)
    rows, _ = _centred(df, d)
    lam, vec = leading_pairs(rows.times, d, k, tol, max_iter)
    return Svd(np.maximum(lam, 0.0) / rows.n, vec, None)


def tall_skinny_qr(df: DataFrame, compute_q: bool = True):
    """A = Q R with a non-negative diagonal of R: ``(Q rows (id, q) or None, R)``."""
    vectors = MLUtils.convertVectorColumnsFromML(
        df.select(array_to_vector("features").alias("v")), "v")
    r = RowMatrix(vectors).tallSkinnyQR(False).R.toArray()
    r = r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]
    if not compute_q:
        return None, r
    if np.abs(np.diag(r)).min() <= 1e-12 * np.abs(np.diag(r)).max():
        raise ValueError("the columns are linearly dependent: Q is not defined by A and R")
    return multiply_local(df, np.linalg.inv(r), out="q"), r


@dataclass
class IpcaState:
    """Incremental PCA: ``u`` (d x k), singular values ``d``, means, weight ``n``."""
    u: np.ndarray
    d: np.ndarray
    mu: np.ndarray
    n: float


def ipca_fit(df: DataFrame, state: IpcaState | None = None, ff: float = 1.0,
             k: int | None = None, scale_d0: bool = False, tol: float = 1e-10) -> IpcaState:
    """First fit, or an update of ``state`` with a batch of samples.

    The update is the SVD of the old scaled components, the centred batch and one row for the
    moved mean, stacked. Only products with the stack are taken: the old components and the
    moved mean act on the driver, the batch in a scan. Without ``k`` as many components are
    kept as the stack can have. ``ff`` is the forgetting factor of the means; ``scale_d0``
    applies it to the old singular values too.
    """
    d = width(df)
    rows, mu1 = _centred(df, d)
    n = rows.n
    if state is None:
        most = min(d, n)                              # the rank of the stack is no larger
        lam, vec = leading_pairs(rows.times, d, min(most, k or most), tol)
        s = np.sqrt(np.maximum(lam, 0.0))
        keep = int((s > _floor(d, 1e-9) * s[0]).sum())
        return IpcaState(vec[:, :keep], s[:keep], mu1, float(n))
    d0 = state.d * ff if scale_d0 else state.d
    moved = np.sqrt(n * state.n / (n + state.n)) * (state.mu - mu1)

    def times(v):
        return rows.times(v) + (state.u * d0 ** 2) @ (state.u.T @ v) + np.outer(moved, moved @ v)
    total = n + ff * state.n
    mu = (ff * state.n * state.mu + n * mu1) / total
    most = min(d, n + len(d0) + 1)
    lam, vec = leading_pairs(times, d, most if k is None else min(k, most, int(total)), tol)
    lam = np.maximum(lam, 0.0)
    if k is None:
        energy = rows.total + float((d0 ** 2).sum()) + float(moved @ moved)
        keep = max(1, int((lam >= 1e-6 * energy).sum()))
        lam, vec = lam[:keep], vec[:, :keep]
    return IpcaState(vec, np.sqrt(lam), mu, float(total))
