"""Quadratic penalties on coefficients: driver-side p x p algebra."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


class Penalty:
    """A symmetric matrix with its rank."""

    def __init__(self, s, rank: int | None = None):
        s = np.asarray(s, float)
        if s.ndim != 2:
            raise ValueError("A penalty has two dimensions")
        if s.shape[0] != s.shape[1]:
            raise ValueError("A penalty is square")
        if not np.allclose(s, s.T, rtol=1e-10, atol=1e-12):
            raise ValueError("A penalty is symmetric")
        self.s = s
        self.rank = eigen_rank(s) if rank is None else rank
        self.null_space_dim = len(s) - self.rank

    @property
    def size(self) -> int:
        return len(self.s)


class CompositePenalty:
    """Penalties of one size, each with a log smoothing parameter."""

    def __init__(self, penalties: list[Penalty], log_sp=None):
        if not penalties:
            raise ValueError("At least one penalty is needed")
        if len({p.size for p in penalties}) > 1:
            raise ValueError("Penalties have one size")
        self.penalties = list(penalties)
        self.log_sp = np.zeros(len(penalties)) if log_sp is None else np.asarray(log_sp, float)
        if len(self.log_sp) != len(penalties):
            raise ValueError("One smoothing parameter per penalty")

    def weighted(self, log_sp=None) -> np.ndarray:
        rho = self.log_sp if log_sp is None else np.asarray(log_sp, float)
        if len(rho) != len(self.penalties):
            raise ValueError("One smoothing parameter per penalty")
        return sum(np.exp(r) * p.s for r, p in zip(rho, self.penalties))


def embed(s: np.ndarray, start: int, p: int) -> np.ndarray:
    if start < 0 or start + len(s) > p:
        raise ValueError("The block lies outside of the matrix")
    out = np.zeros((p, p))
    out[start : start + len(s), start : start + len(s)] = s
    return out


def eigen_rank(s: np.ndarray) -> int:
    if not s.size:
        return 0
    val = np.linalg.eigvalsh(s)
    return int((val > val.max(initial=0) * EPS ** (2 / 3)).sum()) if val.max(initial=0) > 0 else 0


def sqrt_rows(s: np.ndarray) -> np.ndarray:
    """R with R'R = S, of as many rows as the rank."""
    val, vec = np.linalg.eigh(s)
    keep = val > max(val.max(initial=0), 0) * EPS ** (2 / 3)
    return (vec[:, keep] * np.sqrt(val[keep])).T


def shrink(s: np.ndarray, factor: float = 0.1, chained: bool = True) -> np.ndarray:
    """Penalises the null space too: zero eigenvalues become the smallest other one times powers of factor (or factor)."""
    val, vec = np.linalg.eigh(s)
    null = int((val < val.max() * EPS ** (2 / 3)).sum())
    if null:
        least = val[null]
        val = val.copy()
        val[:null] = [least * (factor ** (null - i) if chained else factor) for i in range(null)]
    return (vec * val) @ vec.T


def initial_log_sp(diag_xx: np.ndarray, penalties: list[np.ndarray]) -> np.ndarray:
    """Start: average diagonals balanced, then by factors of ten until the data's share of them is near 0.4."""
    out = []
    for s in penalties:
        d = np.diag(s)
        on = np.abs(s).max(1) > EPS**0.8 * max(np.abs(s).max(), 1e-300)
        xx, ss = diag_xx[on].mean(), d[on].mean()
        lam = xx / ss if ss > 0 and xx > 0 else 1.0
        share = lambda l: float(np.mean(diag_xx[on] / (diag_xx[on] + l * d[on] + 1e-300)))
        for _ in range(200):
            if share(lam) > 0.4 * 1.5:
                lam *= 10
            elif share(lam) < 0.4 / 1.5:
                lam /= 10
            else:
                break
            if not 1e-12 < lam < 1e12 * max(1.0, xx / max(ss, 1e-300)):
                break
        out.append(np.log(lam))
    return np.array(out)
