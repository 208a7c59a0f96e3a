"""Fitting: penalised iteratively re-weighted least squares inside a Newton search for smoothing parameters.

An engine answers passes over the rows. The local one holds rows that are proven to be
few (compressed to distinct covariates, or small outright); the Spark one runs a job per
pass. All p x p algebra is on the driver.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .passes import fold

MU_FLOOR, W_LOW, W_HIGH = 1e-10, 1e-10, 1e10
LSP_MAX = 40.0
ROW = ("n", "w", "y", "ss", "sy", "d0", "off")


def glm_sums(x: np.ndarray, rows: dict, family, beta: np.ndarray) -> list:
    """X'WX, X'Wz, deviance, Pearson sum and the mean of Fletcher's correction, at beta.

    A row stands for n observations with weight w in all, mean y, and `ss`, the weighted
    squares within it; `sy` is the plain sum of its y and `d0` their deviance from y.
    """
    eta = x @ beta
    mu = family.link.inverse(eta + rows["off"])
    v = family.variance(mu)
    with np.errstate(all="ignore"):
        g = family.link.derivative(mu)
        w = np.clip(np.nan_to_num(rows["w"] / (v * g * g), nan=W_LOW, posinf=W_HIGH), W_LOW, W_HIGH)
        z = np.nan_to_num(eta + (rows["y"] - mu) * g)
        dev = float((rows["w"] * family.unit_deviance(rows["y"], mu)).sum() + rows["d0"].sum())
        pearson = float(((rows["ss"] + rows["w"] * (rows["y"] - mu) ** 2) / v).sum())
        skew = float((family.dvar(mu) * (rows["sy"] - rows["n"] * mu) / v).sum())
    xw = x * w[:, None]
    return [xw.T @ x, xw.T @ z, dev, pearson, skew]


def start_sums(x: np.ndarray, rows: dict, family) -> list:
    """Unweighted X'X and X'(g(mu0) - offset) for starting values, and the diagonal of X'wX."""
    target = family.link.link(family.initialize(rows["y"], rows["w"])) - rows["off"]
    xn = x * rows["n"][:, None]
    return [xn.T @ x, xn.T @ target, (x * x * rows["w"][:, None]).sum(0)]


def slope_sums(x: np.ndarray, rows: dict, family, beta: np.ndarray, slopes: np.ndarray, h_inv: np.ndarray) -> list:
    """What derivatives by log smoothing parameters need: T_j = X'diag(W' eta_j)X, q = sum W' h x and sum W'' h eta_j eta_k.

    h is a row's leverage x' H^-1 x; W' and W'' are derivatives of the Fisher weights by
    the linear predictor.
    """
    eta = x @ beta
    total = eta + rows["off"]
    mu = family.link.inverse(total)
    h1 = family.link.mu_eta(total)
    h2, h3 = family.link.mu_eta2(total)
    v, v1, v2 = family.variance(mu), family.dvar(mu), family.d2var(mu)
    with np.errstate(all="ignore"):
        a, c = h1 / v, h1 * v1 / v  # powers as products: pow is the slowest of these
        w1 = rows["w"] * a * (2 * h2 - h1 * c)
        w2 = rows["w"] * (2 * h2 * h2 / v + a * (2 * h3 - 5 * h2 * c - a * h1 * h1 * v2 + 2 * h1 * c * c))
    w1, w2 = np.nan_to_num(w1, posinf=0, neginf=0), np.nan_to_num(w2, posinf=0, neginf=0)
    lev = ((x @ h_inv) * x).sum(1)
    ej = x @ slopes
    t = np.stack([(x * (w1 * ej[:, j])[:, None]).T @ x for j in range(slopes.shape[1])]) if slopes.shape[1] else np.zeros((0, len(beta), len(beta)))
    return [t, x.T @ (w1 * lev), ej.T @ (ej * (w2 * lev)[:, None])]


class LocalEngine:
    """Rows held on the driver, as their number of bytes was found small; passes go over them in pieces that fit a cache."""

    PIECE = 65_536

    def __init__(self, x: np.ndarray, rows: dict, family):
        self.x, self.rows, self.family = x, rows, family

    def _fold(self, kernel, *args):
        def piece(at):
            part = slice(at, at + self.PIECE)
            return kernel(self.x[part], {k: v[part] for k, v in self.rows.items()}, self.family, *args)

        starts = range(0, max(len(self.x), 1), self.PIECE)
        if len(starts) == 1:
            return piece(0)
        # Sums are added in the order of the pieces, whichever is done first.
        with ThreadPoolExecutor(min(len(starts), os.cpu_count() or 1)) as pool:
            return [sum(parts[1:], parts[0]) for parts in zip(*pool.map(piece, starts))]

    def start(self):
        return self._fold(start_sums)

    def sums(self, beta):
        return self._fold(glm_sums, beta)

    def slopes(self, beta, slopes, h_inv):
        return self._fold(slope_sums, beta, slopes, h_inv)


class SparkEngine:
    """One job a pass; each Arrow batch makes its rows of the model matrix anew."""

    def __init__(self, df: DataFrame, setup, family):
        self.df, self.setup, self.family = df, setup, family

    def _fold(self, kernel, *args):
        setup, family = self.setup, self.family

        def step(cols):
            rows = {k: cols[f"__{k}"] for k in ROW}
            return [np.asarray(a, float) for a in kernel(setup.eval(cols), rows, family, *args)]

        out = fold(self.df, step)
        return [float(a) if a.ndim == 0 else a for a in out]

    def start(self):
        return self._fold(start_sums)

    def sums(self, beta):
        return self._fold(glm_sums, beta)

    def slopes(self, beta, slopes, h_inv):
        return self._fold(slope_sums, beta, slopes, h_inv)


class GramEngine:
    """Gaussian responses with the identity link: one Gram matrix answers every pass."""

    def __init__(self, engine, p: int, y_square: float, n: float, start):
        self._start = start
        self.a, self.b, *_ = engine.sums(np.zeros(p))
        self.yy, self.n = y_square, n

    def start(self):
        return self._start

    def sums(self, beta):
        dev = float(self.yy - 2 * beta @ self.b + beta @ self.a @ beta)
        return [self.a, self.b, max(dev, 0.0), max(dev, 0.0), 0.0]

    def slopes(self, beta, slopes, h_inv):
        p, m = len(beta), slopes.shape[1]
        return [np.zeros((m, p, p)), np.zeros(p), np.zeros((m, m))]


def factor(h: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant of H, preconditioned by its diagonal; a growing ridge if it isn't definite."""
    d = np.sqrt(np.maximum(np.diag(h), 1e-300))
    c = h / np.outer(d, d)
    ridge = 0.0
    for _ in range(8):
        try:
            low = np.linalg.cholesky(c + ridge * np.eye(len(c)))
            break
        except np.linalg.LinAlgError:
            ridge = max(ridge * 100, 1e-12)
    else:
        raise np.linalg.LinAlgError("The penalised cross-product is not positive definite")
    inv = np.linalg.inv(low)
    return (inv.T @ inv) / np.outer(d, d), float(2 * np.log(np.diag(low)).sum() + 2 * np.log(d).sum())


@dataclass
class Inner:
    """A converged inner fit."""

    beta: np.ndarray
    xwx: np.ndarray
    deviance: float
    pearson: float
    skew: float
    converged: bool
    n_iter: int


def pirls(engine, beta: np.ndarray, s: np.ndarray, tol: float = 1e-7, max_iter: int = 100) -> Inner:
    """Each pass gives the cross-products and the deviance at one beta, so a full step is one pass."""
    sums = engine.sums(beta)
    pd = sums[2] + beta @ s @ beta
    converged, i = False, 0
    once = isinstance(engine, GramEngine)
    for i in range(1, max_iter + 1):
        h_inv, _ = factor(sums[0] + s)
        new = h_inv @ sums[1]
        step = new - beta
        at = engine.sums(new)
        pd_new = at[2] + new @ s @ new
        ok = np.isfinite(pd_new) and (once or pd_new <= pd + 1e-7 * abs(pd))
        k = 0
        while not ok and k < 25:
            new = beta + step * 0.5 ** (k + 2)
            at = engine.sums(new)
            pd_new = at[2] + new @ s @ new
            ok = np.isfinite(pd_new) and pd_new <= pd + 1e-7 * abs(pd)
            k += 1
        if not ok:
            converged = True  # no step lowers the penalised deviance
            break
        moved = np.abs(new - beta).max(initial=0) / (0.1 + np.abs(new).max(initial=0))
        fell = abs(pd - pd_new) / (0.1 + abs(pd_new))
        beta, sums, pd = new, at, pd_new
        if once or i >= 3 and fell < tol and moved < tol:
            converged = True
            break
    return Inner(beta, sums[0], sums[2], sums[3], sums[4], converged, i)


@dataclass
class Problem:
    """What the outer search needs besides the rows."""

    penalties: list[np.ndarray]  # in the coordinates of the engine
    blocks: list  # (indices, range-space projections of their matrices, or rank and constant of a single one)
    null_dim: int
    family: object
    saturated: dict
    n: float
    reml: bool = True

    def s(self, rho) -> np.ndarray:
        out = np.zeros_like(self.penalties[0]) if self.penalties else None
        for r, m in zip(rho, self.penalties):
            out = out + np.exp(r) * m
        return out

    def log_det(self, rho):
        """ln |S|+ with gradient and Hessian by rho; each block apart."""
        m = len(self.penalties)
        value, grad, hess = 0.0, np.zeros(m), np.zeros((m, m))
        for idx, mats in self.blocks:
            if len(idx) == 1:
                rank, const = mats
                value += rank * rho[idx[0]] + const
                grad[idx[0]] += rank
                continue
            r = np.asarray(rho)[idx]
            top = r.max()
            lam = np.exp(r - top)
            total = sum(w * p for w, p in zip(lam, mats))
            sign, ld = np.linalg.slogdet(total)
            value += (ld if sign > 0 else -1e10) + len(total) * top
            inv = np.linalg.pinv(total)
            parts = [w * inv @ p for w, p in zip(lam, mats)]
            for a, ja in enumerate(idx):
                grad[ja] += np.trace(parts[a])
                for b, jb in enumerate(idx):
                    hess[ja, jb] += (np.trace(parts[a]) if a == b else 0.0) - np.sum(parts[a] * parts[b].T)
        return value, grad, hess


@dataclass
class Outer:
    """Result of the outer search."""

    rho: np.ndarray
    log_phi: float | None
    inner: Inner
    score: float | None
    gradient: np.ndarray
    converged: bool
    n_iter: int
    message: str
    scores: list = field(default_factory=list)


def criterion(problem: Problem, rho, log_phi, inner: Inner, phi: float | None = None) -> float:
    phi = np.exp(log_phi) if log_phi is not None else (1.0 if phi is None else phi)
    s = problem.s(rho) if len(rho) else np.zeros_like(inner.xwx)
    dp = inner.deviance + inner.beta @ s @ inner.beta
    ls = problem.family.saturated_slopes(problem.saturated, phi)[0]
    value = dp / (2 * phi) - ls + 0.5 * factor(inner.xwx + s)[1] - 0.5 * problem.log_det(rho)[0]
    return float(value - (0.5 * problem.null_dim * np.log(2 * np.pi * phi) if problem.reml else 0.0))


def derivatives(problem: Problem, engine, rho, log_phi, inner: Inner):
    """Gradient and Hessian of the criterion by (rho, ln phi), through the inner fit.

    With stationarity at beta: beta_j = -H^-1 lambda_j S_j beta and H_j = T_j + lambda_j S_j.
    Second order terms of W enter through two sums weighted by the rows' leverages.
    """
    m, beta = len(rho), inner.beta
    phi = 1.0 if log_phi is None else np.exp(log_phi)
    lam = np.exp(rho)
    s = problem.s(rho)
    h_inv, _ = factor(inner.xwx + s)
    sb = np.column_stack([lam[j] * (problem.penalties[j] @ beta) for j in range(m)])
    bj = -h_inv @ sb
    t, q, curve = engine.slopes(beta, bj, h_inv)
    hj = [t[j] + lam[j] * problem.penalties[j] for j in range(m)]
    tr = [h_inv @ h for h in hj]
    bsb = np.array([beta @ sb[:, j] for j in range(m)])
    _, d1, d2 = problem.log_det(rho)
    grad = bsb / (2 * phi) + 0.5 * np.array([np.trace(x) for x in tr]) - 0.5 * d1
    hess = np.zeros((m, m))
    for j in range(m):
        for k in range(j, m):
            rhs = hj[k] @ bj[:, j] + lam[j] * (problem.penalties[j] @ bj[:, k]) + (sb[:, j] if j == k else 0.0)
            bjk = -h_inv @ rhs
            pen = (bsb[j] if j == k else 0.0) + 2 * (sb[:, j] @ bj[:, k])
            second = curve[j, k] + q @ bjk + (np.sum(h_inv * (lam[j] * problem.penalties[j])) if j == k else 0.0)
            hess[j, k] = hess[k, j] = pen / (2 * phi) + 0.5 * (second - np.sum(tr[j] * tr[k].T)) - 0.5 * d2[j, k]
    if log_phi is None:
        return grad, hess
    dp = inner.deviance + bsb.sum()
    _, ls1, ls2 = problem.family.saturated_slopes(problem.saturated, phi)
    g = -dp / (2 * phi) - ls1 - (0.5 * problem.null_dim if problem.reml else 0.0)
    cross = -bsb / (2 * phi)
    return np.append(grad, g), np.block([[hess, cross[:, None]], [cross[None, :], np.array([[dp / (2 * phi) - ls2]])]])


def newton_step(grad: np.ndarray, hess: np.ndarray, power: float, cap: float = 5.0) -> np.ndarray:
    """Newton step on the Hessian with its eigenvalues made positive and kept off zero."""
    val, vec = np.linalg.eigh((hess + hess.T) / 2)
    val = np.abs(val)
    val = np.maximum(val, max(val.max(), 1e-300) * np.finfo(float).eps ** power)
    step = -vec @ ((vec.T @ grad) / val)
    return step * min(1.0, cap / max(np.abs(step).max(), 1e-300))


def search(problem: Problem, engine, beta: np.ndarray, rho: np.ndarray, log_phi: float | None, max_iter: int = 200) -> Outer:
    """Outer Newton search with step halving, bounds on rho, and inactive directions left out."""
    gaussian = problem.family.family_name == "gaussian"
    tol = np.finfo(float).eps ** 0.5 if gaussian else 1e-6
    inner_tol = min(1e-7, tol * 1e-2)
    m = len(rho)
    params = np.append(rho, log_phi) if log_phi is not None else np.array(rho, float)

    def fit(x, warm):
        inner = pirls(engine, warm, problem.s(x[:m]), inner_tol)
        return inner, criterion(problem, x[:m], x[m] if log_phi is not None else None, inner)

    inner, score = fit(params, beta)
    scores, stuck, message, done, it = [score], 0, "iteration limit", False, 0
    grad = np.zeros(len(params))
    for it in range(1, max_iter + 1):
        grad, hess = derivatives(problem, engine, params[:m], params[m] if log_phi is not None else None, inner)
        at_bound = np.zeros(len(params), bool)
        at_bound[:m] = ((params[:m] >= LSP_MAX) & (grad[:m] < 0)) | ((params[:m] <= -LSP_MAX) & (grad[:m] > 0))
        scale = 1 + abs(score) if gaussian else abs(params[m] if log_phi is not None else 0.0) + abs(score)
        free = ~at_bound & ((np.abs(grad) > 0.1 * tol * scale) | (np.abs(np.diag(hess)) > 0.1 * tol * scale))
        pg = np.where(at_bound, 0.0, grad)
        moved = len(scores) > 1 and abs(scores[-1] - scores[-2]) <= tol * scale
        if not free.any() or np.abs(pg).max() <= 5 * tol * scale and (moved or len(scores) == 1):
            message, done = "full convergence", True
            break
        step = np.zeros(len(params))
        step[free] = newton_step(grad[free], hess[np.ix_(free, free)], 0.5 if gaussian else 0.7)
        best = None
        for k in range(30):
            if k == 4 and it <= 10 and not gaussian:  # the quadratic model is no good here: go down the slope
                down = np.where(free, -grad, 0.0)
                step = down * min(np.linalg.norm(step) * 2**k, 2.0) / max(np.linalg.norm(down), 1e-300) * 0.5**-k
            trial = params + step * 0.5**k
            trial[:m] = np.clip(trial[:m], -LSP_MAX, LSP_MAX)
            try:
                found = fit(trial, inner.beta)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(found[1]) and found[1] <= score + 1e-12 * abs(score):
                best = trial, *found
                break
            if np.abs(step).max() * 0.5**k < 1e-8:
                break
        if best is None or best[1] is None:
            stuck += 1
            message, done = "step failed", stuck >= 1 and np.abs(pg).max() <= 1e3 * tol * scale
            break
        stuck = stuck + 1 if abs(score - best[2]) <= 1e-14 * abs(score) else 0
        params, inner, score = best[0], best[1], best[2]
        scores.append(score)
        if stuck >= 3:
            message, done = "score no longer falls", True
            break
    return Outer(params[:m], float(params[m]) if log_phi is not None else None, inner, score, grad, done, it, message, scores)
