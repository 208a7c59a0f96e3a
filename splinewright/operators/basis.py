"""Basis expansions: fitted from aggregates, evaluated row by row on numpy batches.

A basis has `setup(facts)`, `eval(cols)` -> rows x n_coefs, `penalties`, `ranks`,
`null_dim` and `variables`. `facts` answers aggregate questions about the data (see
passes.Facts), so no basis ever sees the rows themselves.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np

from ..plans.formula import SmoothSpec
from ..plans.penalties import EPS, eigen_rank, shrink


class Basis:
    centred = True  # takes a sum-to-zero constraint
    margin = True

    def __init__(self, spec: SmoothSpec):
        self.spec, self.variables = spec, list(spec.variables)
        self.penalties: list[np.ndarray] = []
        self.ranks: list[int] = []
        self.null_dim = 0

    def setup(self, facts) -> None:
        raise NotImplementedError

    def eval(self, cols: dict) -> np.ndarray:
        raise NotImplementedError

    def rescale(self, row_norm: float) -> None:
        """Penalties brought to the size of the data's cross-product."""
        self.penalties = [s * (row_norm**2 / np.abs(s).sum(0).max()) if s.any() else s for s in self.penalties]


class Cubic(Basis):
    """Cubic regression splines by values at knots: cr, cs (with shrinkage) and cc (cyclic)."""

    def __init__(self, spec: SmoothSpec):
        super().__init__(spec)
        if len(self.variables) != 1:
            raise ValueError(f"bs='{spec.bs}' takes one variable: {spec.label}")
        self.k = 10 if spec.k < 0 else spec.k
        if self.k < 3:
            raise ValueError(f"k of {spec.label} must be at least 3")
        self.cyclic = spec.bs == "cc"

    def setup(self, facts) -> None:
        x = self.variables[0]
        self.knots = np.asarray(facts.distinct_percentiles(x, self.k), float)
        if self.k > (n := facts.n_distinct(x)):
            raise ValueError(f"{self.spec.label}: k={self.k} is more than the {n} distinct values of {x}")
        self.curve, s = (self._cyclic if self.cyclic else self._natural)()
        self.n_coefs = len(s)
        self.ranks, self.null_dim = [self.k - 2], 1 if self.cyclic else 2
        if self.spec.bs == "cs":
            s = shrink(s)
            self.ranks, self.null_dim = [self.k], 0
        self.penalties = [s]

    def _natural(self):
        """Second derivatives at the knots as a linear map of the values, and the integrated squared one."""
        h = np.diff(self.knots)
        k = self.k
        d = np.zeros((k - 2, k))
        i = np.arange(k - 2)
        d[i, i], d[i, i + 1], d[i, i + 2] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
        b = np.diag((h[:-1] + h[1:]) / 3) + np.diag(h[1:-1] / 6, 1) + np.diag(h[1:-1] / 6, -1)
        inner = np.linalg.solve(b, d)
        s = d.T @ inner
        return np.vstack((np.zeros(k), inner, np.zeros(k))), (s + s.T) / 2

    def _cyclic(self):
        h = np.diff(self.knots)
        n = self.k - 1
        b, d = np.zeros((n, n)), np.zeros((n, n))
        for i in range(n):
            before, after = h[i - 1], h[i]
            b[i, i] += (before + after) / 3
            d[i, i] -= 1 / before + 1 / after
            for j, w in (((i - 1) % n, before), ((i + 1) % n, after)):
                b[i, j] += w / 6
                d[i, j] += 1 / w
        curve = np.linalg.solve(b, d)
        s = d.T @ curve
        return curve, (s + s.T) / 2

    def wrap(self, x: np.ndarray) -> np.ndarray:
        """Values outside of the knots brought into the first period."""
        lo, hi = self.knots[0], self.knots[-1]
        return np.where((x < lo) | (x > hi), lo + np.mod(x - lo, hi - lo), x)

    def eval(self, cols: dict) -> np.ndarray:
        x, t = np.asarray(cols[self.variables[0]], float), self.knots
        if self.cyclic:
            x = self.wrap(x)
        j = np.clip(np.searchsorted(t, x) - 1, 0, self.k - 2)
        h = t[j + 1] - t[j]
        up, down = x - t[j], t[j + 1] - x
        # Outside of the knots the cubic part on the outer side is gone: lines go on.
        c_down = (np.where(x > t[-1], 0.0, down**3 / h) - h * down) / 6
        c_up = (np.where(x < t[0], 0.0, up**3 / h) - h * up) / 6
        nxt = (j + 1) % self.n_coefs if self.cyclic else j + 1
        out = c_down[:, None] * self.curve[j] + c_up[:, None] * self.curve[nxt]
        rows = np.arange(len(x))
        out[rows, j] += down / h
        out[rows, nxt] += up / h
        return out


def polynomial_powers(d: int, m: int) -> list[tuple[int, ...]]:
    """Powers of the monomials of total degree under m: by degree, then by falling first powers."""
    return [p for total in range(m) for p in sorted((q for q in product(range(total + 1), repeat=d) if sum(q) == total), reverse=True)]


def polynomials(x: np.ndarray, powers: list[tuple[int, ...]]) -> np.ndarray:
    """The monomials of these powers, one column each."""
    return np.column_stack([np.prod([x[:, j] ** q for j, q in enumerate(p)], axis=0) for p in powers])


def thin_plate_kernel(r: np.ndarray, m: int, d: int) -> np.ndarray:
    """The radial function whose semi-norm is the thin plate penalty of order m in d dimensions."""
    power = 2 * m - d
    if d % 2 == 0:
        c = (-1) ** (m + 1 + d // 2) / (2 ** (2 * m - 1) * math.pi ** (d / 2) * math.factorial(m - 1) * math.factorial(m - d // 2))
        safe = np.where(r > 0, r, 1.0)
        return c * safe**power * np.log(safe) * (r > 0)
    c = math.gamma(d / 2 - m) / (2 ** (2 * m) * math.pi ** (d / 2) * math.factorial(m - 1))
    return c * r**power


class ThinPlate(Basis):
    """Thin plate regression splines: tp, and ts with shrinkage."""

    CHUNK = 4096  # rows whose distances to all knots are held at once

    def __init__(self, spec: SmoothSpec):
        super().__init__(spec)
        d = len(self.variables)
        m = spec.extra.get("m")
        self.m = (d + 2) // 2 + (d + 2) % 2 if not isinstance(m, int) or m < 1 else m
        if 2 * self.m <= d:
            raise ValueError(f"{spec.label}: 2 m must be more than the number of variables")
        self.powers = polynomial_powers(d, self.m)
        null = len(self.powers)
        self.k = spec.k if spec.k > 0 else {1: 10, 2: 30}.get(d, null + 100)
        self.k = max(self.k, null + 1)
        self.max_knots = int(spec.extra.get("max_knots", 2000))

    def _polynomials(self, x: np.ndarray) -> np.ndarray:
        return polynomials(x, self.powers)

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        d2 = ((x[:, None, :] - self.at[None, :, :]) ** 2).sum(2)
        return thin_plate_kernel(np.sqrt(d2), self.m, x.shape[1])

    def setup(self, facts) -> None:
        self.shift = np.array([facts.mean(v) for v in self.variables])
        knots = facts.distinct_rows(self.variables, self.max_knots)
        if len(knots) < self.k:
            raise ValueError(f"{self.spec.label}: k={self.k} is more than the {len(knots)} distinct points")
        self.at = knots - self.shift
        e, t = self._kernel(self.at), self._polynomials(self.at)
        val, vec = np.linalg.eigh(e)
        top = np.argsort(-np.abs(val), kind="stable")[: self.k]
        u, d = vec[:, top], val[top]
        null = t.shape[1]
        z = np.linalg.qr((t.T @ u).T, mode="complete")[0][:, null:]
        self.to_smooth = u @ z
        s = np.zeros((self.k, self.k))
        s[: self.k - null, : self.k - null] = (z.T * d) @ z
        self.scale = np.ones(self.k)
        self.n_coefs = self.k
        sums = facts.basis_sums(self)
        self.scale = np.sqrt(sums["squares"] / sums["n"])
        s = s / np.outer(self.scale, self.scale)
        s = (s + s.T) / 2
        self.ranks, self.null_dim = [self.k - null], null
        if self.spec.bs == "ts":
            s = shrink(s, 0.1, chained=False)
            self.ranks, self.null_dim = [self.k], 0
        self.penalties = [s]

    def eval(self, cols: dict) -> np.ndarray:
        x = np.column_stack([np.asarray(cols[v], float) for v in self.variables]) - self.shift
        out = np.empty((len(x), self.k))
        for s in range(0, len(x), self.CHUNK):
            part = x[s : s + self.CHUNK]
            out[s : s + self.CHUNK] = np.hstack((self._kernel(part) @ self.to_smooth, self._polynomials(part)))
        return out / self.scale


def row_tensor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise Kronecker product, the last factor's columns fastest."""
    return (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)


class Tensor(Basis):
    """te: products of one-dimensional bases; ti: the same with each margin's mean taken out."""

    def __init__(self, spec: SmoothSpec):
        super().__init__(spec)
        if len(self.variables) < 2:
            raise ValueError(f"{spec.label} takes two variables at least")
        if len(set(self.variables)) < len(self.variables):
            raise ValueError(f"{spec.label} takes distinct variables")
        self.margins = [make_basis(SmoothSpec("s", (v,), spec.bs, spec.k, None, spec.extra)) for v in self.variables]
        self.centred = spec.kind == "te"

    def setup(self, facts) -> None:
        self.maps, self.margin_norms, sizes, squares, ranks = [], [], [], [], []
        for margin, v in zip(self.margins, self.variables):
            margin.setup(facts)
            s, to = margin.penalties[0], np.eye(margin.n_coefs)
            if not self.centred:  # ti
                z = null_of_sums(facts.basis_sums(margin)["sums"])
                s, to = z.T @ s @ z, z
            if not isinstance(margin, Cubic):
                lo, hi = facts.range(v)
                x = margin.eval({v: np.linspace(lo, hi, to.shape[1])}) @ to
                u, d, vt = np.linalg.svd(x)
                if d[-1] / d[0] >= EPS ** (2 / 3):
                    xp = (vt.T / d) @ u.T  # parameters become values at points spread evenly
                    s, to = xp.T @ s @ xp, to @ xp
            self.maps.append(to)
            s = (s + s.T) / 2
            squares.append(s / np.linalg.eigvalsh(s)[-1])
            ranks.append(eigen_rank(s))
            sizes.append(len(s))
        self.n_coefs = int(np.prod(sizes))
        self.penalties = []
        for j in range(len(sizes)):
            out = np.ones((1, 1))
            for i, n in enumerate(sizes):
                out = np.kron(out, squares[i] if i == j else np.eye(n))
            self.penalties.append(out)
        self.ranks = [r * self.n_coefs // n for r, n in zip(ranks, sizes)]
        self.null_dim = int(np.prod([n - r for n, r in zip(sizes, ranks)]))

    def eval(self, cols: dict) -> np.ndarray:
        out = None
        for margin, to in zip(self.margins, self.maps):
            x = margin.eval(cols) @ to
            out = x if out is None else row_tensor(out, x)
        return out


def null_of_sums(sums: np.ndarray) -> np.ndarray:
    """Orthonormal columns orthogonal to the column sums: the sum-to-zero map."""
    return np.linalg.qr(np.asarray(sums, float)[:, None], mode="complete")[0][:, 1:]


BASES = {"tp": ThinPlate, "ts": ThinPlate, "cr": Cubic, "cs": Cubic, "cc": Cubic}


def make_basis(spec: SmoothSpec) -> Basis:
    if spec.bs not in BASES and spec.bs not in ("te", "ti"):
        raise KeyError(f"Unknown basis '{spec.bs}'. Available: {', '.join(sorted(BASES))}, te, ti")
    if spec.kind in ("te", "ti"):
        return Tensor(spec)
    return BASES[spec.bs](spec)


class Term:
    """A smooth of the model: a basis, perhaps times a factor's levels or a number, and its constraint."""

    def __init__(self, spec: SmoothSpec, basis: Basis, levels: list[str] | None = None):
        self.spec, self.basis, self.levels = spec, basis, levels
        self.numeric_by = spec.by is not None and levels is None
        self.map: np.ndarray | None = None  # raw to constrained coefficients of one block
        self.dropped: list[int] = []  # columns that side constraints take out

    @property
    def label(self) -> str:
        if self.numeric_by:
            return f"{self.spec.kind}({','.join(self.spec.variables)}):{self.spec.by}"
        return self.spec.label

    def constrain(self, sums: np.ndarray) -> None:
        if self.basis.centred and not self.numeric_by:
            self.map = null_of_sums(sums)

    @property
    def block_size(self) -> int:
        return self.basis.n_coefs if self.map is None else self.map.shape[1]

    @property
    def full_size(self) -> int:
        return self.block_size * (len(self.levels) if self.levels is not None else 1)

    @property
    def size(self) -> int:
        return self.full_size - len(self.dropped)

    def penalties(self) -> list[np.ndarray]:
        own = [s if self.map is None else self.map.T @ s @ self.map for s in self.basis.penalties]
        out = []
        for level in range(len(self.levels) if self.levels is not None else 1):
            for s in own:
                big = np.zeros((self.full_size, self.full_size))
                at = slice(level * self.block_size, (level + 1) * self.block_size)
                big[at, at] = (s + s.T) / 2
                out.append(np.delete(np.delete(big, self.dropped, 0), self.dropped, 1))
        return out

    def to_raw(self) -> np.ndarray:
        """The map from this term's coefficients to those of its raw basis, for each level apart."""
        one = np.eye(self.basis.n_coefs) if self.map is None else self.map
        full = np.kron(np.eye(len(self.levels) if self.levels is not None else 1), one)
        return np.delete(full, self.dropped, 1)

    def eval_raw(self, cols: dict) -> np.ndarray:
        """Rows of the raw basis, before any constraint."""
        return Term(self.spec, self.basis, self.levels).eval(cols)

    def eval(self, cols: dict) -> np.ndarray:
        x = self.basis.eval(cols)
        if self.map is not None:
            x = x @ self.map
        if self.numeric_by:
            x = x * np.asarray(cols[self.spec.by], float)[:, None]
        elif self.levels is not None:
            out = np.zeros((len(x), self.full_size))
            fac = np.asarray(cols[self.spec.by], object)
            for i, level in enumerate(self.levels):
                on = np.flatnonzero(fac == level)  # a row touches its level's block only
                out[on, i * self.block_size : (i + 1) * self.block_size] = x[on]
            x = out
        return np.delete(x, self.dropped, 1) if self.dropped else x
