"""Binding a formula to a DataFrame: validation, factors, bases, constraints, penalties and names."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.basis import Term, make_basis
from ..operators.passes import Facts, tsqr
from .formula import FormulaSpec
from .penalties import EPS, eigen_rank, sqrt_rows


@dataclass(frozen=True)
class Factor:
    """Levels of a string column, in order; `ordered` drops the first one from by-smooths."""

    levels: tuple[str, ...] | None = None
    ordered: bool = False


@dataclass
class PenaltyBlock:
    """Penalties that act on the same coefficients: one of a smooth, several of a tensor."""

    term: int
    start: int
    matrices: list[np.ndarray]
    indices: list[int] = field(default_factory=list)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def check_columns(spec: FormulaSpec, df: DataFrame) -> None:
    have = ", ".join(df.columns)
    if spec.response not in df.columns:
        raise ValueError(f"Response '{spec.response}' is not a column. Available: {have}")
    for name in spec.variables():
        if name not in df.columns:
            raise ValueError(f"Variable '{name}' is not a column. Available: {have}")
        kind = df.schema[name].dataType
        if not isinstance(kind, (T.NumericType, T.StringType)):
            raise ValueError(f"Variable '{name}' is neither numeric nor a string but {kind.simpleString()}")
    for s in spec.smooths:
        for v in s.variables:
            if is_string(df, v):
                raise ValueError(f"{s.label}: '{v}' is a factor")


def quality(df: DataFrame, response: str, columns: list[str]) -> DataFrame:
    """One row of counts: rows, and per column nulls, NaN and infinite values."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in dict.fromkeys([response, *columns]):
        x = F.col(f"`{c}`")
        aggs.append(F.count_if(x.isNull()).alias(f"{c}__null"))
        if not is_string(df, c):
            x = x.cast("double")
            aggs += [F.count_if(F.isnan(x)).alias(f"{c}__nan"), F.count_if(F.abs(x) == float("inf")).alias(f"{c}__inf")]
    return df.agg(*aggs)


def check_quality(df: DataFrame, response: str, columns: list[str]) -> int:
    row = quality(df, response, columns).first().asDict()
    for c in dict.fromkeys([response, *columns]):
        bad = {k: row.get(f"{c}__{k}", 0) for k in ("null", "nan", "inf")}
        if any(bad.values()):
            what = ", ".join(f"{v} {({'null': 'null', 'nan': 'NaN', 'inf': 'Inf'})[k]}" for k, v in bad.items() if v)
            raise ValueError(f"'{c}' holds {what} values")
    if row["n"] < 2:
        raise ValueError(f"A model needs at least 2 observations, not {row['n']}")
    return row["n"]


def factor_levels(df: DataFrame, name: str) -> DataFrame:
    """(level, n) of a factor, in code point order."""
    return df.groupBy(F.col(f"`{name}`").alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy("level")


class Setup:
    """A bound formula: evaluates rows of the model matrix, and knows penalties and names."""

    def __init__(self, spec: FormulaSpec, df: DataFrame, factors: dict[str, Factor] | None = None, n: int | None = None):
        self.spec, factors = spec, factors or {}
        self.factor_names = [v for v in spec.variables() if is_string(df, v)]
        self.levels: dict[str, list[str]] = {}
        self.counts: dict[str, dict] = {}
        for name in self.factor_names:
            found = {r["level"]: r["n"] for r in factor_levels(df, name).collect()}
            self.counts[name] = found
            given = factors.get(name)
            self.levels[name] = list(given.levels) if given and given.levels else list(found)
        numeric = [v for v in spec.variables() if v not in self.factor_names]
        self.facts = Facts(df, numeric, n)
        self.ranges = {v: self.facts.range(v) for v in numeric}
        self._parametric()
        self.terms = [self._term(s, factors) for s in spec.smooths]
        self._constrain(df)
        self._assemble()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "facts"}  # executors evaluate rows; the table stays here

    def _parametric(self) -> None:
        self.param_names = ["(Intercept)"] if self.spec.has_intercept else []
        for t in self.spec.parametric:
            if t.name in self.factor_names:
                levels = self.levels[t.name]
                if len(levels) < 2:
                    raise ValueError(f"Factor '{t.name}' has fewer than 2 levels")
                self.param_names += [f"{t.name}{lv}" for lv in (levels[1:] if self.spec.has_intercept else levels)]
            else:
                self.param_names.append(t.name)

    def _term(self, s, factors) -> Term:
        basis, levels = make_basis(s), None
        if s.by in self.factor_names:
            levels = self.levels[s.by]
            if (f := factors.get(s.by)) and f.ordered:
                levels = levels[1:]
            for lv in levels:
                if not self.counts[s.by].get(lv):
                    raise ValueError(f"{s.label}: level '{lv}' has zero observations")
        return Term(s, basis, levels)

    def _constrain(self, df: DataFrame) -> None:
        for term in self.terms:
            term.basis.setup(self.facts)
            sums = self.facts.basis_sums(term.basis)
            term.basis.rescale(sums["norm"])
            term.constrain(sums["sums"])
        names = [n for t in self.terms for n in self._names(t)]
        if len(set(names)) < len(names):
            self._side_constraints(df)

    @staticmethod
    def _names(term: Term) -> list[str]:
        return [v + (term.spec.by or "") for v in term.spec.variables]

    def _side_constraints(self, df: DataFrame) -> None:
        """Takes out columns of a smooth that lie in the span of smooths of its variables, lower dimensions first.

        Works on the R factor of all columns: spans and residuals are those of the rows
        themselves. Rows that stand for the penalties keep merely collinear data from
        looking dependent.
        """
        r = tsqr(df.select(*[F.col(f"`{v}`") for v in self.spec.variables()]), self._eval_raw)
        starts, at = [], len(self.param_names)
        for t in self.terms:
            starts.append(at)
            at += t.full_size
        rows = [r]
        for t, s in zip(self.terms, starts):
            own = np.zeros((t.full_size, r.shape[1]))
            for pen in t.penalties():
                root = sqrt_rows(pen)
                size = np.sqrt((r[:, s : s + t.full_size] ** 2).mean() / max((root**2).mean(), 1e-300)) if root.size else 0
                own[: len(root), s : s + t.full_size] += 1e-1 * size * root
            rows.append(own)
        r = np.linalg.qr(np.vstack(rows), mode="r")
        seen: dict[str, list[int]] = {}
        for i in sorted(range(len(self.terms)), key=lambda k: len(self.terms[k].spec.variables)):
            t = self.terms[i]
            if not t.basis.centred:  # ti: its margins have no mean left
                continue
            before = sorted({k for n in self._names(t) for k in seen.get(n, [])})
            if before:
                x1 = [r[:, : len(self.param_names)]] + [np.delete(r[:, starts[k] : starts[k] + self.terms[k].full_size], self.terms[k].dropped, 1) for k in before]
                t.dropped = dependent_columns(np.hstack(x1), r[:, starts[i] : starts[i] + t.full_size])
            for n in self._names(t):
                seen.setdefault(n, []).append(i)

    def _assemble(self) -> None:
        self.n_param = len(self.param_names)
        self.starts, at = [], self.n_param
        self.blocks: list[PenaltyBlock] = []
        self.names = list(self.param_names)
        m = 0
        for i, t in enumerate(self.terms):
            self.starts.append(at)
            pens = t.penalties()
            per = len(t.basis.penalties)
            for b in range(0, len(pens), per):
                block = PenaltyBlock(i, at, pens[b : b + per], list(range(m, m + per)))
                self.blocks.append(block)
                m += per
            self.names += [f"{t.label}.{j + 1}" for j in range(t.size)]
            at += t.size
        self.p, self.n_penalties = at, m
        self.penalties = []
        for b in self.blocks:
            for s in b.matrices:
                big = np.zeros((self.p, self.p))
                big[b.start : b.start + len(s), b.start : b.start + len(s)] = s
                self.penalties.append(big)
        total = sum((s / np.linalg.norm(s) for s in self.penalties), np.zeros((self.p, self.p)))
        self.null_dim = self.p - eigen_rank(total)

    def term_slice(self, i: int) -> slice:
        return slice(self.starts[i], self.starts[i] + self.terms[i].size)

    def coef_map(self) -> "CoefMap":
        return CoefMap(self)

    def find(self, label: str) -> int:
        for i, t in enumerate(self.terms):
            if t.label == label:
                return i
        raise KeyError(f"No term '{label}'. Available: {', '.join(t.label for t in self.terms)}")

    def eval_parametric(self, cols: dict, n: int) -> np.ndarray:
        out = [np.ones(n)] if self.spec.has_intercept else []
        for t in self.spec.parametric:
            if t.name in self.factor_names:
                levels = self.levels[t.name]
                x = np.asarray(cols[t.name], object)
                out += [(x == lv).astype(float) for lv in (levels[1:] if self.spec.has_intercept else levels)]
            else:
                out.append(np.asarray(cols[t.name], float))
        return np.column_stack(out) if out else np.zeros((n, 0))

    def eval(self, cols: dict) -> np.ndarray:
        """Rows of the model matrix."""
        n = len(next(iter(cols.values())))
        return np.hstack([self.eval_parametric(cols, n), *[t.eval(cols) for t in self.terms]])

    def _eval_raw(self, cols: dict) -> np.ndarray:
        return self.eval(cols)


class CoefMap:
    """Between the coefficients of raw bases and those of the model, which constraints leave; parametric ones are the same."""

    def __init__(self, setup: Setup):
        self.setup = setup
        blocks = [np.eye(setup.n_param)] + [t.to_raw() for t in setup.terms]
        self.starts = np.cumsum([0] + [len(b) for b in blocks])
        self.matrix = np.zeros((self.starts[-1], setup.p))
        at = 0
        for start, b in zip(self.starts, blocks):
            self.matrix[start : start + len(b), at : at + b.shape[1]] = b
            at += b.shape[1]

    def raw_slice(self, i: int) -> slice:
        """Where term i's raw coefficients stand."""
        return slice(int(self.starts[i + 1]), int(self.starts[i + 2]))

    def to_raw(self, beta: np.ndarray) -> np.ndarray:
        return self.matrix @ beta

    def to_constrained(self, raw: np.ndarray) -> np.ndarray:
        """The model's coefficients whose raw ones are nearest; the map's columns are orthonormal."""
        return self.matrix.T @ raw

    def transform_x(self, x: np.ndarray) -> np.ndarray:
        """Rows of the raw bases as rows of the model matrix."""
        return x @ self.matrix

    def transform_s(self, s: np.ndarray) -> np.ndarray:
        """A penalty of raw coefficients as one of the model's."""
        return self.matrix.T @ s @ self.matrix


def numerical_rank(a: np.ndarray, tol: float | None = None) -> int:
    """How many columns of a are independent: diagonals of a QR with column pivots above eps * max(m, n) * the largest."""
    a = np.array(a, float)
    if not a.size:
        return 0
    limit = EPS * max(a.shape) if tol is None else tol
    rank, top = 0, 0.0
    for _ in range(min(a.shape)):
        norms = np.sqrt((a * a).sum(0))
        k = int(norms.argmax())
        top = top or norms[k]
        if not norms[k] > limit * top:
            break
        rank += 1
        u = a[:, k] / norms[k]
        a = a - np.outer(u, u @ a)
        a -= np.outer(u, u @ a)  # twice is enough to be orthogonal
        a[:, k] = 0.0
    return rank


def dependent_columns(x1: np.ndarray, x2: np.ndarray, tol: float = EPS**0.5) -> list[int]:
    """Columns of x2 that x1 and the other columns of x2 make up, by pivoted elimination of what x1 leaves."""
    q, r = np.linalg.qr(x1)
    rest = x2 - q @ (q.T @ x2)
    size = np.abs(r[0, 0])
    order, left, diag = [], list(range(x2.shape[1])), []
    while left:
        norms = np.sqrt((rest[:, left] ** 2).sum(0))
        k = left.pop(int(norms.argmax()))
        order.append(k)
        diag.append(norms.max())
        if norms.max() > 0:
            u = rest[:, k] / norms.max()
            rest = rest - np.outer(u, u @ rest)
    diag = np.array(diag)
    drop = len(diag)
    while drop and diag[drop - 1 :].mean() < size * tol:
        drop -= 1
    return sorted(order[drop:])
