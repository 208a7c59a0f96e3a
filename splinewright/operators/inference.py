"""Summaries of fitted models: tests of parametric terms and smooths, and printed tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import special as sp


#: p-values below this are not taken from a numerical inversion.
TAIL = 1e-7


@dataclass
class Summary:
    """Tables as lists of rows; p_table_df and s_table_df make DataFrames of them."""

    formula: str
    family: str
    link: str
    parametric: list[tuple]  # term, estimate, se, statistic, p
    smooth: list[tuple]  # term, edf, ref_df, statistic, p
    residual_df: float
    scale: float
    r_squared: float | None
    deviance_explained: float
    score: float | None
    method: str
    n: int
    scale_known: bool

    def p_table_df(self, spark):
        return spark.createDataFrame(self.parametric, "term string, estimate double, se double, statistic double, p_value double")

    def s_table_df(self, spark):
        return spark.createDataFrame(self.smooth, "term string, edf double, ref_df double, statistic double, p_value double")

    def __str__(self) -> str:
        stat = "z" if self.scale_known else "t"
        lines = ["", f"Family: {self.family}", f"Link function: {self.link}", "", "Formula:", self.formula, "", "Parametric coefficients:"]
        width = max([11, *(len(r[0]) for r in self.parametric)])
        lines.append(f"{'':{width}} {'Estimate':>11} {'Std. Error':>11} {stat + ' value':>9} {'Pr(>|' + stat + '|)':>10}")
        for name, b, se, t, p in self.parametric:
            lines.append(f"{name:{width}} {b:11.5g} {se:11.5g} {t:9.3f} {_p(p):>10} {stars(p)}")
        if self.smooth:
            stat = "Chi.sq" if self.scale_known else "F"
            width = max(len(r[0]) for r in self.smooth)
            lines += ["", "Approximate significance of smooth terms:", f"{'':{width}} {'edf':>8} {'Ref.df':>8} {stat:>9} {'p-value':>10}"]
            lines += [f"{name:{width}} {e:8.3f} {r:8.3f} {t:9.3f} {_p(p):>10} {stars(p)}" for name, e, r, t, p in self.smooth]
        lines += ["---", "Signif. codes:  0 '***' 0.001 '**' 0.01 '*' 0.05 '.' 0.1 ' ' 1", ""]
        r2 = "NA" if self.r_squared is None else f"{self.r_squared:.3g}"
        lines.append(f"R-sq.(adj) = {r2}   Deviance explained = {100 * self.deviance_explained:.3g}%")
        score = "fixed" if self.score is None else f"{self.score:.5g}"
        lines.append(f"-{self.method} = {score}  Scale est. = {self.scale:.5g}  n = {self.n}")
        return "\n".join(lines)


def _p(p: float) -> str:
    return "NA" if np.isnan(p) else "<2e-16" if p < 2e-16 else f"{p:.3g}"


def stars(p: float) -> str:
    return next((s for limit, s in ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, ".")) if p < limit), "")


def wood_test(beta: np.ndarray, r: np.ndarray, v: np.ndarray, rank: float, res_df: float | None) -> tuple[float, float, float]:
    """Wald-type test of a smooth's values with a pseudo-inverse of fractional rank (Wood 2013).

    r: upper triangular R factor of the smooth's columns. The fractional part of the rank
    mixes two directions, whose signs are told by R's first row; the statistic has the
    mixing term as it is, and p-values are averaged over either sign of it.
    Returns the statistic, its reference degrees of freedom and the p-value.
    """
    fit = r @ beta
    w = r @ v @ r.T
    val, vec = np.linalg.eigh((w + w.T) / 2)
    val, vec = val[::-1], vec[:, ::-1]
    sign = np.sign(vec[0])
    vec = vec * np.where(sign == 0, 1, sign)
    k = max(0, int(np.floor(rank)))
    nu = rank - k
    k1 = k + (nu > 1e-12)
    usable = int((val > val.max() * np.finfo(float).eps ** 0.9).sum())
    if k1 > usable:
        k1 = k = usable
        nu, rank = 0.0, float(usable)
    z = vec.T @ fit
    if nu <= 1e-12:
        stat = float((z[:k] ** 2 / val[:k]).sum())
        if res_df is None:
            return stat, rank, sp.chi2_sf(stat, rank)
        return stat / rank, rank, sp.f_sf(stat / rank, rank, res_df)
    if k == 0:
        base, weights, rank = float(z[0] ** 2 / val[0]), np.ones(1), 1.0
        stats = [base]
    else:
        # The last two directions share rank 1 + nu; either sign of their mixed term is as good.
        base = float((z[: k - 1] ** 2 / val[: k - 1]).sum())
        a, b = z[k - 1] / np.sqrt(val[k - 1]), z[k] / np.sqrt(val[k])
        mixed = 2 * np.sqrt(nu * (1 - nu) / 2) * a * b
        stats = [base + a * a + nu * b * b + mixed, base + a * a + nu * b * b - mixed]
        root = np.sqrt((1 + nu) * (1 - nu))
        weights = np.append(np.ones(k - 1), [(1 + nu + root) / 2, (1 + nu - root) / 2])
    ps = []
    for s in stats:
        if res_df is None:
            ps.append(sp.chi2_mixture_sf(s, weights))
        else:  # sum w chi2 > s chi2(whole) / whole
            whole = max(1, round(res_df))
            both = np.append(weights, -s / whole)
            p, fault = sp.weighted_chi2_sf(0.0, both, np.append(np.ones(len(weights)), whole), tol=TAIL / 100)
            # Below TAIL the numerical inversion has no digits left; the F tail has.
            ps.append(p if not fault and TAIL < p <= 1 else sp.f_sf(s / rank, rank, res_df))
    return (stats[0] if res_df is None else stats[0] / rank), rank, float(min(1.0, np.mean(ps)))


def summarise(model) -> Summary:
    setup, fam = model.setup_, model.family_
    rdf = model.n_ - model.edf_total_
    se = np.sqrt(np.maximum(np.diag(model.Vp_), 0))
    parametric = []
    for i in range(setup.n_param):
        t = model.coefficients_[i] / se[i] if se[i] > 0 else float("nan")
        p = float("nan") if not np.isfinite(t) else sp.norm_sf2(t) if fam.scale_known else sp.t_sf2(t, rdf) if rdf > 0 else float("nan")
        parametric.append((setup.names[i], float(model.coefficients_[i]), float(se[i]), float(t), float(p)))
    smooth = []
    for i, term in enumerate(setup.terms):
        at = setup.term_slice(i)
        # The test is one of values at the rows as they are, whatever their weights.
        gram = model._xx[at, at]
        val, vec = np.linalg.eigh((gram + gram.T) / 2)
        r = np.linalg.qr((vec * np.sqrt(np.maximum(val, 0))).T, mode="r")
        rank = float(min(model.edf1_[i], term.size))
        stat, ref, p = wood_test(model.coefficients_[at], r, model.Vp_[at, at], rank, None if fam.scale_known else max(rdf, 1e-6))
        smooth.append((term.label, float(model.edf_[i]), float(ref), float(stat), float(p)))
    return Summary(model.formula, fam.family_name, fam.link.name, parametric, smooth, float(rdf), model.scale_, model.r_squared_, model.deviance_explained_, model.score_, model.method, model.n_, fam.scale_known)
