"""Special functions on numpy arrays: gamma family, incomplete beta and gamma, normal, and weighted chi-square tails."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
#: Bernoulli-series coefficients B_2k / (2k (2k - 1)) of ln gamma.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def lgamma(x):
    """ln gamma for positive x: shifted to 8 or more, then Stirling's series."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift - np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    series = sum(c / x ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series + shift


def digamma(x):
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out = np.where(low, out - 1 / np.where(low, x, 1.0), out)
        x = np.where(low, x + 1, x)
    return out + np.log(x) - 0.5 / x - sum(c * (2 * k + 1) / x ** (2 * k + 2) for k, c in enumerate(_STIRLING))


def trigamma(x):
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out = np.where(low, out + 1 / np.where(low, x, 1.0) ** 2, out)
        x = np.where(low, x + 1, x)
    return out + 1 / x + 0.5 / x**2 + sum(c * (2 * k + 1) * (2 * k + 2) / x ** (2 * k + 3) for k, c in enumerate(_STIRLING))


def _each(fn, x):
    x = np.asarray(x, float)
    return np.array([fn(v) for v in x.ravel().tolist()]).reshape(x.shape)


def norm_cdf(x):
    return 0.5 * _each(math.erfc, -np.asarray(x, float) / math.sqrt(2))


def norm_pdf(x):
    return np.exp(-0.5 * np.asarray(x, float) ** 2) / math.sqrt(2 * math.pi)


def norm_ppf(p):
    return _each(_NORMAL.inv_cdf, p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function; small tails are kept without cancellation."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 100_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-17:
                break
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 100_000):
        num = -k * (k - a)
        b += 2
        d = num * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + num / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gammaincc(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return betainc(df / 2, 0.5, df / (df + t * t))


def norm_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def ncchi2_sf(x: float, df: float, nc: float) -> float:
    """Non-central chi-square tail as a Poisson mixture of central ones, from the mode outwards."""
    if nc <= 0:
        return chi2_sf(x, df)
    half, total = nc / 2, 0.0
    mode = int(half)
    weight = lambda j: math.exp(-half + j * math.log(half) - math.lgamma(j + 1))
    for way in (range(mode, mode + 100_000), range(mode - 1, -1, -1)):
        for j in way:
            w = weight(j)
            total += w * chi2_sf(x, df + 2 * j)
            if w < 1e-17 and abs(j - half) > 3:
                break
    return min(1.0, total)


def weighted_chi2_sf(q: float, weights, df=None, nc=None, sigma: float = 0.0, tol: float = 2e-5, limit: int = 100_000) -> tuple[float, int]:
    """P(sum_i w_i chi2(df_i, nc_i) + sigma N(0, 1) > q) by inversion of the characteristic function (Davies 1980).

    Returns the probability and a fault code: 0 none, 1 the series needs over `limit` terms.
    The step is set by the range outside which hardly any probability lies, and halved until two sums agree.
    """
    w = np.asarray(weights, float)
    df = np.ones_like(w) if df is None else np.asarray(df, float)
    nc = np.zeros_like(w) if nc is None else np.asarray(nc, float)
    mean = float((w * (df + nc)).sum())
    sd = math.sqrt(float((2 * w * w * (df + 2 * nc)).sum()) + sigma * sigma)
    if sd == 0:
        return float(mean > q), 0
    step = 2 * math.pi / (12 * sd + 2 * abs(q - mean) + 10 * float(np.abs(w).max()))
    last = None
    for _ in range(12):
        total, k0, block = 0.0, 0, 2048
        while True:
            u = (np.arange(k0, k0 + block) + 0.5) * step
            x = 2 * np.outer(w, u)
            angle = 0.5 * (df[:, None] * np.arctan(x)).sum(0) + (nc[:, None] * 0.5 * x / (1 + x * x)).sum(0) - u * q
            size = -0.25 * (df[:, None] * np.log1p(x * x)).sum(0) - (0.5 * nc[:, None] * x * x / (1 + x * x)).sum(0) - 0.5 * (sigma * u) ** 2
            total += float((np.exp(size) * np.sin(angle) / (np.arange(k0, k0 + block) + 0.5)).sum())
            k0 += block
            if size[-1] - math.log(k0) < math.log(tol * 1e-2):
                break
            if k0 > limit:
                return float("nan"), 1
        now = 0.5 + total / math.pi
        if last is not None and abs(now - last) < tol / 4:
            return min(1.0, max(0.0, now)), 0
        last, step = now, step / 2
    return min(1.0, max(0.0, last)), 0


def liu_sf(q: float, weights, df=None) -> float:
    """Tail of a weighted sum of chi-squares from its first four cumulants (Liu, Tang and Zhang 2009)."""
    w = np.asarray(weights, float)
    df = np.ones_like(w) if df is None else np.asarray(df, float)
    c1, c2, c3, c4 = (float((w**k * df).sum()) for k in (1, 2, 3, 4))
    s1, s2 = c3 / c2**1.5, c4 / c2**2
    if s1 * s1 > s2:
        a = 1 / (s1 - math.sqrt(s1 * s1 - s2))
        delta = s1 * a**3 - a * a
        dof = a * a - 2 * delta
    else:
        a, delta = 1 / s1, 0.0
        dof = c2**3 / c3**2
    x = (q - c1) / math.sqrt(2 * c2) * math.sqrt(2) * a + dof + delta
    return ncchi2_sf(x, dof, delta) if x > 0 else 1.0


def chi2_mixture_sf(q: float, weights, df=None) -> float:
    """Davies' tail, or Liu's where the series does not end or gives nothing usable."""
    p, fault = weighted_chi2_sf(q, weights, df)
    return p if not fault and 0 < p <= 1 else liu_sf(q, weights, df)
