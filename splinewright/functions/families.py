"""Exponential families with two faces: Spark Column expressions and numpy arrays."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import functions as F

from .links import EPS, Link, face

LOG_EPS = 1e-30


class ExponentialFamily(ABC):
    """Variance function, deviance and likelihood of a response distribution. Subclasses may be defined by users."""

    family_name = ""
    default_link = "identity"
    scale_known = False

    def __init__(self, link: str | Link | None = None):
        if link is None:
            link = self.default_link
        if isinstance(link, str):
            link = Link.from_name(link)
        if not isinstance(link, Link):
            raise TypeError(f"link must be a name or a Link, not {type(link).__name__}")
        self.link = link

    @abstractmethod
    def variance(self, mu): ...

    @abstractmethod
    def dvar(self, mu):
        """V'(mu)."""

    def d2var(self, mu):
        return mu * 0.0

    @abstractmethod
    def unit_deviance(self, y, mu): ...

    @abstractmethod
    def initialize(self, y, wt=None):
        """Starting values of mu."""

    @abstractmethod
    def valid_mu(self, mu): ...

    def valid_eta(self, eta):
        if face(eta) is not face(0.0):
            return ~F.isnan(eta) & (F.abs(eta) < float("inf"))
        return np.isfinite(eta)

    @abstractmethod
    def saturated(self, y, wt, scale):
        """A row's part of the saturated log likelihood."""

    @abstractmethod
    def aic_part(self, y, mu, wt, scale):
        """A row's part of minus twice the log likelihood."""

    def aic_constant(self) -> float:
        return 0.0

    def aic(self, y, mu, wt, scale):
        return float(np.sum(self.aic_part(y, mu, wt, scale))) + self.aic_constant()

    def saturated_loglik(self, y, wt, scale):
        return float(np.sum(self.saturated(y, wt, scale)))

    def saturated_slopes(self, sums: dict, scale: float) -> tuple[float, float, float]:
        """Saturated log likelihood and its derivatives by ln scale, from per-weight sums."""
        return sums["saturated"], 0.0, 0.0

    def deviance_resids(self, y, mu, wt=1.0):
        f = face(y, mu)
        sign = f.where(y > mu, 1.0, f.where(y < mu, -1.0, 0.0))
        return sign * f.sqrt(f.greatest(wt * self.unit_deviance(y, mu), 0.0))

    def dev_resids(self, y, mu, wt=1.0):
        """Total deviance: a number, or a Column to aggregate."""
        part = wt * self.unit_deviance(y, mu)
        return float(np.sum(part)) if face(y, mu) is face(0.0) else F.sum(part)

    def working_weights(self, mu, wt=1.0):
        g = self.link.derivative(mu)
        return wt / (self.variance(mu) * g * g)

    def working_response(self, y, mu, eta):
        return eta + (y - mu) * self.link.derivative(mu)

    def scale_estimate(self, y, mu, wt, n: int, p: float) -> float:
        return 1.0 if self.scale_known else self.dev_resids(y, mu, wt) / (n - p)

    def log_likelihood(self, y, mu, scale, wt=1.0) -> float:
        return -self.dev_resids(y, mu, wt) / (2 * scale)

    def __repr__(self):
        return f"{type(self).__name__}(link='{self.link.name}')"


def _xlog(f, x, ratio):
    """x ln(ratio), 0 where x is 0."""
    return f.where(x > 0, x * f.log(f.greatest(ratio, LOG_EPS)), 0.0)


class Gaussian(ExponentialFamily):
    family_name = "gaussian"

    def variance(self, mu):
        return mu * 0.0 + 1.0

    def dvar(self, mu):
        return mu * 0.0

    def unit_deviance(self, y, mu):
        return (y - mu) * (y - mu)

    def initialize(self, y, wt=None):
        return y * 1.0

    def valid_mu(self, mu):
        return self.valid_eta(mu)

    def saturated(self, y, wt, scale):
        f = face(y, wt)
        return f.where(wt > 0, 0.5 * f.log(f.greatest(wt, LOG_EPS)) - 0.5 * math.log(2 * math.pi * scale), 0.0)

    def aic_part(self, y, mu, wt, scale):
        return wt * (math.log(2 * math.pi * scale) + 1)

    def aic_constant(self):
        return 2.0

    def saturated_slopes(self, sums, scale):
        n = sums["n_positive"]
        return -0.5 * n * math.log(2 * math.pi * scale) + 0.5 * sums["log_w"], -0.5 * n, 0.0


class Binomial(ExponentialFamily):
    family_name = "binomial"
    default_link = "logit"
    scale_known = True

    def variance(self, mu):
        return mu * (1 - mu)

    def dvar(self, mu):
        return 1 - 2 * mu

    def d2var(self, mu):
        return mu * 0.0 - 2.0

    def unit_deviance(self, y, mu):
        f = face(y, mu)
        m = f.least(f.greatest(mu, EPS), 1 - EPS)
        return f.greatest(2 * (_xlog(f, y, y / m) + _xlog(f, 1 - y, (1 - y) / (1 - m))), 0.0)

    def initialize(self, y, wt=None):
        return (y + 0.5) / 2

    def valid_mu(self, mu):
        return (mu > 0) & (mu < 1)

    def saturated(self, y, wt, scale):
        f = face(y, wt)
        return wt * f.where((y > 0) & (y < 1), _xlog(f, y, y) + _xlog(f, 1 - y, 1 - y), 0.0)

    def aic_part(self, y, mu, wt, scale):
        f = face(y, mu)
        m = f.least(f.greatest(mu, EPS), 1 - EPS)
        return -2 * wt * (y * f.log(m) + (1 - y) * f.log(1 - m))


class Poisson(ExponentialFamily):
    family_name = "poisson"
    default_link = "log"
    scale_known = True

    def variance(self, mu):
        return mu * 1.0

    def dvar(self, mu):
        return mu * 0.0 + 1.0

    def unit_deviance(self, y, mu):
        f = face(y, mu)
        m = f.greatest(mu, EPS)
        return f.greatest(2 * (_xlog(f, y, y / m) - (y - m)), 0.0)

    def initialize(self, y, wt=None):
        return face(y).where(y > 0, y, 0.1)

    def valid_mu(self, mu):
        return mu > 0

    def saturated(self, y, wt, scale):
        f = face(y, wt)
        return wt * f.where(y > 0, _xlog(f, y, y) - y - f.lgamma(f.greatest(y, 0.0) + 1), 0.0)

    def aic_part(self, y, mu, wt, scale):
        f = face(y, mu)
        m = f.greatest(mu, EPS)
        return -2 * wt * (y * f.log(m) - m - f.lgamma(f.greatest(y, 0.0) + 1))


class Gamma(ExponentialFamily):
    family_name = "Gamma"
    default_link = "inverse"

    def variance(self, mu):
        return mu * mu

    def dvar(self, mu):
        return 2 * mu

    def d2var(self, mu):
        return mu * 0.0 + 2.0

    def unit_deviance(self, y, mu):
        f = face(y, mu)
        a, m = f.greatest(y, EPS), f.greatest(mu, EPS)
        return f.greatest(2 * (-f.log(a / m) + (y - mu) / m), 0.0)

    def initialize(self, y, wt=None):
        return face(y).greatest(y, EPS)

    def valid_mu(self, mu):
        return mu > 0

    def saturated(self, y, wt, scale):
        f = face(y, wt)
        a = f.greatest(wt / scale, LOG_EPS)
        return f.where(wt > 0, -f.lgamma(a) + a * f.log(a) - a - f.log(f.greatest(y, EPS)), 0.0)

    def aic_part(self, y, mu, wt, scale):
        f = face(y, mu)
        a, m, y = 1.0 / scale, f.greatest(mu, EPS), f.greatest(y, EPS)
        shape = f.lgamma(f.lit(a)) if f is not face(0.0) else float(f.lgamma(a))
        return -2 * wt * ((a - 1) * f.log(y) - y * a / m - shape + a * math.log(a) - a * f.log(m))

    def aic_constant(self):
        return 2.0

    def saturated_slopes(self, sums, scale):
        from . import special as sp

        w, count = sums["weights"]
        a = w / scale
        value = float((count * (-sp.lgamma(a) + a * np.log(a) - a)).sum()) - sums["log_y"]
        slope = a * (sp.digamma(a) - np.log(a))
        curve = a * (sp.digamma(a) - np.log(a) + a * sp.trigamma(a) - 1)
        return value, float((count * slope).sum()), -float((count * curve).sum())


FAMILIES = {"gaussian": Gaussian, "binomial": Binomial, "poisson": Poisson, "gamma": Gamma}


def get_family(family) -> ExponentialFamily:
    if isinstance(family, ExponentialFamily):
        return family
    if not isinstance(family, str):
        raise TypeError(f"family must be a name or an ExponentialFamily, not {type(family).__name__}")
    if family.lower() not in FAMILIES:
        raise KeyError(f"Unknown family '{family}'. Available: {', '.join(sorted(FAMILIES))}")
    return FAMILIES[family.lower()]()
