"""Link functions with two faces: Spark Column expressions and numpy arrays.

Guards: mu is kept off the ends of its range by EPS before a function that needs it, as
ANSI Spark fails or gives null where IEEE arithmetic gives an infinity.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special

EPS = 1e-10


class _Numpy:
    """The functions that links and families use, on arrays."""

    log, exp, sqrt, power, abs = np.log, np.exp, np.sqrt, np.power, np.abs

    lit = staticmethod(lambda x: x)
    least = staticmethod(np.minimum)
    greatest = staticmethod(np.maximum)

    @staticmethod
    def where(test, a, b):
        return np.where(test, a, b)

    @staticmethod
    def ratio(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.divide(a, b)

    norm_cdf, norm_pdf, norm_ppf, lgamma = special.norm_cdf, special.norm_pdf, special.norm_ppf, special.lgamma


def _vector_udf(fn):
    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(fn(x.to_numpy(float)))

    return apply


class _Columns:
    """The same functions on Columns."""

    log, exp, sqrt, power, abs, lit = F.log, F.exp, F.sqrt, F.pow, F.abs, F.lit

    @staticmethod
    def least(a, b):
        return F.least(_col(a), _col(b))

    @staticmethod
    def greatest(a, b):
        return F.greatest(_col(a), _col(b))

    @staticmethod
    def where(test, a, b):
        return F.when(test, _col(a)).otherwise(_col(b))

    @staticmethod
    def ratio(a, b):
        return F.try_divide(_col(a), _col(b))

    @staticmethod
    def norm_pdf(x):
        return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)

    norm_cdf = staticmethod(lambda x: _vector_udf(special.norm_cdf)(x))
    norm_ppf = staticmethod(lambda x: _vector_udf(special.norm_ppf)(x))

    @staticmethod
    def lgamma(x):
        """Stirling's series after a shift by eight."""
        product = x
        for k in range(1, 8):
            product = product * (x + k)
        y = x + 8
        series = sum(c / F.pow(y, F.lit(2.0 * k + 1)) for k, c in enumerate(special._STIRLING))
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _col(x):
    return x if isinstance(x, Column) else F.lit(x)


def face(*values):
    """The set of functions that fits the values."""
    return _Columns if any(isinstance(v, Column) for v in values) else _Numpy


class Link(ABC):
    """g(mu) = eta. Subclasses may be defined by users."""

    name = ""

    @abstractmethod
    def link(self, mu): ...

    @abstractmethod
    def inverse(self, eta): ...

    @abstractmethod
    def derivative(self, mu):
        """d eta / d mu."""

    def linkinv(self, eta):
        return self.inverse(eta)

    def mu_eta(self, eta):
        """d mu / d eta."""
        return 1.0 / self.derivative(self.inverse(eta))

    def mu_eta2(self, eta):
        """Second and third derivatives of mu by eta; by differences unless a subclass knows them."""
        h = 1e-4 * (1 + np.abs(eta))
        up, here, down = self.mu_eta(eta + h), self.mu_eta(eta), self.mu_eta(eta - h)
        return (up - down) / (2 * h), (up - 2 * here + down) / (h * h)

    @classmethod
    def from_name(cls, name: str) -> "Link":
        if name not in LINKS:
            raise ValueError(f"Unknown link '{name}'. Available: {', '.join(sorted(LINKS))}")
        return LINKS[name]()

    def __repr__(self):
        return f"{type(self).__name__}()"


def _inside(mu):
    f = face(mu)
    return f.least(f.greatest(mu, EPS), 1 - EPS)


def _above(mu):
    return face(mu).greatest(mu, EPS)


class IdentityLink(Link):
    name = "identity"

    def link(self, mu):
        return mu * 1.0

    inverse = link

    def derivative(self, mu):
        return mu * 0.0 + 1.0

    mu_eta = derivative

    def mu_eta2(self, eta):
        return eta * 0.0, eta * 0.0


class LogLink(Link):
    name = "log"

    def link(self, mu):
        return face(mu).log(_above(mu))

    def inverse(self, eta):
        return face(eta).exp(eta)

    mu_eta = inverse

    def derivative(self, mu):
        return 1.0 / _above(mu)

    def mu_eta2(self, eta):
        return np.exp(eta), np.exp(eta)


class LogitLink(Link):
    name = "logit"

    def link(self, mu):
        m = _inside(mu)
        return face(mu).log(m / (1 - m))

    def inverse(self, eta):
        return 1.0 / (1.0 + face(eta).exp(-eta))

    def derivative(self, mu):
        m = _inside(mu)
        return 1.0 / (m * (1 - m))

    def mu_eta(self, eta):
        p = self.inverse(eta)
        return p * (1 - p)

    def mu_eta2(self, eta):
        p = self.inverse(eta)
        return p * (1 - p) * (1 - 2 * p), p * (1 - p) * (1 - 6 * p + 6 * p * p)


class InverseLink(Link):
    name = "inverse"

    def link(self, mu):
        return 1.0 / _above(mu)

    def inverse(self, eta):
        return face(eta).ratio(1.0, eta)

    def derivative(self, mu):
        m = _above(mu)
        return -1.0 / (m * m)

    def mu_eta(self, eta):
        return face(eta).ratio(-1.0, eta * eta)

    def mu_eta2(self, eta):
        return 2.0 / eta**3, -6.0 / eta**4


class ProbitLink(Link):
    name = "probit"

    def link(self, mu):
        return face(mu).norm_ppf(_inside(mu))

    def inverse(self, eta):
        return face(eta).norm_cdf(eta)

    def derivative(self, mu):
        f = face(mu)
        return 1.0 / f.norm_pdf(f.norm_ppf(_inside(mu)))

    def mu_eta(self, eta):
        return face(eta).norm_pdf(eta)

    def mu_eta2(self, eta):
        d = special.norm_pdf(eta)
        return -eta * d, (eta * eta - 1) * d


class CloglogLink(Link):
    name = "cloglog"

    def link(self, mu):
        f = face(mu)
        return f.log(-f.log(1 - _inside(mu)))

    def inverse(self, eta):
        f = face(eta)
        return 1.0 - f.exp(-f.exp(eta))

    def derivative(self, mu):
        m = _inside(mu)
        return 1.0 / ((1 - m) * -face(mu).log(1 - m))

    def mu_eta(self, eta):
        f = face(eta)
        return f.exp(eta - f.exp(eta))

    def mu_eta2(self, eta):
        e = np.exp(eta)
        d = np.exp(eta - e)
        return d * (1 - e), d * ((1 - e) ** 2 - e)


class SqrtLink(Link):
    name = "sqrt"

    def link(self, mu):
        return face(mu).sqrt(_above(mu))

    def inverse(self, eta):
        return eta * eta

    def derivative(self, mu):
        return 0.5 / face(mu).sqrt(_above(mu))

    def mu_eta(self, eta):
        return 2.0 * eta

    def mu_eta2(self, eta):
        return eta * 0.0 + 2.0, eta * 0.0


class InverseSquaredLink(Link):
    name = "inverse_squared"

    def link(self, mu):
        m = _above(mu)
        return 1.0 / (m * m)

    def inverse(self, eta):
        f = face(eta)
        return 1.0 / f.sqrt(_above(eta))

    def derivative(self, mu):
        m = _above(mu)
        return -2.0 / (m * m * m)

    def mu_eta(self, eta):
        e = _above(eta)
        return -0.5 / (e * face(eta).sqrt(e))

    def mu_eta2(self, eta):
        e = np.maximum(eta, EPS)
        return 0.75 * e**-2.5, -1.875 * e**-3.5


LINKS = {c.name: c for c in (IdentityLink, LogLink, LogitLink, InverseLink, ProbitLink, CloglogLink, SqrtLink, InverseSquaredLink)}


def register_sql(spark) -> None:
    """Publishes each link as SQL functions: <name>_link(mu), <name>_inverse(eta), <name>_derivative(mu), <name>_mu_eta(eta)."""
    guard, inside = "greatest(x, 1e-10D)", "least(greatest(x, 1e-10D), 1D - 1e-10D)"
    for name, body in {
        "identity_link": "x", "identity_inverse": "x", "identity_derivative": "1D", "identity_mu_eta": "1D",
        "log_link": f"ln({guard})", "log_inverse": "exp(x)", "log_derivative": f"1D / {guard}", "log_mu_eta": "exp(x)",
        "logit_link": f"ln({inside} / (1D - {inside}))", "logit_inverse": "1D / (1D + exp(-x))", "logit_derivative": f"1D / ({inside} * (1D - {inside}))", "logit_mu_eta": "exp(-x) / pow(1D + exp(-x), 2D)",
        "inverse_link": f"1D / {guard}", "inverse_inverse": "try_divide(1D, x)", "inverse_derivative": f"-1D / pow({guard}, 2D)", "inverse_mu_eta": "try_divide(-1D, x * x)",
        "cloglog_link": f"ln(-ln(1D - {inside}))", "cloglog_inverse": "1D - exp(-exp(x))", "cloglog_derivative": f"-1D / ((1D - {inside}) * ln(1D - {inside}))", "cloglog_mu_eta": "exp(x - exp(x))",
        "sqrt_link": f"sqrt({guard})", "sqrt_inverse": "x * x", "sqrt_derivative": f"0.5D / sqrt({guard})", "sqrt_mu_eta": "2D * x",
        "inverse_squared_link": f"pow({guard}, -2D)", "inverse_squared_inverse": f"pow({guard}, -0.5D)", "inverse_squared_derivative": f"-2D * pow({guard}, -3D)", "inverse_squared_mu_eta": f"-0.5D * pow({guard}, -1.5D)",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x DOUBLE) RETURNS DOUBLE RETURN {body}")
