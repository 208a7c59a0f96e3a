"""Links, families and special functions: known values, derivatives by differences, and both faces alike."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splinewright.functions import special as sp
from splinewright.functions.families import FAMILIES, Binomial, Gamma, get_family
from splinewright.functions.links import LINKS, Link, register_sql

MU = {"logit": np.linspace(0.02, 0.98, 25), "probit": np.linspace(0.02, 0.98, 25), "cloglog": np.linspace(0.02, 0.98, 25)}


@pytest.mark.parametrize("name", sorted(LINKS))
def test_links(name):
    link, mu = LINKS[name](), MU.get(name, np.linspace(0.2, 6, 25))
    eta = link.link(mu)
    np.testing.assert_allclose(link.inverse(eta), mu, rtol=1e-9)
    np.testing.assert_allclose(link.derivative(mu) * link.mu_eta(eta), 1, rtol=1e-8)
    h = 1e-5 * (1 + np.abs(eta))
    d2, d3 = link.mu_eta2(eta)
    np.testing.assert_allclose((link.mu_eta(eta + h) - link.mu_eta(eta - h)) / (2 * h), d2, rtol=1e-5, atol=1e-7)
    d2u, d2d = link.mu_eta2(eta + h)[0], link.mu_eta2(eta - h)[0]
    np.testing.assert_allclose((d2u - d2d) / (2 * h), d3, rtol=1e-4, atol=1e-6)


@pytest.mark.parametrize("name", sorted(LINKS))
def test_link_columns_equal_arrays(spark, name):
    link, mu = LINKS[name](), MU.get(name, np.linspace(0.2, 6, 25))
    df = spark.createDataFrame([(float(m), float(e)) for m, e in zip(mu, link.link(mu))], "m double, e double")
    m, e = F.col("m"), F.col("e")
    got = df.select("m", "e", link.link(m), link.inverse(e), link.derivative(m), link.mu_eta(e)).toPandas().to_numpy()
    m, e = got[:, 0], got[:, 1]
    np.testing.assert_allclose(got[:, 2:], np.column_stack([link.link(m), link.inverse(e), link.derivative(m), link.mu_eta(e)]), rtol=1e-9)


def test_link_guards_and_registry(spark):
    for name in LINKS:
        assert np.isfinite(LINKS[name]().link(np.array([0.0, 1.0]))).all()
    with pytest.raises(ValueError, match="Available"):
        Link.from_name("Logit")
    register_sql(spark)
    row = spark.sql("SELECT logit_link(0.25D), cloglog_inverse(0.5D), inverse_squared_derivative(2D)").first()
    np.testing.assert_allclose(list(row), [math.log(1 / 3), 1 - math.exp(-math.exp(0.5)), -0.25])


@pytest.mark.parametrize("name", sorted(FAMILIES))
def test_families(spark, name):
    fam = get_family(name.upper())
    mu = np.linspace(0.1, 0.9, 9)
    h = 1e-6
    np.testing.assert_allclose((fam.variance(mu + h) - fam.variance(mu - h)) / (2 * h), fam.dvar(mu), atol=1e-6)
    np.testing.assert_allclose((fam.dvar(mu + h) - fam.dvar(mu - h)) / (2 * h), fam.d2var(mu), atol=1e-6)
    y = {"binomial": np.array([0.0, 1.0, 0.3]), "poisson": np.array([0.0, 3.0, 7.0])}.get(name, np.array([0.2, 1.0, 4.0]))
    m, w = np.array([0.3, 0.6, 0.8]), np.array([1.0, 2.0, 0.5])
    assert (fam.unit_deviance(y, m) >= 0).all() and np.allclose(fam.unit_deviance(m, m), 0)
    # The deviance's slope is -2 (y - mu) / V.
    np.testing.assert_allclose((fam.unit_deviance(y, m + h) - fam.unit_deviance(y, m - h)) / (2 * h), -2 * (y - m) / fam.variance(m), rtol=1e-5)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, m, w)], "y double, m double, w double")
    cy, cm, cw = F.col("y"), F.col("m"), F.col("w")
    got = df.agg(fam.dev_resids(cy, cm, cw), F.sum(fam.saturated(cy, cw, 0.7)), F.sum(fam.aic_part(cy, cm, cw, 0.7)) + fam.aic_constant()).first()
    np.testing.assert_allclose(list(got), [fam.dev_resids(y, m, w), fam.saturated_loglik(y, w, 0.7), fam.aic(y, m, w, 0.7)], rtol=1e-9)


def test_family_registry():
    assert isinstance(get_family("Binomial"), Binomial) and Gamma(link="log").link.name == "log"
    with pytest.raises(KeyError):
        get_family("tweedie")
    with pytest.raises(TypeError):
        get_family(3)
    with pytest.raises(TypeError):
        Gamma(link=3)


def test_special_functions():
    x = np.array([0.1, 0.5, 1.0, 3.7, 12.0, 300.0])
    np.testing.assert_allclose(sp.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    h = 1e-5
    np.testing.assert_allclose(sp.digamma(x), (sp.lgamma(x + h) - sp.lgamma(x - h)) / (2 * h), rtol=1e-5)
    np.testing.assert_allclose(sp.digamma(1.0), -0.5772156649015329, rtol=1e-12)
    np.testing.assert_allclose(sp.trigamma(1.0), math.pi**2 / 6, rtol=1e-12)
    np.testing.assert_allclose(sp.norm_cdf([-1.96, 0.0]), [0.024997895148220435, 0.5], rtol=1e-12)
    # Tabulated tails.
    assert sp.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert sp.chi2_sf(400.0, 10) == pytest.approx(math.exp(-200) * sum(200**k / math.factorial(k) for k in range(5)), rel=1e-10)
    assert sp.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert sp.f_sf(4.1028210151304, 2, 10) == pytest.approx(0.05, rel=1e-8)
    assert sp.betainc(2.0, 3.0, 0.4) == pytest.approx(0.5248, rel=1e-12)
    assert sp.ncchi2_sf(5.0, 3, 0.0) == sp.chi2_sf(5.0, 3)
    # A non-central chi-square with two degrees of freedom by simulation-free quadrature: Rice distribution at 2.
    r = np.linspace(0, 2, 200_001)
    i0 = sum((r / 2) ** (2 * k) / math.factorial(k) ** 2 for k in range(30))
    density = r * np.exp(-(r * r + 1) / 2) * i0
    assert sp.ncchi2_sf(4.0, 2, 1.0) == pytest.approx(1 - np.trapezoid(density, r), abs=1e-8)


def test_weighted_chi_square():
    assert sp.weighted_chi2_sf(3.841458820694124, [1.0])[0] == pytest.approx(0.05, abs=1e-4)
    assert sp.weighted_chi2_sf(12.0, [2.0, 2.0, 2.0])[0] == pytest.approx(sp.chi2_sf(6.0, 3), abs=1e-4)
    p, fault = sp.weighted_chi2_sf(2.0, [1.0, 0.4])
    rng = np.random.default_rng(1)
    z = rng.normal(size=(400_000, 2)) ** 2
    assert not fault and p == pytest.approx((z @ [1, 0.4] > 2).mean(), abs=3e-3)
    assert sp.liu_sf(6.0, [1.0, 1.0]) == pytest.approx(sp.chi2_sf(6.0, 2), rel=1e-6)
