"""Fits against dense algebra on the collected rows, derivatives against differences, invariants and errors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splinewright.functions.families import Gamma, get_family
from splinewright.gam import GAM
from splinewright.operators.solve import LocalEngine, Problem, criterion, derivatives, pirls
from splinewright.plans.setup import Factor, numerical_rank
from splinewright.sources import models
from splinewright.streaming.scoring import GramAccumulator, score_stream


def data(n=300, seed=42):
    rng = np.random.default_rng(seed)
    x1, x2, fac = rng.uniform(0, 1, n), rng.uniform(0, 1, n), rng.choice(list("abc"), n)
    eta = np.sin(2 * np.pi * x1) + 0.5 * x2
    return pd.DataFrame({
        "x1": x1, "x2": x2, "fac": fac, "w": rng.uniform(0.5, 2, n), "o": rng.normal(0, 0.1, n), "gaussian": eta + rng.normal(0, 0.3, n), "binomial": (rng.uniform(size=n) < 1 / (1 + np.exp(-2 * eta))).astype(float),
        "poisson": rng.poisson(np.exp(0.5 * eta + 0.5)).astype(float), "gamma": rng.gamma(5, np.exp(0.3 * eta + 1) / 5),
    })


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(data()).persist()


CELLS = [(f, s) for f in ("gaussian", "binomial", "poisson", "gamma") for s in ("s(x1, k=8, bs='tp')", "s(x1, k=8, bs='cr')", "te(x1, x2, k=4)", "ti(x1, x2, k=4)", "s(x1, by=fac, k=6, bs='tp') + fac", "s(x1, by=fac, k=6, bs='cr') + fac", "te(x1, x2, by=fac, k=4) + fac")]


@pytest.mark.parametrize("family,smooth", CELLS)
def test_hard_gates(df, family, smooth):
    m = GAM(f"{family} ~ {smooth}", family=family).fit(df)
    assert m.converged_ and m.deviance_ >= 0 and np.isfinite(m.coefficients_).all()
    assert (m.edf_ > 0).all() and m.edf_total_ <= min(m.setup_.p, m.n_)
    np.testing.assert_allclose(m.Vp_, m.Vp_.T, atol=1e-10 * np.abs(m.Vp_).max())
    assert np.linalg.eigvalsh(m.Vp_).min() > -1e-8 * np.abs(m.Vp_).max()
    assert all(0 <= p <= 1 or np.isnan(p) for *_, p in m.summary(show=False).smooth)


@pytest.mark.parametrize("family,weights", [("gaussian", None), ("gaussian", "w"), ("poisson", None), ("poisson", "w"), ("binomial", None), ("gamma", "w")])
@pytest.mark.parametrize("local", [True, False])
def test_smooth_test_against_dense_columns(df, family, weights, local):
    """Wood's statistic from a QR of the rows' unweighted columns, its p-value by simulation of the mixture."""
    m = GAM(f"{family} ~ s(x1, k=8, bs='cr') + s(x2, k=6, bs='tp')", family=family, local=local).fit(df, weights=weights)
    pdf, rng = data(), np.random.default_rng(2)
    x = m.setup_.eval({c: pdf[c].to_numpy() for c in ("x1", "x2", "fac")})
    rdf = m.n_ - m.edf_total_
    for i, (_, _, ref, stat, p) in enumerate(m.summary(show=False).smooth):
        at = m.setup_.term_slice(i)
        r = np.linalg.qr(x[:, at])[1]
        val, vec = np.linalg.eigh(r @ m.Vp_[at, at] @ r.T)
        val, vec = val[::-1], vec[:, ::-1] * np.sign(vec[0, ::-1])
        rank = min(m.edf1_[i], vec.shape[1])
        k, nu = int(rank), rank - int(rank)
        z = (vec.T @ r @ m.coefficients_[at]) / np.sqrt(np.maximum(val, 1e-300))
        pinv = np.zeros((len(z), len(z)))
        pinv[range(k), range(k)] = 1
        pinv[k - 1 : k + 1, k - 1 : k + 1] = [[1, np.sqrt(nu * (1 - nu) / 2)], [np.sqrt(nu * (1 - nu) / 2), nu]]
        flip = np.ones(len(z))
        flip[k - 1] = -1
        d, d1 = z @ pinv @ z, (z * flip) @ pinv @ (z * flip)
        known = family in ("poisson", "binomial")
        np.testing.assert_allclose(stat, d if known else d / rank, rtol=1e-6)
        np.testing.assert_allclose(ref, rank, rtol=1e-9)
        weight = np.ones(k + 1)
        weight[k - 1], weight[k] = np.linalg.eigvalsh([[1, np.sqrt(nu * (1 - nu) / 2)], [np.sqrt(nu * (1 - nu) / 2), nu]])[::-1]
        draws = rng.chisquare(1, (200_000, k + 1)) @ weight
        scale = 1 if known else rng.chisquare(round(rdf), 200_000) / round(rdf)
        np.testing.assert_allclose(p, ((draws > d * scale).mean() + (draws > d1 * scale).mean()) / 2, atol=0.005)


def dense(m, pdf, family):
    """The same penalised fit by plain numpy on all rows."""
    x = m.setup_.eval({c: pdf[c].to_numpy() for c in ("x1", "x2", "fac")})
    fam, y = get_family(family), pdf[family].to_numpy()
    s = sum(l * p for l, p in zip(m.smoothing_params_, m.setup_.penalties))
    mu = fam.initialize(y)
    eta = fam.link.link(mu)
    for _ in range(200):
        g = fam.link.derivative(mu)
        w, z = 1 / (fam.variance(mu) * g * g), eta + (y - mu) * g
        beta = np.linalg.solve(x.T @ (x * w[:, None]) + s, x.T @ (w * z))
        eta = x @ beta
        mu = fam.link.inverse(eta)
    return beta, x @ beta


@pytest.mark.parametrize("family", ["gaussian", "binomial", "poisson"])
@pytest.mark.parametrize("local", [True, False])
def test_fit_equals_dense_algebra(df, family, local):
    m = GAM(f"{family} ~ s(x1, k=8, bs='cr') + te(x1, x2, k=4) + fac", family=family, local=local).fit(df)
    pdf = data()
    beta, eta = dense(m, pdf, family)
    np.testing.assert_allclose(m.setup_.eval({c: pdf[c].to_numpy() for c in ("x1", "x2", "fac")}) @ m.coefficients_, eta, atol=2e-5)


def test_paths_agree(spark):
    pdf = data(900)
    pdf["x1"], pdf["x2"] = pdf["x1"].round(1), 0.0
    df = spark.createDataFrame(pdf)
    a, b = GAM("poisson ~ s(x1, k=6, bs='cr') + fac", family="poisson").fit(df, weights="w"), GAM("poisson ~ s(x1, k=6, bs='cr') + fac", family="poisson", local=False).fit(df, weights="w")
    assert a.execution_path_ == "compressed" and b.execution_path_ == "spark"
    np.testing.assert_allclose(a.coefficients_, b.coefficients_, atol=1e-6)
    for k in ("deviance_", "null_deviance_", "score_", "edf_total_", "r_squared_"):
        assert getattr(a, k) == pytest.approx(getattr(b, k), rel=1e-5)
    pdf["u"] = pdf["x1"] + np.linspace(0, 1e-9, len(pdf))  # nothing to compress
    c = GAM("poisson ~ s(u, k=6, bs='cr') + fac", family="poisson").fit(spark.createDataFrame(pdf), weights="w")
    assert c.execution_path_ == "local"


@pytest.mark.parametrize("family,link,tol", [("gaussian", None, 1e-5), ("poisson", None, 1e-4), ("binomial", None, 1e-4), ("gamma", "log", 1e-3)])
def test_derivatives_by_differences(df, family, link, tol):
    fam = Gamma(link="log") if link else get_family(family)
    m = GAM(f"{family} ~ te(x1, x2, k=4)", family=fam).fit(df)
    pdf = data()
    y = pdf[family].to_numpy()
    one = np.ones(len(y))
    rows = {"n": one, "w": one, "y": y, "ss": 0 * y, "sy": y, "d0": 0 * y, "off": 0 * y}
    engine = LocalEngine(m.setup_.eval({c: pdf[c].to_numpy() for c in ("x1", "x2")}), rows, fam)
    pens = m.setup_.penalties
    val, vec = np.linalg.eigh(sum(p / np.linalg.norm(p) for p in pens))
    u = vec[:, val > 1e-10 * val.max()]
    problem = Problem(pens, [([0, 1], [u.T @ p @ u for p in pens])], m.setup_.null_dim, fam, m._sums, m.n_)
    rho, phi = np.array([1.0, 2.0]), None if fam.scale_known else np.log(0.3)

    def score(r, lp):
        return criterion(problem, r, lp, pirls(engine, m.coefficients_, problem.s(r), 1e-13))

    g, h = derivatives(problem, engine, rho, phi, pirls(engine, m.coefficients_, problem.s(rho), 1e-13))
    e = 1e-4
    for j in range(2):
        d = np.eye(2)[j] * e
        assert g[j] == pytest.approx((score(rho + d, phi) - score(rho - d, phi)) / (2 * e), rel=tol, abs=1e-6)
        up = derivatives(problem, engine, rho + d, phi, pirls(engine, m.coefficients_, problem.s(rho + d), 1e-13))[0]
        down = derivatives(problem, engine, rho - d, phi, pirls(engine, m.coefficients_, problem.s(rho - d), 1e-13))[0]
        np.testing.assert_allclose(h[:, j], (up - down) / (2 * e), rtol=50 * tol, atol=1e-4)
    if phi is not None:
        assert g[2] == pytest.approx((score(rho, phi + e) - score(rho, phi - e)) / (2 * e), rel=tol, abs=1e-6)


def test_limits_of_smoothing(df):
    pdf = data()
    stiff = GAM("gaussian ~ s(x1, k=8, bs='cr')", sp=[1e12]).fit(df)
    line = np.polyval(np.polyfit(pdf["x1"], pdf["gaussian"], 1), pdf["x1"])
    np.testing.assert_allclose(np.sort(stiff.fitted_values_.toPandas()["fit"]), np.sort(line), atol=1e-4)
    loose = GAM("gaussian ~ s(x1, k=8, bs='cr')", sp=[1e-12]).fit(df)
    assert loose.edf_total_ == pytest.approx(8, abs=1e-4) and stiff.edf_total_ == pytest.approx(2, abs=1e-4)


def test_prediction_and_matrix(df):
    m = GAM("poisson ~ s(x1, k=6, bs='cr') + fac", family="poisson").fit(df, offset="o")
    new = df.select("x1", "fac", "o", F.lit(1).alias("keep"))
    out = m.predict(new, pred_type="link", se_fit=True, offset="o").toPandas()
    x = np.vstack(m.predict_matrix(new).toPandas()["lpmatrix"])
    np.testing.assert_allclose(out["fit"], x @ m.coefficients_ + out["o"], atol=1e-10)
    np.testing.assert_allclose(out["se_fit"], np.sqrt(((x @ m.Vp_) * x).sum(1)), atol=1e-10)
    np.testing.assert_allclose(m.predict(new, offset="o").toPandas()["fit"], np.exp(out["fit"]), rtol=1e-10)
    unseen = new.limit(1).withColumn("fac", F.lit("zzz"))
    assert np.isfinite(m.predict(unseen).first()["fit"])
    m.unseen = "error"
    with pytest.raises(Exception, match="Unseen level"):
        m.predict(unseen).collect()


def test_weights_equal_repetition(spark):
    pdf = data(120)
    pdf["k"] = np.arange(120) % 3 + 1
    twice = pdf.loc[pdf.index.repeat(pdf["k"])]
    f = "gaussian ~ s(x1, k=6, bs='cr')"
    a, b = GAM(f, sp=[1.0]).fit(spark.createDataFrame(pdf), weights="k"), GAM(f, sp=[1.0]).fit(spark.createDataFrame(twice))
    assert a.deviance_ == pytest.approx(b.deviance_, rel=0.02)


def test_side_constraints_and_ordered_factors(df):
    m = GAM("gaussian ~ s(x1, bs='cr', k=6) + s(x2, bs='cr', k=6) + te(x1, x2, k=4)").fit(df)
    x = np.vstack(m.predict_matrix(df.select("x1", "x2")).toPandas()["lpmatrix"])
    assert m.setup_.terms[2].dropped and np.linalg.matrix_rank(x) == m.setup_.p
    o = GAM("gaussian ~ s(x1, by=fac, k=6, bs='cr')", factors={"fac": Factor(("a", "b", "c"), ordered=True)}).fit(df)
    assert o.setup_.terms[0].levels == ["b", "c"]
    n = GAM("gaussian ~ s(x1, by=x2, k=6, bs='cr')").fit(df)
    assert n.setup_.terms[0].label == "s(x1):x2" and n.setup_.terms[0].size == 6


def test_summary_and_effects(spark, df):
    m = GAM("gaussian ~ s(x1, k=8, bs='cr') + s(x2, by=fac, k=5, bs='cr') + te(x1, x2, k=4) + fac").fit(df)
    s = m.summary(show=False)
    assert s.smooth[0][0] == "s(x1)" and s.smooth[0][4] < 1e-6 and "R-sq.(adj)" in str(s)
    assert s.s_table_df(spark).count() == 3 and s.p_table_df(spark).count() == 3
    out = m.partial_effects(spark, n_grid=20, n2=5).toPandas()
    assert out.groupby("term").size().to_dict() == {"s(x1)": 20, "s(x2,by=fac)": 60, "te(x1,x2)": 25}
    np.testing.assert_allclose(out["upper"] - out["fit"], 2 * out["se"], atol=1e-12)
    for bad in ({"select": 9}, {"n_grid": 1}, {"se_mult": -1}):
        with pytest.raises(ValueError):
            m.partial_effects(spark, **bad)
    noise = GAM("gaussian ~ s(o, k=6, bs='cr')").fit(df).summary(show=False)
    assert noise.smooth[0][4] > 1e-3


def test_persistence_and_streams(spark, df, tmp_path):
    m = GAM("gaussian ~ s(x1, k=6, bs='cr') + fac").fit(df)
    models.save(m, spark, str(tmp_path / "m"))
    back = models.load(spark, str(tmp_path / "m"))
    new = df.select("x1", "fac", "gaussian")
    np.testing.assert_allclose(back.predict(new).toPandas()["fit"], m.predict(new).toPandas()["fit"])
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    q = score_stream(m, stream).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == new.count()
    acc = GramAccumulator(m)
    for k in range(2):
        acc.add_batch(new.where(F.col("x1") < 0.5 if k else F.col("x1") >= 0.5), k)
    acc.add_batch(new, 1)  # delivered again
    x = np.vstack(m.predict_matrix(new).toPandas()["lpmatrix"])
    np.testing.assert_allclose(acc.xx, x.T @ x, rtol=1e-9, atol=1e-9)


def test_errors(spark, df):
    for kw, err in (({"method": "GCV"}, ValueError), ({"select": True}, NotImplementedError), ({"knots": {}}, NotImplementedError), ({"gamma": 1.4}, NotImplementedError), ({"backend": "x"}, NotImplementedError), ({"nonsense": 1}, TypeError)):
        with pytest.raises(err):
            GAM("gaussian ~ x1", **kw)
    with pytest.raises(RuntimeError):
        GAM("gaussian ~ x1").predict()
    with pytest.raises(ValueError, match="Available"):
        GAM("nope ~ x1").fit(df)
    with pytest.raises(ValueError, match="Available"):
        GAM("gaussian ~ nope").fit(df)
    with pytest.raises(ValueError, match="observations"):
        GAM("gaussian ~ x1").fit(df.limit(1))
    with pytest.raises(ValueError):
        GAM("gaussian ~ s(x1, k=20, bs='cr')").fit(df.limit(10))
    with pytest.raises(ValueError, match="smoothing"):
        GAM("gaussian ~ s(x1, k=6, bs='cr')", sp=[1, 2]).fit(df)
    with pytest.raises(ValueError, match="zero observations"):
        GAM("gaussian ~ s(x1, by=fac, k=5, bs='cr')", factors={"fac": Factor(("a", "b", "c", "d"))}).fit(df)
    with pytest.raises(ValueError, match="negative"):
        GAM("gaussian ~ x1").fit(df, weights=F.lit(-1.0))
    for bad, what in ((None, "null"), (float("nan"), "NaN"), (float("inf"), "Inf")):
        broken = df.withColumn("x1", F.when(F.col("x2") > 0.9, F.lit(bad)).otherwise(F.col("x1")))
        with pytest.raises(ValueError, match=what):
            GAM("gaussian ~ s(x1, k=6, bs='cr')").fit(broken)
    m = GAM("gaussian ~ x1").fit(df)
    with pytest.raises(ValueError):
        m.predict(df, pred_type="terms")
    with pytest.raises(ValueError, match="lacks"):
        m.predict(df.select("x2"))


@pytest.mark.parametrize("sp", [np.exp(20.0), np.exp(-20.0)])
def test_extreme_smoothing_parameters(df, sp):
    m = GAM("gaussian ~ s(x1, k=8, bs='cr')", sp=[sp]).fit(df)
    assert np.isfinite(m.coefficients_).all()


def test_hard_data(spark):
    rng = np.random.default_rng(123)
    x = np.linspace(0, 1, 200)
    y = ((x > 0.5) ^ ((np.abs(x - 0.5) < 0.05) & (rng.uniform(size=200) < 0.5))).astype(float)
    m = GAM("y ~ s(x, k=10, bs='cr')", family="binomial").fit(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})))
    assert np.isfinite(m.coefficients_).all() and np.isfinite(m.deviance_)
    z = GAM("y ~ s(x, k=5, bs='cr')", family="poisson").fit(spark.createDataFrame(pd.DataFrame({"x": x, "y": 0 * x})))
    assert np.isfinite(z.coefficients_).all() and (z.fitted_values_.toPandas()["fit"] >= 0).all()


def test_training_attributes_views_and_rug(spark, df):
    pdf = data()
    m = GAM("poisson ~ s(x1, k=6, bs='cr') + s(x2, by=fac, k=5, bs='tp') + fac", family="poisson").fit(df, weights="w", offset="o")
    x = m.setup_.eval({c: pdf[c].to_numpy() for c in ("x1", "x2", "fac")})
    np.testing.assert_allclose(np.array([r["lpmatrix"] for r in m.X_.collect()]), x, atol=1e-12)
    for name, column in (("y_", "poisson"), ("weights_", "w"), ("offset_", "o")):
        np.testing.assert_allclose([r[0] for r in getattr(m, name).collect()], pdf[column])
    assert [s["label"] for s in m.smooth_info_] == [t.label for t in m.setup_.terms] and m.smooth_info_[-1]["last_coef"] == m.setup_.p
    assert set(m.create_views(spark, "fit1")) == {"fit1_terms", "fit1_coefficients", "fit1_summary_parametric", "fit1_summary_smooth"}
    assert spark.sql("SELECT count(*) FROM fit1_coefficients JOIN fit1_summary_parametric USING (term)").first()[0] == m.setup_.n_param
    assert spark.sql("SELECT sum(edf) FROM fit1_terms").first()[0] == pytest.approx(m.edf_.sum())
    assert m.rug(1).columns == ["term", "level", "x"] and m.rug(1).count() == len(pdf)
    with pytest.raises(ValueError):
        m.rug(2)


def test_coefficient_map(df):
    pdf = data()
    m = GAM("gaussian ~ s(x1, k=6, bs='cr') + s(x2, by=fac, k=5, bs='cr') + fac").fit(df)
    cols, c = {v: pdf[v].to_numpy() for v in ("x1", "x2", "fac")}, m.coef_map_
    raw = np.hstack([m.setup_.eval_parametric(cols, len(pdf)), *[t.eval_raw(cols) for t in m.setup_.terms]])
    np.testing.assert_allclose(c.transform_x(raw), m.setup_.eval(cols), atol=1e-12)
    np.testing.assert_allclose(raw @ c.to_raw(m.coefficients_), m.setup_.eval(cols) @ m.coefficients_, atol=1e-10)
    np.testing.assert_allclose(c.to_constrained(c.to_raw(m.coefficients_)), m.coefficients_, atol=1e-12)
    big = np.zeros((raw.shape[1], raw.shape[1]))
    big[c.raw_slice(0), c.raw_slice(0)] = m.setup_.terms[0].basis.penalties[0]
    np.testing.assert_allclose(c.transform_s(big), m.setup_.penalties[0], atol=1e-9)


def test_numerical_rank():
    rng = np.random.default_rng(0)
    for m, n, k in ((20, 6, 6), (20, 6, 3), (5, 9, 5), (9, 9, 4)):
        assert numerical_rank(rng.normal(size=(m, k)) @ rng.normal(size=(k, n))) == k
    assert numerical_rank(np.zeros((4, 3))) == 0 and numerical_rank(np.zeros((0, 3))) == 0
    assert numerical_rank(np.diag([1.0, 1e-10, 1e-20])) == 2


def test_accumulator_goes_on_after_a_restart(spark, df, tmp_path):
    m, path = GAM("gaussian ~ x1 + x2").fit(df), f"file://{tmp_path}/sums"
    first = GramAccumulator(m, path, spark)
    first.add_batch(df.where("x1 < 0.5"), 0)
    first.add_batch(df.where("x1 >= 0.5 and x1 < 0.7"), 1)
    again = GramAccumulator(m, path, spark)
    again.add_batch(df.where("x1 < 0.5"), 0)
    again.add_batch(df.where("x1 >= 0.7"), 2)
    whole = GramAccumulator(m)
    whole.add_batch(df, 0)
    np.testing.assert_allclose(again.xx, whole.xx)
    assert again.seen == {0, 1, 2} and again.n == whole.n and again.yy == pytest.approx(whole.yy)
