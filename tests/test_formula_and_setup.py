import numpy as np
import pytest

from splinewright.operators.basis import make_basis, null_of_sums, polynomial_powers, row_tensor
from splinewright.operators.passes import Facts, fold, tsqr
from splinewright.plans.formula import SmoothSpec, parse_formula
from splinewright.plans.penalties import CompositePenalty, Penalty, embed, shrink
from splinewright.plans.setup import dependent_columns


def test_grammar():
    f = parse_formula("y ~ x + fac + s(u, k=8, bs='CR') + te(v, w) + s(z, by=fac, m=2) - 1")
    assert f.response == "y" and [t.name for t in f.parametric] == ["x", "fac"] and not f.has_intercept
    assert [(s.kind, s.bs, s.k, s.by) for s in f.smooths] == [("s", "cr", 8, None), ("te", "cr", -1, None), ("s", "tp", -1, "fac")]
    assert not parse_formula("y ~ 0 + x").has_intercept and parse_formula("y ~ 1").has_intercept


@pytest.mark.parametrize("text", ["y", "~ x", "y ~", "y ~ x *", "y ~ x * z", "y ~ x:z", "y ~ f(x)", "y ~ s()", "y ~ s(2)", "y ~ s(x, k='a')", "y ~ s(x, bs=1)", "y ~ s(x, by=1)", "y ~ s(x, q=1)", "y ~ 3", "y ~ -x", "y ~ s(x) + s(x)", "y ~ s(x, k=j)"])
def test_bad_formulas(text):
    with pytest.raises(ValueError):
        parse_formula(text)


@pytest.fixture(scope="module")
def facts(spark):
    rng = np.random.default_rng(42)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(size=(200, 3))], "x double, y double, z double").persist()
    return Facts(df, ["x", "y", "z"]), df


@pytest.mark.parametrize("bs", ["cr", "cs", "cc", "tp", "ts"])
def test_basis(facts, bs):
    b = make_basis(SmoothSpec("s", ("x",), bs, 8))
    b.setup(facts[0])
    x = np.linspace(0.02, 0.98, 101)
    m = b.eval({"x": x})
    assert m.shape == (101, b.n_coefs) and np.linalg.matrix_rank(b.penalties[0], tol=1e-9 * np.abs(b.penalties[0]).max()) == b.ranks[0]
    if bs in ("cr", "cs", "cc"):
        np.testing.assert_allclose(m.sum(1), 1, atol=1e-10)
        np.testing.assert_allclose(b.eval({"x": b.knots[:-1]})[:, : b.n_coefs], np.eye(len(b.knots) - 1, b.n_coefs), atol=1e-10)
    if bs == "cr":  # straight lines cost nothing and go on outside
        line = 2 + 3 * b.knots
        assert line @ b.penalties[0] @ line == pytest.approx(0, abs=1e-8)
        np.testing.assert_allclose(b.eval({"x": np.array([-1.0, 2.0])}) @ line, [-1, 8], rtol=1e-9)
        # The penalty is the integrated squared second derivative.
        beta, t = np.random.default_rng(0).normal(size=8), np.linspace(b.knots[0], b.knots[-1], 20_001)
        f = b.eval({"x": t}) @ beta
        bend = np.gradient(np.gradient(f, t), t)
        assert beta @ b.penalties[0] @ beta == pytest.approx(np.trapezoid(bend[5:-5] ** 2, t[5:-5]), rel=2e-2)
    if bs == "cc":
        ends = b.eval({"x": np.array([b.knots[0], b.knots[-1], b.knots[0] + 0.1, b.knots[-1] + 0.1])})
        np.testing.assert_allclose(ends[[0, 2]], ends[[1, 3]], atol=1e-10)
    if bs == "tp":
        flat = np.linalg.lstsq(b.eval({"x": x}), 2 + 3 * x, rcond=None)[0]
        assert flat @ b.penalties[0] @ flat == pytest.approx(0, abs=1e-8)


def test_thin_plate_in_two_dimensions_with_few_knots(facts):
    b = make_basis(SmoothSpec("s", ("x", "y"), "tp", 12, None, {"max_knots": 50}))
    b.setup(facts[0])
    assert len(b.at) == 50 and b.null_dim == 3 and np.isfinite(b.eval({"x": np.array([0.5]), "y": np.array([0.5])})).all()


def test_tensors(facts):
    te, ti = (make_basis(SmoothSpec(k, ("x", "y"), bs, 4)) for k, bs in (("te", "cr"), ("ti", "cr")))
    for b in (te, ti):
        b.setup(facts[0])
    assert te.n_coefs == 16 and ti.n_coefs == 9 and len(te.penalties) == len(ti.penalties) == 2
    sums = facts[0].basis_sums(ti)["sums"]
    np.testing.assert_allclose(sums.shape, (9,))
    np.testing.assert_allclose(row_tensor(np.array([[1.0, 2]]), np.array([[3.0, 4]])), [[3, 4, 6, 8]])
    tp = make_basis(SmoothSpec("te", ("x", "y"), "tp", 4))
    tp.setup(facts[0])
    assert np.isfinite(tp.eval({"x": np.array([0.1]), "y": np.array([0.2])})).all()
    assert polynomial_powers(2, 3) == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]


def test_basis_errors(facts):
    with pytest.raises(ValueError, match="at least 3"):
        make_basis(SmoothSpec("s", ("x",), "cr", 2))
    with pytest.raises(ValueError, match="distinct"):
        make_basis(SmoothSpec("s", ("x",), "cr", 500)).setup(facts[0])
    with pytest.raises(KeyError):
        make_basis(SmoothSpec("s", ("x",), "ps"))
    with pytest.raises(ValueError):
        make_basis(SmoothSpec("s", ("x", "y"), "cr"))


def test_penalties():
    s = np.diag([0.0, 1.0, 2.0])
    assert Penalty(s).rank == 2 and np.linalg.matrix_rank(shrink(s)) == 3
    np.testing.assert_allclose(CompositePenalty([Penalty(s), Penalty(np.eye(3))], [0.0, np.log(2)]).weighted(), s + 2 * np.eye(3))
    assert embed(s, 1, 5)[2, 2] == 1
    for bad in (np.ones(3), np.ones((2, 3)), np.array([[1.0, 2], [0, 1]])):
        with pytest.raises(ValueError):
            Penalty(bad)
    with pytest.raises(ValueError):
        embed(s, 4, 5)
    with pytest.raises(ValueError):
        CompositePenalty([])


def test_dependence_is_found_at_root_epsilon():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    assert dependent_columns(x, np.column_stack((rng.normal(size=300), x @ [1, 2, 3, 4], rng.normal(size=300)))) == [1]
    z = null_of_sums(x.sum(0))
    np.testing.assert_allclose((x @ z).sum(0), 0, atol=1e-10)


def test_passes_do_not_depend_on_partitions(facts):
    df = facts[1]

    def step(c):
        x = np.column_stack((c["x"], c["y"], c["z"]))
        return [x.T @ x, np.abs(x).max()]

    one, many, tree = (fold(df.repartition(n), step, [np.add, np.maximum]) for n in (1, 7, 90))
    x = df.toPandas().to_numpy()
    for got in (one, many, tree):
        np.testing.assert_allclose(got[0], x.T @ x, rtol=1e-12)
        assert got[1] == np.abs(x).max()
    r = tsqr(df.repartition(5), lambda c: np.column_stack((c["x"], c["y"], c["z"])))
    np.testing.assert_allclose(r.T @ r, x.T @ x, rtol=1e-10)
