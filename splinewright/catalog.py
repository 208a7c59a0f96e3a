"""Queries of the additive-model engine over the driver's tables, and their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.families import Gamma, get_family
from .functions.links import LINKS
from .gam import GAM
from .operators.basis import make_basis, polynomial_powers, polynomials, row_tensor, thin_plate_kernel
from .operators.passes import Facts, fold, knots
from .plans.formula import SmoothSpec
from .plans.setup import factor_levels, quality
from .sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
KEY = ["l_orderkey", "l_linenumber"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and negative zeros made plain."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0.0"


# Links ---------------------------------------------------------------------

#: mu and eta of a link's query, from l_quantity in 1..50.
_ARGS = {
    "identity": ("q / 10", "(q - 25) / 10"), "log": ("q / 10", "(q - 25) / 10"), "logit": ("q / 51", "(q - 25) / 10"), "inverse": ("q / 10", "(q - 25.5) / 10"),
    "probit": ("q / 51", "(q - 25) / 10"), "cloglog": ("q / 51", "(q - 40) / 15"), "sqrt": ("q / 10", "(q - 25) / 10"), "inverse_squared": ("q / 10", "q / 20"),
}
#: link(mu), inverse(eta), d eta / d mu, d mu / d eta in SQL.
_SQL = {
    "identity": ("m", "e", "1.0", "1.0"),
    "log": ("ln(m)", "exp(e)", "1 / m", "exp(e)"),
    "logit": ("ln(m / (1 - m))", "1 / (1 + exp(-e))", "1 / (m * (1 - m))", "exp(-e) / ((1 + exp(-e)) * (1 + exp(-e)))"),
    "inverse": ("1 / m", "1 / e", "-1 / (m * m)", "-1 / (e * e)"),
    "cloglog": ("ln(-ln(1 - m))", "1 - exp(-exp(e))", "1 / ((1 - m) * -ln(1 - m))", "exp(e - exp(e))"),
    "sqrt": ("sqrt(m)", "e * e", "0.5 / sqrt(m)", "2 * e"),
    "inverse_squared": ("1 / (m * m)", "1 / sqrt(e)", "-2 / (m * m * m)", "-0.5 / (e * sqrt(e))"),
}


def _link(name: str):
    def run(spark, sf_dir):
        q, link = F.col("l_quantity"), LINKS[name]()
        mu, eta = (F.expr(s.replace("q", "l_quantity")).cast("double") for s in _ARGS[name])
        df = table(spark, sf_dir, "lineitem").select(*KEY, q, mu.alias("m"), eta.alias("e"))
        m, e = F.col("m"), F.col("e")
        return rounded(df.select(*KEY, link.link(m).alias("link"), link.inverse(e).alias("inverse"), link.derivative(m).alias("derivative"), link.mu_eta(e).alias("mu_eta")))

    sql = None
    if name in _SQL:
        a, b, c, d = _SQL[name]
        mu, eta = (s.replace("q", "l_quantity") for s in _ARGS[name])
        sql = f"SELECT l_orderkey, l_linenumber, {r(a)} AS link, {r(b)} AS inverse, {r(c)} AS derivative, {r(d)} AS mu_eta FROM (SELECT *, CAST({mu} AS DOUBLE) AS m, CAST({eta} AS DOUBLE) AS e FROM lineitem)"
    query(f"link_{name}", sql)(run)


for _name in LINKS:
    _link(_name)

# Families ------------------------------------------------------------------

#: y and mu from lineitem; weights are 1 + l_tax.
_DATA = {
    "gaussian": ("l_extendedprice / 10000", "l_quantity / 10"),
    "binomial": ("CASE WHEN l_returnflag = 'R' THEN 1.0D ELSE 0.0D END", "l_quantity / 51"),
    "poisson": ("l_linenumber * 1.0D", "l_quantity / 10"),
    "gamma": ("l_extendedprice / 9973", "l_quantity / 10"),
}
#: V, V', unit deviance, mu0, d eta / d mu, eta, and parts of saturated log likelihood and aic at scale 0.5.
_XLOGX = "CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END"
_FAM_SQL = {
    "gaussian": ("1.0", "0.0", "(y - m) * (y - m)", "y", "1.0", "m", "0.5 * ln(w) - 0.5 * ln(2 * pi() * 0.5)", "w * (ln(2 * pi() * 0.5) + 1)", 2),
    "binomial": ("m * (1 - m)", "1 - 2 * m", f"2 * ({_XLOGX} + CASE WHEN y < 1 THEN (1 - y) * ln((1 - y) / (1 - m)) ELSE 0 END)", "(y + 0.5) / 2", "1 / (m * (1 - m))", "ln(m / (1 - m))", "0.0", "-2 * w * (y * ln(m) + (1 - y) * ln(1 - m))", 0),
    "poisson": ("m", "1.0", f"2 * ({_XLOGX} - (y - m))", "CASE WHEN y > 0 THEN y ELSE 0.1 END", "1 / m", "ln(m)", "w * CASE WHEN y > 0 THEN y * ln(y) - y - lgamma(y + 1) ELSE 0 END", "-2 * w * (y * ln(m) - m - lgamma(y + 1))", 0),
    "gamma": ("m * m", "2 * m", "2 * (-ln(y / m) + (y - m) / m)", "y", "-1 / (m * m)", "1 / m", "-lgamma(w / 0.5) + w / 0.5 * ln(w / 0.5) - w / 0.5 - ln(y)", "-2 * w * (ln(y) - 2 * y / m - lgamma(2.0) + 2 * ln(2.0) - 2 * ln(m))", 2),
}


def _families(name: str):
    y_sql, mu_sql = _DATA[name]
    v, dv, dev, mu0, g, eta, sat, aic, constant = _FAM_SQL[name]

    def rows(spark, sf_dir):
        return table(spark, sf_dir, "lineitem").select(*KEY, F.expr(y_sql).cast("double").alias("y"), F.expr(mu_sql).cast("double").alias("m"), (1 + F.col("l_tax")).alias("w"))

    def pointwise(spark, sf_dir):
        fam, y, m, w = get_family(name), F.col("y"), F.col("m"), F.col("w")
        return rounded(rows(spark, sf_dir).select(
            *KEY, fam.variance(m).alias("variance"), fam.dvar(m).alias("dvar"), fam.unit_deviance(y, m).alias("deviance"), fam.deviance_resids(y, m, w).alias("residual"), fam.initialize(y, w).alias("mu0"),
            fam.working_weights(m, w).alias("weight"), fam.working_response(y, m, fam.link.link(m)).alias("response"), fam.valid_mu(m).alias("valid"),
        ))

    def totals(spark, sf_dir):
        fam, y, m, w = get_family(name), F.col("y"), F.col("m"), F.col("w")
        df = rows(spark, sf_dir).agg(
            fam.dev_resids(y, m, w).alias("deviance"), F.sum(fam.saturated(y, w, 0.5)).alias("saturated"), (F.sum(fam.aic_part(y, m, w, 0.5)) + fam.aic_constant()).alias("aic"),
            F.sum(w * (y - m) * (y - m) / fam.variance(m)).alias("pearson"), F.avg(fam.dvar(m) * (y - m) / fam.variance(m)).alias("fletcher"), F.count(F.lit(1)).alias("n"),
        )
        return rounded(df.select("n", *[(F.col(c) / F.col("n")).alias(c) for c in ("deviance", "saturated", "aic", "pearson")], "fletcher"))

    y_duck = y_sql.replace("D", "") if "CASE" not in y_sql else "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END"
    base = f"(SELECT l_orderkey, l_linenumber, CAST({y_duck.replace('1.0D', '1.0')} AS DOUBLE) AS y, CAST({mu_sql} AS DOUBLE) AS m, 1 + l_tax AS w FROM lineitem)"
    sign = "CASE WHEN y > m THEN 1 WHEN y < m THEN -1 ELSE 0 END"
    valid = {"gaussian": "true", "binomial": "m > 0 AND m < 1"}.get(name, "m > 0")
    query(f"fam_{name}_pointwise", f"""SELECT l_orderkey, l_linenumber, {r(v)} AS variance, {r(dv)} AS dvar, {r(f'greatest({dev}, 0)')} AS deviance, {r(f'{sign} * sqrt(greatest(w * ({dev}), 0))')} AS residual,
        {r(mu0)} AS mu0, {r(f'w / (({v}) * ({g}) * ({g}))')} AS weight, {r(f'({eta}) + (y - m) * ({g})')} AS response, {valid} AS valid FROM {base}""")(pointwise)
    query(f"fam_{name}_totals", f"""SELECT count(*) AS n, {r(f'sum(w * greatest({dev}, 0)) / count(*)')} AS deviance, {r(f'sum({sat}) / count(*)')} AS saturated, {r(f'(sum({aic}) + {constant}) / count(*)')} AS aic,
        {r(f'sum(w * (y - m) * (y - m) / ({v})) / count(*)')} AS pearson, {r(f'avg(({dv}) * (y - m) / ({v}))')} AS fletcher FROM {base}""")(totals)


for _name in _DATA:
    _families(_name)

# Scans and facts -----------------------------------------------------------


@query("data_quality", "SELECT count(*) AS n, count(*) FILTER (value IS NULL) AS value__null, count(*) FILTER (isnan(value)) AS value__nan, count(*) FILTER (isinf(value)) AS value__inf, count(*) FILTER (event_type IS NULL) AS event_type__null FROM events")
def data_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("factor_levels", "SELECT l_returnflag AS level, count(*) AS n FROM lineitem GROUP BY 1")
def levels(spark, sf_dir):
    return factor_levels(table(spark, sf_dir, "lineitem"), "l_returnflag")


def _knots(k: int, x: str, name: str):
    at = ", ".join(repr(i / (k - 1)) for i in range(k))
    sql = f"SELECT unnest(range({k})) AS j, round(unnest(quantile_cont(x, [{at}])), 6) + 0.0 AS knot FROM (SELECT DISTINCT CAST({x} AS DOUBLE) AS x FROM {name})"

    def run(spark, sf_dir):
        found, _ = knots(table(spark, sf_dir, name), x, k)
        return rounded(spark.createDataFrame([(j, float(v)) for j, v in enumerate(found)], "j long, knot double"))

    query(f"knots_{x}_k{k}", sql)(run)


_knots(10, "l_extendedprice", "lineitem")
_knots(5, "value", "events")


@query("covariate_range", "SELECT min(value) AS lo, max(value) AS hi, round(avg(value), 6) + 0.0 AS mean, count(DISTINCT value) AS n_distinct FROM events")
def covariate_range(spark, sf_dir):
    facts = Facts(table(spark, sf_dir, "events").select("value"), ["value"])
    return rounded(spark.createDataFrame([(*facts.range("value"), facts.mean("value"), facts.n_distinct("value"))], "lo double, hi double, mean double, n_distinct long"))


# Bases ---------------------------------------------------------------------


def _evaluated(df: DataFrame, keys: list[str], xs: list[str], make, names: list[str]) -> DataFrame:
    """Rows of a numpy basis as columns, by a narrow map."""
    import pandas as pd

    kinds = dict(df.dtypes)

    def run(batches):
        for b in batches:
            x = make({v: b[v].to_numpy(float) for v in xs})
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(x, columns=names)], axis=1)

    return df.select(*keys, *xs).mapInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} double" for n in names]))


def _set_up(df: DataFrame, x: str, bs: str, k: int):
    basis = make_basis(SmoothSpec("s", (x,), bs, k))
    basis.setup(Facts(df.select(x), [x]))
    return basis


_CR3 = """WITH t AS (SELECT quantile_cont(x, 0.0) AS k0, quantile_cont(x, 0.5) AS k1, quantile_cont(x, 1.0) AS k2 FROM (SELECT DISTINCT l_quantity AS x FROM lineitem))
, h AS (SELECT *, k1 - k0 AS h0, k2 - k1 AS h1, (k2 - k0) / 3 AS b FROM t)
, x AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, h.*, CASE WHEN l_quantity > k1 THEN 1 ELSE 0 END AS j FROM lineitem, h)
, c AS (SELECT *, CASE j WHEN 0 THEN ((x - k0) * (x - k0) * (x - k0) / h0 - h0 * (x - k0)) / 6 ELSE ((k2 - x) * (k2 - x) * (k2 - x) / h1 - h1 * (k2 - x)) / 6 END AS g FROM x)
SELECT l_orderkey, l_linenumber, round(CASE j WHEN 0 THEN (k1 - x) / h0 ELSE 0 END + g / h0 / b, 6) + 0.0 AS b0,
 round(CASE j WHEN 0 THEN (x - k0) / h0 ELSE (k2 - x) / h1 END - g * (1 / h0 + 1 / h1) / b, 6) + 0.0 AS b1,
 round(CASE j WHEN 0 THEN 0 ELSE (x - k1) / h1 END + g / h1 / b, 6) + 0.0 AS b2 FROM c"""


@query("basis_cr_k3", _CR3)
def basis_cr(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    basis = _set_up(df, "l_quantity", "cr", 3)
    return rounded(_evaluated(df, KEY, ["l_quantity"], basis.eval, ["b0", "b1", "b2"]))


@query("cyclic_wrap", f"SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_quantity > 30 THEN 10 + (l_quantity - 10) % 20 WHEN l_quantity < 10 THEN 30 - (30 - l_quantity) % 20 ELSE l_quantity END')} AS wrapped FROM lineitem")
def cyclic_wrap(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    basis = _set_up(df.where("l_quantity BETWEEN 10 AND 30"), "l_quantity", "cc", 3)
    return rounded(_evaluated(df, KEY, ["l_quantity"], lambda c: basis.wrap(c["l_quantity"])[:, None], ["wrapped"]))


@query("basis_tp_kernel", f"""SELECT l_orderkey, l_linenumber, {r('pow(abs(l_quantity - 25) / 10, 3) / 12')} AS eta1,
  {r('CASE WHEN r2 > 0 THEN r2 * ln(sqrt(r2)) / (8 * pi()) ELSE 0 END')} AS eta2 FROM (SELECT *, pow((l_quantity - 25) / 10, 2) + pow(l_discount * 10 - 0.5, 2) AS r2 FROM lineitem)""")
def tp_kernel(spark, sf_dir):
    def make(c):
        a, b = (c["l_quantity"] - 25) / 10, c["l_discount"] * 10 - 0.5
        return np.column_stack((thin_plate_kernel(np.abs(a), 2, 1), thin_plate_kernel(np.sqrt(a * a + b * b), 2, 2)))

    return rounded(_evaluated(table(spark, sf_dir, "lineitem"), KEY, ["l_quantity", "l_discount"], make, ["eta1", "eta2"]))


@query("basis_tp_polynomials", f"SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS t0, {r('x')} AS t1, {r('y')} AS t2, {r('x * x')} AS t3, {r('x * y')} AS t4, {r('y * y')} AS t5 FROM (SELECT *, l_quantity / 10 AS x, l_discount AS y FROM lineitem)")
def tp_polynomials(spark, sf_dir):
    powers = polynomial_powers(2, 3)
    make = lambda c: polynomials(np.column_stack((c["l_quantity"] / 10, c["l_discount"])), powers)
    return rounded(_evaluated(table(spark, sf_dir, "lineitem"), KEY, ["l_quantity", "l_discount"], make, [f"t{i}" for i in range(6)]))


@query("row_tensor", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{r(f'{a} * {b}')} AS t{3 * i + j}" for i, a in enumerate(("1", "x", "x * x")) for j, b in enumerate(("1", "y", "y * y"))) + " FROM (SELECT *, l_quantity / 10 AS x, l_discount * 10 AS y FROM lineitem)")
def row_tensor_query(spark, sf_dir):
    def make(c):
        a, b = (np.column_stack((np.ones(len(x)), x, x * x)) for x in (c["l_quantity"] / 10, c["l_discount"] * 10))
        return row_tensor(a, b)

    return rounded(_evaluated(table(spark, sf_dir, "lineitem"), KEY, ["l_quantity", "l_discount"], make, [f"t{i}" for i in range(9)]))


@query("poly_terms_te", None)
def te_lpmatrix(spark, sf_dir):
    df = _lines(spark, sf_dir)
    return GAM("y_gaussian ~ te(x1, x2, k=4)", sp=[1.0, 1.0]).fit(df).predict_matrix(df.select(*KEY, "x1", "x2"))


# Parametric models ---------------------------------------------------------

_DUMMY = "CASE WHEN l_returnflag = '{0}' THEN 1.0 ELSE 0.0 END"


@query("parametric_matrix", f"SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS c0, l_quantity AS c1, {_DUMMY.format('N')}::DOUBLE AS c2, {_DUMMY.format('R')}::DOUBLE AS c3 FROM lineitem")
def parametric_matrix(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = GAM("l_extendedprice ~ l_quantity + l_returnflag").fit(df).predict_matrix(df.select(*KEY, "l_quantity", "l_returnflag"))
    return out.select(*KEY, *[F.get("lpmatrix", F.lit(i)).alias(f"c{i}") for i in range(4)])


_DESIGN = "(SELECT 1.0::DOUBLE AS c0, l_quantity AS c1, l_discount AS c2, l_extendedprice / 1000 AS y, 1 + l_tax AS w FROM lineitem)"


def _gram_sql(w: str) -> str:
    names = ["c0", "c1", "c2", "y"]
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {r(f'sum({w} * {a} * {b}) / count(*) / pi()')} AS value FROM {_DESIGN}" for i, a in enumerate(names) for j, b in enumerate(names))


def _gram(df: DataFrame, weight: str | None, spark) -> DataFrame:
    def step(c):
        x = np.column_stack((np.ones(len(c["l_quantity"])), c["l_quantity"], c["l_discount"], c["l_extendedprice"] / 1000))
        w = c["w"] if weight else np.ones(len(x))
        return [(x * w[:, None]).T @ x, float(len(x))]

    g, n = fold(df, step)
    return rounded(spark.createDataFrame([(i, j, float(g[i, j] / n / math.pi)) for i in range(4) for j in range(4)], "i int, j int, value double"))


@query("gram_parametric", _gram_sql("1"))
def gram_parametric(spark, sf_dir):
    return _gram(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), None, spark)


@query("gram_weighted", _gram_sql("w"))
def gram_weighted(spark, sf_dir):
    return _gram(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", (1 + F.col("l_tax")).alias("w")), "w", spark)


@query("compressed_rows", f"SELECT l_quantity, l_returnflag, count(*)::DOUBLE AS n, {r('sum(1 + l_tax)')} AS w, {r('sum((1 + l_tax) * l_linenumber) / sum(1 + l_tax)')} AS y, sum(l_linenumber)::DOUBLE AS sy FROM lineitem GROUP BY ALL")
def compressed_rows(spark, sf_dir):
    m = GAM("l_linenumber ~ l_quantity + l_returnflag", family="poisson")
    rows = m._compressed(m._rows(table(spark, sf_dir, "lineitem"), 1 + F.col("l_tax"), None))
    return rounded(rows.select("l_quantity", "l_returnflag", F.col("__n").alias("n"), F.col("__w").alias("w"), F.col("__y").alias("y"), F.col("__sy").alias("sy")))


@query("ols_2", f"SELECT unnest(['(Intercept)', 'l_quantity']) AS term, unnest([{r('regr_intercept(y, x)', 5)}, {r('regr_slope(y, x)', 5)}]) AS estimate FROM (SELECT l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem)")
def ols_2(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), "l_quantity")
    return rounded(GAM("y ~ l_quantity").fit(df).coefficients_df(spark).select("term", "estimate"), 5)


@query("summary_ols", """WITH s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS mx, regr_syy(y, x) * (1 - regr_r2(y, x)) AS rss FROM (SELECT l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem))
 SELECT '(Intercept)' AS term, round(a, 5) + 0.0 AS estimate, round(sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)), 5) + 0.0 AS se FROM s UNION ALL SELECT 'l_quantity', round(b, 5) + 0.0, round(sqrt(rss / (n - 2) / sxx), 5) + 0.0 FROM s""")
def summary_ols(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), "l_quantity")
    found = GAM("y ~ l_quantity").fit(df).summary(show=False)
    return rounded(found.p_table_df(spark).select("term", "estimate", "se"), 5)


@query("model_statistics", """SELECT count(*) AS n, round(regr_syy(y, x) / count(*), 5) + 0.0 AS null_deviance, round(regr_syy(y, x) * (1 - regr_r2(y, x)) / count(*), 5) + 0.0 AS deviance, round(regr_r2(y, x), 6) + 0.0 AS deviance_explained,
 round(1 - (1 - regr_r2(y, x)) * (count(*) - 1) / (count(*) - 2), 6) + 0.0 AS r_sq_adj FROM (SELECT l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem)""")
def model_statistics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), "l_quantity")
    m = GAM("y ~ l_quantity").fit(df)
    row = (m.n_, round(m.null_deviance_ / m.n_, 5), round(m.deviance_ / m.n_, 5), round(m.deviance_explained_, 6), round(m.r_squared_, 6))
    return spark.createDataFrame([row], "n long, null_deviance double, deviance double, deviance_explained double, r_sq_adj double")


@query("predict_ols", """WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem)
, s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS mx, regr_syy(y, x) * (1 - regr_r2(y, x)) AS rss FROM d)
SELECT l_orderkey, l_linenumber, round(a + b * x, 4) + 0.0 AS fit, round(sqrt(rss / (n - 2) * (1.0 / n + (x - mx) * (x - mx) / sxx)), 5) + 0.0 AS se_fit FROM d, s""")
def predict_ols(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*KEY, (F.col("l_extendedprice") / 1000).alias("y"), "l_quantity")
    out = GAM("y ~ l_quantity").fit(df).predict(df, se_fit=True)
    return out.select(*KEY, (F.round("fit", 4) + 0.0).alias("fit"), (F.round("se_fit", 5) + 0.0).alias("se_fit"))


def _irls_sql(mu: str, weight: str, y: str, start: str, pull: str = "y - m", more: str = "1 AS one") -> str:
    """Newton steps for two coefficients in a recursive CTE."""
    return f"""WITH RECURSIVE d AS (SELECT CAST({y} AS DOUBLE) AS y, l_quantity / 10 AS x, {more} FROM lineitem)
, f(k, a, b) AS (SELECT 0, {start}, CAST(0 AS DOUBLE) UNION ALL SELECT k + 1, s.a + (s.h11 * s.g0 - s.h01 * s.g1) / (s.h00 * s.h11 - s.h01 * s.h01), s.b + (s.h00 * s.g1 - s.h01 * s.g0) / (s.h00 * s.h11 - s.h01 * s.h01) FROM (
  SELECT k, a, b, sum({pull}) AS g0, sum(({pull}) * x) AS g1, sum(v) AS h00, sum(v * x) AS h01, sum(v * x * x) AS h11 FROM (SELECT k, a, b, d.*, {mu} AS m, {weight} AS v FROM f, d WHERE k < 20) GROUP BY k, a, b) s)
SELECT unnest(['(Intercept)', 'x']) AS term, unnest([round(a, 5) + 0.0, round(b, 5) + 0.0]) AS estimate FROM f WHERE k = 20"""


_P = "1 / (1 + exp(-(a + b * x)))"


@query("pirls_logit_2", _irls_sql(_P, f"({_P}) * (1 - {_P})", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "CAST(0 AS DOUBLE)"))
def pirls_logit(spark, sf_dir):
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    df = table(spark, sf_dir, "lineitem").select(y.alias("y"), (F.col("l_quantity") / 10).alias("x"))
    return rounded(GAM("y ~ x", family="binomial").fit(df).coefficients_df(spark).select("term", "estimate"), 5)


@query("pirls_poisson_2", _irls_sql("exp(a + b * x)", "exp(a + b * x)", "l_linenumber", "CAST(1 AS DOUBLE)"))
def pirls_poisson(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("y"), (F.col("l_quantity") / 10).alias("x"))
    return rounded(GAM("y ~ x", family="poisson").fit(df).coefficients_df(spark).select("term", "estimate"), 5)


@query("pirls_gamma_2", _irls_sql("exp(a + b * x)", "1", "l_extendedprice / 1000", "CAST(3 AS DOUBLE)", "(y - m) / m"))
def pirls_gamma(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") / 10).alias("x"))
    return rounded(GAM("y ~ x", family=Gamma(link="log")).fit(df).coefficients_df(spark).select("term", "estimate"), 5)


_WEIGHTED = _irls_sql("exp(a + b * x + l_tax)", "(1 + l_discount) * exp(a + b * x + l_tax)", "l_linenumber", "CAST(1 AS DOUBLE)", "(1 + l_discount) * (y - m)", "l_tax, l_discount")


def _weighted_poisson(spark, sf_dir, **kw):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("y"), (F.col("l_quantity") / 10).alias("x"), (1 + F.col("l_discount")).alias("w"), "l_tax")
    return rounded(GAM("y ~ x", family="poisson", **kw).fit(df, weights="w", offset="l_tax").coefficients_df(spark).select("term", "estimate"), 5)


@query("pirls_poisson_weighted_2", _WEIGHTED)
def pirls_weighted(spark, sf_dir):
    return _weighted_poisson(spark, sf_dir)


@query("pirls_poisson_weighted_2_jobs", _WEIGHTED)
def pirls_weighted_jobs(spark, sf_dir):
    return _weighted_poisson(spark, sf_dir, local=False)


@query("ols_2_jobs", ORACLES["ols_2"])
def ols_2_jobs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), "l_quantity")
    return rounded(GAM("y ~ l_quantity", local=False).fit(df).coefficients_df(spark).select("term", "estimate"), 5)


@query("statistics_poisson_2", _irls_sql("exp(a + b * x)", "exp(a + b * x)", "l_linenumber", "CAST(1 AS DOUBLE)").split("SELECT unnest")[0] + """SELECT count(*) AS n, round(2 * sum(y * ln(y / m) - (y - m)) / count(*), 5) + 0.0 AS deviance,
 round(2 * sum(y * ln(y / my)) / count(*), 5) + 0.0 AS null_deviance, round(1 - sum(y * ln(y / m) - (y - m)) / sum(y * ln(y / my)), 6) + 0.0 AS deviance_explained FROM (SELECT y, exp(a + b * x) AS m, avg(y) OVER () AS my FROM f, d WHERE k = 20)""")
def statistics_poisson(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("y"), (F.col("l_quantity") / 10).alias("x"))
    m = GAM("y ~ x", family="poisson").fit(df)
    row = (m.n_, round(m.deviance_ / m.n_, 5), round(m.null_deviance_ / m.n_, 5), round(m.deviance_explained_, 6))
    return spark.createDataFrame([row], "n long, deviance double, null_deviance double, deviance_explained double")


# Smooths of three knots: all algebra has a closed form ----------------------

_EQUAL3 = """WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 OR l_quantity < 10 THEN 10 + ((l_quantity - 10) % 30 + 30) % 30 ELSE l_quantity END AS x FROM lineitem)
, j AS (SELECT *, CASE WHEN x <= 20 THEN 0 WHEN x <= 30 THEN 1 ELSE 2 END AS j, x - CASE WHEN x <= 20 THEN 10 WHEN x <= 30 THEN 20 ELSE 30 END AS up FROM c)
, g AS (SELECT *, (j + 1) % 3 AS nxt, (up * up * up / 10 - 10 * up) / 6 AS cu, ((10 - up) * (10 - up) * (10 - up) / 10 - 10 * (10 - up)) / 6 AS cd FROM j)
SELECT l_orderkey, l_linenumber, """ + ", ".join(r(f"CASE j WHEN {i} THEN (10 - up) / 10 ELSE 0 END + CASE nxt WHEN {i} THEN up / 10 ELSE 0 END + cd * (2 - CASE j WHEN {i} THEN 6 ELSE 0 END) / 100 + cu * (2 - CASE nxt WHEN {i} THEN 6 ELSE 0 END) / 100") + f" AS b{i}" for i in range(3)) + " FROM g"


@query("basis_cc_k4", _EQUAL3)
def basis_cc(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    basis = _set_up(df.where("l_quantity BETWEEN 10 AND 40"), "l_quantity", "cc", 4)
    return rounded(_evaluated(df, KEY, ["l_quantity"], basis.eval, ["b0", "b1", "b2"]))


#: Rows with the basis b, its sums, the reflection v that takes the mean out, the centred columns u, a response y of known shape.
_K3 = _CR3.split("\nSELECT l_orderkey, l_linenumber, round(CASE")[0].replace("SELECT l_orderkey, l_linenumber, l_quantity AS x, h.*", "SELECT lineitem.*, l_quantity AS x, h.*") + """
, b AS (SELECT *, CASE j WHEN 0 THEN (k1 - x) / h0 ELSE 0 END + g / h0 / b AS b0, CASE j WHEN 0 THEN (x - k0) / h0 ELSE (k2 - x) / h1 END - g * (1 / h0 + 1 / h1) / b AS b1, CASE j WHEN 0 THEN 0 ELSE (x - k1) / h1 END + g / h1 / b AS b2,
  sin(2 * pi() * l_quantity / 50) + 0.5 * (l_discount * 10) + ((l_orderkey * 7919 + l_linenumber * 104729) % 1000) / 1000.0::DOUBLE + 0.0005 - 0.5 AS y FROM c)
, m AS (SELECT count(*) AS n, sum(b0) AS c0, sum(b1) AS c1, sum(b2) AS c2, max(abs(b0) + abs(b1) + abs(b2)) AS norm, sqrt(sum(b0 * b0) / count(*)) AS rms0, any_value(1 / h0) AS d0, any_value(-1 / h0 - 1 / h1) AS d1, any_value(1 / h1) AS d2, any_value(b) AS bb, avg(y) AS my FROM b)
, v AS (SELECT *, c0 + sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS v0 FROM m)
, w AS (SELECT *, 2 / (v0 * v0 + c1 * c1 + c2 * c2) AS tau, norm * norm / (greatest(d0, -d1, d2) * (d0 - d1 + d2) / bb) / bb AS f FROM v)
, e AS (SELECT *, d1 - tau * c1 * (d0 * v0 + d1 * c1 + d2 * c2) AS e1, d2 - tau * c2 * (d0 * v0 + d1 * c1 + d2 * c2) AS e2 FROM w)
, u AS (SELECT b.*, e.* EXCLUDE (c0), b1 - tau * c1 * (b0 * v0 + b1 * c1 + b2 * c2) AS u1, b2 - tau * c2 * (b0 * v0 + b1 * c1 + b2 * c2) AS u2 FROM b, e)"""
_SUMS3 = """
, st AS (SELECT count(*) AS n, any_value(my) AS my, sum((y - my) * (y - my)) AS yy, sum(u1 * u1) AS a11, sum(u1 * u2) AS a12, sum(u2 * u2) AS a22, sum(u1 * (y - my)) AS r1, sum(u2 * (y - my)) AS r2, any_value(f * e1 * e1) AS s11, any_value(f * e1 * e2) AS s12, any_value(f * e2 * e2) AS s22 FROM u)"""


def _solved(sp: str, source: str = "st") -> str:
    """The penalised fit at smoothing parameter sp, and what its determinants and traces need."""
    return f"""SELECT *, (p22 * r1 - p12 * r2) / det AS z1, (p11 * r2 - p12 * r1) / det AS z2, (p22 * a11 - 2 * p12 * a12 + p11 * a22) / det AS edf
  FROM (SELECT *, p11 * p22 - p12 * p12 AS det FROM (SELECT *, a11 + {sp} * s11 AS p11, a12 + {sp} * s12 AS p12, a22 + {sp} * s22 AS p22 FROM {source}))"""


_K3_SP = 50.0
_K3_FIT = f"{_K3}{_SUMS3}\n, q AS ({_solved(str(_K3_SP))})"
_K3_TERMS = "SELECT unnest(['(Intercept)', 's(l_quantity).1', 's(l_quantity).2']) AS term, unnest([round(my, {0}) + 0.0, round(z1, {0}) + 0.0, round(z2, {0}) + 0.0]) AS estimate FROM {1}"


def _grid(name: str, source: str, middle: str, step: float) -> str:
    """The smoothing parameter of least restricted likelihood among 401 around a middle."""
    lines = f"SELECT st.*, {middle} + {step} * (i - 200) AS rho FROM {source}, range(401) AS g(i)"
    lines = f"SELECT *, exp(rho) AS sp FROM ({lines})"
    score = "(n - 2) / 2.0 * ln(yy - z1 * r1 - z2 * r2) + ln(det) / 2 - rho / 2"
    return f"\n, {name} AS (SELECT arg_min(rho, {score}) AS best FROM ({_solved('sp', f'({lines})')}))"


_K3_REML = _K3 + _SUMS3 + _grid("g1", "st", "0.0", 0.1) + _grid("g2", "st, g1", "g1.best", 0.0005) + _grid("g3", "st, g2", "g2.best", 0.0000025) + f"\n, q AS ({_solved('exp(best)', '(SELECT * FROM st, g3)')})"


def _k3(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    u = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(1000)) / 1000 + 0.0005
    y = F.sin(2 * math.pi * F.col("l_quantity") / 50) + 0.5 * (F.col("l_discount") * 10) + u - 0.5
    return df.select(*KEY, "l_quantity", "l_discount", "l_returnflag", y.alias("y"))


def _matrix(spark, sf_dir, formula: str, names: list[str], first: int, sp: list[float]) -> DataFrame:
    """Columns of a model's matrix from the first on."""
    df = _k3(spark, sf_dir)
    out = GAM(formula, sp=sp).fit(df).predict_matrix(df.drop("y"))
    return rounded(out.select(*KEY, *[F.get("lpmatrix", F.lit(first + i)).alias(n) for i, n in enumerate(names)]), 5)


@query("lpmatrix_cr_k3", f"{_K3}\nSELECT l_orderkey, l_linenumber, {r('u1', 5)} AS u1, {r('u2', 5)} AS u2 FROM u")
def lpmatrix_cr(spark, sf_dir):
    return _matrix(spark, sf_dir, "y ~ s(l_quantity, k=3, bs='cr')", ["u1", "u2"], 1, [1.0])


@query("numeric_by_cr_k3", f"{_K3}\nSELECT l_orderkey, l_linenumber, {r('l_discount * b0', 5)} AS b0, {r('l_discount * b1', 5)} AS b1, {r('l_discount * b2', 5)} AS b2 FROM b")
def numeric_by(spark, sf_dir):
    return _matrix(spark, sf_dir, "y ~ s(l_quantity, by=l_discount, k=3, bs='cr')", ["b0", "b1", "b2"], 1, [1.0])


@query("factor_by_cr_k3", f"{_K3}\nSELECT l_orderkey, l_linenumber, " + ", ".join(r(f"CASE WHEN l_returnflag = '{lv}' THEN u{j} ELSE 0 END", 5) + f" AS {lv.lower()}{j}" for lv in "ANR" for j in (1, 2)) + " FROM u")
def factor_by(spark, sf_dir):
    return _matrix(spark, sf_dir, "y ~ l_returnflag + s(l_quantity, by=l_returnflag, k=3, bs='cr')", [f"{lv}{j}" for lv in "anr" for j in (1, 2)], 3, [1.0] * 3)


@query("basis_sums_cr_k3", f"{_K3}\nSELECT n, {r('c0 / n')} AS mean0, {r('c1 / n')} AS mean1, {r('c2 / n')} AS mean2, {r('rms0')} AS rms0, {r('norm')} AS max_row_abs_sum FROM m")
def basis_sums(spark, sf_dir):
    facts = Facts(table(spark, sf_dir, "lineitem").select("l_quantity"), ["l_quantity"])
    basis = make_basis(SmoothSpec("s", ("l_quantity",), "cr", 3))
    basis.setup(facts)
    s = facts.basis_sums(basis)
    row = (int(s["n"]), *[float(x / s["n"]) for x in s["sums"]], float(np.sqrt(s["squares"][0] / s["n"])), s["norm"])
    return rounded(spark.createDataFrame([row], "n long, mean0 double, mean1 double, mean2 double, rms0 double, max_row_abs_sum double"))


def _k3_model(spark, sf_dir, **kw) -> GAM:
    return GAM("y ~ s(l_quantity, k=3, bs='cr')", **kw).fit(_k3(spark, sf_dir))


def _k3_terms(name: str, sql: str, digits: int, **kw) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return rounded(_k3_model(spark, sf_dir, **kw).coefficients_df(spark).select("term", "estimate"), digits)


for _suffix, _local in (("", True), ("_jobs", False)):
    _k3_terms(f"fit_gaussian_cr_fixed_sp{_suffix}", f"{_K3_FIT}\n{_K3_TERMS.format(5, 'q')}", 5, sp=[_K3_SP], local=_local)
    _k3_terms(f"fit_reml_gaussian_cr_k3{_suffix}", f"{_K3_REML}\n{_K3_TERMS.format(4, 'q')}", 4, local=_local)


def _edf_row(m, spark) -> DataFrame:
    row = (m.n_, round(m.edf_total_, 4), round(float(m.edf_[0]), 4), round(m.scale_, 5), round(m.deviance_explained_, 5))
    return spark.createDataFrame([row], "n long, edf_total double, edf double, scale double, deviance_explained double")


_K3_EDF = "SELECT n, round(1 + edf, 4) + 0.0 AS edf_total, round(edf, 4) + 0.0 AS edf, round(rss / (n - 1 - edf), 5) + 0.0 AS scale, round(1 - rss / yy, 5) + 0.0 AS deviance_explained FROM (SELECT *, yy - 2 * (z1 * r1 + z2 * r2) + z1 * z1 * a11 + 2 * z1 * z2 * a12 + z2 * z2 * a22 AS rss FROM q)"


@query("statistics_fixed_sp_k3", f"{_K3_FIT}\n{_K3_EDF}")
def statistics_fixed(spark, sf_dir):
    return _edf_row(_k3_model(spark, sf_dir, sp=[_K3_SP]), spark)


@query("statistics_reml_k3", f"{_K3_REML}\n{_K3_EDF}")
def statistics_reml(spark, sf_dir):
    return _edf_row(_k3_model(spark, sf_dir), spark)


@query("predict_fixed_sp_k3", f"""{_K3_FIT}
, s AS (SELECT *, (yy - 2 * (z1 * r1 + z2 * r2) + z1 * z1 * a11 + 2 * z1 * z2 * a12 + z2 * z2 * a22) / (n - 1 - edf) AS scale FROM q)
SELECT l_orderkey, l_linenumber, {r('s.my + u1 * z1 + u2 * z2', 4)} AS fit, {r('sqrt(scale * (1.0 / s.n + (u1 * u1 * p22 - 2 * u1 * u2 * p12 + u2 * u2 * p11) / det))', 5)} AS se_fit FROM u, s""")
def predict_fixed(spark, sf_dir):
    df = _k3(spark, sf_dir)
    out = GAM("y ~ s(l_quantity, k=3, bs='cr')", sp=[_K3_SP]).fit(df).predict(df, se_fit=True)
    return out.select(*KEY, (F.round("fit", 4) + 0.0).alias("fit"), (F.round("se_fit", 5) + 0.0).alias("se_fit"))


# Smooth models -------------------------------------------------------------


def _lines(spark, sf_dir) -> DataFrame:
    """lineitem with covariates x1 (50 values), x2 (11), a factor, and a response of each family with known shape."""
    df = table(spark, sf_dir, "lineitem").select(*KEY, (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), (F.col("l_extendedprice") / 105000).alias("z"), F.col("l_returnflag").alias("fac"), "l_tax")
    u = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(1000)) / 1000 + 0.0005
    df = df.withColumn("u", u).withColumn("eta", F.sin(2 * math.pi * F.col("x1")) + 0.5 * F.col("x2"))
    rate = F.exp(0.5 * F.col("eta") + 0.5)
    return df.select(
        *KEY, "x1", "x2", "z", "fac",
        (F.col("eta") + (F.col("u") - 0.5)).alias("y_gaussian"),
        F.when(F.col("u") < 1 / (1 + F.exp(-F.col("eta"))), 1.0).otherwise(0.0).alias("y_binomial"),
        (F.floor(rate) + F.when(F.col("u") < rate - F.floor(rate), 1.0).otherwise(0.0)).alias("y_poisson"),
        (F.exp(0.3 * F.col("eta") + 1) * (0.25 + 1.5 * F.col("u"))).alias("y_gamma"),
    )


SMOOTHS = {
    "tp": "s(x1, k=10, bs='tp')", "cr": "s(x1, k=10, bs='cr')", "te": "te(x1, x2, k=5)", "ti": "ti(x1, x2, k=5)",
    "tp_by": "s(x1, by=fac, k=10, bs='tp') + fac", "cr_by": "s(x1, by=fac, k=10, bs='cr') + fac", "te_by": "te(x1, x2, by=fac, k=5) + fac",
    "cs": "s(x1, k=8, bs='cs')", "cc": "s(x1, k=8, bs='cc')", "ts": "s(x1, k=8, bs='ts')", "numeric_by": "s(x1, by=x2, k=8, bs='cr')", "side": "s(x1, bs='cr', k=6) + s(x2, bs='cr', k=6) + te(x1, x2, k=4)",
}


def _fit(family: str, key: str):
    def run(spark, sf_dir):
        df = _lines(spark, sf_dir).select("x1", "x2", "fac", f"y_{family}")
        return GAM(f"y_{family} ~ {SMOOTHS[key]}", family=family).fit(df).coefficients_df(spark)

    query(f"fit_{family}_{key}")(run)


for _family in _DATA:
    for _key in ("tp", "cr", "te", "ti", "tp_by", "cr_by", "te_by"):
        _fit(_family, _key)
for _key in ("cs", "cc", "ts", "numeric_by", "side"):
    _fit("gaussian", _key)


@query("fit_ml_cr")
def fit_ml(spark, sf_dir):
    return GAM("y_poisson ~ s(x1, k=10, bs='cr')", family="poisson", method="ML").fit(_lines(spark, sf_dir)).coefficients_df(spark)


@query("fit_fixed_sp")
def fit_fixed(spark, sf_dir):
    return GAM("y_gaussian ~ s(x1, k=4, bs='cr')", sp=[1.0]).fit(_lines(spark, sf_dir)).coefficients_df(spark)


@query("fit_continuous_cr")
def fit_continuous(spark, sf_dir):
    return GAM("y_gaussian ~ s(z, k=10, bs='cr') + fac").fit(_lines(spark, sf_dir)).coefficients_df(spark)


@query("fit_distributed_cr")
def fit_distributed(spark, sf_dir):
    return GAM("y_poisson ~ s(z, k=10, bs='cr')", family="poisson", local=False).fit(_lines(spark, sf_dir)).coefficients_df(spark)


def _model(spark, sf_dir):
    return GAM("y_gaussian ~ s(x1, k=8, bs='cr') + te(x1, x2, k=4) + fac").fit(_lines(spark, sf_dir))


@query("predict_smooth")
def predict_smooth(spark, sf_dir):
    df = _lines(spark, sf_dir).select(*KEY, "x1", "x2", "fac", "y_gaussian")
    return GAM("y_gaussian ~ s(x1, k=8, bs='cr') + fac").fit(df).predict(df, se_fit=True)


@query("summary_smooth")
def summary_smooth(spark, sf_dir):
    return _model(spark, sf_dir).summary(show=False).s_table_df(spark)


@query("partial_effects")
def partial_effects(spark, sf_dir):
    return _model(spark, sf_dir).partial_effects(spark)


@query("flagship")
def flagship(spark, sf_dir):
    """l_extendedprice by a cubic smooth of l_quantity and l_returnflag, predicted for every line."""
    df = table(spark, sf_dir, "lineitem").select(*KEY, "l_extendedprice", "l_quantity", "l_returnflag")
    return GAM("l_extendedprice ~ s(l_quantity, k=10, bs='cr') + l_returnflag").fit(df).predict(df.drop("l_extendedprice"), se_fit=True)


@query("gamma_hourly")
def gamma_hourly(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("value", F.hour("ts").cast("double").alias("hour"), "event_type")
    return GAM("value ~ s(hour, k=8, bs='cc') + event_type", family=Gamma(link="log")).fit(df).coefficients_df(spark)


@query("binomial_quality")
def binomial_quality(spark, sf_dir):
    """Joins come before the fit: labelled documents, broadcast or shuffled as Catalyst sees fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("size"), "lang")
    df = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return GAM("quality ~ s(size, k=5, bs='cr') + lang", family="binomial").fit(df).coefficients_df(spark)
