"""Generalized additive models over DataFrames of any length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.families import Binomial, Gamma, Gaussian, Poisson, get_family
from .operators import effects, inference
from .operators.passes import columns_of, fold
from .operators.solve import ROW, GramEngine, LocalEngine, Problem, SparkEngine, criterion, factor, pirls, search
from .plans.formula import parse_formula
from .plans.penalties import EPS, eigen_rank, initial_log_sp
from .plans.setup import Setup, check_columns, check_quality

#: Bytes of rows, and of model matrix, up to which a fit keeps them on the driver.
LOCAL_ROW_BYTES, LOCAL_MATRIX_BYTES = 64 << 20, 512 << 20
#: Distinct covariate rows over rows, below which rows are compressed.
COMPRESS = 0.2


class GAM:
    """`GAM("y ~ s(x, bs='cr') + fac", family="poisson").fit(df)`.

    weights and offset of `fit` are column names or Columns. `factors` gives levels of
    string columns, or says that they are ordered. `unseen="error"` makes predictions
    fail on levels that the fit has not seen; by default they count as none of the levels.
    `local=False` runs every pass as a Spark job, however few the rows are.
    """

    def __init__(self, formula: str, family="gaussian", method: str = "REML", sp=None, factors: dict | None = None, unseen: str = "zero", local: bool = True, **kwargs):
        self.formula, self.spec = formula, parse_formula(formula)
        self.family_ = get_family(family)
        if not isinstance(method, str) or method.upper() not in ("REML", "ML"):
            raise ValueError(f"method must be 'REML' or 'ML', not {method!r}")
        for name, plain in (("backend", "spark"), ("optimizer", "newton"), ("select", False), ("gamma", 1), ("knots", None)):
            if name in kwargs and kwargs.pop(name) not in (plain, float(plain) if isinstance(plain, int) else plain):
                raise NotImplementedError(f"{name} is fixed to {plain!r}")
        if kwargs:
            raise TypeError(f"Unknown options: {', '.join(kwargs)}")
        if unseen not in ("zero", "error"):
            raise ValueError("unseen must be 'zero' or 'error'")
        self.method, self.sp, self.factors, self.unseen, self.local = method.upper(), sp, factors, unseen, local
        self._fitted = False

    def _check(self) -> None:
        if not self._fitted:
            raise RuntimeError("This model is not fitted: call fit() first")

    # fitting ---------------------------------------------------------------

    def _rows(self, df: DataFrame, weights, offset) -> DataFrame:
        """The formula's columns, as doubles or strings, with __w, __off and __resp; nothing else is read."""

        def number(x, default):
            x = F.lit(default) if x is None else F.col(f"`{x}`") if isinstance(x, str) else x
            return x.cast("double")

        keep = [F.col(f"`{v}`") if dict(df.dtypes)[v] == "string" else F.col(f"`{v}`").cast("double").alias(v) for v in self.spec.variables()]
        return df.select(F.col(f"`{self.spec.response}`").cast("double").alias("__resp"), number(weights, 1.0).alias("__w"), number(offset, 0.0).alias("__off"), *keep)

    def _compressed(self, rows: DataFrame) -> DataFrame:
        """One row per distinct covariates and offset: exact for these families, whose likelihood sees their mean."""
        y, w, fam = F.col("__resp"), F.col("__w"), self.family_
        c = 0.5 if isinstance(fam, Binomial) else 1.0
        out = rows.groupBy(*self.spec.variables(), "__off").agg(
            F.count(F.lit(1)).cast("double").alias("__n"), F.sum("__w").alias("__ws"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"), F.sum(y).alias("__sy"), F.sum(w * fam.unit_deviance(y, F.lit(c))).alias("dc")
        )
        mean = F.when(F.col("__ws") > 0, F.col("wy") / F.col("__ws")).otherwise(F.col("__sy") / F.col("__n"))
        out = out.withColumn("__y", mean).withColumn("__ss", F.greatest(F.col("wyy") - F.col("__ws") * F.col("__y") * F.col("__y"), F.lit(0.0)))
        out = out.withColumn("__d0", F.greatest(F.col("dc") - F.col("__ws") * fam.unit_deviance(F.col("__y"), F.lit(c)), F.lit(0.0)))
        return out.withColumnRenamed("__ws", "__w").drop("wy", "wyy", "dc")

    @staticmethod
    def _plain(rows: DataFrame) -> DataFrame:
        y = F.col("__resp")
        return rows.select("*", y.alias("__y"), y.alias("__sy"), F.lit(1.0).alias("__n"), F.lit(0.0).alias("__ss"), F.lit(0.0).alias("__d0")).drop("__resp")

    def _engine(self, rows: DataFrame, setup: Setup, n: int):
        """Where passes run: on the driver if the (perhaps compressed) rows are proven few, else as jobs."""
        variables, fam = self.spec.variables(), self.family_
        width = 8 * (len(variables) + len(ROW))
        exact = type(fam) in (Gaussian, Binomial, Poisson, Gamma)
        distinct = self._sums["distinct"]
        compress = exact and distinct <= COMPRESS * n
        table = self._compressed(rows) if compress else self._plain(rows)
        size = min(distinct * 1.2, n) if compress else n
        if self.local and size * width <= LOCAL_ROW_BYTES and size * setup.p * 8 <= LOCAL_MATRIX_BYTES:
            # Rows that stand for themselves need no sums beside their response.
            found = (table if compress else rows).toArrow().combine_chunks().to_batches()
            cols = columns_of(found[0])
            if not compress:
                y = cols["__resp"]
                cols |= {"__y": y, "__sy": y, "__n": np.ones(len(y)), "__ss": np.zeros(len(y)), "__d0": np.zeros(len(y))}
            row = {k: np.asarray(cols[f"__{k}"], float) for k in ROW}
            self.execution_path_ = "compressed" if compress else "local"
            return LocalEngine(setup.eval(cols) if variables else np.ones((len(row["y"]), setup.p)), row, fam)
        self.execution_path_ = "spark"
        return SparkEngine(table.persist(), setup, fam)

    def fit(self, data: DataFrame, weights: str | Column | None = None, offset: str | Column | None = None) -> "GAM":
        check_columns(self.spec, data)
        rows = self._rows(data, weights, offset).persist()
        try:
            named = rows.withColumnRenamed("__resp", self.spec.response) if self.spec.response not in rows.columns else rows.drop(self.spec.response).withColumnRenamed("__resp", self.spec.response)
            self.n_ = check_quality(named, self.spec.response, [*self.spec.variables(), "__w", "__off"])
            self._saturated(rows, weights is None)
            self.setup_ = setup = Setup(self.spec, rows.select(*self.spec.variables()), self.factors, self.n_)
            if setup.p > self.n_:
                raise ValueError(f"The model has {setup.p} coefficients and only {self.n_} observations")
            engine = self._engine(rows, setup, self.n_)
            try:
                self._optimise(engine)
                self._finish(rows, engine)
            finally:
                if isinstance(engine, SparkEngine):
                    engine.df.unpersist()
        finally:
            rows.unpersist()
        self._data, self._offset, self._weights = data, offset, weights
        self._fitted = True
        return self

    def _saturated(self, rows: DataFrame, plain: bool) -> None:
        """Sums of the saturated likelihood, null deviance and weighted moments of the response. plain: all weights are 1."""
        y, w, fam = F.col("__resp"), F.col("__w"), self.family_
        on = w > 0
        aggs = {"n_positive": F.count_if(on), "log_w": F.sum(F.when(on, F.log(w)).otherwise(0.0)), "w": F.sum(w), "wy": F.sum(w * y), "wyy": F.sum(w * y * y)}
        if isinstance(fam, Gamma):
            aggs["log_y"] = F.sum(F.when(on, F.log(F.greatest(y, F.lit(1e-10)))).otherwise(0.0))
        elif not isinstance(fam, Gaussian):
            aggs["saturated"] = F.sum(fam.saturated(y, w, 1.0))
        aggs |= {"negative": F.count_if(w < 0), "distinct": F.approx_count_distinct(F.xxhash64(*self.spec.variables(), "__off"))}
        sums = rows.agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict()
        if sums["negative"]:
            raise ValueError("Weights must not be negative")
        if isinstance(fam, Gamma):
            found = [{"__w": 1.0, "count": sums["n_positive"]}] if plain else rows.where("__w > 0").groupBy("__w").count().limit(100_001).collect()
            if len(found) > 100_000:
                raise NotImplementedError("Gamma models take at most 100,000 distinct weights")
            sums["weights"] = np.array([r["__w"] for r in found]), np.array([r["count"] for r in found], float)
        self._sums = sums
        mean = sums["wy"] / sums["w"]
        dev, v = rows.agg(F.sum(w * fam.unit_deviance(y, F.lit(mean))), F.var_samp(F.sqrt(w) * (y - mean))).first()
        self.null_deviance_, self._null_var = float(dev), v

    def _optimise(self, engine) -> None:
        setup, fam = self.setup_, self.family_
        g, rhs, diag = engine.start()
        self._xx = g
        d = self._coordinates()
        if fam.family_name == "gaussian" and fam.link.name == "identity":
            engine = GramEngine(engine, setup.p, self._y_square(engine), self.n_, (g, rhs, diag))
        engine = _Turned(engine, d)
        pens = [d.T @ s @ d for s in setup.penalties]
        blocks = []
        for b in setup.blocks:
            at = slice(b.start, b.start + len(b.matrices[0]))
            mats = [pens[i][at, at] for i in b.indices]
            if len(mats) == 1:
                val = np.linalg.eigvalsh(mats[0])
                val = val[val > val.max() * EPS ** (2 / 3)]
                blocks.append((b.indices, (len(val), float(np.log(val).sum()))))
            else:
                val, vec = np.linalg.eigh(sum(m / np.linalg.norm(m) for m in mats))
                u = vec[:, val > val.max() * EPS ** (2 / 3)]
                blocks.append((b.indices, [u.T @ m @ u for m in mats]))
        problem = Problem(pens, blocks, setup.null_dim, fam, self._sums, self.n_, self.method == "REML")
        beta = np.linalg.lstsq(d.T @ g @ d, d.T @ rhs, rcond=1e-12)[0]
        if setup.spec.has_intercept and not isinstance(engine, GramEngine):
            # Where least squares on the link scale starts worse than a constant, start there.
            flat = np.zeros(setup.p)
            flat[0] = float(fam.link.link(np.array([self._sums["wy"] / self._sums["w"]]))[0])
            if not engine.sums(beta)[2] <= engine.sums(flat)[2]:
                beta = flat
        m = setup.n_penalties
        if self.sp is not None:
            sp = np.asarray(self.sp, float)
            if len(sp) != m:
                raise ValueError(f"The model has {m} smoothing parameters, sp has {len(sp)}")
            rho = np.log(sp)
            inner = pirls(engine, beta, problem.s(rho) if m else np.zeros((setup.p, setup.p)))
            self.converged_, self.n_iter_, self.score_, self.message_ = inner.converged, 0, None, "fixed smoothing parameters"
        elif m == 0:
            rho = np.zeros(0)
            inner = pirls(engine, beta, np.zeros((setup.p, setup.p)))
            self.converged_, self.n_iter_, self.message_ = inner.converged, 0, "no smooth terms"
            self.score_ = None
        else:
            rho = np.clip(initial_log_sp(diag, setup.penalties), -30, 30)
            log_phi = None
            if not fam.scale_known:
                first = pirls(engine, beta, problem.s(rho))
                log_phi = float(np.log(max(first.deviance, 1e-12) / max(self.n_ - setup.null_dim, 1)))
                beta = first.beta
            out = search(problem, engine, beta, rho, log_phi)
            rho, inner = out.rho, out.inner
            self.converged_, self.n_iter_, self.score_, self.message_ = out.converged, out.n_iter, out.score, out.message
        s = problem.s(rho) if m else np.zeros((setup.p, setup.p))
        h_inv, _ = factor(inner.xwx + s)
        f = h_inv @ inner.xwx
        self.coefficients_ = d @ inner.beta
        to = np.linalg.inv(d)
        self._f = d @ f @ to
        self._h_inv = d @ h_inv @ d.T
        self._xwx = to.T @ inner.xwx @ to
        self.edf_total_ = float(np.trace(f))
        rdf = self.n_ - self.edf_total_
        if fam.scale_known:
            self.scale_ = 1.0
        else:
            mean_skew = inner.skew / self.n_
            self.scale_ = float(inner.pearson / rdf / (1 + max(-0.9, mean_skew))) if rdf > 0 else float("nan")
        if m == 0 and self.sp is None:
            self.score_ = criterion(problem, rho, None, inner, self.scale_)
        self.Vp_, self.Ve_ = self._h_inv * self.scale_, None
        self.smoothing_params_ = np.exp(rho)
        self.deviance_ = float(inner.deviance)
        diag1 = 2 * np.diag(self._f) - np.einsum("ij,ji->i", self._f, self._f)
        at = [setup.term_slice(i) for i in range(len(setup.terms))]
        self.edf_ = np.array([np.trace(self._f[a, a]) for a in at])
        self.edf1_ = np.array([min(diag1[a].sum(), setup.terms[i].size) for i, a in enumerate(at)])
        self.lambda_strategy_ = "fixed" if self.sp is not None else self.method

    def _y_square(self, engine) -> float:
        """Weighted squares of y minus the offset's part, as the Gram's z is y - offset."""
        if isinstance(engine, LocalEngine):
            r = engine.rows
            return float((r["w"] * (r["y"] - r["off"]) ** 2 + r["ss"]).sum())
        z = F.col("__y") - F.col("__off")
        return float(engine.df.agg(F.sum(F.col("__w") * z * z + F.col("__ss"))).first()[0])

    def _coordinates(self) -> np.ndarray:
        """Basis of the coefficients in which each penalty block is diagonal; a single penalty becomes an identity."""
        d = np.eye(self.setup_.p)
        for b in self.setup_.blocks:
            at = slice(b.start, b.start + len(b.matrices[0]))
            size = slice(0, len(b.matrices[0]))
            val, vec = np.linalg.eigh(sum(m / np.linalg.norm(m) for m in b.matrices))
            scale = np.where(val > val.max() * EPS ** (2 / 3), 1 / np.sqrt(np.maximum(val, 1e-300)), 1.0) if len(b.matrices) == 1 else np.ones(len(val))
            if not np.allclose(d[at, at], np.eye(len(val))):
                continue
            d[at, at] = (vec * scale)[size, size]
        return d

    def _finish(self, rows: DataFrame, engine) -> None:
        """Residual variance for R squared, over the rows themselves."""
        setup, fam, beta = self.setup_, self.family_, self.coefficients_

        def moments(x, w, y, off):
            r = np.sqrt(w) * (y - fam.link.inverse(x @ beta + off))
            return [float(len(r)), r.sum(), (r * r).sum()]

        def step(cols):
            x = setup.eval(cols) if len(cols) > 3 else np.ones((len(cols["__w"]), setup.p))
            return moments(x, cols["__w"], cols["__resp"], cols["__off"])

        if self.execution_path_ == "local":
            found = moments(engine.x, engine.rows["w"], engine.rows["y"], engine.rows["off"])
        else:
            found = fold(rows, step)
        n, s, q = (float(v) for v in found)
        self._resid_var = (q - s * s / n) / (n - 1)
        rdf = self.n_ - self.edf_total_
        self.r_squared_ = None if rdf <= 0 or n <= 1 or not self._null_var else 1 - self._resid_var * (n - 1) / (self._null_var * rdf)
        self.deviance_explained_ = (self.null_deviance_ - self.deviance_) / self.null_deviance_ if self.null_deviance_ else 0.0

    # attributes ------------------------------------------------------------

    @property
    def term_names_(self) -> list[str]:
        return self.setup_.names

    @property
    def fitted_values_(self) -> DataFrame:
        return self.predict()

    @property
    def linear_predictor_(self) -> DataFrame:
        return self.predict(pred_type="link")

    def coefficients_df(self, spark) -> DataFrame:
        """(term, estimate, se), one row a coefficient."""
        self._check()
        rows = [(n, float(b), float(s)) for n, b, s in zip(self.setup_.names, self.coefficients_, np.sqrt(np.maximum(np.diag(self.Vp_), 0)))]
        return spark.createDataFrame(rows, "term string, estimate double, se double")

    # The training rows are a table of any length, so what belongs to them is a DataFrame.

    @property
    def X_(self) -> DataFrame:
        """The training rows with their rows of the model matrix in `lpmatrix`."""
        return self.predict_matrix(self._data)

    @property
    def y_(self) -> DataFrame:
        return self._training("__resp", "y")

    @property
    def weights_(self) -> DataFrame:
        return self._training("__w", "w")

    @property
    def offset_(self) -> DataFrame:
        return self._training("__off", "offset")

    def _training(self, name: str, alias: str) -> DataFrame:
        self._check()
        return self._rows(self._data, self._weights, self._offset).select(F.col(name).alias(alias))

    @property
    def coef_map_(self):
        """Between raw and constrained coefficients, matrices and penalties."""
        self._check()
        return self.setup_.coef_map()

    @property
    def smooth_info_(self) -> list[dict]:
        """Each smooth's label, place among the coefficients, penalties, null space and degrees of freedom."""
        self._check()
        out = []
        for i, t in enumerate(self.setup_.terms):
            at = self.setup_.term_slice(i)
            out.append({"label": t.label, "variables": t.spec.variables, "by": t.spec.by, "bs": t.spec.bs, "first_coef": at.start, "last_coef": at.stop, "n_coefs": t.size, "ranks": list(t.basis.ranks), "null_dim": t.basis.null_dim, "n_penalties": len(t.penalties()), "edf": float(self.edf_[i])})
        return out

    def create_views(self, spark, prefix: str = "gam") -> list[str]:
        """Temporary views <prefix>_terms, _coefficients, _summary_parametric and _summary_smooth for SQL; returns their names."""
        self._check()
        found = self.summary(show=False)
        info = [(s["label"], ",".join(s["variables"]), s["by"], s["bs"], s["first_coef"], s["n_coefs"], s["null_dim"], s["edf"]) for s in self.smooth_info_]
        tables = {
            "terms": spark.createDataFrame(info, "term string, variables string, by string, bs string, first_coef int, n_coefs int, null_dim int, edf double"),
            "coefficients": self.coefficients_df(spark), "summary_parametric": found.p_table_df(spark), "summary_smooth": found.s_table_df(spark),
        }
        for name, df in tables.items():
            df.createOrReplaceTempView(f"{prefix}_{name}")
        return [f"{prefix}_{name}" for name in tables]

    def rug(self, select: int = 0) -> DataFrame:
        """The training rows' values that a smooth sees, (term, level, x[, x2]): a projection, of any length."""
        self._check()
        if not 0 <= select < len(self.setup_.terms):
            raise ValueError(f"select must lie in 0..{len(self.setup_.terms) - 1}")
        t = self.setup_.terms[select]
        level = F.col(f"`{t.spec.by}`").cast("string") if t.levels is not None else F.lit(None).cast("string")
        xs = [F.col(f"`{v}`").cast("double").alias("x" if not k else f"x{k + 1}") for k, v in enumerate(t.spec.variables)]
        return self._data.select(F.lit(t.label).alias("term"), level.alias("level"), *xs)

    # queries ---------------------------------------------------------------

    def predict(self, newdata: DataFrame | None = None, pred_type: str = "response", se_fit: bool = False, offset: str | Column | None = None) -> DataFrame:
        """newdata with a column `fit`, and `se_fit` (on the link scale) if asked; a narrow map, streams too."""
        self._check()
        if pred_type not in ("response", "link"):
            raise ValueError(f"pred_type must be 'response' or 'link', not {pred_type!r}")
        setup, fam, beta, vp = self.setup_, self.family_, self.coefficients_, self.Vp_
        if newdata is None:
            newdata, offset = self._data, self._offset
        x, extra = self._model_rows(newdata, offset)

        def run(batches):
            for batch in batches:
                cols = columns_of(batch.select([*names, "__off"]))
                m = setup.eval(cols) if names else np.ones((batch.num_rows, setup.p))
                eta = m @ beta + cols["__off"]
                new = [pa.array(np.asarray(fam.link.inverse(eta) if pred_type == "response" else eta, float))]
                if se_fit:
                    new.append(pa.array(np.sqrt(np.maximum(((m @ vp) * m).sum(1), 0))))
                keep = batch.select(kept)
                yield pa.RecordBatch.from_arrays([*keep.columns, *new], names=[*kept, *extra_names])

        names, kept = [f"__v_{v}" for v in self.spec.variables()], newdata.columns
        setup = _Renamed(setup, self.spec.variables())
        extra_names = ["fit", "se_fit"] if se_fit else ["fit"]
        if set(extra_names) & set(kept):
            raise ValueError("newdata already has a column fit or se_fit")
        schema = newdata.schema
        for name in extra_names:
            schema = schema.__class__([*schema.fields]).add(name, "double")
        return x.mapInArrow(run, schema)

    def _model_rows(self, newdata: DataFrame, offset) -> tuple[DataFrame, list[str]]:
        check = parse_formula(self.formula)
        missing = [v for v in check.variables() if v not in newdata.columns]
        if missing:
            raise ValueError(f"newdata lacks {', '.join(missing)}. Available: {', '.join(newdata.columns)}")
        off = F.lit(0.0) if offset is None else F.col(f"`{offset}`") if isinstance(offset, str) else offset
        extra = []
        for v in check.variables():
            c = F.col(f"`{v}`")
            if v in self.setup_.factor_names:
                if self.unseen == "error":
                    known = F.array(*[F.lit(lv) for lv in self.setup_.levels[v]])
                    c = F.when(F.array_contains(known, c), c).otherwise(F.raise_error(F.concat(F.lit(f"Unseen level of {v}: "), c)))
                extra.append(c.cast("string").alias(f"__v_{v}"))
            else:
                extra.append(c.cast("double").alias(f"__v_{v}"))
        return newdata.select("*", *extra, off.cast("double").alias("__off")), [f"__v_{v}" for v in check.variables()]

    def predict_matrix(self, newdata: DataFrame) -> DataFrame:
        """newdata with a column `lpmatrix array<double>`: its rows of the model matrix."""
        self._check()
        x, names = self._model_rows(newdata, None)
        setup, kept = _Renamed(self.setup_, self.spec.variables()), newdata.columns

        def run(batches):
            for batch in batches:
                m = setup.eval(columns_of(batch.select(names))) if names else np.ones((batch.num_rows, setup.p))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, flat], names=[*kept, "lpmatrix"])

        return x.mapInArrow(run, newdata.schema.__class__([*newdata.schema.fields]).add("lpmatrix", T.ArrayType(T.DoubleType())))

    def summary(self, show: bool = True):
        self._check()
        found = inference.summarise(self)
        if show:
            print(found)
        return found

    def partial_effects(self, spark, select: int | None = None, n_grid: int = 200, n2: int = 40, se_mult: float = 2.0) -> DataFrame:
        self._check()
        return effects.partial_effects(self, spark, select, n_grid, n2, se_mult)

    def plot(self, spark, **kwargs):
        """The data behind the plots, and a figure too if matplotlib can be imported."""
        self._check()
        return effects.plot(self, spark, **kwargs)


class _Renamed:
    """A setup that reads its variables from columns named __v_<variable>."""

    def __init__(self, setup: Setup, variables: list[str]):
        self.setup, self.variables, self.p = setup, variables, setup.p

    def eval(self, cols: dict) -> np.ndarray:
        return self.setup.eval({v: cols[f"__v_{v}"] for v in self.variables})


class _Turned:
    """An engine seen in coefficients b with beta = D b: cross-products turn, rows don't."""

    def __new__(cls, engine, d):
        if isinstance(engine, GramEngine):
            engine.a, engine.b = d.T @ engine.a @ d, d.T @ engine.b
            return engine
        self = super().__new__(cls)
        self.engine, self.d = engine, d
        return self

    def sums(self, beta):
        a, b, *rest = self.engine.sums(self.d @ beta)
        return [self.d.T @ a @ self.d, self.d.T @ b, *rest]

    def slopes(self, beta, slopes, h_inv):
        d = self.d
        t, q, curve = self.engine.slopes(d @ beta, d @ slopes, d @ h_inv @ d.T)
        return [np.einsum("ia,jik,kb->jab", d, t, d, optimize=True), d.T @ q, curve]
