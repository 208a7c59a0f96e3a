"""Partial effects of smooth terms on grids: DataFrames made from `range` and a narrow map."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passes import columns_of

SCHEMA = "term string, level string, x double, x2 double, fit double, se double, lower double, upper double"


def partial_effects(model, spark, select: int | None, n_grid: int, n2: int, se_mult: float) -> DataFrame:
    """(term, level, x, x2, fit, se, lower, upper): 1-D terms on n_grid points, 2-D ones on n2 x n2; by numbers are 1."""
    setup = model.setup_
    if n_grid < 2 or n2 < 2:
        raise ValueError("n_grid and n2 must be at least 2")
    if se_mult < 0:
        raise ValueError("se_mult must not be negative")
    if not setup.terms:
        raise ValueError("The model has no smooth terms")
    if select is not None and not 0 <= select < len(setup.terms):
        raise ValueError(f"select must lie in 0..{len(setup.terms) - 1}")
    out = None
    for i, term in enumerate(setup.terms):
        if select is not None and i != select:
            continue
        if len(term.spec.variables) > 2:
            warnings.warn(f"{term.label} has more than two variables: no grid", stacklevel=2)
            continue
        part = _grid(model, spark, i, n_grid if len(term.spec.variables) == 1 else n2, se_mult)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _axis(setup, v: str, n: int, name: str, spark) -> DataFrame:
    lo, hi = setup.ranges[v]
    return spark.range(n).select((F.lit(float(lo)) + F.col("id") * ((hi - lo) / (n - 1))).alias(name))


def _grid(model, spark, i: int, n: int, se_mult: float) -> DataFrame:
    setup = model.setup_
    term, at = setup.terms[i], setup.term_slice(i)
    vs = term.spec.variables
    grid = _axis(setup, vs[0], n, "x", spark)
    # Grids are products of axes: n x n2 points and the levels, sizes that the caller sets.
    grid = grid.crossJoin(_axis(setup, vs[1], n, "x2", spark)) if len(vs) == 2 else grid.withColumn("x2", F.lit(None).cast("double"))
    if term.levels is not None:
        grid = grid.crossJoin(spark.createDataFrame([(lv,) for lv in term.levels], "level string"))
    else:
        grid = grid.withColumn("level", F.lit(None).cast("string"))
    beta, v = model.coefficients_[at], model.Vp_[at, at]
    label, by, numeric = term.label, term.spec.by, term.numeric_by

    def run(batches):
        for batch in batches:
            cols = columns_of(batch)
            values = {vs[0]: cols["x"]} | ({vs[1]: cols["x2"]} if len(vs) == 2 else {})
            if by:
                values[by] = np.ones(batch.num_rows) if numeric else cols["level"]
            x = term.eval(values)
            fit, se = x @ beta, np.sqrt(np.maximum(((x @ v) * x).sum(1), 0))
            make = lambda a: pa.array(np.asarray(a, float))
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(fit)), batch.column("level"), batch.column("x"), batch.column("x2"), make(fit), make(se), make(fit - se_mult * se), make(fit + se_mult * se)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return grid.select("level", "x", "x2").mapInArrow(run, SCHEMA)


def plot(model, spark, select=None, n_grid: int = 200, n2: int = 40, se_mult: float = 2.0, **style):
    """(figure, data): the figure is None without matplotlib."""
    data = partial_effects(model, spark, select, n_grid, n2, se_mult)
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        return None, data
    pdf = data.toPandas()  # grids only
    panels = list(pdf.groupby(["term", "level"], dropna=False, sort=False))
    figure, axes = plt.subplots(len(panels), 1, squeeze=False, **style)
    edf = dict(zip((t.label for t in model.setup_.terms), model.edf_))
    for ax, ((term, level), part) in zip(axes[:, 0], panels):
        if part["x2"].isna().all():
            ax.plot(part["x"], part["fit"])
            ax.fill_between(part["x"], part["lower"], part["upper"], alpha=0.3)
        else:
            n = int(np.sqrt(len(part)))
            ax.contourf(part["x"].to_numpy().reshape(n, n), part["x2"].to_numpy().reshape(n, n), part["fit"].to_numpy().reshape(n, n))
        ax.set_ylabel(f"{term[:-1]},{edf[term]:.2f})" + (f":{level}" if isinstance(level, str) else ""))
    return figure, data
