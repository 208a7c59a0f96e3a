"""Fitted models as one-row parquet tables, readable from any store that Spark reads."""

import pickle

from pyspark import cloudpickle
from pyspark.sql import SparkSession

FORMAT = 1


def save(model, spark: SparkSession, path: str) -> None:
    """Writes the fitted state; the training data stay where they are."""
    model._check()
    state = {k: v for k, v in model.__dict__.items() if k not in ("_data", "_offset")}
    rows = [(FORMAT, model.formula, model.family_.family_name, int(model.n_), cloudpickle.dumps(state))]
    spark.createDataFrame(rows, "format int, formula string, family string, n long, state binary").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str):
    """Reads what save() wrote. As with any pickle, read only files that you trust."""
    from ..gam import GAM

    row = spark.read.parquet(path).first()
    if row["format"] != FORMAT:
        raise ValueError(f"Unknown model format {row['format']}")
    model = GAM.__new__(GAM)
    model.__dict__.update(pickle.loads(bytes(row["state"])))
    return model
