"""Scoring is a narrow map, so it is the same on a stream; cross-products add up batch by batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.passes import fold

_STATE = "batch long, xx array<double>, xy array<double>, yy double, n double"


def score_stream(model, stream: DataFrame, se_fit: bool = False) -> DataFrame:
    """The stream with `fit` (and `se_fit`); stateless, so it needs no watermark."""
    return model.predict(stream, se_fit=se_fit)


class GramAccumulator:
    """X'X, X'y and y'y of all batches seen: pass `add_batch` to writeStream.foreachBatch.

    A batch that is delivered again (same id) counts once. With `path`, a folder that the
    next run can reach, each batch's sums are written there under its id, and a new
    accumulator of that path goes on from them.
    """

    def __init__(self, model, path: str | None = None, spark=None):
        self.model, self.path, self.seen = model, path, set()
        p = model.setup_.p
        self.xx, self.xy, self.yy, self.n = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
        if path and spark is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
                for r in spark.read.schema(_STATE).parquet(f"{path}/*").orderBy("batch").collect():  # O(p^2) numbers a batch
                    self._add(r["batch"], np.array(r["xx"]).reshape(p, p), np.array(r["xy"]), r["yy"], r["n"])

    def _add(self, batch_id: int, xx, xy, yy: float, n: float) -> None:
        self.xx, self.xy, self.yy, self.n = self.xx + xx, self.xy + xy, self.yy + float(yy), self.n + float(n)
        self.seen.add(batch_id)

    def add_batch(self, df: DataFrame, batch_id: int) -> None:
        if batch_id in self.seen:
            return
        setup, spec = self.model.setup_, self.model.spec
        keep = [F.col(f"`{v}`") if v in setup.factor_names else F.col(f"`{v}`").cast("double").alias(v) for v in spec.variables()]

        def step(cols):
            y = cols.pop("__resp")
            x = setup.eval(cols) if cols else np.ones((len(y), setup.p))
            return [x.T @ x, x.T @ y, float(y @ y), float(len(y))]

        sums = fold(df.select(F.col(f"`{spec.response}`").cast("double").alias("__resp"), *keep), step)
        if sums is None:
            p = setup.p
            sums = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
        if self.path:
            row = (batch_id, [float(v) for v in np.ravel(sums[0])], [float(v) for v in sums[1]], float(sums[2]), float(sums[3]))
            df.sparkSession.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        self._add(batch_id, *sums)
