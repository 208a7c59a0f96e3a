"""Distributed passes over the rows: aggregates for bases, Gram matrices, and sums for inference.

A pass maps Arrow batches to one row of sums per partition, adds them in partition order
(by a tree when there are many), and brings O(p^2) numbers to the driver. The design
matrix exists only inside a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Partial sums that the driver adds itself; beyond it they are added by groups first.
TREE = 64
#: Bytes of one column up to which its distinct values are sorted on the driver.
LOCAL_COLUMN_BYTES = 32 << 20


def columns_of(batch) -> dict:
    """Arrow batch to numpy columns: float64, or objects for strings."""
    out = {}
    for name, col in zip(batch.schema.names, batch.columns):
        if pa.types.is_floating(col.type) or pa.types.is_integer(col.type):
            out[name] = col.to_numpy(zero_copy_only=False)
        else:
            out[name] = np.asarray(col.to_pylist(), object)
    return out


def fold(df: DataFrame, step, combine=None) -> list[np.ndarray]:
    """step(cols) -> list of arrays, combined over all batches and partitions.

    combine: per array `np.add`, `np.maximum` or a function of two arrays; np.add if not given.
    """
    ops = combine

    def merge(a, b):
        return b if a is None else [(np.add if ops is None else ops[i])(x, y) for i, (x, y) in enumerate(zip(a, b))]

    def pack(state, key):
        shapes = [np.asarray(x).shape for x in state]
        return pa.RecordBatch.from_pydict({"key": [key], "shapes": [repr(shapes)], "sums": [np.concatenate([np.asarray(x, float).ravel() for x in state]).tobytes()]}, schema=schema)

    def unpack(shapes, raw):
        shapes, flat, at, out = eval(shapes, {}), np.frombuffer(raw), 0, []  # noqa: S307 - our own tuples
        for s in shapes:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return out

    schema = pa.schema([("key", pa.int64()), ("shapes", pa.string()), ("sums", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        state = None
        for batch in batches:
            if batch.num_rows:
                state = merge(state, step(columns_of(batch)))
        if state is not None:
            yield pack(state, TaskContext.get().partitionId())

    parts = df.mapInArrow(run, "key long, shapes string, sums binary")
    n = df.rdd.getNumPartitions()
    while n > TREE:
        groups = int(np.ceil(np.sqrt(n)))

        def add(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["key"])
            state = None
            for r in rows:
                state = merge(state, unpack(r["shapes"], r["sums"]))
            return pa.Table.from_batches([pack(state, rows[0]["key"])])

        parts = parts.groupBy(F.expr(f"key div {-(-n // groups)}")).applyInArrow(add, "key long, shapes string, sums binary")
        n = groups
    state = None
    for r in sorted(parts.collect(), key=lambda r: r["key"]):
        state = merge(state, unpack(r["shapes"], r["sums"]))
    return state


class Facts:
    """Answers of aggregate questions about a table, each asked once."""

    def __init__(self, df: DataFrame, numeric: list[str], n: int | None = None):
        self.df = df
        self.n = df.count() if n is None else n
        row = {}
        if numeric:
            row = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("lo", F.min), ("hi", F.max), ("mu", F.mean))]).first().asDict()
        self._range = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(numeric)}
        self._mean = {c: row[f"mu{i}"] for i, c in enumerate(numeric)}
        self._distinct: dict = {}
        self._sums: dict = {}

    def range(self, x: str):
        return self._range[x]

    def mean(self, x: str) -> float:
        return self._mean[x]

    def n_distinct(self, x: str) -> int:
        if x not in self._distinct:
            self._distinct[x] = self.df.agg(F.count_distinct(F.col(f"`{x}`"))).first()[0]
        return self._distinct[x]

    def distinct_percentiles(self, x: str, k: int) -> np.ndarray:
        """k evenly spaced fractional ranks through the sorted distinct values; their number comes with them."""
        if self.n * 8 <= LOCAL_COLUMN_BYTES:
            found = self.df.select(F.col(f"`{x}`").cast("double").alias("x")).toArrow().column("x").to_numpy()
            values = np.unique(found)
            self._distinct[x] = len(values)
            return np.interp(np.arange(k) * ((len(values) - 1) / (k - 1)), np.arange(len(values)), values)
        out, self._distinct[x] = knots(self.df, x, k)
        return out

    def distinct_rows(self, xs: list[str], most: int) -> np.ndarray:
        """Distinct covariate rows in lexicographic order, or a seeded choice of `most` of them.

        The chosen ranks are drawn on the driver; rows get their rank from their range
        partition's offset, so neither sorting nor choosing gathers the rows in one task.
        """
        cols = [F.col(f"`{x}`") for x in xs]
        distinct = self.df.select(*cols).distinct()
        n = distinct.count()
        if n <= most:
            rows = distinct.collect()
        else:
            chosen = sorted(np.random.RandomState(1).choice(n, most, replace=False).tolist())
            dealt = distinct.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id()).persist()
            counts = dealt.groupBy(F.shiftright("__at", 33).alias("p")).count()
            w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
            starts = counts.select("p", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("start"))
            ranked = dealt.withColumn("p", F.shiftright("__at", 33)).join(F.broadcast(starts), "p")  # one row a partition
            ranked = ranked.withColumn("__rank", F.col("start") + F.col("__at").bitwiseAND((1 << 33) - 1))
            ids = self.df.sparkSession.createDataFrame([(int(i),) for i in chosen], "__rank long")
            rows = ranked.join(F.broadcast(ids), "__rank", "left_semi").select(*cols).collect()
            dealt.unpersist()
        return np.array(sorted(tuple(r) for r in rows), float)

    def basis_sums(self, basis) -> dict:
        """Column sums, sums of squares, and the largest absolute row sum of a basis over all rows."""
        key = (id(basis), tuple(getattr(basis, "scale", ())))
        if key not in self._sums:
            names = list(dict.fromkeys(basis.variables))

            def step(cols):
                x = basis.eval(cols)
                return [x.sum(0), (x * x).sum(0), np.abs(x).sum(1).max(), float(len(x))]

            sums, squares, norm, n = fold(self.df.select(*[F.col(f"`{v}`") for v in names]), step, [np.add, np.add, np.maximum, np.add])
            self._sums[key] = {"sums": sums, "squares": squares, "norm": float(norm), "n": float(n)}
        return self._sums[key]


def knots(df: DataFrame, x: str, k: int) -> tuple[np.ndarray, int]:
    """k knots, and the number of distinct values, for columns of any length.

    Distinct values are range-partitioned and sorted; a row's rank is its partition's
    offset plus its place there, so only the rows at the wanted ranks come to the driver.
    """
    values = df.select(F.col(f"`{x}`").cast("double").alias("x")).distinct().repartitionByRange("x").sortWithinPartitions("x")
    values = values.withColumn("at", F.monotonically_increasing_id()).persist()
    counts = sorted((r["p"], r["count"]) for r in values.groupBy(F.shiftright("at", 33).alias("p")).count().collect())  # one row a partition
    n = sum(c for _, c in counts)
    rank = np.arange(k) * ((n - 1) / (k - 1))
    wanted = sorted({int(r) for r in np.concatenate((np.floor(rank), np.ceil(rank)))})
    place, start = {}, 0
    for p, c in counts:
        place |= {(p << 33) + r - start: r for r in wanted if start <= r < start + c}
        start += c
    rows = values.where(F.col("at").isin(list(place))).collect()
    values.unpersist()
    found = sorted((place[r["at"]], r["x"]) for r in rows)
    return np.interp(rank, [a for a, _ in found], [b for _, b in found]), n


def tsqr(df: DataFrame, eval_rows) -> np.ndarray:
    """R factor of the rows that eval_rows(cols) makes: local QRs, stacked and factored again."""

    def both(a, b):
        return np.linalg.qr(np.vstack((a, b)), mode="r")

    def step(cols):
        x = eval_rows(cols)
        r = np.linalg.qr(x, mode="r")
        out = np.zeros((x.shape[1], x.shape[1]))
        out[: len(r)] = r
        return [out]

    return fold(df, step, [both])[0]
