"""Exact top-k search by inner product with a Voronoi kNN join.

Pivots (a bounded sample: the square root of the rows, up to `PIVOT_BYTES`) cut the data
into Voronoi cells. Each cell is summed up by its pivot p and its radius R, the largest
distance of a member from p. For a query q no member at distance r from p scores more than
q.p + |q| r. Queries are solved in their own cell first, which gives each a k-th best score;
then a query is replicated to just those other cells whose bound by R reaches it. There
queries form groups of `QUERIES_BLOCK`, and of the cell's data only the members that the
group's own distance bound needs are replicated to it. Results are exact for any pivots:
the sample decides only how much is pruned.

Cells are cut into blocks of `BLOCK` rows and their queries into blocks as said, so a cell
may hold any share of the data; a cell without queries moves nothing. Of each block at
most k rows per query go on.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part, and rows without an id neither; vectors of different lengths are not compared; rows
of the query's own id are no candidates; repeated query rows (id and vector) are one query,
rows of one id with different vectors are different ones, repeated candidates stay rows of
their own; ties go to the smaller id; vectors so large that doubles would not hold all
scores exactly (squared norms from 2^53) are an error; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Workspace, table
from .embeddings import finite

PIVOT_BYTES = 8 << 20
BLOCK = 8192
QUERIES_BLOCK = 8192
EXACT = float(1 << 53)

MEMBER = "cell int, id long, is_query boolean, vec binary, radius double, norm2 double"
ASKED = "id long, twin long, vec binary, cell int, least double, rho double"
SOLVED = "query_id long, twin long, vec_id long, score long"


def _cells(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                x = np.vstack(part["v"].to_numpy()).astype(np.float64)
                d2 = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
                cell = d2.argmin(1)
                yield pd.DataFrame({"cell": cell, "id": part["id"], "is_query": part["is_query"], "vec": [r.tobytes() for r in x], "radius": np.sqrt(np.maximum(((x - pivots[cell]) ** 2).sum(1), 0)), "norm2": (x * x).sum(1)})

    return run


def _solve(k: int):
    """Top k of a block for each of its queries, at least as good as what the query has."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        is_query = group["is_query"].to_numpy()
        data, queries = group[~is_query], group[is_query]
        if not len(data) or not len(queries):
            return pd.DataFrame({"query_id": [], "twin": [], "vec_id": [], "score": []})
        x = np.vstack([np.frombuffer(v) for v in data["vec"]])
        ids = data["id"].to_numpy()
        x, ids = x[order := np.argsort(ids, kind="stable")], ids[order]
        out = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            scores = np.vstack([np.frombuffer(v) for v in part["vec"]]) @ x.T
            for q, twin, least, s in zip(part["id"].to_numpy(), part["twin"].to_numpy(), part["least"].to_numpy(), scores):
                s = np.where(ids == q, -np.inf, s)
                if len(s) > k:
                    least = max(least, np.partition(s, -k)[-k])
                good = np.flatnonzero((s >= least) & (s > -np.inf))
                good = good[np.argsort(-s[good], kind="stable")][:k]
                out.append((np.full(len(good), q), np.full(len(good), twin), ids[good], s[good].astype(np.int64)))
        return pd.DataFrame({c: np.concatenate(z) for c, z in zip(("query_id", "twin", "vec_id", "score"), zip(*out))})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest inner products of floor(scale * x)."""
    ws = Workspace(vectors.sparkSession, "topk")
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    # The raw vector is judged: floor gives a long, in which nothing non-finite is left to see.
    good = finite(F.col(vector_col)) & F.col(id_col).isNotNull()
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    solved = None
    for dim, n in sorted(tuple(r) for r in rows.groupBy(F.size("v")).count().collect()):  # one length, as a rule
        part = _top_k_of(ws, rows.where(F.size("v") == dim), k, dim, n)
        solved = part if solved is None else solved.unionAll(part)
    if solved is None:
        solved = vectors.sparkSession.createDataFrame([], SOLVED)
    best = _best(solved, k).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(solved: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pivots(rows: DataFrame, dim: int, n: int) -> np.ndarray:
    """Rows of the smallest hashes: the square root of all, as far as PIVOT_BYTES holds them."""
    count = max(1, min(max(16, math.isqrt(n)), PIVOT_BYTES // (8 * dim)))
    picked = rows.orderBy(F.xxhash64("id", "v"), "id").select("v").limit(count).toArrow()["v"].combine_chunks()
    return np.unique(np.asarray(picked.flatten(), np.float64).reshape(len(picked), dim), axis=0)


def _top_k_of(ws: Workspace, rows: DataFrame, k: int, dim: int, n: int) -> DataFrame:
    spark = rows.sparkSession
    pivots = _pivots(rows, dim, n)
    members = ws.stage(rows.mapInPandas(_cells(pivots), MEMBER), "cells")
    sums = members.groupBy("cell").agg(F.max("radius").alias("r"), F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2")).collect()  # a row for each pivot
    if any(not s["norm2"] < EXACT for s in sums):
        raise ValueError("vectors are too large: scores of 2^53 or more can't be told apart")
    radius = np.full(len(pivots), -1.0)
    for s in sums:
        radius[s["cell"]] = s["r"] * (1 + 1e-9) + 1e-6
    blocks = {s["cell"]: -(-s["n"] // BLOCK) for s in sums}

    def solve(queries: DataFrame, name: str) -> DataFrame:
        """queries(ASKED): solved in their cells, block against block."""
        asked = {r["cell"]: -(-r["q"] // QUERIES_BLOCK) for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).collect()}  # a row for each pivot at most
        plan = spark.createDataFrame([(c, blocks[c], q) for c, q in asked.items()], "cell int, blocks int, query_blocks int")
        queries = queries.join(F.broadcast(plan), "cell").withColumn("query_block", F.pmod(F.xxhash64("id", "twin"), F.col("query_blocks")).cast("int"))
        # What each group of queries needs of a cell: members at least as far from the pivot as its bound.
        need = queries.groupBy("cell", "query_block").agg(F.min("rho").alias("rho"))
        data = members.join(F.broadcast(plan), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        data = data.join(need, "cell").where(F.col("radius") * (1 + 1e-9) + 1e-6 >= F.col("rho"))
        queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        key = ["cell", "block", "query_block", "id"]
        none = F.lit(0).cast("long").alias("twin")
        both = data.select(*key, none, "vec", F.lit(False).alias("is_query"), F.lit(0.0).alias("least")).unionAll(queries.select(*key, "twin", "vec", F.lit(True), "least"))
        return ws.stage(both.groupBy("cell", "block", "query_block").applyInPandas(_solve(k), SOLVED), name)

    low = F.lit(float("-inf"))
    asked = members.where("is_query").select("id", F.xxhash64("vec").alias("twin"), "vec", "cell").dropDuplicates(["id", "twin"])
    asked = ws.stage(asked.select("id", "twin", "vec", "cell", low.alias("least"), low.alias("rho")), "asked")
    if asked.isEmpty():
        return spark.createDataFrame([], SOLVED)
    near = solve(asked, "near")
    kth = _best(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "twin", F.col("score").cast("double").alias("kth"))
    known = asked.join(kth, ["id", "twin"], "left").select("id", "twin", "vec", "cell", F.coalesce("kth", low).alias("least"))

    def reach(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                q, least = np.vstack([np.frombuffer(v) for v in part["vec"]]), part["least"].to_numpy()[:, None]
                size = np.sqrt((q * q).sum(1))[:, None]
                middle = q @ pivots.T
                ok = middle + size * radius[None, :] >= least
                ok[np.arange(len(q)), part["cell"]] = False
                ok[:, radius < 0] = False
                i, cell = np.nonzero(ok)
                with np.errstate(invalid="ignore", divide="ignore"):
                    rho = np.where(size > 0, (least - middle) / size, -np.inf)
                rows = {c: part[c].to_numpy()[i] for c in ("id", "twin", "vec", "least")}
                yield pd.DataFrame(rows | {"cell": cell, "rho": rho[i, cell]})[["id", "twin", "vec", "cell", "least", "rho"]]

    far = ws.stage(known.mapInPandas(reach, ASKED), "reach")
    if far.isEmpty():
        return near
    return near.unionAll(solve(far, "far"))


def op2_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
, s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  , q.v AS q FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

QUERIES = {"op2_topk": op2_topk}
ORACLES = {"op2_topk": ORACLE}
