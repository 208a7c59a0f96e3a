"""Shared plumbing: staged tables, global order without a single task, graph components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is absent, a fresh one, if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="splinewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows up to which a helper table is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """For a join with df, of which `rows` is an upper bound of the rows: broadcast while that is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Workspace:
    """Intermediate tables in the shared folder: they cut lineage and outlive executors.

    Files go when `drop` is called or when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.root)
        path.getFileSystem(self._conf()).deleteOnExit(path)

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def stage(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        self._n += 1
        where = f"{self.root}/{self._n}-{name}"
        df.write.option("compression", codec).parquet(where)  # snappy: little native memory per open file
        out = self.spark.read.schema(df.schema).parquet(where)
        out._staged_at = where
        return out

    def release(self) -> None:
        """Lets go of shuffle files that no plan refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Deletes staged tables that no later plan reads."""
        for df in frames:
            path = self._path(df._staged_at)
            path.getFileSystem(self._conf()).delete(path, True)


def ordered(ws: Workspace, df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Stages df in global key order; adds _pid (range partition) and _m (order).

    Rows that tie on all keys are split by their place in the input, so that even a
    table of one repeated row is dealt over all partitions.
    """
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*keys, F.col("_tie")]
    dealt = df.repartitionByRange(partitions(ws.spark), *keys).sortWithinPartitions(*keys)
    staged = ws.stage(dealt.drop("_tie").withColumn("_m", F.monotonically_increasing_id()), name)
    return staged.withColumn("_pid", F.shiftright("_m", 33))


def offsets(df: DataFrame, by: list[str], value: Column, out: str) -> DataFrame:
    """Per (by, _pid): the sum of value over earlier partitions. One row per partition and key."""
    sums = df.groupBy(*by, "_pid").agg(F.sum(value).alias("_sum"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_pid")
    before = F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*by, "_pid", F.coalesce(before, F.lit(0)).alias(out))


def global_rank(df: DataFrame, out: str = "_rank") -> DataFrame:
    """Gapless rank from 0 of an ordered() table; needs no window over the rows."""
    starts = offsets(df, [], F.lit(1), "_start")
    local = F.col("_m").bitwiseAND((1 << 33) - 1)
    return df.join(bounded(starts, partitions(df.sparkSession)), "_pid").withColumn(out, F.col("_start") + local).drop("_start")


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): (node, component), component the smallest node.

    Alternates large-star and small-star rounds written as joins against each node's
    smallest neighbour, so no neighbour list is ever gathered in one place; skewed join
    partitions of a hub can be split because both sides are plain shuffles. Rounds go on
    until every node is linked to its component's smallest one, however many that takes.
    """
    cur = ws.stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    size = cur.count()
    while size:
        # large star: every neighbour larger than u links to u's smallest neighbour (or u).
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u's smaller neighbours and u itself link to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = large.join(small_least, "u")
        nxt = nxt.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small_least.select("u", F.col("m").alias("v"))).distinct()
        nxt = ws.stage(nxt, "star")
        # Done when every node has one link and no link's end is itself linked further.
        facts = nxt.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("d")).first()
        ws.drop(cur)
        cur = nxt
        if facts["n"] == facts["d"]:
            roots = nxt.select(F.col("v").alias("u")).distinct()
            if roots.join(nxt, "u", "left_semi").isEmpty():
                break
    labels = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
