"""Sharding by balanced label propagation (DataFrame operations only).

Documents are linked when their texts are equal; a shard is a label. Each round every
document looks at the labels of its neighbours and asks to move to the shard that holds
most of them and has room (a group larger than a shard: to one of as many shards as it
fills); rounds go on until no one asks or the cut no longer falls. A shard admits the share of the requests that its quota
allows, so sizes stay even and fewer links are cut. Shards are even in rows: counts
differ by one at most (law `rows`).

Neighbours that share a label are alike, so the rounds run on cells (group, shard,
count): a group of any size is at most `shards` rows, and no group is gathered. Documents
that no link holds fill what room is left, in a global order, and so do documents that
found no room beside their neighbours, which keeps them side by side.

Defined cases: null texts link with nothing; empty texts are equal; repeated rows are
linked like any equal texts; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Workspace, bounded, global_rank, offsets, ordered, partitions, table

#: The fewest rounds, if cells ask for them; more follow as long as the cut falls.
ROUNDS = 8
SWAP_ROUNDS = 3
#: A cell moves as a whole, to keep its group together, up to this share of a shard's quota.
WHOLE = 0.125
#: Parts of a group that are smaller than this share of a shard, and not its largest, are placed with the rest.
SCATTERED = 0.25
BLOCK = 4096


def _unit(*cols) -> "F.Column":
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def _admit(flows: list[tuple[int, int, int]], room: list[int]) -> list[float]:
    """The share of requests that each shard admits: what has room, and room that leavers make."""
    p = [1.0] * len(room)
    for _ in range(50):
        left, asked = [max(0, r) for r in room], [0] * len(room)
        for a, b, n in flows:
            left[a] += n * p[b]
            asked[b] += n
        p = [min(x, r / n) if n else 0.0 for x, r, n in zip(p, left, asked)]
    return p


def _propagate(ws: Workspace, cells: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """Label propagation over cells(gid, shard, n) under the shards' quotas.

    Ends when no cell asks to move, or when after `rounds` rounds the cut no longer falls.
    """
    step, before = 0, -1.0
    quotas = F.array(*[F.lit(q) for q in quota])
    while True:
        # One row a shard: its load, and the squares of its cells, whose sum is greater the fewer links are cut.
        sums = cells.groupBy("shard").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("kept")).collect()
        load, kept = {r["shard"]: r["n"] for r in sums}, sum(r["kept"] for r in sums)
        if step >= rounds and kept <= before:
            return cells
        before = kept
        room = [q - load.get(s, 0) for s, q in enumerate(quota)]
        # Early on any shard may be asked, as moves free room too; later on only those that have some.
        open_ = F.array(*[F.lit(r > 0 or step < SWAP_ROUNDS) for r in room])
        w = Window.partitionBy("gid")
        own = F.struct("n", F.xxhash64("gid", "shard").alias("tie"), "shard")
        # A group asks for as many shards as it fills, its largest ones; each of its other cells asks for one of these.
        need = F.ceil(F.sum("n").over(w) / max(1, *quota)).cast("int")
        best = F.slice(F.sort_array(F.collect_list(F.when(F.get(open_, F.col("shard")), own)).over(w), asc=False), F.lit(1), need)
        asked = cells.withColumn("best", best).withColumn("one", F.get("best", F.pmod(F.xxhash64("gid", "shard", F.lit(step)), F.greatest(F.size("best"), F.lit(1))).cast("int")))
        want = (F.col("one") > own) & ~F.array_contains(F.col("best.shard"), F.col("shard"))
        asked = ws.stage(asked.withColumn("to", F.when(want, F.col("one.shard"))).drop("best", "one"), "asked")
        flows = asked.where("to is not null").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()  # shards^2 rows at most
        if not flows:
            ws.drop(cells)
            return asked.select("gid", "shard", "n")
        rates = _admit([(r["shard"], r["to"], r["n"]) for r in flows], room)
        share = F.array(*[F.lit(p) for p in rates])
        p = F.get(share, F.col("to"))
        whole = F.col("n") <= F.greatest(F.lit(1), F.floor(F.get(quotas, F.col("to")) * WHOLE))
        moved = F.when(F.col("to").isNull(), 0).when(whole, F.when(_unit("gid", "to", F.lit(step)) < p, F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.floor(F.col("n") * p + _unit("gid", "shard", F.lit(step)))))
        both = asked.withColumn("moved", moved.cast("long")).select("gid", F.explode(F.array(F.struct("shard", (F.col("n") - F.col("moved")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")))).alias("c"))
        nxt = ws.stage(both.select("gid", "c.*").where("n > 0").groupBy("gid", "shard").agg(F.sum("n").alias("n")), "cells")
        ws.drop(cells, asked)
        cells, step = nxt, step + 1


def _fit(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Cuts cells where a shard holds more than its quota, the smallest of a shard first.

    Loads are summed per shard and size class, so that no shard's cells meet in one task.
    """
    # What is left of a large group in shards that others fill is better off side by side with the rest of it.
    main = F.max("n").over(Window.partitionBy("gid"))
    few = F.get(F.array(*[F.lit(q) for q in quota]), F.col("shard")) * SCATTERED
    cells = cells.withColumn("main", main).where((F.col("n") >= F.col("main")) | (F.col("n") >= few)).drop("main")
    cls = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    cells = cells.withColumn("cls", cls).withColumn("part", F.pmod(F.xxhash64("gid"), F.lit(64)).cast("int"))
    sums = cells.groupBy("shard", "cls", "part").agg(F.sum("n").alias("s"))
    w = Window.partitionBy("shard").orderBy(F.desc("cls"), "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "cls", "part", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("above"))
    w = Window.partitionBy("shard", "cls", "part").orderBy("gid").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("above") + F.coalesce(F.sum("n").over(w), F.lit(0))
    cells = cells.join(F.broadcast(sums), ["shard", "cls", "part"]).withColumn("upto", upto)  # at most shards * 64 * 64 rows
    limit = F.get(F.array(*[F.lit(q).cast("long") for q in quota]), F.col("shard"))
    kept = F.greatest(F.lit(0), F.least(F.col("n"), limit - F.col("upto")))
    return cells.select("gid", "shard", kept.cast("long").alias("n")).where("n > 0")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    ws = Workspace(docs.sparkSession, "sharding")
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("gid"),
    )
    rows = global_rank(ordered(ws, base, [F.col("gid"), F.col("doc_id")], "rows"))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    # First labels by a hash of the row; only groups of two and more have links.
    start = F.pmod(F.xxhash64("doc_id", "_m"), F.lit(shards)).cast("int")
    first = rows.where("gid is not null").groupBy("gid", start.alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("_rank").alias("r"))
    first = ws.stage(first.withColumn("size", F.sum("n").over(Window.partitionBy("gid"))).withColumn("at", F.min("r").over(Window.partitionBy("gid"))).where("size > 1"), "links")
    # Large groups first, while all others count as movable; then the small ones in the room that is left.
    is_large = F.col("size") > WHOLE * min(quota)
    large = _propagate(ws, ws.stage(first.where(is_large).select("gid", "shard", "n"), "large"), quota, rounds)
    large = ws.stage(_fit(large, quota), "large")
    taken = {r["shard"]: r["n"] for r in large.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    rest = [q - taken.get(s, 0) for s, q in enumerate(quota)]
    small = _propagate(ws, ws.stage(first.where(~is_large).select("gid", "shard", "n"), "small"), rest, rounds)
    cells = large.unionAll(_fit(small, rest))

    # A group's rows follow each other in the global order: its cells are ranges there, the unplaced rest comes last.
    w = Window.partitionBy("gid").orderBy(F.desc("n"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    groups = first.groupBy("gid").agg(F.first("at").alias("at"), F.first("size").alias("size"))
    spans = cells.join(groups, "gid").withColumn("lo", F.col("at") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    spans = spans.select("shard", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    spans = ws.stage(spans, "spans")
    load = {r["shard"]: r["n"] for r in spans.groupBy("shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    # Each block of ranks gets the spans that reach into it; the last span begun covers a row, if it has not ended.
    cut = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))))
    cut = cut.select("block", F.greatest("lo", F.col("block") * BLOCK).alias("_rank"), F.struct("shard", "hi").alias("span"))
    marks = rows.select(F.floor(F.col("_rank") / BLOCK).alias("block"), "_rank", F.struct("doc_id", "size", "text_crc32", "_pid", "_m").alias("row"))
    marks = marks.unionByName(cut, allowMissingColumns=True)
    w = Window.partitionBy("block").orderBy("_rank", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("span", F.last("span", ignorenulls=True).over(w)).where("row is not null")
    label = F.when(F.col("span.hi") > F.col("_rank"), F.col("span.shard"))
    rows = ws.stage(marks.select("row.*", label.alias("label")), "labelled")

    # Rows without a label fill the shards' room in global order.
    w = Window.partitionBy("_pid").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    free = F.when(F.col("label").isNull(), 1).otherwise(0)
    rows = rows.join(bounded(offsets(rows, [], free, "_start"), partitions(rows.sparkSession)), "_pid")
    nth = F.col("_start") + F.coalesce(F.sum(free).over(w), F.lit(0))
    ends, end = [], 0
    for s, q in enumerate(quota):
        end += q - load.get(s, 0)
        ends.append(end)
    rows = rows.withColumn("_nth", nth)
    filler = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("_nth")))
    rows = ws.stage(rows.withColumn("shard", F.coalesce("label", filler).cast("int")).drop("_start", "_nth", "label"), "sharded")
    w = Window.partitionBy("_pid", "shard").orderBy("_m")
    rows = rows.join(bounded(offsets(rows, ["shard"], F.lit(1), "_start"), len(quota) * partitions(rows.sparkSession)), ["shard", "_pid"])
    slot = (F.col("_start") + F.row_number().over(w) - 1).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_shards(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"), 40)


QUERIES = {"op3_shards": op3_shards}
ORACLES = {}
