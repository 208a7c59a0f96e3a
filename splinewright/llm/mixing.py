"""Mixing sources to target weights by a time-varying curriculum (DataFrame operations only).

Method: each source has a weight schedule over training time t in [0, 1],
rate_s(t) = target_s * (1 + ramp_s * (2 t - 1)). Its integral is the cumulative token
demand; every copy of a document is met at the demand already served by its source, and
the inverse of the integral gives the copy's training position. Documents are then
range-sorted by position.

Which copies are taken: a source takes floor(target / size) whole passes, and for the
rest the documents that come first by a hash of id and text, as long as they fit; what is
then left is filled by the largest documents that still fit, until none does. The query
op10_mix takes `TOPUPS` of these, as its SQL says.

Histograms (per source, and per source and hash bucket or size) are shuffled, and hashes of
documents that could fill what is left.

Defined cases: a null text has size 0; a null source is a source of its own, last; an
empty table gives an empty result; rows that agree in id and text are taken or left
together; documents of size 0 are kept by whole passes only and never cost words;
other columns, whatever their names, pass through `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, WORD, Workspace, table

TOPUPS = 3
BUCKET_BITS = 10
FINE_DIGITS = 6  # of the hash: the crossing bucket's parts


def _key(source: Column) -> Column:
    """A join key that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)), F.lit(0)).cast("long")


def _hash(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text), F.lit(""))))


def _bucket(h: Column) -> Column:
    return F.shiftright(F.conv(F.substring(h, 1, 13), 16, 10).cast("long"), 52 - BUCKET_BITS).cast("int")


def _targets(base: DataFrame, max_repeat: int) -> DataFrame:
    """One row per source: its size, weight and target after the capped shares are dealt again."""
    src = base.groupBy("_src").agg(F.sum("_size").alias("s"))
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.col("_src") == "n", "_src"))
    src = src.withColumn("rank", rank).withColumn("w", (F.pmod(F.col("rank") - 1, F.lit(3)) + 1).cast("long"))
    src = src.withColumn("cap", F.col("s") * max_repeat).withColumn("total", F.sum("s").over(one))
    by_ratio = one.orderBy(F.col("cap") / F.col("w"), "rank")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    capped = F.col("cap").cast("double") * rest <= F.col("w").cast("double") * (F.col("total") - before)
    src = src.withColumn("capped", capped)
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(one)
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(one)
    share = F.col("w").cast("double") * (F.col("total") - spent) / F.nullif(free, F.lit(0))
    src = src.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share))
    passes = F.when(F.col("s") > 0, F.floor(F.col("target") / F.nullif(F.col("s"), F.lit(0)))).otherwise(0)
    src = src.withColumn("passes", passes.cast("long"))
    return src.withColumn("rest", F.col("target") - F.col("passes") * F.col("s"))


def plan_mix(ws: Workspace, base: DataFrame, max_repeat: int = 3, topups: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """From base(_src, _h, _bucket, _size): what each source takes, its demand per bucket, and _fill()'s choice.

    topups: so many of the largest documents that still fit, in place of all.
    """
    src = ws.stage(_targets(base, max_repeat).select("_src", "rank", "s", "target", "passes", "rest"), "sources")
    hist = base.groupBy("_src", "_bucket").agg(F.sum("_size").alias("bs"))
    w = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = ws.stage(hist.withColumn("before", F.coalesce(F.sum("bs").over(w), F.lit(0))), "demand")
    # The bucket in which the hash order passes what is left of the target.
    cross = hist.join(src, "_src").where("before <= rest and rest < before + bs")
    cross = ws.stage(cross.select("_src", "_bucket", "before", "rest"), "cross")
    units = base.join(_small(cross), ["_src", "_bucket"]).groupBy("_src", "before", "rest", "_h").agg(F.sum("_size").alias("us"))
    units = ws.stage(units.withColumn("_fine", F.substring("_h", 1, FINE_DIGITS)), "units")
    # That bucket's own histogram, by more digits of the hash, tells in which of its parts; only that is put in order.
    w = Window.partitionBy("_src").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    fine = units.groupBy("_src", "before", "rest", "_fine").agg(F.sum("us").alias("fs"))
    fine = fine.withColumn("start", F.col("before") + F.coalesce(F.sum("fs").over(w), F.lit(0))).where("start <= rest and rest < start + fs")
    fine = ws.stage(fine.select("_src", "_fine", "start"), "fine")
    w = Window.partitionBy("_src", "_fine").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    peers = units.join(_small(fine), ["_src", "_fine"]).withColumn("upto", F.col("start") + F.sum("us").over(w)).where("upto <= rest")
    edge = peers.groupBy("_src").agg(F.max("_h").alias("h"), F.max("upto").alias("upto"))
    # All earlier parts are taken, whose hashes are less than this part's first digits.
    edge = fine.join(edge, "_src", "left").select("_src", F.coalesce("h", "_fine").alias("last_h"), F.coalesce("upto", "start").alias("upto"))
    cross = cross.withColumnRenamed("_bucket", "last_bucket").drop("rest")
    src = src.join(cross, "_src", "left").join(edge, "_src", "left")
    src = src.withColumn("last_h", F.coalesce("last_h", F.lit(""))).withColumn("last_bucket", F.coalesce("last_bucket", F.lit(-1)))
    src = src.withColumn("left_over", F.col("rest") - F.coalesce("upto", "before", F.lit(0))).drop("before", "upto")
    src = ws.stage(src.withColumn("extra", F.array().cast("array<string>")), "edges")
    if topups is None:
        return src, hist, _fill(ws, base, src)
    for _ in range(topups):
        # The largest document that still fits, in each source: a partial aggregate of the base table.
        fit = base.join(_small(src), "_src").where(~_chosen() & (F.col("_size") > 0) & (F.col("_size") <= F.col("left_over")))
        best = fit.groupBy("_src").agg(F.max(F.struct("_size", "_h")).alias("best"))
        nxt = src.join(best, "_src", "left")
        nxt = nxt.withColumn("extra", F.when(F.col("best").isNull(), F.col("extra")).otherwise(F.concat("extra", F.array("best._h"))))
        nxt = nxt.withColumn("left_over", F.col("left_over") - F.coalesce("best._size", F.lit(0))).drop("best")
        src = ws.stage(nxt, "edges")
    return src, hist, None


def _fill(ws: Workspace, base: DataFrame, src: DataFrame) -> DataFrame:
    """The largest documents that still fit what is left of each source, until none does: extra(_src, _h, ...).

    Rows that agree in id and text count as one document. Each round takes from the counts
    of sizes all that fit in descending order, up to the first size of which not all fit;
    of that, as many as do. What is left halves at least.
    """
    free = base.join(_small(src.select("_src", "last_bucket", "last_h", "left_over", "extra")), "_src").where(~_chosen() & (F.col("_size") > 0) & (F.col("_size") <= F.col("left_over")))
    docs = free.groupBy("_src", "_bucket", "_h").agg(F.sum("_size").alias("_unit"))
    docs = ws.stage(docs, "free")
    sizes = ws.stage(docs.groupBy("_src", "_unit").agg(F.count(F.lit(1)).alias("n")), "sizes")
    left = ws.stage(src.select("_src", "left_over"), "left")
    taken = None
    while True:
        down = Window.partitionBy("_src").orderBy(F.desc("_unit")).rowsBetween(Window.unboundedPreceding, 0)
        fit = sizes.join(_small(left), "_src").where("_unit <= left_over")
        fit = fit.withColumn("upto", F.sum(F.col("_unit") * F.col("n")).over(down))
        # The sizes that fit whole, and the first after them.
        fit = fit.where("upto - _unit * n <= left_over").withColumn("before", F.col("upto") - F.col("_unit") * F.col("n"))
        over = F.col("upto") > F.col("left_over")
        some = F.floor((F.col("left_over") - F.col("before")) / F.col("_unit"))
        fit = fit.withColumn("take", F.when(over, some).otherwise(F.col("n")))
        fit = fit.withColumn("crossed", F.coalesce(F.sum(F.when(over, 1)).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        fit = ws.stage(fit.where("crossed = 0").select("_src", "_unit", "n", "take", over.alias("over")), "taken")
        if fit.isEmpty():
            break
        part = fit.where("take > 0").select("_src", "_unit", "n", "take")
        taken = part if taken is None else taken.unionAll(part)
        spent = fit.groupBy("_src").agg(F.sum(F.col("_unit") * F.col("take")).alias("spent"), F.max("over").alias("more"))
        # A source of which all sizes fitted is done.
        left = ws.stage(left.join(spent, "_src").where("more").select("_src", (F.col("left_over") - F.col("spent")).alias("left_over")), "left")
    if taken is None:
        return docs.select("_src", "_h").limit(0)
    # The greatest hashes of a size of which not all are taken: whole buckets from above, then the bucket in which they end.
    own = docs.join(_small(taken), ["_src", "_unit"])
    above = Window.partitionBy("_src", "_unit").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    dealt = own.groupBy("_src", "_unit", "_bucket").agg(F.count(F.lit(1)).alias("m"))
    dealt = dealt.withColumn("above", F.coalesce(F.sum("m").over(above), F.lit(0))).drop("m")
    own = own.join(_small(ws.stage(dealt, "dealt")), ["_src", "_unit", "_bucket"]).where("above < take")
    nth = F.row_number().over(Window.partitionBy("_src", "_unit", "_bucket").orderBy(F.desc("_h")))
    return ws.stage(own.withColumn("nth", nth + F.col("above")).where("nth <= take").select("_src", "_h"), "extra")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast, once a count has shown that the per-source table is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _chosen() -> Column:
    """Whether a row is in the partial pass of its source."""
    return (F.col("_bucket") < F.col("last_bucket")) | ((F.col("_bucket") == F.col("last_bucket")) & (F.col("_h") <= F.col("last_h"))) | F.array_contains("extra", F.col("_h"))


def _decide(rows: DataFrame, src: DataFrame, hist: DataFrame, extra: DataFrame | None) -> DataFrame:
    """Adds copies and training positions to rows that have _src, _h, _bucket and _size."""
    rows = rows.join(_small(src), "_src").join(_small(hist), ["_src", "_bucket"])
    chosen = _chosen()
    if extra is not None:
        rows = rows.join(_small(extra.withColumn("_filled", F.lit(True))), ["_src", "_h"], "left")
        chosen = chosen | F.coalesce("_filled", F.lit(False))
    copies = F.col("passes") + F.when(chosen & (F.col("_size") > 0), 1).otherwise(0)
    rows = rows.withColumn("_copies", copies.cast("int"))
    # Demand served before this document within one pass: its bucket's start, plus its place in the bucket's hash range.
    low = F.conv(F.substring("_h", 1, 13), 16, 10).cast("long").bitwiseAND((1 << (52 - BUCKET_BITS)) - 1)
    served = F.col("before") + F.col("bs") * (low.cast("double") / float(1 << (52 - BUCKET_BITS)))
    whole = F.col("passes") * F.col("s")
    demand = F.greatest(whole + F.col("rest"), F.lit(1.0))
    ramp = (F.pmod(F.col("rank") - 1, F.lit(3)) - 1) * F.lit(0.5)

    def position(k: Column) -> Column:
        at = k * F.col("s") + F.when(k < F.col("passes"), served).otherwise(F.least(served, F.col("rest")))
        u = F.least(at / demand, F.lit(1.0))
        # The inverse of u = t + ramp (t^2 - t).
        return 2 * u / ((1 - ramp) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u))

    many = F.transform(F.sequence(F.lit(0), F.col("_copies") - 1), position)
    return rows.withColumn("_positions", F.when(F.col("_copies") > 0, many).otherwise(F.array().cast("array<double>")))


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    h = _hash(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), _key(F.col(source_col)).alias("_src"), h.alias("_h"), _bucket(h).alias("_bucket"), _words(F.col(text_col)).alias("_size"))


def mix_report(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", max_repeat: int = 3, topups: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, positions; in order of first position."""
    ws = Workspace(docs.sparkSession, "mix")
    base = ws.stage(_base(docs, id_col, text_col, source_col), "base")
    out = _decide(base, *plan_mix(ws, base, max_repeat, topups))
    out = out.select("doc_id", F.col("_size").alias("size"), F.col("s").alias("source_size"), "target", (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"), F.col("_positions").alias("positions"))
    return out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", max_repeat: int = 3) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with its own columns only, sorted by training position."""
    ws = Workspace(docs.sparkSession, "mix")
    base = ws.stage(_base(docs, id_col, text_col, source_col).drop("doc_id"), "base")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    h = _hash(F.col(f"_row.`{id_col}`"), F.col(f"_row.`{text_col}`"))
    row = row.select("_row", _key(F.col(f"_row.`{source_col}`")).alias("_src"), h.alias("_h"), _words(F.col(f"_row.`{text_col}`")).alias("_size")).withColumn("_bucket", _bucket(F.col("_h")))
    out = _decide(row, *plan_mix(ws, base, max_repeat)).select("_row", F.explode("_positions").alias("_at"), "_h")
    return out.orderBy("_at", "_h").select("_row.*")


def op10_mix(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"), topups=TOPUPS).select("doc_id", "size", "source_size", "target", "taken", "copies")


_FIT = """
, left{k} AS (SELECT src, r - coalesce(got, 0) AS r FROM left{j} LEFT JOIN (SELECT src, max(n) AS got FROM pick{j} GROUP BY 1) USING (src))
, pick{k} AS (SELECT src, h, n FROM (SELECT src, h, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, h DESC) AS k
    FROM d JOIN left{k} USING (src) WHERE n > 0 AND n <= r AND h NOT IN (SELECT h FROM pre) {seen}) WHERE k = 1)
"""


def _oracle() -> str:
    fits, seen = "", ""
    for k in range(1, TOPUPS + 1):
        fits += _FIT.format(k=k, j=k - 1, seen=seen)
        seen += f" AND h NOT IN (SELECT h FROM pick{k})"
    taken = " UNION ".join(["SELECT h FROM pre", *[f"SELECT h FROM pick{k}" for k in range(1, TOPUPS + 1)]])
    return f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS h FROM documents)
, a AS (SELECT src, CAST(sum(n) AS BIGINT) AS s FROM d GROUP BY 1)
, b AS (SELECT *, (row_number() OVER (ORDER BY src = 'n', src) - 1) % 3 + 1 AS w, 3 * s AS cap, sum(s) OVER () AS total FROM a)
, c AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, src = 'n', src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS spent_before,
    CAST(sum(w) OVER (ORDER BY cap / w, src = 'n', src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS w_rest FROM b)
, e AS (SELECT *, cap * w_rest <= w * (total - spent_before) AS capped FROM c)
, f AS (SELECT src, s, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) *
    CAST(total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE) / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM e)
, g AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS passes FROM f)
, o AS (SELECT src, h, n, sum(n) OVER (PARTITION BY src ORDER BY h) AS upto, target - passes * s AS r FROM d JOIN g USING (src))
, pre AS (SELECT src, h, upto FROM o WHERE upto <= r)
, left0 AS (SELECT src, target - passes * s - coalesce(u, 0) AS r FROM g LEFT JOIN (SELECT src, max(upto) AS u FROM pre GROUP BY 1) USING (src))
, pick0 AS (SELECT src, h, 0 AS n FROM pre WHERE false)
{fits}
SELECT doc_id, CAST(n AS BIGINT) AS size, s AS source_size, target,
  CAST(n * (passes + CASE WHEN n > 0 AND h IN ({taken}) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(passes + CASE WHEN n > 0 AND h IN ({taken}) THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM d JOIN g USING (src)
"""


QUERIES = {"op10_mix": op10_mix}
ORACLES = {"op10_mix": _oracle()}
