"""Near-duplicate embeddings by cross-polytope hashing.

Each table rotates vectors by fast Hadamard transforms with random signs, twice, and
hashes each rotation to the coordinate of largest size and its sign. A vector lies in the
bucket of its two largest coordinates and probes the buckets that the runners-up give
(multiprobe). Vectors that meet in a bucket are candidates; their cosine is computed in
double precision, so nothing below the threshold links.

Blocks are told apart by 64-bit fingerprints. A pair is counted where it meets first, in the order of tables and buckets, which each
side's list of buckets tells: no pair leaves its bucket, only counts of links and the
edges of a spanning forest do. Buckets of more than `BLOCK` vectors are cut into blocks,
all of which meet, so no bucket is capped. Ids are hashed and dealt first; vectors follow
only into buckets where a pair can be. Equal vectors are one with a multiplicity.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and
rows whose label or id is null, link with nothing; vectors of different lengths never
link; repeated rows count as copies; an empty table gives an empty result; other columns
are not read. Recall against brute force is measured by the tests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, components, partitions, table

TABLES = 5
PROBES = 2  # coordinates tried in each of two rotations: 4 buckets a table, the first its own
BLOCK = 4096
ROWS = 512  # rows of a block compared with another block at a time
SHORT = 32  # rows of a block below which blocks are compared together
SEED = 20


def finite(vector: Column) -> Column:
    """Whether a vector has components and all are numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one (or zero), whatever the size of their components."""
    x = x / np.maximum(np.abs(x).max(1, initial=0.0), 1e-300)[:, None]
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def buckets(unit: np.ndarray) -> np.ndarray:
    """Bucket numbers (rows, TABLES, PROBES^2); the first of each table is the row's own."""
    d = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), d))
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng(SEED)
    out = np.empty((len(x), TABLES, PROBES**2), np.int32)
    for t in range(TABLES):
        codes = []
        for _ in range(2):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :PROBES]
            codes.append(2 * top + (np.take_along_axis(y, top, 1) > 0))
        pairs = codes[0][:, :, None] * (2 * d) + codes[1][:, None, :]
        out[:, t] = pairs.reshape(len(x), -1)
    return out


def _meets(ka: np.ndarray, kb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of bucket lists of one table: whether they meet, and in which bucket first."""
    none = np.iinfo(np.int32).max
    first = np.where((kb == ka[:, :1]).any(1), ka[:, 0], none)
    other = np.where((ka == kb[:, :1]).any(1), kb[:, 0], none)
    at = np.minimum(first, other)
    return at < none, at


def _same_bucket_pairs(start: np.ndarray, length: np.ndarray, chunk: np.ndarray, i: np.ndarray, j: np.ndarray, close):
    """Pairs (of row numbers) that are close, from runs of rows of one block each.

    Short runs of one length are laid side by side and done at once, long ones by matrix product.
    """
    out = []
    for n in np.unique(length[length <= SHORT]):
        if n > 1:
            a, b = np.triu_indices(n, 1)
            s = start[length == n]
            for at in range(0, len(s), max(1, 200_000 // len(a))):
                part = s[at : at + max(1, 200_000 // len(a)), None]
                pa, pb = (part + a).ravel(), (part + b).ravel()
                good = close(pa, pb)
                out.append((pa[good], pb[good]))
    for s, n, ci, cj in zip(*(x[length > SHORT] for x in (start, length, i, j))):
        rows = np.arange(s, s + n)
        mine, b = rows[chunk[rows] == ci], rows[chunk[rows] == cj]
        for k in range(0, len(mine), ROWS):
            a = mine[k : k + ROWS]
            pa, pb = np.nonzero(close(a, b, True))
            good = a[pa] < b[pb] if ci == cj else np.ones(len(pa), bool)
            out.append((a[pa[good]], b[pb[good]]))
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*out)) or [(), ()])]


def _linked(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts and forest edges of the blocks in rows sorted by block."""
    key = part["key"].to_numpy()
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.concatenate((start, [len(key)])))
    own = part["own"].to_numpy()
    useful = (length > 1) & (np.add.reduceat(own.astype(np.int64), start) > 0)
    start, length = start[useful], length[useful]
    empty = pd.DataFrame({"node": [], "links": [], "to": []})
    if not len(start):
        return empty
    dim = part["dim"].to_numpy()
    used = np.zeros(len(part), bool)
    for s, n in zip(start, length):
        used[s : s + n] = True
    x = np.zeros((len(part), dim.max()))
    for d in np.unique(dim):
        at = np.flatnonzero(used & (dim == d))
        if len(at):
            raw = b"".join(part["vec"].to_numpy()[at])
            x[at, :d] = np.frombuffer(raw, np.float32 if len(raw) == 4 * d * len(at) else np.float64).reshape(len(at), d)
    x = _unit(x)

    def close(a, b, cross=False):
        if cross:
            return (x[a] @ x[b].T >= threshold) & (own[a][:, None] | own[b][None, :])
        return (np.einsum("ij,ij->i", x[a], x[b]) >= threshold) & (own[a] | own[b])

    pa, pb = _same_bucket_pairs(start, length, part["chunk"].to_numpy(), part["i"].to_numpy()[start], part["j"].to_numpy()[start], close)
    if not len(pa):
        return empty
    t, bucket = part["t"].to_numpy()[pa], part["bucket"].to_numpy()[pa]
    rows, back = np.unique(np.concatenate((pa, pb)), return_inverse=True)
    # The bucket lists of what is close are hashed anew, which costs less than to carry all.
    keys = np.empty((len(rows), TABLES, PROBES**2), np.int32)
    for d in np.unique(dim[rows]):
        at = np.flatnonzero(dim[rows] == d)
        keys[at] = buckets(x[rows[at], :d])
    ka, kb = back[: len(pa)], back[len(pa) :]
    # A pair counts where it meets first.
    first = np.ones(len(pa), bool)
    for table_ in range(TABLES):
        meets, at = _meets(keys[ka, table_], keys[kb, table_])
        first &= np.where(t == table_, at == bucket, ~meets | (t < table_))
    pa, pb = pa[first], pb[first]
    ids, mult = part["node"].to_numpy(), part["mult"].to_numpy()
    names, back = np.unique(ids[np.concatenate((pa, pb))], return_inverse=True)
    na, nb = back[: len(pa)], back[len(pa) :]
    links = (np.bincount(na, mult[pb], len(names)) + np.bincount(nb, mult[pa], len(names))).astype(np.int64)
    # A forest over the pairs: every vector linked to the least of its component here.
    lab, old = np.arange(len(names)), None
    while old is None or (lab != old).any():
        old = lab.copy()
        low = np.minimum(lab[na], lab[nb])
        np.minimum.at(lab, na, low)
        np.minimum.at(lab, nb, low)
        lab = lab[lab]
    return pd.DataFrame({"node": names, "links": links, "to": names[lab]})


def _links(threshold: float):
    def run(batches):
        # Rows come sorted by block; a block that goes on in the next batch waits for it.
        rest = None
        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(part):
                continue
            key = part["key"].to_numpy()
            end = np.flatnonzero(key != key[-1])
            cut = end[-1] + 1 if len(end) else 0
            rest = part.iloc[cut:].reset_index(drop=True)
            if cut:
                yield _linked(part.iloc[:cut].reset_index(drop=True), threshold)
        if rest is not None and len(rest):
            yield _linked(rest, threshold)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "embeddings")
    wide = vectors.schema[vector_col].dataType.elementType.simpleString() != "float"
    v = F.col(vector_col).cast("array<double>" if wide else "array<float>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.col(label_col).alias("label"))
    usable = finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    distinct = ws.stage(rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")).withColumn("serial", F.monotonically_increasing_id()), "distinct")
    kind = np.float64 if wide else np.float32

    def packed(batches):
        for batch in batches:
            for d, part in batch.groupby(batch["v"].map(len), sort=False):
                x = np.vstack(part["v"].to_numpy()).astype(kind)
                yield pd.DataFrame({"node": part["serial"], "dim": d, "mult": part["mult"], "vec": [r.tobytes() for r in x]})

    def hashed(batches):
        for batch in batches:
            for d, part in batch.groupby(batch["v"].map(len), sort=False):
                x = np.vstack(part["v"].to_numpy()).astype(kind).astype(np.float64)
                keys = buckets(_unit(x))
                # Own bucket and probes, each once a table.
                for t in range(TABLES):
                    for p in range(keys.shape[2]):
                        new = ~(keys[:, t, :p] == keys[:, t, p : p + 1]).any(1)
                        yield pd.DataFrame({"label": part["label"].to_numpy()[new], "dim": d, "t": t, "bucket": keys[new, t, p], "own": p == 0, "node": part["serial"].to_numpy()[new]})

    name = distinct.schema["label"].dataType.simpleString()
    members = distinct.select("label", "v", "serial").mapInPandas(hashed, f"label {name}, dim int, t int, bucket int, own boolean, node long")
    dealt = members = ws.stage(members.select(F.xxhash64("label", "dim", "t", "bucket").alias("place"), "t", "bucket", "own", "node"), "members")
    # A bucket without an owner, or with one vector, has no pair; large ones are cut into blocks.
    sizes = members.groupBy("place").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("owned")).where("m > 1 and owned")
    members = members.join(sizes.select("place", F.ceil(F.col("m") / BLOCK).cast("int").alias("chunks")), "place")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    chunk = F.col("chunk")
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, chunk).alias("i"), F.greatest(c, chunk).alias("j")))
    # Ids are dealt first; vectors go only where a block has use for them.
    members = members.join(distinct.select("v", "mult", "serial").mapInPandas(packed, "node long, dim int, mult long, vec binary"), "node")
    blocks = members.withColumn("block", F.explode(meets)).select(F.xxhash64("place", "block.i", "block.j").alias("key"), "dim", "t", "bucket", "block.i", "block.j", "chunk", "own", "node", "mult", "vec")
    blocks = blocks.repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = ws.stage(blocks.mapInPandas(_links(threshold), "node long, links long, to long"), "found")
    comp = components(ws, found.select(F.col("node").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "serial")
    count = found.groupBy(F.col("node").alias("serial")).agg(F.sum("links").alias("links"))
    named = distinct.join(count, "serial", "left").join(comp.withColumnRenamed("component", "root"), "serial", "left")
    named = ws.stage(named.where("mult > 1 or links is not null").select("label", "v", "rep", "mult", "links", "root"), "named")
    least = named.where("root is not null").groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(least, "root", "left").drop("root")
    ws.drop(dealt, found)
    out = rows.join(named.withColumn("ok", F.lit(True)), ["label", "v", "ok"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    n_links = F.coalesce(F.col("mult") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embeddings(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


QUERIES = {"op4_embeddings": op4_embeddings}
ORACLES = {}
