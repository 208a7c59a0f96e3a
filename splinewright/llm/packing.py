"""Best-fit packing of tokenized documents into fixed-length sequences.

Method: bound-certified repacking. Pieces are dealt over partitions and each partition
packs its own by best-fit decreasing. Dual-feasible functions give a lower bound of the
partition's bin count, which certifies it or not. While the summed count exceeds the
bound over all pieces and still falls, bins that have gaps give their pieces back, and
these are dealt anew over blocks of bounded size and repacked: first those of partitions
without a certificate, then all. Deals by hash, in which unlike pieces meet, take turns
with deals by gap, in which the emptiest bins of all partitions meet. A block that gains
nothing keeps its bins, so the count never rises; every bin with a gap takes part.

Tokens: the byte-level BPE file named by `tokenizer`, read by the library for its ranks
form, which gives the same ids (tests compare them); every document ends with id 0.

Defined cases: a null or empty text is the one token 0; a document longer than
`capacity` is cut into pieces of exactly `capacity` but for the first, which takes the
remainder; repeated rows are packed as often as they come; an empty table gives an empty
result; only the id and text columns are read, whatever else the table has.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, table

#: Pieces that one task or block packs.
PIECES_PER_TASK = 50_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, sequence_id long, offset long"
#: The gap of the piece's bin, and whether the bin count of its partition or block meets the bound.
PACKED = f"{PLACED}, gap long, certified boolean"


def _encoder(json_path: str):
    """Token ids of a text, as the tokenizer file gives them without special tokens."""
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = []

    def encode(text: str) -> list[int]:
        if "<|endoftext|>" not in text:
            return fast.encode_ordinary(text)
        if not slow:  # the one special token's string: only the other library knows its rule
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(json_path))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        encode = _encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array((encode(text) if text else []) + [0], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin.

    Open bins are kept by their room; a bit set of the rooms in use finds the least room
    that is enough in one step.
    """
    bins, offs = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offs[i] = b, fill[b]
        fill[b] += n
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins, offs, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The greatest bound that two families of dual-feasible functions give for the bin count."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity) if len(lengths) else 0


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """lower_bound() from how many items each length has.

    f_t: 1 above capacity - t, 0 below t, else the share itself; u_k: rounds (k + 1) x
    down to k parts unless it is whole.
    """
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    n_upto, sum_upto = np.cumsum(counts), np.cumsum(counts * sizes)
    t = np.arange(1, capacity // 2 + 1)
    big = n_upto[-1] - n_upto[capacity - t]
    mid = sum_upto[capacity - t] - sum_upto[t - 1]
    best = max(best, int((big + -(-mid // capacity)).max()))
    for k in range(1, 33):
        whole = (k + 1) * sizes % capacity == 0
        parts = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((counts * parts).sum()) // (k * capacity)))
    return best


def _packed(part: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    """The pieces in bins, which count from base; those that lie in no more bins already stay there."""
    lengths = part["length"].to_numpy(np.int64)
    bins, offs, fill = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if "sequence_id" in part and (part["offset"] == 0).sum() <= len(fill):
        return part.assign(certified=(part["offset"] == 0).sum() == bound)
    return part.assign(sequence_id=base + bins, offset=offs, gap=capacity - fill[bins], certified=len(fill) == bound)


def _first(capacity: int):
    def run(batches):
        from pyspark import TaskContext

        if batches := [b for b in batches if len(b)]:
            yield _packed(pd.concat(batches, ignore_index=True), capacity, TaskContext.get().partitionId() << 28)

    return run


def _again(capacity: int, round_no: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        return _packed(part.drop(columns="block"), capacity, (round_no << 48) | (int(part["block"].iloc[0]) << 28))

    return run


def _blocks(bins: DataFrame, by_gap: bool, round_no: int) -> tuple[DataFrame, int]:
    """Adds to pieces the block of their bin, of about PIECES_PER_TASK pieces; and how many blocks there are."""
    sizes = {r["gap"]: r["n"] for r in bins.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    tie = F.xxhash64("sequence_id", F.lit(round_no))
    if not by_gap:
        blocks = max(1, -(-sum(sizes.values()) // PIECES_PER_TASK))
        return bins.withColumn("block", F.pmod(tie, F.lit(blocks)).cast("long")), blocks
    # The emptiest bins come first; bins of one gap that are more than a block are dealt over several.
    deal, block, held = [], 0, 0
    for gap in sorted(sizes, reverse=True):
        if held and held + sizes[gap] > PIECES_PER_TASK:
            block, held = block + 1, 0
        many = max(1, -(-sizes[gap] // PIECES_PER_TASK))
        deal.append((gap, block, many))
        block, held = block + many - 1, held + sizes[gap] if many == 1 else PIECES_PER_TASK
    spark = bins.sparkSession
    deal = F.broadcast(spark.createDataFrame(deal, "gap long, first long, many long"))
    return bins.join(deal, "gap").withColumn("block", F.col("first") + F.pmod(tie, F.col("many"))).drop("first", "many"), block + 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ws = Workspace(docs.sparkSession, "packing")
    todo = ws.stage(tokenize(docs, tokenizer, capacity, id_col, text_col), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in todo.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    bound, tasks = bound_of(counts, capacity), max(1, -(-int(counts.sum()) // PIECES_PER_TASK))
    names = [c.split()[0] for c in PACKED.split(", ")]
    packed = ws.stage(todo.repartition(tasks).mapInPandas(_first(capacity), PACKED), "round0")

    def used(df: DataFrame) -> int:
        return df.where("offset = 0").count()

    done, pool = packed.where("gap = 0"), packed.where("gap > 0")
    total, round_no, every, idle = used(packed), 0, tasks == 1, 0
    while total > bound and tasks > 1:
        # Certified bins are passed over until the others are done; then their gaps count too.
        open_ = pool if every else pool.where("not certified")
        round_no += 1
        dealt, blocks = _blocks(open_, round_no % 2 == 0, round_no)
        nxt = ws.stage(dealt.groupBy("block").applyInPandas(_again(capacity, round_no), PACKED), f"round{round_no}")
        fewer = used(open_) - used(nxt)
        rest = nxt if every else nxt.unionAll(pool.where("certified").select(names))
        done, pool = done.unionAll(nxt.where("gap = 0")), rest.where("gap > 0")
        total, idle = total - fewer, 0 if fewer else idle + 1
        if idle > 1 or idle and blocks == 1:  # neither deal gains any more
            if every:
                break
            every, idle = True, 0
    return done.unionAll(pool).select([c.split()[0] for c in PLACED.split(", ")])


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """(sequences used, lower bound over the whole corpus), from the histogram of lengths."""
    used = packed.select("sequence_id").distinct().count()
    hist = packed.groupBy("length").count().collect()  # at most `capacity` rows
    return used, lower_bound(np.repeat([r["length"] for r in hist], [r["count"] for r in hist]).astype(np.int64), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op1_packing": op1_packing}
ORACLES = {}
