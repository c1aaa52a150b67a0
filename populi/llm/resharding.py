"""Resharding by minimum-cost flow.

The old layout is cut into blocks (ranges of text hashes within an old shard), whose sizes are summed. Old shards supply
their bytes, new shards take up to their capacities, keeping bytes in place is free and moving one costs `cost`: the flow
of least cost says how many bytes each old shard sends to each new one. The network has one node per shard, so it is
solved exactly on the driver by successive shortest paths; documents and blocks never go there. Every old shard lays its
blocks end to end and hands out consecutive stretches to its targets. A stretch ends between blocks or, inside the block
where its limit falls, between texts, so that only moved files are rewritten and equal texts stay together unless their
bytes exceed the tolerance; blocks of such hot texts are salted by document.

Law `bytes`: large blocks and texts are laid first, so a stretch ends among the smallest ones and sizes differ by little more
than those. A text stays in one shard with its copies while they have at most `TOLERANCE` of a shard's bytes together.
Defined results: a null text has size 1 and crc 0, like an empty one; every row gets a slot, repeated rows one each; a
null doc_id is placed by its text; further columns are kept by `assign`; an empty table gives an empty result."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from populi.llm.common import Scratch, text_or_empty

BLOCKS = 4096  # blocks of an old shard
TOLERANCE = 0.05  # of a new shard's capacity


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each source to each sink at least cost; capacities must hold the supply.

    Successive shortest paths with labels corrected in a queue; augmentations number at most the pairs times two."""
    n, m = len(supply), len(capacity)
    flow, left, room = [[0] * m for _ in range(n)], list(supply), list(capacity)
    while any(left):
        dist = [0 if left[i] else None for i in range(n)] + [None] * m
        back: list[int | None] = [None] * (n + m)
        queue = deque(i for i in range(n) if left[i])
        while queue:
            u = queue.popleft()
            edges = ([(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]])
            for v, c in edges:
                if dist[v] is None or dist[u] + c < dist[v]:
                    dist[v], back[v] = dist[u] + c, u
                    queue.append(v)
        ends = [j for j in range(m) if room[j] and dist[n + j] is not None]
        if not ends:
            raise ValueError("capacities do not hold the supply")
        end = min(ends, key=lambda j: (dist[n + j], j))
        path, v = [], n + end
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        amount = min([left[v], room[end], *[flow[b][a - n] for a, b in path if a >= n]])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[end] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def assign(docs: DataFrame, old_shard: F.Column, shards: int, scratch: Scratch, blocks: int = BLOCKS, cost: list[list[int]] | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, old_shard, shard, slot (gapless from 0 within its shard).

    old_shard: the present shard, an integer from 0. cost[i][j]: of moving a byte from old shard i to new shard j; as
    given, 0 at home and 1 elsewhere."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), old_shard.cast("int").alias("old_shard"))
    rows = scratch.write(rows.withColumn("block", F.pmod(F.shiftright("h", 20), F.lit(blocks)).cast("int")), "rows")
    supply = {r["old_shard"]: r["n"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("n")).collect()}  # one row per old shard
    if not supply:
        return rows.select("doc_id", "size", "text_crc32", "old_shard", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    olds = max(supply) + 1
    total = sum(supply.values())
    cost = cost or [[int(i != j) for j in range(shards)] for i in range(olds)]
    flow = min_cost_flow([supply.get(i, 0) for i in range(olds)], even_capacities(total, shards), cost)
    limit = max(1, int(total / shards * TOLERANCE))

    # texts whose copies exceed the tolerance are dealt by document; there are fewer than total / limit of them
    hot = rows.groupBy("old_shard", "h").agg(F.sum("size").alias("n"), F.count("*").alias("c")).where((F.col("n") > limit) & (F.col("c") > 1)).select("old_shard", "h")
    hot = scratch.write(hot, "hot").withColumn("hot", F.lit(True))
    salt = F.xxhash64("doc_id", "h")
    rows = (rows.join(hot, ["old_shard", "h"], "left")
            .withColumn("key", F.when(F.col("hot"), salt).otherwise(F.col("h")))
            .withColumn("block", F.when(F.col("hot"), F.pmod(F.shiftright(salt, 20), F.lit(blocks)).cast("int")).otherwise(F.col("block"))).drop("hot"))
    rows = scratch.write(rows, "keyed")
    laid = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"))
    before = W.partitionBy("old_shard").orderBy(F.desc("bytes"), "block").rowsBetween(W.unboundedPreceding, -1)
    laid = laid.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0)))  # at most `blocks` rows an old shard
    cuts, targets = {}, {}  # the ends of an old shard's stretches, and where each goes
    for i in supply:
        order = [i] * (i < shards and flow[i][i] > 0) + [j for j in range(shards) if j != i and flow[i][j]]
        at, cuts[i], targets[i] = 0, [], []
        for j in order:
            at += flow[i][j]
            cuts[i].append(at)
            targets[i].append(j)

    def target(at: F.Column) -> F.Column:
        """Where the byte at that place of its old shard goes."""
        out = None
        for i in supply:
            here = F.lit(targets[i][-1])
            for end, j in reversed(list(zip(cuts[i], targets[i]))):
                here = F.when(at < end, j).otherwise(here)
            out = F.when(F.col("old_shard") == i, here) if out is None else out.when(F.col("old_shard") == i, here)
        return out

    laid = laid.select("old_shard", "block", "start", target(F.col("start")).alias("from"), target(F.col("start") + F.col("bytes") - 1).alias("to"))
    laid = scratch.write(laid, "laid")
    rows = rows.join(laid, ["old_shard", "block"])
    # a block that a cut crosses, at most one per cut, is parted between texts
    crossed = rows.where(F.col("from") != F.col("to"))
    crossed = crossed.withColumn("group", F.sum("size").over(W.partitionBy("old_shard", "block", "key")))
    inside = W.partitionBy("old_shard", "block").orderBy(F.desc("group"), "key").rangeBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("start") + F.sum("size").over(inside) - F.floor(F.col("group") / 2)
    crossed = crossed.withColumn("at", middle).withColumn("shard", target(F.col("at"))).drop("at", "group")
    whole = rows.where(F.col("from") == F.col("to")).withColumn("shard", F.col("from"))
    placed = scratch.write(whole.unionByName(crossed).select("doc_id", "size", "text_crc32", "h", "old_shard", "block", "shard"), "placed")
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "old_shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = W.partitionBy("shard", "old_shard", "block").orderBy("h", "doc_id")
    return (placed.withColumn("k", F.row_number().over(within)).join(counts, ["shard", "old_shard", "block"])
            .select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("k") - 1).cast("long").alias("slot")))


def rewrite(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> list[int]:
    """Writes the files of every new shard that a moved document leaves or enters, as path/shard=<n>; other shards keep theirs.

    ids must be unique. Returns the rewritten shards (one number per shard)."""
    moved = placed.where(F.col("old_shard") != F.col("shard"))
    touched = sorted({r[0] for r in moved.select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect()})
    kept = placed.where(F.col("shard").isin(touched)).select(F.col("doc_id").alias("__d"), "shard")
    out = docs.join(kept, docs[id_col].cast("long") == F.col("__d")).drop("__d")
    out.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(64))).write.mode("overwrite").partitionBy("shard").parquet(path)
    return touched


def digest(docs: DataFrame, shards: int = 8, old_shards: int = 6) -> DataFrame:
    """The documents lie in `old_shards` by their texts' hashes and are spread over `shards` of equal bytes."""
    scratch = Scratch(docs.sparkSession, "resharding")
    old = F.pmod(F.xxhash64(text_or_empty()), F.lit(old_shards))
    placed = assign(docs, old, shards, scratch)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard")
