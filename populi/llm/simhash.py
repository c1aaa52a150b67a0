"""Near-duplicates by SimHash with a Gray-order hierarchical index.

A document's fingerprint is the bitwise majority of the XXH64 of its word shingles. Equal fingerprints become one.
Two fingerprints at most d bits apart agree on one of d + 1 bit ranges, so rows meet by (range, its bits); a group too
large for a task is dealt again by d + 1 ranges of its remaining bits, which keeps every link, and one that even then
is too large is cut into blocks that meet in pairs. Within a task each group
is sorted by Gray rank, so that neighbours differ in few bits; runs of 16 become nodes holding the bits all members
share, nodes become nodes of the level above, and a shared bit is kept at the highest node only. A query goes down from
the top, adds up differences node by node, and drops a whole group once they exceed d. Groups already in its component
are passed over, and a task returns only links to its local roots, never pairs. Stars then make the components.

Defined results: null and empty texts have no shingles and fingerprint zero, which is linked like any other; rows of one
doc_id are separate rows; a null doc_id takes part and never names a component unless all its members are null; further
input columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from populi.llm.common import Scratch, gathered, per_batch, text_or_empty
from populi.llm.components import components

MASK = (1 << 64) - 1
FAN = 16  # members of a node
HOT_ROWS = 500_000  # fingerprints of a group beyond which it is dealt again; some 50 MB in a task
DEPTH = 2  # dealings by ranges; groups that stay large then are compared in pairs of blocks
BLOCK = 1 << 16  # shingles counted at a time
BATCH, BUDGET = 4096, 1 << 21  # queries of a batch, and rows of a frontier held at a time


def fingerprint(text: str, words: int, seed: int) -> int:
    """Majority bits of the shingles' hashes; a bit in exactly half of them is 0."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return 0
    joined, ends = b" ".join(tokens), np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = max(1, len(tokens) - words + 1), xxhash.xxh64_intdigest
    starts, ends = starts[:n], ends[-n:]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i:i + BLOCK].tolist(), ends[i:i + BLOCK].tolist())], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp: the 64 bits as a signed long."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])
    text = text_or_empty(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return source.mapInArrow(per_batch(one), "doc_id long, text_hash long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray sequence."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over the groups of a task; rows are kept in (group, Gray rank) order."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), group))
        self.group, self.fp = group[self.order], fp[self.order]
        value, mask, owner = self.fp, np.full(len(fp), MASK, np.uint64), self.group
        first, last = np.arange(len(fp)), np.arange(len(fp))  # rows below a node
        self.levels = []  # from the leaves up: value, mask, first, last row, first child, end of children
        child = end = np.arange(len(fp))
        while True:
            self.levels.append([value, mask, first, last, child, end])
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            if len(begin) == len(owner):
                break
            within = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
            child = np.flatnonzero(within % FAN == 0)
            end = np.r_[child[1:], len(owner)]
            agree = np.bitwise_and.reduceat(mask, child) & ~(np.bitwise_and.reduceat(value, child) ^ np.bitwise_or.reduceat(value, child))
            value, mask, owner, first, last = value[child], agree, owner[child], first[child], last[end - 1]
        for lower, upper in zip(self.levels, self.levels[1:]):  # a bit that the node above holds is not counted again
            lower[1] = lower[1] & ~np.repeat(upper[1], upper[5] - upper[4])
        self.top = np.repeat(np.arange(len(owner)), last - first + 1)

    def _below(self, level: int, query: np.ndarray, node: np.ndarray, gone: np.ndarray, most: int, label: np.ndarray, whole: list) -> list:
        """Pairs (query, earlier row) within `most` bits under the nodes, without those known to be in the query's component."""
        value, mask, first, _, child, end = self.levels[level]
        gone = gone + np.bitwise_count((self.fp[query] ^ value[node]) & mask[node])
        keep = (gone <= most) & (first[node] < query) & (whole[level][node] != label[query])
        query, node, gone = query[keep], node[keep], gone[keep]
        if not level or not len(query):
            return [(query, node)] if len(query) else []
        n = end[node] - child[node]
        return self._expand(level, query, node, gone, n, most, label, whole)

    def _expand(self, level, query, node, gone, n, most, label, whole) -> list:
        child = self.levels[level][4]
        if n.sum() > BUDGET and len(query) > 1:
            half = len(query) // 2
            return [p for part in (slice(half), slice(half, None))
                    for p in self._expand(level, query[part], node[part], gone[part], n[part], most, label, whole)]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self._below(level - 1, np.repeat(query, n), np.repeat(child[node], n) + offset, np.repeat(gone, n), most, label, whole)

    def roots(self, most: int) -> np.ndarray:
        """For every given row, the position of its local root: the first row of those it is linked with in its group."""
        n, high = len(self.fp), len(self.levels) - 1
        label = np.arange(n)
        for at in range(0, n, BATCH):
            query = np.arange(at, min(at + BATCH, n))
            whole = []  # the component of a node whose rows share one, else -1
            for level in self.levels:
                first, last = level[2], level[3]
                if level is self.levels[0]:
                    low = top = label
                else:
                    low, top = np.minimum.reduceat(low, level[4]), np.maximum.reduceat(top, level[4])
                whole.append(np.where(low == top, low, -1))
            for q, row in self._below(high, query, self.top[query], np.zeros(len(query), np.uint8), most, label, whole):
                label = merged(label, q, row)
        out = np.empty(n, np.int64)
        out[self.order] = self.order[label]
        return out


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of each a and b; a label is the smallest row of its component."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, low = a[open_], b[open_], np.minimum(la, lb)[open_]
        np.minimum.at(label, la[open_], low)
        np.minimum.at(label, lb[open_], low)
        while (label[label] != label).any():
            label = label[label]


def split_bits(used: int, parts: int) -> list[int]:
    """Masks that extend `used` by each of `parts` nearly equal ranges of the other bits."""
    free = [i for i in range(64) if not used >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [used | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _bits(mask: int) -> F.Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _dealt(rows: DataFrame, used: dict[int, list[int]]) -> DataFrame:
    """One row per range: mask, part (the bits under it); `used` gives each present mask its extensions."""
    keys = None
    for mask, masks in used.items():
        each = F.array(*[F.struct(_bits(m).alias("mask"), F.col("fp").bitwiseAND(_bits(m)).alias("part")) for m in masks])
        keys = F.when(F.col("mask") == _bits(mask), each) if keys is None else keys.when(F.col("mask") == _bits(mask), each)
    return rows.select("fp", F.explode(keys).alias("key")).select("fp", "key.mask", "key.part")


def links(distinct: DataFrame, most: int, scratch: Scratch, hot_rows: int = HOT_ROWS) -> DataFrame:
    """a, b: links that connect the same fingerprints as all pairs within `most` bits do. distinct: one row per fp."""
    def search(batches):
        rows = gathered(batches)
        if rows is None:
            return
        fp, *key = (rows.column(c).to_numpy() for c in ("fp", "mask", "part", "block"))
        order = np.lexsort(key)
        fresh = np.r_[True, np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in key])]
        group = np.empty(len(fp), np.int64)
        group[order] = np.cumsum(fresh)
        root = GrayIndex(group, fp.view(np.uint64)).roots(most)
        linked = root != np.arange(len(fp))
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["a", "b"])

    used = [0]
    todo, found = distinct.select("fp", F.lit(0).cast("long").alias("mask")), []
    for depth in range(DEPTH):
        rows = _dealt(todo, {m: split_bits(m, most + 1) for m in used}).withColumn("block", F.lit(0).cast("long"))
        sizes = rows.groupBy("mask", "part").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
        hot = scratch.write(sizes, f"hot-{depth}")  # fewer than rows / hot_rows groups
        used = [r["mask"] & MASK for r in hot.select("mask").distinct().collect()]  # at most (most + 1) ** (depth + 1) numbers
        calm = rows.join(hot, ["mask", "part"], "left_anti") if used else rows
        if used:
            todo = scratch.write(rows.join(hot, ["mask", "part"]).select("fp", "mask", "part", "n"), f"todo-{depth}")
            if depth == DEPTH - 1:
                calm = calm.unionByName(_in_blocks(todo, hot_rows))
        found.append(scratch.write(calm.repartition("mask", "part", "block").mapInArrow(search, "a long, b long"), f"found-{depth}"))
        if not used:
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _in_blocks(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Groups that no dealing makes small, as pairs of blocks: each row goes to the pairs its own block is in.

    rows: fp, mask, part, n (rows of the group). A pair holds about hot_rows rows, and every two rows share a pair."""
    count = F.ceil(F.col("n") * 2 / hot_rows).cast("long")
    own = F.pmod(F.xxhash64("fp"), count)
    pairs = rows.withColumns({"own": own, "count": count}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    return pairs.select("fp", "mask", "part", (1 + F.least("own", "other") * F.col("count") + F.greatest("own", "other")).alias("block"))


def near_duplicates(docs: DataFrame, most: int = 4, words: int = 4, seed: int = 42, id_col: str = "doc_id",
                    text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, text_hash, fp, component (a fingerprint), component_id for every input row.

    component_id is the smallest doc_id reachable over fingerprints within `most` bits."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, words, seed, id_col, text_col), "prints")
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    joined = components(links(distinct, most, scratch, hot_rows), scratch)
    linked = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = scratch.write(linked.join(lowest, "component").select("fp", "component", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of docs, with its columns, of each component: the one of the smallest doc_id (then hash of its text)."""
    found = near_duplicates(docs, **options)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("k"))
    best = best.select(F.col("k.doc_id").alias("__d"), F.col("k.text_hash").alias("__t"))
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64(text_or_empty())})
    kept = keyed.join(best, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__hash") == F.col("__t")), "left_semi")
    first = F.row_number().over(W.partitionBy("__id", "__hash").orderBy("__id"))  # rows that repeat id and text
    return kept.withColumn("__k", first).where("__k = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(classes: DataFrame) -> DataFrame:
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
