"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of leading turns. Its name is the exclusive or of 128-bit hashes of (place, role, text), so
every prefix of a conversation is named by a running exclusive or over its turns, and nodes are groups of equal names:
no text is compared twice and no conversation is held as a whole.

Subtree totals go from children to parents in reverse level order. Nodes fall into classes by the power of FAN that their
members reach; the nodes of one class that hang together are a shard, which has under FAN nodes a level. Shards are
dealt over tasks; a task has its nodes sorted by descending depth (Spark's external sort) and every node sends its
totals to its parent through a priority queue ordered the same way, which spills sorted runs. The totals of shard roots
are summed per parent and are where the next class starts: within shards first, then across shard roots, once a power.

Defined results: rows without conversation id form no conversation. Turns go by their number, null first, ties by role
and then by a hash of the text; null roles and texts are empty. Repeated rows are repeated turns. An empty table has no
nodes, not even a root. Other columns, whatever their names, play no part. A conversation of any length is ranked and
named part by part; its chain of nodes passes one task, which keeps one message of it at a time."""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from populi.llm.common import Scratch
from populi.operators.groups import rank_within

FAN = 256  # of members: classes are its powers, and a shard has fewer nodes a level
BLOCK = 4096  # turns of a conversation whose names are made in one go
CHUNK = 1024  # neighbouring conversation ids whose list is one value
MESSAGES = 500_000  # that a priority queue keeps in memory
NODE = ("depth", "x1", "x2")


def ordered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0), n (turns of the conversation), key (16 bytes that stand for role and text), n_chars."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    content = F.sha2(F.concat(F.length(empty(role)).cast("string"), F.lit(":"), empty(role), empty(text)).cast("binary"), 256)
    rows = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), empty(role).alias("role"),
        F.unhex(F.substring(content, 1, 32)).alias("key"), F.length(empty(text)).cast("long").alias("n_chars"))
    ranked = rank_within(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")], rank="rank", size="n")
    return ranked.select("conv_id", (F.col("rank") - 1).alias("pos"), "n", "key", "n_chars")


def spliced(turns: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % 100; h = crc32(c) % 6. As
    `ordered`, and a conversation without turns left has one row with a null pos."""
    conv = F.col("conv_id")
    convs = turns.where("pos = 0").select("conv_id", F.col("n").alias("own"), (conv - conv % 100).alias("base"),
                                          (F.crc32(conv.cast("string").cast("binary")) % 6).alias("h"))
    bases = convs.where(conv == F.col("base")).select(conv.alias("base"), F.col("own").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("n", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("base_n", "own")
    columns = ["conv_id", "pos", "n", "key", "n_chars"]
    own = turns.drop("n").join(convs, "conv_id").where(F.col("pos") >= F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    lent = turns.where((F.col("pos") < 5) & (conv % 100 == 0)).select(conv.alias("base"), "pos", "key", "n_chars").join(
        convs, "base").where(F.col("pos") < F.col("m"))
    bare = convs.where("n = 0").select("conv_id", F.lit(None).cast("long").alias("pos"), "n", F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("n_chars"))
    return own.select(columns).unionByName(lent.select(columns)).unionByName(bare)


def _named(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, depth, name (x1, x2), the parent's name (p1, p2), n_chars, ends (it is the last turn)."""
    z = {f"z{i}": F.xxhash64(F.lit(i), F.col("pos"), F.col("key")) for i in (1, 2)}
    rows = turns.where("pos is not null").withColumns({**z, "block": F.floor(F.col("pos") / BLOCK)})
    xor = lambda i: F.bit_xor(f"z{i}")
    whole = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (rows.where(F.col("n") > BLOCK).groupBy("conv_id", "block").agg(xor(1).alias("z1"), xor(2).alias("z2"))
             .select("conv_id", "block", *[F.coalesce(xor(i).over(whole), F.lit(0)).alias(f"a{i}") for i in (1, 2)]))
    inner = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumns({f"x{i}": xor(i).over(inner) for i in (1, 2)}).join(ahead, ["conv_id", "block"], "left")
    x = x.withColumns({f"x{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"a{i}", F.lit(0))) for i in (1, 2)})
    return x.select("conv_id", (F.col("pos") + 1).alias("depth"), "x1", "x2", *[F.col(f"x{i}").bitwiseXOR(F.col(f"z{i}")).alias(f"p{i}") for i in (1, 2)],
                    "n_chars", (F.col("pos") == F.col("n") - 1).alias("ends"))


class SpillingQueue:
    """Smallest first, of tuples of `width` whole numbers; what exceeds `limit` goes to sorted runs.

    A run is the task's own spill, like that of a Spark sort: an unnamed file in Spark's local folder that ends with the task."""

    def __init__(self, width: int, limit: int = MESSAGES):
        self.width, self.limit = width, limit
        self.near: list[tuple] = []
        self.runs: list[tuple] = []  # (smallest item left, number of the run, the rest)
        self.made = 0

    def _run(self, file) -> Iterator[tuple]:
        file.seek(0)
        while data := file.read(8 * self.width * 1024):
            cells = array("q", data)
            yield from zip(*[iter(cells)] * self.width)

    def push(self, item: tuple) -> None:
        heapq.heappush(self.near, item)
        if len(self.near) > self.limit:
            file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            for x in sorted(self.near):
                array("q", x).tofile(file)
            rest = self._run(file)
            self.near, self.made = [], self.made + 1
            heapq.heappush(self.runs, (next(rest), self.made, rest))

    def first(self) -> tuple | None:
        heads = ([self.near[0]] if self.near else []) + ([self.runs[0][0]] if self.runs else [])
        return min(heads, default=None)

    def pop(self) -> tuple:
        if self.near and (not self.runs or self.near[0] <= self.runs[0][0]):
            return heapq.heappop(self.near)
        item, run, rest = self.runs[0]
        following = next(rest, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, run, rest))
        return item


SUMS = ("n_children", "n_leaves", "saved_tokens")


def _forward(limit: int):
    """mapInArrow function over nodes in descending depth: adds what their children in the task send to the totals they come with."""
    def run(batches):
        queue = SpillingQueue(5, limit)
        for batch in batches:
            cells = {c: batch.column(c).to_pylist() for c in (*NODE, "p1", "p2", "root", "weight", *SUMS)}
            out: list[list[int]] = [[], [], []]
            for depth, x1, x2, p1, p2, root, weight, children, leaves, saved in zip(*cells.values()):
                key = (-depth, x1, x2)
                while (head := queue.first()) is not None and head[:3] == key:
                    _, _, _, l, s = queue.pop()
                    children, leaves, saved = children + 1, leaves + l, saved + s
                if not children:
                    leaves = 1
                saved += weight
                if not root:
                    queue.push((1 - depth, p1, p2, leaves, saved))
                for cell, x in zip(out, (children, leaves, saved)):
                    cell.append(x)
            for name, values in zip(SUMS, out):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(values, pa.int64()))
            yield batch
    return run


def _hashed_lists(batches):
    """mapInArrow function over pieces of lists in order: one row per node with the hash of its joined pieces."""
    key, state = None, None
    for batch in batches:
        done = []
        for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
            if node == key:
                state.update(b"," + ids.encode())
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
        yield _list_rows(done)
    if key is not None:
        yield _list_rows([(*key, state.hexdigest())])


def _list_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame, scratch: Scratch, fan: int = FAN, messages: int = MESSAGES) -> DataFrame:
    """The nodes with their totals: depth, name (x1, x2), parent's name (p1, p2; null for the root), conv_id, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. turns: a written table as `ordered` or `spliced` gives it."""
    named = scratch.write(_named(turns), "named")
    empty = turns.where("pos is null").select("conv_id")
    # a root row for every conversation would be one group; its figures come from the conversations' first rows
    starts = turns.where("pos = 0 or pos is null").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = starts.where("n_convs > 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"),
                                             "conv_id", "n_convs", zero.alias("weight"))
    nodes = named.groupBy(*NODE).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"),
                                     F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"))
    nodes = nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("n_chars")).drop("n_chars").unionByName(top)
    level, grade = F.lit(0), fan
    while grade < 1 << 62:
        level, grade = level + (F.col("n_convs") >= grade).cast("int"), grade * fan
    nodes = scratch.write(nodes.withColumn("class", level), "nodes")
    highest = nodes.agg(F.max("class")).first()[0]
    if highest is None:
        highest = -1
    # classes never rise along a conversation: its first node of a class tells the shard; nodes of the lowest class need no join
    heavy = nodes.where("class > 0").select(*NODE, "class")
    path = named.select("conv_id", *NODE).join(heavy, list(NODE), "left").withColumn("class", F.coalesce("class", F.lit(0)))
    shards = path.groupBy("conv_id", "class").agg(F.min(F.struct("depth", "x1")).alias("top")).where(F.col("class") < highest)
    nodes = nodes.join(shards, ["conv_id", "class"], "left").withColumns(
        {"shard": F.coalesce("top.x1", F.lit(0)), "root": F.coalesce(F.col("top.depth"), F.lit(0)) == F.col("depth")}).drop("top")
    nodes = scratch.write(nodes, "sharded")
    rounds: list[DataFrame] = []
    for k in range(highest + 1):
        mine = nodes.where(F.col("class") == k)
        sent = [r.where("root").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), "n_leaves", "saved_tokens") for r in rounds]
        if sent:
            every = sent[0]
            for more in sent[1:]:
                every = every.unionByName(more)
            got = every.groupBy(*NODE).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            mine = mine.join(got, list(NODE), "left")
            mine = mine.withColumns({c: F.coalesce(c, zero) for c in SUMS})
        else:
            mine = mine.withColumns({c: zero for c in SUMS})
        dealt = mine.repartition("shard").sortWithinPartitions(F.desc("depth"), "x1", "x2")
        rounds.append(scratch.write(dealt.mapInArrow(_forward(messages), dealt.schema), f"round-{k}"))
    done = rounds[0] if rounds else nodes.withColumns({c: zero for c in SUMS})
    for more in rounds[1:]:
        done = done.unionByName(more)
    # parents: those of the lowest class have few children, the others are few
    reps = lambda df: df.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    up = ["depth", "p1", "p2"]
    with_heavy = scratch.write(done.join(reps(nodes.where("class > 0")), up, "left"), "parents")
    found = with_heavy.where("parent_conv_id is not null or depth = 0")
    others = with_heavy.where("parent_conv_id is null and depth > 0").drop("parent_conv_id").join(reps(nodes.where("class = 0")), up)
    lists = named.where("ends").select(*NODE, "conv_id").unionByName(empty.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id"))
    pieces = lists.groupBy(*NODE, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))  # CHUNK ids at most, as an id is one conversation
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    hashes = pieces.mapInArrow(_hashed_lists, "depth long, x1 long, x2 long, ends_sha256 string")
    out = found.unionByName(others).join(hashes, list(NODE), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(*NODE, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", *SUMS, F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def digest(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", *SUMS, "ends_sha256")
