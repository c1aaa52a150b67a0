"""Nearest neighbours by largest inner product: an NN-descent graph and greedy graph search.

Equal vectors are one node, named by their smallest id. Vectors are lengthened by one component so that all have the same
norm, which makes the inner products of nodes a metric order while those with a query stay as they are. The graph starts
from blocks of near vectors (random hyperplanes) and is improved by rounds of neighbours of neighbours: around every node
its neighbours and the nodes that point to it are compared, pairs with a new edge only, and each node keeps its best. Near nodes
are dealt into groups (by the sides of random hyperplanes); a group fetches each vector its nodes need once, by a join,
and compares inside its task. Joins with what grows with the table are merge joins at every size: a broadcast is built in the
driver. It holds the entries, the sizes of the parts and, while few nodes are wanted, their numbers.
A query keeps a beam of the best nodes found; each round those not yet opened are, by a join with the graph, new nodes are
scored, and the search ends for a query when its whole beam has been opened. It starts at its own node and at the best
DOORS of a bounded set of entries, the longest vectors and a spread of all: what is nearest by inner product can lie in
another component of the graph, among long vectors above all.

The graph and the search are approximate; the scores of what they return are exact inner products in double precision of
the original vectors, and every vector is indexed. Recall against brute force is tested.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do those of another
length than the most frequent one (the shorter of two as frequent); rows without an id take no part; equal vectors are
all answers, smaller ids first; repeated ids are one vector each and the answer names each. Further columns are ignored;
an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from populi.llm.common import Scratch

DEGREE = 32  # neighbours a node keeps
LINKS = 128  # links that a search follows from a node, nearest first, either way
TREES, BLOCK = 3, 1024  # random partitions of the start at least, and nodes compared in a block
ROUNDS, SETTLED = 40, 0.02  # rounds of improvement as a guard; they stop once that share of the edges changes
GROUP, QUERY_GROUP = 256, 160  # nodes, and queries, whose vectors are fetched together
LONGEST, SPREAD, DOORS = 512, 1536, 16  # entries of the search: the longest vectors, others, and how many a query takes
BEAM = 200  # nodes a query keeps
FEW = 10_000  # wanted nodes that a search sends to where the vectors are; more are shuffled
EDGE = "u long, v long, s float, fresh boolean"


def vectors_of(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec (array<double>) of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size["n"] if size else 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    values = values.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(matrix.ravel()))


def best(edges: DataFrame, degree: int) -> DataFrame:
    """The `degree` best distinct neighbours of each node; an edge known before is not fresh."""
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))
    return once.withColumn("r", rank).where(F.col("r") <= degree).drop("r")


def start(nodes: DataFrame, dim: int, count: int, trees: int, block: int, degree: int, seed: int) -> DataFrame:
    """Edges within blocks of near nodes. nodes: node, x (array<float>)."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / block)))))
    planes = np.random.default_rng(seed).normal(size=(trees, max(bits, 1), dim)).astype(np.float32)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(pa.chunked_array([batch.column("x")]))
            for t in range(trees):
                side = (x @ planes[t].T > 0) @ (1 << np.arange(planes.shape[1])) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(side * trees + t, pa.int64()), batch.column("node"), batch.column("x")], names=["part", "node", "x"])

    dealt = nodes.select("node", "x").mapInArrow(deal, "part long, node long, x array<float>")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    dealt = dealt.join(sizes, "part")  # a large part is cut at random into blocks of like size
    cuts = F.greatest(F.round(F.col("n") / block), F.lit(1)).cast("long")
    dealt = dealt.select("part", F.pmod(F.xxhash64("node", "part"), cuts).alias("cut"), "node", "x")

    def compare(table: pa.Table) -> pa.Table:
        x, node = _matrix(table.column("x")), table.column("node").to_numpy()
        n, k = len(node), min(degree, len(node) - 1)
        if k < 1:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "s": pa.array([], pa.float32()), "fresh": pa.array([], pa.bool_())})
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pa.table({"u": np.repeat(node, k), "v": node[top.ravel()], "s": np.take_along_axis(s, top, 1).ravel(), "fresh": np.full(n * k, True)})

    return dealt.groupBy("part", "cut").applyInArrow(compare, EDGE)


def improve(edges: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """Edges found around each node between its neighbours. nodes: node, grp, x."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    pick = F.row_number().over(W.partitionBy("u").orderBy(F.desc("fresh"), F.xxhash64("u", "v")))
    back = back.withColumn("r", pick).where(F.col("r") <= degree).drop("r")  # a node that many point to compares a sample of them
    around = edges.select("u", "v", "fresh").unionByName(back).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    around = around.join(nodes.select(F.col("node").alias("u"), "grp").hint("merge"), "u")
    lists = around.groupBy("grp", "u").agg(F.collect_list(F.struct("v", "fresh")).alias("b")).select(
        "grp", F.transform("b", lambda e: e["v"]).alias("v"), F.transform("b", lambda e: e["fresh"]).alias("fresh"))
    worst = edges.groupBy("u").agg(F.when(F.count("*") >= degree, F.min("s")).otherwise(F.lit(-np.inf).cast("float")).alias("bar"))
    held = nodes.select("node", "x").join(worst.withColumnRenamed("u", "node").hint("merge"), "node", "left")
    need = around.select(F.col("grp").alias("part"), F.col("v").alias("node")).distinct().join(held.hint("merge"), "node")

    def compare(lists_: pa.Table, held_: pa.Table) -> pa.Table:
        ids = held_.column("node").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(held_.column("x"))[order]
        bar = np.nan_to_num(held_.column("bar").to_numpy(zero_copy_only=False)[order].astype(np.float32), nan=-np.inf)
        us, vs, ss = [], [], []
        v_all, f_all = lists_.column("v").combine_chunks(), lists_.column("fresh").combine_chunks()
        ends = v_all.offsets.to_numpy()
        flat = np.searchsorted(ids, v_all.values.to_numpy())
        fresh = f_all.values.to_numpy(zero_copy_only=False).astype(bool)
        for a, b in zip(ends[:-1], ends[1:]):
            at, new = flat[a:b], fresh[a:b]
            s = x[at] @ x[at].T
            good = (s > bar[at][:, None]) & (new[:, None] | new[None, :])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            us.append(at[i])
            vs.append(at[j])
            ss.append(s[i, j])
        u, v, s = (np.concatenate(c) if c else np.zeros(0) for c in (us, vs, ss))
        key = u.astype(np.int64) * len(ids) + v.astype(np.int64)
        _, first = np.unique(key, return_index=True)
        u, v, s = u[first].astype(np.int64), v[first].astype(np.int64), s[first]
        return pa.table({"u": pa.array(ids[u]), "v": pa.array(ids[v]), "s": pa.array(s, pa.float32()), "fresh": pa.array(np.full(len(u), True))})

    return lists.groupBy("grp").cogroup(need.groupBy("part")).applyInArrow(compare, EDGE)


def build_graph(nodes: DataFrame, dim: int, count: int, scratch: Scratch, degree: int = DEGREE, trees: int | None = None, block: int = BLOCK,
                rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """u, v, s: approximate neighbours of every node. The partitions of the start grow with the logarithm of the number of blocks."""
    trees = trees or max(TREES, int(np.ceil(np.log2(max(2, count / block)))))
    edges = scratch.write(best(start(nodes, dim, count, trees, block, degree, seed), degree), "graph-0")
    total = max(1, count * min(degree, count - 1))
    for k in range(1, rounds + 1):
        old = edges.withColumn("fresh", F.lit(False))
        edges = scratch.write(best(old.unionByName(improve(edges, nodes, degree)), degree), f"graph-{k}")
        scratch.drop(f"graph-{k - 1}")
        if edges.where("fresh").count() <= SETTLED * total:
            break
    return edges.select("u", "v", "s")


STATE = "grp long, query long, x binary, ids binary, s binary, done binary, seen binary, next array<long>"
STATE_NAMES = [c.split(" ")[0] for c in STATE.split(", ")]
TYPES = {"x": np.float32, "ids": np.int64, "s": np.float32, "done": np.bool_, "seen": np.int64}


def _states(table: pa.Table) -> list[dict]:
    """Rows as numpy arrays."""
    rows = table.select(STATE_NAMES).to_pylist()
    for row in rows:
        for name, kind in TYPES.items():
            row[name] = np.frombuffer(row[name], kind)
        row["next"] = np.array(row["next"], np.int64)
    return rows


def _table(rows: list[dict]) -> pa.Table:
    columns = {"grp": pa.array([r["grp"] for r in rows], pa.int64()), "query": pa.array([r["query"] for r in rows], pa.int64())}
    columns |= {n: pa.array([np.ascontiguousarray(r[n], k).tobytes() for r in rows], pa.binary()) for n, k in TYPES.items()}
    columns["next"] = pa.array([r["next"].tolist() for r in rows], pa.list_(pa.int64()))
    return pa.table({n: columns[n] for n in STATE_NAMES})


def _scored(beam: int):
    """Scores the new nodes (`next`), keeps the beam, and puts the nodes to open into `next`."""
    def run(state: pa.Table, held: pa.Table) -> pa.Table:
        ids = held.column("node").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(held.column("vec"))[order]
        rows = _states(state)
        for row in rows:
            new = row["next"]
            found = np.searchsorted(ids, new)
            have = np.concatenate([row["ids"], new])
            score = np.concatenate([row["s"], (x[found] @ row["x"] if len(new) else np.zeros(0)).astype(np.float32)])
            done = np.concatenate([row["done"], np.zeros(len(new), bool)])
            keep = np.lexsort((have, -score))[:beam]
            row["ids"], row["s"], done = have[keep], score[keep], done[keep]
            row["next"] = row["ids"][~done]
            row["done"] = np.ones(len(done), bool)  # all that stay in the beam are opened now
        return _table(rows)
    return run


def _opened(state: pa.Table, held: pa.Table) -> pa.Table:
    """Follows the links of the nodes in `next` to nodes not seen before, which become `next`."""
    ids = held.column("u").to_numpy()
    order = np.argsort(ids)
    lists = held.column("vs").combine_chunks()
    ids, links = ids[order], [lists.values.to_numpy()[a:b] for a, b in zip(lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:])]
    rows = _states(state)
    for row in rows:
        at = np.searchsorted(ids, row["next"])
        at = at[(at < len(ids)) & (ids[np.minimum(at, max(len(ids) - 1, 0))] == row["next"])] if len(ids) else at[:0]
        near = np.unique(np.concatenate([links[order[k]] for k in at])) if len(at) else np.zeros(0, np.int64)
        row["next"] = np.setdiff1d(near, row["seen"], assume_unique=True)
        row["seen"] = np.union1d(row["seen"], row["next"])
    return _table(rows)


def entries_of(nodes: DataFrame, scratch: Scratch, longest: int = LONGEST, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, vectors) of the search's entries, longest + spread at most. nodes: node, vec, norm.

    They are written first: a task merges what the tasks offer, each up to as many rows, and not the driver."""
    rows = scratch.write(nodes.orderBy(F.desc("norm"), "node").limit(longest).select("node", "vec"), "longest").collect()
    rows += scratch.write(nodes.orderBy(F.xxhash64("node"), "node").limit(spread).select("node", "vec"), "spread").collect()
    once = {r["node"]: r["vec"] for r in rows}
    return np.array(list(once), np.int64), np.array(list(once.values()), np.float32) if once else np.zeros((0, 0), np.float32)


def _count(state: DataFrame) -> int:
    return state.agg(F.sum(F.size("next"))).first()[0] or 0


def _wanted(state: DataFrame, name: str, count: int) -> DataFrame:
    """part, node (as `name`): the `count` nodes in `next`, once a group, ready for a join with the table that has them."""
    need = state.select(F.col("grp").alias("part"), F.explode("next").alias(name)).distinct()
    return need.hint("broadcast" if count <= FEW else "merge")


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, scratch: Scratch, entries: tuple[np.ndarray, np.ndarray],
           beam: int = BEAM, links: int = LINKS) -> DataFrame:
    """query, node: the beam of each query after greedy search.

    graph: u, v, s; nodes: node, vec (array<float>); queries: grp, query, vec, entry (array of nodes to start from)."""
    doors, places = entries
    both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")).groupBy("u", "v").agg(F.max("s").alias("s"))
    near = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))
    linked = scratch.write(both.withColumn("r", near).where(F.col("r") <= links).groupBy("u").agg(F.collect_list("v").alias("vs")), "links")

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(pa.chunked_array([batch.column("vec")])).astype(np.float32)
                best = np.argsort(-(x @ places.T), axis=1, kind="stable")[:, :DOORS]
                entry = [np.unique(np.concatenate((np.array(e, np.int64), doors[b]))) for e, b in zip(batch.column("entry").to_pylist(), best)]
                none = {"ids": np.zeros(0), "s": np.zeros(0), "done": np.zeros(0)}
                yield from _table([{"grp": g, "query": q, "x": v, "seen": e, "next": e, **none} for g, q, v, e in
                                   zip(batch.column("grp").to_pylist(), batch.column("query").to_pylist(), x, entry)]).to_batches()

    state = scratch.write(queries.select("grp", "query", "vec", "entry").mapInArrow(first, STATE), "new-0")
    k = 0
    while True:  # every round opens all of a beam that is not; it ends, as every node is seen once
        need = _wanted(state, "node", _count(state)).join(nodes.select("node", "vec"), "node")
        state = scratch.write(state.groupBy("grp").cogroup(need.groupBy("part")).applyInArrow(_scored(beam), STATE), f"beam-{k}")
        scratch.drop(f"new-{k}")
        if not (count := _count(state)):
            break
        need = _wanted(state, "u", count).join(linked, "u")
        state = scratch.write(state.groupBy("grp").cogroup(need.groupBy("part")).applyInArrow(_opened, STATE), f"new-{k + 1}")
        scratch.drop(f"beam-{k}")
        k += 1

    def beams(batches):
        for batch in batches:
            if batch.num_rows:
                ids = [np.frombuffer(b, np.int64) for b in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("query").to_numpy(), [len(i) for i in ids])), pa.array(np.concatenate(ids))],
                                                 names=["query", "node"])
    return state.select("query", "ids").mapInArrow(beams, "query long, node long")


def grouped(nodes: DataFrame, dim: int, count: int, group: int = GROUP, seed: int = 2) -> DataFrame:
    """nodes (with x) and grp: nodes on the same side of random hyperplanes, cut at random to some `group` nodes."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / group)))))
    planes = np.random.default_rng(seed).normal(size=(bits, dim)).astype(np.float32)

    def side(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(pa.chunked_array([batch.column("x")]))
                code = (x @ planes.T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int64())], names=[*batch.schema.names, "side"])
    sides = nodes.mapInArrow(side, StructType([*nodes.schema.fields]).add("side", "long"))
    cuts = sides.groupBy("side").agg(F.ceil(F.count("*") / group).alias("cuts"))
    cut = F.xxhash64("side", F.pmod(F.xxhash64("node"), F.col("cuts")))
    return sides.join(cuts, "side").withColumn("grp", cut).drop("side", "cuts")


def nearest(table: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM,
            degree: int = DEGREE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query (a condition on vec_id) holds."""
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.write(vectors_of(table, id_col, vec_col), "rows")
    classes = rows.groupBy("vec").agg(F.min("vec_id").alias("node"))  # equal vectors; partial sums keep a hot one small
    classes = scratch.write(classes.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))), "classes")
    facts = classes.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max(F.size("vec")).alias("d")).first()
    count, top, dim = facts["n"], facts["norm"] or 1.0, facts["d"] or 0
    unit = F.transform("vec", lambda x: (x / F.lit(top)).cast("float"))
    more = F.sqrt(F.greatest(F.lit(1.0) - F.pow(F.col("norm") / F.lit(top), 2), F.lit(0.0))).cast("float")
    nodes = grouped(classes.select("node", "norm", unit.alias("vec"), F.concat(unit, F.array(more)).alias("x")), dim + 1, count)
    nodes = scratch.write(nodes, "nodes")
    graph = build_graph(nodes, dim + 1, count, scratch, degree)
    # every member of a class is a query of its own, but one search serves a class
    members = rows.join(classes.select("vec", "node").hint("merge"), "vec").select("vec_id", "node")
    members = scratch.write(members, "members")
    asked = members.where(is_query).select(F.col("vec_id").alias("query_id"), "node")
    heads = asked.select("node").distinct()
    wanted = scratch.write(heads.join(nodes.hint("merge"), "node").select(F.col("node").alias("query"), "vec", F.array("node").alias("entry")), "queries")
    groups = max(1, -(-wanted.count() // QUERY_GROUP))
    found = search(graph, nodes, wanted.withColumn("grp", F.pmod(F.xxhash64("query"), F.lit(groups))), scratch, entries_of(nodes, scratch), max(beam, 2 * k + 2))
    found = scratch.write(found, "found")
    exact = (found.join(classes.select(F.col("node").alias("query"), F.col("vec").alias("q")).hint("merge"), "query").join(classes.select("node", "vec").hint("merge"), "node")
             .select("query", "node", F.aggregate(F.zip_with("q", "vec", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score")))
    # k + 1 members of a class at most can be an answer beside a query of the class itself
    order = F.row_number().over(W.partitionBy("node").orderBy("vec_id"))
    low = scratch.write(members.withColumn("r", order).where(F.col("r") <= k + 1).select("node", "vec_id"), "low")
    some = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "node"))
    exact = scratch.write(exact.withColumn("r", some).where(F.col("r") <= k + 1).drop("r"), "exact")
    answers = exact.join(low.hint("merge"), "node").select("query", "vec_id", "score")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    answers = scratch.write(answers.withColumn("r", place).where(F.col("r") <= k + 1).groupBy("query")
                            .agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("a")), "answers")  # k + 1 entries each
    mine = asked.join(answers.withColumnRenamed("query", "node").hint("merge"), "node")
    others = F.slice(F.filter("a", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return (mine.select("query_id", F.posexplode(others).alias("p", "e"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "e.vec_id", "e.score"))
