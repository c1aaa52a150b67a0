"""Greedy micro-clusters ("tribes") inside each segment, formed in parallel rounds.

The rule: the lowest undecided position is the next seed; its members are the undecided users with cosine at or above
the threshold, the most similar max_users of them (earlier positions first); the tribe stands if it has enough users and
reviews, else the seed alone is decided. What a seed takes depends only on earlier seeds within two steps of it, so in
each round every undecided user that is lower than all undecided users within two steps is a seed at once: their
neighbourhoods do not meet, and the outcome is that of the rule one by one. A goal of coverage cuts the sequence of
seeds afterwards, where running sums in seed order reach it.

Where a segment is dense such seeds are few, as nearly all wait for each other, and the links would be nearly all of its
pairs. Then a round looks ahead instead, without links: the k lowest undecided users of a segment meet its undecided
vectors block by block, each keeps a list of its nearest, and one task plays the lists in order. The j-th user needs its
j * max_users nearest at most, as no more are taken before it; lists end at DEEP * max_users, and the play stops, to go on
in the next round, at a user whose list is used up though it was cut. k follows the share of users that a round decides.

Links are made only for segments of more than LARGE users that have few of them (LINKS a user, as a sample shows), by the
metric similarity join over distinct vectors of a segment; copies of a vector are held together and never paired. What a
round leaves is written in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from populi.functions.base import present, unit_hash
from populi.functions.dist import unit_vector
from populi.operators.groups import keep_top, rank_within
from populi.operators.similarity import TILE, similar_pairs
from populi.session import written


LEAST_AHEAD, MOST_AHEAD = 32, 4096  # undecided users of a segment that one task plays in order
DEEP = 16  # a list has so many times max_users rows at most
MOST_ROWS = 1 << 20  # rows of a segment's lists
BIN = 256  # neighbouring positions that are seeds in the same round
BLOCK = 16_000  # vectors of a block: 8 MB at 64 dimensions
LARGE, LINKS, SAMPLE = 20_000, 32, 64  # users of a segment from which links can pay, links a user up to which they do, users sampled


@dataclass(frozen=True)
class TribeRule:
    threshold: float = 0.8
    min_users: int = 1
    max_users: int = 30
    min_reviews: int = 5
    coverage_goal: float = 1.0
    min_tribes: int = 0
    is_relaxed: bool = False

    def relaxed(self) -> TribeRule:
        """The second pass: looser, and bound to run until everyone is decided."""
        return replace(self, threshold=max(0.5, self.threshold - 0.15), min_users=max(2, self.min_users - 2),
                       max_users=self.max_users + 10, min_reviews=max(2, self.min_reviews - 2), is_relaxed=True)


def vector_links(users: DataFrame, threshold: float, **options: int) -> tuple[DataFrame, DataFrame]:
    """(users with rep, links a, b, similarity both ways and of each rep to itself). users: segment_id, unit and more."""
    reps = written(users.groupBy("segment_id", "unit").agg(F.count(F.lit(1)).alias("copies"))
                   .withColumn("rep", F.monotonically_increasing_id()))
    pairs = written(similar_pairs(reps, threshold, within="segment_id", **options))
    links = (pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
             .unionByName(reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))))
    return users.join(reps.drop("copies"), ["segment_id", "unit"]), links


def _seeds_apart(undecided: DataFrame, live: DataFrame, rule: TribeRule) -> DataFrame:
    """What the seeds take that are lower than all undecided users within two steps."""
    low = undecided.groupBy("rep").agg(F.min("position").alias("low"))
    near = live.join(low.select(F.col("rep").alias("b"), "low"), "b").groupBy("a").agg(F.min("low").alias("low"))
    near = written(near)
    far = live.join(near.select(F.col("a").alias("b"), "low"), "b").groupBy("a").agg(F.min("low").alias("low"))
    seeds = (undecided.join(far.withColumnRenamed("a", "rep"), "rep").filter(F.col("position") == F.col("low"))
             .select(F.col("rep").alias("a"), F.col("position").alias("seed")))
    # of one vector's copies no more than max_users can be members
    offered = keep_top(undecided.drop("unit"), ["rep"], [F.col("position")], rule.max_users)
    found = live.join(seeds, "a").join(offered.withColumnRenamed("rep", "b"), "b")
    best = keep_top(found, ["a"], [F.col("similarity").desc(), F.col("position")], rule.max_users)
    sums = best.groupBy("a").agg(F.count(F.lit(1)).alias("__n"), F.sum("n_reviews").alias("__r"))
    stands = (F.col("__n") >= max(1, rule.min_users)) & (F.col("__r") >= rule.min_reviews)
    return (best.join(sums, "a").withColumn("stands", stands).filter(F.col("stands") | (F.col("position") == F.col("seed")))
            .select("segment_id", "seed", "position", F.when(F.col("stands"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")))
                    .alias("similarity"), "stands"))


def _lists(users: DataFrame, seeds: DataFrame, rule: TribeRule) -> DataFrame:
    """(segment_id, turn, seed, position, n_reviews, similarity): the min(turn, DEEP) * max_users nearest users of each seed.

    users: segment_id, position, n_reviews, unit, blocks (of the segment); seeds: segment_id, turn, seed, unit, blocks."""
    def nearest(key: tuple, block: pa.Table, asking: pa.Table) -> pa.Table:
        names, out = ["segment_id", "turn", "seed", "position", "n_reviews", "similarity"], []
        vectors = lambda column: column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)
        position = block.column("position").to_numpy()
        order = np.argsort(position)
        position, reviews = position[order], block.column("n_reviews").to_numpy()[order]
        turn, seed = asking.column("turn").to_numpy(), asking.column("seed").to_numpy()
        if len(position) and len(seed):
            units, own = vectors(block.column("unit"))[order].T, vectors(asking.column("own"))
            step = max(1, TILE // len(position))
            for at in range(0, len(seed), step):
                for i, similarity in enumerate(own[at:at + step] @ units, at):
                    found = np.flatnonzero((similarity >= rule.threshold - 1e-9) | (position == seed[i]))
                    s = np.where(position[found] == seed[i], 1.0, similarity[found].round(12))
                    found, s = found[s >= rule.threshold], s[s >= rule.threshold]
                    most = min(turn[i], DEEP) * rule.max_users
                    if len(found) > most:
                        low = np.partition(s, len(s) - most)[len(s) - most]
                        found, s = found[s >= low], s[s >= low]
                        best = np.argsort(-s, kind="stable")[:most]
                        found, s = found[best], s[best]
                    out.append((np.full(len(found), i), position[found], reviews[found], s))
        which, *cells = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(which), asking.schema.field("of").type), pa.array(turn[which], pa.int32()), pa.array(seed[which], pa.int64()),
                                     *(pa.array(c) for c in cells)], names=names)
    kind = users.schema["segment_id"].dataType.simpleString()
    blocked = users.withColumn("blk", F.pmod(F.xxhash64("position"), "blocks")).drop("blocks")
    asking = seeds.select(F.col("segment_id").alias("of"), "turn", "seed", F.col("unit").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at"))
    found = blocked.groupBy("segment_id", "blk").cogroup(asking.groupBy("of", "at")).applyInArrow(
        nearest, f"segment_id {kind}, turn int, seed long, position long, n_reviews long, similarity double")
    return keep_top(found, ["segment_id", "seed"], [F.col("similarity").desc(), F.col("position")], F.least("turn", F.lit(DEEP)) * rule.max_users)


def _seeds_ahead(undecided: DataFrame, state: DataFrame, rule: TribeRule, share: float) -> DataFrame:
    """What the lowest undecided users of each segment, so large a share of it, take one after the other.

    undecided: segment_id, position, bin, n_reviews, unit. state: segment_id, total, done, formed; both are given back as they
    are after the round, with last (the segment reached its goal) and short (a cut list was used up)."""
    most = max(LEAST_AHEAD, min(MOST_AHEAD, MOST_ROWS // (DEEP * rule.max_users)))
    segment = Window.partitionBy("segment_id")  # a row for each bin
    bins = undecided.groupBy("segment_id", "bin").agg(F.count(F.lit(1)).alias("n")).select(
        "segment_id", "bin", F.sum("n").over(segment).alias("n"),
        (F.sum("n").over(segment.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    wanted = F.least(F.lit(most), F.greatest(F.lit(LEAST_AHEAD), F.ceil(F.col("n") * F.lit(share))))
    upto = bins.groupBy("segment_id").agg(F.max(F.when(F.col("before") < wanted, F.col("bin"))).alias("upto"), F.ceil(F.max("n") / F.lit(BLOCK)).alias("blocks"))
    users = undecided.join(upto, "segment_id")
    order = Window.partitionBy("segment_id").orderBy("position")  # of the seeds only
    seeds = users.filter(F.col("bin") <= F.col("upto")).select("segment_id", F.row_number().over(order).alias("turn"), F.col("position").alias("seed"), "unit", "blocks")
    lists = _lists(users.select("segment_id", "position", "n_reviews", "unit", "blocks"), seeds, rule)

    def play(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "similarity", "position"], ascending=[True, False, True])
        turn, seeds, position, reviews, near = (rows[c].to_numpy().tolist() for c in ("turn", "seed", "position", "n_reviews", "similarity"))
        total, done, formed = (int(rows[c].iloc[0]) for c in ("total", "done", "formed"))
        starts = np.flatnonzero(np.diff(rows["turn"].to_numpy(), prepend=-1)).tolist()
        taken, out, last, short = set(), [], False, False
        for a, b in zip(starts, [*starts[1:], len(turn)]):
            if seeds[a] in taken:
                continue
            open_to = [i for i in range(a, b) if position[i] not in taken][:rule.max_users]
            short = len(open_to) < rule.max_users and b - a == min(turn[a], DEEP) * rule.max_users
            if short:
                break
            stands = len(open_to) >= max(1, rule.min_users) and sum(reviews[i] for i in open_to) >= rule.min_reviews
            if not stands:
                open_to = [i for i in open_to if position[i] == seeds[a]]
            taken.update(position[i] for i in open_to)
            out += [(seeds[a], position[i], max(0.0, min(1.0, near[i])) if stands else None, stands) for i in open_to]
            done, formed = done + len(open_to), formed + stands
            last = stands and (done >= total if rule.is_relaxed else done / total >= rule.coverage_goal and formed >= rule.min_tribes)
            if last:
                break
        settled = pd.DataFrame(out, columns=["seed", "position", "similarity", "stands"])
        settled["similarity"] = settled["similarity"].astype(object).where(settled["similarity"].notna(), None)
        return settled.assign(segment_id=rows["segment_id"].iloc[0], total=total, done=done, formed=formed, last=last, short=short)
    kind = undecided.schema["segment_id"].dataType.simpleString()
    return lists.join(state, "segment_id").groupBy("segment_id").applyInPandas(
        play, f"segment_id {kind}, seed long, position long, similarity double, stands boolean, total long, done long, formed long, last boolean, short boolean")


DECIDED = ["segment_id", "seed", "position", "similarity", "stands"]


def seeds_in_order(users: DataFrame, totals: DataFrame, rule: TribeRule) -> DataFrame:
    """DECIDED of everyone the rule decides up to the goal of a segment, without links. users: segment_id, position, bin, n_reviews, unit.

    totals: segment_id, total, done, start as in `numbered`."""
    undecided, state = written(users), totals.select("segment_id", "total", "done", F.col("start").alias("formed"))
    decided: list[DataFrame] = []
    share = 0.5 / rule.max_users
    left = undecided.count()
    while left:
        settled = written(_seeds_ahead(undecided, state, rule, share))
        decided.append(settled.select(*DECIDED))
        round_ = settled.agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("short")).first()
        share = share / 2 if round_["short"] else min(1.0, share * max(0.5, min(4.0, 0.5 * left / round_["n"])))
        state = settled.groupBy("segment_id").agg(*[F.max(c).alias(c) for c in ("total", "done", "formed")])
        ended = settled.filter("last").select("segment_id").distinct()
        undecided = written(undecided.join(settled.select("segment_id", "position"), ["segment_id", "position"], "left_anti").join(ended, "segment_id", "left_anti"))
        left = undecided.count()
    return _union(decided) if decided else _none(users)


def all_seeds(users: DataFrame, links: DataFrame, rule: TribeRule) -> DataFrame:
    """DECIDED of everyone the rule decides when nothing stops it; where seeds apart get few, the rest goes in order.

    users: segment_id, position, bin, n_reviews, unit, rep; links as vector_links gives them."""
    undecided, live = written(users), written(links)
    totals = undecided.groupBy("segment_id").agg(F.count(F.lit(1)).alias("total"), *[F.lit(0).cast("long").alias(c) for c in ("done", "start")])
    fewest = LEAST_AHEAD * undecided.select("segment_id").distinct().count()
    decided: list[DataFrame] = []
    while not undecided.isEmpty():
        settled = written(_seeds_apart(undecided, live, rule))
        decided.append(settled.select(*DECIDED))
        undecided = written(undecided.join(settled.select("segment_id", "position"), ["segment_id", "position"], "left_anti"))
        if settled.count() < fewest:
            endless = replace(rule, coverage_goal=2.0, is_relaxed=False)
            decided.append(seeds_in_order(undecided.drop("rep"), totals, endless))
            break
        left = undecided.select("rep").distinct()
        live = written(live.join(left.withColumnRenamed("rep", "a"), "a", "left_semi").join(left.withColumnRenamed("rep", "b"), "b", "left_semi"))
    return _union(decided) if decided else _none(users)


def _none(users: DataFrame) -> DataFrame:
    return users.select("segment_id", F.col("position").alias("seed"), "position", F.lit(0.0).alias("similarity"), F.lit(False).alias("stands")).limit(0)


def _with_few_links(users: DataFrame, rule: TribeRule) -> DataFrame:
    """The large segments whose users have few neighbours, as some of each show."""
    sizes = users.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE)
    held = users.join(sizes.select("segment_id", F.ceil(F.col("n") / F.lit(BLOCK)).alias("blocks")), "segment_id")
    seeds = keep_top(held, ["segment_id"], [unit_hash(F.col("position")), F.col("position")], SAMPLE).select(
        "segment_id", F.lit(DEEP).alias("turn"), F.col("position").alias("seed"), "unit", "blocks")
    found = _lists(held.select("segment_id", "position", "n_reviews", "unit", "blocks"), seeds, rule)
    return found.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= LINKS * SAMPLE).select("segment_id")


def _pass(users: DataFrame, totals: DataFrame, rule: TribeRule, **options: int) -> DataFrame:
    """DECIDED of one pass: by links where these are few (or on request, where options tell how to find them), else in order."""
    largest = users.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if options:
        return all_seeds(*vector_links(users, rule.threshold, **options), rule)
    if largest <= LARGE:
        return seeds_in_order(users, totals, rule)
    few = written(_with_few_links(users, rule))
    by_links = all_seeds(*vector_links(users.join(few, "segment_id"), rule.threshold), rule)
    return by_links.unionByName(seeds_in_order(users.join(few, "segment_id", "left_anti"), totals, rule))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numbered(decided: DataFrame, totals: DataFrame, rule: TribeRule) -> DataFrame:
    """decided with tribe_no (null: refused), up to the seed at which its segment reaches the goal.

    totals: segment_id, total (all users of the segment), done (decided before), start (tribes before)."""
    seeds = decided.groupBy("segment_id", "seed").agg(F.count(F.lit(1)).alias("n"), F.first("stands").alias("stands"))
    sums = rank_within(seeds, ["segment_id"], [F.col("seed")], rank="__k", weight=F.col("n"), running="upto")
    sums = rank_within(sums, ["segment_id"], [F.col("seed")], rank="__k", weight=F.col("stands").cast("long"), running="formed")
    sums = sums.join(totals, "segment_id").withColumns({"upto": F.col("upto") + F.col("done"), "formed": F.col("formed") + F.col("start")})
    over = (F.col("upto") >= F.col("total") if rule.is_relaxed else
            (F.col("upto") / F.col("total") >= rule.coverage_goal) & (F.col("formed") >= rule.min_tribes))
    stop = sums.filter(over & F.col("stands")).groupBy("segment_id").agg(F.min("seed").alias("stop"))
    kept = sums.join(stop, "segment_id", "left").filter(F.col("stop").isNull() | (F.col("seed") <= F.col("stop")))
    number = F.when(F.col("stands"), F.col("formed") - 1).alias("tribe_no")
    return decided.drop("stands").join(kept.select("segment_id", "seed", number), ["segment_id", "seed"])


def form_tribes(users: DataFrame, rule: TribeRule | None = None, **options: int) -> DataFrame:
    """Tribe of every user that gets one: main pass, then the relaxed pass over whoever is left undecided.

    users: user_id, segment_id, position (unique in a segment), user_embedding, n_reviews."""
    rule = rule or TribeRule()
    prepared = users.select("user_id", "segment_id", F.col("position").cast("long").alias("position"),
                            unit_vector(F.col("user_embedding")).alias("unit"),
                            F.col("n_reviews").cast("long").alias("n_reviews")).filter(F.col("unit").isNotNull())
    prepared = written(rank_within(prepared.filter(F.col("segment_id").isNotNull()), ["segment_id"], [F.col("position")], rank="bin")
                       .withColumn("bin", F.floor(F.col("bin") / F.lit(BIN))))
    totals = prepared.groupBy("segment_id").agg(F.count(F.lit(1)).alias("total")).withColumns(
        {"done": F.lit(0).cast("long"), "start": F.lit(0).cast("long")})
    main = written(numbered(_pass(prepared.drop("user_id"), totals, rule, **options), totals, rule))
    rest = prepared.drop("user_id").join(main.select("segment_id", "position"), ["segment_id", "position"], "left_anti")
    so_far = main.groupBy("segment_id").agg(F.count(F.lit(1)).alias("done"), F.coalesce(F.max("tribe_no") + 1, F.lit(0)).alias("start"))
    so_far = totals.select("segment_id", "total").join(so_far, "segment_id")
    again = numbered(_pass(written(rest), so_far, rule.relaxed(), **options), so_far, rule.relaxed())
    both = main.withColumn("relaxed", F.lit(False)).unionByName(again.withColumn("relaxed", F.lit(True)))
    members = (both.filter(F.col("tribe_no").isNotNull()).join(prepared.drop("unit", "bin"), ["segment_id", "position"])
               .withColumn("tribe_id", F.concat("segment_id", F.when(F.col("relaxed"), "_relaxed_micro_")
                                                .otherwise("_micro_"), "tribe_no")))
    sums = members.groupBy("tribe_id").agg(F.count(F.lit(1)).alias("total_users"), F.sum("n_reviews").alias("total_reviews"))
    return (members.join(sums, "tribe_id")
            .select("user_id", "segment_id", "tribe_id", F.col("similarity").alias("similarity_score"), "position",
                    "total_users", "total_reviews", F.col("relaxed").alias("relaxed_criteria")))


def tribe_reviews(members: DataFrame, reviews: DataFrame, position: str, limit: int | None = None) -> DataFrame:
    """A tribe's reviews in member and review order, with review_no; on request the first `limit` of them."""
    joined = members.select("tribe_id", "user_id", F.col("position").alias("__member")).join(reviews, "user_id")
    ranked = rank_within(joined, ["tribe_id"], [F.col("__member"), F.col(position)], rank="review_no").drop("__member")
    return ranked if limit is None else ranked.filter(F.col("review_no") <= limit)


def tribe_summaries(members: DataFrame, summaries: DataFrame, each: int | None = None, total: int | None = None) -> DataFrame:
    """Members' summaries in member order; on request each cut at a length, and none after a total is reached.

    A tribe has at most max_users members, so its window is small."""
    text = F.col("summary")
    if each is not None:
        text = F.when(F.length(text) > each, F.concat(F.substring(text, 1, each), F.lit("..."))).otherwise(text)
    kept = members.join(summaries, "user_id").filter(present(F.col("summary"))).withColumn("summary", text)
    if total is None:
        return kept
    before = Window.partitionBy("tribe_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return (kept.withColumn("__before", F.coalesce(F.sum(F.length("summary")).over(before), F.lit(0)))
            .filter(F.col("__before") < total).drop("__before"))
