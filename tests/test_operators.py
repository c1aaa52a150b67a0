import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from populi import schema
from populi.functions.dist import compare
from populi.operators import clean, cluster, fuzzy, groups, journey, match, rollup, sample, similarity, tribes, unify, wide


# ---- groups ---------------------------------------------------------------------------------------------------------

def test_describe_equals_numpy(spark):
    rng = np.random.default_rng(2)
    values = {"skew": np.exp(rng.normal(size=3000) * 3) - 5, "equal": np.full(500, 0.25), "few": np.array([3.0, -1.0, 7.5, 7.5]),
              "big": 1e9 + rng.normal(size=1000)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("few", float("nan")), ("few", None)],
                               "k string, v double")
    got = {r["k"]: r for r in groups.describe(df, ["k"], "v", {"q25": .25, "median": .5, "q90": .9}).collect()}
    for k, v in values.items():
        r = got[k]
        assert r["n"] == len(v) and r["min"] == v.min() and r["max"] == v.max()
        assert r["mean"] == pytest.approx(v.mean(), rel=1e-12)
        assert r["std"] == pytest.approx(v.std(), rel=1e-4 if k == "big" else 1e-10, abs=1e-12)
        assert [r["q25"], r["median"], r["q90"]] == pytest.approx(list(np.percentile(v, [25, 50, 90])), rel=1e-12)


def test_ordered_keys_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.integers(-2 ** 63, 2 ** 63, 4000).view(np.float64), rng.normal(size=500), [2.0 ** e for e in range(-1074, 1024, 7)],
                             [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, np.inf, -np.inf, 1 - 2 ** -53, 0.61, 1000.0]])
    values = values[~np.isnan(values)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", groups.ordered_key(F.col("v")).alias("k")).toPandas().sort_values("v")
    bits = rows["v"].abs().to_numpy().view(np.int64)  # the doubles' own bits rise with their size
    assert (rows["k"].to_numpy() == np.where(rows["v"] < 0, -bits, bits)).all()


def test_quantiles_of_constants_and_of_values_close_together(spark):
    rng = np.random.default_rng(9)
    values = {"flat": np.repeat([0.61, 0.62], [9000, 10]), "close": 0.61 + rng.random(5000) * 1e-12, "thousand": 1000 + rng.random(3000) * 1e-3,
              "signs": rng.normal(size=2000), "one": np.array([-3.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    out = groups.describe(df, ["k"], "v", {"q10": .1, "median": .5, "q99": .99})
    for r in out.collect():
        assert [r["q10"], r["median"], r["q99"]] == pytest.approx(list(np.percentile(values[r["k"]], [10, 50, 99])), rel=1e-15, abs=1e-300)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len([line for line in plan.splitlines() if "+- Exchange " in line]) <= 7 and "ReusedExchange" in plan  # one is shared


@pytest.mark.parametrize("hot", ["'hot'", "CAST(NULL AS STRING)"])
def test_ranks_of_hot_keys_and_hot_order_values(spark, hot):
    """One key, or the null key, holds most rows; so does one order value."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("k"), F.col("id") % 50)).otherwise(F.expr(hot)).alias("k"),
                                  F.md5(F.col("id").cast("string")).alias("h"), F.greatest(F.col("id") - 2000, F.lit(0)).alias("p"))
    for order in (["h"], ["p", "id"]):
        got = groups.rank_within(df, ["k"], [F.col(c) for c in order], size="n", weight=F.col("id"), running="w").toPandas()
        got = got.fillna({"k": "-"}).sort_values(["k", *order])
        grouped = got.groupby("k")
        assert (got["rank"] == grouped.cumcount() + 1).all() and (got["w"] == grouped["id"].cumsum()).all()
        assert (got["n"] == grouped["id"].transform("size")).all()
    down = groups.rank_within(df, ["k"], [F.desc("p"), F.asc("id")]).filter("k = 'k0' and rank = 1").first()
    assert down["p"] == df.filter("k = 'k0'").agg(F.max("p")).first()[0]


def test_one_key_and_one_order_value_for_all_rows_make_balanced_parts(spark):
    df = spark.range(40_000).select("id", F.lit("k").alias("k"), F.lit(7).alias("o"))
    sizes = [r["count"] for r in groups.dealt_in_order(df, ["k"], [F.col("o")]).groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8
    got = groups.rank_within(df, ["k"], [F.col("o")], size="n", weight=F.lit(2), running="w")
    assert got.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.min("n"), F.max(F.col("w") - 2 * F.col("rank"))).first()[:] == (40_000, 1, 40_000, 40_000, 0)
    again = groups.rank_within(df.repartition(3), ["k"], [F.col("o")]).withColumnRenamed("rank", "r2")
    assert got.join(again, "id").filter("rank <> r2").count() == 0  # ties go the same way in every run


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = groups.keep_first(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


# ---- samples --------------------------------------------------------------------------------------------------------

def test_split_is_complete_disjoint_and_repeatable(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 300).alias("u"))
    runs = []
    for partitions in (2, 64):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        runs.append(sorted(map(tuple, sample.user_split(df, "u", "id", seed=3).select("id", "u", "split").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert runs[0] == runs[1] and len({r[0] for r in runs[0]}) == 2000
    by_user = {}
    for _, u, s in runs[0]:
        by_user.setdefault(u, []).append(s)
    for splits in by_user.values():
        n, test = len(splits), splits.count("test")
        assert test == (max(1, int(n * 0.2)) if n >= 4 else 0)


def test_leave_one_out_history_against_loop(spark):
    rng = random.Random(4)
    data = [(f"u{u}", i, "w" * rng.randint(0, 9)) for u in range(8) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(data, "u string, i int, t string").withColumn("ts", F.timestamp_seconds(F.col("i")))
    got = {(r["u"], r["i"]): r["history"] for r in sample.leave_one_out_history(df, "u", "ts", "i", "t", budget=20).collect()}
    for u, i, _ in data:
        want, used = [], 0
        for _, _, other in sorted(x for x in data if x[0] == u and x[1] != i):
            used += len(other)
            if used > 20:
                break
            want.append(other)
        assert got[u, i] == [w for w in want if w]


def test_category_targets_add_up(spark):
    counts = spark.createDataFrame([("a", 7), ("b", 2), ("c", 1)], "c string, n long")
    got = {r["c"]: r["target"] for r in sample.category_targets(counts, "c", 5).collect()}
    assert got == {"a": 4, "b": 1, "c": 0}


# ---- matching -------------------------------------------------------------------------------------------------------

def test_match_accounts_for_every_row(spark):
    preds = spark.createDataFrame(
        [(1, "U1", "P ", "Cat", {"a": 1.0}), (2, "", "p", "cat", {"a": 1.0}), (3, "u1", None, "cat", {"a": 1.0}), (4, "u1", "p", "", {"a": 1.0}),
         (5, "u9", "p", "cat", {"a": 1.0}), (6, "u2", "p", "cat", {}), (7, "u3", "p", "cat", {"a": 0.0})],
        "review_key long, user_id string, product_description string, category string, predicted map<string,double>")
    truth = spark.createDataFrame(
        [("u1", "p", "cat", {"b": 1.0}, {"b": .9}, 1), ("u1 ", "P", "CAT", {"a": 1.0}, {"a": .9}, 2), ("u2", "p", "cat", {"a": 1.0}, {}, 3),
         ("u3", "p", "cat", {"a": 1.0}, {}, 4)],
        "user_id string, product_description string, category string, actual map<string,double>, before map<string,double>, pos int")
    matched = match.match_to_truth(preds, truth)
    reasons = {r["review_key"]: r["reason"] for r in matched.collect()}
    assert reasons == {1: None, 2: "missing_user_id", 3: "missing_product_description", 4: "missing_category", 5: "no_ground_truth_match",
                       6: "empty_distributions", 7: "normalization_failed"}
    scored = match.score_matches(matched, 0.65).collect()
    assert len(scored) == 1 and scored[0]["jsd"] == pytest.approx(0) and scored[0]["recall_at_max3k"] == 1.0


def test_classification_merge_against_loop(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    reviews = [(i, pick("u", "v"), pick("x", "y"), pick(None, "p", "q"), pick(None, "r1", "r2")) for i in range(60)]
    tags = [(i, pick("u", "v"), pick("x", "y", "z"), pick(None, "p", "q"), pick(None, None, "r1")) for i in range(12)]
    ddl = "user_id string, review_text string, asin string, review_id string"
    got = match.merge_classifications(spark.createDataFrame(reviews, f"key int, {ddl}"), spark.createDataFrame(tags, f"pos int, {ddl}"), ["pos"], "key")
    by_id = {t[4]: t[0] for t in tags if t[4]}
    for r in got.collect():
        _, u, x, a, rid = next(v for v in reviews if v[0] == r["key"])
        want = by_id.get(rid) if rid in by_id else next((t[0] for t in tags if t[1] == u and t[2] == x and (not a or not t[3] or t[3] == a)), None)
        assert r["pos"] == want and r["review_id"] == rid


def test_hot_text_does_not_multiply(spark):
    rows = spark.range(3000).select(F.col("id").alias("key"), F.lit("u").alias("user_id"), F.lit("same").alias("review_text"),
                                    F.lit(None).cast("string").alias("asin"), F.lit(None).cast("string").alias("review_id"))
    tags = rows.withColumnRenamed("key", "pos")
    assert match.merge_classifications(rows, tags, ["pos"], "key").filter("pos = 0").count() == 3000


def test_best_result_rules(spark):
    part = lambda m, acc, rec, pos: spark.createDataFrame([("u", "p", acc, rec, pos)], "u string, p string, a double, r double, pos int").select("*", F.lit(m).alias("m"))
    make = lambda df, m: unify.to_results(df, m, user=F.col("u"), product=F.col("p"), accuracy=F.col("a"), recall=F.col("r"), extra={"pos": F.col("pos")})
    parts = [make(part("x", 0.0, 0.9, 1), "x"), make(part("y", 0.8, 0.1, 2), "y")]
    pick = lambda keep: unify.best_results(parts, ["user_id", "stimulus_product_id"], "pos", keep).first()["simulation_method"]
    assert (pick("best"), pick("first"), pick("last")) == ("x", "x", "y")


def test_sequence_matches_against_loop(spark):
    names, topics = ["Battery lif", "Screen quality", "the price", "zzz", "life battery"], ["Battery Life", "Quality of Screen", "Price"]

    def similarity_of(a, b):
        x, y = a.strip().lower(), b.strip().lower()
        if x == y:
            return 1.0
        if x in y or y in x:
            return 0.85
        wx, wy = set(x.split()), set(y.split())
        return max(SequenceMatcher(None, x, y).ratio(), len(wx & wy) / len(wx | wy) * 0.9)
    got = {r["theme"]: (r["topic"], r["similarity"]) for r in fuzzy.best_fuzzy(
        spark.createDataFrame([("c", n) for n in names], "category string, theme string"),
        spark.createDataFrame([("c", i, t) for i, t in enumerate(topics)], "category string, pos int, theme string"), 0.5).collect()}
    for n in names:
        best = max(similarity_of(n, t) for t in topics)
        assert (n in got) == (best >= 0.5)
        if n in got:
            assert got[n][1] == pytest.approx(best) and similarity_of(n, got[n][0]) == pytest.approx(best)


# ---- journeys -------------------------------------------------------------------------------------------------------

def plain_best(initial, steps):
    theme, overall, best = initial[0], initial[1], 0
    for it, t, o, p in steps:
        if p is None:
            continue
        if (t is not None and t < theme) or (t is not None and abs(t - theme) < 0.001 and o is not None and o < overall):
            theme, overall, best = t, (o if o is not None else overall), it
    return best, theme, overall


def test_best_step_fold_against_loop(spark):
    rng = random.Random(6)
    near = lambda: rng.choice([None, 0.3, 0.3004, 0.2996, 0.5, rng.random()])
    data = []
    for i in range(300):
        steps = [(k + 1, near(), near(), rng.choice([None, "p"])) for k in range(rng.randint(0, 12))]
        data.append((i, (0, rng.choice([0.3, 0.6]), rng.choice([0.3, 0.6]), "p0"), steps))
    s = "struct<iteration:int,theme:double,overall:double,prediction:string>"
    df = spark.createDataFrame(data, f"i int, initial {s}, steps array<{s}>")
    got = {r["i"]: r["b"] for r in df.select("i", journey.best_by_theme(F.col("initial"), F.col("steps")).alias("b")).collect()}
    for i, initial, steps in data:
        assert (got[i].iteration, got[i].theme, got[i].overall) == plain_best(initial[1:3], steps)


def test_running_best_of_all_or_of_stated_iterations_and_fills(spark):
    long = spark.createDataFrame([("r", 0, None), ("r", 2, .5), ("r", 4, .7), ("r", 13, .1)], "k string, iteration int, theme double")
    nested = journey.nest_steps(long, ["k"], ["theme"])
    grid = lambda **o: [r["theme"] for r in journey.dense_grid(nested, ["k"], ["theme"], **o).orderBy("iteration").collect()]
    assert grid() == [None, None] + [.5] * 11 + [.1] and grid(last=12) == [None, None] + [.5] * 11
    assert journey.dense_grid(nested, ["k"], ["theme"], fill=0.0).filter("theme = 0").count() == 2


def test_improvement_rules(spark):
    df = spark.createDataFrame([(0.5, 0.25), (0.0, 0.3), (0.0, 0.0), (None, 0.1)], "x double, y double")
    got = df.select(rollup.lower_is_better_pct(F.col("x"), F.col("y")), rollup.higher_is_better_pct(F.col("x"), F.col("y")),
                    rollup.composite_score(F.col("x"), F.col("y"), F.lit(None).cast("double"), F.lit(None).cast("double"))).collect()
    assert [tuple(r)[:2] for r in got] == [(50.0, -50.0), (0.0, 1000.0), (0.0, 0.0), (None, None)]
    assert got[0][2] == pytest.approx(0.375) and got[3][2] == pytest.approx(0.1)


# ---- vectors --------------------------------------------------------------------------------------------------------

def vectors(n, d, seed, spread=0.35, centers=6):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, d))
    return (c[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, d))).round(3)


@pytest.mark.parametrize("threshold,block", [(0.8, 7), (0.95, 1000)])
def test_similarity_join_is_exact(spark, threshold, block):
    x = vectors(150, 8, 7)
    x[100:140] = x[3]  # a large group of copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T).round(12) >= threshold).sum(axis=1) - 1
    got = {r["id"]: r["neighbours"] for r in similarity.neighbour_counts(df, "id", "v", threshold, pivots=9, block=block).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_similar_rows_are_paired_with_their_copies(spark):
    x = vectors(60, 8, 7)
    x[50:53] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9 - 1e-12
    got = sorted((r["a"], r["b"]) for r in similarity.row_pairs(df, "id", "v", 0.9, block=20).collect())
    assert got == [(i, j) for i in range(60) for j in range(i + 1, 60) if near[i, j]] and (50, 51) in got


def test_similarity_join_sends_a_row_to_few_tasks(spark):
    """Vectors without clusters: no two cells are far apart, so every block meets every other."""
    x = np.random.default_rng(5).normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    tasks = similarity._tasks(similarity.distinct_vectors(df, "id", "v"), 0.8, None, 500, None)
    assert tasks.count() <= 3000 * (2 * 3000 / 500 + 1)  # blocks are twice as many as full ones, at most


def plain_tribes(unit, reviews, rule, processed, counter):
    out, n = [], len(unit)
    for i in range(n):
        if i in processed:
            continue
        s = (unit @ unit[i]).round(12)
        found = [j for j in range(n) if s[j] >= rule.threshold and j not in processed]
        if len(found) > rule.max_users:
            found = sorted(found, key=lambda j: -s[j])[:rule.max_users]
        if len(found) < rule.min_users or sum(reviews[j] for j in found) < rule.min_reviews:
            processed.add(i)
            continue
        out.append((counter, frozenset(found)))
        processed.update(found)
        counter += 1
        done = len(processed) >= n if rule.is_relaxed else (len(processed) / n >= rule.coverage_goal and counter >= rule.min_tribes)
        if done:
            break
    return out, counter


@pytest.mark.parametrize("rule,options", [
    (tribes.TribeRule(0.8, 2, 6, 5, 0.6, 1), {"block": 16}),
    (tribes.TribeRule(0.9, 1, 30, 5), {}),
    (tribes.TribeRule(0.7, 3, 4, 9, 0.5, 3), {"pivots": 3}),
])
def test_tribes_equal_the_sequential_rule(spark, rule, options):
    data, want = [], set()
    rng = random.Random(8)
    for segment in ("segment_0", "segment_1"):
        x = vectors(90, 6, len(data) + 9)
        x[50:60] = x[0]
        reviews = [rng.randint(0, 4) for _ in range(len(x))]
        data += [(f"{segment}-{i}", segment, i, v.tolist(), r) for i, (v, r) in enumerate(zip(x, reviews))]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        done = set()
        main, counter = plain_tribes(unit, reviews, rule, done, 0)
        relaxed, _ = plain_tribes(unit, reviews, rule.relaxed(), done, counter)
        want |= {(f"{segment}_micro_{c}", frozenset(f"{segment}-{j}" for j in m)) for c, m in main}
        want |= {(f"{segment}_relaxed_micro_{c}", frozenset(f"{segment}-{j}" for j in m)) for c, m in relaxed}
    users = spark.createDataFrame(data, "user_id string, segment_id string, position long, user_embedding array<double>, n_reviews long")
    got = {}
    for r in tribes.form_tribes(users, rule, **options).collect():
        got.setdefault(r["tribe_id"], set()).add(r["user_id"])
    assert {(t, frozenset(m)) for t, m in got.items()} == want


def test_tribes_of_a_dense_segment_take_few_rounds(spark, monkeypatch):
    """2,000 users who are all near each other: the rule one by one would be a round for each of 67 seeds."""
    rng = np.random.default_rng(7)
    units = rng.normal(size=(1, 8)) + rng.normal(size=(2000, 8)) * 0.05
    units /= np.linalg.norm(units, axis=1)[:, None]
    users = spark.createDataFrame([(f"u{i}", "s", i, [float(x) for x in u], 3) for i, u in enumerate(units)],
                                  "user_id string, segment_id string, position long, user_embedding array<double>, n_reviews long")
    rounds = []
    for name in ("_seeds_apart", "_seeds_ahead"):
        played = getattr(tribes, name)
        monkeypatch.setattr(tribes, name, lambda *a, played=played: rounds.append(1) or played(*a))
    rule = tribes.TribeRule(0.8, 1, 30, 5)
    got = {}
    for r in tribes.form_tribes(users, rule).collect():
        got.setdefault(r["tribe_id"], set()).add(int(r["user_id"][1:]))
    similarity, open_to, want = np.round(units @ units.T, 12), list(range(2000)), []
    while open_to:
        seed = open_to[0]
        taken = sorted(open_to, key=lambda v: (-similarity[seed, v], v))[:30]
        want.append(set(taken))
        open_to = [v for v in open_to if v not in want[-1]]
    assert similarity.min() >= 0.8 and sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert len(rounds) <= 10


def dense_users(spark, n, seed):
    rng = np.random.default_rng(seed)
    units = rng.normal(size=(1, 8)) + rng.normal(size=(n, 8)) * rng.choice([0.05, 0.4, 2.0], size=(n, 1))
    units /= np.linalg.norm(units, axis=1)[:, None]
    return spark.createDataFrame([(f"u{i}", "s", i, [float(x) for x in u], 1 + i % 3) for i, u in enumerate(units)],
                                 "user_id string, segment_id string, position long, user_embedding array<double>, n_reviews long")


def test_tribes_of_a_dense_segment_make_no_links(spark, monkeypatch):
    """Nearly all pairs of the segment are links: a table of them would grow with its square."""
    users = dense_users(spark, 250, 3)
    rule = tribes.TribeRule(0.6, 2, 7, 5, 0.8, 1)
    tell = lambda df: sorted((r["tribe_id"], r["user_id"], round(r["similarity_score"], 9)) for r in df.collect())
    want = tell(tribes.form_tribes(users, rule, block=100))
    monkeypatch.setattr(tribes, "similar_pairs", lambda *a, **k: pytest.fail("links were made"))
    assert tell(tribes.form_tribes(users, rule)) == want
    monkeypatch.setattr(tribes, "BIN", 16)  # more rounds, more blocks, and lists that are used up
    monkeypatch.setattr(tribes, "DEEP", 2)
    monkeypatch.setattr(tribes, "BLOCK", 90)
    assert tell(tribes.form_tribes(users, rule)) == want


def test_large_segments_with_few_links_use_them(spark, monkeypatch):
    """The segment of few neighbours goes by links, the dense one without."""
    x = np.random.default_rng(4).normal(size=(150, 16))
    sparse = spark.createDataFrame([(f"v{i}", "few", i, v.tolist(), 2) for i, v in enumerate(x)], dense_users(spark, 1, 1).schema)
    users = dense_users(spark, 150, 6).unionByName(sparse)
    rule = tribes.TribeRule(0.6, 1, 12, 2)
    tell = lambda df: sorted((r["tribe_id"], r["user_id"]) for r in df.collect())
    want = tell(tribes.form_tribes(users, rule))
    monkeypatch.setattr(tribes, "LARGE", 100)
    linked, made = [], tribes.vector_links
    monkeypatch.setattr(tribes, "vector_links", lambda users, *a, **k: linked.append({r[0] for r in users.select("segment_id").distinct().collect()}) or made(users, *a, **k))
    assert tell(tribes.form_tribes(users, rule)) == want and linked[0] == {"few"}


def test_tribe_caps(spark):
    members = spark.createDataFrame([("t", "a", 0), ("t", "b", 1), ("t", "c", 2)], "tribe_id string, user_id string, position long")
    reviews = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(4)], "user_id string, pos long")
    kept = [(r["user_id"], r["pos"]) for r in tribes.tribe_reviews(members, reviews, "pos", limit=6).orderBy("review_no").collect()]
    assert kept == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]
    texts = spark.createDataFrame([("a", "x" * 3000), ("b", "y" * 10), ("c", " ")], "user_id string, summary string")
    got = {r["user_id"]: r["summary"] for r in tribes.tribe_summaries(members, texts, each=2000, total=50_000).collect()}
    assert len(got["a"]) == 2003 and got["b"] == "y" * 10 and "c" not in got


def test_memory_of_tribes_and_clusters(spark):
    """Tribes of one name in two clusters stay apart, in batch order; members and memory are dealt once, by cluster and user."""
    rows = spark.createDataFrame([("c1", "m0", "u", 2, 0, "b"), ("c1", "m0", "u", 1, 0, "a"), ("c2", "m0", "u", 1, 0, "z"), ("c1", "m2", "u", 0, 0, "c"),
                                  (None, "m0", "u", 1, 0, "n")], "cluster_id string, tribe_id string, user_id string, batch int, i int, analysis string")
    members = spark.createDataFrame([("c1", "m0", "u", {"k": 1}), ("c2", "m0", "u", None), ("c1", "m1", "u", None), ("c1", "m0", "v", None), ("c3", "m0", "u", None), ("c1", "m1", "u", None)],
                                    "cluster_id string, tribe_id string, user_id string, more map<string,int>")
    found = match.memory_for(members, rows)
    got = sorted(((r["cluster_id"], r["tribe_id"], r["user_id"]), r["analyses"], r["memory_level"], r["tribe_has_memory"], r["more"]) for r in found.collect())
    assert got == [(("c1", "m0", "u"), ["a", "b"], "tribe", True, {"k": 1}), (("c1", "m0", "v"), None, None, True, None), (("c1", "m1", "u"), ["a", "b", "c"], "cluster", False, None),
                   (("c1", "m1", "u"), ["a", "b", "c"], "cluster", False, None), (("c2", "m0", "u"), ["z"], "tribe", True, None), (("c3", "m0", "u"), None, None, False, None)]
    above = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("REPARTITION_BY_COL")
    assert len(above) == 2 and "Join" not in above[0] and "Exchange" in above[0]


def test_choose_k():
    results = [{"k": 2, "silhouette": .5, "balance_ratio": .5}, {"k": 3, "silhouette": .45, "balance_ratio": .2}, {"k": 4, "silhouette": .5, "balance_ratio": .01}]
    assert cluster.choose_k(results, 3)["k"] == 3 and cluster.choose_k(results, 4)["k"] == 2 and cluster.choose_k(results)["k"] == 2


# ---- long form, rules, cleaning -------------------------------------------------------------------------------------

def test_long_and_map_forms_agree(spark):
    data = [("a", f"t{i}", float(i), float(9 - i) if i % 2 else None) for i in range(1, 9)]
    long = spark.createDataFrame(data, "k string, t string, x double, y double")
    r = wide.compare_long(long, "k", "t", "x", "y").first()
    m = wide.theme_map(long, "k", "t", x="x", y="y").select(compare(F.col("x"), F.col("y")).alias("c")).first()["c"]
    assert (r["jsd"], r["wd"], r["support"]) == (pytest.approx(m.jsd), pytest.approx(m.wd), m.support)


def test_rules_split_rows_and_lose_none(spark):
    df = spark.createDataFrame([("u", [1.0, 2.0], 2), ("u", [1.0], 2), ("", [], 0), (None, None, None)],
                               "user_id string, user_embedding array<double>, embedding_dimension int")
    good, bad = schema.valid_and_rejected(df, "user_embedding")
    assert good.count() == 1 and bad.count() == 3
    assert set(bad.filter("user_id = ''").first()["broken_rules"]) == {"user_id_present", "embedding_not_empty"}
    with pytest.raises(ValueError):
        schema.validate(df, "nothing")


def test_every_rule_table_parses(spark):
    parser = spark._jsparkSession.sessionState().sqlParser()
    assert len(schema.RULES) >= 14
    for rules in schema.RULES.values():
        assert len({name for name, _ in rules}) == len(rules)
        for _, test in rules:
            assert parser.parseExpression(test) is not None


def test_strict_required_map_fails_the_job(spark):
    df = spark.createDataFrame([({"a": 1.0},), ({},)], "m map<string,double>")
    assert clean.require_themes(df, "m").filter("reason is not null").count() == 1
    with pytest.raises(Exception, match="must not be empty"):
        clean.require_themes(df, "m", strict=True).collect()


def test_costs_of_known_and_unknown_models(spark):
    calls = spark.createDataFrame([("o3-mini", "a", 1_000_000, 0, 0), ("GPT-5.2", "a", 0, 1_000_000, 0), ("other", "b", 5, 5, 5)],
                                  "model string, call_type string, input_tokens long, output_tokens long, cached_input_tokens long")
    got = {(r["model"], r["call_type"]): r["cost"] for r in rollup.usage_costs(calls).collect()}
    assert got["o3", "a"] == 2.0 and got["gpt-5.2", "a"] == 14.0 and got["other", "b"] == 0.0 and got["ALL", "ALL"] == 16.0
