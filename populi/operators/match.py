"""Matching joins: every lookup side has one row per key before it is joined, so no join multiplies rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from populi.functions.base import blank, non_empty, present
from populi.functions.dist import compare, total
from populi.functions.recall import ranked, recall_at_max_nk
from populi.functions.text import fold, match_key, topic_file_category, without_copy_suffix
from populi.operators.groups import keep_first, keep_last
from populi.session import written


def spread_key(key: Column, usable: Column, spread_by: Column) -> Column:
    """The key where it is usable, else a value that matches nothing and spreads such rows over all tasks."""
    return F.when(usable, key).otherwise(F.concat(F.lit("\u0001"), F.xxhash64(spread_by).cast("string")))


def match_to_truth(predictions: DataFrame, truth: DataFrame, position: str = "pos") -> DataFrame:
    """Left join of predictions to ground truth on (user, product, category), each row with a reason or none.

    predictions: user_id, product_description, category, predicted map, and a unique key `review_key`.
    truth: the same three key columns, actual map, before map, and `position`; the last row of a key wins."""
    key = lambda: match_key(F.col("user_id"), F.col("product_description"), F.col("category"))
    known = (keep_last(truth.withColumn("match_key", key()), ["match_key"], position)
             .drop("user_id", "product_description", "category", position))
    incomplete = (F.when(F.coalesce("user_id", F.lit("")) == "", "missing_user_id")
                  .when(F.coalesce("product_description", F.lit("")) == "", "missing_product_description")
                  .when(F.coalesce("category", F.lit("")) == "", "missing_category"))
    joined = (predictions.withColumn("__incomplete", incomplete)
              .withColumn("match_key", spread_key(key(), F.col("__incomplete").isNull(), F.col("review_key")))
              .join(known.withColumn("__found", F.lit(True)), "match_key", "left"))
    no_mass = lambda m: total(F.col(m)) == 0
    no_value = lambda m: F.size(F.map_filter(F.col(m), lambda _, v: v.isNotNull())) == 0
    not_finite = lambda m: F.exists(F.map_values(m), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    reason = (F.when(F.col("__incomplete").isNotNull(), F.col("__incomplete"))
              .when(F.col("__found").isNull(), "no_ground_truth_match")
              .when(non_empty(F.col("predicted")).isNull() | non_empty(F.col("actual")).isNull(),
                    "empty_distributions")
              .when(no_value("predicted") | no_value("actual"), "alignment_failed")
              .when(not_finite("predicted") | not_finite("actual"), "invalid_metrics")
              .when(no_mass("predicted") | no_mass("actual"), "normalization_failed"))
    return joined.withColumn("reason", reason).drop("__incomplete", "__found")


def score_matches(matched: DataFrame, threshold: float = 0.0) -> DataFrame:
    """JSD, WD and Recall@max(3,k)/@max(4,k) of every matched row; recall is null without truth themes."""
    truth = F.map_keys(F.map_filter(F.col("before"), lambda _, v: v >= threshold))
    scored = (matched.filter(F.col("reason").isNull())
              .withColumn("__c", compare(F.col("actual"), F.col("predicted")))
              .withColumn("__order", ranked(F.col("predicted"))).withColumn("truth", truth))
    k = F.when(F.size("truth") > 0, F.size("truth"))
    return (scored.withColumns({
        "jsd": F.col("__c.jsd"), "wd": F.col("__c.wd"), "k_actual": k,
        "recall_at_max3k": recall_at_max_nk(F.col("__order"), F.col("truth"), 3, no_truth=None),
        "recall_at_max4k": recall_at_max_nk(F.col("__order"), F.col("truth"), 4, no_truth=None),
        "top_k_used_3": F.when(k.isNotNull(), F.greatest(F.lit(3), k)),
        "top_k_used_4": F.when(k.isNotNull(), F.greatest(F.lit(4), k))}).drop("__c", "__order", "truth", "reason"))


@dataclass(frozen=True)
class Rung:
    """One step of a cascade: key expressions on both sides, and which lookup row wins a shared key."""

    name: str
    left: Sequence[Column]
    right: Sequence[Column]
    keep: str = "last"


def joined_key(parts: Sequence[Column]) -> Column:
    """One text out of several key parts; each is preceded by its length, so different parts never give the same text."""
    texts = [p.cast("string") for p in parts]
    return texts[0] if len(texts) == 1 else F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)])


def cascade(left: DataFrame, lookup: DataFrame, rungs: Sequence[Rung], value: str, position: str,
            spread_by: str) -> DataFrame:
    """Try rungs in order; the first that yields a value fills `value`, and match_level names it.

    A rung's key is unusable for rows where any of its parts is null."""
    result = left
    for i, rung in enumerate(rungs):
        names = [f"__k{i}_{j}" for j in range(len(rung.right))]
        keyed = lookup.select(*[c.alias(n) for c, n in zip(rung.right, names)], F.col(value).alias(f"__v{i}"),
                              F.col(position).alias("__pos")).dropna(subset=names)
        keep = keep_last if rung.keep == "last" else keep_first
        side = keep(keyed, names, "__pos").drop("__pos")
        side = side.select(joined_key([F.col(n) for n in names]).alias(f"__k{i}"), f"__v{i}")
        usable = F.lit(True)
        for c in rung.left:
            usable = usable & c.isNotNull()
        result = (result.withColumn(f"__k{i}", spread_key(joined_key(rung.left), usable, F.col(spread_by)))
                  .join(side, f"__k{i}", "left").drop(f"__k{i}"))
    found = [F.when(F.col(f"__v{i}").isNotNull(), F.lit(r.name)) for i, r in enumerate(rungs)]
    return (result.withColumn("match_level", F.coalesce(*found))
            .withColumn(value, F.coalesce(*[F.col(f"__v{i}") for i in range(len(rungs))]))
            .drop(*[f"__v{i}" for i in range(len(rungs))]))


def earlier(a: Column, b: Column) -> Column:
    """Of two structs with a field pos, the one with the smaller pos; nulls give way."""
    return F.when(a.isNull(), b).when(b.isNull(), a).when(a["pos"] <= b["pos"], a).otherwise(b)


def _given(column: Column) -> Column:
    return F.when(present(column), F.trim(column))


def by_product_then_text(predictions: DataFrame, truth: DataFrame, value: str, position: str,
                         spread_by: str) -> DataFrame:
    """Prediction-side cascade: product id without regard to case, then exact text."""
    asin, text = F.upper(_given(F.col("asin"))), _given(F.col("review_text"))
    return cascade(predictions, truth, [Rung("asin", [asin], [asin]), Rung("text", [text], [text])], value, position,
                   spread_by)


def by_baseline_keys(predictions: DataFrame, truth: DataFrame, value: str, position: str,
                     spread_by: str) -> DataFrame:
    """Baseline-side cascade: (user, index, product, text), then (product, text) of unindexed rows, then text."""
    user, idx = F.col("user_id"), F.col("review_index")
    product, text = _given(F.col("product_description")), _given(F.col("review_text"))
    unindexed = F.when(user.isNull() | idx.isNull(), product)
    return cascade(predictions, truth, [
        Rung("user_index", [user, idx, product, text], [user, idx, product, text]),
        Rung("product_text", [product, text], [unindexed, text], keep="first"),
        Rung("text", [text], [text])], value, position, spread_by)


def by_product_or_user(predictions: DataFrame, truth: DataFrame, value: str, position: str,
                       spread_by: str) -> DataFrame:
    """Within a user (`scope`): same product id, or same product description; the first row in order wins.

    Both rungs are looked up and the earlier ground-truth row is taken."""
    scope = F.col("scope")
    asin, product = _given(F.col("asin")), _given(F.col("product_description"))
    packed = truth.withColumn("__hit", F.struct(F.col(position).alias("pos"), F.col(value).alias("value")))
    step = lambda df, name, key: cascade(df, packed, [Rung(name, [scope, key], [scope, key], keep="first")], "__hit",
                                         position, spread_by).withColumnRenamed("__hit", f"__{name}").drop("match_level")
    joined = step(step(predictions, "asin", asin), "product", product)
    best = earlier(F.col("__asin"), F.col("__product"))
    return (joined.withColumn("match_level", F.when(best.isNull(), None)
                              .when(best["pos"] == F.col("__asin.pos"), "asin").otherwise("product"))
            .withColumn(value, best["value"]).drop("__asin", "__product"))


def merge_classifications(reviews: DataFrame, tags: DataFrame, fields: Sequence[str], spread_by: str) -> DataFrame:
    """Review left-joined to its classification: by review_id, else (user, text, product or product unknown).

    In the second step the earliest tag (by `pos`) with the same user and text wins whose product is the same or
    unknown on either side. The tag side is first reduced to one row per (user, text, product) and per (user, text),
    so a text repeated many times on both sides does not multiply."""
    hit = F.struct(F.col("pos"), F.struct(*fields).alias("v"))
    text_key = F.md5("review_text")
    tagged = tags.withColumn("__hit", hit)
    by_id = keep_last(tagged.filter(present(F.col("review_id"))), ["review_id"], "pos").select(
        "review_id", F.col("__hit").alias("__by_id"))
    asin = F.when(F.col("asin") != "", F.col("asin"))
    known = tagged.select(F.col("user_id"), text_key.alias("__t"), asin.alias("__asin"), "__hit")
    with_product = (known.filter(F.col("__asin").isNotNull()).groupBy("user_id", "__t", "__asin")
                    .agg(F.min_by("__hit", "__hit.pos").alias("__by_product")))
    any_product = (known.groupBy("user_id", "__t")
                   .agg(F.min_by("__hit", "__hit.pos").alias("__any"),
                        F.min_by("__hit", F.when(F.col("__asin").isNull(), F.col("__hit.pos"))).alias("__unknown"),
                        F.max(F.col("__asin").isNull()).alias("__has_unknown")))
    joined = (reviews.withColumn("__t", text_key).withColumn("__asin", asin)
              .withColumn("review_id", spread_key(F.col("review_id"), present(F.col("review_id")), F.col(spread_by)))
              .join(by_id, "review_id", "left")
              .join(any_product, ["user_id", "__t"], "left")
              .withColumn("__pk", spread_key(F.col("__asin"), F.col("__asin").isNotNull(), F.col(spread_by)))
              .join(with_product.withColumnRenamed("__asin", "__pk"), ["user_id", "__t", "__pk"], "left"))
    unknown = F.when(F.col("__has_unknown"), F.col("__unknown"))
    by_text = F.when(F.col("__asin").isNull(), F.col("__any")).otherwise(
        earlier(F.col("__by_product"), unknown))
    chosen = F.coalesce(F.col("__by_id"), by_text)
    return (joined.withColumn("match_level", F.when(F.col("__by_id").isNotNull(), "review_id")
                              .when(by_text.isNotNull(), "user_text_product"))
            .withColumn("__chosen", chosen)
            .select(*[F.when(~F.col(c).startswith("\u0001"), F.col(c)).alias(c) if c == "review_id" else F.col(c)
                      for c in reviews.columns], "match_level",
                    *[F.col(f"__chosen.v.{f}").alias(f) for f in fields]))


def fill_missing_themes(predictions: DataFrame, lookup: DataFrame, themes: str, position: str,
                        spread_by: str) -> DataFrame:
    """Rows without themes take them from the product's lookup row; filled tells which."""
    asin = F.upper(_given(F.col("asin")))
    own = predictions.withColumnRenamed(themes, "__own")
    joined = cascade(own, lookup, [Rung("asin", [asin], [asin])], themes, position, spread_by)
    lacking = F.coalesce(F.size("__own") <= 0, F.lit(True))
    return (joined.withColumn("filled", lacking & F.col(themes).isNotNull())
            .withColumn(themes, F.when(lacking, F.col(themes)).otherwise(F.col("__own")))
            .drop("__own", "match_level"))


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the output yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def with_user_text(df: DataFrame, texts: DataFrame, user: str, value: str) -> DataFrame:
    """Lookup by the user id without a trailing _1, then by the id as it is."""
    lookup = lambda key: texts.groupBy(F.col(user).alias(key)).agg(F.max(value).alias(f"__{key}"))
    return (df.withColumn("__bare", without_copy_suffix(F.col(user)))
            .join(lookup("__bare").withColumnRenamed("____bare", "__hit_bare"), "__bare", "left")
            .join(lookup("__raw").withColumnRenamed("____raw", "__hit_raw"), F.col(user) == F.col("__raw"), "left")
            .withColumn(value, F.coalesce("__hit_bare", "__hit_raw")).drop("__bare", "__raw", "__hit_bare", "__hit_raw"))


def _one_row(lookup: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The lookup with one row per key, the last by `order`, so that a join never multiplies rows."""
    return keep_last(lookup, keys, order)


def segment_details(segments: DataFrame, reviews: DataFrame, backstories: DataFrame) -> DataFrame:
    """Reviews of segmented users with their backstory, one row per review; nest with writers.user_documents."""
    held = [c for c in backstories.columns if c != "user_id"]
    return segments.join(reviews, "user_id").join(_one_row(backstories, ["user_id"], held[0]) if held else backstories.distinct(), "user_id", "left")


def seed_characteristics(summaries: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tribes with both a summary and details, tribes missing one of them with the reason)."""
    both = summaries.withColumn("__s", F.lit(True)).join(details.withColumn("__d", F.lit(True)), "tribe_id", "full")
    reason = F.when(F.col("__s").isNull(), "missing_summary").when(F.col("__d").isNull(), "missing_details")
    tagged = both.withColumn("reason", reason).drop("__s", "__d")
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def prediction_tasks(tribes: DataFrame, reviews: DataFrame, backstories: DataFrame, topics: DataFrame, *,
                     seeds: DataFrame | None = None, memory: DataFrame | None = None,
                     user_context: bool = True) -> DataFrame:
    """One row per review of every tribe member with its context, or the reason it is skipped.

    tribes: user_id, tribe_id. reviews: user_id, review_key, category, main_category, themes, ... backstories:
    user_id, overall_summary, category_summaries map. topics: main_category, category_themes. The optional seeds
    (tribe_id, persona) and memory (tribe_id, user_id, learnings) give the other context variants."""
    tasks = tribes.join(reviews, "user_id")
    if user_context:
        tasks = tasks.join(_one_row(backstories, ["user_id"], "overall_summary"), "user_id", "left")
    tasks = tasks.join(_one_row(topics, ["main_category"], "category_themes"), "main_category", "left")
    if seeds is not None:
        tasks = tasks.join(_one_row(seeds, ["tribe_id"], "persona"), "tribe_id", "left")
    if memory is not None:
        tasks = tasks.join(_one_row(memory, ["tribe_id", "user_id"], "learnings"), ["tribe_id", "user_id"], "left")
    reason = F.when(F.lit(False), "")
    if user_context:
        reason = reason.when(blank(F.col("overall_summary")), "no_user_summary")
    reason = (reason.when(blank(F.col("category")), "no_category")
              .when(F.coalesce(F.size("themes"), F.lit(0)) <= 0, "empty_themes")
              .when(F.coalesce(F.size("category_themes"), F.lit(0)) <= 0, "no_category_themes"))
    tasks = tasks.withColumn("reason", reason)
    if user_context:
        own = F.coalesce(F.try_element_at(F.col("category_summaries"), F.col("main_category")),
                         F.try_element_at(F.col("category_summaries"), F.col("category")), F.lit(""))
        tasks = tasks.withColumn("category_summary", own)
    return tasks


def delta_journey_truth(deltas: DataFrame, journeys: DataFrame, truth: DataFrame, keys: Sequence[str], order: Column, *, delta: str = "delta") -> DataFrame:
    """The rows of deltas with the best corrected delta of their journey, the gain over their own, and their truth row.

    journeys: keys, iteration, delta (iteration 0 is the prediction itself). truth: keys and more, the last by `order` counts.
    reason: no_journey, no_truth, null where both were found; best_iteration is the earliest of the best."""
    step = F.struct(F.col(delta).alias("d"), F.col("iteration").alias("i"))
    best = (journeys.filter((F.col("iteration") > 0) & F.col(delta).isNotNull() & ~F.isnan(delta)).groupBy(*keys).agg(F.min(step).alias("__best")))
    fields = [c for c in truth.columns if c not in keys]
    last = truth.groupBy(*keys).agg(F.max(F.struct(order.alias("__o"), *fields)).alias("__t"))
    joined = deltas.join(best, list(keys), "left").join(last, list(keys), "left")
    reason = F.when(F.col("__best").isNull(), "no_journey").when(F.col("__t").isNull(), "no_truth")
    return joined.select(*deltas.columns, F.col("__best.d").alias("best_delta"), F.col("__best.i").alias("best_iteration"),
                         (F.col(delta) - F.col("__best.d")).alias("gain"), *[F.col(f"__t.{c}").alias(c) for c in fields], reason.alias("reason"))


def user_memory(batches: DataFrame) -> DataFrame:
    """Learnings per (tribe, user) from batches with parallel arrays reviews and analyses.

    batches: cluster_id, tribe_id, batch, reviews, analyses. A user's analyses are kept in batch order; the cluster
    grain is the fallback for users without any in their tribe."""
    rows = (batches.select("cluster_id", "tribe_id", "batch", F.posexplode(F.arrays_zip("reviews", "analyses"))
                           .alias("i", "r"))
            .select("cluster_id", "tribe_id", "batch", "i", F.regexp_extract("r.reviews", r"^(.*)_review_", 1)
                    .alias("user_id"), F.col("r.analyses").alias("analysis"))
            .filter((F.col("user_id") != "") & present(F.col("analysis"))))
    return rows


def memory_for(members: DataFrame, rows: DataFrame) -> DataFrame:
    """analyses of each member in batch order, from the member's tribe; a tribe without any memory takes its cluster's.

    Tribes are named within their cluster, and a missing key has no memory. Members and rows are dealt once, by cluster and
    user: a user's lists of the tribes are built there, and the cluster's from them. memory_level is tribe or cluster, null
    for a member without any; tribe_has_memory tells the two kinds apart once a tribe."""
    place, tribe = ["cluster_id", "user_id"], ["cluster_id", "tribe_id"]
    rows = written(rows.select(*place, "tribe_id", "batch", "i", "analysis").dropna(subset=[*place, "tribe_id"]))
    known = rows.select(*tribe).distinct().withColumn("__known", F.lit(True))
    more = [c for c in members.columns if c not in (*place, "tribe_id")]
    asked = members.join(known, tribe, "left").select(
        *place, "tribe_id", F.struct(F.coalesce("__known", F.lit(False)).alias("__has"), *more).alias("__m"))
    told = rows.select(*place, "tribe_id", F.struct("batch", "i", "analysis").alias("__e"))
    lists = asked.unionByName(told, allowMissingColumns=True).repartition(*place).groupBy(*place, "tribe_id").agg(
        F.collect_list("__m").alias("__ms"), F.sort_array(F.collect_list("__e")).getField("analysis").alias("__own"))
    asking = F.when(F.size("__ms") > 0, F.struct("tribe_id", "__ms", F.when(F.get("__ms", 0)["__has"], F.col("__own")).alias("__own")))
    users = lists.groupBy(*place).agg(F.sort_array(F.collect_list(F.when(F.size("__own") > 0, F.struct("tribe_id", "__own")))).getField("__own").alias("__all"),
                                      F.collect_list(asking).alias("__asking"))
    joined = (users.select(*place, "__all", F.explode("__asking").alias("__a"))
              .select(*place, F.col("__a.tribe_id").alias("tribe_id"), F.coalesce("__a.__own", F.flatten("__all")).alias("__found"), F.explode("__a.__ms").alias("__m")))
    found, has = F.when(F.size("__found") > 0, F.col("__found")), F.col("__m.__has")
    return joined.select(*[F.col(f"__m.{c}").alias(c) if c in more else F.col(c) for c in members.columns], found.alias("analyses"),
                         has.alias("tribe_has_memory"), F.when(found.isNotNull(), F.when(has, "tribe").otherwise("cluster")).alias("memory_level"))


def history_without_own(rows: DataFrame, history: DataFrame, key: str, place: str) -> DataFrame:
    """Each row with the history of its key, less the entry at its own place: n_history, own place and whether any is there.

    history: key, place, text. The texts stay in the history table, once each; a reader of one row skips `own`."""
    sums = history.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.length("text")).alias("__chars"))
    own = history.groupBy(key, place).agg(F.count(F.lit(1)).alias("__own"), F.sum(F.length("text")).alias("__own_chars"))
    joined = rows.join(sums, key, "left").join(own, [key, place], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.withColumns({"n_history": zero("__n") - zero("__own"), "n_chars": zero("__chars") - zero("__own_chars"),
                               "missing": F.col("__n").isNull()}).drop("__n", "__chars", "__own", "__own_chars")


def category_lookup(categories: DataFrame, universe: DataFrame, raw: str = "raw_category",
                    mapped: str = "mapped_category") -> DataFrame:
    """Universe key for each distinct (raw, mapped) category by seven strategies, most exact first.

    universe: key. The keys (a list of categories) are held as one array, so containment needs no cross join."""
    keys = universe.agg(F.array_sort(F.collect_set("key")).alias("keys")).scalar()
    normal, raw_normal = topic_file_category(F.col(mapped)), topic_file_category(F.col(raw))
    first = lambda test: F.get(F.filter(F.col("__keys"), test), 0)
    strategies = [
        ("normalised", first(lambda k: k == normal)), ("exact", first(lambda k: k == F.col(mapped))),
        ("raw", first(lambda k: k == F.col(raw))), ("raw_normalised", first(lambda k: k == raw_normal)),
        ("normalised_any_case", first(lambda k: F.lower(k) == F.lower(normal))),
        ("any_case", first(lambda k: F.lower(k) == F.lower(F.col(mapped)))),
        ("contained", first(lambda k: F.contains(F.lower(k), F.lower(normal)) | F.contains(F.lower(normal), F.lower(k))))]
    return (categories.select(raw, mapped).distinct().withColumn("__keys", keys)
            .select(raw, mapped, F.coalesce(*[c for _, c in strategies]).alias("universe_key"),
                    F.coalesce(*[F.when(c.isNotNull(), name) for name, c in strategies]).alias("strategy")))


def category_pairs(reviews: DataFrame, user: str, category: str) -> DataFrame:
    """Users shared by every pair of categories. A user's distinct categories are at most the category list."""
    per_user = (reviews.groupBy(user).agg(F.array_sort(F.collect_set(category)).alias("c"))
                .filter(F.size("c") > 1).groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(
        F.filter("c", lambda b: b > a), lambda b: F.struct(a.alias("category_a"), b.alias("category_b")))))
    return (per_user.select("n", F.explode(pairs).alias("p")).groupBy("p.category_a", "p.category_b")
            .agg(F.sum("n").alias("shared_users")))
