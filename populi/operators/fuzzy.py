"""Theme names that nearly match: lookups of distinct names in a category's topic list, held as one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from populi.functions import fixed_values as fixed
from populi.functions.dist import cosine
from populi.functions.text import fold, string_similarity
from populi.session import written


def token_theme_means(df: DataFrame, key: str, tokens: Column, names: DataFrame, theme: str = "theme") -> DataFrame:
    """(key, means map<theme, p>): for each theme the mean probability of the tokens that occur inside its name.

    tokens: array<struct<token, logprob>>; tokens that are only JSON structure are skipped. Every substring of the names is
    indexed and tokens meet the index by equality: a token costs one lookup however many themes there are. Spark
    broadcasts the index when its size allows. Keys without such a token are left out."""
    name = F.lower(F.trim(theme))
    starts = F.sequence(F.lit(1), F.greatest(F.length("__n"), F.lit(1)))
    cuts = names.select(theme).distinct().withColumn("__n", name).select(theme, "__n", F.explode(starts).alias("__s"))
    cuts = cuts.select(theme, F.explode(F.transform(F.sequence(F.lit(0), F.length("__n") - F.col("__s") + 1), lambda n: F.substr("__n", F.col("__s"), n))).alias("__text"))
    index = cuts.distinct().groupBy("__text").agg(F.collect_set(theme).alias("__themes"))
    said = df.select(key, F.explode(tokens).alias("__t")).select(key, F.lower(F.trim("__t.token")).alias("__text"), F.exp("__t.logprob").alias("__p"))
    met = said.filter(~F.col("__text").isin(fixed.STRUCTURE_TOKENS)).join(index, "__text")
    means = met.select(key, F.explode("__themes").alias(theme), "__p").groupBy(key, theme).agg(F.avg("__p").alias("__p"))
    return means.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(theme, "__p"))).alias("means"))


def topic_lists(topics: DataFrame) -> DataFrame:
    """(category, topics array in list order) from (category, theme, pos); a topic list is a short dictionary."""
    return topics.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "theme"))),
                                                      lambda s: s["theme"]).alias("topics"))


def best_fuzzy(names: DataFrame, topics: DataFrame, threshold: float) -> DataFrame:
    """(category, theme, topic, similarity) for names whose most similar topic, by edit ratio, reaches the threshold."""
    distinct = names.select("category", "theme").distinct().join(topic_lists(topics), "category")
    scored = F.transform("topics", lambda t: F.struct(string_similarity(F.col("theme"), t).alias("s"), t.alias("t")))
    best = F.reduce(scored, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("string").alias("t")),
                    lambda acc, x: F.when(x["s"] > acc["s"], x).otherwise(acc))
    return (distinct.withColumn("__b", best).filter(F.col("__b.s") >= threshold)
            .select("category", "theme", F.col("__b.t").alias("topic"), F.col("__b.s").alias("similarity")))


def best_by_vector(names: DataFrame, topics: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """As best_fuzzy, by cosine of theme vectors. vectors: theme, vector."""
    listed = (topics.join(vectors, "theme").groupBy("category")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "theme", "vector"))).alias("topics")))
    rows = (names.select("category", "theme").distinct().join(vectors, "theme").join(listed, "category"))
    scored = F.transform("topics", lambda t: F.struct(cosine(F.col("vector"), t["vector"]).alias("s"),
                                                      t["theme"].alias("t")))
    best = F.reduce(scored, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("string").alias("t")),
                    lambda acc, x: F.when(x["s"] > acc["s"], x).otherwise(acc))
    return (rows.withColumn("__b", best).filter(F.col("__b.s") >= threshold)
            .select("category", "theme", F.col("__b.t").alias("topic"), F.col("__b.s").alias("similarity")))


def onto_topic_list(probs: DataFrame, topics: DataFrame, matches: list[DataFrame]) -> DataFrame:
    """Distribution of each review over its category's whole topic list.

    probs: review_key, category, theme, p. A theme goes to the equal topic, else to the topic of the first match table
    that has it, else it is dropped; a review with no mass left is uniform over the list."""
    # of topics that fold alike the last of the list stands
    equal = topics.groupBy("category", fold(F.col("theme")).alias("__f")).agg(F.max_by("theme", F.struct("pos", "theme")).alias("__m0"))
    named = probs.withColumn("__f", fold(F.col("theme"))).join(equal, ["category", "__f"], "left")
    for i, table in enumerate(matches, 1):
        single = table.groupBy("category", "theme").agg(F.max_by("topic", F.struct("similarity", "topic")).alias(f"__m{i}"))
        named = named.join(single, ["category", "theme"], "left")
    target = F.coalesce(*[F.col(f"__m{i}") for i in range(len(matches) + 1)])
    mass = (named.withColumn("topic", target)
            .groupBy("review_key", "category", "topic").agg(F.sum("p").alias("p")))
    folded = (mass.groupBy("review_key", "category")
              .agg(F.map_from_entries(F.collect_list(F.when(F.col("topic").isNotNull(), F.struct("topic", "p"))))
                   .alias("__mass")).join(topic_lists(topics), "category"))
    total = F.aggregate(F.map_values("__mass"), F.lit(0.0), lambda acc, v: acc + v)
    share = lambda t: F.when(F.col("__total") > 1e-10,
                             F.coalesce(F.element_at("__mass", t), F.lit(0.0)) / F.col("__total")
                             ).otherwise(1.0 / F.size("topics"))
    return (folded.withColumn("__total", total)
            .select("review_key", "category", F.explode("topics").alias("topic"), "__mass", "__total", "topics")
            .select("review_key", "category", "topic", share(F.col("topic")).alias("p")))


def _single_targets(mapping: DataFrame) -> DataFrame:
    """(category, theme, to_theme): one row per mapped theme; of several targets the last name stands.

    A written table has a known size: Spark broadcasts it when that allows, so that no common theme lands in one task."""
    return written(mapping.groupBy("category", F.col("from_theme").alias("theme")).agg(F.max("to_theme").alias("to_theme")))


def rename_themes(probs: DataFrame, mapping: DataFrame, keys: list[str], combine: str = "sum",
                  keep_unmapped: bool = True, targets: DataFrame | None = None) -> DataFrame:
    """Move mass to new theme names by (category, from_theme, to_theme); masses that meet are summed or maximised.

    Unmapped themes keep their name, or are dropped unless they belong to `targets` (category, theme)."""
    renamed = probs.join(_single_targets(mapping), ["category", "theme"], "left")
    if not keep_unmapped:
        listed = targets.select("category", "theme").distinct().withColumn("__listed", F.lit(True))
        renamed = renamed.join(listed, ["category", "theme"], "left").filter(
            F.col("to_theme").isNotNull() | F.col("__listed"))
    agg = F.sum("p") if combine == "sum" else F.max("p")
    return (renamed.withColumn("theme", F.coalesce("to_theme", "theme"))
            .groupBy(*keys, "category", "theme").agg(agg.alias("p")))


def rename_logprobs(logprobs: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """As rename_themes for (logprob_yes, logprob_no): the larger of each is kept."""
    renamed = logprobs.join(_single_targets(mapping), ["category", "theme"], "left")
    return (renamed.withColumn("theme", F.coalesce("to_theme", "theme")).groupBy(*keys, "category", "theme")
            .agg(F.max("logprob_yes").alias("logprob_yes"), F.max("logprob_no").alias("logprob_no")))


def theme_costs(names: DataFrame, topics: DataFrame, vectors: DataFrame) -> DataFrame:
    """(category, theme, costs): cost max(0, 1 - cosine) of each distinct name to every topic of its category.

    costs is array<struct<topic, cost>> in list order; a topic list is a short dictionary."""
    listed = (topics.join(vectors, "theme").groupBy("category")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "theme", "vector"))).alias("topics")))
    rows = names.select("category", "theme").distinct().join(vectors, "theme").join(listed, "category")
    cost = lambda t: F.greatest(F.lit(0.0), 1.0 - cosine(F.col("vector"), t["vector"]))
    return rows.select("category", "theme", F.transform("topics", lambda t: F.struct(
        t["theme"].alias("topic"), cost(t).alias("cost"))).alias("costs"))


def cost_matrices(topics: DataFrame, vectors: DataFrame) -> DataFrame:
    """(category, position map<theme, index>, costs array<array<double>>): one row per category, for relaxed_transport."""
    known = topics.join(vectors.select("theme"), "theme", "left_semi")
    rows = theme_costs(known, known, vectors).join(known, ["category", "theme"])
    packed = rows.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "theme", F.transform("costs", lambda c: c["cost"]).alias("row")))).alias("r"))
    return packed.select("category", F.map_from_entries(F.transform("r", lambda x, i: F.struct(x["theme"], i))).alias("position"),
                         F.transform("r", lambda x: x["row"]).alias("costs"))
