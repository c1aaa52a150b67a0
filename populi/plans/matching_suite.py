"""Cascading, residual and star joins on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.functions import text
from populi.operators import match
from populi.operators.groups import keep_first, keep_last
from populi.operators.unify import best_results, to_results
from populi.plans.testbed import SQL, population, query, rounded, table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type", "value", "props")


# Clicks and views are reviews; purchases are classifications. A view names no product, a purchase above 100 neither.
_J4 = """rev AS (SELECT event_id, CAST(user_id AS VARCHAR) u, props x, CASE WHEN event_type = 'click' THEN CAST(user_id % 7 AS VARCHAR) END asin
    FROM events WHERE event_type <> 'purchase'),
  tag AS (SELECT event_id pos, CAST(user_id AS VARCHAR) u, props x, CASE WHEN value <= 50 THEN CAST(user_id % 7 AS VARCHAR) WHEN value > 100 THEN 'zz' END asin
    FROM events WHERE event_type = 'purchase')"""


def _j4_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    asin = (F.col("user_id").cast("long") % 7).cast("string")
    rows = _events(spark, sf)
    reviews = rows.filter(F.col("event_type") != "purchase").select(
        "event_id", "user_id", F.col("props").alias("review_text"), F.when(F.col("event_type") == "click", asin).alias("asin"),
        F.when(F.col("value") > 150, F.concat(F.lit("id"), F.col("user_id"))).alias("review_id"))
    tags = rows.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("pos"), "user_id", F.col("props").alias("review_text"),
        F.when(F.col("value") <= 50, asin).when(F.col("value") > 100, "zz").alias("asin"),
        F.when(F.col("value") > 200, F.concat(F.lit("id"), F.col("user_id"))).alias("review_id"),
        F.create_map(F.lit("value"), F.col("value")).alias("probabilities"))
    return reviews, tags


@query("classification_merge", f"""WITH {_J4},
  byid AS (SELECT 'id' || user_id rid, max(event_id) pos FROM events WHERE event_type = 'purchase' AND value > 200 GROUP BY 1),
  m AS (SELECT rev.event_id, min(tag.pos) pos FROM rev JOIN tag ON rev.u = tag.u AND rev.x = tag.x
    AND (rev.asin IS NULL OR tag.asin IS NULL OR rev.asin = tag.asin) GROUP BY 1)
  SELECT rev.event_id, CASE WHEN byid.pos IS NOT NULL THEN 'review_id' WHEN m.pos IS NOT NULL THEN 'user_text_product' END match_level,
    coalesce(byid.pos, m.pos) pos FROM rev JOIN events e USING (event_id) LEFT JOIN byid ON e.value > 150 AND byid.rid = 'id' || rev.u
  LEFT JOIN m ON m.event_id = rev.event_id""")
def classification_merge(spark: SparkSession, sf: str) -> DataFrame:
    reviews, tags = _j4_sides(spark, sf)
    merged = match.merge_classifications(reviews, tags, ["pos", "probabilities"], "event_id")
    return merged.select("event_id", "match_level", "pos")


_DOCS = """pred AS (SELECT doc_id, CASE WHEN lang = 'en' THEN lower(source) END asin, trim(text) x FROM documents),
  truth AS (SELECT doc_id pos, CASE WHEN quality = 1 THEN source END asin, trim(text) x FROM documents JOIN labels USING (doc_id))"""


def _doc_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    pred = docs.select("doc_id", F.when(F.col("lang") == "en", F.lower("source")).alias("asin"), F.col("text").alias("review_text"))
    truth = docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("pos"), F.when(F.col("quality") == 1, F.col("source")).alias("asin"),
        F.col("text").alias("review_text"), F.col("doc_id").alias("hit"))
    return pred, truth


@query("cascade_product_then_text", f"""WITH {_DOCS}, a AS (SELECT upper(asin) k, max(pos) hit FROM truth WHERE asin IS NOT NULL GROUP BY 1),
  t AS (SELECT x, max(pos) hit FROM truth GROUP BY 1)
  SELECT doc_id, CASE WHEN a.hit IS NOT NULL THEN 'asin' WHEN t.hit IS NOT NULL THEN 'text' END match_level, coalesce(a.hit, t.hit) hit
  FROM pred LEFT JOIN a ON upper(pred.asin) = a.k LEFT JOIN t USING (x)""")
def cascade_product_then_text(spark: SparkSession, sf: str) -> DataFrame:
    pred, truth = _doc_sides(spark, sf)
    return match.by_product_then_text(pred, truth, "hit", "pos", "doc_id").select("doc_id", "match_level", "hit")


_BASE = """p AS (SELECT event_id, CAST(user_id AS VARCHAR) u, CAST(event_id % 5 AS INTEGER) i, event_type pr, props x FROM events WHERE value < 40),
  t AS (SELECT event_id pos, CASE WHEN value < 90 THEN CAST(user_id AS VARCHAR) END u, CAST(event_id % 5 AS INTEGER) i, event_type pr, props x FROM events WHERE value >= 40),
  k1 AS (SELECT u, i, pr, x, max(pos) hit FROM t WHERE u IS NOT NULL GROUP BY 1, 2, 3, 4),
  k2 AS (SELECT pr, x, min(pos) hit FROM t WHERE u IS NULL GROUP BY 1, 2), k3 AS (SELECT x, max(pos) hit FROM t GROUP BY 1)"""


@query("cascade_baseline_keys", f"""WITH {_BASE} SELECT event_id, CASE WHEN k1.hit IS NOT NULL THEN 'user_index' WHEN k2.hit IS NOT NULL THEN 'product_text'
    WHEN k3.hit IS NOT NULL THEN 'text' END match_level, coalesce(k1.hit, k2.hit, k3.hit) hit
  FROM p LEFT JOIN k1 USING (u, i, pr, x) LEFT JOIN k2 USING (pr, x) LEFT JOIN k3 USING (x)""")
def cascade_baseline_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).withColumns({
        "review_index": (F.col("event_id") % 5).cast("int"), "product_description": F.col("event_type"), "review_text": F.col("props")})
    truth = rows.filter(F.col("value") >= 40).withColumn("user_id", F.when(F.col("value") < 90, F.col("user_id"))).select(
        F.col("event_id").alias("pos"), F.col("event_id").alias("hit"), "user_id", "review_index", "product_description", "review_text")
    pred = rows.filter(F.col("value") < 40)
    return match.by_baseline_keys(pred, truth, "hit", "pos", "event_id").select("event_id", "match_level", "hit")


@query("product_or_user_match", """WITH p AS (SELECT l_orderkey o, l_linenumber n, l_suppkey s, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag = 'R'),
  t AS (SELECT l_orderkey * 100 + l_linenumber pos, l_suppkey s, l_partkey, l_shipdate FROM lineitem WHERE l_returnflag <> 'R'),
  a AS (SELECT s, l_partkey, min(pos) hit FROM t GROUP BY 1, 2), q AS (SELECT s, CAST(l_shipdate AS DATE) d, min(pos) hit FROM t GROUP BY 1, 2)
  SELECT o * 100 + n review_key, CASE WHEN a.hit IS NULL AND q.hit IS NULL THEN NULL WHEN q.hit IS NULL OR a.hit <= q.hit THEN 'asin' ELSE 'product' END match_level,
    least(a.hit, q.hit) hit FROM (SELECT l_orderkey o, l_linenumber n, l_suppkey s, l_partkey, CAST(l_shipdate AS DATE) d FROM lineitem WHERE l_returnflag = 'R') p
  LEFT JOIN a USING (s, l_partkey) LEFT JOIN q USING (s, d)""")
def product_or_user_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("review_key"), F.col("l_suppkey").alias("scope"), "l_returnflag",
        F.col("l_partkey").cast("string").alias("asin"), F.to_date("l_shipdate").cast("string").alias("product_description"))
    pred = rows.filter(F.col("l_returnflag") == "R").drop("l_returnflag")
    truth = rows.filter(F.col("l_returnflag") != "R").select(
        F.col("review_key").alias("pos"), F.col("review_key").alias("hit"), "scope", "asin", "product_description")
    return match.by_product_or_user(pred, truth, "hit", "pos", "review_key").select("review_key", "match_level", "hit")


@query("attach_ground_truth", f"""WITH {SQL.POP}, t AS (SELECT o_custkey, lower(o_orderpriority) c, max(o_orderkey) k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
  SELECT review_key, k truth_key FROM pop LEFT JOIN t ON CAST(o_custkey AS VARCHAR) = user_id AND lower(category) = c""")
def attach_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Last finished order of the same user and category, attached by the normalised key."""
    truth = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").withColumn(
        "match_key", text.match_key(F.col("o_custkey").cast("string"), F.lower("o_orderpriority")))
    last = keep_last(truth, ["match_key"], "o_orderkey").select("match_key", F.col("o_orderkey").alias("truth_key"))
    rows = population(spark, sf).withColumn("match_key", text.match_key(F.col("user_id"), F.col("category")))
    return rows.join(last, "match_key", "left").select("review_key", "truth_key")


@query("filled_missing_themes", """WITH s AS (SELECT doc_id, source asin, lang = 'en' has FROM documents), l AS (SELECT source asin, max(doc_id) d FROM documents JOIN labels USING (doc_id)
    WHERE quality = 1 GROUP BY 1)
  SELECT doc_id, NOT has AND d IS NOT NULL filled, CASE WHEN has THEN 'own' WHEN d IS NOT NULL THEN 'doc' || d END themes FROM s LEFT JOIN l USING (asin)""")
def filled_missing_themes(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    none = F.array().cast("array<string>")
    pred = docs.select("doc_id", F.col("source").alias("asin"),
                       F.when(F.col("lang") == "en", F.array(F.lit("own"))).otherwise(none).alias("themes"))
    lookup = docs.join(labels.filter(F.col("quality") == 1), "doc_id").select(
        F.lower("source").alias("asin"), F.col("doc_id").alias("pos"), F.array(F.concat(F.lit("doc"), "doc_id")).alias("themes"))
    rows = match.fill_missing_themes(pred, lookup, "themes", "pos", "doc_id")
    return rows.select("doc_id", "filled", F.get("themes", 0).alias("themes"))


@query("segment_user_details", f"""WITH {SQL.POP}, b AS (SELECT CAST(c_custkey AS VARCHAR) user_id, c_name FROM customer WHERE c_acctbal > 0)
  SELECT cluster_id segment_id, count(*) n_reviews, count(DISTINCT pop.user_id) n_users, count(c_name) n_with_backstory FROM pop LEFT JOIN b USING (user_id) GROUP BY 1""")
def segment_user_details(spark: SparkSession, sf: str) -> DataFrame:
    pop = population(spark, sf)
    segments = pop.select("user_id", F.col("cluster_id").alias("segment_id")).distinct()
    stories = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").cast("string").alias("user_id"), "c_name")
    rows = match.segment_details(segments, pop.select("user_id", "review_key"), stories)
    return rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.countDistinct("user_id").alias("n_users"),
                                          F.count("c_name").alias("n_with_backstory"))


def _task_inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    pop = population(spark, sf)
    reviews = pop.select("user_id", "review_key", F.when(F.col("category") != "4-NOT SPECIFIED", F.col("category")).alias("category"),
                         F.col("category").alias("main_category"),
                         F.when(F.col("sentiment") != "Negative", F.array(F.lit("t"))).alias("themes"))
    stories = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("overall_summary"),
        F.create_map(F.lit("1-URGENT"), F.lit("hurried")).alias("category_summaries"))
    topics = pop.select(F.col("category").alias("main_category")).distinct().filter(F.col("main_category") != "5-LOW").withColumn(
        "category_themes", F.array(F.lit("a"), F.lit("b")))
    seeds = pop.select("tribe_id").distinct().withColumn("persona", F.concat(F.lit("persona "), "tribe_id"))
    return {"tribes": pop.select("user_id", "tribe_id").distinct(), "reviews": reviews, "backstories": stories, "topics": topics, "seeds": seeds}


_REASON = """CASE WHEN c_acctbal <= 0 AND {user} THEN 'no_user_summary' WHEN category = '4-NOT SPECIFIED' THEN 'no_category'
  WHEN sentiment = 'Negative' THEN 'empty_themes' WHEN category = '5-LOW' THEN 'no_category_themes' END"""


@query("prediction_tasks", f"""WITH {SQL.POP} SELECT coalesce({_REASON.format(user='TRUE')}, 'task') outcome, category = '1-URGENT' has_summary, count(*) n
  FROM pop JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id GROUP BY 1, 2""")
def prediction_tasks(spark: SparkSession, sf: str) -> DataFrame:
    i = _task_inputs(spark, sf)
    tasks = match.prediction_tasks(i["tribes"], i["reviews"], i["backstories"], i["topics"])
    return tasks.groupBy(F.coalesce("reason", F.lit("task")).alias("outcome"), (F.col("category_summary") != "").alias("has_summary")).agg(
        F.count(F.lit(1)).alias("n"))


@query("prediction_tasks_from_seeds", f"""WITH {SQL.POP} SELECT coalesce({_REASON.format(user='FALSE')}, 'task') outcome, 'persona ' || tribe_id persona, count(*) n
  FROM pop JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id GROUP BY 1, 2""")
def prediction_tasks_from_seeds(spark: SparkSession, sf: str) -> DataFrame:
    i = _task_inputs(spark, sf)
    tasks = match.prediction_tasks(i["tribes"], i["reviews"], i["backstories"], i["topics"], seeds=i["seeds"], user_context=False)
    return tasks.groupBy(F.coalesce("reason", F.lit("task")).alias("outcome"), "persona").agg(F.count(F.lit(1)).alias("n"))


@query("prediction_tasks_with_memory", f"""WITH {SQL.POP} SELECT review_key, {_REASON.format(user='TRUE')} reason, 'persona ' || tribe_id persona, CASE WHEN c_acctbal > 0 THEN c_name END overall_summary,
    CASE WHEN c_custkey % 3 = 0 THEN tribe_id || ' learned from ' || user_id END learnings, category = '1-URGENT' has_summary FROM pop JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id""")
def prediction_tasks_with_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks with all three contexts: the tribe's seed, the user's backstory and what was learned about the user in the tribe."""
    i = _task_inputs(spark, sf)
    memory = i["tribes"].filter(F.col("user_id").cast("long") % 3 == 0).withColumn("learnings", F.concat("tribe_id", F.lit(" learned from "), "user_id"))
    tasks = match.prediction_tasks(i["tribes"], i["reviews"], i["backstories"], i["topics"], seeds=i["seeds"], memory=memory)
    return tasks.select("review_key", "reason", "persona", "overall_summary", "learnings", (F.col("category_summary") != "").alias("has_summary"))


@query("seed_characteristics", """SELECT coalesce(a.s, b.s) tribe_id, CASE WHEN a.s IS NULL THEN 'missing_summary' WHEN b.s IS NULL THEN 'missing_details' END reason, a.n total_users, b.m total_reviews
  FROM (SELECT source s, count(*) n FROM documents WHERE lang = 'fr' GROUP BY 1) a FULL JOIN (SELECT source s, count(*) m FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) b ON a.s = b.s""")
def seed_characteristics(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    summaries = docs.filter(F.col("lang") == "fr").groupBy(F.col("source").alias("tribe_id")).agg(F.count(F.lit(1)).alias("total_users"))
    details = docs.join(table(spark, sf, "labels").filter(F.col("toxic") == 1), "doc_id").groupBy(F.col("source").alias("tribe_id")).agg(
        F.count(F.lit(1)).alias("total_reviews"))
    good, bad = match.seed_characteristics(summaries, details)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("tribe_id", "reason", "total_users", "total_reviews")


@query("delta_journey_truth", f"""WITH {SQL.POP}, d AS (SELECT user_id u, event_id, value FROM events WHERE event_type = 'view'),
  j AS (SELECT user_id u, min(value) best FROM events WHERE event_type = 'click' GROUP BY 1), g AS (SELECT o_custkey u, max(o_orderkey) g FROM orders GROUP BY 1)
  SELECT event_id, round(value - best, 6) gain, g truth_key FROM d LEFT JOIN j USING (u) LEFT JOIN g USING (u)""")
def delta_journey_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Initial delta of a view, best corrected delta among the user's clicks, and the user's last order."""
    rows = _events(spark, sf).withColumnRenamed("value", "delta")
    journeys = rows.filter(F.col("event_type") == "click").select("user_id", (F.col("event_id") + 1).alias("iteration"), "delta")
    truth = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").alias("truth_key"))
    found = match.delta_journey_truth(rows.filter(F.col("event_type") == "view"), journeys, truth, ["user_id"], F.col("truth_key"))
    return rounded(found.select("event_id", "gain", "truth_key"))


@query("category_key_lookup", """WITH u AS (SELECT DISTINCT replace(replace(o_orderpriority, '-', '_'), ' ', '_') k FROM orders WHERE o_orderpriority <> '3-MEDIUM'
    UNION SELECT DISTINCT p_type FROM part),
  c AS (SELECT DISTINCT o_orderpriority raw_category, lower(replace(o_orderpriority, '-', ' ')) mapped_category FROM orders UNION ALL
    SELECT DISTINCT p_type, lower(p_type) || ' goods' FROM part),
  n AS (SELECT *, replace(replace(mapped_category, '&', 'and'), ' ', '_') mn FROM c)
  SELECT raw_category, mapped_category, coalesce((SELECT min(k) FROM u WHERE k = mn), (SELECT min(k) FROM u WHERE k = mapped_category), (SELECT min(k) FROM u WHERE k = raw_category),
    (SELECT min(k) FROM u WHERE lower(k) = lower(mn)), (SELECT min(k) FROM u WHERE contains(lower(k), lower(mn)) OR contains(lower(mn), lower(k)))) universe_key FROM n""")
def category_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    priority = F.col("o_orderpriority")
    universe = (orders.filter(priority != "3-MEDIUM").select(F.translate(priority, "- ", "__").alias("key"))
                .union(part.select("p_type")).distinct())
    categories = orders.select(priority.alias("raw_category"), F.lower(F.replace(priority, F.lit("-"), F.lit(" "))).alias("mapped_category")).union(
        part.select("p_type", F.concat(F.lower("p_type"), F.lit(" goods"))))
    return match.category_lookup(categories, universe).drop("strategy")


@query("user_memory", """WITH r AS (SELECT l_suppkey % 3 cl, l_suppkey tr, l_orderkey b, l_partkey || '_review_' || l_linenumber i, l_partkey u, l_returnflag || l_orderkey an
    FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey % 4 > 0),
  m AS (SELECT DISTINCT l_suppkey % 3 cl, l_suppkey tr, l_partkey u FROM lineitem),
  t AS (SELECT tr, u, string_agg(an, ',' ORDER BY b, i) a FROM r GROUP BY 1, 2), c AS (SELECT cl, u, string_agg(an, ',' ORDER BY tr, b, i) a FROM r GROUP BY 1, 2)
  SELECT m.tr tribe_id, CAST(m.u AS VARCHAR) user_id, CASE WHEN m.tr IN (SELECT tr FROM r) THEN CASE WHEN t.a IS NOT NULL THEN 'tribe' END WHEN c.a IS NOT NULL THEN 'cluster' END memory_level,
    CASE WHEN m.tr IN (SELECT tr FROM r) THEN t.a ELSE c.a END analyses FROM m LEFT JOIN t USING (tr, u) LEFT JOIN c USING (cl, u)""")
def user_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Batches are orders' lines per supplier: parallel arrays of review keys and analyses; a quarter of the tribes and returned lines have none."""
    told = (F.col("l_returnflag") != "R") & (F.col("l_suppkey") % 4 > 0)
    line = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 3).alias("cluster_id"), F.col("l_suppkey").alias("tribe_id"), F.col("l_orderkey").alias("batch"),
        F.concat("l_partkey", F.lit("_review_"), "l_linenumber").alias("key"),
        F.when(told, F.concat("l_returnflag", "l_orderkey")).otherwise("").alias("analysis"),
        F.col("l_partkey").cast("string").alias("user_id"))
    packed = line.groupBy("cluster_id", "tribe_id", "batch").agg(F.sort_array(F.collect_list(F.struct("key", "analysis"))).alias("e"))
    batches = packed.select("cluster_id", "tribe_id", "batch", F.col("e.key").alias("reviews"), F.col("e.analysis").alias("analyses"))
    found = match.memory_for(line.select("cluster_id", "tribe_id", "user_id").distinct(), match.user_memory(batches))
    return found.select("tribe_id", "user_id", "memory_level", F.array_join("analyses", ",").alias("analyses"))


@query("history_without_own", """WITH h AS (SELECT conv_id, turn, length(text) l FROM conversations WHERE role = 'user'), t AS (SELECT conv_id, turn FROM conversations),
  s AS (SELECT conv_id, count(*) n, sum(l) l FROM h GROUP BY 1)
  SELECT t.conv_id, t.turn, coalesce(s.n, 0) - (h.turn IS NOT NULL)::INT n_history, CAST(coalesce(s.l, 0) - coalesce(h.l, 0) AS BIGINT) n_chars, s.n IS NULL missing
  FROM t LEFT JOIN s USING (conv_id) LEFT JOIN h ON h.conv_id = t.conv_id AND h.turn = t.turn""")
def history_without_own(spark: SparkSession, sf: str) -> DataFrame:
    """History table of one kind of turns joined to all turns, without the turn at the same place."""
    turns = table(spark, sf, "conversations")
    rows = match.history_without_own(turns.select("conv_id", "turn"), turns.filter(F.col("role") == "user"), "conv_id", "turn")
    return rows.select("conv_id", "turn", "n_history", "n_chars", "missing")


@query("suffix_tolerant_lookup", """WITH w AS (SELECT event_id, CASE WHEN event_type = 'view' THEN user_id || '_1' ELSE CAST(user_id AS VARCHAR) END u FROM events),
  t AS (SELECT CASE WHEN c_acctbal < 0 THEN c_custkey || '_1' ELSE CAST(c_custkey AS VARCHAR) END u, c_name FROM customer)
  SELECT event_id, coalesce((SELECT max(c_name) FROM t WHERE t.u = regexp_replace(w.u, '_1$', '')), (SELECT max(c_name) FROM t WHERE t.u = w.u)) summary FROM w""")
def suffix_tolerant_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("event_id", F.when(F.col("event_type") == "view", F.concat("user_id", F.lit("_1"))).otherwise(
        F.col("user_id")).alias("user_id"))
    texts = table(spark, sf, "customer").select(
        F.when(F.col("c_acctbal") < 0, F.concat("c_custkey", F.lit("_1"))).otherwise(F.col("c_custkey").cast("string")).alias("user_id"),
        F.col("c_name").alias("summary"))
    return match.with_user_text(rows, texts, "user_id", "summary").select("event_id", "summary")


@query("unified_methods_deduplicated", """WITH r AS (SELECT user_id, event_type, event_id, CASE event_type WHEN 'view' THEN 'pre' WHEN 'click' THEN 'post' WHEN 'purchase' THEN 'baseline' ELSE 'other' END simulation_method,
    CASE WHEN event_type = 'click' THEN 0 ELSE value / 1000 END acc, value / 700 rec, props FROM events),
  s AS (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY CASE WHEN acc = 0 THEN rec ELSE acc END DESC, event_id) n FROM r)
  SELECT user_id, props, simulation_method, event_id FROM s WHERE n = 1""")
def unified_methods_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    accuracy = {"view": ("pre", F.col("value") / 1000), "click": ("post", F.lit(0.0)), "purchase": ("baseline", F.col("value") / 1000)}
    parts = [to_results(rows.filter(F.col("event_type") == kind), method, user=F.col("user_id"), product=F.col("props"),
                        accuracy=acc, recall=F.col("value") / 700, extra={"event_id": F.col("event_id")})
             for kind, (method, acc) in accuracy.items()]
    parts.append(to_results(rows.filter(~F.col("event_type").isin(list(accuracy))), "other", user=F.col("user_id"), product=F.col("props"),
                            accuracy=F.col("value") / 1000, recall=F.col("value") / 700, extra={"event_id": F.col("event_id")}))
    kept = best_results(parts, ["user_id", "stimulus_product_id"], "event_id", keep="best")
    return kept.select("user_id", F.col("stimulus_product_id").alias("props"), "simulation_method", "event_id")


@query("first_result_kept", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) a, row_number() OVER (PARTITION BY user_id, event_type
    ORDER BY event_id DESC) z FROM events) SELECT event_id, a = 1 is_first, z = 1 is_last FROM r WHERE a = 1 OR z = 1""")
def first_result_kept(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    first = keep_first(rows, ["user_id", "event_type"], "event_id").select("event_id", F.lit(True).alias("is_first"))
    last = keep_last(rows, ["user_id", "event_type"], "event_id").select("event_id", F.lit(True).alias("is_last"))
    both = first.join(last, "event_id", "full")
    return both.select("event_id", F.coalesce("is_first", F.lit(False)).alias("is_first"), F.coalesce("is_last", F.lit(False)).alias("is_last"))
