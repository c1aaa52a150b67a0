"""Keys, categories, theme maps and response clean-up on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.functions import dist, recall, text
from populi.functions import fixed_values as fixed
from populi.operators import fuzzy
from populi.plans.metrics_suite import brand_vectors
from populi.plans.testbed import SQL, distributions, population, query, rounded, sides, table
from populi.sources.readers import topics_from_json

_NAMES = [n for names in fixed.MAIN_CATEGORIES.values() for n in names] + ["Pet Supplies", "Gift Cards", "Amazon Devices"]
_SQL_NAMES = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


def _named_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Every part gets a source category by its size; some are spelled in upper case."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    name = F.element_at(names, (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 40, F.upper(name)).otherwise(name).alias("category"))


_PARTS = f"""parts AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN upper({_SQL_NAMES}[p_partkey % {len(_NAMES)} + 1])
    ELSE {_SQL_NAMES}[p_partkey % {len(_NAMES)} + 1] END category FROM part)"""


def _map_sql(groups: dict, codes: dict, column: str) -> str:
    whens = " ".join(f"WHEN '{n.lower()}' THEN '{codes.get(m, m)}'" for m, names in groups.items() for n in names)
    return f"CASE lower({column}) {whens} END"


@query("main_categories", f"""WITH {_PARTS} SELECT category, {_map_sql(fixed.MAIN_CATEGORIES, fixed.MAIN_CATEGORY_CODES, 'category')} main_category, count(*) n
  FROM parts GROUP BY 1""")
def main_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _named_parts(spark, sf).groupBy("category", text.main_category(F.col("category")).alias("main_category")).agg(F.count(F.lit(1)).alias("n"))


@query("baseline_categories", f"""WITH {_PARTS} SELECT category, coalesce(CASE WHEN category IN ({', '.join("'" + n + "'" for g in fixed.BASELINE_CATEGORIES.values() for n in g)})
  THEN {_map_sql(fixed.BASELINE_CATEGORIES, {}, 'category')} END, category) main_category, count(*) n FROM parts GROUP BY 1""")
def baseline_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _named_parts(spark, sf).groupBy("category", text.baseline_category(F.col("category")).alias("main_category")).agg(F.count(F.lit(1)).alias("n"))


def _rules_sql(rules: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(category), '{w}')" for w in words) + f" THEN '{main}'"
                              for main, words in fixed.KEYWORD_RULES[rules]) + " END"


@query("keyword_categories", f"""WITH {_PARTS} SELECT category, {_rules_sql('sampling')} by_sampling_rules, {_rules_sql('topics')} by_topic_rules, count(*) n FROM parts GROUP BY 1""")
def keyword_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _named_parts(spark, sf).groupBy("category", text.category_by_keyword(F.col("category")).alias("by_sampling_rules"),
                                           text.category_by_keyword(F.col("category"), "topics").alias("by_topic_rules")).agg(F.count(F.lit(1)).alias("n"))


@query("spelled_categories", f"""WITH {_PARTS}, m AS (SELECT category, CASE WHEN category IN ({', '.join("'" + n + "'" for g in fixed.MAIN_CATEGORIES.values() for n in g)})
    THEN {_map_sql(fixed.MAIN_CATEGORIES, {}, 'category')} ELSE category END c FROM parts)
  SELECT category, CASE WHEN regexp_matches(lower(c), 'fashion|jewelry') THEN 'Clothing Shoes & Jewelry' ELSE c END main_category, count(*) n FROM m GROUP BY 1, 2""")
def spelled_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _named_parts(spark, sf).groupBy("category", text.spelled_main_category(F.col("category")).alias("main_category")).agg(F.count(F.lit(1)).alias("n"))


@query("normalised_category_names", f"""WITH {_PARTS} SELECT DISTINCT category, trim(regexp_replace(regexp_replace(regexp_replace(category, ' & |&', ' and ', 'g'), '[ /-]', '_', 'g'), '_+', '_', 'g'), '_') underscored,
  replace(replace(category, '&', 'and'), ' ', '_') topic_file FROM parts""")
def normalised_category_names(spark: SparkSession, sf: str) -> DataFrame:
    return _named_parts(spark, sf).select("category").distinct().select(
        "category", text.underscored_category(F.col("category")).alias("underscored"), text.topic_file_category(F.col("category")).alias("topic_file"))


@query("match_keys", f"WITH {SQL.POP} SELECT review_key, lower(trim(user_id)) || '|||' || lower(trim(' ' || tribe_id || ' ')) || '|||' || lower(category) match_key FROM pop")
def match_keys(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit(" "), "tribe_id", F.lit(" "))
    return population(spark, sf).select("review_key", text.match_key(F.col("user_id"), padded, F.col("category")).alias("match_key"))


@query("content_hashes", "SELECT doc_id, md5(text) whole, substr(md5(substr(text, 1, 100)), 1, 8) stated_prefix FROM documents")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.text_hash(F.col("text")).alias("whole"),
                                                text.text_hash(F.col("text"), 100, 8).alias("stated_prefix"))


@query("sentiment_words", """SELECT event_type, CASE WHEN event_type IN ('view') THEN 'Neutral' WHEN event_type = 'purchase' THEN 'Positive' WHEN event_type = 'error' THEN 'Negative' ELSE 'Neutral' END sentiment,
  count(*) n FROM events GROUP BY 1""")
def sentiment_words(spark: SparkSession, sf: str) -> DataFrame:
    word = F.when(F.col("event_type") == "purchase", " Great ").when(F.col("event_type") == "error", "TERRIBLE").when(
        F.col("event_type") == "view", "ok").otherwise(F.col("event_type"))
    return table(spark, sf, "events").groupBy("event_type", text.sentiment(word).alias("sentiment")).agg(F.count(F.lit(1)).alias("n"))


@query("parsed_ids", f"""WITH {SQL.POP} SELECT review_key, 'cluster_' || (review_key % 7) cluster_id, 'micro_' || (review_key % 30) micro_id, user_id, CAST(review_key % 9 AS INTEGER) review_idx FROM pop""")
def parsed_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = population(spark, sf).withColumns({
        "tribe": F.concat(F.lit("segment_"), F.col("review_key") % 7, F.lit("_micro_"), F.col("review_key") % 30),
        "key": F.concat("user_id", F.lit("_review_"), F.col("review_key") % 9)})
    return rows.select("review_key", text.cluster_of_tribe(F.col("tribe")).alias("cluster_id"), text.micro_of_tribe(F.col("tribe")).alias("micro_id"),
                       text.user_of_review_key(F.col("key")).alias("user_id"), text.index_of_review_key(F.col("key")).alias("review_idx"))


@query("normalised_themes", f"""WITH {SQL.SIDES}, tot AS (SELECT k, sum(b) sb FROM sides GROUP BY k)
  SELECT k, t theme, round(b / sb, 6) p FROM sides JOIN tot USING (k) WHERE b IS NOT NULL""")
def normalised_themes(spark: SparkSession, sf: str) -> DataFrame:
    rows = distributions(spark, sf).select("k", F.explode(dist.normalise(F.col("predicted"))).alias("theme", "p"))
    return rounded(rows)


@query("uniform_themes", """WITH s AS (SELECT DISTINCT l_orderkey k, p_brand t FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A')
  SELECT k, t theme, round(1.0 / count(*) OVER (PARTITION BY k), 6) p FROM s""".replace("round(1.0 / count(*) OVER (PARTITION BY k), 6)", "round(CAST(1.0 AS DOUBLE) / count(*) OVER (PARTITION BY k), 6)"))
def uniform_themes(spark: SparkSession, sf: str) -> DataFrame:
    names = sides(spark, sf).filter(F.col("flag") == "A").select("k", "t").distinct().groupBy("k").agg(F.collect_list("t").alias("names"))
    return rounded(names.select("k", F.explode(dist.uniform(F.col("names"))).alias("theme", "p")))


@query("logprob_softmax", f"""WITH {SQL.SIDES}, l AS (SELECT k, t, -b / 20000 yes FROM sides WHERE b IS NOT NULL), m AS (SELECT *, exp(yes - max(yes) OVER (PARTITION BY k)) e FROM l)
  SELECT k, t theme, round(round(e / sum(e) OVER (PARTITION BY k), 12), 6) softmax, round(round(exp(yes), 12), 6) p_yes, round(round(exp(yes) / (exp(yes) + exp(yes * 2)), 12), 6) yes_share FROM m""")
def logprob_softmax(spark: SparkSession, sf: str) -> DataFrame:
    logs = distributions(spark, sf).select("k", F.transform_values("predicted", lambda _, v: -v / 20000).alias("yes"))
    soft = logs.select("k", "yes", F.explode(dist.softmax(F.col("yes"))).alias("theme", "softmax"))
    yes = F.element_at("yes", F.col("theme"))
    return rounded(soft.select("k", "theme", "softmax", F.exp(yes).alias("p_yes"), dist.yes_share(yes, yes * 2).alias("yes_share")))


_RENAME = """CASE WHEN t IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') THEN 'small numbers' WHEN t IN ('Brand#10', 'Brand#20') THEN 'round numbers' {rest} END"""


def _mapping(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.col("p_brand")
    return (table(spark, sf, "part").select("p_brand").distinct().select(
        F.lit("all").alias("category"), brand.alias("from_theme"),
        F.when(brand.isin(*[f"Brand#{i}" for i in range(1, 6)]), "small numbers").when(brand.isin("Brand#10", "Brand#20"), "round numbers").alias("to_theme"))
        .filter(F.col("to_theme").isNotNull()))


def _probs(spark: SparkSession, sf: str) -> DataFrame:
    return sides(spark, sf).repartition("k").groupBy("k", F.col("t").alias("theme")).agg(F.sum("a").alias("p")).withColumn("category", F.lit("all"))


@query("renamed_themes_summed", f"WITH {SQL.SIDES} SELECT k, {_RENAME.format(rest='ELSE t')} theme, sum(a) p FROM sides GROUP BY 1, 2")
def renamed_themes_summed(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy.rename_themes(_probs(spark, sf), _mapping(spark, sf), ["k"]).select("k", "theme", "p")


@query("renamed_themes_largest", f"""WITH {SQL.SIDES}, r AS (SELECT k, {_RENAME.format(rest="WHEN t IN ('Brand#7', 'Brand#8', 'Brand#9') THEN t")} theme, a FROM sides)
  SELECT k, theme, max(a) p FROM r WHERE theme IS NOT NULL GROUP BY 1, 2""")
def renamed_themes_largest(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "part").filter(F.col("p_brand").isin("Brand#7", "Brand#8", "Brand#9")).select(
        F.lit("all").alias("category"), F.col("p_brand").alias("theme"))
    return fuzzy.rename_themes(_probs(spark, sf), _mapping(spark, sf), ["k"], "max", keep_unmapped=False, targets=targets).select("k", "theme", "p")


@query("renamed_logprobs", f"""WITH {SQL.SIDES} SELECT k, {_RENAME.format(rest='ELSE t')} theme, max(-a) logprob_yes, round(max(-c / 1000), 6) logprob_no FROM sides GROUP BY 1, 2""")
def renamed_logprobs(spark: SparkSession, sf: str) -> DataFrame:
    logs = sides(spark, sf).groupBy("k", F.col("t").alias("theme")).agg(
        (-F.sum("a")).alias("logprob_yes"), (-F.sum("c") / 1000).alias("logprob_no")).withColumn("category", F.lit("all"))
    return rounded(fuzzy.rename_logprobs(logs, _mapping(spark, sf), ["k"]).select("k", "theme", "logprob_yes", "logprob_no"))


@query("truth_theme_sets", f"""WITH {SQL.SIDES}, s AS (SELECT k, t, a / 50 x, CASE WHEN b IS NOT NULL THEN exp(-b / 50000) / (exp(-b / 50000) + exp(-c / 50000)) END y FROM sides),
  n AS (SELECT k, count(*) FILTER (WHERE x >= 0.9) n1, count(*) FILTER (WHERE y >= 0.9) n2, count(*) FILTER (WHERE x > 0.5) n3 FROM s GROUP BY k)
  SELECT k, CAST(CASE WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 ELSE (SELECT count(*) FROM s WHERE s.k = n.k AND x * 2 > 0.9) END AS INTEGER) n_truth FROM n""")
def truth_theme_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = distributions(spark, sf).withColumn("logs", F.map_zip_with("predicted", "corrected", lambda _, b, c: F.struct(
        (-b / 50000).alias("yes"), (-c / 50000).alias("no"))))
    twice = F.transform_values("before", lambda _, v: v * 2)
    truth = recall.truth_themes(0.9, flat=F.col("before"), logprobs=F.col("logs"), predicted=twice)
    return rows.select("k", F.size(truth).alias("n_truth"))


@query("primary_topics", f"""WITH {SQL.SIDES}, {SQL.RANKED} SELECT k, coalesce(max(t) FILTER (WHERE r = 1), (SELECT min(t) FROM sides s WHERE s.k = q.k)) primary_topic
  FROM (SELECT DISTINCT k FROM sides) q LEFT JOIN ranked USING (k) GROUP BY k""")
def primary_topics(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.array_sort(F.map_keys("actual"))
    return distributions(spark, sf).select("k", dist.primary_topic(F.col("predicted"), listed).alias("primary_topic"))


@query("token_probabilities", r"""WITH tok AS (SELECT doc_id, unnest(string_split(lower(substr(text, 1, length(text))), ' ')) w FROM documents),
  n AS (SELECT doc_id, trim(w) w, count(*) c FROM tok GROUP BY 1, 2), th AS (SELECT unnest(['the other thing', 'ration']) t),
  m AS (SELECT doc_id, t, sum(c * exp(-length(w) / 10.0)) / sum(c) p FROM n, th WHERE contains(t, w) GROUP BY 1, 2)
  SELECT doc_id, round(max(p) FILTER (WHERE t = 'the other thing'), 6) p_thing, round(coalesce(max(p) FILTER (WHERE t = 'ration'), 0.25), 6) p_ration,
    0.5 p_unknown FROM documents LEFT JOIN m USING (doc_id) GROUP BY 1""".replace("0.5 p_unknown", "CAST(0.5 AS DOUBLE) p_unknown"))
def token_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of a text is a token; its log probability falls with its length."""
    words = F.transform(F.split(F.lower("text"), " "), lambda w: F.struct(w.alias("token"), (-F.length(F.trim(w)) / 10.0).alias("logprob")))
    themes = F.array(F.lit("the other thing"), F.lit("ration"), F.lit("#%"))
    stated = F.create_map(F.lit("ration"), F.lit(0.25))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    means = fuzzy.token_theme_means(docs, "doc_id", words, docs.limit(1).select(F.explode(themes).alias("theme")))
    rows = docs.select("doc_id").distinct().join(means.withColumnRenamed("means", "m"), "doc_id", "left")
    rows = rows.withColumn("all", text.theme_probabilities(themes, F.col("m"), stated))
    pick = lambda m, t: F.try_element_at(F.col(m), F.lit(t))
    return rounded(rows.select("doc_id", pick("m", "the other thing").alias("p_thing"), pick("all", "ration").alias("p_ration"), pick("all", "#%").alias("p_unknown")))


@query("salvaged_responses", """SELECT event_type, count(*) n, count(*) FILTER (WHERE event_type <> 'error') n_salvaged, CAST(coalesce(sum(CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 1 ELSE 2 END), 0) AS BIGINT) n_themes
  FROM events GROUP BY 1""")
def salvaged_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Whole, doubled-brace, cut-off and hopeless responses, one kind per event type."""
    a, b = F.concat(F.lit('"u'), "user_id", F.lit('"')), F.concat(F.lit('"'), "event_type", F.lit('"'))
    body = F.concat(F.lit('"themes": ['), a, F.lit(", "), b, F.lit("]"))
    kind = F.col("event_type")
    raw = (F.when(kind == "click", F.concat(F.lit("Here it is: {"), body, F.lit("} done")))
           .when(kind == "view", F.concat(F.lit("{ {"), body, F.lit("}")))
           .when(kind == "purchase", F.concat(F.lit('{"{'), body, F.lit("}")))
           .when(kind == "signup", F.concat(F.lit('{"themes": ['), a, F.lit(', "cut of'))).otherwise("no list at all"))
    rows = table(spark, sf, "events").select("event_type", text.salvage_topics(raw).alias("themes"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("themes").alias("n_salvaged"),
                                          F.coalesce(F.sum(F.size("themes")), F.lit(0)).alias("n_themes"))


@query("tagged_responses", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 'k' || json_extract_string(props, '$.k') END theme,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'Neutral' ELSE 'Positive' END sentiment FROM events""")
def tagged_responses(spark: SparkSession, sf: str) -> DataFrame:
    theme = F.concat(F.lit('["k'), F.get_json_object("props", "$.k"), F.lit('"]'))
    kind = F.col("event_type")
    raw = (F.when(kind == "error", "I cannot tell").when(kind == "view", F.concat(F.lit('{"results": [{"sentiment": "Neutral", "predicted_themes": '), theme, F.lit("}]}")))
           .otherwise(F.concat(F.lit('Answer: {"identified_themes": '), theme, F.lit(', "sentiment": "Positive"}'))))
    rows = table(spark, sf, "events").select("event_id", text.tagged_response(raw).alias("r"))
    return rows.select("event_id", F.get("r.themes", 0).alias("theme"), F.col("r.sentiment").alias("sentiment"))


@query("embedding_texts", """SELECT c_custkey, 'User characteristics: ' || c_name || ' Category-specific traits: - ' || c_mktsegment || ': balance ' || c_nationkey || ' Reviews products in categories: ' || c_mktsegment || ', ' || c_nationkey embedding_text FROM customer""")
def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.col("c_nationkey").cast("string")
    traits = F.create_map(F.col("c_mktsegment"), F.concat(F.lit("balance "), nation))
    return table(spark, sf, "customer").select("c_custkey", text.embedding_text(F.col("c_name"), traits, F.array(F.col("c_mktsegment"), nation)).alias("embedding_text"))


@query("pre_post_cells", """SELECT event_id, round(value, 6) pre, round(value / 2, 6) post, round(CASE WHEN value = 0 THEN NULL ELSE (value - value / 2) / value * 100 END, 6) improvement_pct FROM events""")
def pre_post_cells(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.concat(F.col("value").cast("string"), F.lit(" / "), (F.col("value") / 2).cast("string"), F.lit(" (med: 0.5) / 50.0%"))
    return rounded(table(spark, sf, "events").select("event_id", text.pre_post_cell(cell).alias("c")).select("event_id", "c.*"))


@query("gathered_themes", """WITH l AS (SELECT l_orderkey k, p_brand t, l_returnflag f FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT k, CAST(count(DISTINCT t) AS INTEGER) n_themes FROM l WHERE f <> 'R' GROUP BY k""")
def gathered_themes(spark: SparkSession, sf: str) -> DataFrame:
    listed = lambda flag: F.collect_set(F.when(F.col("flag") == flag, F.col("t")))
    rows = sides(spark, sf).filter(F.col("flag") != "R").groupBy("k").agg(listed("A").alias("x"), listed("N").alias("y"))
    none = F.lit(None).cast("array<string>")
    return rows.select("k", F.size(text.gather_themes(F.col("x"), none, F.col("y"), F.col("x"))).alias("n_themes"))


@query("characteristic_lines", f"""SELECT c_custkey, CAST((c_acctbal > 0)::INT + (c_mktsegment = 'BUILDING')::INT AS INTEGER) n_lines, CASE WHEN c_acctbal > 0 THEN '[General Characteristics] ' || c_name WHEN c_mktsegment = 'BUILDING'
  THEN '[BUILDING Specific] builds' END first_line FROM customer""")
def characteristic_lines(spark: SparkSession, sf: str) -> DataFrame:
    general = F.when(F.col("c_acctbal") > 0, F.col("c_name"))
    lines = text.characteristic_lines(general, F.col("c_mktsegment"), F.create_map(F.lit("BUILDING"), F.lit("builds")))
    return table(spark, sf, "customer").select("c_custkey", lines.alias("l")).select("c_custkey", F.size("l").alias("n_lines"), F.get("l", 0).alias("first_line"))


@query("parsed_analyses", """SELECT event_id, CASE event_type WHEN 'click' THEN '[m' || user_id || '] [because]' WHEN 'view' THEN '[m' || user_id || '] [plain words]' WHEN 'purchase' THEN 'stated'
  WHEN 'signup' THEN '[No missed motives] [No additional themes missed]' ELSE '[LLM Error] [Empty response]' END analysis FROM events""")
def parsed_analyses(spark: SparkSession, sf: str) -> DataFrame:
    motive, kind = F.concat(F.lit("[m"), "user_id", F.lit("]")), F.col("event_type")
    raw = (F.when(kind == "click", F.concat(F.lit("Well: "), motive, F.lit(" [because]"))).when(kind == "view", F.concat(motive, F.lit(" plain words")))
           .when(kind == "purchase", '{"analysis": "stated"}').when(kind == "signup", "[No missed motives] [nothing]").otherwise(""))
    return table(spark, sf, "events").select("event_id", text.parse_analysis(raw).alias("analysis"))


@query("topics_from_json", """WITH t AS (SELECT DISTINCT p_type, p_brand FROM part), r AS (SELECT p_type category, p_brand theme, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) - 1 pos FROM t)
  SELECT category, CAST(pos AS INTEGER) pos, theme FROM r""")
def topics_from_json_query(spark: SparkSession, sf: str) -> DataFrame:
    """Topic universe written in the three layouts and read back."""
    listed = table(spark, sf, "part").select("p_type", "p_brand").distinct().groupBy("p_type").agg(F.array_sort(F.collect_list("p_brand")).alias("b"))
    plain = F.to_json("b")
    objects = F.to_json(F.struct(F.transform("b", lambda x: F.struct(x.alias("topic_name"))).alias("topics")))
    themes = F.to_json(F.struct(F.col("b").alias("themes")))
    body = F.when(F.col("p_type") < "M", plain).when(F.col("p_type") < "Q", objects).otherwise(themes)
    raw = listed.select(F.concat(F.lit('{"'), "p_type", F.lit('": '), body, F.lit("}")).alias("raw"))
    return topics_from_json(raw, F.col("raw"))


_FUZZY = """nm AS (SELECT DISTINCT p_name n FROM part), tp AS (SELECT unnest(['ring', 'large bolt', 'cold washer', 'small gear']) t),
  sc AS (SELECT n, t, CASE WHEN n = t THEN 1.0::DOUBLE WHEN contains(n, t) OR contains(t, n) THEN 0.85::DOUBLE ELSE greatest(1 - levenshtein(n, t)::DOUBLE / greatest(length(n), length(t)),
    0.9::DOUBLE * len(list_intersect(string_split(n, ' '), string_split(t, ' '))) / len(list_distinct(list_concat(string_split(n, ' '), string_split(t, ' '))))) END s FROM nm, tp),
  bs AS (SELECT n, max(s) s FROM sc GROUP BY 1)"""


def _topic_rows(spark: SparkSession, sf: str) -> DataFrame:
    names = ["ring", "large bolt", "cold washer", "small gear"]
    first = table(spark, sf, "region").filter(F.col("r_regionkey") == 0)
    return first.select(F.lit("all").alias("category"), F.posexplode(F.array(*[F.lit(n) for n in names])).alias("pos", "theme"))


@query("fuzzy_theme_matches", f"WITH {_FUZZY} SELECT n theme, round(s, 6) similarity FROM bs WHERE s >= 0.6")
def fuzzy_theme_matches(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.lit("all").alias("category"), F.col("p_name").alias("theme"))
    found = fuzzy.best_fuzzy(names, _topic_rows(spark, sf), 0.6)
    return rounded(found.select("theme", "similarity"))


@query("vector_theme_matches", """WITH v AS (SELECT DISTINCT p_brand t, CAST(embedding AS DOUBLE[]) e FROM part JOIN embeddings ON vec_id = CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT)),
  s AS (SELECT a.t theme, b.t topic, list_cosine_similarity(a.e, b.e) s FROM v a JOIN v b ON b.t IN ('Brand#1', 'Brand#2', 'Brand#3')), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY s DESC) n FROM s)
  SELECT theme, topic, round(s, 6) similarity FROM r WHERE n = 1 AND s >= 0.05""")
def vector_theme_matches(spark: SparkSession, sf: str) -> DataFrame:
    vectors = brand_vectors(spark, sf)
    names = vectors.select(F.lit("all").alias("category"), "theme")
    topics = names.filter(F.col("theme").isin("Brand#1", "Brand#2", "Brand#3")).withColumn("pos", F.regexp_extract("theme", r"(\d+)", 1).cast("int"))
    return rounded(fuzzy.best_by_vector(names, topics, vectors, 0.05).select("theme", "topic", "similarity"))


@query("distributions_onto_topics", f"""WITH {_FUZZY}, pk AS (SELECT n, (SELECT min(t) FROM sc WHERE sc.n = bs.n AND sc.s = bs.s) t FROM bs WHERE s >= 0.6),
  l AS (SELECT l_orderkey k, p_name n, sum(l_quantity) p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  m AS (SELECT k, t, sum(p) p FROM l LEFT JOIN pk USING (n) GROUP BY 1, 2), tt AS (SELECT k, sum(p) FILTER (WHERE t IS NOT NULL) s FROM m GROUP BY 1)
  SELECT tt.k, tp.t topic, round(CASE WHEN s IS NULL THEN 0.25 ELSE coalesce(m.p, 0) / s END, 6) p FROM tt CROSS JOIN tp LEFT JOIN m ON m.k = tt.k AND m.t = tp.t""")
def distributions_onto_topics(spark: SparkSession, sf: str) -> DataFrame:
    probs = sides(spark, sf, "p_name").groupBy(F.col("k").alias("review_key"), F.col("t").alias("theme")).agg(F.sum("a").alias("p")).withColumn("category", F.lit("all"))
    # equally similar topics: the alphabetically first is wanted here, so the list is given in that order
    topics = _topic_rows(spark, sf).withColumn("pos", F.when(F.col("theme") == "cold washer", 0).when(F.col("theme") == "large bolt", 1).when(F.col("theme") == "ring", 2).otherwise(3))
    matches = fuzzy.best_fuzzy(probs, topics, 0.6)
    return rounded(fuzzy.onto_topic_list(probs, topics, [matches]).select(F.col("review_key").alias("k"), "topic", "p"))


@query("renamed_theme_lists", """WITH l AS (SELECT l_orderkey k, (l_linenumber, p_brand) i, CASE p_brand WHEN 'Brand#1' THEN 'Brand#2' WHEN 'Brand#3' THEN 'three' ELSE p_brand END t
    FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT k, t, min(i) i FROM l GROUP BY 1, 2)
  SELECT k, string_agg(t, ',' ORDER BY i) themes FROM f GROUP BY 1""")
def renamed_theme_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Each review's themes in line order; two names become one."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    listed = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_brand"))).alias("e"))
    names = F.create_map(*[F.lit(x) for x in ("Brand#1", "Brand#2", "Brand#3", "three")])
    return listed.select("k", F.array_join(text.rename_list(F.transform("e", lambda x: x["p_brand"]), names), ",").alias("themes"))
