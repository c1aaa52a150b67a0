"""Readers: files to flat tables. Every read names its schema; paths may be local, s3a:// or any Hadoop path, and
.json and .json.gz alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from populi import schema as S
from populi.functions.base import let, non_empty, present
from populi.functions.dist import uniform
from populi.functions.text import underscored_category
from populi.sources.entries import line_place, object_entries


# ---- shapes that differ from file to file ------------------------------------------------------------------------

def theme_map(raw: Column) -> Column:
    """JSON text of an object {theme: p} or a list of names (then uniform) as map<string,double>."""
    text = F.trim(raw)
    return (F.when(text.startswith("["), uniform(F.from_json(text, "array<string>")))
            .when(text.startswith("{"), F.from_json(text, "map<string,double>")))


def theme_names(raw: Column) -> Column:
    """JSON text of a list of names, or of an object whose entries count when they are not zero."""
    text = F.trim(raw)
    named = F.map_keys(F.map_filter(F.from_json(text, "map<string,double>"), lambda _, v: v != 0))
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), named)


def yes_probabilities(raw: Column) -> Column:
    """JSON text of {theme: p} or {theme: {prob_yes, prob_no}} as map<theme, p>."""
    nested = F.from_json(raw, "map<string,struct<prob_yes:double,prob_no:double>>")
    flat = F.from_json(raw, "map<string,double>")
    return F.coalesce(non_empty(F.map_filter(flat, lambda _, v: v.isNotNull())),
                      F.transform_values(nested, lambda _, v: v["prob_yes"]))


def logprob_map(raw: Column) -> Column:
    """JSON text of {theme: {logprob_yes|yes, logprob_no|no}} as map<theme, struct<logprob_yes, logprob_no>>."""
    parsed = F.from_json(raw, "map<string,struct<logprob_yes:double,logprob_no:double,yes:double,no:double>>")
    return F.transform_values(parsed, lambda _, v: F.struct(
        F.coalesce(v["logprob_yes"], v["yes"]).alias("logprob_yes"),
        F.coalesce(v["logprob_no"], v["no"]).alias("logprob_no")))


def first_actual(review: Column) -> Column:
    """Actual side by priority: topic_probabilities, then themes, then predicted_themes."""
    return F.coalesce(*[let(theme_map(review[name]), non_empty) for name in ("topic_probabilities", "themes", "predicted_themes")])


# ---- reviews, products, users ------------------------------------------------------------------------------------

def raw_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Raw review lines; blank and malformed lines are dropped. `pos` orders them by file and place in it."""
    return (spark.read.schema(S.RAW_REVIEW).option("mode", "DROPMALFORMED").json(path).select("*", line_place().alias("pos"))
            .filter(F.coalesce("reviewerID", "user_id").isNotNull()).withColumn("file", F.col("pos.file")))


def products(spark: SparkSession, path: str) -> DataFrame:
    """Product lines; a description given as a list becomes one text. `pos` orders them by file and place in it."""
    rows = spark.read.schema(S.PRODUCT).option("mode", "DROPMALFORMED").json(path).select("*", line_place().alias("pos"))
    parts = F.from_json("description", "array<string>")
    text = F.when(F.trim("description").startswith("["), F.array_join(parts, " ")).otherwise(F.col("description"))
    return rows.withColumn("description", text)


def user_quotas(spark: SparkSession, path: str, *, per_user_cap: int | None = None,
                max_users: int | None = None) -> DataFrame:
    """(user_id, quota) from tab-separated lines; # and = lines, and lines without a number, are passed over."""
    parts = F.split(F.trim("value"), "\t")
    rows = (spark.read.text(path).select(line_place().alias("pos"), F.trim("value").alias("value"))
            .filter(present(F.col("value")) & ~F.col("value").rlike("^[#=]"))
            .select("pos", F.trim(F.get(parts, 0)).alias("user_id"), F.trim(F.get(parts, 1)).try_cast("int").alias("quota")))
    if per_user_cap is not None:
        rows = rows.filter(F.col("quota").isNotNull()).withColumn("quota", F.least("quota", F.lit(per_user_cap)))
    # a user listed twice keeps the first place and the last number
    listed = rows.filter(F.col("quota") > 0).groupBy("user_id").agg(
        F.min("pos").alias("pos"), F.max_by("quota", "pos").alias("quota"))
    listed = listed.orderBy("pos").limit(max_users) if max_users is not None else listed
    return listed.select("user_id", "quota")


def category_quotas(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, category, quota) from lines 'user<TAB>Category:n, Category:n'."""
    parts = F.split(F.trim("value"), "\t")
    return (spark.read.text(path).filter(present(F.col("value")) & ~F.trim("value").rlike("^[#=]"))
            .select(F.trim(F.get(parts, 0)).alias("user_id"),
                    F.explode(F.split(F.get(parts, 1), r",\s*")).alias("entry"))
            .select("user_id", F.trim(F.regexp_extract("entry", r"^(.*):\s*\d+\s*$", 1)).alias("category"),
                    F.regexp_extract("entry", r":\s*(\d+)\s*$", 1).try_cast("int").alias("quota"))
            .filter(F.col("quota").isNotNull()))


def flatten_users(documents: DataFrame, *carry: str) -> DataFrame:
    """(user_id, review_idx, review fields) from documents users map<user, struct<reviews array<struct>>>."""
    return (documents.select(*carry, F.explode("users").alias("user_id", "doc"))
            .select(*carry, "user_id", F.posexplode("doc.reviews").alias("review_idx", "r"))
            .select(*carry, "user_id", "review_idx", "r.*"))


def user_reviews(spark: SparkSession, path: str, *, end: str = "}") -> DataFrame:
    """Reviews from {user: {reviews: [...]}} files, one object of any size or one a line; reviews with blank text are dropped.

    A user may have several entries, as writers.user_documents cuts them: each names as `first` how many of the user's
    reviews come before it. end: see object_entries."""
    document = F.from_json("value", f"first int, reviews array<struct<{_colon(S.NESTED_REVIEW)}>>")
    docs = object_entries(spark, path, end=end).select(F.col("key").alias("user_id"), document.alias("d"))
    rows = docs.select("user_id", F.coalesce("d.first", F.lit(0)).alias("first"), F.posexplode("d.reviews").alias("i", "r"))
    return rows.select("user_id", (F.col("first") + F.col("i")).alias("review_idx"), "r.*").filter(present(F.col("review_text")))


def _colon(ddl: str) -> str:
    return ",".join(":".join(field.strip().split(" ", 1)) for field in ddl.split(","))


def user_review_parts(spark: SparkSession, path: str) -> DataFrame:
    """Reviews from the documents written by writers.user_documents."""
    docs = spark.read.schema(f"user_id string, part int, reviews array<struct<{_colon(S.NESTED_REVIEW)}>>").json(path)
    return docs.select("user_id", F.explode("reviews").alias("r")).select("user_id", "r.*")


def category_texts(reviews: DataFrame, category: str) -> DataFrame:
    return reviews.filter(F.col("category") == category).select(F.trim("review_text").alias("text"))


def classifications(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classification rows, rejected lines with their text)."""
    lines = spark.read.text(path).select("value", line_place().alias("pos")).filter(present(F.col("value")))
    rows = lines.withColumn("r", F.from_json("value", S.CLASSIFICATION + ", _corrupt string",
                                             {"columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("r._corrupt").isNotNull() | F.col("r.review_id").isNull()
    return rows.filter(~broken).select("r.*", "pos").drop("_corrupt"), rows.filter(broken).select("value")


def topic_universe(spark: SparkSession, path: str) -> DataFrame:
    """(category, pos, theme) from {category: [...]}, {category: {topics|themes: [...]}}; entries are names or objects
    with a topic_name. Categories are spelled with underscores."""
    return _topics(object_entries(spark, path, end=",").select(F.col("key").alias("category"), F.col("value").alias("body")))


def topics_from_json(df: DataFrame, raw: Column) -> DataFrame:
    """The same from a column of JSON text."""
    return _topics(df.select(F.explode(F.from_json(raw, "map<string,string>")).alias("category", "body")))


def _topics(bodies: DataFrame) -> DataFrame:
    listed = F.when(F.trim("body").startswith("["), F.from_json("body", "array<string>")).otherwise(
        F.coalesce(F.from_json("body", "topics array<string>")["topics"],
                   F.from_json("body", "themes array<string>")["themes"]))
    name = F.when(F.trim("entry").startswith("{"), F.get_json_object("entry", "$.topic_name")).otherwise(F.col("entry"))
    return (bodies.select(underscored_category(F.col("category")).alias("category"), F.posexplode(listed).alias("pos", "entry"))
            .select("category", "pos", name.alias("theme")).filter(F.col("theme").isNotNull()))


def learned_records(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Records of a learned table (see schema.RECORDS) from {key: record} files of any size, one object or one a line; a
    record without its own id takes the key."""
    rows = object_entries(spark, path).select("key", F.from_json("value", f"struct<{S.RECORDS[table]}>").alias("r")).filter(F.col("r").isNotNull())
    id_field = S.RECORDS[table].split(":", 1)[0]
    return rows.withColumn("r", F.col("r").withField(id_field, F.coalesce(F.col(f"r.{id_field}"), F.col("key")))).select("r.*")


def category_map(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """{main: [names]} of a mapping file, in the form functions.text.main_category takes (a few dozen entries)."""
    row = (spark.read.text(path, wholetext=True)
           .select(F.from_json("value", "category_to_main_mapping map<string,string>")["category_to_main_mapping"]
                   .alias("m")).first())
    groups: dict[str, list[str]] = {}
    for name, main in (row["m"] or {}).items():
        groups.setdefault(main, []).append(name)
    return groups


# ---- prediction, ground-truth, delta and journey trees -------------------------------------------------------------

def _tree(spark: SparkSession, path: str, ddl: str, pattern: str = "*.json", lines: bool = False) -> DataFrame:
    """Documents of the JSON files of a directory tree, with cluster and micro ids taken from their paths.

    A file holds one small document or, with `lines`, one a line: so many tribes need few files, which Spark splits. Such
    documents name cluster_id and micro_id themselves where the path does not; `file` is then the line's place."""
    if lines and "cluster_id" not in ddl:
        ddl += ", cluster_id string, micro_id string"
    rows = (spark.read.schema(ddl).option("multiLine", not lines).option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).json(path).withColumn("__path", F.col("_metadata.file_path")))
    rows = rows.withColumn("file", line_place() if lines else F.col("__path"))
    number = lambda word: F.regexp_extract("__path", rf"{word}_(\d+)", 1)
    tag = lambda word: F.when(number(word) != "", F.concat(F.lit(word + "_"), number(word)))
    own = lambda name: [F.col(name)] if lines and name in rows.columns else []
    return rows.withColumns({"path_cluster": F.coalesce(*own("cluster_id"), tag("cluster")), "path_micro": F.coalesce(*own("micro_id"), tag("micro"))}).drop("__path")


def prediction_tree(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per predicted review; files without user_predictions are skipped."""
    files = _tree(spark, path, S.PREDICTION_FILE, lines=lines).filter(F.col("user_predictions").isNotNull())
    rows = (files.select("file", F.col("path_cluster").alias("cluster_id"), F.col("path_micro").alias("micro_id"),
                         F.coalesce("persona_name", "metadata.persona_name").alias("persona_name"),
                         F.explode("user_predictions").alias("user_id", "reviews"))
            .select("*", F.posexplode("reviews").alias("review_idx", "r")).drop("reviews"))
    return rows.select(
        "file", "cluster_id", "micro_id", "persona_name", "user_id", "review_idx", "r.product_description", "r.category",
        "r.asin", F.col("r.prediction.review_text").alias("predicted_text"),
        F.col("r.prediction.rating").try_cast("double").alias("predicted_rating"),
        F.col("r.prediction.sentiment").alias("predicted_sentiment"),
        theme_map(F.col("r.prediction.predicted_themes")).alias("predicted"),
        F.col("r.actual.review_text").alias("actual_text"),
        F.col("r.actual.rating").try_cast("double").alias("actual_rating"),
        F.col("r.actual.sentiment").alias("actual_sentiment"), first_actual(F.col("r.actual")).alias("actual"))


def baseline_predictions(spark: SparkSession, path: str, end: str = "}") -> DataFrame:
    """Flat files {user_review_i: {...}} of any size in the layout of prediction_tree. end: see object_entries."""
    entry = (f"struct<product_description:string,category:string,asin:string,prediction:struct<{S.SIDE}>,"
             f"actual:struct<{S.SIDE},themes:string,topic_probabilities:string>>")
    rows = (object_entries(spark, path, end=end).filter(F.col("key").rlike(r"_review_\d+$"))
            .select("key", F.from_json("value", entry).alias("r")))
    return rows.select(
        F.regexp_extract("key", r"^(.*)_review_(\d+)$", 1).alias("user_id"),
        F.regexp_extract("key", r"^(.*)_review_(\d+)$", 2).cast("int").alias("review_idx"), "r.product_description",
        "r.category", "r.asin", F.col("r.prediction.review_text").alias("predicted_text"),
        F.col("r.prediction.rating").try_cast("double").alias("predicted_rating"),
        F.col("r.prediction.sentiment").alias("predicted_sentiment"),
        theme_map(F.col("r.prediction.predicted_themes")).alias("predicted"),
        F.col("r.actual.review_text").alias("actual_text"),
        F.col("r.actual.rating").try_cast("double").alias("actual_rating"),
        F.col("r.actual.sentiment").alias("actual_sentiment"), first_actual(F.col("r.actual")).alias("actual"))


def predictions(spark: SparkSession, path: str, layout: str, lines: bool = False) -> DataFrame:
    """One schema for every layout: tree | baseline | topic_list (records with topic_probabilities at the top).

    lines: the files of a tree hold a document a line, those of a baseline an entry a line."""
    if layout == "tree":
        return prediction_tree(spark, path, lines).drop("file")
    if layout == "baseline":
        return baseline_predictions(spark, path, "\n" if lines else "}").withColumns(
            {"cluster_id": F.lit(None).cast("string"), "micro_id": F.lit(None).cast("string"),
             "persona_name": F.lit(None).cast("string")})
    if layout == "topic_list":
        rows = spark.read.schema("user_id string, product_description string, category string, asin string, "
                                 "review_text string, rating string, sentiment string, topic_probabilities string, "
                                 f"prediction struct<{S.SIDE}>").option("multiLine", True).json(path)
        return rows.select("user_id", F.lit(None).cast("int").alias("review_idx"), "product_description", "category",
                           "asin", F.coalesce("prediction.review_text", "review_text").alias("predicted_text"),
                           F.coalesce("prediction.rating", "rating").try_cast("double").alias("predicted_rating"),
                           F.coalesce("prediction.sentiment", "sentiment").alias("predicted_sentiment"),
                           F.coalesce(non_empty(theme_map(F.col("topic_probabilities"))),
                                      theme_map(F.col("prediction.predicted_themes"))).alias("predicted"))
    raise ValueError(f"unknown layout {layout!r}")


def detect_layout(spark: SparkSession, path: str) -> str:
    """tree for a folder with tribe accuracy files, topic_list for a file holding a list, baseline for one holding an object."""
    if not path.rstrip("/").endswith((".json", ".json.gz")):
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", "micro_*accuracy.json").load(path).select("path"))
        if files.limit(1).count() == 0:
            raise ValueError(f"no prediction files below {path}")
        return "tree"
    head = spark.read.text(path).filter(present(F.col("value"))).select(F.substring(F.trim("value"), 1, 1)).first()
    return "topic_list" if head and head[0] == "[" else "baseline"


def all_predictions(spark: SparkSession, sources: dict[str, str], lines: bool = False) -> DataFrame:
    """Union of several sources given as {path: layout}, with missing fields null; layout auto looks at the path."""
    result = None
    for path, layout in sources.items():
        layout = detect_layout(spark, path) if layout == "auto" else layout
        rows = predictions(spark, path, layout, lines).withColumn("layout", F.lit(layout))
        result = rows if result is None else result.unionByName(rows, allowMissingColumns=True)
    return result


def ground_truth_tree(spark: SparkSession, path: str, pattern: str = "*_details.json", lines: bool = False) -> DataFrame:
    """One row per ground-truth review, in the order (file, user, index) as pos; see match.match_to_truth."""
    files = _tree(spark, path, S.GROUND_TRUTH_FILE, pattern, lines)
    rows = (files.select("file", F.col("path_cluster").alias("cluster_id"), F.col("path_micro").alias("micro_id"),
                         "persona_name", F.explode("members_grouped_by_user").alias("user_id", "reviews"))
            .select("*", F.posexplode("reviews").alias("review_idx", "r")).drop("reviews")
            .filter((F.coalesce("r.product_description", F.lit("")) != "") & (F.coalesce("r.category", F.lit("")) != "")))
    return rows.select("cluster_id", "micro_id", "persona_name", "user_id", "r.product_description", "r.category",
                       "r.review_text", "r.rating", "r.sentiment", "r.asin",
                       theme_map(F.col("r.topic_probabilities")).alias("actual"),
                       yes_probabilities(F.col("r.topic_probabilities_before_normalisation")).alias("before"),
                       logprob_map(F.col("r.topic_logprobs")).alias("logprobs"), "r.predicted_themes",
                       F.struct("file", "user_id", "review_idx").alias("pos"))


def delta_tree(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    files = _tree(spark, path, S.DELTA_FILE, lines=lines)
    return (files.select(F.coalesce("cluster_id", "path_cluster").alias("cluster_id"),
                         F.coalesce("micro_cluster_id", "path_micro").alias("micro_id"), F.explode("deltas").alias("d"))
            .select("cluster_id", "micro_id", "d.review_key", "d.user_id", "d.review_idx", "d.text_delta", "d.theme_delta",
                    "d.theme_jsd", "d.overall_delta", theme_map(F.col("d.prediction.predicted_themes")).alias("predicted"),
                    theme_map(F.col("d.actual.predicted_themes")).alias("actual")))


def journey_tree(spark: SparkSession, path: str, pattern: str = "*_journey.json") -> DataFrame:
    """One row per review with `initial` and `steps` as operators.journey takes them.

    Name the folder of the journey files itself: Spark passes over folders that start with an underscore."""
    entries = object_entries(spark, path, pattern=pattern)
    number = lambda word: F.regexp_extract("file", rf"{word}_(\d+)", 1)
    rows = entries.select(F.concat(F.lit("cluster_"), number("cluster")).alias("cluster_id"),
                          F.concat(F.lit("micro_"), number("micro")).alias("micro_id"), F.col("key").alias("review_key"),
                          F.from_json("value", f"struct<{S.JOURNEY_ENTRY}>").alias("j")).filter(F.col("j").isNotNull())
    step = lambda s: F.struct(s["iteration"].alias("iteration"), s["new_theme_delta"].alias("theme"),
                              s["new_overall_delta"].alias("overall"), s["new_text_delta"].alias("text"),
                              s["corrected_prediction_data"].alias("prediction"))
    steps = F.filter(F.transform(F.coalesce("j.correction_journey", F.array()), step), lambda s: s["iteration"] >= 1)
    d = F.col("j.initial_prediction_deltas")
    first = F.struct(F.lit(0).alias("iteration"), d["theme_delta"].alias("theme"), d["overall_delta"].alias("overall"),
                     d["text_delta"].alias("text"), F.col("j.initial_prediction_data").alias("prediction"))
    return rows.select("cluster_id", "micro_id", "review_key", "j.user_id", "j.review_idx", first.alias("initial"),
                       F.array_sort(F.concat(F.array(first), steps)).alias("steps"))


def cluster_texts(spark: SparkSession, path: str, cluster: str) -> DataFrame:
    """Review texts of one cluster from tribe seeds, whether members sit at the top level or under details."""
    member = "members_grouped_by_user map<string,array<struct<review_text:string>>>"
    seeds = object_entries(spark, path).select("key", F.from_json(
        "value", f"tribe_id string, {member}, details struct<{member.replace(' ', ':', 1)}>").alias("s"))
    at = lambda place: seeds.select(F.coalesce("s.tribe_id", "key").alias("tribe_id"), F.explode(place).alias("user_id", "rs"))
    rows = at("s.members_grouped_by_user").unionByName(at("s.details.members_grouped_by_user"))
    number = int(cluster.rsplit("_", 1)[-1])
    return (rows.filter(F.regexp_extract("tribe_id", r"(?:segment|cluster)_(\d+)", 1) == str(number))
            .select("tribe_id", "user_id", F.explode("rs.review_text").alias("text")).filter(present(F.col("text"))))
