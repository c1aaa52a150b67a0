"""Cleaning, validation with reasons and deduplication of review rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from populi.functions.base import blank, non_empty, present
from populi.functions.dist import finite_entries, positive_entries
from populi.functions.text import cluster_number, has_description, product_description
from populi.operators.groups import keep_first, keep_last


def unify_ids(df: DataFrame) -> DataFrame:
    """One user id and one product id out of the alternative fields of raw review lines."""
    filled = lambda name: F.when(F.col(name) != "", F.col(name))
    return df.withColumns({"user_id": F.coalesce(filled("reviewerID"), F.col("user_id")),
                           "asin": F.coalesce(filled("parent_asin"), F.col("asin"))}).drop("reviewerID", "parent_asin")


def needed_products(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Product lines named by some review, through either of their ids."""
    ids = reviews.select("asin").distinct()
    by = lambda column: products.join(ids.withColumnRenamed("asin", column), column, "left_semi")
    own = by("asin")
    parents = by("parent_asin").join(own.select("pos"), "pos", "left_anti")
    return own.unionByName(parents)


def attach_product(reviews: DataFrame, products: DataFrame, default_category: str | None = None) -> DataFrame:
    """Left join of reviews to product lines by either product id; the later line wins for an id.

    `products` carries a line number `pos`; a line's parent id and own id both name it."""
    ids = F.array_distinct(F.array_compact(F.array(F.when(present(F.col("parent_asin")), F.col("parent_asin")),
                                                   F.when(present(F.col("asin")), F.col("asin")))))
    by_id = keep_last(products.select(F.explode(ids).alias("asin"), "title", "main_category", "description", "pos"),
                      ["asin"], "pos").drop("pos")
    joined = reviews.join(by_id, "asin", "left")
    found = F.col("title").isNotNull() | F.col("description").isNotNull() | F.col("main_category").isNotNull()
    return (joined.withColumn("product_description", F.when(
                found, product_description(F.col("description"), F.coalesce("title", F.lit("N/A")))))
            .withColumn("category", F.coalesce("main_category", F.lit(default_category)))
            .drop("title", "main_category", "description"))


def with_valid_description(df: DataFrame) -> DataFrame:
    return df.filter(has_description(F.col("product_description")))


def new_rows(df: DataFrame, keys: Sequence[str], existing: DataFrame | None = None,
             position: Sequence[str] = ()) -> DataFrame:
    """First row of each key that is not already in `existing`."""
    fresh = keep_first(df, keys, *position) if position else df.dropDuplicates(list(keys))
    return fresh if existing is None else fresh.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def prediction_duplicates_removed(df: DataFrame, text: str, asin: str, user: str, position: str,
                                  prefix: int | None = None) -> DataFrame:
    """First row of each (text, product, user); a caller may state a prefix, which then stands for the text."""
    whole = F.coalesce(text, F.lit(""))
    keyed = df.withColumn("__text", F.md5(whole if prefix is None else F.substring(whole, 1, prefix)))
    return keep_first(keyed, ["__text", asin, user], position).drop("__text")


def task_duplicates_removed(df: DataFrame, user: str, asin: str, timestamp: str, text: str,
                            position: str, prefix: int | None = None) -> DataFrame:
    """First row of each (user, product, time, text)."""
    return prediction_duplicates_removed(
        df.withColumn("__ua", F.concat_ws("|", user, F.col(timestamp).cast("string"))), text, asin, "__ua", position,
        prefix).drop("__ua")


def pollution_reason(text: Column, user: Column) -> Column:
    return (F.when(blank(text), "missing_or_empty_review_text")
            .when(user.isNull() | (user == ""), "missing_user_id"))


def split_by_reason(df: DataFrame, reason: Column, column: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with one); the second goes to a reject sink."""
    tagged = df.withColumn(column, reason)
    return tagged.filter(F.col(column).isNull()).drop(column), tagged.filter(F.col(column).isNotNull())


def user_validity(reviews: DataFrame, user: str = "user_id", text: str = "review_text") -> DataFrame:
    """One row per user: number of reviews and the reason the user is unusable, if any."""
    return (reviews.groupBy(user).agg(F.count(F.lit(1)).alias("n_reviews"),
                                      F.max(present(F.col(text))).alias("__any"))
            .withColumn("reason", F.when(blank(F.col(user)), "invalid_user_id")
                        .when(~F.coalesce("__any", F.lit(False)), "no_review_text")).drop("__any"))


def themed_reviews(df: DataFrame, themes: str = "themes") -> DataFrame:
    return df.filter(F.size(themes) > 0)


def clean_distribution(m: Column, positive: bool = False) -> Column:
    """Drop null, NaN and infinite values, and on request zeros; an empty result is null."""
    kept = finite_entries(m)
    return non_empty(positive_entries(kept) if positive else kept)


def _finite(value: Column, kind: DataType) -> Column:
    """The value with every NaN or infinite number inside it null, at any depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if not _holds_numbers(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    return F.when(value.isNotNull(), F.struct(*[_finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))


def _holds_numbers(kind: DataType) -> bool:
    inner = ([kind.elementType] if isinstance(kind, ArrayType) else [kind.valueType] if isinstance(kind, MapType)
             else [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [])
    return isinstance(kind, (DoubleType, FloatType)) or any(map(_holds_numbers, inner))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Doubles that are NaN or infinite become null, inside maps, arrays and structs too, ready for a JSON sink."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def in_clusters(df: DataFrame, column: str, targets: Sequence[str | int]) -> DataFrame:
    """Rows of the given clusters, named cluster_3, segment_3 or 3; an empty list keeps all rows."""
    numbers = [int(str(t).rsplit("_", 1)[-1]) for t in targets]
    return df.filter(cluster_number(F.col(column)).isin(numbers)) if numbers else df


def history_rows(df: DataFrame, required: Sequence[str] = ("product_description", "review_text")) -> DataFrame:
    """Rows fit for a review history: every required text is present."""
    for name in required:
        df = df.filter(present(F.col(name)))
    return df


def in_categories(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(categories)))


def require_themes(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Tag rows whose map is missing or empty; in strict mode such a row fails the job."""
    empty = F.coalesce(F.size(column) <= 0, F.lit(True))
    if not strict:
        return df.withColumn("reason", F.when(empty, "missing_" + column))
    return df.filter(F.assert_true(~empty, f"{column} must not be empty").isNull())
