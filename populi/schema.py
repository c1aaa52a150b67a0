"""Record schemas and validation rules of the learned tables.

A rule is a name and a SQL condition that valid rows satisfy; a condition that evaluates to null counts as broken, so
optional fields are written with IS NULL OR. validate() splits nothing: it tags rows with the names of broken rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_REVIEW = ("reviewerID string, user_id string, asin string, parent_asin string, text string, rating double, "
              "timestamp bigint")
PRODUCT = "parent_asin string, asin string, title string, main_category string, description string"
NESTED_REVIEW = ("product_description string, review_text string, rating double, category string, timestamp string, "
                 "asin string")
CLASSIFICATION = ("review_id string, user_id string, review string, category string, identified_themes array<string>, "
                  "theme_token_probabilities map<string,double>, sentiment string, rating double, asin string, "
                  "timestamp string, error string")
SIDE = "review_text:string,rating:string,sentiment:string,predicted_themes:string"
PREDICTION_FILE = (
    "persona_name string, metadata struct<persona_name:string>, "
    "user_predictions map<string,array<struct<product_description:string,category:string,asin:string,"
    f"prediction:struct<{SIDE}>,actual:struct<{SIDE},themes:string,topic_probabilities:string>>>>")
GROUND_TRUTH_FILE = (
    "persona_name string, members_grouped_by_user map<string,array<struct<product_description:string,category:string,"
    "review_text:string,rating:double,sentiment:string,asin:string,topic_probabilities:string,"
    "topic_probabilities_before_normalisation:string,topic_logprobs:string,predicted_themes:array<string>>>>")
DELTA_FILE = (
    "cluster_id string, micro_cluster_id string, deltas array<struct<review_key:string,user_id:string,review_idx:int,"
    "text_delta:double,theme_delta:double,theme_jsd:double,overall_delta:double,"
    "prediction:struct<predicted_themes:string>,actual:struct<predicted_themes:string>>>")
CORRECTION = ("iteration:int,new_text_delta:double,new_theme_delta:double,new_overall_delta:double,"
              "corrected_prediction_data:string")
JOURNEY_ENTRY = (
    "user_id:string,review_idx:int,"
    "initial_prediction_deltas:struct<text_delta:double,theme_delta:double,overall_delta:double>,"
    f"initial_prediction_data:string,correction_journey:array<struct<{CORRECTION}>>")

_SUMMARY = "struct<influencing_characteristics_summary:string>"
_LIST = "array<string>"
RECORDS: dict[str, str] = {
    "user_backstory": f"user_id:string,overall_characteristics:{_SUMMARY},category_characteristics:map<string,{_SUMMARY}>,"
                      f"num_categories:int,categories:{_LIST}",
    "user_embedding": f"user_id:string,user_embedding:array<double>,user_categories:{_LIST},embedding_model:string,"
                      "embedding_dimension:int,embedding_text:string",
    "user_review_history": "user_id:string,review_history:array<struct<review_id:string,product_description:string,"
                           "review_text:string>>",
    "user_segments": "user_id:string,segment_id:string,segment_name:string,user_embedding:array<double>,"
                     "cluster_metadata:struct<silhouette_score:double,cluster_size:int,davies_bouldin_score:double,"
                     "balance_ratio:double>",
    "user_tribe": "user_id:string,segment_id:string,tribe_id:string,tribe_name:string,similarity_score:double,"
                  "tribe_metadata:struct<total_users:int,total_reviews:int,persona_name:string,relaxed_criteria:boolean>",
    "tribe_seed_characteristics":
        "tribe_id:string,persona_name:string,total_users_in_cluster:int,total_reviews_from_cluster:int,"
        "quantitative_summary:struct<average_rating:string,sentiment_distribution_percent:map<string,double>>,"
        f"qualitative_summary:struct<persona_summary:string,key_motivations:{_LIST},common_praises:{_LIST},"
        f"common_criticisms:{_LIST},core_characteristics:{_LIST},potential_goals:{_LIST}>,justification:string,key_topics:{_LIST},"
        "member_user_characteristics:array<struct<user_id:string,characteristic_summary:string>>",
}

_SENTIMENTS = "('Positive', 'Negative', 'Neutral')"


def _unit(name: str, optional: bool = False) -> tuple[str, str]:
    test = f"{name} BETWEEN 0 AND 1"
    return f"{name}_in_0_1", f"{name} IS NULL OR {test}" if optional else test


def _filled(name: str) -> tuple[str, str]:
    return f"{name}_present", f"{name} IS NOT NULL AND trim({name}) <> ''"


def _at_least(name: str, low: int, optional: bool = False) -> tuple[str, str]:
    test = f"{name} >= {low}"
    return f"{name}_at_least_{low}", f"{name} IS NULL OR {test}" if optional else test


_PREDICTION = [("rating_in_1_5", "rating BETWEEN 1 AND 5"), ("sentiment_known", f"sentiment IN {_SENTIMENTS}"),
               ("predicted_themes_given", "predicted_themes IS NOT NULL")]
_BASELINE = [_filled("user_id"), _at_least("review_index", 0), _filled("product_description"), _filled("category"),
             ("review_type_known", "review_type IS NULL OR review_type IN ('first', 'intermediate', 'last')"),
             ("method_known", "method IN ('history', 'backstory')"), ("model_known", "model IN ('o3', 'claude')")]

RULES: dict[str, list[tuple[str, str]]] = {
    "topic_universe": [_filled("category"), ("topics_given", "topics IS NOT NULL"),
                       ("topics_named", "NOT exists(topics, t -> t IS NULL OR trim(t) = '')")],
    "review_topic_classification": [
        _filled("review_id"), _filled("user_id"), ("review_not_empty", "length(review) >= 1"),
        ("category_not_empty", "length(category) >= 1"), ("themes_given", "identified_themes IS NOT NULL"),
        ("probabilities_given", "theme_token_probabilities IS NOT NULL"), _filled("sentiment")],
    "user_backstory": [_filled("user_id"), _filled("overall_summary"), _at_least("num_categories", 0),
                       ("categories_given", "categories IS NOT NULL")],
    "user_embedding": [_filled("user_id"), ("embedding_not_empty", "size(user_embedding) > 0"),
                       ("dimension_matches", "size(user_embedding) = embedding_dimension")],
    "user_review_history": [_filled("user_id"), ("history_not_empty", "size(review_history) > 0")],
    "user_segments": [_filled("user_id"), _filled("segment_id"), ("embedding_not_empty", "size(user_embedding) > 0"),
                      _at_least("cluster_size", 0)],
    "segment_user_details": [_filled("user_id"), _filled("segment_id"), ("reviews_given", "reviews IS NOT NULL")],
    "user_tribe": [_filled("user_id"), _filled("segment_id"), _filled("tribe_id"),
                   _unit("similarity_score", optional=True), _at_least("total_users", 0),
                   _at_least("total_reviews", 0)],
    "tribe_seed_characteristics": [_filled("tribe_id"), _at_least("total_users_in_cluster", 0, optional=True),
                                   _at_least("total_reviews_from_cluster", 0, optional=True)],
    "refined_characteristics": [_filled("tribe_id"), _at_least("num_analyses", 0), _at_least("refinement_round", 1),
                                _unit("confidence", optional=True), _at_least("support_count", 0, optional=True)],
    "behavior_loss": [_filled("user_id"), _filled("review_id"), _unit("text_delta"), _unit("theme_delta"),
                      _unit("overall_behavior_loss"), _unit("overall_accuracy"),
                      _at_least("iteration", 1, optional=True)],
    "initial_predictions": [_filled("product_description"), *_PREDICTION, _unit("rating_score"),
                            _unit("sentiment_score"), _unit("overall_accuracy"), _at_least("num_actual_themes", 0)],
    "baseline_predictions": [*_BASELINE, *_PREDICTION, _unit("overall_accuracy"), _unit("rating_score"),
                             _unit("sentiment_score"), _unit("recall_at_max3k")],
    "baseline_predictions_logprobs": [*_BASELINE, *_PREDICTION, _at_least("jsd", 0)],
    "simulation_results": [_filled("user_id"), _filled("stimulus_product_id"),
                           ("rating_in_1_5", "rating IS NULL OR rating BETWEEN 1 AND 5"),
                           ("rating_predicted_in_1_5", "rating_predicted BETWEEN 1 AND 5"),
                           ("sentiment_known", f"sentiment_predicted IN {_SENTIMENTS}")],
}


def broken_rules(rules: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(F.expr(test), F.lit(False)), F.lit(name)) for name, test in rules]))


def validate(df: DataFrame, table: str, column: str = "broken_rules") -> DataFrame:
    """Tag each row with the names of the rules it breaks (empty array: valid)."""
    if table not in RULES:
        raise ValueError(f"unknown table {table!r}; known: {sorted(RULES)}")
    return df.withColumn(column, broken_rules(RULES[table]))


def valid_and_rejected(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    tagged = validate(df, table)
    return (tagged.filter(F.size("broken_rules") == 0).drop("broken_rules"),
            tagged.filter(F.size("broken_rules") > 0))
