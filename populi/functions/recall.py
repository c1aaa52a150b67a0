"""Top-k themes and the recall family, as row-wise expressions.

`ranked` arrays are ordered by probability descending; equal probabilities by theme name, since a map has no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from populi.functions.base import let, non_empty
from populi.functions.dist import yes_share
from populi.functions.text import themes_overlap


def ranked(m: Column) -> Column:
    """All theme names of a map, best first."""
    keyed = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("theme")))
    return F.transform(F.array_sort(keyed), lambda s: s["theme"])


def top_k(m: Column, k: Column | int) -> Column:
    return F.slice(ranked(m), 1, k)


def hits(names: Column, truth: Column) -> Column:
    return F.size(F.array_intersect(names, truth))


def recall_at(order: Column, truth: Column, k: Column | int, *, no_truth: float | None = 0.0) -> Column:
    """|top k of order, in truth| / |truth|; no_truth is the value for an empty truth (0.0 or None)."""
    kept = F.slice(order, 1, F.lit(k) if isinstance(k, int) else k)
    return (F.when(F.size(truth) > 0, hits(kept, truth) / F.size(truth))
            .otherwise(F.lit(no_truth).cast("double")))


def max_nk(truth: Column, n: int) -> Column:
    return F.greatest(F.lit(n), F.size(truth))


def recall_at_max_nk(order: Column, truth: Column, n: int, *, no_truth: float | None = 0.0) -> Column:
    return recall_at(order, truth, max_nk(truth, n), no_truth=no_truth)


def recall_with_score(m: Column, order: Column, truth: Column, score: float) -> Column:
    """Recall@max(3,k) widened by every prediction scored at or above `score`."""
    wide = F.array_union(F.slice(order, 1, max_nk(truth, 3)), F.map_keys(F.map_filter(m, lambda _, v: v >= score)))
    return F.when(F.size(truth) > 0, hits(wide, truth) / F.size(truth))


def above_score(m: Column, score: float) -> Column:
    return F.size(F.map_filter(m, lambda _, v: v >= score))


def extra_above_score(m: Column, order: Column, truth: Column, score: float) -> Column:
    """How many themes the score rule adds beyond the top max(3,k)."""
    return F.size(F.array_except(F.map_keys(F.map_filter(m, lambda _, v: v >= score)),
                                 F.slice(order, 1, max_nk(truth, 3))))


def recall_with_floor(actual: Column, predicted: Column, k: int, floor: float, epsilon: float = 1e-10) -> Column:
    """Truth is every actual theme above epsilon; predictions below the floor are ignored."""
    truth = F.map_keys(F.map_filter(actual, lambda _, v: v > epsilon))
    return F.coalesce(recall_at(ranked(F.map_filter(predicted, lambda _, v: v >= floor)), truth, k), F.lit(0.0))


def theme_delta(predicted: Column, actual: Column) -> Column:
    """1 - recall@max(3,k) on lower-cased names; every listed actual theme counts, repeats included."""
    fold = lambda names: F.transform(names, lambda t: F.lower(F.trim(t)))
    k = F.size(actual)
    top = fold(top_k(predicted, F.greatest(F.lit(3), k)))
    found = let(top, lambda names: F.size(F.filter(fold(actual), lambda t: F.array_contains(names, t))))
    return (F.when(non_empty(actual).isNull(), 0.0).when(non_empty(predicted).isNull(), 1.0)
            .otherwise(1.0 - found / k))


def keys_at_least(m: Column, threshold: float | Column) -> Column:
    return F.map_keys(F.map_filter(m, lambda _, v: v >= threshold))


def truth_themes(threshold: float, *, nested: Column | None = None, flat: Column | None = None,
                 logprobs: Column | None = None, predicted: Column | None = None) -> Column:
    """Truth set from the first source that yields a theme.

    nested: map<theme, struct<prob_yes,..>>; flat: map<theme,double>; logprobs: map<theme, struct<yes,no>>;
    predicted: map<theme,double>, compared strictly."""
    rungs = []
    if nested is not None:
        rungs.append(F.map_keys(F.map_filter(nested, lambda _, v: v["prob_yes"] >= threshold)))
    if flat is not None:
        rungs.append(keys_at_least(flat, threshold))
    if logprobs is not None:
        rungs.append(F.map_keys(F.map_filter(logprobs, lambda _, v: yes_share(v["yes"], v["no"]) >= threshold)))
    if predicted is not None:
        rungs.append(F.map_keys(F.map_filter(predicted, lambda _, v: v > threshold)))
    return F.coalesce(*[non_empty(r) for r in rungs], F.array().cast("array<string>"))


def soft_accuracy(predicted: Column, actual: Column, predicted_rating: Column, actual_rating: Column,
                  predicted_sentiment: Column, actual_sentiment: Column) -> dict[str, Column]:
    """Accuracy with themes that only need to overlap (see text.themes_overlap), as named columns; zeros without a true theme.

    predicted: map<theme, p>; actual: array of themes. Names are compared folded; ratings count as 3 where missing."""
    names = F.array_distinct(F.transform(actual, lambda t: F.lower(F.trim(t))))
    top = F.transform(top_k(predicted, F.greatest(F.lit(3), F.size(names))), lambda t: F.lower(F.trim(t)))
    found = let(top, lambda best: F.size(F.filter(names, lambda t: F.exists(best, lambda p: themes_overlap(p, t)))))
    rating = rating_score(F.coalesce(predicted_rating, F.lit(3.0)), F.coalesce(actual_rating, F.lit(3.0)))
    fold = lambda c: F.lower(F.coalesce(c, F.lit("")))
    sentiment = F.when(fold(predicted_sentiment) == fold(actual_sentiment), 1.0).otherwise(0.0)
    share = found / F.size(names)
    block = {"rating_score": rating, "sentiment_score": sentiment, "soft_recall": share,
             "overall_accuracy": 0.4 * rating + 0.3 * sentiment + 0.3 * share}
    return {name: F.when(F.size(names) > 0, c).otherwise(0.0) for name, c in block.items()}


def recall_of_rows(rows: DataFrame, predicted: str, actual: str, threshold: float) -> DataFrame:
    """The rows with k_actual and recall at k and at max(3,k); true themes are the actual entries at or above the threshold."""
    truth = truth_themes(threshold, flat=F.col(actual))
    ready = rows.withColumns({"__truth": truth, "__order": ranked(F.col(predicted))})
    order, truth = F.col("__order"), F.col("__truth")
    return ready.withColumns({"k_actual": F.size(truth), "recall_at_k": recall_at(order, truth, F.size(truth), no_truth=None),
                              "recall_at_max3k": recall_at_max_nk(order, truth, 3, no_truth=None)}).drop("__truth", "__order")


def rating_score(predicted: Column, actual: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(predicted - actual) / 4.0)


def review_metrics(predicted: Column, truth: Column, predicted_rating: Column, actual_rating: Column,
                   predicted_sentiment: Column, actual_sentiment: Column) -> dict[str, Column]:
    """The per-review metric block as named columns; all are null when there is no truth theme."""
    order, k = ranked(predicted), F.size(truth)
    rating = rating_score(F.coalesce(predicted_rating, F.lit(3.0)), F.coalesce(actual_rating, F.lit(3.0)))
    sentiment = F.when(predicted_sentiment.eqNullSafe(actual_sentiment), 1.0).otherwise(0.0)
    recall_3k = recall_at_max_nk(order, truth, 3)
    block = {
        "rating_score": rating,
        "sentiment_score": sentiment,
        "recall_at_1": recall_at(order, truth, 1),
        "recall_at_3": recall_at(order, truth, 3),
        "recall_at_5": recall_at(order, truth, 5),
        "recall_at_k": recall_at(order, truth, k),
        "recall_at_max3k": recall_3k,
        "recall_at_max3k_08": recall_with_score(predicted, order, truth, 0.8),
        "above_08": above_score(predicted, 0.8),
        "extra_08": extra_above_score(predicted, order, truth, 0.8),
        "recall_at_max3k_085": recall_with_score(predicted, order, truth, 0.85),
        "above_085": above_score(predicted, 0.85),
        "extra_085": extra_above_score(predicted, order, truth, 0.85),
        "overall_accuracy": 0.4 * rating + 0.3 * sentiment + 0.3 * recall_3k,
        "num_actual_themes": k,
    }
    return {name: F.when(k > 0, column) for name, column in block.items()}
