"""Keys, names, categories and the clean-up of model responses held as text columns."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from populi.functions import fixed_values as fixed
from populi.functions.base import let, present


# ---- keys -----------------------------------------------------------------------------------------------------

def fold(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def match_key(*parts: Column) -> Column:
    """Lower-cased, trimmed parts joined by |||; a missing part is the empty string."""
    return F.concat_ws("|||", *[fold(p) for p in parts])


def text_hash(text: Column, prefix: int | None = None, digits: int = 32) -> Column:
    """md5 of the whole text; a caller may state a prefix and fewer digits."""
    source = text if prefix is None else F.substring(text, 1, prefix)
    return F.substring(F.md5(source), 1, digits)


def review_id(user: Column, asin: Column, timestamp: Column, text: Column) -> Column:
    """user_asin_timestamp_hash with 'unknown' for missing parts."""
    known = lambda c: F.when(present(c.cast("string")), c.cast("string")).otherwise("unknown")
    return F.concat_ws("_", F.coalesce(user.cast("string"), F.lit("")), known(asin), known(timestamp),
                       text_hash(text))


def user_of_review_key(key: Column) -> Column:
    """user part of user_review_3; a key without the marker is a user id."""
    return F.when(key.rlike("_review_"), F.regexp_extract(key, r"^(.*)_review_", 1)).otherwise(key)


def index_of_review_key(key: Column) -> Column:
    found = F.regexp_extract(key, r"_review_(\d+)$", 1)
    return F.when(found != "", found.cast("int")).when(~key.rlike("_review_"), F.lit(0))


def cluster_of_tribe(tribe: Column) -> Column:
    """segment_3_micro_7 (or any id with a number before _micro_) to cluster_3."""
    number = F.regexp_extract(F.split(tribe, "_micro_").getItem(0), r"(\d+)", 1)
    return (F.when(~F.contains(tribe, F.lit("_micro_")), tribe)
            .when(number != "", F.concat(F.lit("cluster_"), number))
            .otherwise(F.split(tribe, "_micro_").getItem(0)))


def micro_of_tribe(tribe: Column) -> Column:
    return F.when(F.contains(tribe, F.lit("_micro_")),
                  F.concat(F.lit("micro_"), F.get(F.split(tribe, "_micro_"), 1))).otherwise("micro_0")


def cluster_number(name: Column) -> Column:
    """Number in cluster_4, segment_4 or 4."""
    found = F.regexp_extract(F.trim(name.cast("string")), r"^(?:cluster_|segment_)?(\d+)$", 1)
    return F.when(found != "", found.cast("int"))


def without_copy_suffix(user: Column) -> Column:
    return F.regexp_replace(user, r"_1$", "")


# ---- categories -----------------------------------------------------------------------------------------------

def _literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _inverted(groups: Mapping[str, list[str]]) -> dict[str, str]:
    return {name: main for main, names in groups.items() for name in names}


def main_category(category: Column, groups: Mapping[str, list[str]] | None = None,
                  codes: Mapping[str, str] | None = None) -> Column:
    """Main category by exact name, then by name without regard to case; null when unmapped.

    The mapping has a few dozen fixed entries and is inlined as a literal, so no join is needed."""
    groups = fixed.MAIN_CATEGORIES if groups is None else groups
    codes = fixed.MAIN_CATEGORY_CODES if codes is None else codes
    exact = {name: codes.get(main, main) for name, main in _inverted(groups).items()}
    folded: dict[str, str] = {}
    for name, main in exact.items():
        folded.setdefault(name.lower(), main)
    return F.coalesce(F.try_element_at(_literal_map(exact), category),
                      F.try_element_at(_literal_map(folded), F.lower(category)))


def baseline_category(category: Column) -> Column:
    """The baselines' own grouping; an unmapped category stays as it is."""
    return F.coalesce(F.try_element_at(_literal_map(_inverted(fixed.BASELINE_CATEGORIES)), category), category)


def category_by_keyword(category: Column, rules: str = "sampling") -> Column:
    """First rule with a keyword inside the lower-cased name; null when none holds."""
    name, chain = F.lower(category), None
    for main, words in fixed.KEYWORD_RULES[rules]:
        held = F.lit(False)
        for word in words:
            held = held | F.contains(name, F.lit(word))
        chain = F.when(held, main) if chain is None else chain.when(held, main)
    return chain


def _folded(name: str) -> str:
    return name.lower().replace("_", " ").replace("&", "and")


def spelled_main_category(category: Column, groups: Mapping[str, list[str]] | None = None) -> Column:
    """Main category of a name in any spelling, under one name for all of fashion; a name that stays unmapped is kept.

    A listed name in mixed spelling stands for itself. One in a single style (all upper or lower case, or underscores for
    spaces) stands for every spelling that folds to the same: case, underscores and the word for & do not matter."""
    groups = fixed.MAIN_CATEGORIES if groups is None else groups
    listed = _inverted(groups)
    styled = {_folded(n): main for n, main in listed.items() if n in (n.upper(), n.lower()) or "_" in n}
    fold = F.replace(F.replace(F.lower(category), F.lit("_"), F.lit(" ")), F.lit("&"), F.lit("and"))
    found = F.coalesce(F.try_element_at(_literal_map(listed), category), *([F.try_element_at(_literal_map(styled), fold)] if styled else []), category)
    of_fashion = [main for main in groups if set(re.split("[ _]", main.lower())) & {"fashion", "clothing", "jewelry"}]
    if not of_fashion:
        return found
    return let(found, lambda c: F.when(F.lower(c).rlike("fashion|jewelry"), of_fashion[0]).otherwise(c))


def underscored_category(category: Column) -> Column:
    """'Health & Personal Care' to Health_and_Personal_Care; spaces, dashes and slashes become single underscores."""
    words = F.regexp_replace(F.regexp_replace(category, r" & |&", " and "), r"[ \-/]", "_")
    return F.regexp_replace(F.regexp_replace(words, r"_+", "_"), r"^_|_$", "")


def topic_file_category(category: Column) -> Column:
    """The baselines' spelling: & to and, blanks to underscores, one pass over doubled underscores."""
    words = F.replace(F.replace(category, F.lit("&"), F.lit("and")), F.lit(" "), F.lit("_"))
    return F.regexp_replace(F.replace(words, F.lit("__"), F.lit("_")), r"^_+|_+$", "")


def sentiment(text: Column) -> Column:
    word, chain = F.lower(F.trim(text)), None
    for name, words in fixed.SENTIMENT_WORDS.items():
        chain = F.when(word.isin(words), name) if chain is None else chain.when(word.isin(words), name)
    return chain.otherwise("Neutral")


# ---- products, users and their texts ----------------------------------------------------------------------------

def product_description(description: Column, title: Column) -> Column:
    """The description, or the title when it is blank or the text '[]'."""
    return F.when(present(description) & (description != "[]"), description).otherwise(title)


def has_description(description: Column) -> Column:
    return present(description) & (description != "N/A")


def embedding_text(overall: Column, by_category: Column, categories: Column) -> Column:
    """Text to embed: overall summary, one line per category summary, then the category list.

    by_category is map<category, summary>; its entries are written in name order."""
    traits = F.transform(F.array_sort(F.map_entries(by_category)),
                         lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.concat_ws(" ", F.concat(F.lit("User characteristics: "), overall),
                       F.when(F.size(by_category) > 0, F.lit("Category-specific traits:")), traits,
                       F.concat(F.lit("Reviews products in categories: "), F.array_join(categories, ", ")))


def characteristic_lines(general: Column, main: Column, by_category: Column) -> Column:
    """General and category-specific characteristics of a review's user, each tagged with its kind."""
    own = F.try_element_at(by_category, main)
    return F.array_compact(F.array(
        F.when(present(general), F.concat(F.lit("[General Characteristics] "), general)),
        F.when(present(own), F.concat(F.lit("["), main, F.lit(" Specific] "), own))))


def gather_themes(*sources: Column) -> Column:
    """Distinct theme names from several arrays, in order of appearance; null arrays are skipped."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(s, F.array().cast("array<string>")) for s in sources])))


def rename_list(themes: Column, names: Column) -> Column:
    """A list with its names renamed by a map, in order, repeats removed; names outside the map stay."""
    return F.array_distinct(F.transform(themes, lambda t: F.coalesce(F.try_element_at(names, t), t)))


# ---- model responses ---------------------------------------------------------------------------------------------

TAGGED = ("identified_themes array<string>, predicted_topics array<string>, predicted_themes array<string>, "
          "sentiment string, topic_probabilities map<string,double>")


def outer_json(response: Column) -> Column:
    """From the first { to the last }; null when there is none."""
    found = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def salvage_topics(response: Column, field: str = "themes") -> Column:
    """Theme list of a raw response: a doubled opening brace is undone and a cut-off array keeps its whole names."""
    body = F.regexp_replace(F.trim(response), r'^\s*\{"?\s*(?=\{)', "")
    whole = F.from_json(outer_json(body), f"`{field}` array<string>")[field]
    kept = F.regexp_extract(body, rf'(?s)"{field}"\s*:\s*\[(.*)', 1)
    partial = F.regexp_extract_all(kept, F.lit(r'"((?:[^"\\]|\\.)*)"\s*(?:,|\]|$)'), 1)
    return F.coalesce(whole, F.when(F.size(partial) > 0, partial))


def tagged_response(response: Column) -> Column:
    """struct<themes, sentiment, probabilities> of a classification response, batch or single layout."""
    body = outer_json(response)
    batch = F.get(F.from_json(body, f"results array<struct<{TAGGED.replace(' array', ':array').replace(' string', ':string').replace(' map', ':map')}>>")["results"], 0)
    single = F.from_json(body, TAGGED)
    pick = lambda r, *names: F.coalesce(*[r[n] for n in names])
    none = F.array().cast("array<string>")
    return F.when(single.isNotNull(), F.struct(
        F.coalesce(F.when(batch.isNotNull(), pick(batch, "predicted_themes", "identified_themes"))
                   .otherwise(pick(single, "identified_themes", "predicted_topics", "predicted_themes")), none)
        .alias("themes"),
        F.when(batch.isNotNull(), batch["sentiment"]).otherwise(single["sentiment"]).alias("sentiment"),
        F.when(batch.isNotNull(), batch["topic_probabilities"]).otherwise(single["topic_probabilities"])
        .alias("probabilities")))


def theme_probabilities(themes: Column, token_based: Column, stated: Column, default: float = 0.5) -> Column:
    """Probability per theme: from tokens, else as stated by the model, else the default."""
    return F.map_from_entries(F.transform(F.array_distinct(themes), lambda t: F.struct(
        t.alias("key"), F.coalesce(F.try_element_at(token_based, t), F.try_element_at(stated, t), F.lit(default))
        .alias("value"))))


def parse_analysis(response: Column) -> Column:
    """'[motive] [explanation]' of a free-text response, with a JSON fallback and an error marker.

    The text after the first opening bracket is halved where one bracket closes and, white space apart, another opens."""
    blank = F.lit(" \t\n\r\x0b\x0c")
    opened = F.when(response.contains("["), F.substr(response, F.instr(response, "[") + 1))
    second = F.get(F.split(opened, r"\]\s*\[", 2), F.lit(1))
    first_half = F.left(opened, F.length(opened) - F.length(second))  # with both brackets in between
    pair = F.when(second.contains("]"), F.concat(F.lit("["), first_half, F.substring_index(second, "]", 1), F.lit("]")))
    motive = F.when(opened.contains("]"), F.substring_index(opened, "]", 1))
    words = F.btrim(F.substr(opened, F.length(motive) + 2), blank)
    settled = F.when(F.lower(pair).rlike("no missed motives|none"), "[No missed motives] [No additional themes missed]").otherwise(pair)
    stated = F.when(response.startswith("{"), F.get_json_object(response, "$.analysis"))
    reason = F.when(F.coalesce(response, F.lit("")) == "", "Empty response").otherwise(F.concat(F.lit("Format mismatch: "), response))
    return F.coalesce(settled, F.concat(F.lit("["), motive, F.lit("] ["), words, F.lit("]")), stated,
                      F.concat(F.lit("[LLM Error] ["), reason, F.lit("]")))


def pre_post_cell(cell: Column) -> Column:
    """struct<pre, post, improvement_pct> of a cell such as '0.5571 / 0.4254 (med: 0.41) / 23.64%'."""
    parts = F.split(F.trim(cell), "/")
    post = F.regexp_replace(F.regexp_replace(F.get(parts, 1), r"\s*\(med:.*?\)", ""), r"%.*$", "")
    pre, post = F.trim(F.get(parts, 0)).try_cast("double"), F.trim(post).try_cast("double")
    both = pre.isNotNull() & post.isNotNull()
    return F.struct(F.when(both, pre).alias("pre"), F.when(both, post).alias("post"),
                    F.when(both & (pre != 0), (pre - post) / pre * 100.0).alias("improvement_pct"))


# ---- names that nearly match -------------------------------------------------------------------------------------

def content_words(name: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(name, r"[,&\s]+", " ")), " ")
    stop = F.array(*[F.lit(w) for w in fixed.THEME_STOP_WORDS])
    return F.array_except(F.filter(words, lambda w: w != ""), stop)


def themes_overlap(a: Column, b: Column) -> Column:
    """Equal, contained, or sharing at least max(2, half of the shorter name's content words)."""
    wa, wb = content_words(a), content_words(b)
    shared = F.size(F.array_intersect(wa, wb))
    enough = F.greatest(F.lit(2.0), F.least(F.size(wa), F.size(wb)) * 0.5)
    return F.contains(b, a) | F.contains(a, b) | ((F.size(wa) > 0) & (F.size(wb) > 0) & (shared >= enough))


def jaccard(a: Column, b: Column) -> Column:
    split = lambda t: F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    wa, wb = split(a), split(b)
    union = F.size(F.array_union(wa, wb))
    return F.when(union > 0, F.size(F.array_intersect(wa, wb)) / union).otherwise(0.0)


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).otherwise(0.0)


def string_similarity(a: Column, b: Column, ratio: Column | None = None) -> Column:
    """1 when equal, 0.85 when one contains the other, else the larger of ratio and 0.9 * word Jaccard."""
    x, y = fold(a), fold(b)
    base = edit_ratio(x, y) if ratio is None else ratio
    return (F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0)
            .when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.85)
            .otherwise(F.greatest(base, 0.9 * jaccard(x, y))))
