"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become words; numbers, names (capitalised words inside a sentence) and units after a number become typed
placeholders, so that a question asked again with other values keeps its template. Every window of `WINDOW` template
words is hashed by doubling (hashes of 1, 2, 4, 8 words) and looked up among the benchmark's windows; matches count by
(document, item, distance between their places). An item is leaked where enough of its windows match, 13 words or all of a
shorter item, and where its slots are consistent: one value of the item always stands for one value in the document.

The benchmark's distinct windows are broadcast only while their counted number is within `BROADCAST_WINDOWS`; beyond it
the same join shuffles. Items with equal templates are one class, named by its smallest item_id (`members` lists the others).
Slots are checked for every distinct line of a class, by the equality patterns its lines have, so that documents times
lines are never made.

Defined results: null and empty texts match nothing; an item shorter than `WINDOW` words is one window of its own
length; items under `LEAST_WORDS` words match nothing, as any text holds them by chance; nor do items without an id. Rows equal in doc_id and text
are one document; a null doc_id is kept as null. Further columns are ignored (by `drop_leaked`: kept); empty tables give
empty results. Whole texts are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from populi.llm.common import Scratch, text_or_empty

WINDOW = 8
RUN_WORDS = 13
LEAST_WORDS = 4
BROADCAST_WINDOWS = 1_000_000  # 24 MB of hashes

# Units of measure that may follow a number.
UNITS = ("kilograms kilogram grams gram kilometers kilometres kilometer kilometre meters metres meter metre centimeters centimetres "
         "miles mile hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro "
         "cents cent percent degrees liters litres liter litre kg km cm mm mg ml lb oz ft").split()
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"  # placeholders, from the private use area
MARK = "\ue000"  # stands before a name until its word is replaced


def _words(text: F.Column) -> F.Column:
    """The text with one space between its words, lower case, names marked; decimal signs and grouping inside numbers go."""
    out = F.regexp_replace(text, "([0-9])[.,]([0-9])", "$1$2")
    out = F.regexp_replace(out, r"([0-9]) ?(" + "|".join(UNITS) + r")(?!\p{L})", "$1 $2")
    out = F.regexp_replace(out, r"([\p{Ll}0-9,;:] )(\p{Lu}\p{L}*)", f"$1{MARK}$2")
    return F.trim(F.lower(F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{MARK}]+", " ")))


def _template(words: F.Column) -> F.Column:
    """The words with placeholders; as many as before."""
    out = F.regexp_replace(words, rf"{MARK}[\p{{L}}\p{{N}}]*", NAME)
    out = F.regexp_replace(out, r"[0-9]+", NUMBER)
    return F.regexp_replace(out, rf"{NUMBER} (?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}])", f"{NUMBER} {UNIT}")


def _tokens(words: F.Column) -> F.Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _joined(left: F.Column, right: F.Column, reach: int) -> F.Column:
    """Hashes of stretches: each left hash with the right one `reach` further on."""
    n = F.greatest(F.size(left) - reach, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, reach + 1, n), lambda a, b: F.xxhash64(a, b))


def _windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (with template tokens in __tokens) and __w<length>: hashes of all stretches of that many words."""
    df = df.withColumn("__w1", F.transform("__tokens", lambda w: F.xxhash64(w)))
    wanted, width = set(lengths), 1
    while width < max(wanted, default=1):  # widths 1, 2, 4, 8; each one column, so that none is computed twice
        df = df.withColumn(f"__w{2 * width}", _joined(F.col(f"__w{width}"), F.col(f"__w{width}"), width))
        width *= 2
    for k in sorted(wanted):
        if k & (k - 1):
            low, rest = 1 << k.bit_length() - 1, k - (1 << k.bit_length() - 1)
            part, at = None, 0
            for bit in (4, 2, 1):
                if k & bit:
                    part = F.col(f"__w{bit}") if part is None else _joined(part, F.col(f"__w{bit}"), at)
                    at += bit
            df = df.withColumn(f"__w{k}", part) if rest and low else df
    return df


def _exploded(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """keep, length, pos, hash of every window of the lengths.

    The outer form, as the plain one adds a filter that would compute the whole chain of hashes again, nested."""
    out = None
    for k in lengths:
        one = df.select(*keep, F.lit(k).alias("length"), F.posexplode_outer(f"__w{k}").alias("pos", "hash"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("hash").isNotNull())


def templates(docs: DataFrame, id_col: str, text_col: str, id_name: str) -> DataFrame:
    """id, __text (hash of the text), __words and __tokens (template); aligned lists of words."""
    text = text_or_empty(text_col)
    return (docs.select(F.col(id_col).alias(id_name), F.xxhash64(text).alias("__text"), _words(text).alias("__line"))
            .select(id_name, "__text", "__line", _tokens(_template(F.col("__line"))).alias("__tokens")))


def _items(benchmark: DataFrame) -> DataFrame:
    """The items that can match: item_id, __line, __tokens."""
    return templates(benchmark, "item_id", "text", "item_id").where((F.size("__tokens") >= LEAST_WORDS) & F.col("item_id").isNotNull())


def members(benchmark: DataFrame) -> DataFrame:
    """item_id (of the class, as in `leaks`), member_id: all items of each class."""
    items = _items(benchmark)
    named = items.groupBy("__tokens").agg(F.min("item_id").alias("__class"))
    return items.join(named, "__tokens").select(F.col("__class").alias("item_id"), F.col("item_id").alias("member_id")).distinct()


def _is_slot(kind: F.Column) -> F.Column:
    return kind.contains(NAME) | kind.contains(NUMBER)


def _class_lines(items: DataFrame, named: DataFrame, scratch: Scratch) -> DataFrame:
    """item_id of the class, words and pattern of each distinct line: a slot's pattern is the place where its value stands first, others have 0."""
    lines = items.join(named.select("item_id", "__tokens").withColumnRenamed("item_id", "__class"), "__tokens")
    lines = lines.select(F.col("__class").alias("item_id"), "__line", "__tokens").distinct()
    lines = scratch.write(lines.select("item_id", F.arrays_zip(F.col("__tokens").alias("kind"), F.split("__line", " ").alias("word")).alias("cells")), "lines")
    pattern = F.transform("cells", lambda c: F.when(_is_slot(c["kind"]), F.array_position("cells", c)).otherwise(0).cast("int"))
    return scratch.write(lines.select("item_id", F.transform("cells", lambda c: c["word"]).alias("words"), pattern.alias("pattern")), "patterns")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run_words: int = RUN_WORDS, id_col: str = "doc_id",
          text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, __text, item_id, matched, needed, item_windows, slots, same_values: one row per leaked item class of a document;
    same_values: some item of the class stands there with its own values."""
    scratch = Scratch(docs.sparkSession, "leaks")
    usable = _items(benchmark)
    n = F.size("__tokens")
    items = (usable.groupBy("__tokens").agg(F.min("item_id").alias("item_id"))
             .select("item_id", "__tokens", F.least(n, F.lit(window)).alias("item_length"), (F.greatest(n - window, F.lit(0)) + 1).alias("item_windows"),
                     (F.greatest(F.least(n, F.lit(run_words)) - window, F.lit(0)) + 1).alias("needed")))
    items = scratch.write(items, "items")
    lengths = sorted(r[0] for r in items.select("item_length").distinct().collect())  # at most `window` numbers
    if not lengths:
        lengths = [window]
    wanted = _exploded(_windows(items, lengths), lengths, ["item_id", "item_length"])
    wanted = scratch.write(wanted.where(F.col("length") == F.col("item_length")).select("item_id", "length", F.col("pos").alias("item_pos"), "hash"), "wanted")
    distinct = wanted.select("length", "hash").distinct()
    if wanted.count() <= broadcast_windows:
        distinct = F.broadcast(distinct)
    source = templates(docs, id_col, text_col, "doc_id").select("doc_id", "__text", "__tokens")
    found = _exploded(_windows(source, lengths), lengths, ["doc_id", "__text"]).join(distinct, ["length", "hash"], "left_semi")
    found = scratch.write(found, "found")
    hits = (found.distinct().join(wanted, ["length", "hash"])
            .groupBy("doc_id", "__text", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
            .agg(F.count_distinct("item_pos").alias("matched"), F.min("item_pos").alias("lo"), F.max(F.col("item_pos") + F.col("length")).alias("hi"))
            .join(items.select("item_id", "item_windows", "needed", F.col("__tokens").alias("item_tokens")), "item_id")
            .where(F.col("matched") >= F.col("needed")))
    hits = scratch.write(hits, "hits")
    # slots are read from the texts of matched documents only
    chosen = hits.select(F.col("doc_id").alias("__d"), F.col("__text").alias("__t")).distinct()
    texts = (docs.select(F.col(id_col).alias("__d"), text_or_empty(text_col).alias("__body"))
             .withColumn("__t", F.xxhash64("__body")))
    texts = texts.join(chosen.select(F.col("__d").alias("__cd"), F.col("__t").alias("__ct")), F.col("__d").eqNullSafe(F.col("__cd")) & (F.col("__t") == F.col("__ct")), "left_semi")
    texts = texts.select("__d", "__t", _words(F.col("__body")).alias("__doc_line")).dropDuplicates(["__d", "__t"])
    pairs = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__text") == F.col("__t")))
    n = F.col("hi") - F.col("lo")
    # the matched words alone are written, so that no later expression splits a whole text again
    cells = F.arrays_zip(F.slice("item_tokens", F.col("lo") + 1, n).alias("kind"),
                         F.slice(F.split("__doc_line", " "), F.col("lo") + F.col("shift") + 1, n).alias("doc"))
    pairs = scratch.write(pairs.select("doc_id", "__text", "item_id", "matched", "needed", "item_windows", "lo", n.alias("n"), cells.alias("cells")), "pairs")
    lines = _class_lines(usable, items, scratch)
    values = lambda c, word: F.array_join(F.transform(F.filter(c, lambda x: _is_slot(x["kind"])), lambda x: x[word]), " ")
    pairs = pairs.withColumn("__values", values("cells", "doc"))
    # what each line of a class has in its slots, for the ranges that were matched
    own = (pairs.select("item_id", "lo", "n").distinct().join(lines, "item_id")
           .select("item_id", "lo", "n", F.arrays_zip(F.slice("words", F.col("lo") + 1, F.col("n")).alias("doc"), F.slice("pattern", F.col("lo") + 1, F.col("n")).alias("at")).alias("cells"))
           .select("item_id", "lo", "n", F.array_join(F.transform(F.filter("cells", lambda x: x["at"] > 0), lambda x: x["doc"]), " ").alias("__values"))
           .distinct().withColumn("same", F.lit(True)))
    pairs = pairs.join(own, ["item_id", "lo", "n", "__values"], "left")
    # one value of the item always stands for one value in the document: as many pairs as places where values stand first
    slots = F.filter(F.arrays_zip(F.slice("pattern", F.col("lo") + 1, F.col("n")).alias("at"), F.transform("cells", lambda x: x["doc"]).alias("doc")), lambda x: x["at"] > 0)
    checked = (pairs.join(lines.select("item_id", "pattern").distinct(), "item_id").withColumn("__slots", slots)
               .where(F.size(F.array_distinct("__slots")) == F.size(F.array_distinct(F.transform("__slots", lambda x: x["at"])))))
    return checked.groupBy("doc_id", "__text", "item_id").agg(
        F.max("matched").alias("matched"), F.first("needed").alias("needed"), F.first("item_windows").alias("item_windows"),
        F.max(F.size("__slots")).alias("slots"), F.max(F.coalesce("same", F.lit(False))).alias("same_values"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("__d"), F.col("__text").alias("__t")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64(text_or_empty()) == F.col("__t")), "left_anti")


# The same result said in SQL, with windows as texts in place of hashes. Signs that a look-ahead only looks at are taken
# along and put back, which differs where two numbers with units share the one sign between them.
ORACLE = f"""WITH src AS (SELECT 'd' side, doc_id id, coalesce(text, '') t FROM documents UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
  joined AS (SELECT side, id, regexp_replace(t, '([0-9])[.,]([0-9])', '\\1\\2', 'g') t FROM src),
  parted AS (SELECT side, id, regexp_replace(t, '([0-9]) ?({"|".join(UNITS)})([^\\p{{L}}]|$)', '\\1 \\2\\3', 'g') t FROM joined),
  marked AS (SELECT side, id, regexp_replace(t, '([\\p{{Ll}}0-9,;:] )(\\p{{Lu}}\\p{{L}}*)', '\\1{MARK}\\2', 'g') t FROM parted),
  lines AS (SELECT side, id, trim(lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}{MARK}]+', ' ', 'g'))) t FROM marked),
  typed AS (SELECT side, id, t, regexp_replace(regexp_replace(regexp_replace(t, '{MARK}[\\p{{L}}\\p{{N}}]*', '{NAME}', 'g'), '[0-9]+', '{NUMBER}', 'g'),
    '{NUMBER} (?:{"|".join(UNITS)})( |$)', '{NUMBER} {UNIT}\\1', 'g') k FROM lines),
  tok AS (SELECT side, id, string_split(t, ' ') w, string_split(k, ' ') k FROM typed WHERE t <> ''),
  items AS (SELECT min(id) item_id, arg_min(w, id) iw, k ik, least(len(k), {WINDOW}) n, len(k) size FROM tok WHERE side = 'b' AND len(k) >= {LEAST_WORDS} GROUP BY k),
  iwin AS (SELECT item_id, n, p, array_to_string(ik[p + 1:p + n], ' ') g FROM (SELECT *, unnest(generate_series(0, size - n)) p FROM items)),
  dwin AS (SELECT id doc_id, n, p, array_to_string(k[p + 1:p + n], ' ') g FROM (SELECT id, k, n, unnest(generate_series(0, len(k) - n)) p
    FROM tok, (SELECT DISTINCT n FROM items) WHERE side = 'd' AND len(k) >= n)),
  hits AS (SELECT doc_id, item_id, dwin.p - iwin.p shift, count(DISTINCT iwin.p) matched, min(iwin.p) lo, max(iwin.p + n) hi FROM dwin JOIN iwin USING (n, g) GROUP BY 1, 2, 3),
  held AS (SELECT hits.*, size - n + 1 item_windows, list_filter(list_transform(range(lo, hi), lambda i: {{'kind': ik[i + 1], 'item': iw[i + 1], 'doc': tok.w[i + 1 + shift]}}),
      lambda s: contains(s.kind, '{NAME}') OR contains(s.kind, '{NUMBER}')) s
    FROM hits JOIN items USING (item_id) JOIN tok ON side = 'd' AND id = doc_id WHERE matched >= greatest(least(size, {RUN_WORDS}) - {WINDOW}, 0) + 1)
  SELECT doc_id, item_id, max(matched) matched_windows, max(item_windows) item_windows, CAST(max(len(s)) AS BIGINT) n_slots,
    bool_or(len(list_filter(s, lambda x: x.item <> x.doc)) = 0) same_values
  FROM held WHERE len(list_distinct(s)) = len(list_distinct(list_transform(s, lambda x: {{'kind': x.kind, 'item': x.item}}))) GROUP BY 1, 2"""


def digest(found: DataFrame) -> DataFrame:
    """One row per leaked document and item class."""
    return found.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("item_id").cast("long").alias("item_id")).agg(
        F.max("matched").cast("long").alias("matched_windows"), F.first("item_windows").cast("long").alias("item_windows"),
        F.max("slots").cast("long").alias("n_slots"), F.max("same_values").alias("same_values"))
