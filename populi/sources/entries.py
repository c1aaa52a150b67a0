"""Entries of JSON objects of any size, and a line's place in its file.

A {key: record} file may be one object of many gigabytes on one line. It is read as pieces that end at a chosen sign, so
Spark splits it like any text file. A piece tells how it changes the nesting depth, for either answer to whether it
starts inside a string; prefix sums over the splits of a file settle that answer and the depth at which each piece starts.
Pieces between two ends at depth one are then gathered, which is one record at a time, and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def line_place() -> Column:
    """(file, block, row): grows along a file however Spark splits and packs files. Use it right on a file scan."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def _depth(text: Column) -> Column:
    """Opened less closed brackets of text without strings."""
    opened = F.length(text) - F.length(F.translate(text, "{[", ""))
    return opened - (F.length(text) - F.length(F.translate(text, "}]", "")))


def pieces(spark: SparkSession, path: str, end: str, pattern: str | None = None) -> DataFrame:
    """file, block, row, text (with its end sign), quotes (0 or 1: changes whether inside a string), and the change of depth
    of a piece that starts outside (deep0) or inside (deep1) a string."""
    reader = spark.read.option("lineSep", end).option("recursiveFileLookup", pattern is not None)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(path).select(line_place().alias("p"), F.concat("value", F.lit(end)).alias("text")).select("p.*", "text")
    bare = F.when(F.contains("text", F.lit("\\")), F.regexp_replace("text", r"(?s)\\.", "")).otherwise(F.col("text"))  # without escaped signs
    # two quotes without a bracket between them change nothing, wherever the piece starts; what is left has few signs
    rows = rows.withColumn("bare", F.regexp_replace(bare, r'"[^"{}\[\]]*"|[^"{}\[\]]+', ""))
    outside = F.regexp_replace("bare", r'"[^"]*("|$)', "")
    inside = F.regexp_replace(F.regexp_replace("bare", r'^[^"]*("|$)', ""), r'"[^"]*("|$)', "")
    quotes = (F.length("bare") - F.length(F.translate("bare", '"', ""))) % 2
    return rows.select("file", "block", "row", "text", quotes.alias("quotes"), _depth(outside).alias("deep0"), _depth(inside).alias("deep1"))


def object_entries(spark: SparkSession, path: str, *, end: str = "}", pattern: str | None = None) -> DataFrame:
    """(file, part, key, value): every entry of the objects in the files, value as JSON text (a string without its quotes).

    end: '}' where the values are objects, ',' for any values (more pieces), a line's end for files with an entry a line
    as writers.write_objects makes them (a piece an entry; right for any file, but a long line is one piece). A file holds one object or one a line; .gz
    files are read too, each by one task. A pattern looks for file names in all folders below the path. Entries of a
    (file, part) follow each other; malformed ones are left out."""
    split, file = ["file", "block"], Window.partitionBy("file")
    along = Window.partitionBy(*split).orderBy("row")
    before, upto = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    earlier = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    rows = pieces(spark, path, end, pattern)
    # both answers for the split's own start
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    rows = rows.withColumn("odd", odd)
    change = lambda start: F.when(F.col("odd") == start, F.col("deep0")).otherwise(F.col("deep1"))
    rows = rows.withColumns({"upto0": F.sum(change(0)).over(upto), "upto1": F.sum(change(1)).over(upto),
                             "shut": (F.col("odd") + F.col("quotes")) % 2})
    # a piece ends outside a string if `shut` equals the split's start
    totals = rows.groupBy(*split).agg(F.sum("quotes").alias("q"), F.max_by("upto0", "row").alias("d0"), F.max_by("upto1", "row").alias("d1"))
    totals = totals.withColumn("start", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
    totals = totals.withColumn("d", F.when(F.col("start") == 0, F.col("d0")).otherwise(F.col("d1")))
    starts = totals.select(*split, "start", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("base"))
    rows = rows.join(starts, split).withColumn("depth", F.col("base") + F.when(F.col("start") == 0, F.col("upto0")).otherwise(F.col("upto1")))
    rows = rows.withColumn("ends", ((F.col("shut") == F.col("start")) & (F.col("depth") <= 1)).cast("int"))
    # number the records: ends before a piece, within its split and in the splits before
    rows = rows.withColumn("n", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    counts = rows.groupBy(*split).agg(F.sum("ends").alias("e"))
    shifts = counts.select(*split, F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("shift"))
    rows = rows.join(shifts, split).withColumn("part", F.col("n") + F.col("shift"))
    records = rows.groupBy("file", "part").agg(
        F.array_sort(F.collect_list(F.struct("block", "row", "text", "depth"))).alias("r"))
    text = F.btrim(F.array_join(F.col("r.text"), ""), F.lit(" \t\n\x0b\f\r,"))
    records = records.select("file", "part", text.alias("text"), (F.element_at("r", -1)["depth"] == 1).alias("open"))
    closed = F.concat(F.when(F.col("text").startswith("{"), "").otherwise("{"), "text", F.when(F.col("open"), "}").otherwise(""))
    return records.select("file", "part", F.explode(F.from_json(closed, "map<string,string>")).alias("key", "value"))
