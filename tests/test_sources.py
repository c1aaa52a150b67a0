import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from populi.functions.base import present
from populi.operators import clean, groups, journey, match
from populi.sources import entries, readers, writers
from populi.sources.entries import object_entries
from populi.streaming import incremental


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
    return str(path)


def listed(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_raw_reviews_with_bad_lines(spark, tmp_path):
    lines = [{"reviewerID": "u1", "asin": "a1", "parent_asin": "p1", "text": "x", "rating": 5.0, "timestamp": 1}, {"user_id": "u2", "asin": "a2", "text": "y"}]
    body = "\n".join([json.dumps(lines[0]), "", "{broken", json.dumps(lines[1])]) + "\n"
    put(tmp_path / "r" / "a.jsonl", body)
    with gzip.open(tmp_path / "r" / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps(lines[0]) + "\n")
    rows = clean.unify_ids(readers.raw_reviews(spark, str(tmp_path / "r")))
    assert listed(rows, "user_id", "asin") == [("u1", "p1"), ("u1", "p1"), ("u2", "a2")]
    assert clean.new_rows(rows, ["user_id", "asin"], position=["pos"]).count() == 2


def test_products_and_descriptions(spark, tmp_path):
    lines = [{"parent_asin": "p1", "asin": "a1", "title": "T1", "description": ["x", "y"], "main_category": "Software"},
             {"asin": "a2", "title": "T2", "description": "[]"}, {"asin": "a3", "title": "N/A", "description": []},
             {"asin": "a4", "title": "T4", "description": "plain"}, {"asin": "a4", "title": "T4 again", "description": "later"}]
    path = put(tmp_path / "meta.jsonl", "\n".join(map(json.dumps, lines)))
    reviews = spark.createDataFrame([(a,) for a in ("p1", "a1", "a2", "a3", "a4", "none")], "asin string")
    rows = clean.with_valid_description(clean.attach_product(reviews, readers.products(spark, path), "Fallback"))
    assert listed(rows, "asin", "product_description", "category") == [
        ("a1", "x y", "Software"), ("a2", "T2", "Fallback"), ("a4", "later", "Fallback"), ("p1", "x y", "Software")]


def test_quota_lists(spark, tmp_path):
    path = put(tmp_path / "q.txt", "# c\n===\nu1\t3\nu2\tx\n\nu3\t99\nu4\t0\nu5\t2\n")
    assert listed(readers.user_quotas(spark, path, per_user_cap=5, max_users=2), "user_id", "quota") == [("u1", 3), ("u3", 5)]
    many = put(tmp_path / "m.txt", "u1\tBooks:2\nu2\tAll Beauty:1, Health & Personal Care: 4\n")
    assert listed(readers.category_quotas(spark, many), "user_id", "category", "quota") == [
        ("u1", "Books", 2), ("u2", "All Beauty", 1), ("u2", "Health & Personal Care", 4)]


def test_nested_reviews_round_trip(spark, tmp_path):
    review = lambda t, a: {"product_description": "d", "review_text": t, "rating": 4.0, "category": None, "timestamp": "7", "asin": a}
    path = put(tmp_path / "u.json", {"u1": {"reviews": [review("x", "a"), review(" ", "b"), review("z", "c")]}, "u2": {"reviews": [review("w", "a")]}})
    rows = readers.user_reviews(spark, path)
    assert listed(rows, "user_id", "review_idx", "asin") == [("u1", 0, "a"), ("u1", 2, "c"), ("u2", 0, "a")]
    docs = writers.user_documents(rows, "user_id", ["review_idx"],
                                  ["product_description", "review_text", "rating", "category", "timestamp", "asin"], per_part=1)
    writers.write_json(docs, str(tmp_path / "docs"))
    back = readers.user_review_parts(spark, str(tmp_path / "docs"))
    assert listed(back, "user_id", "review_text") == listed(rows, "user_id", "review_text") and docs.filter("part = 1").count() == 1


def test_reviews_of_a_user_in_many_parts(spark, tmp_path):
    from oracle import compare, connect

    from __spark_entry__ import oracle_sql, queries
    n = 20_003
    orders = spark.range(n).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 5000 == 7, 2).otherwise(1).cast("long").alias("o_custkey"),
                                   F.lit("1-URGENT").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus"), F.lit("1995-01-01").cast("date").alias("o_orderdate"), F.lit(1.0).alias("o_totalprice"))
    customer = spark.range(1, 3).select(F.col("id").alias("c_custkey"), F.lit(0).alias("c_nationkey"), F.lit("m").alias("c_mktsegment"))
    nation, region = spark.sql("SELECT 0 n_nationkey, 0 n_regionkey"), spark.sql("SELECT 0 r_regionkey, 'r' r_name")
    for name, df in (("orders", orders), ("customer", customer), ("nation", nation), ("region", region)):
        df.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    name = "user_object_reviews"
    assert queries()[name](spark, str(tmp_path)).count() == n
    assert compare(spark, connect(str(tmp_path)), name, queries()[name], oracle_sql()[name], str(tmp_path)) is None


def test_topic_universe_shapes(spark, tmp_path):
    path = put(tmp_path / "t.json", {"Health & Personal Care": ["a", "b"], "Books": {"topics": [{"topic_name": "c"}]}, "Toys": {"themes": ["d"]}})
    assert listed(readers.topic_universe(spark, path), "category", "pos", "theme") == [
        ("Books", 0, "c"), ("Health_and_Personal_Care", 0, "a"), ("Health_and_Personal_Care", 1, "b"), ("Toys", 0, "d")]


def test_category_map_file(spark, tmp_path):
    path = put(tmp_path / "c.json", {"main_categories": {"A": ["x"]}, "category_to_main_mapping": {"x": "A", "y": "A", "z": "B"}})
    assert readers.category_map(spark, path) == {"A": ["x", "y"], "B": ["z"]}


def test_classifications_and_rejects(spark, tmp_path):
    path = put(tmp_path / "c.jsonl", json.dumps({"review_id": "1", "identified_themes": ["a"], "theme_token_probabilities": {"a": .5, "b": 0.0}}) + "\n{bad\n")
    good, bad = readers.classifications(spark, path)
    assert good.count() == 1 and bad.collect()[0][0] == "{bad"


def side(themes, **more):
    return {"review_text": "t", "rating": "4.5", "sentiment": "Positive", "predicted_themes": themes, **more}


def test_prediction_layouts_share_a_schema(spark, tmp_path):
    review = {"product_description": "P", "category": "C", "asin": "a", "prediction": side({"x": .7, "y": .3}), "actual": side(["x", "z"])}
    put(tmp_path / "tree" / "cluster_3" / "micro_12_accuracy.json", {"metadata": {"persona_name": "N"}, "user_predictions": {"u1": [review, review]}})
    put(tmp_path / "tree" / "cluster_3" / "grand_summary.json", {"scores": 1})
    flat = put(tmp_path / "flat.json", {"u_2_review_5": {**review, "actual": side([], topic_probabilities={"q": 1.0})}, "junk": {}})
    top = put(tmp_path / "top.json", [{"user_id": "u3", "product_description": "P", "category": "C", "topic_probabilities": {"x": 1.0}}])
    rows = readers.all_predictions(spark, {str(tmp_path / "tree"): "tree", flat: "baseline", top: "topic_list"})
    assert listed(rows, "layout", "user_id", "review_idx", "cluster_id", "micro_id", "persona_name") == sorted([
        ("baseline", "u_2", 5, None, None, None), ("topic_list", "u3", None, None, None, None),
        ("tree", "u1", 0, "cluster_3", "micro_12", "N"), ("tree", "u1", 1, "cluster_3", "micro_12", "N")], key=str) or rows.count() == 4
    tree = rows.filter("layout = 'tree'").first()
    assert tree["predicted"] == {"x": .7, "y": .3} and tree["actual"] == {"x": .5, "z": .5} and tree["predicted_rating"] == 4.5
    assert rows.filter("layout = 'baseline'").first()["actual"] == {"q": 1.0}


def test_ground_truth_last_row_wins(spark, tmp_path):
    entry = lambda p: {"product_description": "P", "category": "C", "topic_probabilities": {"x": p}, "topic_logprobs": {"x": {"yes": -1.0, "no": -2.0}},
                       "topic_probabilities_before_normalisation": {"x": {"prob_yes": p, "prob_no": 1 - p}}, "predicted_themes": ["x"]}
    put(tmp_path / "cluster_0" / "micro_1_details.json", {"persona_name": "N", "members_grouped_by_user": {"u": [entry(.1), entry(.9), {"category": "C"}]}})
    truth = readers.ground_truth_tree(spark, str(tmp_path))
    assert truth.count() == 2
    preds = spark.createDataFrame([(1, "U", "p", "c", {"x": 1.0})], "review_key long, user_id string, product_description string, category string, predicted map<string,double>")
    row = match.match_to_truth(preds, truth).first()
    assert row["before"] == {"x": .9} and row["logprobs"]["x"]["logprob_no"] == -2.0 and row["reason"] is None


def test_delta_and_journey_trees(spark, tmp_path):
    delta = {"cluster_id": "cluster_1", "deltas": [{"review_key": "u_review_0", "theme_jsd": 0.0, "theme_delta": .4, "text_delta": .5,
                                                    "prediction": {"predicted_themes": {"a": 1.0}}, "actual": {"predicted_themes": ["a", "b"]}}]}
    put(tmp_path / "d" / "cluster_1" / "micro_2_delta.json", delta)
    row = readers.delta_tree(spark, str(tmp_path / "d")).first()
    assert row["micro_id"] == "micro_2" and row["theme_jsd"] == 0.0 and row["actual"] == {"a": .5, "b": .5}
    steps = [{"iteration": i, "new_theme_delta": d, "new_overall_delta": d, "corrected_prediction_data": p} for i, d, p in
             ((1, .2, None), (2, .3, {"t": 1}), (13, .0, {"t": 9}))]
    put(tmp_path / "j" / "_journey" / "cluster_1" / "micro_2_journey.json", {"u_review_0": {
        "user_id": "u", "review_idx": 0, "initial_prediction_deltas": {"theme_delta": .5, "overall_delta": .5}, "initial_prediction_data": {"t": 0},
        "correction_journey": steps}})
    j = readers.journey_tree(spark, str(tmp_path / "j" / "_journey")).withColumn("best", journey.best_by_theme(F.col("initial"), F.col("steps"))).first()
    assert len(j["steps"]) == 4 and j["best"]["iteration"] == 13 and json.loads(j["best"]["prediction"]) == {"t": 9}


def test_objects_with_an_entry_a_line_are_read_by_line(spark, tmp_path):
    text = 'a "}\n{ b'
    rows = spark.createDataFrame([(f"u{i}", [(text, f"a{i}")]) for i in range(50)], "u string, reviews array<struct<review_text:string,asin:string>>")
    writers.write_objects(rows, "u", F.struct("reviews"), str(tmp_path / "o"))
    got = readers.user_reviews(spark, str(tmp_path / "o"), end="\n")
    assert listed(got, "user_id", "asin", "review_text") == sorted((f"u{i}", f"a{i}", text) for i in range(50))
    assert listed(readers.user_reviews(spark, str(tmp_path / "o")), "user_id", "asin", "review_text") == listed(got, "user_id", "asin", "review_text")


def test_trees_of_many_tribes_in_a_file(spark, tmp_path):
    """A document a line, from documents that name their tribe or take its cluster from the folder."""
    review = {"product_description": "P", "category": "C", "asin": "a", "prediction": side({"x": 1.0}), "actual": side(["x"]), "topic_probabilities": {"x": 1.0}}
    tribes = [{"cluster_id": "cluster_1", "micro_id": "micro_7", "user_predictions": {"u1": [review]}, "members_grouped_by_user": {"u1": [review]}},
              {"micro_id": "micro_8", "user_predictions": {"u2": [review, review]}, "members_grouped_by_user": {"u2": [review, review]}}]
    put(tmp_path / "cluster_5" / "part-0.json", "\n".join(json.dumps(t) for t in tribes))
    want = [("cluster_1", "micro_7", "u1"), ("cluster_5", "micro_8", "u2"), ("cluster_5", "micro_8", "u2")]
    assert listed(readers.all_predictions(spark, {str(tmp_path): "tree"}, lines=True), "cluster_id", "micro_id", "user_id") == want
    truth = readers.ground_truth_tree(spark, str(tmp_path), "*.json", lines=True)
    assert listed(truth, "cluster_id", "micro_id", "user_id") == want and truth.select("pos").distinct().count() == 3


def test_tree_queries_write_few_files(spark, tmp_path):
    from populi.plans import sources_suite
    path = sources_suite._tribe_files(spark, "/root/testdata/sf0.01", str(tmp_path / "t"), user_predictions=F.col("users"))
    files, tribes = len(list((tmp_path / "t").rglob("*.json"))), spark.read.json(path).count()
    assert tribes > 100 and files <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cluster_texts_from_both_places(spark, tmp_path):
    path = put(tmp_path / "seeds.json", {
        "segment_4_micro_0": {"tribe_id": "segment_4_micro_0", "members_grouped_by_user": {"u": [{"review_text": "x"}]}},
        "k": {"tribe_id": "segment_4_micro_1", "details": {"members_grouped_by_user": {"v": [{"review_text": "y"}, {"review_text": " "}]}}},
        "segment_5_micro_0": {"members_grouped_by_user": {"w": [{"review_text": "z"}]}}})
    assert listed(readers.cluster_texts(spark, path, "cluster_4"), "user_id", "text") == [("u", "x"), ("v", "y")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c1", "m1", 1, .5, None), ("c1", "m2", 2, float("nan"), "bad")], "cluster_id string, micro_id string, k int, v double, reason string")
    writers.write_with_rejects(df, str(tmp_path / "ok"), str(tmp_path / "no"))
    assert spark.read.json(str(tmp_path / "ok")).count() == 1 and "v" not in spark.read.json(str(tmp_path / "no")).columns
    writers.write_parquet(df, str(tmp_path / "p"), ["cluster_id", "micro_id"])
    assert (tmp_path / "p" / "cluster_id=c1" / "micro_id=m2").exists()
    grid = spark.createDataFrame([("r", i, i / 2) for i in range(13)], "k string, iteration int, v double")
    writers.write_grid(grid, ["k"], "v", str(tmp_path / "g"))
    got = spark.read.option("header", True).csv(str(tmp_path / "g")).first()
    assert got["I0"] == "0.0" and got["I12"] == "6.0"


def test_incremental_run_never_repeats_rows(spark, tmp_path):
    line = lambda i, text: json.dumps({"review_id": str(i), "user_id": "u", "review": text}) + "\n"
    tag = lambda df: df.withColumn("reason", F.when(~present(F.col("review")), "empty_review"))
    run = lambda: incremental.append_tagged(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "state"), tag)
    put(tmp_path / "in" / "1.json", line(1, "x") + line(2, " "))
    run()
    run()
    put(tmp_path / "in" / "2.json", line(3, "y"))
    run()
    assert listed(spark.read.json(str(tmp_path / "out")), "review_id") == [("1",), ("3",)]
    assert listed(spark.read.json(str(tmp_path / "bad")), "review_id") == [("2",)]


def test_failures_are_merged_once(spark):
    log = spark.createDataFrame([("a", 1), ("a", 1)], "k string, iteration int")
    new = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1)], "k string, iteration int")
    assert listed(incremental.merge_failures(log, new, ["k", "iteration"]), "k", "iteration") == [("a", 1), ("b", 1)]


def test_learned_records_take_their_key(spark, tmp_path):
    summary = {"influencing_characteristics_summary": "s"}
    path = put(tmp_path / "b.json", {"u1": {"overall_characteristics": summary, "category_characteristics": {"Books": summary}, "num_categories": 1},
                                     "k": {"user_id": "u2", "overall_characteristics": summary}})
    rows = readers.learned_records(spark, path, "user_backstory")
    assert listed(rows, "user_id", "overall_characteristics.influencing_characteristics_summary") == [("u1", "s"), ("u2", "s")]
    assert rows.filter("user_id = 'u1'").first()["category_characteristics"]["Books"][0] == "s"
    for table in readers.S.RECORDS:
        assert readers.learned_records(spark, put(tmp_path / f"{table}.json", {"x": {}}), table).count() == 1


def test_layout_detection(spark, tmp_path):
    put(tmp_path / "t" / "cluster_0" / "micro_1_accuracy.json", {"user_predictions": {}})
    assert readers.detect_layout(spark, str(tmp_path / "t")) == "tree"
    assert readers.detect_layout(spark, put(tmp_path / "l.json", [{"a": 1}])) == "topic_list"
    assert readers.detect_layout(spark, put(tmp_path / "o.json", {"a": 1})) == "baseline"
    put(tmp_path / "e" / "x.json", {})
    with pytest.raises(ValueError):
        readers.detect_layout(spark, str(tmp_path / "e"))


def test_needed_products_by_either_id(spark):
    products = spark.createDataFrame([("p1", "a1", 1), (None, "a2", 2), ("p3", "a3", 3), ("a2", "p1", 4)], "parent_asin string, asin string, pos long")
    reviews = spark.createDataFrame([("p1",), ("a2",), ("p1",)], "asin string")
    assert listed(clean.needed_products(products, reviews), "pos") == [(1,), (2,), (4,)]


def test_unknown_layout(spark):
    with pytest.raises(ValueError):
        readers.predictions(spark, "x", "nothing")


NASTY = ["}{", '",', '\\"', 'a"b', "[x]", "\\", "line\nfeed", "é✓", '{"k": 1}', ""]


def nested(rng, depth=0):
    kind = rng.randrange(6)
    if depth == 0 or kind == 0 and depth < 4:
        return {rng.choice(NASTY) + str(i): nested(rng, depth + 1) for i in range(rng.randrange(5))}
    if kind == 1 and depth < 4:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, 2.5, None, True, *NASTY])


@pytest.mark.parametrize("size", ["128m", "300b"])
def test_entries_of_objects_do_not_depend_on_splits(spark, tmp_path, size):
    """Objects on one line and on many, one a line, with brackets, quotes and backslashes in strings, cut anywhere."""
    rng, want, whole = random.Random(1), {}, {}
    for f in range(5):
        entries = {f"{rng.choice(NASTY)}key{f}_{i}": nested(rng) for i in range(60)}
        whole.update(entries)
        put(tmp_path / "whole" / f"{f}.json", json.dumps(entries, indent=rng.choice([None, 1, 4]), ensure_ascii=f % 2 == 0) + rng.choice(["", "\n", " \n"]))
    lines = {f"l{i}": nested(rng) for i in range(40)}
    put(tmp_path / "lines" / "x.json", "\n".join(json.dumps({k: v}) for k, v in lines.items()) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for folder, want, end in (("whole", whole, "}"), ("whole", whole, ","), ("lines", lines, "}")):
            rows = entries_of(spark, tmp_path / folder, end)
            assert rows == want
        scalars = put(tmp_path / "s" / "x.json", {"a": 1, "b": [1, {"c": "}"}], "d": "x, y", "e": {"f": {}}, "g": None})
        assert {r["key"]: r["value"] for r in object_entries(spark, scalars).collect()} == {"a": "1", "b": '[1,{"c":"}"}]', "d": "x, y", "e": '{"f":{}}', "g": None}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["}", ",", "\n"])
def test_pieces_of_any_text(spark, tmp_path, end):
    """Quotes and depth as a loop over the signs finds them, from outside and from inside a string."""
    rng = random.Random(7)
    text = "".join(rng.choice(['"', '"', "{", "}", "[", "]", ",", "\n", "a:", " ", "\\\"", "\\\\", "é}", "x" * 50]) for _ in range(4000))
    put(tmp_path / "t.json", text + end)
    rows = sorted(entries.pieces(spark, str(tmp_path / "t.json"), end).collect(), key=lambda r: (r["block"], r["row"]))
    assert "".join(r["text"] for r in rows) == text + end
    for r in rows:
        bare, got = re.sub(r"(?s)\\.", "", r["text"]), []
        for inside in (False, True):
            depth, string = 0, inside
            for sign in bare:
                string ^= sign == '"'
                depth += 0 if string else (sign in "{[") - (sign in "}]")
            got.append(depth)
        assert (r["quotes"], r["deep0"], r["deep1"]) == (bare.count('"') % 2, *got), r


@pytest.mark.parametrize("batch", [1, 2, 3, 10_000])
def test_written_objects_are_whole_in_any_batches(spark, tmp_path, batch):
    rows = spark.range(23).select(F.concat(F.lit('k"'), "id").alias("k"), F.struct((F.col("id") * 2).alias("v")).alias("r")).repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        writers.write_objects(rows, "k", F.col("r"), str(tmp_path / "o"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    objects = [json.loads(f.read_text()) for f in (tmp_path / "o").glob("part-*") if f.stat().st_size]
    assert sorted((k, r["v"]) for o in objects for k, r in o.items()) == sorted((f'k"{i}', 2 * i) for i in range(23))


def test_actual_sides_are_parsed_once(spark):
    df = spark.createDataFrame([('{"a": 0.5}', None, '["b", "c"]')], "topic_probabilities string, themes string, predicted_themes string").select(F.struct("*").alias("r"))
    count = lambda c: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count("from_json")
    assert count(readers.first_actual(F.col("r"))) == 3 * count(readers.theme_map(F.col("r.themes")))
    assert df.select(readers.first_actual(F.col("r"))).first()[0] == {"a": 0.5}


def entries_of(spark, path, end):
    return {r["key"]: json.loads(r["value"]) for r in object_entries(spark, str(path), end=end).collect()}


def test_the_last_line_wins_however_files_are_split(spark, tmp_path):
    lines = [json.dumps({"asin": f"a{i % 50}", "title": f"t{i}", "description": "x" * (i % 90)}) for i in range(4000)]
    for f in range(4):
        put(tmp_path / "p" / f"{f}.jsonl", "\n".join(lines[1000 * f:1000 * (f + 1)]) + "\n")
    last = {f"a{k}": f"t{3950 + k}" for k in range(50)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    try:
        for size, partitions in (("128m", 1), ("128m", 200), ("2k", 8)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = groups.keep_last(readers.products(spark, str(tmp_path / "p")), ["asin"], "pos")
            assert {r["asin"]: r["title"] for r in rows.collect()} == last
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_restarted_stream_yields_every_id_once(spark, tmp_path):
    line = lambda i, text, day: json.dumps({"id": i, "text": text, "ts": f"2024-01-{day:02d}T00:00:00"}) + "\n"
    tag = lambda df: df.withColumn("reason", F.when(~present(F.col("text")), "blank"))
    for name, event_time in (("plain", None), ("timed", "ts")):
        at = lambda part, name=name: str(tmp_path / name / part)
        for run, content in enumerate([line(1, "x", 1) + line(2, " ", 1) + line(1, "x", 1), line(1, "x", 2) + line(3, "y", 2), line(2, " ", 2) + line(3, "y", 2)]):
            put(tmp_path / name / "in" / f"{run}.json", content)
            incremental.append_once(spark, at("in"), at("good"), at("bad"), at("state"), tag, ["id"], "id int, text string, ts timestamp", event_time)
        assert listed(spark.read.schema("id int").json(at("good/*")), "id") == [(1,), (3,)]
        assert listed(spark.read.schema("id int, reason string").json(at("bad/*")), "id", "reason") == [(2, "blank")]
