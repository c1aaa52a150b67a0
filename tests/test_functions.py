import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from populi.functions import dist, recall, text

PAIR = "a map<string,double>, p map<string,double>"


def plain_jsd(a, p, eps=1e-10):
    keys = sorted(set(a) | set(p))
    x, y = np.array([a.get(k, 0.0) for k in keys]), np.array([p.get(k, 0.0) for k in keys])
    x, y = (v / v.sum() if v.sum() else v for v in (x, y))
    x, y = x + eps, y + eps
    x, y = x / x.sum(), y / y.sum()
    m = (x + y) / 2
    return float(0.5 * (x * np.log2(x / m)).sum() + 0.5 * (y * np.log2(y / m)).sum())


def rows(spark, data, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, ddl).select(*columns).collect()]


def test_divergence_matches_numpy(spark):
    rng = np.random.default_rng(1)
    data = [({f"t{i}": float(v) for i, v in enumerate(rng.random(rng.integers(1, 9)))},
             {f"t{i + 3}": float(v) for i, v in enumerate(rng.random(rng.integers(1, 9)))}) for _ in range(200)]
    got = rows(spark, data, PAIR, dist.jsd(F.col("a"), F.col("p")), dist.wasserstein(F.col("a"), F.col("p")))
    for (a, p), (j, w) in zip(data, got):
        sa, sp = sum(a.values()), sum(p.values())
        l1 = sum(abs(a.get(k, 0) / sa - p.get(k, 0) / sp) for k in set(a) | set(p))
        assert math.isclose(j, plain_jsd(a, p), abs_tol=1e-12) and math.isclose(w, l1 / 2, abs_tol=1e-12)
        assert -1e-12 <= j <= 1 + 1e-12 and j <= w + 1e-6


def test_divergence_edges(spark):
    data = [({"a": 1.0}, {"a": 2.0}), ({"a": 1.0}, {"b": 1.0}), ({"a": 0.0}, {"b": 1.0}), ({}, {}), (None, {"a": 1.0}),
            ({"A": .667, "B": .333}, {"A": .6, "B": .4})]
    got = rows(spark, data, PAIR, dist.compare(F.col("a"), F.col("p")).alias("c"))
    same, apart, empty_side, nothing, missing, worked = [r[0] for r in got]
    assert same.jsd == pytest.approx(0) and same.wd == 0 and same.overlap == 1
    assert apart.jsd == pytest.approx(1, abs=1e-6) and apart.wd == 1 and apart.overlap == 0
    assert empty_side.wd is None and empty_side.jsd == pytest.approx(plain_jsd({"a": 0.0}, {"b": 1.0}), abs=0.4)
    assert nothing is None and missing is None
    assert worked.jsd == pytest.approx(plain_jsd({"A": .667, "B": .333}, {"A": .6, "B": .4}), abs=1e-12)


def test_jsd_over_category_rules(spark):
    data = [({"a": 1.0}, {}, ["a", "b"]), ({}, {"a": 1.0}, ["a", "b"]), ({"a": 1.0}, {"b": 1.0}, ["c", "d"]), ({"a": 1.0}, {"a": 1.0}, [])]
    got = rows(spark, data, "p map<string,double>, a map<string,double>, t array<string>",
               dist.jsd_over_category(F.col("p"), F.col("a"), F.col("t")))
    assert [round(r[0], 6) for r in got] == [0.0, 1.0, 0.0, 0.0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.01, 1), min_size=1), min_size=2, max_size=2))
def test_jsd_is_symmetric(spark, maps):
    (forth, back), = rows(spark, [tuple(maps)], PAIR, dist.jsd(F.col("a"), F.col("p")), dist.jsd(F.col("p"), F.col("a")))
    assert math.isclose(forth, back, abs_tol=1e-12)


def test_recall_is_monotone_and_breaks_ties_by_name(spark):
    data = [({"x": .5, "b": .5, "a": .5, "c": .1}, ["a", "c", "zz"])]
    cols = [recall.recall_at(recall.ranked(F.col("m")), F.col("t"), k) for k in range(1, 6)]
    got = rows(spark, data, "m map<string,double>, t array<string>", recall.ranked(F.col("m")), *cols)[0]
    assert got[0] == ["a", "b", "x", "c"] and list(got[1:]) == sorted(got[1:]) and got[4] == pytest.approx(2 / 3)


def test_recall_without_truth(spark):
    got = rows(spark, [({"a": 1.0}, [])], "m map<string,double>, t array<string>",
               recall.recall_at_max_nk(recall.ranked(F.col("m")), F.col("t"), 3),
               recall.recall_at_max_nk(recall.ranked(F.col("m")), F.col("t"), 3, no_truth=None))
    assert got == [(0.0, None)]


def test_softmax_and_truth_rungs(spark):
    got = rows(spark, [({"a": -1.0, "b": -1000.0},)], "m map<string,double>", dist.softmax(F.col("m")))[0][0]
    assert got["a"] == pytest.approx(1) and got["b"] == pytest.approx(0)
    df = spark.createDataFrame([({"a": 0.2}, {"b": (0.0, -5.0)}, {"c": 0.9})],
                               "f map<string,double>, l map<string,struct<yes:double,no:double>>, p map<string,double>")
    truth = recall.truth_themes(0.5, flat=F.col("f"), logprobs=F.col("l"), predicted=F.col("p"))
    assert df.select(truth).first()[0] == ["b"]


def test_text_helpers(spark):
    data = [("Health & Personal Care",), ("a  &b/c-d",), ("AMAZON FASHION",), (None,)]
    got = rows(spark, data, "c string", text.underscored_category(F.col("c")), text.topic_file_category(F.col("c")),
               text.main_category(F.col("c")), text.category_by_keyword(F.col("c")))
    assert got[0] == ("Health_and_Personal_Care", "Health_and_Personal_Care", "Health_and_Personal_Care", "Health_and_Personal_Care")
    assert got[1][0] == "a_and_b_c_d"
    assert got[2][2:] == ("Clothing Shoes & Jewelry", "Clothing_Shoes_and_Jewelry") and got[3] == (None,) * 4


def test_ids(spark):
    data = [("segment_3_micro_7", "u_x_review_12"), ("odd", "u1"), ("segment_2_relaxed_micro_4", "u_review_x")]
    got = rows(spark, data, "t string, k string", text.cluster_of_tribe(F.col("t")), text.micro_of_tribe(F.col("t")),
               text.user_of_review_key(F.col("k")), text.index_of_review_key(F.col("k")))
    assert got == [("cluster_3", "micro_7", "u_x", 12), ("odd", "micro_0", "u1", 0), ("cluster_2", "micro_4", "u", None)]


def test_analysis_and_cells(spark):
    data = [("x [a] [b] y",), ("[a] tail",), ('{"analysis": "z"}',), ("[none] [x]",), ("free",), ("",), (None,)]
    got = [r[0] for r in rows(spark, data, "r string", text.parse_analysis(F.col("r")))]
    assert got[:4] == ["[a] [b]", "[a] [tail]", "z", "[No missed motives] [No additional themes missed]"]
    assert got[4].startswith("[LLM Error] [Format mismatch") and got[5] == got[6] == "[LLM Error] [Empty response]"
    cells = rows(spark, [("0.557106 / 0.535447 (med: 0.525455) / 5.68%",), ("n/a",), ("0.5/0.4/x",)], "c string",
                 text.pre_post_cell(F.col("c")))
    assert cells[0][0].pre == 0.557106 and cells[0][0].post == 0.535447 and cells[1][0].pre is None
    assert cells[2][0].improvement_pct == pytest.approx(20)


def test_relaxed_transport_is_zero_for_equal_sides(spark):
    position, costs = {"a": 0, "b": 1}, [[0.0, 1.0], [1.0, 0.0]]
    data = [({"a": .5, "b": .5}, {"a": .5, "b": .5}, position, costs), ({"a": .5, "b": .5}, {"b": 1.0}, position, costs)]
    got = rows(spark, data, "x map<string,double>, y map<string,double>, p map<string,int>, c array<array<double>>",
               dist.relaxed_transport(F.col("x"), F.col("y"), F.col("p"), F.col("c")))
    assert [r[0] for r in got] == [0.0, 0.5]
