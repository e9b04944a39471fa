"""Joins, ranking and metrics: ties, nulls, duplicates, empty sides."""

import pytest
from pyspark.sql import functions as F

from vellumen.operators import metrics, rank, relate


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_last_wins_orders_nulls_first_and_breaks_ties_by_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 5), ("a", 2, 3), ("b", None, None)], "k string, o int, v int")
    assert rows(relate.last_wins(df, ["k"], ["o", "v"]), "k") == [("a", 2, 5), ("b", None, None)]
    assert rows(relate.first_wins(df, ["k"], ["o", "v"]), "k") == [("a", None, 1), ("b", None, None)]


def test_defaults_are_for_missing_rows_only(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert rows(relate.left_default(left, right, ["k"], {"v": ""}), "k") == [(1, "x"), (2, None), (3, "")]


def test_required_matches_fail_the_job(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "t")], "k int, t string")
    hit, missing = relate.match_split(left, right, ["k"])
    assert rows(hit) == [(1, "a", "t")] and rows(missing) == [(2, "b")]
    with pytest.raises(Exception, match="no match for page"):
        relate.require_match(left, right, ["k"], "page").count()
    assert rows(relate.require_match(left.limit(1), right, ["k"]).select("t")) == [("t",)]


def test_overlays_and_replacements(spark):
    a = spark.createDataFrame([(1, "old", 1), (2, "old", 1)], "k int, v string, o int")
    b = spark.createDataFrame([(2, None, 0)], "k int, v string, o int")
    assert rows(relate.overlay([a, b], ["k"], ["o"]), "k") == [(1, "old", 1), (2, None, 0)]
    assert rows(relate.upsert(a, b, ["k"], ["o"]), "k") == [(1, "old", 1), (2, None, 0)]
    retry = spark.createDataFrame([(1, "new", 2, True), (2, "new", 2, False)], "k int, v string, o int, ok boolean")
    assert rows(relate.replaced(a, retry, ["k"], F.col("ok")), "k") == [(1, "new", 2), (2, "old", 1)]
    over = spark.createDataFrame([(1, None, "e")], "k int, v string, extra string")
    assert rows(relate.present_override(a.drop("o"), over, ["k"]), "k") == [(1, None, "e"), (2, "old", None)]


def test_spine_sets_and_forms(spark):
    r, v = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([("m",), ("n",)], "model string")
    facts = spark.createDataFrame([(1, "n", 7)], "k int, model string, x int")
    assert rows(relate.spine(r, v, facts, ["k", "model"]), "k", "model") == [(1, "m", None), (1, "n", 7), (2, "m", None), (2, "n", None)]
    with pytest.raises(ValueError):
        relate.spine(r, v, facts, ["k", "model"], most=1)
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(relate.form_update(truth, spark.createDataFrame([(1, "x"), (2, "")], "k int, w string"), "k", {"v": F.coalesce(F.nullif("form_w", F.lit("")), "v")}), "k") == [(1, "x"), (2, "b")]
    for form in ([(1, "x")], [(1, "x"), (2, "y"), (3, "z")]):
        with pytest.raises(Exception, match="in form"):
            relate.form_update(truth, spark.createDataFrame(form, "k int, w string"), "k", {}).count()
    with pytest.raises(ValueError):
        relate.same_count_join(truth, facts.select("k"), "k")
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "k int, l array<string>")
    assert rows(relate.unnested(lists, "l", "x"), "x") == [(1, "a"), (1, "b")]
    assert (2, None) in rows(relate.unnested(lists, "l", "x", keep_empty=True))


def test_ranking(spark):
    c = spark.createDataFrame([("p", 0, "top", 5.0), ("p", 1, "left", 5.0), ("p", 2, "left", 4.2), ("q", 0, "top", 1.0)], "page string, i int, side string, score double")
    got = rows(rank.top1_with_rejects(c, ["page"], "score", ["i"]), "page", "i")
    assert [(r[0], r[1], r[4], r[5], r[6]) for r in got] == [("p", 0, 1, True, 0.0), ("p", 1, 2, False, pytest.approx(0.8)), ("p", 2, 3, False, None), ("q", 0, 1, True, None)]
    assert [r[-1] for r in rows(rank.ambiguity(c, ["page"], "side", "score"), "page", "i")] == [pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3), 0.0]
    n = spark.createDataFrame([("s", "a"), ("s", "a"), ("t", "a"), ("s", ""), ("s", ""), ("s", None)], "src string, name string")
    assert sorted(r[-1] for r in rows(rank.duplicates(n, ["src", "name"]))) == [False] * 4 + [True] * 2
    with pytest.raises(ValueError):
        rank.stratified(c, "side", {"top": 3}, F.col("page"))
    assert rank.stratified(c, "side", {"top": 3, "left": 1}, F.concat("page", "i"), strict=False).count() == 3
    iv = spark.createDataFrame([(1, 0, 9), (1, 1, 2), (1, 11, 12), (1, 20, 21), (2, 0, 1)], "k int, a int, b int")
    assert rows(rank.islands(iv, ["k"], "a", "b", 2).select("k", "a", "b", "n_rows"), "k", "a") == [(1, 0, 12, 3), (1, 20, 21, 1), (2, 0, 1, 1)]
    profile = spark.createDataFrame([([0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0],)], "p array<double>")
    assert [tuple(x) for x in profile.select(rank.projection_islands(F.col("p"), 0.5, 1)).first()[0]] == [(1, 5), (8, 9)]
    assert [r[-1] for r in rows(rank.numbered(iv, ["a", "b", "k"]), "sequence_number")] == [1, 2, 3, 4, 5]
    assert rank.error_first(spark.createDataFrame([(1, "m", "错误", 1), (1, "m", "正确", 2), (2, "n", "错误", 1), (3, "m", " ", 1)], "page int, model string, v string, o int"), "page", F.col("model") == "m", "v", "正确", ["o"]).count() == 1


def test_metrics(spark):
    df = spark.createDataFrame([("a", True, 0.5), ("a", None, 0.1), ("b", False, None)], "g string, ok boolean, c double")
    assert rows(metrics.grouped_accuracy(df, "g", F.col("ok")), "value") == [("a", 2, 1, 0.5), ("b", 1, 0, 0.0)]
    none = df.limit(0)
    assert metrics.accuracy_summary(none, F.col("ok"), "c", F.lit(False), "g").first()["accuracy"] == 0.0
    assert metrics.evaluation_summary(none, "g", {"t": F.col("ok")}).first()["t_accuracy"] is None
    v = spark.createDataFrame([("m", "correct"), ("m", ""), ("m", None), ("n", None)], "model string, v string")
    assert [r[-1] for r in rows(metrics.model_accuracy(v, "model", "v", reviewed_only=True), "model")] == [1.0, None]
    assert [r[-1] for r in rows(metrics.model_accuracy(v, "model", "v", reviewed_only=False, digits=4), "model")] == [0.3333, 0.0]
    votes = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (1, "y", 4), (1, "x", 2), (2, "z", 1)], "p int, v string, o int")
    assert rows(metrics.majority_vote(votes, ["p"], "v", "o"), "p") == [(1, "y", 2, 4, 2, True), (2, "z", 1, 1, 1, False)]
    both = spark.createDataFrame([(1, "m", "a", False), (1, "n", None, False), (2, "m", "a", True)], "p int, model string, a string, r boolean")
    got = rows(metrics.compare_models(both, ["p"], "model", ["m", "n"], "r", ["a"]), "p")
    assert got == [(1, [], False, True, True), (2, ["n"], True, False, True)]
    leak = spark.createDataFrame([("s", "train"), ("s", ""), ("t", "train"), ("t", "val")], "src string, split string")
    assert rows(metrics.leakage(leak, "src", "split", ignore_blank=True)) == [("t", ["train", "val"])]
    assert metrics.leakage(leak, "src", "split", ignore_blank=False).count() == 2
    assert rows(metrics.mined_rules(leak, "split", support=2)) == [("rule_001", "train", 2)]
    assert metrics.page_pivot(both, ["p"], "model", "a", ["r"]).where("p = 1").first()["values"] == {"m": "a", "n": None}
    status = metrics.truth_status(both, spark.createDataFrame([(1, "a")], "p int, t string"), ["p"], "a", "t")
    assert sorted(r[-1] for r in rows(status)) == ["match", "mismatch", "missing"]
