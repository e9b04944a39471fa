"""Summaries of parts, merged: exact bitmaps, and bounds of sketches, on skewed, null and tied rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumen.operators import sketches


def rows_of(seed, n=3000):
    r = random.Random(seed)
    return [(r.randint(1, 5), r.choice(["k"] * 9 + ["l"]), r.choice([None, 1, 1, 1, 2, 2, *range(3, 60), r.randint(60, 4000), 10**12])) for _ in range(n)]


def test_distinct_of_any_parts(spark):
    rows = rows_of(1)
    state = sketches.distinct_state(spark.createDataFrame(rows, "day int, k string, item long"), ["day", "k"], "item").cache()
    for days in ((1,), (2, 3), (1, 2, 3, 4, 5)):
        part = state.where(F.col("day").isin(*days))
        got = {x["k"]: x["n"] for x in sketches.distinct_of(part.unionByName(part), ["k"]).collect()}
        assert got == {k: len({i for d, kk, i in rows if d in days and kk == k and i is not None}) for k in "kl"}


def test_estimates(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 9000).cast("string").alias("item"))
    state = sketches.sketch_state(rows, ["day"], "item")
    assert abs(sketches.estimate_of(state.withColumn("all", F.lit(1)), ["all"]).first()["n"] / 9000 - 1) < 5 * 1.04 / 64


@pytest.mark.parametrize("size", [1, 4, 20, 5000])
def test_counts_are_low_by_the_error_at_most(spark, size):
    rows = rows_of(2)
    state = sketches.frequent_state(spark.createDataFrame(rows, "day int, k string, item long"), ["k", "day"], "item", size)
    found = sketches.frequent_of(state, ["k"], "item", size).collect()
    for k in "kl":
        true = Counter(i for _, kk, i in rows if kk == k and i is not None)
        error = sum(x["error"] for x in found if x["k"] == k)
        counts = {x["item"]: x["count"] for x in found if x["k"] == k and x["item"] is not None}
        assert len(counts) <= size and error <= 2 * sum(true.values()) / (size + 1)
        assert all(true[i] - error <= c <= true[i] for i, c in counts.items())
        assert all(n <= error for i, n in true.items() if i not in counts)


def test_frequent_items_are_exact(spark):
    rows = rows_of(3)
    frame = spark.createDataFrame(rows, "day int, k string, item long")
    state = sketches.frequent_state(frame, ["k", "day"], "item", 60)
    got = {(x["k"], x["item"]): x["n"] for x in sketches.frequent(frame, state, ["k"], "item", 0.02).collect()}
    want = {}
    for k in "kl":
        true = Counter(i for _, kk, i in rows if kk == k and i is not None)
        want |= {(k, i): n for i, n in true.items() if n > 0.02 * sum(true.values())}
    assert got == want and len(want) > 4
    with pytest.raises(ValueError):
        sketches.frequent(frame, sketches.frequent_state(frame, ["k", "day"], "item", 1), ["k"], "item", 0.02)
    assert sketches.frequent_of(sketches.frequent_state(frame.where("false"), ["k"], "item"), ["k"], "item").count() == 0
