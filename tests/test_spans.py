"""Joins along an axis and percentiles against brute force, with skewed, null and tied rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumen.operators import quantiles, rank, spans


def few_rows_a_range(monkeypatch):
    monkeypatch.setattr(rank, "RANGE", 9)


@pytest.mark.parametrize("strict", [True, False])
def test_as_of(spark, monkeypatch, strict):
    """A key with most rows, over many ranges; ties in time on both sides; nulls anywhere."""
    few_rows_a_range(monkeypatch)
    r = random.Random(2)
    key = lambda: r.choice(["hot"] * 8 + ["a", "b", None])
    left = [(key(), r.choice([None, *range(60)]), i) for i in range(120)] + [("lone", 5, 900), ("hot", 3, 3), ("hot", 3, 3)]
    right = [(key(), r.choice([None, *range(0, 60, 3)]), r.choice([None, 1, 2, 3])) for _ in range(90)]
    got = spans.as_of(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, u int, v int"), ["k"], "t", "u", ["v"], strict=strict, oldest=lambda t: t - 20).collect()
    want = Counter()
    for k, t, i in left:
        fit = [(u, v) for kk, u, v in right if k is not None and kk == k and t is not None and u is not None and (u < t or (not strict and u == t))]
        best = max(fit, key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=(None, None))
        want[(k, t, i, *(best if best[0] is not None and best[0] >= t - 20 else (None, None)))] += 1
    assert Counter(map(tuple, got)) == want


def test_as_of_refuses_a_name_on_both_sides(spark):
    with pytest.raises(ValueError):
        spans.as_of(spark.createDataFrame([(1, 1)], "k int, t int"), spark.createDataFrame([(1, 1)], "k int, t int"), ["k"], "t", "t", [])


@pytest.mark.parametrize("width", [None, 0.5, 1000.0])
def test_overlapping(spark, width):
    r = random.Random(3)
    lengths = [0, 0, 1, 3, 40, 900]
    side = lambda n: [(i, r.choice(["x"] * 6 + ["y", None]), s := r.randint(-50, 1000), None if r.random() < 0.05 else s + r.choice([*lengths, -1])) for i in range(n)]
    left, right = side(120), side(90)
    got = spans.overlapping(spark.createDataFrame(left, "i int, k string, a int, b int"), spark.createDataFrame(right, "j int, q string, c int, d int"), ("a", "b"), ("c", "d"), [("k", "q")], width)
    want = Counter((*p, *q) for p in left for q in right if p[1] is not None and p[1] == q[1] and None not in (p[3], q[3]) and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3])
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100


def test_many_short_intervals_below_a_long_one(spark):
    """All lie in the long one, and none in another."""
    short = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 1).alias("b"))
    other = spark.range(2000).select(F.col("id").alias("j"), (F.col("id") * 10 + 5).alias("c"), (F.col("id") * 10 + 6).alias("d")).union(spark.sql("SELECT -1L, 0L, 20000L"))
    assert spans.overlapping(short, other, ("a", "b"), ("c", "d"), width=2.0).count() == 2000


def box(r, scale=1.0):
    x, y = r.random() * scale, r.random() * scale
    return (x, y, x + r.choice([0.01, 0.02, 0.1, 0.0]) * r.uniform(0.8, 1.2), y + r.choice([0.01, 0.03]) * r.uniform(0.8, 1.2))


def brute_iou(a, b):
    shared = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return shared / (area(a) + area(b) - shared) if shared > 0 else 0.0


@pytest.mark.parametrize(("least", "dense"), [(0.05, 8), (0.3, 8), (0.5, 2000), (0.9, 3)])
def test_overlapping_boxes(spark, least, dense):
    """Most boxes crowd in a corner, some are equal, some have no area or nulls."""
    r = random.Random(5)
    rows = [(i, r.choice([1, 1, 1, 2, None]), box(r, 0.05 if i % 3 else 1.0)) for i in range(150)]
    rows += [(200 + k, 1, rows[0][2]) for k in range(3)] + [(300, 1, None), (301, 1, (0.1, None, 0.2, 0.3)), (302, 1, (0.5, 0.5, 0.4, 0.6))]
    kind = "box struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    left = spark.createDataFrame(rows, f"i int, p int, {kind}")
    right = left.select(F.col("i").alias("j"), F.col("p").alias("q"), F.col("box").alias("other"))
    got = spans.overlapping_boxes(left, right, "box", "other", least, [("p", "q")], dense).select("i", "j", "iou").collect()
    good = [x for x in rows if x[1] is not None and x[2] is not None and None not in x[2] and x[2][2] > x[2][0] and x[2][3] > x[2][1]]
    want = {(a[0], b[0]): brute_iou(a[2], b[2]) for a in good for b in good if a[1] == b[1] and brute_iou(a[2], b[2]) >= least}
    assert len(got) == len(want) and {(x["i"], x["j"]) for x in got} == set(want) and len(want) > len(good)
    assert all(x["iou"] == pytest.approx(want[x["i"], x["j"]]) for x in got)


def test_spans_of_nothing(spark):
    kind = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    assert spans.overlapping_boxes(spark.createDataFrame([], f"i int, box {kind}"), spark.createDataFrame([], f"j int, other {kind}"), "box", "other", 0.5).count() == 0
    assert spans.overlapping(spark.createDataFrame([], "a int, b int"), spark.createDataFrame([(1, 2)], "c int, d int"), ("a", "b"), ("c", "d")).count() == 0
    assert spans.as_of(spark.createDataFrame([(1, 2)], "k int, t int"), spark.createDataFrame([], "k int, u int, v int"), ["k"], "t", "u", ["v"]).collect()[0][2:] == (None, None)
    assert quantiles.percentiles(spark.createDataFrame([], "k int, v double"), ["k"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("most", [100_000, 5])
def test_percentiles(spark, most):
    """Groups of one value, of ties, of values that are far apart, of infinities and NaN, and a hot one."""
    r = random.Random(7)
    rows = [("hot", r.choice([-1e300, -3.0, 0.0, 1e-300, 2.0, 2.0, r.gauss(0, 1), 1e12 + r.random()])) for _ in range(400)]
    rows += [("ties", 7.0)] * 50 + [("one", 3.5), ("none", None), (None, 1.0), (None, 2.0)] + [("close", 1.0 + i * 2**-52) for i in range(40)] + [("odd", x) for x in (math.inf, -math.inf, math.nan, math.nan, 1.0, 2.0, -0.0, 0.0)] + [("wide", x) for x in (1.7e308, -1.7e308, 0.0, 1.0, 5.0, 6.0, 1e308)]
    shares = [0.001, 0.5, 0.95, 1.0]
    got = quantiles.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares, most).collect()
    want = Counter()
    for k in {k for k, _ in rows}:
        own = sorted((v for kk, v in rows if kk == k and v is not None), key=lambda v: (math.isnan(v), v))
        for p in shares if own else ():
            want[k, p, repr(own[math.ceil(p * len(own)) - 1] + 0.0), len(own)] += 1
    assert Counter((x["k"], x["share"], repr(x["value"] + 0.0), x["n"]) for x in got) == want


def test_histograms(spark):
    counts = [3, 3, 3, 50, 51, 0, 0, 9]
    best = quantiles.least_error_cuts(counts, 4)
    assert [(a, b) for a, b, _ in best] == [(0, 3), (3, 5), (5, 7), (7, 8)] and sum(e for *_, e in best) == pytest.approx(0.5)
    rows = [(float(i),) for i, n in enumerate(counts) for _ in range(n)] + [(None,), (math.nan,), (math.inf,)]
    found = quantiles.least_error(spark.createDataFrame(rows, "v double"), "v", 4, 8).collect()
    assert [(x["n"], x["total"]) for x in found] == [(3, 9), (2, 101), (2, 0), (1, 9)]
    values = spark.createDataFrame([(v,) for v in random.Random(1).choices(range(20), k=103)] + [(None,)], "v int")
    depth = {x["bucket"]: x for x in quantiles.equal_depth(values, "v", 10).collect()}
    own = sorted(x["v"] for x in values.collect() if x["v"] is not None)
    parts = [[v for i, v in enumerate(own) if i * 10 // 103 == b] for b in range(10)]
    assert {b: (x["low"], x["high"], x["n"]) for b, x in depth.items()} == {b + 1: (min(p), max(p), len(p)) for b, p in enumerate(parts)}


def test_brute_force_cuts():
    r = np.random.default_rng(1)
    for _ in range(20):
        counts = r.integers(0, 9, size=7).tolist()
        found = quantiles.least_error_cuts(counts, 3)
        spread = lambda x: sum((v - sum(x) / len(x)) ** 2 for v in x)
        least = min(spread(counts[:i]) + spread(counts[i:j]) + spread(counts[j:]) for i in range(1, 6) for j in range(i + 1, 7))
        assert sum(e for *_, e in found) == pytest.approx(least)


def test_islands_and_numbers_of_hot_keys(spark, monkeypatch):
    """A key over many ranges: how far it has come is carried on, also past ranges that don't reach as far."""
    few_rows_a_range(monkeypatch)
    r = random.Random(8)
    rows = [(r.choice(["hot"] * 9 + ["a", None]), s := r.randint(0, 3000), s + r.choice([0, 1, 5, 400 if r.random() < 0.1 else 2])) for _ in range(250)]
    frame = spark.createDataFrame(rows, "k string, s int, e int")
    want = Counter()
    for k in {x[0] for x in rows}:
        found, last = [], None
        for s, e in sorted(x[1:] for x in rows if x[0] == k):
            if last is None or s - last > 7:
                found.append([s, e, 0])
            found[-1][1:] = [max(found[-1][1], e), found[-1][2] + 1]
            last = e if last is None else max(last, e)
        want.update((k, i + 1, *x) for i, x in enumerate(found))
    assert Counter(map(tuple, rank.islands(frame, ["k"], "s", "e", 7).collect())) == want
    numbers = rank.numbered_within(frame, ["k"], ["s", "e"]).collect()
    for k in {x[0] for x in rows}:
        mine = sorted((x["sequence_number"], x["s"], x["e"]) for x in numbers if x["k"] == k)
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and [x[1:] for x in mine] == sorted(x[1:] for x in rows if x[0] == k)


@pytest.mark.parametrize("width", [1, 2, 5, 8])
def test_smoothed_in_blocks(spark, monkeypatch, width):
    few_rows_a_range(monkeypatch)
    monkeypatch.setattr(rank, "BLOCK", 7)
    rows = [("hot" if i % 5 else None, i, float(i * i % 13)) for i in range(90)]
    found = {x["i"]: x["m"] for x in rank.smoothed(spark.createDataFrame(rows, "k string, i int, v double"), "v", ["k"], ["i"], width, "m").collect()}
    before = (width - 1) // 2
    for k in ("hot", None):
        own = [(i, v) for kk, i, v in rows if kk == k]
        for n, (i, _) in enumerate(own):
            lo = n - (width - 1 - before)
            assert found[i] == pytest.approx(sum(v for _, v in own[max(lo, 0) : n + before + 1]) / width)
