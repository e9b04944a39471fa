"""Exact percentiles of groups of any size, and histograms of equal depth and of least error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumen.operators.rank import kept

#: Rows of a group, or of a stretch of its values, that are sorted in one task; parts that a stretch is cut into.
SORTED, PARTS = 100_000, 4096


def _steps(value: Column) -> Column:
    """A whole number that grows with the value, by eight steps a doubling: what isn't a number is last."""
    size = F.floor(F.log(F.abs(value)) / F.log(F.lit(2.0)) * 8).cast("long") + 10_000
    size = F.when(F.abs(value) == float("inf"), F.lit(99_999)).otherwise(size)
    return F.when(F.isnan(value), F.lit(100_000)).when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)


def _parts(value: Column) -> Column:
    """Which of PARTS equal parts between a stretch's least and greatest value."""
    low, high = F.col("_a"), F.col("_b")
    return F.floor((value / 2 - low / 2) / (high / 2 - low / 2) * PARTS).cast("long")  # halves stay in range


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], most: int | None = None) -> DataFrame:
    """(keys, share, value, n): for each share p of 0 < p <= 1 the value of rank ceil(p n) among the n values of a group, as doubles.

    Nulls don't count; a group of nulls alone has no row. A null key is a group like others.
    NaN comes after all numbers.

    Groups of at most `most` values (SORTED) are sorted, each in a task. The values of a larger one are
    counted by eight steps a doubling, then stretch by stretch by PARTS equal parts, until a
    stretch that has a wanted rank holds so few values, or one: at most some six rounds, each
    an aggregation with map-side parts over the rows of stretches that are still too large.
    """
    if any(not 0 < p <= 1 for p in shares):
        raise ValueError("a share must be above 0 and at most 1")
    most = most or SORTED
    names = [f"_k{i}" for i in range(len(keys))]
    none = [f"_z{i}" for i in range(len(keys))]
    on = [*names, *none]
    # A null key is told by its own flag, so that joins find it.
    key = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(n) for k, n in zip(keys, names, strict=True)]
    cells = rows.where(F.col(value).isNotNull()).select(*key, *(F.col(k).isNull().alias(z) for k, z in zip(keys, none, strict=True)), *(F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("_v"))
    originals = [f"_o{i}" for i in range(len(keys))]
    counts = kept(cells.groupBy(*on).agg(F.count("*").alias("_n"), *(F.first(o).alias(o) for o in originals)))
    big = counts.where(F.col("_n") > most)
    wanted = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("_share"), F.ceil(F.lit(float(p)) * F.col("_n")).alias("_rank")) for p in shares)))
    out = lambda df: df.select(*(F.col(o).alias(k) for o, k in zip(originals, keys, strict=True)), F.col("_share").alias("share"), F.col("_v").alias("value"), F.col("_n").alias("n"))
    by = Window.partitionBy(*on)
    small = cells.drop(*originals).join(big.select(*on), on, "left_anti") if not big.isEmpty() else cells.drop(*originals)
    small = small.withColumn("_at", F.row_number().over(by.orderBy("_v")))
    picked = small.join(counts.select(*on, *originals, "_n", wanted.alias("_w")).select("*", "_w.*").withColumnRenamed("_rank", "_at"), [*on, "_at"])
    if big.isEmpty():
        return out(picked)
    answers = [picked.select(*originals, "_share", "_v", "_n")]
    ranks = kept(big.select(*on, *originals, "_n", F.lit(0.0).alias("_a"), wanted.alias("_w")).select("*", "_w.*").drop("_w"))
    open_ = cells.drop(*originals).join(big.select(*on), on, "left_semi").withColumns({"_a": F.lit(0.0), "_b": F.lit(0.0)})
    first = True
    while True:
        part = open_.withColumn("_part", _steps(F.col("_v")) if first else _parts(F.col("_v")))
        first = False
        found = part.groupBy(*on, "_a", "_part").agg(F.count("*").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        along = Window.partitionBy(*on, "_a").orderBy("_part")
        found = found.withColumn("_before", F.coalesce(F.sum("_m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        hit = kept(ranks.join(found, [*on, "_a"]).where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_m"))))
        answers.append(hit.where("_low = _high").select(*originals, "_share", F.col("_low").alias("_v"), "_n"))
        rest = hit.where("_low <> _high")
        if rest.isEmpty():
            break
        ranks = rest.select(*on, *originals, "_n", "_share", F.col("_low").alias("_a"), (F.col("_rank") - F.col("_before")).alias("_rank"), "_m")
        stretches = rest.select(*on, "_a", "_part", "_low", "_high", "_m").distinct()
        open_ = kept(part.join(stretches, [*on, "_a", "_part"]).select(*on, "_v", F.col("_low").alias("_a"), F.col("_high").alias("_b"), "_m"))
        few = open_.where(F.col("_m") <= most).withColumn("_rank", F.row_number().over(Window.partitionBy(*on, "_a").orderBy("_v")).cast("long"))
        answers.append(few.drop("_m").join(ranks.where(F.col("_m") <= most).drop("_m"), [*on, "_a", "_rank"]).select(*originals, "_share", "_v", "_n"))
        open_, ranks = open_.where(F.col("_m") > most).drop("_m"), ranks.where(F.col("_m") > most).drop("_m")
        if ranks.isEmpty():
            break
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    return out(every)


def equal_depth(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """(bucket, low, high, n) of the values in order: bucket i from 1 has those of rank above (i - 1) n / buckets and up to i n / buckets, rounded up.

    Nulls don't count. Values that are equal may lie in two buckets. Values are put in order
    by ranges, and numbered along them.
    """
    from vellumen.operators.rank import numbered

    values = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
    placed = kept(numbered(values, ["_v"], "_at"))
    n = placed.count()
    bucket = F.floor((F.col("_at") - 1) * buckets / F.lit(max(n, 1))).cast("int") + 1
    return placed.groupBy(bucket.alias("bucket")).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("n"))


def least_error(rows: DataFrame, value: str, buckets: int, cells: int = 512) -> DataFrame:
    """(bucket, low, high, n, total, error): at most `buckets` buckets of neighbouring cells with the least sum of squared distances of cell counts to their bucket's mean.

    The values are counted once, in `cells` equal parts between the least and the greatest;
    that many numbers are what the dynamic programme gets, whatever the rows. low and high are
    the ends of the first and last cell, n the cells, total their rows. Nulls, NaN and infinite
    values don't count. Ties: the earliest cut.
    """
    usable = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v")).where(~F.isnan("_v") & (F.abs("_v") != float("inf")))
    low, high = usable.agg(F.min("_v"), F.max("_v")).first()
    schema = "bucket int, low double, high double, n int, total long, error double"
    if low is None:
        return rows.sparkSession.createDataFrame([], schema)
    step = (high - low) / cells if high > low else 1.0
    at = F.least(F.floor((F.col("_v") - low) / step), F.lit(cells - 1)).cast("int")
    counts = [0] * cells
    for r in usable.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect():  # `cells` rows at most
        counts[r["at"]] = r["n"]
    return rows.sparkSession.createDataFrame([(i + 1, low + a * step, low + b * step, b - a, sum(counts[a:b]), e) for i, (a, b, e) in enumerate(least_error_cuts(counts, buckets))], schema)


def least_error_cuts(counts: Sequence[int], buckets: int) -> list[tuple[int, int, float]]:
    """(begin, end, error) of the buckets: Jagadish et al.'s dynamic programme over prefix sums."""
    import numpy as np

    n = len(counts)
    sums = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    squares = np.concatenate([[0.0], np.cumsum(np.square(counts, dtype=np.float64))])

    def error(a: np.ndarray, b: int) -> np.ndarray:
        return np.maximum(squares[b] - squares[a] - (sums[b] - sums[a]) ** 2 / (b - a), 0.0)

    k = min(buckets, n)
    best = np.full((k + 1, n + 1), np.inf)
    cut = np.zeros((k + 1, n + 1), np.int64)
    best[0, 0] = 0.0
    for j in range(1, k + 1):
        for b in range(j, n + 1):
            a = np.arange(j - 1, b)
            whole = best[j - 1, a] + error(a, b)
            cut[j, b] = a[int(whole.argmin())]
            best[j, b] = whole.min()
    out, b = [], n
    for j in range(k, 0, -1):
        a = int(cut[j, b])
        out.append((a, b, float(error(np.array([a]), b)[0])))
        b = a
    return out[::-1]
