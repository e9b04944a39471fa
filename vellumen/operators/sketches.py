"""Summaries that are kept day by day and merged for any span of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumen.operators.rank import kept, top_n


def distinct_state(rows: DataFrame, parts: Sequence[str], item: str) -> DataFrame:
    """(parts, bucket, members) of whole numbers: which of them a part has, as one bitmap for each 32768 of them. Nulls don't count."""
    number = F.col(item).cast("long")
    some = rows.where(number.isNotNull()).select(*parts, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_at"))
    return some.groupBy(*parts, "bucket").agg(F.bitmap_construct_agg("_at").alias("members"))


def distinct_of(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): how many different numbers the parts of a key have together, exactly. The state may repeat parts."""
    merged = state.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("members")).alias("n"))
    return merged.groupBy(*keys).agg(F.sum("n").alias("n"))


def sketch_state(rows: DataFrame, parts: Sequence[str], item: str, bits: int = 12) -> DataFrame:
    """(parts, sketch): a HyperLogLog sketch a part, of any kind of item; its error is about 1.04 / 2 ** (bits / 2) of the number."""
    return rows.groupBy(*parts).agg(F.hll_sketch_agg(item, bits).alias("sketch"))


def estimate_of(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): about how many different items the parts of a key have together."""
    return state.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def _reduced(counted: DataFrame, parts: Sequence[str], item: str, size: int) -> DataFrame:
    """The `size` largest counts of a part, less the next one: what is taken off is the part's error, at most its rows / (size + 1)."""
    most = kept(top_n(counted, parts, [F.desc("count"), F.col(item)], size + 1))
    least = most.groupBy(*parts).agg(F.when(F.count("*") > size, F.min("count")).otherwise(0).alias("_off"))
    out = most.join(least, list(parts)).withColumn("count", F.col("count") - F.col("_off"))
    # A part whose counts all go keeps its error, in a row without an item.
    rest = out.where("count > 0")
    return rest.select(*parts, item, "count", F.lit(0).cast("long").alias("error")).unionByName(least.select(*parts, F.lit(None).cast(counted.schema[item].dataType).alias(item), F.lit(0).cast("long").alias("count"), F.col("_off").cast("long").alias("error")))


def frequent_state(rows: DataFrame, parts: Sequence[str], item: str, size: int = 100) -> DataFrame:
    """(parts, item, count, error): a Misra-Gries summary of each part, at most `size` items and a row for its error.

    An item's count is too low by the error at most, and never too high; an item that isn't
    there occurs no more often than the error. Nulls are no items; null parts are refused by no one
    but meet nothing when merged. Counting has map-side parts, and no part's items are gathered:
    only the largest counts leave a task.
    """
    counted = rows.where(F.col(item).isNotNull()).groupBy(*parts, item).agg(F.count("*").alias("count"))
    return _reduced(counted, parts, item, size)


def frequent_of(state: DataFrame, keys: Sequence[str], item: str, size: int = 100) -> DataFrame:
    """The summary of the parts of each key together: errors add up, and merging adds rows / (size + 1) at most (Agarwal et al. 2012)."""
    before = state.groupBy(*keys).agg(F.sum("error").alias("_before"))
    merged = _reduced(state.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.sum("count").alias("count")), keys, item, size)
    errors = before.join(merged.where(F.col(item).isNull()).select(*keys, "error"), list(keys), "left").select(*keys, F.lit(None).cast(state.schema[item].dataType).alias(item), F.lit(0).cast("long").alias("count"), (F.col("_before") + F.coalesce("error", F.lit(0))).alias("error"))
    return merged.where(F.col(item).isNotNull()).unionByName(errors)


def frequent(rows: DataFrame, state: DataFrame, keys: Sequence[str], item: str, share: float) -> DataFrame:
    """(keys, item, n): items that are more than `share` of a key's rows, counted exactly: the summary names all that may be.

    For that its error must be at most `share` of the rows, as it is with a size of 1 / share
    and parts merged once at twice that; otherwise a ValueError says so.
    """
    merged = kept(frequent_of(state, keys, item, 2 * int(1 / share) + 1))
    sizes = kept(rows.where(F.col(item).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_all")))
    errors = merged.where(F.col(item).isNull()).select(*keys, "error")
    if not errors.join(sizes, list(keys)).where(F.col("error") > share * F.col("_all")).isEmpty():
        raise ValueError("the summaries are too small for this share")
    named = merged.where(F.col(item).isNotNull()).select(*keys, item)
    counted = rows.join(named, [*keys, item], "left_semi").groupBy(*keys, item).agg(F.count("*").alias("n"))
    return counted.join(sizes, list(keys)).where(F.col("n") > share * F.col("_all")).select(*keys, item, "n")
