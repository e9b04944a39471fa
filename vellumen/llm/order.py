"""Running counts and sums along an order, without gathering a group in a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumen.llm.common import discard, materialize

#: Rows of a range, about.
ROWS = 100_000


def ranged(rows: DataFrame, groups: Sequence[str], order: Sequence[str | Column], per_range: int = ROWS) -> DataFrame:
    """The rows, dealt into ranges of the groups and the order, and written; adds _row and _range.

    _row tells rows apart, and is the last tie-break; it lets one value span ranges. There are
    as many ranges as the rows need, and not fewer than shuffle partitions.
    """
    spark = rows.sparkSession
    written = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    parts = max(1, -(-written.count() // per_range), int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = materialize(written.repartitionByRange(parts, *groups, *order, "_row").withColumn("_range", F.spark_partition_id()))
    discard(written)
    return out


def before(rows: DataFrame, groups: Sequence[str], value: str | None = None) -> DataFrame:
    """(groups, _range, _before, _all): what stands before a range in its group, and in the whole group.

    Counts of rows, or sums of a column. A group has as many rows here as ranges.
    """
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*groups, "_range").agg((F.count("*") if value is None else F.sum(value)).alias("_part"))
    return parts.select(*groups, "_range", F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_before"), F.sum("_part").over(whole).alias("_all"))


def numbered(rows: DataFrame, group: str, order: Sequence[str | Column], per_range: int = ROWS) -> DataFrame:
    """Adds at, the row's number in its group from 0 along the order, and n, the group's rows. No group is null."""
    placed = ranged(rows, [group], order, per_range)
    within = Window.partitionBy(group, "_range").orderBy(*order, "_row")
    joined = placed.withColumn("_at", F.row_number().over(within)).join(before(placed, [group]), [group, "_range"])
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at") - 1).alias("at"), F.col("_all").alias("n"))
