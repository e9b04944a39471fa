"""Sharding by a hierarchical weighted hash tree, with DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumen.llm.common import materialize


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. Weights count in every node above it."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """Shards 0, 1, ... of weight 1, filled rack by rack and region by region."""
    return [Shard(f"region{i // (racks * per_rack)}", f"rack{i // per_rack}", i) for i in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a rack and region of its own.

    No other subtree's weight changes, so rows move into the new shard alone.
    """
    n = max((s.shard for s in tree), default=-1) + 1
    return [*tree, Shard(f"region+{n}", f"rack+{n}", n, weight)]


def pick(key: Column, level: str, children: Column) -> Column:
    """The child with the least draw, of an array of structs (name, weight, child).

    A draw is an exponential number with the weight as its rate, from a hash of key and
    name, so a child wins with a probability in proportion to its weight. A weight that
    grows only draws rows in, one that shrinks only lets rows go.
    """

    def drawn(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{level}/"), c["name"], F.lit("/"), key)), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / c["weight"]).alias("draw"), c["child"].alias("child"))

    return F.array_min(F.transform(children, drawn))["child"]


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key: at the region, rack and shard level in turn the child with the least draw."""
    if any(s.weight < 0 for s in tree) or not any(s.weight > 0 for s in tree):
        raise ValueError("weights must not be negative, nor all of them zero")
    node = lambda name, weight, child: F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(child).alias("child"))
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in tree:
        if s.weight > 0:
            regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    top, middle, leaves = [], [], []
    for i, (region, racks) in enumerate(regions.items()):
        top.append(node(region, sum(s.weight for rack in racks.values() for s in rack), i))
        inner = []
        for rack, shards in racks.items():
            inner.append(node(rack, sum(s.weight for s in shards), len(leaves)))
            leaves.append(F.array(*(node(str(s.shard), s.weight, s.shard) for s in shards)))
        middle.append(F.array(*inner))
    region = pick(key, "region", F.array(*top))
    rack = pick(key, "rack", F.get(F.array(*middle), region))
    return pick(key, "shard", F.get(F.array(*leaves), rack)).cast("int")


def assign(docs: DataFrame, tree: list[Shard], larger: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 100_000) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    Id and tree alone decide the shard: law "key". A null id is placed as the empty key.
    size: UTF-8 bytes of the text, none for null, plus 1. slot: the row's number in its
    shard by (id, size, checksum), from 0 without gaps; rows alike in all three take any order.
    grown_shard: the shard in the larger tree. Other columns are not read.

    Slots are numbered without gathering a shard in a task: rows are dealt into ranges of the
    whole order, (range, shard) counts are summed up along the ranges, and rows are numbered
    within a range and shard. A salt lets one id's rows span ranges.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        place(key, tree).alias("shard"),
        (place(key, larger) if larger else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_salt"),
    )
    rows = materialize(rows)
    parts = max(1, -(-rows.count() // rows_per_part), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(id_col).asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("_salt")]
    ranged = materialize(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("shard", "_range").agg(F.count("*").alias("_n")).select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_range").orderBy(*order)
    numbered = ranged.withColumn("_at", F.row_number().over(within)).join(counts, ["shard", "_range"])
    return numbered.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard")
