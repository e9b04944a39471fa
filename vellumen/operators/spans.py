"""Joins along an axis: the last row before another, intervals that overlap, boxes that overlap."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumen.operators.rank import in_ranges, kept

#: Bins of an interval's level are FACTOR times as wide as those of the level below.
FACTOR = 4
#: Boxes of a cell beyond which it is split; halvings of the plane, at most.
DENSE, DEPTH = 2000, 24


def _apart(left: DataFrame, right: DataFrame) -> None:
    if set(left.columns) & set(right.columns):
        raise ValueError("both sides have a column of the same name")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, values: Sequence[str], *, strict: bool = True, oldest: Callable[[Column], Column] | None = None) -> DataFrame:
    """Left rows with right_at and values of the last right row of the same keys before them.

    strict: before, else at the same time too. oldest gives the earliest time that still counts
    for a left row's time. Of right rows at one time the last by its values counts. Left rows
    for which there is none stay, with nulls, as do those with a null key or time; right
    rows with one don't count. The names of values and right_at must be new to the left side.

    Both sides are put in one order by key and time, dealt into ranges of it by the number of
    rows, and the last right row is carried on within a range and from the ranges before: a
    key may have any share of the rows.
    """
    _apart(left, right.select(right_at, *values))
    ready = F.lit(True)
    for c in (*keys, at):
        ready &= F.col(c).isNotNull()
    names = [f"_k{i}" for i in range(len(keys))]
    found = F.struct(F.col(right_at), *values)
    kind = right.select(found.alias("r")).schema["r"].dataType
    own = left.schema
    mine = left.where(ready).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(kind).alias("_right"))
    usable = F.lit(True)
    for c in (*keys, right_at):
        usable &= F.col(c).isNotNull()
    theirs = right.where(usable).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(right_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(own).alias("_left"), found.alias("_right"))
    order = ["_at", "_side", "_right"]
    rows = in_ranges(mine.unionByName(theirs), [*names, *order, F.xxhash64("_left")])
    here = F.last("_right", ignorenulls=True).over(Window.partitionBy(*names, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where(F.col("_right").isNotNull()).groupBy(*names, "_range").agg(F.max(F.struct("_at", "_right")).alias("_end"))
    # A range may hold a key's left rows alone: it needs a place in the order of ranges too.
    places = rows.groupBy(*names, "_range").agg(F.lit(1).alias("_one")).join(ends, [*names, "_range"], "left")
    earlier = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select(*names, "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    joined = rows.withColumn("_here", here).where(F.col("_left").isNotNull()).join(carried, [*names, "_range"])
    last = F.coalesce("_here", "_carried._right")
    if oldest is not None:
        last = F.when(last[right_at] >= oldest(F.col("_at")), last)
    matched = joined.select("_left", last.alias("_last")).select("_left.*", "_last.*")
    none = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in (right_at, *values)]
    return matched.unionByName(left.where(~ready).select("*", *none))


def overlapping(left: DataFrame, right: DataFrame, span: tuple[str, str], right_span: tuple[str, str], keys: Sequence[tuple[str, str]] = (), width: float | None = None) -> DataFrame:
    """All pairs of rows whose closed intervals of numbers have a point in common, and whose keys are equal.

    keys: pairs of names. Intervals with a null, or that end before they begin, meet
    nothing, nor do null keys. A point is an interval. Column names of the sides must differ.

    An interval's length gives its level, where a bin is FACTOR times as wide as at the level
    below and it touches two bins or so. A pair meets at the higher of its two levels: there one side is
    at home, and the other comes up from below, to such levels alone as the other side
    has. So a row goes to O(log) bins, and bins that many rows touch are met only by long
    intervals. A pair counts in the bin where what it shares begins. width: of the bins of level 0;
    by default the mean length.
    """
    _apart(left, right)

    def ready(rows: DataFrame, ends: tuple[str, str], names: list[str], tag: str) -> DataFrame:
        low, high = F.col(ends[0]).cast("double"), F.col(ends[1]).cast("double")
        good = rows.where(F.coalesce(low <= high, F.lit(False)) & ~F.isnan(high) & (F.abs(low) != float("inf")) & (F.abs(high) != float("inf")))
        for k in names:
            good = good.where(F.col(k).isNotNull())
        return good.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), low.alias(f"_{tag}0"), high.alias(f"_{tag}1"), F.struct(*rows.columns).alias(f"_{tag}"))

    sides = {"l": kept(ready(left, span, [a for a, _ in keys], "l")), "r": kept(ready(right, right_span, [b for _, b in keys], "r"))}
    if width is None:
        means = [side.agg(F.avg(F.col(f"_{tag}1") - F.col(f"_{tag}0"))).first()[0] or 0.0 for tag, side in sides.items()]
        width = max(means) or 1.0
    level = lambda tag: F.greatest(F.lit(0), F.ceil(F.log(F.greatest((F.col(f"_{tag}1") - F.col(f"_{tag}0")) / width, F.lit(1.0))) / F.log(F.lit(float(FACTOR))))).cast("int")
    sides = {tag: side.withColumn(f"_{tag}level", level(tag)) for tag, side in sides.items()}
    levels = {tag: sorted(side.agg(F.collect_set(f"_{tag}level")).first()[0]) for tag, side in sides.items()}  # some dozens at most
    size = F.lit(width) * F.pow(F.lit(float(FACTOR)), F.col("_level"))

    def binned(tag: str, at: Column) -> DataFrame:
        on = sides[tag].withColumn("_level", F.explode(at))
        return on.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"_{tag}0") / size), F.floor(F.col(f"_{tag}1") / size))))

    def above(tag: str, other: str, same: bool) -> Column:
        low = F.col(f"_{tag}level")
        there = F.array(*map(F.lit, levels[other])).cast("array<int>")
        return F.filter(there, lambda x: x >= low if same else x > low)

    on = [*(f"_k{i}" for i in range(len(keys))), "_level", "_bin"]
    met = lambda a, b: a.join(b, on).where((F.col("_l0") <= F.col("_r1")) & (F.col("_r0") <= F.col("_l1")) & (F.col("_bin") == F.floor(F.greatest("_l0", "_r0") / size)))
    home = met(binned("l", F.array("_llevel")), binned("r", above("r", "l", same=True)))
    away = met(binned("l", above("l", "r", same=False)), binned("r", F.array("_rlevel")))
    return home.select("_l.*", "_r.*").unionByName(away.select("_l.*", "_r.*"))


def overlapping_boxes(left: DataFrame, right: DataFrame, box: str, right_box: str, least: float, keys: Sequence[tuple[str, str]] = (), dense: int | None = None) -> DataFrame:
    """All pairs of rows whose boxes (xmin, ymin, xmax, ymax) overlap by an IoU of `least` or more, with iou, and whose keys are equal.

    Boxes with a null, or without an area, meet nothing, nor do null keys. Column names of the
    sides must differ. `least` is above 0.

    Boxes of such a pair differ in width by no more than 1 / least. So widths are classes
    of that ratio or twofold, and a right box goes to its own class and both beside it. A class
    begins as one cell of the plane a key, and a cell with more than `dense` boxes is split
    into four, until its sides come down to those of the boxes: no box is in more than a few cells.
    A pair counts in the cell that has the first corner of what it shares.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    _apart(left, right)
    base = max(2.0, 1 / least)

    def ready(rows: DataFrame, name: str, names: list[str], side: int) -> DataFrame:
        corner = {c: F.col(name)[c].cast("double").alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")}
        wide, high = corner["xmax"] - corner["xmin"], corner["ymax"] - corner["ymin"]
        good = F.coalesce((wide > 0) & (high > 0) & (wide < float("inf")) & (high < float("inf")), F.lit(False))
        for k in names:
            good &= F.col(k).isNotNull()
        own = F.floor(F.log(wide) / F.log(F.lit(base))).cast("int")
        return rows.where(good).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), *corner.values(), F.lit(side).alias("_side"), (F.struct(*rows.columns) if side == 0 else F.lit(None).cast(left.schema)).alias("_l"), (F.struct(*rows.columns) if side else F.lit(None).cast(right.schema)).alias("_r"), (F.array(own) if side == 0 else F.array(own - 1, own, own + 1)).alias("_classes"))

    every = kept(ready(left, box, [a for a, _ in keys], 0).unionByName(ready(right, right_box, [b for _, b in keys], 1)).withColumn("_class", F.explode("_classes")).drop("_classes"))
    extent = every.agg(F.min("_xmin"), F.min("_ymin"), F.max("_xmax"), F.max("_ymax")).first()
    names = [f"_k{i}" for i in range(len(keys))]
    if extent[0] is None:
        return every.select("_l.*", "_r.*", F.lit(0.0).alias("iou"))
    x0, y0, wide, high = extent[0], extent[1], extent[2] - extent[0], extent[3] - extent[1]
    # A class is a number of widths; how often its cells may be halved is two numbers.
    largest = every.groupBy("_class").agg(*(F.max(F.col(f"_{a}max") - F.col(f"_{a}min")).alias(f"_{a}") for a in "xy"))
    halvings = lambda whole, side: F.least(F.lit(DEPTH), F.greatest(F.lit(0), F.floor(F.log(F.lit(whole) / side) / F.log(F.lit(2.0))))).cast("int")
    limits = largest.select("_class", halvings(wide, F.col("_x")).alias("_xdepth"), halvings(high, F.col("_y")).alias("_ydepth"))
    cell = [*names, "_class", "_depth", "_cx", "_cy"]
    sides = lambda d: (F.lit(wide) / F.pow(F.lit(2.0), F.least(d, F.col("_xdepth"))), F.lit(high) / F.pow(F.lit(2.0), F.least(d, F.col("_ydepth"))))
    place = lambda value, zero, side: F.floor((value - F.lit(zero)) / side)
    open_ = every.join(F.broadcast(limits), "_class").withColumns({"_depth": F.lit(0), "_cx": F.lit(0).cast("long"), "_cy": F.lit(0).cast("long")})
    leaves = None
    for depth in range(DEPTH + 1):
        counts = open_.groupBy(*cell).agg(F.count("*").alias("_n"), F.max(F.greatest("_xdepth", "_ydepth")).alias("_most"))
        full = kept(counts.where((F.col("_n") > (dense or DENSE)) & (F.col("_depth") < F.col("_most"))).select(*cell))
        split = not full.isEmpty()
        done = open_.join(full, cell, "left_anti") if split else open_
        leaves = done if leaves is None else leaves.unionByName(done)
        if not split:
            break
        below = open_.join(full, cell, "left_semi").withColumn("_depth", F.lit(depth + 1))
        sx, sy = sides(F.lit(depth + 1))
        inside = lambda c, old, low, high_, limit: F.filter(F.sequence(low, high_), lambda x: F.when(F.col(limit) > depth, F.floor(x / 2) == F.col(old)).otherwise(x == F.col(old)))  # noqa: B023, E731
        below = below.withColumn("_nx", F.explode(inside("x", "_cx", place(F.col("_xmin"), x0, sx), place(F.col("_xmax"), x0, sx), "_xdepth")))
        below = below.withColumn("_ny", F.explode(inside("y", "_cy", place(F.col("_ymin"), y0, sy), place(F.col("_ymax"), y0, sy), "_ydepth")))
        open_ = kept(below.withColumns({"_cx": F.col("_nx"), "_cy": F.col("_ny")}).drop("_nx", "_ny"))
    corners = ["xmin", "ymin", "xmax", "ymax"]
    one = leaves.where("_side = 0").select(*cell, "_l", "_xdepth", "_ydepth", *(F.col(f"_{c}").alias(f"_l{c}") for c in corners))
    two = leaves.where("_side = 1").select(*cell, "_r", *(F.col(f"_{c}").alias(f"_r{c}") for c in corners))
    shared = {a: F.least(f"_l{a}max", f"_r{a}max") - F.greatest(f"_l{a}min", f"_r{a}min") for a in "xy"}
    common = F.greatest(shared["x"], F.lit(0.0)) * F.greatest(shared["y"], F.lit(0.0))
    area = lambda t: (F.col(f"_{t}xmax") - F.col(f"_{t}xmin")) * (F.col(f"_{t}ymax") - F.col(f"_{t}ymin"))
    iou = common / (area("l") + area("r") - common)
    sx, sy = sides(F.col("_depth"))
    first = (F.col("_cx") == place(F.greatest("_lxmin", "_rxmin"), x0, sx)) & (F.col("_cy") == place(F.greatest("_lymin", "_rymin"), y0, sy))
    return one.join(two, cell).where((common > 0) & (iou >= least) & first).select("_l.*", "_r.*", iou.alias("iou"))
