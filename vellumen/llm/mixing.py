"""Mixing sources to target weights along a curriculum, with DataFrame functions alone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumen.llm.common import discard, materialize
from vellumen.llm.order import before, numbered, ranged

#: A source's weight over training time, from 0 to 1: (time, weight) points with straight lines between.
Schedule = Sequence[tuple[float, float]]
#: Falling, level, and rising from the middle on; the sources take them in turn.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
WORD = r"[^\x20\x09-\x0D]+"


def segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(area before, start, length, weight at the start, slope) of each line that has an area; the whole area is 1."""
    points = list(zip(schedule, schedule[1:], strict=False))
    if schedule[0][0] != 0 or schedule[-1][0] != 1 or any(a[0] > b[0] for a, b in points) or any(not (math.isfinite(w) and w >= 0) for _, w in schedule):
        raise ValueError("a schedule runs from time 0 to 1 with weights that are finite and not negative")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in points]
    whole = sum(areas)
    if whole <= 0:
        raise ValueError("a schedule needs a weight above 0 somewhere")
    out, done = [], 0.0
    for (a, b), area in zip(points, areas, strict=True):
        if area > 0:
            out.append((done, a[0], b[0] - a[0], a[1] / whole, (b[1] - a[1]) / whole / (b[0] - a[0])))
        done += area / whole
    return out


def when_due(share: Column, schedule: Schedule) -> Column:
    """The time at which a source's demand, the integral of its weight, has come to a share of its whole: the inverse, line by line."""
    parts = segments(schedule)
    due = None
    for done, start, length, weight, slope in reversed(parts):
        rest = F.greatest(share - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight * weight) + 2.0 * slope * rest, F.lit(0.0)))
        time = F.when(rest == 0, start).otherwise(F.least(start + 2.0 * rest / (weight + root), F.lit(start + length)))
        due = time if due is None else F.when(share < after, time).otherwise(due)
        after = done
    return due


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, place, target) of (source, source_size): what each source is to give.

    The sources weigh `weights` in turn, by code point, and share `share` times all sizes by weight;
    none gives over `most` times its size, and what is over goes to the others by weight.
    So a target is the smaller of that bound and weight times one level. In the order of bound /
    weight, the first source whose bound isn't reached tells the level: what those before leave,
    over the weight of the rest. No source is named on the driver, however many there are.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    placed = numbered(sources.withColumn("all", F.lit("")), "all", ["source"])
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights)).cast("int"))
    capped = placed.select("all", "source", "source_size", F.col("at").alias("place"), weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("bound"))
    order = [F.col("bound") / F.col("weight"), F.col("source")]
    rows = ranged(capped, ["all"], order)
    sums = before(rows, ["all"], "bound").join(before(rows, ["all"], "weight").select("_range", F.col("_before").alias("_w"), F.col("_all").alias("_every")), "_range")
    within = Window.partitionBy("_range").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0.0))
    joined = rows.select("*", sofar("bound").alias("_b"), sofar("weight").alias("_v")).join(sums.drop("all"), "_range")
    left = F.lit(float(share)) * F.col("_all") / most - (F.col("_before") + F.col("_b"))
    level = left / (F.col("_every") - (F.col("_w") + F.col("_v")))
    found = joined.where(F.col("bound") > F.col("weight") * level).agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], level.alias("level"))).alias("first"))
    target = F.coalesce(F.least("bound", F.col("weight") * F.col("first.level")), F.col("bound"))
    return rows.crossJoin(F.broadcast(found)).select("source", "source_size", "place", target.alias("target"))  # found is one row


def mixed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, curriculum: Sequence[Schedule] = CURRICULUM, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix in training order: (row, id, source, size, source_size, target, pass, taken, position, start).

    size: words of the text, none for a null. A source's documents lie end to end in the order
    of a hash of their ids, `most` times over, and the mix takes them from the start until
    its target, rounded down, is met; the document it ends in gives its first `taken` words.
    A pass over a document that gives words has a row: position is the time from 0 to 1 at which the
    source's demand, its schedule integrated and scaled to its target, comes to the words before it;
    start, the words of the whole mix before it, from range-sorting by position. A document
    that gives none has one row with nulls, and 0 taken.

    Sources are in code point order, a null one last; sources take weights and schedules of the
    curriculum in turn. row tells rows apart. Repeated rows and ids are documents of their own;
    those alike in id and size may change places. Other columns are not read.
    No source is gathered: its sizes are summed by range, and along the ranges.
    """
    key = F.when(F.col(source_col).isNull(), "=").otherwise(F.concat(F.lit("-"), source_col))
    draw = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.char_length(F.translate(F.regexp_replace(text_col, WORD, "x"), "\t\n\x0b\x0c\r ", "")), F.lit(0))
    sized = docs.select(F.col(id_col).alias("id"), key.alias("source"), size.cast("long").alias("size"), draw.alias("draw"))
    order = ["draw", F.col("id").asc_nulls_first(), "size"]
    rows = ranged(sized, ["source"], order)
    sums = materialize(before(rows, ["source"], "size"))
    sources = targets(sums.select("source", F.col("_all").alias("source_size")).distinct(), weights, share, most)
    within = Window.partitionBy("source", "_range").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.select("source", "_range", "_before").join(sources, "source")
    laid = rows.withColumn("_ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(known, ["source", "_range"])
    whole = F.floor("target")

    def one(i: int) -> Column:  # a pass over the source
        offset = F.col("_before") + F.col("_ahead") + i * F.col("source_size")
        taken = F.greatest(F.least(F.col("size"), whole - offset), F.lit(0))
        share_ = F.try_divide(offset.cast("double"), F.col("target"))
        due = when_due(share_, curriculum[-1])
        for j, schedule in enumerate(curriculum[:-1]):
            due = F.when(F.col("place") % len(curriculum) == j, when_due(share_, schedule)).otherwise(due)
        return F.struct(F.lit(i).alias("pass"), taken.alias("taken"), due.alias("position"))

    some = F.filter(F.array(*map(one, range(most))), lambda p: p["taken"] > 0)
    about = ["id", "source", "size", "source_size", "target", "draw"]
    takings = laid.select(F.col("_row").alias("row"), *about, F.explode_outer(some).alias("p")).select("row", *about, F.col("p.pass").alias("pass"), F.coalesce("p.taken", F.lit(0)).alias("taken"), "p.position", F.lit("").alias("all"))
    order = [F.col("position").asc_nulls_last(), "source", "draw", F.col("id").asc_nulls_first(), "size", "pass"]
    sorted_ = ranged(takings, ["all"], order)
    within = Window.partitionBy("_range").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sorted_.withColumn("_ahead", F.coalesce(F.sum("taken").over(within), F.lit(0))).join(before(sorted_, ["all"], "taken").drop("all"), "_range")
    start = F.when(F.col("pass").isNotNull(), F.col("_before") + F.col("_ahead"))
    discard(rows)
    return ahead.select("row", F.col("id").alias(id_col), F.when(F.col("source") != "=", F.substring("source", 2, 1 << 30)).alias("source"), "size", "source_size", "target", "pass", "taken", "position", start.alias("start"))


def by_document(mix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, size, source_size, target, taken, first_start, last_start) for each document of a mix."""
    return mix.groupBy("row", id_col, "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.min("start").alias("first_start"), F.max("start").alias("last_start")).drop("row")
