"""Ranking, choosing, sampling and ordering."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top1_with_rejects(rows: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """Adds candidate_rank, selected and margin: the lead over the next best, null for the last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    rank = F.row_number().over(w)
    return rows.select("*", rank.alias("candidate_rank"), (rank == 1).alias("selected"), (F.col(score) - F.lead(score).over(w)).alias("margin"))


def top_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key; Spark drops the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def ambiguity(rows: DataFrame, keys: Sequence[str], side: str, score: str, near: float = 0.82, of: int = 3) -> DataFrame:
    """Adds ambiguity_score: candidates of another side that come near the row's score, over `of`, at most 1.

    near: the share of the row's score that counts as near. As more than `of` rivals count no
    more, the best `of` of each side are all that a row is held against: a key's sides are few.
    """
    best = top_n(rows.select(*keys, side, score), [*keys, side], [F.desc(score)], of)
    held = best.groupBy(*keys).agg(F.collect_list(F.struct(F.col(side).alias("side"), F.col(score).alias("score"))).alias("_best"))
    rivals = F.size(F.filter(F.col("_best"), lambda c: (c["side"] != F.col(side)) & (c["score"] >= near * F.col(score))))
    return rows.join(held, list(keys), "left").withColumn("ambiguity_score", F.least(rivals / of, F.lit(1.0))).select(*rows.columns, "ambiguity_score")


def duplicates(rows: DataFrame, keys: Sequence[str], flag: str = "is_duplicate") -> DataFrame:
    """Adds whether another row has the same keys; an empty or null key is nobody's duplicate.

    Counted by aggregation and joined, so that a frequent key is no task of its own.
    """
    filled = F.lit(True)
    for k in keys:
        filled &= F.coalesce(F.col(k).cast("string"), F.lit("")) != ""
    often = rows.where(filled).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias(flag))
    return rows.join(often, list(keys), "left").select(*rows.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def duplicate_groups(rows: DataFrame, name: str, route: str, human: str) -> DataFrame:
    """Sends every row whose name others have too to a human; adds a group number by name, from 1."""
    found = rows.where(F.coalesce(F.col(name), F.lit("")) != "").groupBy(name).agg(F.count("*").alias("_n")).where("_n > 1")
    groups = numbered(found.select(name), [name], "_group").select(name, F.col("_group").cast("int").alias("duplicate_group"))
    joined = rows.join(groups, name, "left")
    return joined.select(*(F.when(F.col("duplicate_group").isNotNull(), F.lit(human)).otherwise(F.col(c)).alias(c) if c == route else F.col(c) for c in rows.columns), "duplicate_group")


def stratified(rows: DataFrame, stratum: str, sizes: Mapping[str, int], key: Column, *, strict: bool = True) -> DataFrame:
    """A fixed number of rows of each stratum, the first by the md5 of seed and key: the same in any engine.

    With strict a stratum that has too few fails.
    """
    want = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))))
    chosen = rows.where(F.col(stratum).isin(*sizes)).withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(key), key)))
    # The largest size as a number of its own, by which Spark drops most rows before the shuffle.
    chosen = chosen.where(F.col("_n") <= max(sizes.values(), default=0)).where(F.col("_n") <= F.element_at(want, F.col(stratum))).drop("_n")
    if strict:
        have = {r[stratum]: r["count"] for r in chosen.groupBy(stratum).count().collect()}  # one row a stratum
        short = {k: (have.get(k, 0), v) for k, v in sizes.items() if have.get(k, 0) < v}
        if short:
            raise ValueError(f"too few rows: {short}")
    return chosen


def forced_first(rows: DataFrame, forced: Column, score: Column, key: str, count: int) -> DataFrame:
    """`count` rows: the forced ones, then the best by score."""
    return rows.orderBy(F.desc(forced.cast("int")), F.desc(score), key).limit(count)


def round_robin(rows: DataFrame, group: str, order: Sequence[str | Column], groups: Sequence[str], count: int, tier: Column | None = None) -> DataFrame:
    """`count` rows, one of each group in turn, groups in the given order; a lower tier goes before all."""
    place = F.array_position(F.array(*map(F.lit, groups)), F.col(group))
    turn = F.row_number().over(Window.partitionBy("_tier", group).orderBy(*order))
    dealt = rows.withColumn("_tier", tier if tier is not None else F.lit(0)).where(F.col(group).isin(*groups)).withColumn("_turn", turn)
    return dealt.where(F.col("_turn") <= count).orderBy("_tier", "_turn", place, *order).limit(count).drop("_tier", "_turn")


def capped_mix(rows: DataFrame, dataset: str, caps: Mapping[str, int | None], order: Sequence[str], overall: int) -> DataFrame:
    """At most a number of rows from each dataset (None: all), datasets in the caps' order, `overall` in all."""
    names = list(caps)
    place = F.array_position(F.array(*map(F.lit, names)), F.col(dataset))
    cap = F.element_at(F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(overall if v is None else min(v, overall))))), F.col(dataset))
    numbered = rows.where(F.col(dataset).isin(*names)).withColumn("_n", F.row_number().over(Window.partitionBy(dataset).orderBy(*order)))
    return numbered.where(F.col("_n") <= overall).where(F.col("_n") <= cap).orderBy(place, "_n").limit(overall).drop("_n")


def error_first(rows: DataFrame, page: str, primary: Column, verdict: str, correct: str, order: Sequence[str], limit: int = 0) -> DataFrame:
    """Pages where the primary model was found wrong, the last finding of each, by page; limit 0 takes all."""
    from vellumen.operators.relate import last_wins

    wrong = rows.where(primary & (F.trim(F.coalesce(verdict, F.lit(""))) != "") & (F.trim(verdict) != correct))
    out = last_wins(wrong, [page], order).orderBy(page)
    return out.limit(limit) if limit > 0 else out


def failures_and_controls(rows: DataFrame, accepted: Column, controls: int, order: Sequence[str], key: Sequence[str]) -> DataFrame:
    """All keys that were not accepted once, and the first `controls` of the others: the first row of each in the order.

    A control that is a failure too takes a control's place and is left out. The order should be total.
    """
    from vellumen.operators.relate import first_wins

    keyed = rows.withColumn("_ok", F.coalesce(accepted, F.lit(False)))
    failures = first_wins(keyed.where("NOT _ok"), key, order)
    control = keyed.where("_ok").orderBy(*order).limit(controls)
    control = first_wins(control, key, order).join(failures.select(*key), list(key), "left_anti")
    return failures.withColumn("case_kind", F.lit("failure")).unionByName(control.withColumn("case_kind", F.lit("positive_control"))).drop("_ok")


def by_membership(sample: Column, members: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """A split by lists of samples: the first list that has the sample."""
    out = F.lit(otherwise)
    for name, names in reversed(list(members.items())):
        out = F.when(sample.isin(*names), F.lit(name)).otherwise(out)
    return out


def special_first(sample: Column, special: Mapping[str, str], split: Column) -> Column:
    """A split, but for samples that have one of their own."""
    from vellumen.functions.text import lookup

    return F.coalesce(lookup(sample, special), split) if special else split


def hard_cases(rows: DataFrame, sample: str, samples: Sequence[str], routes: str, route: str = "retrain_candidate") -> DataFrame:
    """Rows whose sample is listed, or that go a route."""
    return rows.where(F.col(sample).isin(*samples) | F.coalesce(F.array_contains(routes, route), F.lit(False)))


def flagged(rows: DataFrame, verdict: str, correct: str = "正确") -> DataFrame:
    """Rows on which a person said anything but that they are right."""
    from vellumen.functions.text import stripped

    said = stripped(F.coalesce(F.col(verdict), F.lit("")))
    return rows.where((said != "") & (said != correct))


def best_items(items: Column, field: str, n: int = 12) -> Column:
    """The n structs of an array with the largest field, falling; equals as they stand."""
    placed = F.transform(items, lambda x, i: F.struct((-x[field]).alias("fall"), i.alias("place"), x.alias("item")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda p: p["item"])


def split_by_digit(number: Column, rules: Mapping[int, str], otherwise: str) -> Column:
    """A split by a number's last digit."""
    digit = F.pmod(number, F.lit(10))
    out = F.lit(otherwise)
    for d, name in rules.items():
        out = F.when(digit == d, F.lit(name)).otherwise(out)
    return out


def kept(rows: DataFrame) -> DataFrame:
    """Rows that are worked out once, whoever reads them, and though executors be lost.

    Written below the session's checkpoint folder; a session without one, as in tests, keeps
    them in Spark's own storage.
    """
    from pyspark import StorageLevel

    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir() and (named := rows.sparkSession.conf.get("spark.checkpoint.dir", None)):
        sc.setCheckpointDir(named)
    return rows.checkpoint() if sc.getCheckpointDir() else rows.persist(StorageLevel.DISK_ONLY)


#: Rows of a range, about, and at least where there are fewer ranges than shuffle partitions.
RANGE, FEW = 200_000, 1000


def settled(rows: DataFrame) -> DataFrame:
    """Rows that may be read several times: as they are if that is a reading of files, else kept."""
    todo = [rows._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in ("Project", "Filter", "LogicalRelation", "Relation", "LocalRelation"):
            return kept(rows)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def in_ranges(rows: DataFrame, order: Sequence[str | Column], per_range: int | None = None) -> DataFrame:
    """The rows, dealt into ranges of the order and kept; adds _range, the number of the range.

    As many ranges as the number of rows needs; up to the number of shuffle partitions if none gets too few.
    """
    rows = settled(rows)
    n = rows.count()
    parts = max(1, -(-n // (per_range or RANGE)), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // FEW)))
    return kept(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "sequence_number") -> DataFrame:
    """Adds a number from 1 in the order, without gathering the table in a task.

    Rows are dealt into ranges of the order; counts of the ranges before are added to the
    number within the range.
    """
    ranged = in_ranges(rows, order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_at", within).join(counts, "_range").select(*rows.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))


def carried(ranged: DataFrame, keys: Sequence[str], value: Column, merge: Callable[[Column], Column], name: str) -> DataFrame:
    """Adds what the ranges before a row's range have for its keys: value, an aggregate a range, merged along the ranges; null if none do.

    A key has as many rows in between as it has ranges. Null keys are keys.
    """
    parts = ranged.groupBy(*keys, "_range").agg(value.alias("_part"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select(*(F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)), F.col("_range").alias("_of"), merge(F.col("_part")).over(earlier).alias(name))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_c{i}"))
    return ranged.join(sums, same).drop("_of", *(f"_c{i}" for i in range(len(keys))))


def numbered_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "sequence_number") -> DataFrame:
    """Adds a number from 1 along the order among the rows of the same keys, whatever share of the rows they are."""
    ranged = carried(in_ranges(rows, [*keys, *order]), keys, F.count("*"), F.sum, "_before")
    at = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return ranged.withColumn("_at", at).select(*rows.columns, (F.coalesce("_before", F.lit(0)) + F.col("_at")).cast("long").alias(name))


def islands(rows: DataFrame, keys: Sequence[str], start: str, end: str, gap: float) -> DataFrame:
    """Intervals of a key, joined where the next begins at most `gap` after all before have ended.

    Rows are dealt into ranges by key and start. How far a key has come, and its number of
    islands, are carried on from the ranges before, so a key may have any share of the rows.
    """
    ranged = carried(in_ranges(rows, [*keys, start, end]), keys, F.max(end), F.max, "_reached")
    w = Window.partitionBy(*keys, "_range").orderBy(start, end)
    before = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reached"))
    opened = ranged.withColumn("_last", before).withColumn("_new", F.when(F.col("_last").isNull() | (F.col(start) - F.col("_last") > gap), 1).otherwise(0)).drop("_reached", "_last")
    counted = carried(kept(opened), keys, F.sum("_new"), F.sum, "_islands")
    own = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered_ = counted.withColumn("island", own + F.coalesce("_islands", F.lit(0)))
    return numbered_.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_rows"))


def projection_islands(profile: Column, threshold: float, gap: int) -> Column:
    """Stretches of a 1-D profile at or above a threshold, joined over gaps of at most `gap`: array of (start, end), end excluded."""
    points = F.filter(F.transform(profile, lambda x, i: F.when(x >= threshold, i)), lambda i: i.isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, i: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = (F.size(done) > 0) & (i - last["end"] <= gap)
        new = F.struct(F.when(joined, last["start"]).otherwise(i).alias("start"), (i + 1).alias("end"))
        return F.concat(F.when(joined, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done), F.array(new))

    return F.aggregate(points, empty, add)


def moving_average(value: str, keys: Sequence[str], order: Sequence[str], width: int) -> Column:
    """Mean over `width` rows centred on each, what lies outside counting as zero: the divisor is always the width."""
    before = (width - 1) // 2
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width - 1 - before), before)
    return F.sum(value).over(w) / width


#: Rows of a key that are smoothed in one task, about.
BLOCK = 50_000


def smoothed(rows: DataFrame, value: str, keys: Sequence[str], order: Sequence[str | Column], width: int, name: str) -> DataFrame:
    """Adds moving_average() along the order, for keys of any size.

    A key's rows are numbered and cut into blocks; rows near an end go to the block beside it too,
    where they are neighbours only. The order must tell rows of a key apart.
    """
    before = (width - 1) // 2
    after = width - 1 - before
    block = max(BLOCK, width)
    at = F.col("_at")
    placed = numbered_within(rows, keys, order, "_at").withColumn("_home", F.floor(at / block))
    blocks = F.array_distinct(F.array(F.col("_home"), F.floor((at - before) / block), F.floor((at + after) / block)))
    near = placed.withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(-after, before)
    return near.withColumn(name, F.sum(value).over(w) / width).where("_block = _home").select(*rows.columns, name)


def by_priority(rows: DataFrame, tiers: Sequence[Column], then: Sequence[str | Column]) -> DataFrame:
    """Rows by the first tier they meet, then by the given order; adds priority from 1."""
    priority = F.lit(len(tiers) + 1)
    for i, t in reversed(list(enumerate(tiers, 1))):
        priority = F.when(t, F.lit(i)).otherwise(priority)
    return rows.withColumn("priority", priority).orderBy("priority", *then)


def near_boxes(rows: DataFrame, keys: Sequence[str], corners: Sequence[str], order: Sequence[str], cell: int = 8) -> DataFrame:
    """One of the boxes whose corners fall in the same cells: the last in the order."""
    from vellumen.operators.relate import last_wins

    cells = [f"_cell{i}" for i in range(len(corners))]
    gridded = rows.select("*", *(F.floor(F.col(c) / cell).alias(n) for c, n in zip(corners, cells, strict=True)))
    return last_wins(gridded, [*keys, *cells], order).drop(*cells)
