"""Keyed joins, overlays and set operations with explicit duplicate and missing-side rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(order: Sequence[str | Column]) -> Column:
    """A struct that compares by the order's columns, a null before everything."""
    parts = [F.col(o) if isinstance(o, str) else o for o in order]
    return F.struct(*(x for i, p in enumerate(parts) for x in (p.isNotNull().alias(f"h{i}"), p.alias(f"o{i}"))))


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the last in the order, which should be total. Aggregated before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), _order(order)).alias("_row")).select("_row.*")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct("*"), _order(order)).alias("_row")).select("_row.*")


def looked_up(side: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None) -> DataFrame:
    """A lookup side with one row for each key: the last in the order, by default that of all its other columns.

    None takes the keys as unique, which the caller vouches for.
    """
    if order is None:
        return side
    others = [c for c in side.columns if c not in keys]
    return last_wins(side, keys, order or others) if order or others else side.distinct()


def left_default(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: Mapping[str, object], order: Sequence[str | Column] | None = ()) -> DataFrame:
    """Left join where a default fills in only what had no match; of rows with one key the last counts (see looked_up).

    A matched row's null stays null. defaults names the right side's columns to take.
    """
    side = looked_up(right, keys, order).select(*keys, *(F.col(c).alias(f"_r_{c}") for c in defaults), F.lit(True).alias("_matched"))
    joined = left.join(side, list(keys), "left")
    return joined.select(*left.columns, *(F.when(F.col("_matched"), F.col(f"_r_{c}")).otherwise(F.lit(v).cast(right.schema[c].dataType)).alias(c) for c, v in defaults.items()))


def match_split(rows: DataFrame, truth: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with their truth, rows without any); of truths with one key the last counts (see looked_up)."""
    return rows.join(looked_up(truth, keys, order), list(keys)), rows.join(truth.select(*keys), list(keys), "left_anti")


def require_match(rows: DataFrame, truth: DataFrame, keys: Sequence[str], what: str = "row", order: Sequence[str | Column] | None = ()) -> DataFrame:
    """Inner join that fails when the job meets a row without a match; of truths with one key the last counts (see looked_up)."""
    side = looked_up(truth, keys, order).withColumn("_matched", F.lit(True))
    joined = rows.join(side, list(keys), "left")
    text = F.concat(F.lit(f"no match for {what}: "), F.to_json(F.struct(*(F.col(k) for k in keys))))
    return joined.where(_held(F.col("_matched"), text)).drop("_matched")


def _held(good: Column, text: Column) -> Column:
    """A condition that is true or fails the job. A filter isn't pruned, as an unused column is.

    rand() keeps the optimizer from working the condition out for missing rows beforehand.
    """
    return F.when(F.coalesce(good, F.lit(False)) & (F.rand() >= 0), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))


def overlay(tables: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Union in which a later table's row replaces an earlier one's; in a table the last in the order wins."""
    union = tables[0].withColumn("_table", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        union = union.unionByName(t.withColumn("_table", F.lit(i)), allowMissingColumns=True)
    return last_wins(union, keys, ["_table", *order]).drop("_table")


def upsert(memory: DataFrame, events: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The memory with events put in by key: an event replaces what has its key."""
    return overlay([memory, events], keys, order)


def replaced(rows: DataFrame, retries: DataFrame, keys: Sequence[str], good: Column, order: Sequence[str | Column] | None = ()) -> DataFrame:
    """Rows whose key has a good retry become that retry, the last of them, as a whole. Retries have the rows' columns."""
    new = looked_up(retries.where(good), keys, order).select(*keys, F.struct(*rows.columns).alias("_new"))
    joined = rows.select(*keys, F.struct(*rows.columns).alias("_old")).join(new, list(keys), "left")
    return joined.select(F.coalesce("_new", "_old").alias("_row")).select("_row.*")


def present_override(base: DataFrame, over: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = ()) -> DataFrame:
    """Left join where a matched row's shared columns come from `over`, nulls included; of its rows with one key from the last."""
    shared = [c for c in over.columns if c not in keys]
    side = looked_up(over, keys, order).select(*keys, F.struct(*shared).alias("_over"))
    joined = base.join(side, list(keys), "left")
    own = [F.when(F.col("_over").isNotNull(), F.col("_over")[c]).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in base.columns]
    return joined.select(*own, *(F.col("_over")[c].alias(c) for c in shared if c not in base.columns))


def spine(records: DataFrame, variants: DataFrame, facts: DataFrame, keys: Sequence[str], most: int = 10_000) -> DataFrame:
    """Every record with every variant, and what facts say about the pair.

    Variants are a short list given by hand: more than `most` are refused, as the product
    would not be meant.
    """
    n = variants.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} variants")
    return records.crossJoin(F.broadcast(variants)).join(facts, list(keys), "left")


def difference(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that are expected and not there."""
    return expected.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")


def existing(rows: DataFrame, there: DataFrame, keys: Sequence[str], flag: str = "exists") -> DataFrame:
    """Adds whether the key is in the other table."""
    side = there.select(*keys).distinct().withColumn(flag, F.lit(True))
    return rows.join(side, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def form_update(truth: DataFrame, form: DataFrame, key: str, updates: Mapping[str, Column]) -> DataFrame:
    """Truth changed by a form that must have the same keys: a key on one side alone fails the job.

    updates: new values, from columns of both sides (the form's with the prefix form_).
    """
    right = form.select(*(F.col(c).alias(c if c == key else f"form_{c}") for c in form.columns)).withColumn("_f", F.lit(True))
    joined = truth.withColumn("_t", F.lit(True)).join(right, key, "full_outer")
    text = F.concat(F.when(F.col("_t").isNull(), "unknown in form: ").otherwise("missing in form: "), F.col(key).cast("string"))
    checked = joined.where(_held(F.col("_t") & F.col("_f"), text))
    return checked.select(key, *(updates.get(c, F.col(c)).alias(c) for c in truth.columns if c != key))


def union_scopes(**scopes: DataFrame) -> DataFrame:
    """Union of tables under the name of their scope."""
    out = None
    for name, rows in scopes.items():
        part = rows.withColumn("scope", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no scope")
    return out


def unnested(rows: DataFrame, column: str, alias: str, *, keep_empty: bool = False) -> DataFrame:
    """A row for each item; with keep_empty one row with a null where there is none."""
    explode = F.explode_outer if keep_empty else F.explode
    return rows.select(*(c for c in rows.columns if c != column), explode(column).alias(alias))


def same_count_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join of two tables that must hold the same keys, once each: what zipping them by position meant."""
    sizes = left.agg(F.count("*"), F.countDistinct(key)).first(), right.agg(F.count("*"), F.countDistinct(key)).first()
    if len({*sizes[0], *sizes[1]}) > 1:
        raise ValueError(f"the tables don't hold the same keys once each: {tuple(sizes[0])} and {tuple(sizes[1])}")
    return require_match(left, right, [key], order=None)


def from_sources(rows: DataFrame, key: str, source: str, prefix: str = "source_") -> DataFrame:
    """Rows that are made from others of the table, with those others' columns; a source that isn't there is null.

    Of rows with one key the last by all their columns is the source.
    """
    others = looked_up(rows, [key], ()).select(F.col(key).alias(source), *(F.col(c).alias(prefix + c) for c in rows.columns if c not in (key, source)))
    return rows.where(F.coalesce(F.col(source), F.lit("")) != "").where(F.col(source) != F.col(key)).join(others, source, "left").select(*rows.columns, *(c for c in others.columns if c != source))


def nested_index(rows: DataFrame, outer: str, inner: str, order: Sequence[str | Column] = ()) -> DataFrame:
    """(outer, a map from inner to the row): an index of two levels; of rows with both keys alike the last counts.

    A map holds what one outer key has, so inner keys should be few.
    """
    once = looked_up(rows, [outer, inner], order)
    value = F.struct(*(c for c in rows.columns if c not in (outer, inner)))
    return once.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner), value.alias("row"))))).alias("index"))


def last_in_first_place(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """The last row of each key, with its first row's place in the order: what replacing in a list leaves.

    Places are the first order column's values; sort by them.
    """
    first = F.min(F.col(order[0]) if isinstance(order[0], str) else order[0]).alias(name)
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), _order(order)).alias("_row"), first).select("_row.*", name)
