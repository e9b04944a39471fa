"""Counts, accuracies, votes, comparisons, leakage and rule mining."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumen.operators.rank import numbered


def rate(hits: Column, total: Column, on_empty: float | None = None, digits: int | None = None) -> Column:
    """hits / total, with an explicit value for an empty total. Rounding is half to even."""
    share = F.when(total == 0, F.lit(on_empty).cast("double")).otherwise(hits.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)))
    return share if digits is None else F.bround(share, digits)


def counter(rows: DataFrame, column: str, *, by_count: bool = False) -> DataFrame:
    """(value, n), by value or by falling count and value."""
    out = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value") if by_count else out.orderBy("value")


def counters(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimension, value, n) of several columns in one pass over the rows; an array counts by item."""
    parts = []
    for c in columns:
        value = F.col(c) if dict(rows.dtypes)[c].startswith("array") else F.array(F.col(c))
        parts.append(F.transform(value.cast("array<string>"), _labelled(c)))
    pairs = rows.select(F.explode(F.concat(*parts)).alias("p"))
    return pairs.groupBy(F.col("p.dimension").alias("dimension"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


def _labelled(name: str):
    return lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value"))


def layers(rows: DataFrame, labels: str, sample: str) -> DataFrame:
    """(layer, n, samples) of a multi-valued label; samples in order."""
    spread = rows.select(F.explode(labels).alias("layer"), sample)
    return spread.groupBy("layer").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(sample)).alias("samples"))


def accuracy_ids(rows: DataFrame, correct: Column, review: Column, key: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, kind, id) of the rows that are wrong (error) and those to review (review), at any number of rows."""
    kinds = F.filter(F.array(F.when(~F.coalesce(correct, F.lit(False)), F.lit("error")), F.when(F.coalesce(review, F.lit(False)), F.lit("review"))), lambda k: k.isNotNull())
    return rows.select(*groups, F.explode(kinds).alias("kind"), F.col(key).alias("id"))


def accuracy_summary(rows: DataFrame, correct: Column, confidence: str, review: Column, key: str, groups: Sequence[str] = (), lists: bool = True) -> DataFrame:
    """Total, correct, errors, accuracy (0.0 if empty), confidence range and mean, and ids of errors and reviews.

    The ids of a group are one value: for tables of pages. Without lists they are left out;
    accuracy_ids() gives them as rows.
    """
    good = F.coalesce(correct, F.lit(False))
    told = F.coalesce(review, F.lit(False))
    n, hits = F.count("*"), F.count_if(good)
    return rows.groupBy(*groups).agg(
        n.alias("total"),
        hits.alias("correct"),
        (n - hits).alias("errors"),
        rate(hits, n, 0.0).alias("accuracy"),
        F.min(confidence).alias("min_confidence"),
        F.max(confidence).alias("max_confidence"),
        F.avg(confidence).alias("avg_confidence"),
        *((F.array_sort(F.collect_list(F.when(~good, F.col(key)))).alias("error_ids"), F.array_sort(F.collect_list(F.when(told, F.col(key)))).alias("review_ids")) if lists else ()),
    )


def combined_accuracy(rows: DataFrame, dataset: str, correct: Column, confidence: str, review: Column) -> DataFrame:
    """Accuracy by dataset and over all: a ratio of sums, with the whole range of confidence."""
    good, told = F.coalesce(correct, F.lit(False)), F.coalesce(review, F.lit(False))
    n, hits = F.count("*"), F.count_if(good)
    out = rows.rollup(dataset).agg(F.grouping(dataset).alias("_all"), n.alias("total"), hits.alias("correct"), (n - hits).alias("errors"), rate(hits, n, 0.0).alias("accuracy"), F.count_if(told).alias("review_count"), F.min(confidence).alias("min_confidence"), F.max(confidence).alias("max_confidence"))
    return out.withColumn(dataset, F.when(F.col("_all") == 1, "combined").otherwise(F.col(dataset))).drop("_all")


def grouped_accuracy(rows: DataFrame, column: str, correct: Column) -> DataFrame:
    """(value, total, correct, accuracy) by a column as text."""
    n, hits = F.count("*"), F.count_if(F.coalesce(correct, F.lit(False)))
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(n.alias("total"), hits.alias("correct"), rate(hits, n).alias("accuracy"))


def evaluation_summary(rows: DataFrame, sample: str, tests: Mapping[str, Column]) -> DataFrame:
    """Counts, distinct samples and, for each test, hits, accuracy and distinct failing samples, in one pass."""
    n = F.count("*")
    parts = [n.alias("record_count"), F.countDistinct(sample).alias("sample_count")]
    for name, passed in tests.items():
        ok = F.coalesce(passed, F.lit(False))
        parts += [F.count_if(ok).alias(f"{name}_correct"), rate(F.count_if(ok), n).alias(f"{name}_accuracy"), F.array_sort(F.collect_set(F.when(~ok, F.col(sample)))).alias(f"{name}_error_samples")]
    return rows.agg(*parts)


def gates(summary: DataFrame, **rules: Column) -> DataFrame:
    """Adds booleans for the rules, and whether all hold."""
    out = summary.select("*", *(F.coalesce(r, F.lit(False)).alias(k) for k, r in rules.items()))
    passed = F.lit(True)
    for k in rules:
        passed &= F.col(k)
    return out.withColumn("passed", passed)


def model_accuracy(rows: DataFrame, model: str, verdict: str, *, reviewed_only: bool, correct: str = "correct", digits: int | None = None, risky: Column | None = None) -> DataFrame:
    """Accuracy of each model over reviewed rows, or over all with blanks as misses; none over nothing.

    A blank verdict is null or empty. risky: rows that don't count.
    """
    rows = rows if risky is None else rows.where(~F.coalesce(risky, F.lit(False)))
    filled = F.coalesce(F.trim(F.col(verdict)), F.lit("")) != ""
    hits, seen, n = F.count_if(filled & (F.trim(verdict) == correct)), F.count_if(filled), F.count("*")
    return rows.groupBy(model).agg(n.alias("total"), seen.alias("reviewed"), hits.alias("correct"), (seen - hits).alias("wrong"), (n - seen).alias("blank"), rate(hits, seen if reviewed_only else n, digits=digits).alias("accuracy"))


def model_ranking(rows: DataFrame, model: str, page: str, verdict: str, correct: str = "correct") -> DataFrame:
    """model_accuracy() over all rows with the pages that are wrong and blank, sorted, and a rank.

    Models rank by accuracy, then by correct rows, both falling, then by falling name. A
    model's pages are one value: for tables of pages.
    """
    said = F.coalesce(F.trim(F.col(verdict)), F.lit(""))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(page))))
    pages = rows.groupBy(model).agg(listed((said != "") & (said != correct)).alias("wrong_pages"), listed(said == "").alias("blank_pages"))
    out = model_accuracy(rows, model, verdict, reviewed_only=False, correct=correct).join(pages, model)
    return numbered(out, [F.desc_nulls_last("accuracy"), F.desc("correct"), F.desc(model)], "rank")


def majority_vote(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of a key; of equals, the one that came first, and then the lesser. needs_check: values differ."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(
        F.min_by(F.struct(value, "votes"), F.struct(-F.col("votes"), F.col("_first"), F.col(value))).alias("_w"),
        F.count("*").alias("distinct_values"),
        F.sum("votes").alias("total_votes"),
    ).select(*keys, F.col("_w")[value].alias(value), F.col("_w")["votes"].alias("votes"), "total_votes", "distinct_values", (F.col("distinct_values") > 1).alias("needs_check"))


def compare_models(rows: DataFrame, keys: Sequence[str], model: str, models: Sequence[str], review: str, compared: Sequence[str]) -> DataFrame:
    """For each key: models that are missing, whether any asks for review, and whether answers differ.

    A null answer is an answer like others, so it conflicts with any other.
    """
    have = F.collect_set(model)
    names = F.array(*map(F.lit, models))
    out = rows.where(F.col(model).isin(*models)).groupBy(*keys).agg(
        have.alias("_have"),
        F.max(F.coalesce(F.col(review), F.lit(False))).alias("any_needs_review"),
        *((F.countDistinct(F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())) > 1).alias(f"{c}_conflict") for c in compared),
    )
    conflict = F.col("any_needs_review") | (F.size(F.array_except(names, F.col("_have"))) > 0)
    for c in compared:
        conflict |= F.col(f"{c}_conflict")
    return out.select(*keys, F.array_except(names, F.col("_have")).alias("missing_models"), "any_needs_review", *(f"{c}_conflict" for c in compared), conflict.alias("needs_attention"))


def page_pivot(rows: DataFrame, keys: Sequence[str], model: str, value: str, order: Sequence[str], attention: Column | None = None) -> DataFrame:
    """A map from model to its last value, for each key; with a condition also needs_attention: it holds for any of those rows."""
    from vellumen.operators.relate import last_wins

    last = last_wins(rows, [*keys, model], order)
    told = [] if attention is None else [F.bool_or(F.coalesce(attention, F.lit(False))).alias("needs_attention")]
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(model, value)))).alias("values"), *told)


def leakage(rows: DataFrame, source: str, split: str, *, ignore_blank: bool) -> DataFrame:
    """(source, splits) of sources that are in more than one split."""
    used = rows.where(F.coalesce(F.trim(F.col(split)), F.lit("")) != "") if ignore_blank else rows
    value = F.coalesce(F.col(split), F.lit(""))
    return used.groupBy(source).agg(F.array_sort(F.collect_set(value)).alias("splits")).where(F.size("splits") > 1)


def issues(**checks: DataFrame) -> DataFrame:
    """Union of (severity, code, item) rows: a check is named severity__code and has one column."""
    out = None
    for name, found in checks.items():
        severity, code = name.split("__", 1)
        part = found.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(found.columns[0]).cast("string").alias("item"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no check")
    return out


def completeness(form: DataFrame, machine: DataFrame, key: str) -> DataFrame:
    """Issues of a form held against the machine's rows: repeated, unknown and missing keys."""
    keys = form.groupBy(key).agg(F.count("*").alias("n"))
    return issues(
        error__duplicate=keys.where("n > 1").select(key),
        error__unknown=keys.select(key).join(machine.select(key), key, "left_anti"),
        error__missing=machine.select(key).distinct().join(keys.select(key), key, "left_anti"),
    )


def mined_rules(rows: DataFrame, value: str, *, support: int, share: float = 0.0, total: int | None = None, prefix: str = "rule") -> DataFrame:
    """Values seen at least `support` times and in at least `share` of the rows, with ids by falling count."""
    found = rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("support"))
    n = F.lit(total) if total is not None else F.col("_total")
    if total is None:
        found = found.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_total"))))  # one row
    kept = found.where((F.col("support") >= support) & (F.col("support") >= share * n)).select("value", "support")
    return numbered(kept, [F.desc("support"), "value"], "_n").select(F.format_string(f"{prefix}_%03d", "_n").alias("rule_id"), "value", "support")


def run_summary(**tables: tuple[DataFrame, Mapping[str, Column]]) -> DataFrame:
    """One row of conditional counts over several tables, a pass over each."""
    out = None
    for rows, counts in tables.values():
        part = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()))
        out = part if out is None else out.crossJoin(F.broadcast(part))  # one row each
    if out is None:
        raise ValueError("no table")
    return out


def truth_status(rows: DataFrame, truth: DataFrame, keys: Sequence[str], answer: str, expected: str) -> DataFrame:
    """Rows with match, mismatch or missing against an earlier truth; of truths with one key the largest counts."""
    from vellumen.operators.relate import looked_up

    side = looked_up(truth.select(*keys, F.col(expected).alias("_expected"), F.lit(True).alias("_there")), keys, ["_expected"])
    joined = rows.join(side, list(keys), "left")
    status = F.when(F.col("_there").isNull() | F.col("_expected").isNull(), "missing").when(F.col(answer).eqNullSafe(F.col("_expected")), "match").otherwise("mismatch")
    return joined.select(*rows.columns, status.alias("truth_status"))


def bucketed(rows: DataFrame, value: Column, edges: Sequence[tuple[str, Column]], otherwise: str) -> DataFrame:
    """(bucket, n) by the first condition that a row meets."""
    out = F.lit(otherwise)
    for name, condition in reversed(list(edges)):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return rows.where(value.isNotNull()).groupBy(out.alias("bucket")).agg(F.count("*").alias("n"))


def ratio_summary(rows: DataFrame, value: str, guard: str) -> DataFrame:
    """Mean, least and largest of a ratio, rounded half to even, and counts of guard states."""
    stats = rows.agg(*(F.bround(f(value), 6).alias(f"{n}_{value}") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))
    held = rows.groupBy().agg(F.count_if(F.col(guard)).alias("guarded"), F.count_if(~F.col(guard)).alias("unguarded"))
    return stats.crossJoin(F.broadcast(held))  # one row each
