"""A Merkle manifest of a table: trees of digests a language, a tree over their roots, and proofs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumen.llm.common import materialize
from vellumen.llm.order import numbered

#: Levels that one round builds; a block has 2 ** STEP nodes.
STEP = 6
#: Columns of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

SIBLING = "array<struct<left:boolean,digest:binary>>"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """A value with its length, so that no two rows read alike; a null is a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def parent(left: Column, right: Column) -> Column:
    """The digest over two nodes, or over one where the other is null."""
    return F.unhex(F.sha2(F.concat(F.coalesce(hexed(left), F.lit("")), F.coalesce(hexed(right), F.lit(""))), 256))


def halved(nodes: Column) -> Column:
    """The level above a level; a last node that has no neighbour is digested alone."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda j: parent(F.get(nodes, 2 * j), F.get(nodes, 2 * j + 1)))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree over n of them."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def placed(nodes: Column, level: int, first: Column) -> Column:
    """Nodes of a level with their coordinates; none where there is no such level."""
    return F.transform(F.coalesce(nodes, F.array().cast("array<binary>")), lambda x, j: F.struct(F.lit(level).alias("level"), (first + j).alias("at"), x.alias("digest")))


def tree(leaves: DataFrame, step: int = STEP) -> list[DataFrame]:
    """The materialised nodes (group, n, level, at, digest), a table for each `step` levels.

    leaves: (group, n, at, digest). A round puts runs of 2 ** step nodes together, builds the
    levels above them, and hands the last on: each table but the first is 2 ** step times smaller.
    """
    out, low = [], 0
    base = leaves.select("group", "n", F.lit(0).alias("level"), "at", "digest")
    top = base.agg(F.max(height(F.col("n")))).first()[0]
    while True:
        nodes = F.sort_array(F.collect_list(F.struct("at", "digest")))
        blocks = base.groupBy("group", "n", F.shiftright("at", step).alias("block")).agg(nodes.alias("nodes"))
        blocks = blocks.withColumn("level0", F.transform("nodes", lambda x: x["digest"]))
        for i in range(step):
            blocks = blocks.withColumn(f"level{i + 1}", F.when(height(F.col("n")) > low + i, halved(F.col(f"level{i}"))))
        every = F.flatten(F.array(*(placed(F.col(f"level{i}"), low + i, F.shiftleft("block", step - i)) for i in range(step + 1))))
        out.append(materialize(blocks.select("group", "n", F.inline(every))))
        if top is None or top <= low + step:
            return out
        low += step
        base = out[-1].where((F.col("level") == low) & (height(F.col("n")) > low))


def roots(tables: list[DataFrame], step: int = STEP) -> DataFrame:
    """(group, n, digest): the top of each tree."""
    tops = [t.where((F.col("level") == height(F.col("n"))) & ((F.col("level") > i * step) | F.lit(i == 0))) for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, tops).select("group", "n", "digest")


def proofs(leaves: DataFrame, tables: list[DataFrame], above: DataFrame, step: int = STEP) -> DataFrame:
    """Leaves (group, n, at and more) with path, the siblings from the leaf up to the root and on along `above`, and about.

    above: (group, n, path, about) for each tree. A path has an entry for each level, null where
    a node has no sibling. Nodes explode the coordinates that index and size of the tree
    require into rows, and join the tables. A round does so for its own levels only, and what lies
    above comes from the round above, once for a block: so at most 2 ** (step - 1) rows ask for
    a node.
    """
    paths = None
    for r in reversed(range(len(tables))):
        low, table = r * step, tables[r]
        base = table.where((F.col("level") == low) & (height(F.col("n")) > low)).select("group", "n", "at") if r else leaves
        asked = base.where(height(F.col("n")) > low).select("group", "at", F.explode(F.sequence(F.lit(low), F.least(F.lit(low + step), height(F.col("n"))) - 1)).alias("level"))
        asked = asked.withColumn("sibling", F.expr(f"shiftright(at, level - {low}) ^ 1"))
        found = asked.join(table.select("group", "level", F.col("at").alias("sibling"), "digest"), ["group", "level", "sibling"], "left")
        entry = F.struct("level", (F.col("sibling") % 2 == 0).alias("left"), "digest")
        own = found.groupBy("group", "at").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda s: F.struct(s["left"].alias("left"), s["digest"].alias("digest"))).alias("own"))
        ends = above.where((height(F.col("n")) > (low if r else -1)) & (height(F.col("n")) <= low + step)).select("group", F.lit(0).cast("long").alias("up"), F.col("path").alias("higher"), "about")
        if paths is not None:
            ends = ends.unionByName(paths.select("group", F.col("at").alias("up"), F.col("path").alias("higher"), "about"))
        joined = base.withColumn("up", F.shiftright("at", step)).join(own, ["group", "at"], "left").join(ends, ["group", "up"])
        paths = joined.select(*base.columns, F.concat(F.coalesce("own", F.array().cast(SIBLING)), "higher").alias("path"), "about")
        if r:
            paths = materialize(paths)
    return paths


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, digest, lambda d, s: F.when(s["left"], parent(s["digest"], d)).otherwise(parent(d, s["digest"])))


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings, level by level, as hexadecimal digits."""
    return F.sha2(F.array_join(F.transform(F.filter(path, lambda s: s["digest"].isNotNull()), lambda s: hexed(s["digest"])), ""), 256)


def manifest(docs: DataFrame, changed: Column | None = None, step: int = STEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, changed_leaf) for each row, all digests binary.

    A leaf is the SHA-256 of a row's FIELDS. Leaves of a lang ascend by doc_id (nulls first;
    rows of one id by their digest), and each two neighbours become one node, level by level;
    a lone one is digested alone. The subroots, by lang (null first), become the root likewise.
    changed: n_chars as a tampered copy of the table has it; changed_leaf is made of it.
    Repeated rows are leaves of their own; an empty table has none. Other columns are not read.
    Texts are read once; then only digests travel. No lang is gathered: rows are numbered by
    ranges, and trees built from runs of 2 ** step nodes.
    """
    n_chars = F.col("n_chars")
    values = lambda n: [n if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), "lang")).alias("group"), leaf(*values(n_chars)).alias("digest"), leaf(*values(n_chars if changed is None else changed)).alias("changed_leaf"))
    leaves = materialize(numbered(leaves, "group", [F.col("doc_id").asc_nulls_first(), "digest"]))
    tables = tree(leaves, step)
    tops = roots(tables, step).select(F.lit("").alias("all"), F.col("group").alias("lang"), F.col("n").alias("leaves"), "digest")
    tops = materialize(numbered(tops, "all", ["lang"]))
    tops = tops.withColumnRenamed("all", "group")
    over = tree(tops, step)
    whole = roots(over, step).select("group", "n", F.array().cast(SIBLING).alias("path"), F.col("digest").alias("about"))
    ends = proofs(tops, over, whole, step)
    above = materialize(ends.select(F.col("lang").alias("group"), F.col("leaves").alias("n"), "path", F.struct(F.col("digest").alias("subroot"), F.col("about").alias("root")).alias("about")))
    found = proofs(leaves, tables, above, step)
    return found.select("doc_id", F.col("digest").alias("leaf"), "about.subroot", "about.root", "path", "changed_leaf")
