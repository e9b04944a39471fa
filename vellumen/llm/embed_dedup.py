"""Near-duplicate vectors by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumen.llm.common import connected_components, dealt_join, flat, joined, materialize

#: Vectors of a tile, about; rows multiplied and pairs recomputed at a time.
TILE, ROWS, PAIRS = 2048, 512, 20_000

FOUND = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("links", T.LongType())])


def finite(vector):
    """Column: whether a vector is there and holds finite numbers only."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 vectors, scales, lengths of the rounded vectors, lengths of what rounding left), of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    near = small * scale[:, None]
    return small, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def directions(x: np.ndarray) -> np.ndarray:
    """Vectors at a scale where squares stay in range: powers of two keep every digit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


#: What a vector is known by in the first search: 8-bit numbers, their scale, and the two lengths.
CODE = T.StructType([T.StructField("code", T.BinaryType()), *(T.StructField(n, T.DoubleType()) for n in ("scale", "near", "rest"))])


def coded(x: np.ndarray) -> list[pa.Array]:
    """The columns of CODE for vectors that aren't zero."""
    x = directions(x)
    small, scale, near, rest = quantised(x / np.linalg.norm(x, axis=1)[:, None])
    width = small.shape[1]
    codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(small), [None, pa.py_buffer(np.ascontiguousarray(small))]).cast(pa.binary())
    return [codes, pa.array(scale), pa.array(near), pa.array(rest)]


class Codes:
    """Rows of CODE."""

    def __init__(self, table: pa.Table, rows: np.ndarray):
        table = table.take(pa.array(rows))
        self.small = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(len(rows), -1)
        self.scale, self.near, self.rest = (table[c].to_numpy() for c in ("scale", "near", "rest"))
        # Products of 8-bit numbers are exact in the float type that holds their sum.
        self.kind = np.float32 if self.small.shape[1] * 127 * 127 < 2**24 else np.float64


def possible(x: Codes, y: Codes, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of x, rows of y) whose cosine may be `least` or more, some rows of x at a time.

    The integer product of two rounded vectors is off by no more than |rest of x| + |rounded
    x| |rest of y|, as both have length 1.
    """
    other = y.small.astype(y.kind).T
    for start in range(0, len(x.small), ROWS):
        rows = slice(start, start + ROWS)
        near = (x.small[rows].astype(x.kind) @ other).astype(np.float64) * x.scale[rows, None] * y.scale
        i, j = np.nonzero(near + x.rest[rows, None] + x.near[rows, None] * y.rest >= least - 1e-9)
        yield i + start, j


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the left and the right tile; both are the same where the tile meets itself."""
    side = table["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, left if table["left"][0].as_py() == table["right"][0].as_py() else right


def wanted(group: pa.Table, least: float, names: list[str]) -> pa.Table:
    """The vectors of a pair of tiles that may have a link there."""
    left, right = sides(group)
    need = np.zeros(group.num_rows, bool)
    if len(left) and len(right):
        same = left is right
        for i, j in possible(Codes(group, left), Codes(group, right), least):
            if same:
                i, j = i[i != j], j[i != j]
            need[left[i]] = need[right[j]] = True
    return group.select(names).filter(pa.array(need))


def tile_pair(group: pa.Table, least: float) -> pa.Table:
    """For each class with links in a pair of tiles: the smallest key it reaches there, and its number of links there.

    Pairs that the bounds let through are computed in double precision.
    """
    ids, copies = group["key"].to_numpy(), group["copies"].to_numpy()
    vectors = group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    vectors = directions(vectors)
    length = np.linalg.norm(vectors, axis=1)
    left, right = sides(group)
    same = left is right
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    if len(left) and len(right):
        for i, j in possible(Codes(group, left), Codes(group, right), least):
            if same:
                i, j = i[i < j], j[i < j]
            for cut in range(0, len(i), PAIRS):
                a, b = left[i[cut : cut + PAIRS]], right[j[cut : cut + PAIRS]]
                good = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (length[a] * length[b]) >= least
                a, b = a[good], b[good]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                joined(root, ids, a, b)
    some = np.flatnonzero(links)
    return pa.table({"u": ids[some], "v": flat(root, ids)[some], "links": links[some]})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", least: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: links join rows of one group with a cosine of at least `least`.

    component_id is the smallest id reachable; kept: whether it is the row's own. Vectors
    that are null, zero, empty or hold null or non-finite numbers, rows with a null group or
    id, and vectors of unequal lengths link with nothing; such rows stay, with no links.
    Repeated rows count as rows, and an id that comes with several vectors or groups links
    through none of them but its own row's. Other columns are not read.

    Equal vectors of a group become one class first, with a key of its own, and are rounded once. A group is dealt into
    tiles of bounded size, and each pair of tiles is one piece of work: a first search over
    rounded vectors, which alone are sent to every pair, finds the vectors that may have
    links; those are then sent whole, and a second search gives sums and a spanning forest
    back, not the pairs.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.col(vector_col).alias("embedding"))
    good = F.coalesce(F.col("group").isNotNull() & F.col("id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    plain = rows.where(good).groupBy("group", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("width", F.size("embedding")).withColumn("key", F.monotonically_increasing_id())
    schema = T.StructType([*plain.schema, *CODE])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(batch.schema.get_field_index("width")).to_numpy()
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                x = part.column(part.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, *coded(x.reshape(-1, w))], names=schema.names)

    classes = materialize(plain.mapInArrow(code, schema))
    # Written, as is what follows, so that Spark can split a large group where it is joined.
    sizes = materialize(classes.groupBy("group", "width").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    dealt = classes.join(sizes, ["group", "width"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = ["group", "width", "left", "right"]
    paired = dealt.select("group", "width", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "key", *CODE.names)
    pair = T.StructType([classes.schema["group"], *(T.StructField(n, T.IntegerType()) for n in ("width", "left", "right", "side")), T.StructField("key", T.LongType())])
    need = materialize(paired.groupBy(*keys).applyInArrow(lambda t: wanted(t, least, pair.names), pair))
    whole = need.join(classes.drop("group", "width"), "key")
    found = materialize(whole.groupBy(*keys).applyInArrow(lambda t: tile_pair(t, least), FOUND))
    links = found.groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    components = connected_components(found.select("u", "v")).withColumnRenamed("node", "key")
    # The least id of a component, from its classes; a large component's are dealt over tasks.
    reached = materialize(classes.select("key", "rep", "copies", "group", "embedding").join(links, "key", "left").join(components, "key", "left").withColumn("component", F.coalesce("component", "key")))
    smallest = reached.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    about = dealt_join(reached, smallest, "component", reached.count(), ("key",))
    about = materialize(about.select("group", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    linked_rows = rows.where(good).join(about, ["group", "embedding"]).select("id", "n_links", "component_id")
    others = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked_rows.unionByName(others).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
