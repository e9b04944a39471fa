"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt into blocks by space, each block's tree is built once, and queries are searched
a block of them at a time: first in the block of data that they lie nearest to, which gives
each its worst k-th score so far, then in every other block that may hold better ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumen.llm.common import dump, load, materialize, spread
from vellumen.llm.embed_dedup import finite

#: Rows of a data block and of a query block; query blocks that one task holds against a data block.
DATA, QUERIES, CHUNK = 8192, 2048, 16
#: Rows that the cells are chosen from, at most, and cells, at most.
SAMPLE, CELLS = 8192, 1024
#: Points of a leaf; ratio of a level's radius to the next; points that give a first bound; products at a time.
LEAF, BASE, FIRST, PRODUCTS = 24, 1.3, 64, 1 << 20
#: The largest score; what lies beyond 64 bits counts as the nearest number within.
LIMIT = 2**63 - 1

BEST = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
BEST_ARROW = pa.struct([(f.name, pa.int64()) for f in BEST])
BLOCK = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("blob", T.BinaryType())])
SEARCHED = T.StructType([*BLOCK, T.StructField("floor", T.DoubleType()), T.StructField("found", T.ArrayType(BEST))])
OTHERS = T.StructType([*BLOCK, T.StructField("own_cell", T.IntegerType()), T.StructField("own_part", T.IntegerType())])


class CoverTree:
    """Points under nodes; a node has a centre among them and covers them within its radius.

    Children of a node are centred at points further apart than their level's radius, the
    node's own centre first; levels shrink by BASE. Levels that don't part the points are
    left out, and so is a level that would leave nearly every point alone: there the node is
    a leaf, however large. points lists all points so that each node has a stretch of it.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.points = np.arange(len(x))
        centre, radius, start, stop, child, last = [0], [0.0], [0], [len(x)], [0], [0]
        reach = np.linalg.norm(x - x[0], axis=1) if len(x) else np.zeros(0)
        todo = [(0, float(reach.max(initial=0)), reach)]
        while todo:
            node, scale, far = todo.pop()
            a, b = start[node], stop[node]
            radius[node] = float(far.max(initial=0))
            if b - a <= LEAF or radius[node] == 0:
                continue
            scale = min(scale, radius[node])
            groups = self.parted(centre[node], self.points[a:b], far, scale / BASE)
            while len(groups) == 1:
                scale /= BASE
                groups = self.parted(centre[node], self.points[a:b], far, scale / BASE)
            if not groups:
                continue
            child[node] = len(centre)
            last[node] = len(centre) + len(groups)
            self.points[a:b] = np.concatenate([g for _, g, _ in groups])
            for at, g, d in groups:
                todo.append((len(centre), scale / BASE, d))
                centre.append(at)
                radius.append(0.0)
                start.append(a)
                stop.append(a := a + len(g))
                child.append(0)
                last.append(0)
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.start, self.stop, self.child, self.last = map(np.array, (start, stop, child, last))
        self.measured()

    def parted(self, at: int, left: np.ndarray, distance: np.ndarray, scale: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(centre, points, distances) of the children at a scale; none if most of them would be single points."""
        groups, total = [], len(left)
        while len(left):
            near = distance <= scale
            groups.append((at, left[near], distance[near]))
            left = left[~near]
            if len(groups) >= 16 and total - len(left) < 2 * len(groups):
                return []
            if len(left):
                at = int(left[0])
                distance = np.linalg.norm(self.x[left] - self.x[at], axis=1)
        return groups

    def measured(self) -> None:
        self.mid = self.x[self.centre] if len(self.x) else self.x
        self.length = np.linalg.norm(self.mid, axis=1)

    def __getstate__(self) -> dict:
        """Whole numbers travel in 16 bits where they fit."""
        small = np.abs(self.x).max(initial=0) < 2**15 and (self.x == np.rint(self.x)).all()
        return {k: v for k, v in vars(self).items() if k not in ("mid", "length")} | {"x": self.x.astype(np.int16) if small else self.x}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.x = self.x.astype(np.float64)
        self.measured()


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: exact, and within 64 bits, as Python's numbers where doubles don't suffice."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2**53:
        return x @ y.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(x) @ whole(y).T, -(2**63), LIMIT)


def lowered(x):
    return x - 1e-9 * np.abs(x) - 1e-9


class DualTreeSearch:
    """The k best points of a data tree for each query of a query tree, ties to the smaller id.

    worst: for each query a score that k points are known to reach; points below it are of no
    interest. work: inner products of nodes and of points so far.
    """

    def __init__(self, queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.q, self.d, self.query_ids, self.data_ids, self.k = queries, data, query_ids, data_ids, k
        self.best: list[list[tuple]] = [[] for _ in query_ids]
        self.worst = np.full(len(query_ids), -np.inf) if worst is None else worst.copy()
        self.work = 0

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.q.last == 0)

    def begin(self) -> None:
        """First bounds: the k-th best of some points of the node that greedy descent ends in, leaving one out for the query itself."""
        for node in self.leaves().tolist():
            at = 0
            while self.d.last[at]:
                children = np.arange(self.d.child[at], self.d.last[at])
                children = children[self.d.stop[children] - self.d.start[children] > self.k + 1]
                if not len(children):
                    break
                self.work += len(children)
                at = int(children[np.argmax(self.d.mid[children] @ self.q.mid[node])])
            own, some = self.own(node), self.d.points[self.d.start[at] : self.d.stop[at]][:FIRST]
            if len(some) > self.k + 1:
                scores = np.clip(self.q.x[own] @ self.d.x[some].T, -float(LIMIT), float(LIMIT))
                self.work += scores.size
                self.worst[own] = np.maximum(self.worst[own], lowered(np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1]))

    def own(self, node: int) -> np.ndarray:
        return self.q.points[self.q.start[node] : self.q.stop[node]]

    def bounds(self, node: int, frontier: np.ndarray) -> np.ndarray:
        """No query of the node scores higher with a point of the data nodes."""
        q, d = self.q, self.d
        r = q.radius[node]
        self.work += len(frontier)
        top = d.mid[frontier] @ q.mid[node] + q.length[node] * d.radius[frontier] + d.length[frontier] * r + r * d.radius[frontier]
        return top + 1e-9 * (np.abs(top) + q.length[node] * d.length[frontier] + 1)

    def run(self) -> list[list[tuple]]:
        if not len(self.query_ids) or not len(self.data_ids):
            return self.best
        self.begin()
        todo = [(0, np.zeros(1, np.int64))]
        while todo:
            node, frontier = todo.pop()
            frontier = frontier[self.bounds(node, frontier) >= self.worst[self.own(node)].min()]
            if self.q.last[node] == 0:
                self.leaf(node, frontier)
            elif len(frontier):
                inner = self.d.last[frontier] > 0
                below = np.concatenate([frontier[~inner], self.children(frontier[inner])])
                todo += [(c, below) for c in range(self.q.child[node], self.q.last[node])]
        return self.best

    def children(self, nodes: np.ndarray) -> np.ndarray:
        return spread(self.d.child[nodes], self.d.last[nodes] - self.d.child[nodes])

    def each(self, own: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The same for single queries: a row for each."""
        x, d = self.q.x[own], self.d
        length = np.linalg.norm(x, axis=1)[:, None]
        self.work += len(own) * len(nodes)
        top = x @ d.mid[nodes].T
        return top + length * d.radius[nodes] + 1e-9 * (np.abs(top) + length * (d.length[nodes] + d.radius[nodes]) + 1)

    def leaf(self, node: int, frontier: np.ndarray) -> None:
        """Down the data tree, level by level, for the queries of a leaf: nodes are pruned for all of them, then for each."""
        own = self.own(node)
        while len(frontier):
            frontier = frontier[self.bounds(node, frontier) >= self.worst[own].min()]
            top = self.each(own, frontier)
            alive = (top >= self.worst[own, None]).any(axis=0)
            frontier, top = frontier[alive], top[:, alive]
            inner = self.d.last[frontier] > 0
            ends, top = frontier[~inner], top[:, ~inner]
            for e in np.argsort(-top.max(axis=0), kind="stable").tolist() if len(ends) else ():
                open_ = top[:, e] >= self.worst[own]
                if open_.any():
                    self.score(own[open_], self.d.points[self.d.start[ends[e]] : self.d.stop[ends[e]]])
            frontier = self.children(frontier[inner])

    def score(self, own: np.ndarray, points: np.ndarray) -> None:
        """Scores the queries with the points, some at a time."""
        step = max(64, PRODUCTS // len(own))
        for cut in range(0, len(points), step):
            some = points[cut : cut + step]
            scores, ids = products(self.q.x[own], self.d.x[some]), self.data_ids[some]
            self.work += scores.size
            good = (scores >= self.worst[own, None]) & (ids != self.query_ids[own, None])
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                query, hit = int(own[i]), np.flatnonzero(good[i])
                found = sorted([*self.best[query], *((-int(s), int(j)) for s, j in zip(scores[i, hit], ids[hit], strict=True))])[: self.k]
                self.best[query] = found
                if len(found) == self.k:
                    self.worst[query] = max(self.worst[query], lowered(float(-found[-1][0])))


def scaled(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x)


def matrix(column: pa.Array | pa.ChunkedArray, prepare: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Rows of vectors of one length, as whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return prepare(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), -1)


def cells_of(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Centres of the top nodes of a cover tree over a sample: the widest are opened until there are enough."""
    tree = CoverTree(sample)
    nodes = [0]
    while len(nodes) < wanted:
        inner = [n for n in nodes if tree.last[n]]
        if not inner:
            break
        widest = max(inner, key=lambda n: tree.radius[n])
        nodes.remove(widest)
        nodes += range(tree.child[widest], tree.last[widest])
    found = sample[tree.centre[nodes[:CELLS]]]
    return np.concatenate([found, sample[: wanted - len(found)]]) if len(found) < wanted else found


class Space:
    """The cells of each vector length: centres, and how far and how many rows they have."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres = centres
        self.radius: dict[int, np.ndarray] = {}
        self.parts: dict[int, np.ndarray] = {}
        self.query_parts: dict[int, np.ndarray] = {}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its centre) of each row; cell 0 and no bound where there are no centres."""
        if x.shape[1] not in self.centres:
            return np.zeros(len(x), np.int32), np.full(len(x), np.inf)
        c = self.centres[x.shape[1]]
        cell = np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)
        return cell.astype(np.int32), np.linalg.norm(x - c[cell], axis=1)

    def measure(self, rows: list) -> None:
        for width in {r["width"] for r in rows}:
            n = max(len(self.centres.get(width, [0])), 1)
            self.radius[width], self.parts[width], self.query_parts[width] = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for r in rows:
            self.radius[r["width"]][r["cell"]] = r["far"]
            self.parts[r["width"]][r["cell"]] = -(-r["n"] // DATA)
            self.query_parts[r["width"]][r["cell"]] = -(-r["asked"] // QUERIES)

    def tops(self, width: int, cell: int) -> np.ndarray:
        """For each cell: no query of the given cell scores higher with a row of it."""
        c, r = self.centres.get(width), self.radius[width]
        if c is None:
            return np.full(1, np.inf)
        length = np.linalg.norm(c, axis=1)
        top = c @ c[cell] + length[cell] * r + length * r[cell] + r * r[cell]
        return np.where(self.parts[width] > 0, top + 1e-9 * (np.abs(top) + length * length[cell] + 1), -np.inf)

    def first(self, width: int, cell: int) -> int:
        """The cell with rows that a cell's queries lie nearest to, by inner product."""
        c = self.centres.get(width)
        return 0 if c is None else int(np.argmax(np.where(self.parts[width] > 0, c @ c[cell], -np.inf)))


def built(group: pa.Table, prepare: Callable[[np.ndarray], np.ndarray]) -> pa.Table:
    state = CoverTree(matrix(group["embedding"], prepare)), group["id"].to_numpy(), None
    return pa.table([group[c].combine_chunks()[:1] for c in ("width", "cell", "part")] + [pa.array([dump(state)], pa.binary())], names=BLOCK.names)


def search(group: pa.Table, k: int) -> pa.Table:
    """The query blocks of a group held against its data block."""
    rows = group.sort_by("is_query").to_pylist()
    out: dict[str, list] = {n: [] for n in SEARCHED.names}
    if not rows[0]["is_query"]:
        data, data_ids, _ = load(rows[0]["blob"])
        for r in rows[1:]:
            tree, ids, worst = load(r["blob"])
            run = DualTreeSearch(tree, ids, data, data_ids, k, worst)
            best = run.run()
            found = [{"query_id": int(q), "vec_id": i, "score": -s} for q, b in zip(ids, best, strict=True) for s, i in b]
            for name, value in zip(SEARCHED.names, (r["width"], r["own_cell"], r["own_part"], dump((tree, ids, run.worst)), float(run.worst.min()), found), strict=True):
                out[name].append(value)
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.list_(BEST_ARROW))
    return pa.table([pa.array(out[n], t) for n, t in zip(SEARCHED.names, types, strict=True)], names=SEARCHED.names)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", prepare: Callable[[np.ndarray], np.ndarray] = scaled) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k other rows with the largest inner product.

    prepare turns components into whole numbers. Ties go to the smaller id. Null vectors,
    vectors that hold null or non-finite numbers, and null ids take no part; vectors of
    unequal lengths are not compared. Rows with one id count once, with the smallest of
    their vectors, and a query never finds its own id. Scores beyond 64 bits count as the
    nearest number of 64 bits. An empty table gives no rows. Other columns are not read.

    Cells are top nodes of a cover tree over at most SAMPLE rows; every row goes to the
    nearest, and a cell with many rows is dealt into blocks. The driver holds CELLS centres
    and counts for each vector length.
    """
    spark = vectors.sparkSession
    rows = vectors.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("embedding"), F.max(is_query).alias("is_query"))
    rows = materialize(rows.withColumn("width", F.size("embedding")))
    space = Space({})
    total = rows.count()
    if total > DATA:
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("width", "embedding").collect()
        for width in {r["width"] for r in sample}:
            own = [r["embedding"] for r in sample if r["width"] == width]
            wanted = min(CELLS, len(own), -(-total * len(own) // len(sample) // DATA) + 1)
            space.centres[width] = cells_of(prepare(np.array(own, np.float64).reshape(len(own), width)), wanted)
    schema = T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(batch.schema.get_field_index("width")).to_numpy()
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                cell, far = space.nearest(matrix(part.column(part.schema.get_field_index("embedding")), prepare))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(far)], names=schema.names)

    if space.centres:
        rows = materialize(rows.mapInArrow(placed, schema))
    else:
        rows = rows.withColumn("cell", F.lit(0)).withColumn("far", F.lit(float("inf")))
    about = rows.groupBy("width", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n"), F.count_if("is_query").alias("asked")).collect()  # a row a cell
    if not about:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space.measure(about)
    dealt = spark.createDataFrame([(r["width"], r["cell"], -(-r["n"] // DATA), max(1, -(-r["asked"] // QUERIES)), space.first(r["width"], r["cell"])) for r in about], "width int, cell int, parts int, asked int, first int")
    sided = rows.join(F.broadcast(dealt), ["width", "cell"])  # a row a cell
    build = lambda side, n: side.withColumn("part", F.pmod(F.xxhash64("id"), F.col(n)).cast("int")).select("width", "cell", "part", "id", "embedding").groupBy("width", "cell", "part").applyInArrow(lambda t: built(t, prepare), BLOCK)
    data, asked = build(sided, "parts"), build(sided.where("is_query"), "asked")
    own = [F.col("cell").alias("own_cell"), F.col("part").alias("own_part")]
    whole = [F.lit(None).cast("int").alias("own_cell"), F.lit(None).cast("int").alias("own_part")]
    keys = ["width", "cell", "part", "chunk"]
    query_blocks = int(sum(p.sum() for p in space.query_parts.values()))
    chunks = max(1, -(-query_blocks // CHUNK))
    chunk = F.pmod(F.xxhash64("own_cell", "own_part"), F.lit(chunks)).cast("int").alias("chunk")

    def held(blocks: DataFrame, queries: DataFrame) -> DataFrame:
        """Query blocks (width, cell, part, own_cell, own_part, blob) against the data blocks of their width, cell and part."""
        spread_ = blocks.select("width", "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), *whole, F.lit(False).alias("is_query"), "blob")
        both = spread_.unionByName(queries.select("width", "cell", "part", chunk, "own_cell", "own_part", F.lit(True).alias("is_query"), "blob"))
        return both.groupBy(*keys).applyInArrow(lambda t: search(t, k), SEARCHED)

    alone = int(sum(p.sum() for p in space.parts.values())) == len(space.parts)  # a block for each length, and so nothing after the first search
    data = data if alone else materialize(data)
    sent = asked.join(F.broadcast(dealt.select("width", "cell", "first")), ["width", "cell"]).select("width", *own, F.col("first").alias("cell"), F.lit(0).alias("part"), "blob")
    first = held(data.where("part = 0"), sent)
    scored = first.select(F.explode("found").alias("f"))
    if not alone:
        first = materialize(first)

        def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for width, cell, part, blob, floor in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    done = space.first(width, cell)
                    for there in np.flatnonzero(space.tops(width, cell) >= floor).tolist():
                        for p in range(int(there == done), int(space.parts[width][there])):
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((width, pa.int32()), (there, pa.int32()), (p, pa.int32()), (blob, pa.binary()), (cell, pa.int32()), (part, pa.int32()))], names=OTHERS.names)

        again = held(data, first.select(*SEARCHED.names[:5]).mapInArrow(targets, OTHERS))
        scored = first.select(F.explode("found").alias("f")).unionByName(again.select(F.explode("found").alias("f")))
    best = Window.partitionBy("f.query_id").orderBy(F.desc("f.score"), "f.vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("f.query_id", "rank", "f.vec_id", "f.score")
