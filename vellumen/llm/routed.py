"""Work that meets in buckets by content and then returns to the batch of rows it came from.

A map task cuts its rows into batches. Each batch sends its distinct strings, packed by
bucket, to the buckets. A bucket sees each string once a batch, however many rows hold it,
and answers each batch apart; so no task gathers all rows of a common passage. The rows are
read a second time and meet the answers to their batch, so that texts are shuffled once.
Batches are named by their place and content. Both readings must give the same batches: a
frame that isn't read from files as it is, is written first, and an answer to a batch that
isn't there fails the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumen.llm.common import byte_column, dump, load, materialize, slices

ROWS = T.StructType([T.StructField("key", T.LongType()), T.StructField("batch", T.BinaryType()), T.StructField("kind", T.IntegerType()), T.StructField("payload", T.BinaryType())])
ARROW = pa.schema([("key", pa.int64()), ("batch", pa.binary()), ("kind", pa.int32()), ("payload", pa.binary())])
STRINGS, HOME, ANSWER = 0, 1, 2
#: A gram is hot beyond so many places, and so many times the mean of the slots that have any; class of those.
HOT, HOT_MEANS, HOTTEST = 1 << 16, 16, 255
#: Plans that give the same rows in the same order whenever they run.
REPEATABLE = ("Project", "Filter", "LogicalRelation")


def packed(rows: list[tuple[int, bytes, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW)], schema=ARROW)


def repeatable(docs: DataFrame) -> DataFrame:
    """The frame, or a written table of it where its plan is more than a reading of files."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    todo, plain = [plan], plan.deterministic()
    while todo and plain:
        node = todo.pop()
        plain = node.nodeName().split(" ")[0] in REPEATABLE
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return docs if plain else materialize(docs)


def ranks(docs: DataFrame, text_col: str, size: int, slice_bytes: int, grams: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A class of frequency, from 0 for none, for each slot of grams, counted over all rows.

    grams(bytes, offsets) gives the hash of each occurrence; its low bits are the slot. A
    gram that goes by these classes first and by its hash second is hardly ever a common one
    where a window has any other, so no bucket grows with the frequency of a word. Hot grams are
    of class HOTTEST: a window that has no other kind is told by longer grams. size: bytes
    of all texts, by which there are 2^16 to 2^20 slots; the driver gets one number for each.
    """
    slots = 1 << min(20, max(16, (size >> 20).bit_length()))
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for part in slices(rows, text_col, slice_bytes):
            total += np.bincount((grams(*byte_column(part.column(0))) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=schema.names)

    found = docs.select(text_col).mapInArrow(count, schema).groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(slots, np.uint8)
    n = found["n"].to_numpy(np.float64)
    hot = n > max(HOT, HOT_MEANS * n.mean()) if len(n) else np.zeros(0, bool)
    out[found["slot"].to_numpy(np.int64)] = np.where(hot, HOTTEST, 4 * np.log2(n + 1)).astype(np.uint8)
    return out


def through_buckets(
    docs: DataFrame,
    columns: list[str],
    text_col: str,
    slice_bytes: int,
    split: Callable[[pa.RecordBatch], tuple[dict[int, object], object]],
    bucket: Callable[[list], list],
    settle: Callable[[object, list], pa.RecordBatch],
    schema: T.StructType,
) -> DataFrame:
    """split(rows) gives what goes to each bucket, and the batch's own state. bucket(list of
    such parts) gives an answer, or None, for each part. settle(state, answers) gives the rows
    of a batch."""

    def batches_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, dict[int, object], object]]:
        place = TaskContext.get().partitionId()
        for n, part in enumerate(slices(rows, text_col, slice_bytes)):
            parts, state = split(part)
            name = hashlib.blake2b(b"%d/%d/" % (place, n), digest_size=16)
            name.update(byte_column(part.column(part.schema.get_field_index(text_col)))[0])
            yield name.digest(), parts, state

    def strings_side(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, parts, _ in batches_of(rows):
            if parts:
                yield from packed([(k, name, STRINGS, dump(v)) for k, v in parts.items()]).to_batches()

    def home_side(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, state in batches_of(rows):
            yield from packed([(0, name, HOME, dump(state))]).to_batches()

    def meet(group: pa.Table) -> pa.Table:
        names, payloads = group["batch"].to_pylist(), group["payload"]
        answers = bucket([load(x.as_buffer()) for x in payloads])
        return packed([(0, n, ANSWER, dump(a)) for n, a in zip(names, answers, strict=True) if a is not None])

    def return_home(group: pa.Table) -> pa.Table:
        state, answers = None, []
        for kind, blob in zip(group["kind"].to_pylist(), group["payload"], strict=True):
            value = load(blob.as_buffer())
            if kind == HOME:
                state = value
            else:
                answers.append(value)
        if state is None:
            raise ValueError("the documents changed between two readings; write them to a table first")
        return pa.Table.from_batches([settle(state, answers)])

    picked = repeatable(docs.select(*columns))
    answers = picked.mapInArrow(strings_side, ROWS).groupBy("key").applyInArrow(meet, ROWS)
    return picked.mapInArrow(home_side, ROWS).unionByName(answers).groupBy("batch").applyInArrow(return_home, schema)
