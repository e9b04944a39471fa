"""What the operators of this folder share: written tables, components, byte buffers."""

from __future__ import annotations

import ctypes
import io
import pickle
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: everything that ends a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="vellumen-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """The frame, written as a table to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        tables = f"{scratch_dir(spark)}/tables/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/" not in (folder.partition(tables.split(":", 1)[-1])[2] or "/"):  # just a table's own folder
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes the tables and archives that operators wrote to the shared folder. Frames that read them end."""
    for name in ("tables", "warc"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(spark: SparkSession, docs: DataFrame, column: str) -> int:
    """UTF-8 bytes in a text column, over all rows."""
    return docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0


#: A value is frequent beyond FREQUENT rows, and beyond a 4096th of all; tasks over which its rows are dealt, at least.
FREQUENT, SALTS = 1 << 16, 256


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, total: int, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Rows joined with facts: a row for each value of key, whose column n (which goes) tells how many rows have it.

    A frequent value's rows, and those with a null, are dealt over many tasks by the columns
    `by`, the fact being in all of them. total: a number that the n add up to, or half that
    sum. So there are at most 2 * 4096 frequent values, and their list may be broadcast.
    """
    frequent = max(FREQUENT, total // 4096)
    if total <= frequent:
        return rows.join(facts.drop("n"), key, how)
    salts = min(4096, max(SALTS, total >> 23))
    hubs = facts.where(F.col("n") > frequent).select(key, F.lit(True).alias("_hub"))
    salt = F.when(F.coalesce(F.col("_hub"), F.lit(False)) | F.col(key).isNull(), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)
    salted = rows.join(F.broadcast(hubs), key, "left").withColumn("_salt", salt).drop("_hub")
    everywhere = F.when(F.col("n") > frequent, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(facts.withColumn("_salt", F.explode(everywhere)).drop("n"), [key, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    edges: two long columns u, v. Alternates the large-star and small-star steps of
    Kiveris et al. (2014); each round is written to the shared folder. A node with very many
    links, as every large component ends with, is counted with map-side parts and dealt over
    many tasks where its links meet its number.
    """

    def signature(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = signature(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = dealt_join(both.where("v > u"), least, "u", before[0], ("v",)).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = dealt_join(large, low, "u", before[0], ("v",)).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, e = e, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = signature(e)
        discard(old)
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def flat(root: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The root of each row's root, and so on."""
    order = np.argsort(ids)
    while True:
        above = root[order[np.searchsorted(ids[order], root)]]
        if (above == root).all():
            return root
        root = above


def joined(root: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts rows a and b under one root, the smallest id of what they reach; root holds ids, and is changed."""
    order = np.argsort(ids)
    place = lambda x: order[np.searchsorted(ids[order], x)]
    while len(a):
        root[:] = flat(root, ids)
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return
        np.minimum.at(root, place(high[apart]), low[apart])
        a, b = a[apart], b[apart]


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def release() -> None:
    """Gives memory that is free in this process back to the machine, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows, cut so that a piece has about `most` bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = byte_column(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        release()


class Words:
    """The words of a run of documents, over one buffer where a space follows each word.

    buf: the words' bytes. start, end: each word's place in buf. first: for each document
    the number of its first word, with the total at the end.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        blank = SPACE[raw]
        inside = ~blank
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= blank[:-1]
        ends[:-1] &= blank[1:]
        full = at[:-1] < at[1:]
        begins[at[:-1][full]] = inside[at[:-1][full]]
        ends[at[1:][full] - 1] = inside[at[1:][full] - 1]
        begin = np.flatnonzero(begins)
        size = np.flatnonzero(ends) + 1 - begin
        self.first = np.searchsorted(begin, at)
        self.start = np.cumsum(size) - size + np.arange(len(size))
        self.end = self.start + size
        self.buf = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        place = np.repeat(np.arange(len(size), dtype=np.int32 if len(raw) < 2**30 else np.int64), size)
        place += np.arange(len(place), dtype=place.dtype)
        self.buf[place] = raw[inside]

    def __len__(self) -> int:
        return len(self.start)

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word in the dictionary, the dictionary: words with the space after them)."""
        return dictionary(self.buf, np.append(self.start, len(self.buf)))


def dictionary(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers for the strings buf[at[i]:at[i+1]], equal exactly for equal strings, and the distinct strings."""
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(buf)])
    found = strings.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x over each window of `width` numbers."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] numbers), then the same for first[1], and so on."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of equal neighbours."""
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(x)], strict=False))


def deltas(x: np.ndarray) -> np.ndarray:
    """Whole numbers as differences in the narrowest type, which pack better; summed() reverses it."""
    d = np.diff(x, prepend=0)  # differences that overflow wrap round, and back again
    for kind in (np.uint8, np.int8, np.uint16, np.int16, np.uint32, np.int32):
        if len(d) and np.iinfo(kind).min <= d.min() and d.max() <= np.iinfo(kind).max:
            return d.astype(kind)
    return d


def summed(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.int64)


def _array(kind: str, shape: tuple, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(shape)


class _Pickler(pickle.Pickler):
    """Arrays as little more than their bytes: on many buckets most blobs hold a few strings."""

    def reducer_override(self, value):
        if type(value) is np.ndarray:
            return _array, (value.dtype.str, value.shape, value.tobytes())
        return NotImplemented


def dump(value) -> bytes:
    out = io.BytesIO()
    _Pickler(out, protocol=5).dump(value)
    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(out.getbuffer())


def load(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
