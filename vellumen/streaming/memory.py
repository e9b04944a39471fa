"""An event memory that a stream keeps up to date: last event wins by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumen.operators.relate import last_wins
from vellumen.sources.files import path_exists

#: Parts into which keys are dealt; batches that wait, at most, before they are put together.
BUCKETS, WAITING = 64, 8


def _names(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the folders prefix=number that were written whole, in order."""
    if not path_exists(spark, folder):
        return []
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{prefix}=")]
    return sorted(int(p.getName().partition("=")[2]) for p in found if path_exists(spark, f"{p}/_SUCCESS"))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """(the last batch that was put together, or -1; for each bucket the version that has its rows)."""
    done = _names(spark, f"{path}/manifest", "version")
    if not done:
        return -1, {}
    rows = spark.read.parquet(f"{path}/manifest/version={done[-1]}").collect()  # a row a bucket
    return done[-1], {r["bucket"]: r["version"] for r in rows}


def _about(spark: SparkSession, path: str, keys: Sequence[str] | None = None, order: Sequence[str] = (), buckets: int = BUCKETS) -> tuple[list[str], list[str], int]:
    """The memory's keys, the order within a batch and the number of buckets, as its first batch wrote them."""
    where = f"{path}/about"
    if not path_exists(spark, f"{where}/_SUCCESS"):
        spark.createDataFrame([(list(keys), list(order), buckets)], "keys array<string>, order array<string>, buckets int").coalesce(1).write.mode("overwrite").parquet(where)
    found = spark.read.parquet(where).first()
    return list(found["keys"]), list(found["order"]), found["buckets"]


def _parts(spark: SparkSession, path: str, only: Sequence[int] | None) -> DataFrame | None:
    """Rows with _bucket and _batch, the batch (or version) they came with: what was put together and the batches since."""
    through, versions = manifest(spark, path)
    base = [f"{path}/base/version={v}/_bucket={b}" for b, v in versions.items() if only is None or b in only]
    deltas = [f"{path}/delta/batch={b}" for b in _names(spark, f"{path}/delta", "batch") if b > through]
    parts = [spark.read.option("basePath", f"{path}/base").parquet(*base).withColumnRenamed("version", "_batch")] if base else []
    if deltas:
        new = spark.read.option("basePath", f"{path}/delta").parquet(*deltas).withColumnRenamed("batch", "_batch")
        parts.append(new if only is None else new.where(F.col("_bucket").isin(*only)))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def current(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame | None:
    """The memory as of the last batch, or None before any. A later batch's events replace those of earlier ones.

    only: some of the buckets. Buckets are folders, so others aren't read.
    """
    path = path.rstrip("/")
    rows = _parts(spark, path, only)
    if rows is None:
        return None
    keys, order, _ = _about(spark, path)
    return last_wins(rows, keys, ["_batch", *order]).drop("_bucket", "_batch")


def put(batch: DataFrame, number: int, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS, waiting: int = WAITING) -> None:
    """Adds a batch to the memory's log: the last event of each key, in its bucket. A batch that comes again changes nothing.

    When more than `waiting` batches wait, they are put together. So a batch writes its own rows,
    and now and then the buckets that some batches touched, never the whole memory.
    """
    spark, path = batch.sparkSession, path.rstrip("/")
    through = manifest(spark, path)[0]
    if number <= through or path_exists(spark, f"{path}/delta/batch={number}/_SUCCESS"):
        return
    keys, order, buckets = _about(spark, path, keys, order, buckets)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    last_wins(batch, keys, order).withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/delta/batch={number}")
    if len([b for b in _names(spark, f"{path}/delta", "batch") if b > through]) > waiting:
        compact(spark, path)


def compact(spark: SparkSession, path: str) -> list[int]:
    """Puts waiting batches into the buckets that they touch, and writes no others; gives their numbers.

    What neither this manifest nor the one before names is deleted: readers may still be at that one.
    """
    path = path.rstrip("/")
    through, versions = manifest(spark, path)
    batches = _names(spark, f"{path}/delta", "batch")
    waiting = [b for b in batches if b > through]
    if not waiting:
        return []
    new = spark.read.option("basePath", f"{path}/delta").parquet(*(f"{path}/delta/batch={b}" for b in waiting))
    touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # as many as buckets, at most
    if touched:
        keys, order, _ = _about(spark, path)
        rows = last_wins(_parts(spark, path, touched), keys, ["_batch", *order]).drop("_batch")
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/base/version={waiting[-1]}")
    latest = versions | dict.fromkeys(touched, waiting[-1])
    spark.createDataFrame(list(latest.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={waiting[-1]}")
    for b in batches:
        if b <= through:  # put together before this time
            _delete(spark, f"{path}/delta/batch={b}")
    named = {*versions.items(), *latest.items()}
    for v in _names(spark, f"{path}/base", "version"):
        if not any(w == v for _, w in named):
            _delete(spark, f"{path}/base/version={v}")
    for v in _names(spark, f"{path}/manifest", "version")[:-2]:
        _delete(spark, f"{path}/manifest/version={v}")
    return touched


def keep(events: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS, waiting: int = WAITING) -> StreamingQuery:
    """Keeps a memory of the last event of each key, as put() does for each micro-batch."""
    add = lambda batch, number: put(batch, number, path, keys, order, buckets, waiting)
    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_counts(events: DataFrame, time: str, outcome: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts of outcomes by window of time, for streams and tables; what comes later than `late` doesn't count in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), outcome).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), outcome, "n")
