"""Sessions of a stream with late rows, and requests that wait for their responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def merged(sessions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (start, end, n) with those joined that lie at most `gap` apart."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(sessions):
        if out and start - out[-1][1] <= gap:
            first, last, m = out[-1]
            out[-1] = (first, max(last, end), m + n)
        else:
            out.append((start, end, n))
    return out


def sessions(events: DataFrame, key: str, time: str, gap: int, late: str) -> DataFrame:
    """(key, start, end, n) of a stream's sessions, in microseconds, each once: when the watermark has passed its end and the gap.

    Rows of a key at most `gap` microseconds apart are one session, in whatever order they
    come, as long as none is over `late` behind the latest time seen; what is later may be
    dropped. Null keys are a key; null times don't count. State is a few numbers for each open
    session. Start it with started(), so that state lies on disk and a task's rows of a
    session are one row before they are shuffled.
    """
    rows = events.where(F.col(time).isNotNull()).withWatermark(time, f"{late} 1 millisecond")  # at the watermark itself a session would be over
    own = F.session_window(time, f"{gap} microseconds") if gap else F.col(time)
    found = rows.groupBy(key, own.alias("_own")).agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.count(F.lit(1)).alias("n"))
    return found.select(key, F.unix_micros("_first").alias("start"), F.unix_micros("_last").alias("end"), "n")


def answered(requests: DataFrame, responses: DataFrame, key: str, asked: str, came: str, deadline: str, late: str) -> DataFrame:
    """Requests with each response of the same key that came from then on until the deadline, and those without one, with nulls.

    Both sides keep their rows in state until the watermarks say that no partner can come; an
    unanswered request comes out then. Names of the columns must differ but for the key.
    """
    left = requests.withWatermark(asked, late)
    right = responses.withWatermark(came, late).withColumnRenamed(key, "_key")
    within = (F.col(key) == F.col("_key")) & (F.col(came) >= F.col(asked)) & (F.col(came) <= F.col(asked) + F.expr(f"INTERVAL {deadline}"))
    return left.join(right, within, "left_outer").drop("_key")


def started(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there, and appends what comes out to Parquet files; the session's settings stay as they are."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            conf.set(name, value)
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
