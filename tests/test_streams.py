"""Streams against batches: sessions with late rows, answered requests, the event memory; lines of large files."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellumen.plans import queries_spans
from vellumen.sources import files
from vellumen.streaming import memory, sessions

START = datetime(2024, 1, 1)


def brute_sessions(rows, gap):
    out = Counter()
    for key in {k for k, _ in rows}:
        times = sorted(int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000) for k, t in rows if k == key and t is not None)
        for start, end, n in sessions.merged([(t, t, 1) for t in times], gap):
            out[key, start, end, n] += 1
    return out


def test_merged_sessions():
    assert sessions.merged([(10, 12, 2), (0, 3, 1), (5, 5, 1), (20, 20, 1)], 2) == [(0, 5, 2), (10, 12, 2), (20, 20, 1)]


def test_sessions_with_late_rows(spark, tmp_path):
    """Rows come shuffled, over files whose times overlap; a hot key, ties, and a null key and time."""
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), START + timedelta(seconds=r.choice([s, s // 60 * 60]))) for s in r.choices(range(40_000), k=300)]
    rows.append((2, None))
    files_ = [[], [], []]
    for k, t in rows:  # a file has its third of the time, and some rows of the one before
        i = 0 if t is None else min(2, int((t - START).total_seconds() // 13_334))
        files_[min(2, i + (r.random() < 0.3))].append((k, t))
    files_.append([(-1, START + timedelta(days=30))])  # moves the watermark on
    for part in files_:
        r.shuffle(part)
        spark.createDataFrame(part, "k long, t timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    gap = 300_000_000
    stream = spark.readStream.schema("k long, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sessions.started(sessions.sessions(stream, "k", "t", gap, "8 hours"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("k IS NULL OR k <> -1")
    assert Counter(map(tuple, got.select("k", "start", "end", "n").collect())) == brute_sessions(rows, gap)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def micros(t):
    return int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def streamed(spark, path, files_, gap, late):
    """Sessions of a stream that reads a file at a time, without those of the key -1."""
    for part in files_:
        spark.createDataFrame(part, "k long, t timestamp").coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema("k long, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    sessions.started(sessions.sessions(stream, "k", "t", gap, late), str(path / "out"), str(path / "mark")).awaitTermination()
    return Counter(map(tuple, spark.read.parquet(str(path / "out")).where("k <> -1").select("k", "start", "end", "n").collect()))


def test_sessions_need_no_python(spark, tmp_path):
    """A call of Python for each key and each timer took nearly all the time."""
    spark.createDataFrame([(1, START)], "k long, t timestamp").write.parquet(str(tmp_path / "in"))
    found = sessions.sessions(spark.readStream.schema("k long, t timestamp").parquet(str(tmp_path / "in")), "k", "t", 1000, "1 hour")
    plan = found._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "session_window" in plan


def test_a_row_exactly_as_late_as_allowed_joins_its_session(spark, tmp_path):
    last, gap = START + timedelta(hours=5), timedelta(seconds=10)
    edge = last - timedelta(hours=1)
    files_ = [[(1, edge - gap), (-1, last)], [(-1, last)], [(1, edge)], [(-1, START + timedelta(days=30))]]
    assert streamed(spark, tmp_path, files_, 10_000_000, "1 hour") == Counter({(1, micros(edge - gap), micros(edge), 2): 1})


def test_sessions_without_a_gap_are_equal_times(spark, tmp_path):
    files_ = [[(1, START), (1, START + timedelta(seconds=1))], [(1, START), (2, START)], [(-1, START + timedelta(days=30))]]
    assert streamed(spark, tmp_path, files_, 0, "1 hour") == Counter({(1, micros(START), micros(START), 2): 1, (1, micros(START) + 1_000_000, micros(START) + 1_000_000, 1): 1, (2, micros(START), micros(START), 1): 1})


def test_replayed_parts_are_written_by_many_tasks(spark, tmp_path):
    """All rows once, the end last, and the files of a part after those of the part before."""
    rows = [(i, i % 7, START + timedelta(minutes=11 * i)) for i in range(4000)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    where = queries_spans.replayed(spark, str(tmp_path), ["event_id", "user_id", "ts"])
    found = spark.read.parquet(where).select("event_id", "user_id", "ts", F.input_file_name().alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    got = found.collect()
    assert sorted((r["event_id"], r["user_id"], r["ts"]) for r in got) == [(-1, -1, datetime(2030, 1, 1)), *rows]
    assert len({r["file"] for r in got}) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    since = {}
    for r in got:
        since[r["at"], r["file"]] = min(since.get((r["at"], r["file"]), r["ts"]), r["ts"])
    quarters = [min(4, (since[k] - START) // timedelta(days=31 / 4)) for k in sorted(since)]
    assert quarters == [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4 + [4]


def test_answered_requests(spark, tmp_path):
    asked = [(i, START + timedelta(minutes=i)) for i in range(20)] + [(99, START + timedelta(days=9))]
    came = [(i, START + timedelta(minutes=i + d), d) for i in range(0, 20, 2) for d in (5, 30, 90)] + [(99, START + timedelta(days=9), 0)]
    spark.createDataFrame(asked, "id long, asked timestamp").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame(came, "id long, came timestamp, d int").coalesce(1).write.parquet(str(tmp_path / "b"))
    left = spark.readStream.schema("id long, asked timestamp").parquet(str(tmp_path / "a"))
    right = spark.readStream.schema("id long, came timestamp, d int").parquet(str(tmp_path / "b"))
    sessions.started(sessions.answered(left, right, "id", "asked", "came", "1 hour", "1 hour"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = Counter((x["id"], x["d"]) for x in spark.read.parquet(str(tmp_path / "out")).collect() if x["id"] != 99)
    assert got == Counter({(i, d): 1 for i in range(20) for d in ((5, 30) if i % 2 == 0 else (None,))})


def test_memory_writes_only_what_changed(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "k long, s int, v string"
    r, want = random.Random(4), {}
    for n in range(7):
        rows = [(r.choice([1, 2, 3, r.randint(0, 50)]) if n < 5 else 1, r.randint(0, 3), f"{n}-{i}") for i in range(6)]
        last = {}
        for k, s, v in rows:
            last[k] = max(last.get(k, (-1, "")), (s, v))
        want |= {k: v for k, (_, v) in last.items()}
        batch = spark.createDataFrame(rows, schema)
        memory.put(batch, n, path, ["k"], ["s", "v"], buckets=8, waiting=2)
        memory.put(batch, n, path, ["k"], ["s", "v"], buckets=8, waiting=2)  # again
        assert {x["k"]: x["v"] for x in memory.current(spark, path).collect()} == want
    before = memory.manifest(spark, path)[1]
    memory.put(spark.createDataFrame([(1, 9, "last")], schema), 7, path, ["k"], ["s", "v"])
    touched = memory.compact(spark, path)
    after = memory.manifest(spark, path)[1]
    assert len(touched) == 1 and {b: v for b, v in after.items() if b not in touched} == {b: v for b, v in before.items() if b not in touched}
    assert memory.current(spark, path, touched).where("k = 1").first()["v"] == "last"
    assert memory.compact(spark, path) == [] and len(list((tmp_path / "m" / "manifest").glob("version=*"))) == 2
    assert memory.current(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_numbers_over_byte_ranges(spark, tmp_path, end):
    r = random.Random(5)
    lines = {name: ["" if r.random() < 0.2 else "x" * r.randint(1, 60) + str(i) for i in range(n)] + ["end"] for name, n in (("a.txt", 900), ("b.txt", 1), ("c é.txt", 0))}
    for name, own in lines.items():
        (tmp_path / name).write_bytes(end.join(own).encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = files.numbered_lines(spark, str(tmp_path))
        assert found.select(F.spark_partition_id()).distinct().count() > 1
        got = Counter((x["path"].rsplit("/", 1)[1].replace("%20", " ").replace("%C3%A9", "é"), x["line_number"], x["line"]) for x in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == Counter((name, i + 1, line) for name, own in lines.items() for i, line in enumerate(own))
