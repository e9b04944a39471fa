"""Queries that join along an axis, with percentiles and histograms, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumen.operators import quantiles, rank, sketches, spans
from vellumen.plans.queries import BOX_SQL, boxes, query, read
from vellumen.plans.queries_records import folder
from vellumen.sources import files
from vellumen.streaming import memory, sessions

# Orders span 2400 days and events 30: a day of the one is 1080 seconds of the other.
PLACED = "epoch(o_orderdate - TIMESTAMP '1995-01-01')::BIGINT // 80 + epoch(TIMESTAMP '2024-01-01')::BIGINT"


def orders_and_events(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders at a second of the events' month, and events."""
    start = F.unix_timestamp(F.lit("1995-01-01 00:00:00").cast("timestamp"))
    at = F.floor((F.unix_timestamp("o_orderdate") - start) / 80) + F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", at.alias("at"))
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("seen"))
    return orders, events


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey, {PLACED} AS due FROM orders), e AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS seen FROM events),
m AS (SELECT o_orderkey, arg_max((event_id, event_type, seen), (seen, event_id)) AS e FROM o JOIN e ON user_id = o_custkey AND seen < due AND seen >= due - 172800 GROUP BY o_orderkey)
SELECT o_orderkey, e[1] AS event_id, e[2] AS event_type, e[3] AS seen FROM o LEFT JOIN m USING (o_orderkey)
""")
def event_before_order(spark, sf_dir):
    """For each order, its customer's last event before it, of the two days before."""
    orders, events = orders_and_events(spark, sf_dir)
    found = spans.as_of(orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), "at"), events, ["user_id"], "at", "seen", ["event_id", "event_type"], oldest=lambda t: t - 172_800)
    return found.select("o_orderkey", "event_id", "event_type", "seen")


@query(f"""
WITH o AS (SELECT o_orderkey, ['click', 'error', 'purchase', 'signup', 'view'][o_orderkey % 5 + 1] AS kind, {PLACED} AS due FROM orders),
e AS (SELECT event_type AS kind, floor(epoch(ts))::BIGINT AS seen, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT o_orderkey, o.kind AS kind, event_id, seen FROM o ASOF LEFT JOIN e ON o.kind = e.kind AND o.due >= e.seen
""")
def event_of_kind_before_order(spark, sf_dir):
    """For each order, the last event of one of five kinds by then: each kind has a fifth of all rows."""
    orders, events = orders_and_events(spark, sf_dir)
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    left = orders.select("o_orderkey", F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("kind"), "at")
    found = spans.as_of(left, events.withColumnRenamed("event_type", "kind"), ["kind"], "at", "seen", ["event_id"], strict=False)
    return found.select("o_orderkey", "kind", "event_id", "seen")


SESSIONS = """WITH e AS (SELECT user_id, event_type, floor(epoch(ts))::BIGINT AS s FROM events WHERE event_type IN ('error', 'purchase')),
o AS (SELECT *, CASE WHEN s - max(s) OVER (PARTITION BY user_id, event_type ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3600 THEN 0 ELSE 1 END AS b FROM e),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM o),
p AS (SELECT user_id, event_type, min(s) AS first, max(s) AS last FROM i GROUP BY user_id, event_type, island)"""


@query(f"""{SESSIONS}
SELECT a.user_id AS error_user, a.first AS error_first, b.user_id AS purchase_user, b.first AS purchase_first FROM p a JOIN p b ON a.event_type = 'error' AND b.event_type = 'purchase' AND a.first <= b.last AND b.first <= a.last
""")
def errors_during_purchases(spark, sf_dir):
    """Stretches of errors and stretches of purchases, of any users, that have a second in common."""
    events = read(spark, sf_dir, "events", "user_id", "event_type", F.unix_timestamp("ts").alias("s")).where("event_type IN ('error', 'purchase')").withColumn("t", F.col("s"))
    found = rank.islands(events, ["user_id", "event_type"], "s", "t", 3600)
    side = lambda kind: found.where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{kind}_user"), F.col("s").alias(f"{kind}_first"), F.col("t").alias(f"{kind}_last"))
    met = spans.overlapping(side("error"), side("purchase"), ("error_first", "error_last"), ("purchase_first", "purchase_last"))
    return met.select("error_user", "error_first", "purchase_user", "purchase_first")


@query(f"""
WITH b AS (SELECT vec_id, vec_id % 5 AS page, a, b, c, d FROM ({BOX_SQL}) WHERE c > a AND d > b),
p AS (SELECT l.vec_id AS one, r.vec_id AS other, (least(l.c, r.c) - greatest(l.a, r.a)) AS w, (least(l.d, r.d) - greatest(l.b, r.b)) AS h, (l.c - l.a) * (l.d - l.b) + (r.c - r.a) * (r.d - r.b) AS areas
    FROM b l JOIN b r ON l.page = r.page AND l.vec_id < r.vec_id)
SELECT one, other, round(w * h / (areas - w * h), 6) AS iou FROM p WHERE w > 0 AND h > 0 AND w * h / (areas - w * h) >= 0.6
""")
def boxes_that_overlap(spark, sf_dir):
    """All pairs of boxes of a page with an IoU of 0.6 or more."""
    b = boxes(spark, sf_dir).select(F.col("vec_id").alias("one"), (F.col("vec_id") % 5).alias("page"), "box")
    found = spans.overlapping_boxes(b, b.select(F.col("one").alias("other"), F.col("page").alias("same"), F.col("box").alias("right")), "box", "right", 0.6, [("page", "same")], dense=100)
    return found.where("one < other").select("one", "other", F.round("iou", 6).alias("iou"))


def percentile_sql(key: str, value: str, table: str) -> str:
    return f"""WITH r AS (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS place, count(*) OVER (PARTITION BY {key}) AS n FROM {table})
SELECT {key}, p::DOUBLE AS share, v AS value, n FROM r, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) AS q(p) WHERE place = ceil(p * n)"""


@query(percentile_sql("l_partkey", "l_extendedprice", "lineitem"))
def part_percentiles(spark, sf_dir):
    return quantiles.percentiles(read(spark, sf_dir, "lineitem", "l_partkey", "l_extendedprice"), ["l_partkey"], "l_extendedprice", [0.5, 0.95, 0.99])


@query(percentile_sql("l_returnflag, l_linestatus", "l_extendedprice", "lineitem"))
def flag_percentiles(spark, sf_dir):
    """A few groups that hold all rows: no more than 2000 values are sorted at once."""
    return quantiles.percentiles(read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.5, 0.95, 0.99], most=2000)


@query("""
WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT (floor(place * 50 / n::DOUBLE) + 1)::INTEGER AS bucket, min(v) AS low, max(v) AS high, count(*) AS n FROM r GROUP BY 1
""")
def price_buckets(spark, sf_dir):
    return quantiles.equal_depth(read(spark, sf_dir, "orders", "o_totalprice"), "o_totalprice", 50)


def price_histogram(spark, sf_dir):
    """The best 12 buckets of 256 parts of the events' values. Tested by brute force."""
    found = quantiles.least_error(read(spark, sf_dir, "events", "value"), "value", 12, 256)
    return found.select("bucket", "n", "total", *(F.round(c, 6).alias(c) for c in ("low", "high", "error")))


query()(price_histogram)


# ---- summaries kept in parts, and streams


SPANS = "(VALUES ('first week', 1, 7), ('middle', 10, 20), ('month', 1, 31)) AS s(span, a, b)"


def day_spans(spark, state: DataFrame) -> DataFrame:
    """State rows of days (from 1) with the span that a day is in, once for each."""
    spans_ = F.array(*(F.struct(F.lit(n).alias("span"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (("first week", 1, 7), ("middle", 10, 20), ("month", 1, 31))))
    return state.withColumn("s", F.explode(F.filter(spans_, lambda s: (F.col("day") >= s["a"]) & (F.col("day") <= s["b"])))).withColumn("span", F.col("s.span")).drop("s")


@query(f"SELECT span, event_type, count(DISTINCT user_id) AS n FROM events JOIN {SPANS} ON day(ts) BETWEEN a AND b GROUP BY ALL")
def distinct_users_of_spans(spark, sf_dir):
    """Different users for any span of days, from bitmaps of the days."""
    days = sketches.distinct_state(read(spark, sf_dir, "events", F.dayofmonth("ts").alias("day"), "event_type", "user_id"), ["day", "event_type"], "user_id")
    return sketches.distinct_of(day_spans(spark, rank.kept(days)), ["span", "event_type"])


@query(f"SELECT span, count(DISTINCT user_id) AS n, true AS near FROM events JOIN {SPANS} ON day(ts) BETWEEN a AND b GROUP BY ALL")
def estimated_users_of_spans(spark, sf_dir):
    """Estimates from merged sketches of the days are within five standard errors of the exact numbers."""
    events = read(spark, sf_dir, "events", F.dayofmonth("ts").alias("day"), "user_id")
    about = sketches.estimate_of(day_spans(spark, rank.kept(sketches.sketch_state(events, ["day"], "user_id"))), ["span"]).withColumnRenamed("n", "about")
    exact = sketches.distinct_of(day_spans(spark, sketches.distinct_state(events, ["day"], "user_id")), ["span"])
    return exact.join(about, "span").select("span", "n", (F.abs(F.col("about") - F.col("n")) <= 5 * 1.04 / 64 * F.col("n")).alias("near"))


@query(r"""
WITH w AS (SELECT lang, unnest(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word FROM documents WHERE lang IS NOT NULL),
n AS (SELECT lang, count(*) AS whole FROM w GROUP BY lang)
SELECT lang, word, count(*) AS n FROM w JOIN n USING (lang) GROUP BY lang, word, whole HAVING count(*) > 0.005 * whole
""")
def frequent_words(spark, sf_dir):
    """Words that are over half a percent of a language's, from summaries of its sources."""
    words = read(spark, sf_dir, "documents", "lang", "source", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> '' AND lang IS NOT NULL")
    state = sketches.frequent_state(words, ["lang", "source"], "word", size=400)
    return sketches.frequent(words, state, ["lang"], "word", 0.005)


STREAM_GAP = 6 * 3600 * 1_000_000


def files_of_part(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def replayed(spark, sf_dir, columns: list[str], parts: int = 4) -> str:
    """A folder with the events as parts that come one after the other, rows within a part in no order; the last ends them.

    A part is as many files as there are shuffle partitions, or fewer where rows are few.
    """
    where, mixed = folder(spark), F.xxhash64("user_id", "ts")
    events = read(spark, sf_dir, "events", *columns)
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    part = F.least(F.lit(parts - 1), F.floor((F.unix_timestamp("ts") - F.unix_timestamp(first)) / (31 * 86_400 / parts)))
    late = F.greatest(F.lit(0), part - 1)  # a tenth comes a file earlier than its time
    dealt = events.withColumn("_part", F.when(F.xxhash64("ts", "user_id") % 10 == 0, late).otherwise(part))
    for i in range(parts):
        dealt.where(F.col("_part") == i).drop("_part").repartition(files_of_part(spark), mixed).sortWithinPartitions(mixed).write.mode("append").parquet(where)
    ended = events.limit(1).select(*(F.lit(-1).cast("long").alias(c) if c in ("user_id", "event_id") else F.lit("2030-01-01 00:00:00").cast("timestamp").alias(c) if c == "ts" else F.col(c) for c in columns))
    ended.coalesce(1).write.mode("append").parquet(where)
    return where


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
o AS (SELECT *, CASE WHEN t - max(t) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 21600000000 THEN 0 ELSE 1 END AS b FROM e),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM i GROUP BY user_id, island
""")
def streamed_sessions(spark, sf_dir):
    """Sessions of users with gaps of at most six hours, from a stream whose files are shuffled and overlap in time."""
    source, out = replayed(spark, sf_dir, ["user_id", "ts"]), folder(spark)
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", files_of_part(spark)).parquet(source)
    sessions.started(sessions.sessions(stream, "user_id", "ts", STREAM_GAP, "16 days"), f"{out}/out", f"{out}/mark").awaitTermination()
    return spark.read.parquet(f"{out}/out").where("user_id >= 0").select("user_id", F.col("start").alias("first"), F.col("end").alias("last"), "n")


@query("""
SELECT a.event_id, a.user_id, b.event_id AS answer FROM events a LEFT JOIN events b ON b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOUR WHERE a.event_type = 'view'
""")
def views_with_purchases(spark, sf_dir):
    """Views with the purchases of the same user in the twelve hours after, and those without one, as streams of both."""
    source, out = replayed(spark, sf_dir, ["event_id", "user_id", "event_type", "ts"]), folder(spark)
    stream = lambda kind: spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").parquet(source).where((F.col("event_type") == kind) | (F.col("user_id") < 0))
    views = stream("view").select("event_id", "user_id", F.col("ts").alias("seen"))
    bought = stream("purchase").select("user_id", F.col("event_id").alias("answer"), F.col("ts").alias("bought"))
    sessions.started(sessions.answered(views, bought, "user_id", "seen", "bought", "12 hours", "16 days"), f"{out}/out", f"{out}/mark").awaitTermination()
    return spark.read.parquet(f"{out}/out").where("user_id >= 0").select("event_id", "user_id", "answer")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def streamed_memory(spark, sf_dir):
    """The last event of each user and type, from a memory that a stream keeps as a log of changed buckets."""
    source, out = folder(spark), folder(spark)
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    for i in range(3):
        events.where(F.floor((F.dayofmonth("ts") - 1) / 11) == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    memory.keep(stream, f"{out}/memory", f"{out}/mark", ["user_id", "event_type"], ["ts", "event_id"], buckets=8, waiting=1).awaitTermination()
    return memory.current(spark, f"{out}/memory").select("user_id", "event_type", "event_id", "ts")


@query("""
SELECT 'day=' || day(ts) AS file, line, event_id FROM (SELECT ts, event_id, row_number() OVER (PARTITION BY day(ts) ORDER BY event_id) AS line FROM events) WHERE event_id % 97 = 0
""")
def bad_lines_of_files(spark, sf_dir):
    """Events as JSON lines, a file a day, of which some are cut off: their files and line numbers."""
    where, key = folder(spark), F.col("event_id")
    cell = F.to_json(F.struct("event_id", "user_id", "event_type"))
    line = F.when(key % 97 == 0, F.substring(cell, 1, 12 + F.length(key.cast("string")))).otherwise(cell)
    rows = read(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("day"), "event_id", line.alias("line"))
    rows.repartition("day").sortWithinPartitions("day", "event_id").drop("event_id").write.partitionBy("day").text(where)
    bad = files.bad_json_lines(spark, where)
    return bad.select(F.regexp_extract("path", r"(day=\d+)/", 1).alias("file"), F.col("line_number").cast("long").alias("line"), F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("event_id"))
