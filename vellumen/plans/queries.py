"""Queries that apply the operators to tables of orders, events and documents, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumen.functions import answers, geometry, numbers, text
from vellumen.operators import metrics, rank, relate
from vellumen.plans import rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Queries over files that they make themselves and no given table: for tests alone.
UNREGISTERED: dict[str, Query] = {}
UNREGISTERED_SQL: dict[str, str] = {}


def query(sql: str | None = None, *, registered: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        (QUERIES if registered else UNREGISTERED)[f.__name__] = f
        if sql is not None:
            (SQL if registered else UNREGISTERED_SQL)[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def joined(c: str | Column, sep: str = ";") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")) if isinstance(c, Column) else F.col(c).cast("array<string>"), sep)


# ---- joins and overlays


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS matched, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def match_split(spark, sf_dir):
    hit, missing = relate.match_split(read(spark, sf_dir, "documents", "doc_id"), read(spark, sf_dir, "labels", "doc_id", "quality"), ["doc_id"])
    return hit.select("doc_id", F.lit(True).alias("matched"), "quality").unionByName(missing.select("doc_id", F.lit(False).alias("matched"), F.lit(None).cast("int").alias("quality")))


@query("""
WITH i AS (SELECT l_orderkey AS k, arg_max(l_returnflag, (l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS flag,
    count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderpriority, c_name, n_name, CASE WHEN i.k IS NULL THEN 'none' ELSE flag END AS last_flag, coalesce(n, 0) AS n_items
FROM orders LEFT JOIN i ON o_orderkey = k LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def report_join(spark, sf_dir):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    items = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", *order)
    last = relate.last_wins(items, ["l_orderkey"], order).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("last_flag"))
    counted = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_items"))
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    out = relate.left_default(relate.left_default(orders, last, ["o_orderkey"], {"last_flag": "none"}, None), counted, ["o_orderkey"], {"n_items": 0}, None)
    people = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey").withColumnRenamed("c_custkey", "o_custkey")
    out = out.join(people, "o_custkey", "left").join(read(spark, sf_dir, "nation", "n_nationkey", "n_name").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left")
    return out.select("o_orderkey", "o_orderpriority", "c_name", "n_name", "last_flag", "n_items")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def require_match(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_orderkey", "l_orderkey")
    return relate.require_match(items, orders, ["l_orderkey"], "item")


EVENT = "event_id, user_id, event_type, value"


@query(f"SELECT {EVENT} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def overlay_last(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return relate.overlay([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")], ["user_id", "event_type"], ["ts", "event_id"]).select(*EVENT.split(", "))


@query(f"SELECT {EVENT} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_wins(spark, sf_dir):
    return relate.first_wins(read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select(*EVENT.split(", "))


@query(f"SELECT {EVENT} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def memory_upsert(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return relate.upsert(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), ["user_id"], ["ts", "event_id"]).select(*EVENT.split(", "))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_totalprice > 1000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 3 = 0 AND o_totalprice > 1000 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders
""")
def retry_overlay(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    retries = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("F").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"), (F.col("o_totalprice") > 1000).alias("ok"))
    return relate.replaced(o, retries, ["o_orderkey"], F.col("ok"))


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'over' END AS origin FROM customer")
def present_override(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    return relate.present_override(c, c.where("c_acctbal < 0").select("c_custkey", F.lit(None).cast("double").alias("c_acctbal"), F.lit("over").alias("origin")), ["c_custkey"])


@query("""
SELECT n_name, p.o_orderpriority, coalesce(n, 0) AS n FROM nation CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
LEFT JOIN (SELECT c_nationkey, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) f
ON f.c_nationkey = n_nationkey AND f.o_orderpriority = p.o_orderpriority
""")
def spine_fill(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority")
    people = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    facts = orders.join(people, orders["o_custkey"] == people["c_custkey"]).groupBy(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority").agg(F.count("*").alias("n"))
    out = relate.spine(read(spark, sf_dir, "nation", "n_nationkey", "n_name"), orders.select("o_orderpriority").distinct(), facts, ["n_nationkey", "o_orderpriority"])
    return out.select("n_name", "o_orderpriority", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey + 100 AS n_regionkey FROM nation")
def form_update(spark, sf_dir):
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    form = n.select("n_nationkey", (F.col("n_regionkey") + 100).alias("region"))
    return relate.form_update(n, form, "n_nationkey", {"n_regionkey": F.col("form_region").cast(n.schema["n_regionkey"].dataType)})


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_order FROM customer")
def existing(spark, sf_dir):
    there = read(spark, sf_dir, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    return relate.existing(read(spark, sf_dir, "customer", "c_custkey"), there, ["c_custkey"], "has_order")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def expected_minus_present(spark, sf_dir):
    partial = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relate.difference(read(spark, sf_dir, "customer", "c_custkey"), partial, ["c_custkey"])


@query("SELECT 'customer' AS scope, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def union_scopes(spark, sf_dir):
    return relate.union_scopes(customer=read(spark, sf_dir, "customer", F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), supplier=read(spark, sf_dir, "supplier", F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))).select("scope", "key", "name")


ISSUES_SQL = "list_filter([CASE WHEN o_totalprice > 300000 THEN 'expensive' END, CASE WHEN o_orderstatus = 'F' THEN 'finished' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL)"


def order_issues(orders: DataFrame) -> DataFrame:
    return orders.withColumn("issues", text.labels((F.col("o_totalprice") > 300000, "expensive"), (F.col("o_orderstatus") == "F", "finished"), (F.col("o_orderpriority").startswith("1"), "urgent")))


@query(f"SELECT o_orderkey, unnest(CASE WHEN len(i) = 0 THEN [NULL] ELSE i END) AS issue FROM (SELECT o_orderkey, {ISSUES_SQL} AS i FROM orders)")
def issue_unnest(spark, sf_dir):
    return relate.unnested(order_issues(read(spark, sf_dir, "orders")).select("o_orderkey", "issues"), "issues", "issue", keep_empty=True)


@query(f"SELECT o_orderkey, list_has_any({ISSUES_SQL}, ['expensive', 'urgent']) AS blocked, array_to_string(list_intersect(['expensive', 'urgent'], {ISSUES_SQL}), ';') AS blocking FROM orders")
def flag_intersections(spark, sf_dir):
    bad = ("expensive", "urgent")
    rows = order_issues(read(spark, sf_dir, "orders"))
    return rows.select("o_orderkey", rules.any_of(F.col("issues"), bad).alias("blocked"), joined(F.array_intersect(F.array(*map(F.lit, bad)), "issues")).alias("blocking"))


# ---- counts and accuracies

ANSWERED = "SELECT d.doc_id, lang, source, n_chars, quality, toxic, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END = quality AS ok, n_chars / 40000.0 AS confidence FROM documents d JOIN labels USING (doc_id)"


def answered(spark, sf_dir) -> DataFrame:
    """Documents with a label, and whether their length foretells it."""
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.withColumn("ok", (F.col("n_chars") > 1500).cast("int") == F.col("quality")).withColumn("confidence", F.col("n_chars") / 40000.0)


@query(f"SELECT lang AS value, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, (count(*) FILTER (WHERE ok))::DOUBLE / count(*) AS accuracy FROM ({ANSWERED}) GROUP BY lang")
def grouped_accuracy(spark, sf_dir):
    return metrics.grouped_accuracy(answered(spark, sf_dir), "lang", F.col("ok"))


@query(f"""
SELECT lang, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE NOT ok) AS errors, (count(*) FILTER (WHERE ok))::DOUBLE / count(*) AS accuracy,
    min(confidence)::DOUBLE AS min_confidence, max(confidence)::DOUBLE AS max_confidence, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE NOT ok), '') AS error_ids,
    coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE toxic = 1), '') AS review_ids
FROM ({ANSWERED}) GROUP BY lang
""")
def accuracy_summary(spark, sf_dir):
    out = metrics.accuracy_summary(answered(spark, sf_dir), F.col("ok"), "confidence", F.col("toxic") == 1, "doc_id", ["lang"])
    return out.select("lang", "total", "correct", "errors", "accuracy", "min_confidence", "max_confidence", joined("error_ids", ",").alias("error_ids"), joined("review_ids", ",").alias("review_ids"))


@query(f"""
SELECT CASE WHEN grouping(lang) = 1 THEN 'combined' ELSE lang END AS lang, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE NOT ok) AS errors,
    (count(*) FILTER (WHERE ok))::DOUBLE / count(*) AS accuracy, count(*) FILTER (WHERE toxic = 1) AS review_count, min(confidence)::DOUBLE AS min_confidence, max(confidence)::DOUBLE AS max_confidence
FROM ({ANSWERED}) GROUP BY ROLLUP (lang)
""")
def combined_accuracy(spark, sf_dir):
    return metrics.combined_accuracy(answered(spark, sf_dir), "lang", F.col("ok"), "confidence", F.col("toxic") == 1)


@query(f"""
SELECT *, accuracy_ok AND clean_ok AS passed FROM (SELECT count(*) AS record_count, count(DISTINCT source) AS sample_count, count(*) FILTER (WHERE ok) AS quality_correct,
    (count(*) FILTER (WHERE ok))::DOUBLE / count(*) AS quality_accuracy, count(*) FILTER (WHERE toxic = 0) AS clean_correct, (count(*) FILTER (WHERE toxic = 0))::DOUBLE / count(*) AS clean_accuracy,
    coalesce((count(*) FILTER (WHERE ok))::DOUBLE / count(*) >= 0.5, false) AS accuracy_ok, coalesce((count(*) FILTER (WHERE toxic = 0))::DOUBLE / count(*) >= 0.99, false) AS clean_ok FROM ({ANSWERED}))
""")
def evaluation_gates(spark, sf_dir):
    s = metrics.evaluation_summary(answered(spark, sf_dir), "source", {"quality": F.col("ok"), "clean": F.col("toxic") == 0}).drop("quality_error_samples", "clean_error_samples")
    return metrics.gates(s, accuracy_ok=F.col("quality_accuracy") >= 0.5, clean_ok=F.col("clean_accuracy") >= 0.99)


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def counter(spark, sf_dir):
    return metrics.counter(read(spark, sf_dir, "events", "event_type"), "event_type")


@query("SELECT row_number() OVER (ORDER BY n DESC, value) AS sequence_number, * FROM (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1)")
def counters_ranked(spark, sf_dir):
    return rank.numbered(metrics.counter(read(spark, sf_dir, "orders", "o_orderpriority"), "o_orderpriority", by_count=True), [F.desc("n"), "value"])


@query(f"SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'issues', value, count(*) FROM (SELECT unnest({ISSUES_SQL}) AS value FROM orders) GROUP BY value")
def counters(spark, sf_dir):
    return metrics.counters(order_issues(read(spark, sf_dir, "orders")), ["o_orderstatus", "issues"])


@query(f"SELECT layer, count(*) AS n, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS samples FROM (SELECT unnest({ISSUES_SQL}) AS layer, o_orderstatus FROM orders) GROUP BY layer")
def layer_counts(spark, sf_dir):
    return metrics.layers(order_issues(read(spark, sf_dir, "orders")), "issues", "o_orderstatus").select("layer", "n", joined("samples").alias("samples"))


@query("""
SELECT (SELECT count(*) FROM orders) AS page_count, (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders) AS done_count,
    (SELECT count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem) AS returned_count, (SELECT count(*) FILTER (WHERE c_acctbal < 0) FROM customer) AS debt_count
""")
def run_summary(spark, sf_dir):
    return metrics.run_summary(
        orders=(read(spark, sf_dir, "orders"), {"page_count": F.lit(True), "done_count": F.col("o_orderstatus") == "F"}),
        items=(read(spark, sf_dir, "lineitem"), {"returned_count": F.col("l_returnflag") == "R"}),
        people=(read(spark, sf_dir, "customer"), {"debt_count": F.col("c_acctbal") < 0}),
    )


VERDICT_SQL = "SELECT event_type AS model, user_id, CASE event_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' WHEN 2 THEN ' ' END AS verdict FROM events"


def verdicts(spark, sf_dir) -> DataFrame:
    e, k = read(spark, sf_dir, "events", "event_id", "event_type", "user_id"), F.col("event_id") % 4
    return e.select(F.col("event_type").alias("model"), "user_id", F.when(k == 0, "correct").when(k == 1, "wrong").when(k == 2, " ").alias("verdict"))


def model_sql(over: str) -> str:
    return f"""
SELECT model, total, reviewed, correct, reviewed - correct AS wrong, total - reviewed AS blank, correct::DOUBLE / nullif({over}, 0) AS accuracy
FROM (SELECT model, count(*) AS total, count(*) FILTER (WHERE trim(verdict) <> '') AS reviewed, count(*) FILTER (WHERE trim(verdict) = 'correct') AS correct FROM ({VERDICT_SQL}) GROUP BY model)"""


@query(model_sql("reviewed"))
def model_accuracy_reviewed(spark, sf_dir):
    return metrics.model_accuracy(verdicts(spark, sf_dir), "model", "verdict", reviewed_only=True)


@query(model_sql("total"))
def model_accuracy_all(spark, sf_dir):
    return metrics.model_accuracy(verdicts(spark, sf_dir), "model", "verdict", reviewed_only=False)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS votes, min(ts) AS first FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first, event_type) AS n, sum(votes) OVER (PARTITION BY user_id)::BIGINT AS total_votes, count(*) OVER (PARTITION BY user_id) AS distinct_values FROM c)
SELECT user_id, event_type, votes, total_votes, distinct_values, distinct_values > 1 AS needs_check FROM r WHERE n = 1
""")
def majority_vote(spark, sf_dir):
    return metrics.majority_vote(read(spark, sf_dir, "events", "user_id", "event_type", "ts"), ["user_id"], "event_type", "ts")


@query("""
SELECT user_id, array_to_string(list_filter(['click', 'error'], lambda m: NOT list_contains(have, m)), ';') AS missing_models, any_needs_review, kinds > 1 AS grade_conflict,
    any_needs_review OR kinds > 1 OR len(have) < 2 AS needs_attention
FROM (SELECT user_id, list(DISTINCT event_type) AS have, bool_or(value > 90) AS any_needs_review, count(DISTINCT coalesce(CASE WHEN value > 20 THEN floor(value / 50)::BIGINT END, -1)) AS kinds
    FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id)
""")
def compare_models(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_type", "value").select("*", (F.col("value") > 90).alias("review"), F.when(F.col("value") > 20, F.floor(F.col("value") / 50)).alias("grade"))
    out = metrics.compare_models(e, ["user_id"], "event_type", ["click", "error"], "review", ["grade"])
    return out.withColumn("missing_models", joined("missing_models"))


@query("""
SELECT user_id, string_agg(event_type || '=' || event_id::VARCHAR, ';' ORDER BY event_type) AS last_events
FROM (SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) GROUP BY user_id
""")
def page_pivot(spark, sf_dir):
    out = metrics.page_pivot(read(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts"), ["user_id"], "event_type", "event_id", ["ts", "event_id"])
    return out.select("user_id", F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("last_events"))


SPLIT_SQL = "CASE WHEN doc_id % 10 IN (8, 9) THEN 'val' WHEN doc_id % 10 = 0 THEN 'test_focus' ELSE 'train' END"


@query(f"SELECT doc_id, {SPLIT_SQL} AS split FROM documents")
def split_assign(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id").withColumn("split", rank.split_by_digit(F.col("doc_id"), {8: "val", 9: "val", 0: "test_focus"}, "train"))


def leak_sql(where: str) -> str:
    return f"SELECT source, string_agg(DISTINCT s, ';' ORDER BY s) AS splits FROM (SELECT 'batch' || doc_id // 3 AS source, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {SPLIT_SQL} END AS s FROM documents) {where} GROUP BY source HAVING count(DISTINCT s) > 1"


def leaks(spark, sf_dir, ignore: bool) -> DataFrame:
    d = read(spark, sf_dir, "documents", "doc_id").withColumn("source", F.concat(F.lit("batch"), F.floor(F.col("doc_id") / 3).cast("string")))
    d = d.withColumn("split", F.when(F.col("doc_id") % 7 == 0, "").otherwise(rank.split_by_digit(F.col("doc_id"), {8: "val", 9: "val", 0: "test_focus"}, "train")))
    return metrics.leakage(d, "source", "split", ignore_blank=ignore).select("source", joined("splits").alias("splits"))


@query(leak_sql("WHERE s <> ''"))
def leakage(spark, sf_dir):
    return leaks(spark, sf_dir, True)


@query(leak_sql(""))
def leakage_with_blanks(spark, sf_dir):
    return leaks(spark, sf_dir, False)


@query("""
SELECT 'error' AS severity, 'duplicate_line' AS code, l_orderkey || ':' || l_linenumber AS item FROM lineitem GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'warning', 'free', l_orderkey::VARCHAR FROM lineitem WHERE l_discount >= 0.1
""")
def dataset_issues(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    twice = items.groupBy(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("item")).count().where("count > 1").select("item")
    return metrics.issues(error__duplicate_line=twice, warning__free=items.where("l_discount >= 0.1").select("l_orderkey"))


@query("""
WITH f AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), m AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT 'error' AS severity, 'duplicate' AS code, k::VARCHAR AS item FROM f WHERE n > 1 UNION ALL SELECT 'error', 'unknown', k::VARCHAR FROM f WHERE k NOT IN (SELECT k FROM m)
UNION ALL SELECT 'error', 'missing', k::VARCHAR FROM m WHERE k NOT IN (SELECT k FROM f)
""")
def form_completeness(spark, sf_dir):
    form = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return metrics.completeness(form, read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("""
SELECT printf('rule_%03d', row_number() OVER (ORDER BY n DESC, o_orderpriority)) AS rule_id, o_orderpriority AS value, n AS support
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) WHERE n >= 2 AND n >= 0.2 * (SELECT count(*) FROM orders)
""")
def rule_mining(spark, sf_dir):
    return metrics.mined_rules(read(spark, sf_dir, "orders", "o_orderpriority"), "o_orderpriority", support=2, share=0.2)


@query("""
SELECT d.doc_id, lang, CASE WHEN l.doc_id IS NULL OR q IS NULL THEN 'missing' WHEN q = lang THEN 'match' ELSE 'mismatch' END AS truth_status
FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'en' ELSE 'fr' END AS q FROM labels) l USING (doc_id)
""")
def truth_status(spark, sf_dir):
    truth = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, None).when(F.col("quality") == 1, "en").otherwise("fr").alias("expected"))
    return metrics.truth_status(read(spark, sf_dir, "documents", "doc_id", "lang"), truth, ["doc_id"], "lang", "expected")


@query("SELECT CASE WHEN value >= 90 THEN 'strong' WHEN value >= 50 THEN 'weak' ELSE 'none' END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def buckets(spark, sf_dir):
    v = F.col("value")
    return metrics.bucketed(read(spark, sf_dir, "events", "value"), v, [("strong", v >= 90), ("weak", v >= 50)], "none")


@query("SELECT round(avg(l_discount), 6) AS avg_l_discount, min(l_discount) AS min_l_discount, max(l_discount) AS max_l_discount, count(*) FILTER (WHERE l_tax > 0.04) AS guarded, count(*) FILTER (WHERE NOT l_tax > 0.04) AS unguarded FROM lineitem")
def ratio_summary(spark, sf_dir):
    return metrics.ratio_summary(read(spark, sf_dir, "lineitem", "l_discount", "l_tax").withColumn("g", F.col("l_tax") > 0.04), "l_discount", "g")


# ---- ranking and choosing

TIES = ["l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_linenumber"]
BEST = f"OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {', '.join(TIES)})"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, row_number() {BEST}::INTEGER AS candidate_rank, row_number() {BEST} = 1 AS selected, l_extendedprice - lead(l_extendedprice) {BEST} AS margin FROM lineitem")
def top1_with_rejects(spark, sf_dir):
    return rank.top1_with_rejects(read(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", *TIES), ["l_orderkey"], "l_extendedprice", TIES).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "candidate_rank", "selected", "margin")


@query("""
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_extendedprice, least((SELECT count(*) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag <> a.l_returnflag
    AND b.l_extendedprice >= 0.82 * a.l_extendedprice) / 3, 1.0)::DOUBLE AS ambiguity_score FROM lineitem a
""")
def ambiguity(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    return rank.ambiguity(rows, ["l_orderkey"], "l_returnflag", "l_extendedprice").drop("l_returnflag")


@query(f"SELECT l_orderkey, l_returnflag, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, {', '.join(TIES)}) AS n FROM lineitem) WHERE n = 1")
def best_per_side(spark, sf_dir):
    return rank.top_n(read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_extendedprice", *TIES), ["l_orderkey", "l_returnflag"], [F.desc("l_extendedprice"), *TIES], 1).select("l_orderkey", "l_returnflag", "l_extendedprice")


@query("SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_brand, p_name) > 1 AS is_duplicate FROM part")
def duplicates_in_source(spark, sf_dir):
    return rank.duplicates(read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name"), ["p_brand", "p_name"]).select("p_partkey", "p_name", "is_duplicate")


@query("""
WITH n AS (SELECT p_partkey, p_brand || '-' || p_size || '-' || p_name AS name FROM part), g AS (SELECT name, dense_rank() OVER (ORDER BY name)::INTEGER AS duplicate_group FROM (SELECT name FROM n GROUP BY 1 HAVING count(*) > 1))
SELECT p_partkey, name, CASE WHEN duplicate_group IS NULL THEN 'auto' ELSE 'human' END AS route, duplicate_group FROM n LEFT JOIN g USING (name)
""")
def duplicates_everywhere(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_name")
    named = p.select("p_partkey", F.concat_ws("-", "p_brand", F.col("p_size").cast("string"), "p_name").alias("name"), F.lit("auto").alias("route"))
    return rank.duplicate_groups(named, "name", "route", "human")


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), '7:' || doc_id) AS n FROM documents)
WHERE n <= CASE lang WHEN 'en' THEN 10 WHEN 'fr' THEN 9 WHEN 'de' THEN 1 ELSE 0 END
""")
def stratified_sample(spark, sf_dir):
    return rank.stratified(read(spark, sf_dir, "documents", "doc_id", "lang"), "lang", {"en": 10, "fr": 9, "de": 1}, F.concat(F.lit("7:"), F.col("doc_id").cast("string")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY (o_orderkey % 1000 = 1) DESC, o_totalprice DESC, o_orderkey LIMIT 20")
def forced_first(spark, sf_dir):
    return rank.forced_first(read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), F.col("o_orderkey") % 1000 == 1, F.col("o_totalprice"), "o_orderkey", 20)


@query("""
SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY t, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS t FROM orders))
ORDER BY t, n, o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25
""")
def round_robin(spark, sf_dir):
    groups = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return rank.round_robin(rows, "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"], groups, 25, F.when(F.col("o_orderstatus") == "P", 0).otherwise(1)).select("o_orderkey", "o_orderpriority")


@query("""
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders)
WHERE n <= CASE o_orderstatus WHEN 'P' THEN 10 WHEN 'O' THEN 4 WHEN 'F' THEN 16 END ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, n LIMIT 16
""")
def capped_mix(spark, sf_dir):
    return rank.capped_mix(read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), "o_orderstatus", {"P": 10, "O": 4, "F": None}, ["o_orderkey"], 16)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'click' AND event_id % 3 = 1) WHERE n = 1")
def error_first(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type", "ts").withColumn("verdict", F.when(F.col("event_id") % 3 == 0, "正确").when(F.col("event_id") % 3 == 1, "错误").otherwise(" "))
    return rank.error_first(e, "user_id", F.col("event_type") == "click", "verdict", "正确", ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT o_orderkey, 'failure' AS case_kind FROM orders WHERE o_orderstatus <> 'F' UNION ALL (SELECT o_orderkey, 'positive_control' FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 5)")
def failures_and_controls(spark, sf_dir):
    return rank.failures_and_controls(read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F", 5, ["o_orderkey"], ["o_orderkey"]).select("o_orderkey", "case_kind")


@query("""
WITH e AS (SELECT user_id, event_id AS s, event_id + 20 AS t FROM events),
o AS (SELECT *, CASE WHEN s - max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 100 THEN 0 ELSE 1 END AS b FROM e),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, t)::BIGINT AS island FROM o)
SELECT user_id, island, min(s) AS s, max(t) AS t, count(*) AS n_rows FROM i GROUP BY user_id, island
""")
def merge_gaps(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_id").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 20).alias("t"))
    return rank.islands(e, ["user_id"], "s", "t", 100)


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM events")
def moving_average(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    return rank.smoothed(e, "value", ["user_id"], ["ts", "event_id"], 5, "smooth").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 WHEN o_totalprice > 200000 THEN 2 ELSE 3 END AS priority FROM orders")
def review_priority(spark, sf_dir):
    return rank.by_priority(read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice"), [F.col("o_orderstatus") == "P", F.col("o_totalprice") > 200000], ["o_orderkey"]).select("o_orderkey", "priority")


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS sequence_number, o_orderkey FROM orders")
def sequence_numbers(spark, sf_dir):
    return rank.numbered(read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"]).select("sequence_number", "o_orderkey")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, floor(value / 8) ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def near_boxes(spark, sf_dir):
    return rank.near_boxes(read(spark, sf_dir, "events", "user_id", "event_id", "value"), ["user_id"], ["value"], ["event_id"])


# ---- text and numbers

PART_TEXT = "CASE p_partkey % 5 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN 'JS' || p_size || '_' || p_partkey || '-A/' WHEN 2 THEN 'N/A' WHEN 3 THEN 'con' ELSE p_brand || ' ' || p_partkey || '.' END"


def part_texts(spark, sf_dir) -> DataFrame:
    p, k = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_brand"), F.col("p_partkey") % 5
    number = F.col("p_partkey").cast("string")
    made = (
        F.when(k == 0, F.concat(F.lit("  "), "p_name", F.lit(" ")))
        .when(k == 1, F.concat(F.lit("JS"), F.col("p_size").cast("string"), F.lit("_"), number, F.lit("-A/")))
        .when(k == 2, "N/A")
        .when(k == 3, "con")
        .otherwise(F.concat("p_brand", F.lit(" "), number, F.lit(".")))
    )
    return p.select("p_partkey", made.alias("t"))


PLAIN = "CASE WHEN lower(trim(t)) IN ('', 'unknown', 'none', 'null', 'n/a') THEN '' ELSE regexp_replace(trim(t), '\\s+', '', 'g') END"


@query(f"SELECT p_partkey, {PLAIN} AS plain, regexp_replace(lower(t), '\\s+', '', 'g') AS folded, replace(regexp_replace(t, '\\s+', '', 'g'), '_', '-') AS dashed, replace({PLAIN}, '_', '-') AS plain_dashed, replace(regexp_replace(upper(trim(t)), '\\s+', '', 'g'), '_', '-') AS compatible FROM (SELECT p_partkey, {PART_TEXT} AS t FROM part)")
def name_normalise(spark, sf_dir):
    t = F.col("t")
    return part_texts(spark, sf_dir).select("p_partkey", text.number_plain(t).alias("plain"), text.number_folded(t).alias("folded"), text.number_dashed(t).alias("dashed"), text.number_plain_dashed(t).alias("plain_dashed"), text.number_compatible(t).alias("compatible"))


@query(f"""
SELECT p_partkey, CASE WHEN b = '' THEN n END AS stem, b AS blockers FROM (SELECT p_partkey, n, CASE WHEN n = '' THEN 'missing_drawing_number' ELSE array_to_string(list_filter([
    CASE WHEN regexp_matches(n, '[<>:"/\\\\|?*\\x00-\\x1f]') THEN 'drawing_number_has_illegal_filename_chars' END, CASE WHEN n LIKE '%.' THEN 'drawing_number_has_invalid_trailing_char' END,
    CASE WHEN upper(n) IN ('CON', 'PRN', 'AUX', 'NUL') THEN 'drawing_number_is_windows_reserved_name' END, CASE WHEN len(n) > 180 THEN 'drawing_number_too_long' END], lambda x: x IS NOT NULL), ';') END AS b
FROM (SELECT p_partkey, {PLAIN} AS n FROM (SELECT p_partkey, {PART_TEXT} AS t FROM part)))
""")
def filename_status(spark, sf_dir):
    t = F.col("t")
    return part_texts(spark, sf_dir).select("p_partkey", text.filename_stem(t).alias("stem"), joined(text.filename_blockers(t)).alias("blockers"))


@query(f"""
SELECT p_partkey, trim(regexp_replace(t, '[^A-Za-z0-9_.-]', '_', 'g'), '._') AS safe, trim(regexp_replace(lower(t), '[^a-z0-9_-]', '_', 'g'), '_') AS id,
    substr(trim(regexp_replace(t, '\\s+', ' ', 'g')), 1, 12) AS short FROM (SELECT p_partkey, {PART_TEXT} AS t FROM part)
""")
def safe_names(spark, sf_dir):
    t = F.col("t")
    return part_texts(spark, sf_dir).select("p_partkey", text.safe_name(t).alias("safe"), text.safe_id(t).alias("id"), text.excerpt(t, 12).alias("short"))


@query(f"""
SELECT p_partkey, n AS name, CASE WHEN n <> trim(t) THEN 'filename_changed_by_sanitization' ELSE '' END AS risks
FROM (SELECT p_partkey, t, trim(regexp_replace(regexp_replace(trim(t), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '\\s+', '_', 'g'), ' ._') AS n FROM (SELECT p_partkey, {PART_TEXT} AS t FROM part))
""")
def sanitized_names(spark, sf_dir):
    return part_texts(spark, sf_dir).select("p_partkey", text.sanitized(F.col("t")).alias("s")).select("p_partkey", "s.name", joined("s.risks").alias("risks"))


@query("SELECT o_orderkey, floor(o_totalprice)::INTEGER AS whole, ((o_orderkey % 9) * 90) % 360 AS angle, (360 - ((o_orderkey % 9) * 90) % 360) % 360 AS undo FROM orders")
def degrees(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    angle = text.right_angle(((F.col("o_orderkey") % 9) * 90).cast("string")).cast("long")
    return o.select("o_orderkey", text.whole_number(F.col("o_totalprice").cast("string")).alias("whole"), angle.alias("angle"), text.correction(angle).alias("undo"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'blank' ELSE 'other' END AS verdict FROM events")
def verdict_words(spark, sf_dir):
    k = F.col("event_id") % 5
    said = F.when(k == 0, " 正确").when(k == 1, "有误").when(k == 2, "看不清").when(k == 3, "").otherwise("?")
    return read(spark, sf_dir, "events", "event_id").select("event_id", text.verdict(said, "number").alias("verdict"))


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, 'the') OR contains(text, 'and') THEN 'english' END, CASE WHEN contains(text, 'que') THEN 'french' END, CASE WHEN contains(text, 'sch') THEN 'german' END], lambda x: x IS NOT NULL), ';') AS hits FROM documents
""")
def field_hits(spark, sf_dir):
    groups = {"english": ("the", "and"), "french": ("que",), "german": ("sch",)}
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", joined(numbers.field_hits(F.col("text"), groups)).alias("hits"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.none' AS nothing FROM events")
def json_extract(spark, sf_dir):
    v = F.try_parse_json("props")
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", answers.at(v, "$.k", "long").alias("k"), answers.at(v, "$.none", "string").alias("nothing"))


def responses(spark, sf_dir) -> DataFrame:
    """Chat responses made of events: good, fenced, out of range, broken and failed ones."""
    e, k = read(spark, sf_dir, "events", "event_id", "user_id", "value"), F.col("event_id") % 6
    share = F.when(k == 2, F.lit(2.0)).otherwise(F.round(F.col("value") / 1000, 3))
    side = F.element_at(F.array(*map(F.lit, ("bottom", "top", "left_edge", "right", "unknown", "nowhere"))), (F.col("event_id") % 7 % 6 + 1).cast("int"))
    answer = F.to_json(F.struct(side.alias("title_block_position"), share.alias("confidence"), F.array(F.lit("lines")).alias("evidence"), (k == 4).alias("needs_human_review"), F.array().cast("array<string>").alias("review_reasons")))
    content = F.when(k == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(k == 3, F.concat(F.lit("so: "), answer, F.lit(" ."))).when(k == 5, F.lit("no answer")).otherwise(answer)
    body = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    failed = F.col("event_id") % 11 == 0
    return e.select(
        F.col("event_id").cast("string").alias("task_id"),
        F.concat(F.lit("/in/"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("source_pdf"),
        F.lit(1).alias("page_number"),
        F.lit("model").alias("model"),
        F.lit("orientation").alias("request_kind"),
        F.lit(None).cast("string").alias("endpoint"),
        (~failed).alias("ok"),
        F.when(failed, "500").otherwise("200").alias("http_status"),
        F.lit(1).alias("attempt_count"),
        F.lit("").alias("error_type"),
        F.lit("").alias("error_message"),
        F.when(~failed, body).alias("response_json"),
        F.lit("").alias("response_text"),
    )


@query("""
WITH r AS (SELECT event_id, event_id % 11 = 0 AS failed, event_id % 6 AS k, ['bottom_edge', 'top_edge', 'left_edge', 'right_edge', 'unknown', 'nowhere'][event_id % 7 % 6 + 1] AS side FROM events),
p AS (SELECT *, NOT failed AND k <> 5 AS parsed FROM r),
q AS (SELECT *, CASE WHEN parsed THEN side END AS pos FROM p)
SELECT event_id::VARCHAR AS task_id, NOT failed AS api_ok, CASE WHEN parsed THEN 'ok' ELSE 'error' END AS parse_status, CASE WHEN parsed AND k <> 2 AND side <> 'nowhere' THEN 'ok' ELSE 'error' END AS schema_status,
    pos AS title_block_position, CASE pos WHEN 'bottom_edge' THEN 0 WHEN 'top_edge' THEN 180 WHEN 'left_edge' THEN 270 WHEN 'right_edge' THEN 90 END AS correction_clockwise_degrees,
    array_to_string(list_sort(list_filter([CASE WHEN failed THEN 'api_error:500' END, CASE WHEN failed THEN 'response_not_json_object' END, CASE WHEN NOT failed AND k = 5 THEN 'content_json_parse_failed' END,
        CASE WHEN parsed AND side = 'nowhere' THEN 'invalid_title_block_position' END, CASE WHEN parsed AND k = 2 THEN 'invalid_confidence' END, CASE WHEN parsed AND k = 4 THEN 'model_marked_needs_human_review' END,
        CASE WHEN pos IS NULL THEN 'missing_title_block_position_for_rotation' WHEN pos IN ('unknown', 'nowhere') THEN 'unknown_title_block_position_for_rotation' END], lambda x: x IS NOT NULL)), ';') AS review_reasons
FROM q
""")
def orientation_decisions(spark, sf_dir):
    d = answers.orientation_decisions(responses(spark, sf_dir))
    return d.select("task_id", "api_ok", "parse_status", "schema_status", "title_block_position", "correction_clockwise_degrees", joined("review_reasons").alias("review_reasons"))


# ---- geometry: components of a vector as coordinates, moved into the page

POINTS_SQL = "SELECT vec_id, list_transform([1, 3, 5, 7], lambda i: {'x': least(greatest(embedding[i]::DOUBLE + 0.5, 0), 1), 'y': least(greatest(embedding[i + 1]::DOUBLE + 0.5, 0), 1)}) AS p FROM embeddings"
BOX_SQL = f"SELECT vec_id, list_min(list_transform(p, lambda q: q.x)) AS a, list_min(list_transform(p, lambda q: q.y)) AS b, list_max(list_transform(p, lambda q: q.x)) AS c, list_max(list_transform(p, lambda q: q.y)) AS d FROM ({POINTS_SQL})"
SIDE_SQL = "CASE least(a, 1 - c, b, 1 - d) WHEN a THEN 'left' WHEN 1 - c THEN 'right' WHEN b THEN 'top' ELSE 'bottom' END"


def boxes(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    at = lambda i: F.least(F.greatest(F.col("embedding")[i].cast("double") + 0.5, F.lit(0.0)), F.lit(1.0))
    points = F.array(*(F.struct(at(i).alias("x"), at(i + 1).alias("y")) for i in (0, 2, 4, 6)))
    return e.select("vec_id", points.alias("points")).withColumn("box", geometry.bbox(F.col("points")))


@query(f"SELECT vec_id, round(abs(list_sum(list_transform([1, 2, 3, 4], lambda i: p[i].x * p[i % 4 + 1].y - p[i % 4 + 1].x * p[i].y))) / 2, 9) AS area FROM ({POINTS_SQL})")
def polygon_area(spark, sf_dir):
    return boxes(spark, sf_dir).select("vec_id", F.round(geometry.polygon_area(F.col("points")), 9).alias("area"))


@query(f"SELECT vec_id, {SIDE_SQL} AS side FROM ({BOX_SQL})")
def nearest_side(spark, sf_dir):
    return boxes(spark, sf_dir).select("vec_id", geometry.nearest_side(F.col("box")).alias("side"))


@query(f"""
SELECT vec_id, CASE k WHEN 1 THEN 1 - d WHEN 2 THEN 1 - c WHEN 3 THEN b ELSE a END AS xmin, CASE k WHEN 1 THEN a WHEN 2 THEN 1 - d WHEN 3 THEN 1 - c ELSE b END AS ymin,
    CASE k WHEN 1 THEN 1 - b WHEN 2 THEN 1 - a WHEN 3 THEN d ELSE c END AS xmax, CASE k WHEN 1 THEN c WHEN 2 THEN 1 - b WHEN 3 THEN 1 - a ELSE d END AS ymax FROM (SELECT *, vec_id % 4 AS k FROM ({BOX_SQL}))
""")
def rotate_box(spark, sf_dir):
    return boxes(spark, sf_dir).select("vec_id", geometry.rotated_box(F.col("box"), F.col("vec_id") % 4 * 90).alias("b")).select("vec_id", "b.*")


@query(f"""
SELECT vec_id, CASE WHEN h > 0 AND w >= h * 1.15 THEN CASE WHEN (b + d) / 2 >= 0.5 THEN 'bottom' ELSE 'top' END WHEN w > 0 AND h >= w * 1.15 THEN CASE WHEN (a + c) / 2 >= 0.5 THEN 'right' ELSE 'left' END
    ELSE {SIDE_SQL} END AS side FROM (SELECT *, greatest(c - a, 0) AS w, greatest(d - b, 0) AS h FROM ({BOX_SQL}))
""")
def aspect_position(spark, sf_dir):
    return boxes(spark, sf_dir).select("vec_id", geometry.aspect_position(F.col("box"))["side"].alias("side"))


@query(f"""
SELECT vec_id, CASE g WHEN l THEN 'left' WHEN r THEN 'right' WHEN t THEN 'top' ELSE 'bottom' END AS nearest_frame_side, g AS frame_contact_gap, greatest(least(1 - g / 0.025, 1), 0) AS frame_contact_score, g <= 0.025 AS touches_frame_line,
    CASE WHEN g <= 0.025 THEN 'contact' ELSE 'gap' END AS frame_contact_status
FROM (SELECT *, least(l, r, t, CASE WHEN vec_id % 2 = 0 THEN u ELSE 9 END) AS g FROM (SELECT vec_id, abs(a - 0.3) AS l, abs(c - 0.7) AS r, abs(b - 0.3) AS t, abs(d - 0.7) AS u FROM ({BOX_SQL})))
""")
def frame_contact(spark, sf_dir):
    frame = F.struct(F.lit(0.3).alias("left"), F.lit(0.7).alias("right"), F.lit(0.3).alias("top"), F.when(F.col("vec_id") % 2 == 0, F.lit(0.7)).alias("bottom"))
    return boxes(spark, sf_dir).select("vec_id", geometry.frame_contact(F.col("box"), frame).alias("f")).select("vec_id", "f.nearest_frame_side", "f.frame_contact_gap", "f.frame_contact_score", "f.touches_frame_line", "f.frame_contact_status")


@query("SELECT p_partkey, CASE WHEN h > w THEN 0.35 ELSE 0.30 END::DOUBLE AS ratio, floor(h * (1.0::DOUBLE - CASE WHEN h > w THEN 0.35 ELSE 0.30 END::DOUBLE))::INTEGER AS y0 FROM (SELECT p_partkey, (p_size * 40 + 7)::INTEGER AS w, (p_partkey % 2000 + 100)::INTEGER AS h FROM part)")
def bottom_crop(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", (F.col("p_size") * 40 + 7).cast("int").alias("w"), (F.col("p_partkey") % 2000 + 100).cast("int").alias("h"))
    return p.select("p_partkey", geometry.bottom_crop(F.col("w"), F.col("h")).alias("c")).select("p_partkey", "c.ratio", F.col("c.box.ymin").alias("y0"))


@query(f"""
WITH p AS ({POINTS_SQL}), b AS (SELECT * FROM p JOIN ({BOX_SQL}) USING (vec_id)),
e AS (SELECT vec_id, list_min(list_transform(list_reverse_sort(list_filter(list_transform([1, 2, 3, 4], lambda i: {{'l': sqrt(pow(p[i % 4 + 1].x - p[i].x, 2) + pow(p[i % 4 + 1].y - p[i].y, 2)),
        'o': least(abs(degrees(atan2(p[i % 4 + 1].y - p[i].y, p[i % 4 + 1].x - p[i].x))) % 90.0, 90.0 - abs(degrees(atan2(p[i % 4 + 1].y - p[i].y, p[i % 4 + 1].x - p[i].x))) % 90.0)}}), lambda x: x.l > 0))[1:2], lambda x: x.o)) AS lean,
    abs(list_sum(list_transform([1, 2, 3, 4], lambda i: p[i].x * p[i % 4 + 1].y - p[i % 4 + 1].x * p[i].y))) / 2 AS area FROM p),
f AS (SELECT vec_id, vec_id // 4 AS page, vec_id % 4 AS candidate_index, (vec_id % 10) / 10 AS conf, lean, area, least(abs(a - 0.3), abs(c - 0.7), abs(b - 0.3)) AS gap, least(a, b, 1 - c, 1 - d) AS edge,
    (a + c) / 2 BETWEEN 0.2 AND 0.8 AND (b + d) / 2 BETWEEN 0.2 AND 0.8 AS centre, area NOT BETWEEN 0.001 AND 0.2 AS odd, vec_id % 5 = 0 AS uniform FROM b JOIN e USING (vec_id)),
g AS (SELECT *, gap <= 0.025 AS touches, edge <= 0.12 AS near, greatest(least(1 - gap / 0.025, 1), 0) AS contact FROM f),
h AS (SELECT *, (touches AND near)::INTEGER * 0.08 + (touches AND NOT uniform AND contact >= 0.65)::INTEGER * 0.04 - uniform::INTEGER * 0.12 + (touches AND near AND NOT uniform AND coalesce(lean <= 5, false))::INTEGER * 0.03 AS extra FROM g),
s AS (SELECT *, conf + 0.25 * greatest(least(1 - greatest(edge, 0) / 0.12, 1), 0) + 0.25 * contact + 0.2 * greatest(least(1 - abs(area - 0.04) / 0.04, 1), 0) - centre::INTEGER * 0.55 - odd::INTEGER * 0.5 + extra AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, candidate_index) = 1 AS selected FROM s)
SELECT page, candidate_index, round(score, 6)::DOUBLE AS candidate_score, selected,
    array_to_string(list_filter([CASE WHEN centre THEN 'center_region' END, CASE WHEN odd THEN 'size_abnormal' END, CASE WHEN near THEN 'near_edge' END, CASE WHEN touches THEN 'touches_frame_line' ELSE 'frame_contact_gap' END, CASE WHEN uniform THEN 'uniform_grid_like' END], lambda x: x IS NOT NULL), ';') AS flags,
    CASE WHEN selected THEN '' ELSE array_to_string(list_filter(['not_selected_by_single_title_block_rule', 'lower_score_duplicate_or_neighbor', CASE WHEN uniform THEN 'uniform_grid_like' END, CASE WHEN uniform THEN 'teacher_uniform_table_negative' END,
        CASE WHEN centre AND NOT touches THEN 'center_region_without_frame_contact' END, CASE WHEN odd THEN 'size_abnormal' END], lambda x: x IS NOT NULL), ';') END AS rejection_reasons
FROM r
""")
def candidate_scores(spark, sf_dir):
    """Scores, flags and the choice among four candidates a page."""
    frame = F.struct(F.lit(0.3).alias("left"), F.lit(0.7).alias("right"), F.lit(0.3).alias("top"), F.lit(None).cast("double").alias("bottom"))
    rows = boxes(spark, sf_dir).select(
        (F.col("vec_id") / 4).cast("long").alias("page"),
        (F.col("vec_id") % 4).alias("candidate_index"),
        "points",
        "box",
        geometry.polygon_area(F.col("points")).alias("area"),
        (F.col("vec_id") % 10 / 10).alias("confidence"),
        geometry.frame_contact(F.col("box"), frame).alias("contact"),
        geometry.axis_offset(F.col("points")).alias("axis_offset"),
        F.when(F.col("vec_id") % 3 == 0, 0.9).alias("cell_area_variance"),
        F.lit(0.85).alias("small_large_mix"),
        F.lit(0.0).alias("uniform_grid_penalty"),
        F.when(F.col("vec_id") % 5 == 0, F.array(F.lit("uniform_grid_like"))).otherwise(F.array().cast("array<string>")).alias("diagnostic_flags"),
    )
    scored = rank.top1_with_rejects(rules.score_candidates(rows), ["page"], "candidate_score", ["candidate_index"])
    reasons = F.when(~F.col("selected"), joined(rules.rejection_reasons(F.col("candidate_flags"), F.col("teacher_rule_flags"), F.lit(False)))).otherwise("")
    return scored.select("page", "candidate_index", F.round("candidate_score", 6).alias("candidate_score"), "selected", joined("candidate_flags").alias("flags"), reasons.alias("rejection_reasons"))


@query(f"""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN held OR apart THEN 'human_review' END, CASE WHEN NOT held AND NOT apart THEN 'auto_accept' END, CASE WHEN (held OR apart) AND conf < 0.5 AND NOT big THEN 'vlm_candidate' END, CASE WHEN fp THEN 'retrain_candidate' END], lambda x: x IS NOT NULL), ';') AS routes
FROM (SELECT *, o_orderstatus = 'P' OR fp OR big AS held, NOT (o_orderstatus = 'P' OR fp OR big) AND o_orderkey % 4 = 0 AS apart
    FROM (SELECT o_orderkey, o_orderstatus, o_totalprice / 400000 AS conf, o_orderpriority LIKE '1%' AS fp, o_totalprice > 300000 AS big FROM orders))
""")
def route_multilabel(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    issues = text.labels((F.col("o_orderpriority").startswith("1"), "part_false_positive"), (F.col("o_totalprice") > 300000, "boundary_too_large"))
    gap, none = F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>")
    selected = F.struct((F.col("o_totalprice") / 400000).alias("confidence"), none.alias("candidate_flags"), none.alias("diagnostic_flags"), (~gap).alias("touches_frame_line"), F.when(gap, "gap").otherwise("contact").alias("frame_contact_status"))
    routes = rules.record_routes(F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("accepted"), issues, selected, F.lit(False), F.lit(""))
    return o.select("o_orderkey", joined(routes["routes"]).alias("routes"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'needs_human_review' WHEN o_orderkey % 5 = 0 THEN 'needs_vlm' WHEN o_orderkey % 3 = 0 THEN 'needs_human_review' WHEN o_totalprice > 300000 THEN 'needs_human_review' ELSE 'auto_accept' END AS decision_status,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_totalprice <= 300000 AND o_totalprice / 250000 >= 0.8 THEN 'high'
    WHEN o_orderstatus = 'F' AND (o_orderkey % 5 = 0 OR (o_orderkey % 3 <> 0 AND o_totalprice <= 300000)) AND o_totalprice / 250000 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level FROM orders
""")
def arbitration(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    issues = text.labels((F.col("o_totalprice") > 300000, "boundary_too_large"))
    conflicts = text.labels((F.col("o_orderkey") % 5 == 0, "yolo_opencv_position_conflict:left:right"))
    selected = F.struct((F.col("o_orderkey") % 3 != 0).alias("touches_frame_line"))
    a = rules.arbitration(F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("needs_review"), selected, issues, conflicts, F.array().cast("array<string>"), F.col("o_totalprice") / 250000)
    return o.select("o_orderkey", a["decision_status"].alias("decision_status"), a["confidence_level"].alias("confidence_level"))


@query("""
WITH r AS (SELECT event_id, user_id, value, event_id % 11 = 0 AS failed, event_id % 6 AS k, ['bottom_edge', 'top_edge', 'left_edge', 'right_edge', 'unknown', 'nowhere'][event_id % 7 % 6 + 1] AS side FROM events),
p AS (SELECT *, NOT failed AND k <> 5 AS parsed FROM r),
q AS (SELECT *, CASE WHEN parsed THEN side END AS pos, parsed AND k <> 2 AND side <> 'nowhere' AS fine FROM p),
d AS (SELECT *, CASE pos WHEN 'bottom_edge' THEN 0 WHEN 'top_edge' THEN 180 WHEN 'left_edge' THEN 270 WHEN 'right_edge' THEN 90 END AS undo,
    list_sort(list_filter([CASE WHEN failed THEN 'api_error:500' END, CASE WHEN failed THEN 'response_not_json_object' END, CASE WHEN NOT failed AND k = 5 THEN 'content_json_parse_failed' END,
        CASE WHEN parsed AND side = 'nowhere' THEN 'invalid_title_block_position' END, CASE WHEN parsed AND k = 2 THEN 'invalid_confidence' END, CASE WHEN parsed AND k = 4 THEN 'model_marked_needs_human_review' END,
        CASE WHEN pos IS NULL THEN 'missing_title_block_position_for_rotation' WHEN pos IN ('unknown', 'nowhere') THEN 'unknown_title_block_position_for_rotation' END], lambda x: x IS NOT NULL)) AS reasons FROM q),
o AS (SELECT *, list_filter([CASE WHEN failed THEN 'api_not_ok' END, CASE WHEN NOT parsed THEN 'parse_not_ok' END, CASE WHEN NOT fine THEN 'schema_not_ok' END, CASE WHEN undo IS NULL THEN 'missing_or_invalid_correction_degrees' END], lambda x: x IS NOT NULL) AS held FROM d),
n AS (SELECT *, len(held) = 0 AS turned, CASE WHEN len(held) = 0 THEN 'JS-' || event_id % 500 ELSE '' END AS number FROM o),
t AS (SELECT *, turned AND count(*) FILTER (WHERE turned) OVER (PARTITION BY user_id, number) > 1 AS taken FROM n),
f AS (SELECT *, list_filter([CASE WHEN taken THEN 'duplicate_drawing_number' END, CASE WHEN NOT turned THEN 'missing_drawing_number_decision' END, CASE WHEN NOT turned THEN 'missing_final_filename_stem' END,
    CASE WHEN len(reasons) > 0 THEN 'rotation_decision_needs_review' END, CASE WHEN NOT turned THEN 'rotation_output_not_corrected' END], lambda x: x IS NOT NULL) AS blocked FROM t)
SELECT '/in/' || user_id || '.pdf' AS source_pdf, 1 AS page_number, CASE WHEN len(blocked) = 0 THEN '/out/' || user_id || '/' || number || '.pdf' ELSE '/out/' || user_id || '/needs_review/' || event_id || '.pdf' END AS final_pdf_path,
    CASE WHEN len(blocked) = 0 THEN 'published' ELSE 'needs_review' END AS final_status, number AS drawing_number, number AS final_filename_stem, '/work/out/' || event_id || '.pdf' AS corrected_pdf_path,
    CASE WHEN turned THEN 'corrected' ELSE 'copied_needs_review' END AS output_status, coalesce(pos, '') AS title_block_position, coalesce(((360 - undo) % 360)::VARCHAR, '') AS current_clockwise_degrees, coalesce(undo::VARCHAR, '') AS correction_clockwise_degrees,
    CASE WHEN NOT parsed THEN '' WHEN k = 2 THEN '2.0' ELSE round(value / 1000, 3)::DOUBLE::VARCHAR END AS confidence, CASE WHEN failed THEN 'false' ELSE 'true' END AS api_ok, CASE WHEN parsed THEN 'ok' ELSE 'error' END AS parse_status,
    CASE WHEN fine THEN 'ok' ELSE 'error' END AS schema_status, CASE WHEN turned THEN 'true' ELSE '' END AS drawing_number_api_ok, CASE WHEN turned THEN 'ok' ELSE '' END AS drawing_number_parse_status,
    CASE WHEN turned THEN 'ok' ELSE '' END AS drawing_number_schema_status, CASE WHEN turned THEN '0.9' ELSE '' END AS drawing_number_confidence, CASE WHEN len(blocked) = 0 THEN 'false' ELSE 'true' END AS needs_review,
    array_to_string(reasons, ';') AS review_reasons, '' AS drawing_number_review_reasons, array_to_string(held, ';') AS output_blockers, array_to_string(blocked, ';') AS final_blockers
FROM f
""")
def publish_run(spark, sf_dir):
    """A whole run over recorded answers: the report of every page."""
    from vellumen.plans import lifecycle

    raw = responses(spark, sf_dir)
    number = F.to_json(F.struct(F.concat(F.lit("JS-"), (F.col("task_id").cast("long") % 500).cast("string")).alias("selected_drawing_number"), F.array().cast("array<string>").alias("candidates"), F.lit(0.9).alias("confidence"), F.array().cast("array<string>").alias("evidence"), F.lit(False).alias("needs_human_review"), F.array().cast("array<string>").alias("review_reasons")))
    asked = raw.where("ok").withColumn("request_kind", F.lit("drawing_number")).withColumn("response_json", F.to_json(F.struct(F.array(F.struct(F.struct(number.alias("content")).alias("message"))).alias("choices"))))
    path = lambda folder, ext: F.concat(F.lit(f"/work/{folder}/"), F.col("task_id"), F.lit(ext))
    pages = raw.select("task_id", "source_pdf", text.file_stem(F.col("source_pdf")).alias("source_stem"), "page_number", path("split", ".pdf").alias("split_pdf_path"), path("out", ".pdf").alias("output_pdf_path"))
    return lifecycle.run(pages, "model", lifecycle.Replay(raw.unionByName(asked)), "/out").report


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def outcome_windows(spark, sf_dir):
    from vellumen.streaming.memory import outcome_counts

    return outcome_counts(read(spark, sf_dir, "events", "ts", "event_type"), "ts", "event_type")
