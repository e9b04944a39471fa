"""Queries that put records together, and that write files and read them again, and SQL for the same rows."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumen.functions import text
from vellumen.operators import metrics, rank, relate
from vellumen.plans import lifecycle, records
from vellumen.plans.queries import ANSWERED, VERDICT_SQL, answered, joined, query, read, responses, verdicts
from vellumen.plans.queries_pages import rounded, texts
from vellumen.plans.queries_text import judged, picked, picked_sql, taught
from vellumen.sources import files, sinks, xlsx


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, in a local session without it, a temporary one."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="vellumen-")
    return f"{named.rstrip('/')}/queries/{uuid.uuid4().hex}"


def on_driver(path: str) -> Path:
    """The folder as the driver's own path, made; what people read is written there."""
    out = Path(path.removeprefix("file://").removeprefix("file:"))
    out.mkdir(parents=True, exist_ok=True)
    return out


# ---- choices, lookups and indexes with repeated keys


@query("""
WITH t AS (SELECT o_custkey AS k, max(o_totalprice) AS price FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(price, -1) AS price, price IS NOT NULL AS matched FROM customer LEFT JOIN t ON c_custkey = k
""")
def last_of_repeated_keys(spark, sf_dir):
    """Lookup sides in which keys repeat: the last by all other columns counts, and no row is doubled."""
    side = read(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"))
    people = read(spark, sf_dir, "customer", "c_custkey")
    filled = relate.left_default(people, side, ["c_custkey"], {"price": -1.0})
    hit, missing = relate.match_split(people, side, ["c_custkey"])
    found = relate.require_match(hit.select("c_custkey"), side, ["c_custkey"]).select("c_custkey", F.lit(True).alias("matched"))
    return filled.join(found.unionByName(missing.select("c_custkey", F.lit(False).alias("matched"))), "c_custkey")


@query("""
WITH r AS (SELECT user_id, event_id, event_type = 'error' AS bad FROM events),
f AS (SELECT user_id, min(event_id) AS event_id FROM r WHERE bad GROUP BY 1), c AS (SELECT user_id, event_id FROM r WHERE NOT bad ORDER BY event_id LIMIT 50)
SELECT user_id, event_id, 'failure' AS case_kind FROM f UNION ALL SELECT user_id, min(event_id), 'positive_control' FROM c WHERE user_id NOT IN (SELECT user_id FROM f) GROUP BY user_id
""")
def failures_before_controls(spark, sf_dir):
    """Keys with failures and successes: a failure goes before its control."""
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    return rank.failures_and_controls(e, F.col("event_type") != "error", 50, ["event_id"], ["user_id"]).select("user_id", "event_id", "case_kind")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 10 IN (3, 4) THEN 'val' WHEN p_partkey % 10 = 5 THEN 'test' ELSE 'train' END AS split, CASE WHEN p_partkey % 10 = 4 THEN 'focus' WHEN p_partkey % 10 IN (8, 9) THEN 'val' WHEN p_partkey % 10 = 0 THEN 'test_focus' ELSE 'train' END AS special,
    p_partkey % 10 = 7 OR p_partkey % 6 = 0 AS hard, p_partkey % 4 = 1 AS flagged FROM part
""")
def memberships(spark, sf_dir):
    """Splits by lists and by digits with exceptions, hard cases and rows that a person objected to."""
    k = F.col("p_partkey")
    sample = F.concat(F.lit("s"), (k % 10).cast("string"))
    p = read(spark, sf_dir, "part", "p_partkey").select("p_partkey", sample.alias("sample"), F.when(k % 6 == 0, texts("a", "retrain_candidate")).otherwise(texts("a")).alias("routes"), picked(k, "正确", " 错误 ", "", None).alias("verdict"))
    hard = rank.hard_cases(p, "sample", ["s7"], "routes").select("p_partkey", F.lit(True).alias("hard"))
    told = rank.flagged(p, "verdict").select("p_partkey", F.lit(True).alias("flagged"))
    out = p.select("p_partkey", rank.by_membership(F.col("sample"), {"val": ["s3", "s4"], "test": ["s4", "s5"]}, "train").alias("split"), rank.special_first(F.col("sample"), {"s4": "focus"}, rank.split_by_digit(k, {8: "val", 9: "val", 0: "test_focus"}, "train")).alias("special"))
    out = out.join(hard, "p_partkey", "left").join(told, "p_partkey", "left")
    return out.select("p_partkey", "split", "special", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("hard", "flagged")))


@query("SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_totalprice DESC, o_orderkey) AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey) WHERE n <= 3 GROUP BY c_custkey")
def best_items(spark, sf_dir):
    """The three largest of an array of structs that each row holds; of equals those that come first."""
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice").join(read(spark, sf_dir, "customer", F.col("c_custkey").alias("o_custkey")), "o_custkey")
    items = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("items"))
    return items.select("c_custkey", F.array_join(F.transform(rank.best_items(F.col("items"), "o_totalprice", 3), lambda x: x["o_orderkey"].cast("string")), ";").alias("best"))


@query("""
SELECT 'aug_' || p_partkey AS sample, 'part_' || p_partkey AS source_sample, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS source_size FROM part
""")
def sources_of_made_rows(spark, sf_dir):
    """Rows that were made from others of the same table, with what those hold; half of the sources are gone."""
    p, key = read(spark, sf_dir, "part", "p_partkey", "p_size"), F.col("p_partkey").cast("string")
    own = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("part_"), key).alias("sample"), F.lit(None).cast("string").alias("source_sample"), F.col("p_size").alias("size"))
    made = p.select(F.concat(F.lit("aug_"), key).alias("sample"), F.concat(F.lit("part_"), key).alias("source_sample"), F.lit(None).cast(own.schema["size"].dataType).alias("size"))
    return relate.from_sources(own.unionByName(made), "sample", "source_sample").select("sample", "source_sample", "source_size")


@query("SELECT user_id, string_agg(event_type || '=' || e, ';' ORDER BY event_type) AS index FROM (SELECT user_id, event_type, max(event_id) AS e FROM events GROUP BY ALL) GROUP BY user_id")
def nested_indexes(spark, sf_dir):
    i = relate.nested_index(read(spark, sf_dir, "events", "user_id", "event_type", "event_id"), "user_id", "event_type")
    return i.select("user_id", F.array_join(F.transform(F.map_entries("index"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["event_id"].cast("string"))), ";").alias("index"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, min(event_id) AS place FROM events GROUP BY user_id, event_type")
def last_in_first_place(spark, sf_dir):
    return relate.last_in_first_place(read(spark, sf_dir, "events", "user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("SELECT n_nationkey, n_name, c_name FROM nation JOIN (SELECT c_nationkey AS n_nationkey, min(c_name) AS c_name FROM customer GROUP BY 1 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) USING (n_nationkey)")
def same_keys(spark, sf_dir):
    """Two tables that must hold the same keys, joined."""
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    c = n.select("n_nationkey").join(read(spark, sf_dir, "customer", F.col("c_nationkey").alias("n_nationkey"), "c_name").groupBy("n_nationkey").agg(F.min("c_name").alias("c_name")), "n_nationkey", "left")
    return relate.same_count_join(n, c, "n_nationkey")


# ---- accuracies


@query(f"SELECT lang, 'error' AS kind, doc_id AS id FROM ({ANSWERED}) WHERE NOT ok UNION ALL SELECT lang, 'review', doc_id FROM ({ANSWERED}) WHERE toxic = 1")
def accuracy_ids(spark, sf_dir):
    return metrics.accuracy_ids(answered(spark, sf_dir), F.col("ok"), F.col("toxic") == 1, "doc_id", ["lang"])


@query(f"""
WITH v AS ({VERDICT_SQL.replace(" FROM events", ", event_id FROM events")}),
m AS (SELECT model, count(*) AS total, count(*) FILTER (WHERE trim(verdict) <> '') AS reviewed, count(*) FILTER (WHERE trim(verdict) = 'correct') AS correct, coalesce(string_agg(event_id::VARCHAR, ';' ORDER BY event_id) FILTER (WHERE trim(verdict) = 'wrong'), '') AS wrong_pages,
    coalesce(string_agg(event_id::VARCHAR, ';' ORDER BY event_id) FILTER (WHERE coalesce(trim(verdict), '') = ''), '') AS blank_pages FROM v GROUP BY model)
SELECT model, correct::DOUBLE / total AS accuracy, wrong_pages, blank_pages, row_number() OVER (ORDER BY correct::DOUBLE / total DESC, correct DESC, model DESC) AS rank FROM m
""")
def model_ranking(spark, sf_dir):
    """Models by accuracy, with the pages that are wrong and blank."""
    e, k = read(spark, sf_dir, "events", "event_id", "event_type"), F.col("event_id") % 4
    v = e.select(F.col("event_type").alias("model"), "event_id", F.when(k == 0, "correct").when(k == 1, "wrong").when(k == 2, " ").alias("verdict"))
    return metrics.model_ranking(v, "model", "event_id", "verdict").select("model", "accuracy", joined("wrong_pages").alias("wrong_pages"), joined("blank_pages").alias("blank_pages"), "rank")


@query(f"SELECT model, count(*) AS total, count(*) FILTER (WHERE trim(verdict) <> '') AS reviewed, (count(*) FILTER (WHERE trim(verdict) = 'correct'))::DOUBLE / nullif(count(*) FILTER (WHERE trim(verdict) <> ''), 0) AS accuracy FROM ({VERDICT_SQL}) WHERE user_id % 5 <> 0 GROUP BY model")
def model_accuracy_without_risks(spark, sf_dir):
    return metrics.model_accuracy(verdicts(spark, sf_dir), "model", "verdict", reviewed_only=True, risky=F.col("user_id") % 5 == 0).select("model", "total", "reviewed", "accuracy")


@query("""
SELECT user_id, bool_or(event_id % 9 = 0) AS needs_attention, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY user_id
""")
def page_attention(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts")
    return metrics.page_pivot(e, ["user_id"], "event_type", "event_id", ["ts", "event_id"], F.col("event_id") % 9 == 0).select("user_id", "needs_attention", F.size("values").cast("long").alias("n"))


@query("""
WITH d AS (SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)), j AS (SELECT *, lang = 'en' AS a, quality = 1 AS b FROM d)
SELECT count(*) AS total, count(*) FILTER (WHERE a) AS ours_match, count(*) FILTER (WHERE b) AS theirs_match, count(*) FILTER (WHERE a AND b) AS three_way_agree, coalesce(round_even((count(*) FILTER (WHERE a))::DOUBLE / count(*), 6), 0) AS our_rate,
    coalesce(round_even((count(*) FILTER (WHERE b))::DOUBLE / count(*), 6), 0) AS their_rate, count(*) FILTER (WHERE a AND NOT b) AS corrections, coalesce(string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id) FILTER (WHERE a AND NOT b), '') AS corrected_samples,
    coalesce(string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id) FILTER (WHERE a AND b AND toxic = 1), '') AS unsure_samples FROM j
""")
def three_way(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    out = records.three_way(d, F.col("lang") == "en", F.col("quality") == 1, F.lit(True), F.col("toxic") == 1, "doc_id")
    return out.withColumn("corrected_samples", joined("corrected_samples")).withColumn("unsure_samples", joined("unsure_samples"))


POSITIONS = ("bottom_edge", "right_edge", "top_left", "nowhere")
DECIDED_SQL = f"""
SELECT event_id AS page_number, event_type AS model, {picked_sql("event_id", *POSITIONS)} AS predicted, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE {picked_sql("event_id", "bottom_right", "right_edge", "bottom_edge", "nowhere")} END AS expected,
    {picked_sql("event_id", 0, 270, 180, None)} AS mine, CASE WHEN event_id % 7 <> 0 THEN {picked_sql("event_id", 0, 270, 0, None)} END AS theirs FROM events
"""


def decided(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    e = read(spark, sf_dir, "events", "event_id", "event_type")
    decisions = e.select(k.alias("page_number"), F.col("event_type").alias("model"), F.concat(F.lit(" "), picked(k, *POSITIONS)).alias("title_block_position"))
    truth = e.where(k % 7 != 0).select(k.alias("page_number"), picked(k, "bottom_right", "right_edge", "bottom_edge", "nowhere").alias("expected_position"))
    return records.decision_against_truth(decisions, truth)


@query(f"SELECT page_number, model, expected AS expected_position, predicted AS predicted_position, predicted = expected AS exact_match, coalesce(mine = theirs, predicted = expected) AS rotation_group_match FROM ({DECIDED_SQL})")
def decisions_and_truth(spark, sf_dir):
    return decided(spark, sf_dir).drop("expected_rotation_group", "predicted_rotation_group")


@query(f"""
SELECT model, count(*) AS total, round_even((count(*) FILTER (WHERE predicted = expected))::DOUBLE / count(*), 4) AS exact_accuracy, round_even((count(*) FILTER (WHERE coalesce(mine = theirs, predicted = expected)))::DOUBLE / count(*), 4) AS rotation_accuracy,
    CASE model WHEN 'click' THEN round_even(round_even((count(*) FILTER (WHERE predicted = expected))::DOUBLE / count(*), 4) - 0.25::DOUBLE, 4) END AS exact_change FROM ({DECIDED_SQL}) GROUP BY model
""")
def retests(spark, sf_dir):
    return records.retest_summary(decided(spark, sf_dir), {"click": 0.25})


@query(f"""
SELECT count(*) AS record_count, coalesce(string_agg(DISTINCT source, ';' ORDER BY source) FILTER (WHERE NOT ok), '') AS quality_error_samples, coalesce(string_agg(DISTINCT source, ';' ORDER BY source) FILTER (WHERE toxic = 1), '') AS clean_error_samples FROM ({ANSWERED})
""")
def evaluation_samples(spark, sf_dir):
    """The samples that fail each test of an evaluation."""
    s = metrics.evaluation_summary(answered(spark, sf_dir), "source", {"quality": F.col("ok"), "clean": F.col("toxic") == 0})
    return s.select("record_count", joined("quality_error_samples").alias("quality_error_samples"), joined("clean_error_samples").alias("clean_error_samples"))


# ---- calibration memory

NUMBERS = ("JS-1", "JS-2", "", None)
CALIBRATED_SQL = f"""
SELECT event_id, 'S:' || event_id AS id, {picked_sql("event_id", "正确", "错误", "未识别", "看不清", "?")} AS said, {picked_sql("event_id", "JS-7", "", "js_8 ", "JS-9")} AS manual, coalesce({picked_sql("event_id", *NUMBERS)}, '') AS fine, {picked_sql("event_id", "JS-C", "")} AS coarse FROM events
"""
OUTCOME_SQL = f"""
SELECT *, CASE WHEN said = '正确' THEN 'machine_confirmed' WHEN said = '错误' AND number <> '' THEN 'manual_corrected' WHEN said = '未识别' AND number <> '' THEN 'manual_supplied_missing' WHEN said IN ('看不清', '错误', '未识别') OR number = '' THEN 'unresolved_requires_manual_identification'
    ELSE 'manual_override_without_standard_judgment' END AS outcome FROM (SELECT *, CASE manual WHEN 'js_8 ' THEN 'JS-8' ELSE manual END AS number, coalesce(nullif(fine, ''), nullif(coarse, '')) AS machine FROM ({CALIBRATED_SQL}))
"""


def calibrated(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    e = read(spark, sf_dir, "events", "event_id")
    form = e.select(k.cast("string").alias("sample_id"), F.when(k % 2 == 0, "范围太大").otherwise("正确").alias("roi_judgment"), picked(k, "正确", "错误", "未识别", "看不清", "?").alias("number_judgment"), picked(k, "JS-7", "", "js_8 ", "JS-9").alias("manual_number"), F.when(k % 3 == 0, "上侧减少").alias("note"))
    machine = e.select(k.cast("string").alias("sample_id"), picked(k, *NUMBERS).alias("fine_candidate"), F.lit("0.5").alias("fine_score"), picked(k, "JS-C", "").alias("coarse_candidate"), F.lit("x").alias("coarse_score"))
    return records.calibration_events(form, machine, "S")


@query(f"""
SELECT id AS event_id, outcome AS calibration_outcome, CASE WHEN outcome = 'machine_confirmed' THEN machine WHEN outcome LIKE 'manual_%' THEN number END AS final_drawing_number, number AS manual_confirmed, fine AS machine_fine, coarse AS machine_coarse, 0.5::DOUBLE AS machine_fine_score,
    NULL::DOUBLE AS machine_coarse_score, array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN 'roi_too_large' END, CASE WHEN event_id % 3 = 0 THEN 'trim_top' END], lambda x: x IS NOT NULL), ';') AS tags FROM ({OUTCOME_SQL})
""")
def calibration_events(spark, sf_dir):
    return calibrated(spark, sf_dir).select("event_id", "calibration_outcome", "final_drawing_number", "manual_confirmed", "machine_fine", "machine_coarse", "machine_fine_score", "machine_coarse_score", joined("roi_note_tags").alias("tags"))


#: All numbers are JS- and a character, so that a confusion is of that one; what is confirmed or open has none.
CONFUSED_SQL = f"SELECT machine[4:4] || '->' || number[4:4] AS value, count(*) AS n FROM ({OUTCOME_SQL}) WHERE outcome LIKE 'manual_%' AND machine IS NOT NULL AND number <> '' AND machine <> number GROUP BY 1"


@query(f"""
SELECT 'confusion' AS dimension, value, n FROM ({CONFUSED_SQL}) UNION ALL
SELECT 'drawing_number_judgment_code', CASE said WHEN '正确' THEN 'correct' WHEN '错误' THEN 'incorrect' WHEN '未识别' THEN 'missing' WHEN '看不清' THEN 'uncertain' ELSE 'other' END, count(*) FROM ({OUTCOME_SQL}) GROUP BY said UNION ALL
SELECT 'calibration_outcome', outcome, count(*) FROM ({OUTCOME_SQL}) GROUP BY outcome UNION ALL SELECT 'fine_roi_judgment_code', CASE WHEN event_id % 2 = 0 THEN 'too_large' ELSE 'correct' END, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'roi_note_tags', 'roi_too_large', count(*) FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'roi_note_tags', 'trim_top', count(*) FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'roi_adjustment_suggestions', '上侧适度收窄', count(*) FROM events WHERE event_id % 3 = 0
""")
def memory_patterns(spark, sf_dir):
    return records.memory_patterns(calibrated(spark, sf_dir))


@query(f"""
SELECT count(*) AS events, count(*) FILTER (WHERE outcome <> 'unresolved_requires_manual_identification') AS resolved, count(*) FILTER (WHERE outcome = 'machine_confirmed') AS confirmed,
    round_even((count(*) FILTER (WHERE outcome = 'machine_confirmed'))::DOUBLE / count(*) FILTER (WHERE outcome <> 'unresolved_requires_manual_identification'), 6) AS confirmed_rate FROM ({OUTCOME_SQL})
""")
def confirmed_rates(spark, sf_dir):
    return records.confirmed_rate(calibrated(spark, sf_dir))


@query(f"""
WITH g AS (SELECT 'roi-too-large-quality-gate' AS rule_id, 'roi_feedback' AS type, 'roi_too_large' AS value, count(*) FILTER (WHERE event_id % 2 = 0) AS support FROM events HAVING count(*) FILTER (WHERE event_id % 2 = 0) >= 0.5 * count(*))
SELECT * FROM g UNION ALL SELECT 'roi-adjustment-' || (1 + (SELECT count(*) FROM g)), 'roi_adjustment', '上侧适度收窄', count(*) FROM events WHERE event_id % 3 = 0 UNION ALL
SELECT 'ocr-confusion-' || (1 + (SELECT count(*) FROM g) + row_number() OVER (ORDER BY n DESC, value)), 'ocr_candidate_diff', value, n FROM ({CONFUSED_SQL}) UNION ALL SELECT 'manual-fallback-required', 'fallback', '', count(*) FROM ({OUTCOME_SQL}) WHERE outcome = 'unresolved_requires_manual_identification'
""")
def transplantable_rules(spark, sf_dir):
    return records.transplantable_rules(calibrated(spark, sf_dir))


@query(f"SELECT id AS event_id, event_id::VARCHAR AS sample_id, outcome AS calibration_outcome FROM ({OUTCOME_SQL}) WHERE event_id % 2 = 0")
def session_rows(spark, sf_dir):
    every = calibrated(spark, sf_dir).withColumn("review_session_id", F.when(F.col("sample_id").cast("long") % 2 == 0, "S").otherwise("T"))
    return records.session_rows(every, "S").select("event_id", "sample_id", "calibration_outcome")


# ---- truth, data sets, requests


@query(f"""
SELECT p_partkey::VARCHAR AS sample, {picked_sql("p_partkey", 90, 180)} AS rotation_degrees, {picked_sql("p_partkey", "manual_review", "consensus_accepted", "unknown")} AS source_level, coalesce({picked_sql("p_partkey", "manual_review_1", "opencv_mcp_consensus_accepted", None)}, '') AS source_basis, p_partkey % 3 = 0 AS verified_by_human,
    CASE WHEN p_partkey % 3 = 0 THEN '{records.HUMAN}' ELSE '{records.AGREED}' END AS note FROM part
""")
def ground_truth(spark, sf_dir):
    k = F.col("p_partkey")
    items = read(spark, sf_dir, "part", "p_partkey").select(k.cast("string").alias("sample"), F.lit("left").alias("title_block_position"), picked(k, "90", "180").alias("rotation_degrees"), picked(k, "manual_review_1", "opencv_mcp_consensus_accepted", None).alias("basis"))
    return records.ground_truth(items).drop("title_block_position")


@query("""
SELECT printf('aug90_%03d_from_', n) || n_name AS sample, n_name AS source_sample, (n_nationkey % 4) * 90 AS source_rotation_degrees, ((90 - (n_nationkey % 4) * 90) % 360 + 360) % 360 AS applied_clockwise_rotation_degrees, 90 AS rotation_degrees, n_name AS source
FROM (SELECT *, row_number() OVER (ORDER BY n_name DESC) AS n FROM nation)
""")
def augmented_truth(spark, sf_dir):
    n = read(spark, sf_dir, "nation", "n_nationkey", F.col("n_name").alias("sample")).withColumn("rotation_degrees", F.col("n_nationkey") % 4 * 90)
    out = records.augmented_truth(n, [F.desc("sample")])
    return out.select("sample", "source_sample", "source_rotation_degrees", "applied_clockwise_rotation_degrees", "rotation_degrees", records.source_of(F.col("sample"), F.lit("")).alias("source"))


@query("""
SELECT n_name AS sample, CASE WHEN n_nationkey % 2 = 0 THEN 'base' ELSE 'round2_hardcase' END AS dataset, CASE WHEN n_nationkey % 2 = 0 THEN 'src' ELSE n_name END AS source_sample, CASE WHEN n_nationkey % 5 = 0 THEN 'val' ELSE 'train' END AS split,
    CASE WHEN n_nationkey % 5 = 0 THEN 'protective_positive' ELSE 'hardcase_train' END AS role, 'g' || n_nationkey % 5 AS hardcase_group FROM nation
""")
def hard_case_sets(spark, sf_dir):
    n = read(spark, sf_dir, "nation", "n_nationkey", F.col("n_name").alias("sample"))
    k = F.col("n_nationkey")
    earlier = n.where(k % 2 == 0).select("sample", F.lit("src").alias("source_sample"), F.lit("base").alias("dataset"), F.lit("left").alias("title_block_position"), F.lit(90).alias("rotation_degrees"))
    return records.hard_cases(n.select("sample", F.concat(F.lit("g"), (k % 5).cast("string")).alias("group")), earlier, "g0").drop("title_block_position", "rotation_degrees")


@query("""
SELECT count(*) AS records, count(DISTINCT o_orderkey) AS samples, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS without_one_label, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 2) > 1)) AS leaked_sources, false AS passed FROM orders
""")
def dataset_summaries(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    rows = o.select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("source_sample"), F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("val").alias("split"))
    counts = o.where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("sample"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("n"))
    missing = o.where("o_orderkey % 3 <> 0 AND o_orderkey % 6 = 0")
    return records.dataset_summary(rows.join(missing.select(F.col("o_orderkey").alias("sample")), "sample", "left_anti"), counts)


@query("""
SELECT 'g' || d AS group, o_orderkey AS sample, d AS prediction_dir, n <> 1 AS needs_attention FROM (SELECT o_orderkey, min(o_orderkey % 3) AS d, min(o_orderkey % 2) AS n, min(o_totalprice) AS p FROM orders GROUP BY 1) WHERE d = 0 OR (d = 1 AND o_orderkey % 5 = 0)
""")
def prediction_groups(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders", "o_orderkey"), F.col("o_orderkey")
    predictions = o.select(k.alias("sample"), (k % 3).alias("prediction_dir"), (k % 2).alias("prediction_count"))
    groups = spark.createDataFrame([("g0", 0, False), ("g1", 1, True)], "group string, prediction_dir long, members_only boolean")
    out = records.prediction_groups(predictions.unionByName(predictions.where("sample % 97 = 0")), groups, o.where("o_orderkey % 5 = 0").select(k.alias("sample")))
    return out.select("group", "sample", "prediction_dir", "needs_attention")


@query("SELECT n_nationkey::VARCHAR AS task_id, v AS variant_id, 'kind__' || v || '__' || n_nationkey AS custom_id FROM nation, (VALUES ('a'), ('b')) AS t(v)")
def request_spine(spark, sf_dir):
    n = read(spark, sf_dir, "nation", F.col("n_nationkey").cast("string").alias("task_id"))
    return records.requests(n, spark.createDataFrame([("a", "m"), ("b", "m")], "variant_id string, model string"), "kind").select("task_id", "variant_id", "custom_id")


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'ok' ELSE 'missing' END AS status, CASE WHEN event_id % 3 > 0 THEN event_type END AS stage FROM events")
def stage_states(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "event_type")
    return records.stage_status(e.select("event_id"), e.where("event_id % 3 > 0").withColumnRenamed("event_type", "stage"), "event_id")


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 2 AS s FROM orders)
SELECT o_orderkey, i AS candidate_index, i = s AS selected, i = 1 AND o_orderkey % 3 > 0 AS rejected, CASE WHEN i = 1 AND o_orderkey % 3 > 0 THEN 0.2 WHEN o_orderkey % 3 > 0 THEN 0.9 END::DOUBLE AS score, CASE WHEN i = 0 THEN 'text' END AS words
FROM r, (VALUES (0), (1)) AS t(i) WHERE o_orderkey % 3 > 0 OR i = s
""")
def expanded_candidates(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders", "o_orderkey"), F.col("o_orderkey")
    base = o.select("o_orderkey", (k % 2).cast("int").alias("selected_candidate_index"))
    candidates = o.where("o_orderkey % 3 > 0").select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("candidate_index"), F.lit(0.9).alias("score"))
    rejected = candidates.where("candidate_index = 1").withColumn("score", F.lit(0.2))
    recognised = o.select("o_orderkey", F.lit(0).alias("candidate_index"), F.lit("text").alias("words"))
    return records.expanded_candidates(base, candidates, rejected, recognised, ["o_orderkey"]).select("o_orderkey", "candidate_index", "selected", "rejected", "score", "words")


@query(f"""
WITH e AS (SELECT event_id, 's' || event_id % 20 AS sample, event_type AS d, event_id % 4 AS k FROM events),
r AS (SELECT 'three_way_mcp_correction' AS source, '' AS prediction_dir, sample, '' AS candidate_index, 'mcp_corrected_opencv' AS teacher_value FROM e WHERE k = 0 UNION SELECT 'three_way_low_confidence_agreement', '', sample, '', 'confidence_calibration' FROM e WHERE k = 1 AND sample = 's1'
    UNION SELECT 'routing_hardcase', d, sample, k::VARCHAR, 'hardcase_explanation' FROM e WHERE sample = 's2' OR k = 3 UNION SELECT 'round3_rejected_candidate', d, sample, k::VARCHAR, 'non_title_table_false_positive' FROM e WHERE sample = 's5')
SELECT * FROM r
""")
def distillation_rows(spark, sf_dir):
    return distilled(spark, sf_dir).select("source", "prediction_dir", "sample", "candidate_index", "teacher_value")


def distilled(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 4
    e = read(spark, sf_dir, "events", "event_id", F.col("event_type").alias("prediction_dir")).withColumn("sample", F.concat(F.lit("s"), (F.col("event_id") % 20).cast("string")))
    three = e.select("sample", F.when(k < 2, "True").otherwise("False").alias("mcp_matches_manual"), F.when(k == 1, " true ").otherwise("no").alias("opencv_matches_manual"))
    routed = e.select("prediction_dir", "sample", k.alias("selected_candidate_index"), F.when(k == 3, texts("retrain_candidate")).alias("routes"), texts("x", "y").alias("route_reasons"))
    return records.distillation_rows(three, ["s1"], routed, ["s2"], e.select("prediction_dir", "sample", k.alias("candidate_index"), texts("z").alias("rejection_reasons")), ["s5"])


@query("""
WITH t AS (SELECT DISTINCT event_type AS d, event_id % 4 AS k FROM events WHERE event_id % 20 = 5)
SELECT 'teacher_' || lpad((k + 1)::VARCHAR, 2, '0') || '_round3_rejected_candidate__' || d || '__s5__candidate_' || k AS task_id, 'non_title_table_false_positive' AS task_type, CASE WHEN k % 2 = 0 THEN 'own' ELSE 'record' END AS source_image,
    CASE WHEN k % 2 = 0 THEN '' ELSE 'candidate_crop' END AS missing_assets FROM t
""")
def teacher_tasks(spark, sf_dir):
    rows = distilled(spark, sf_dir).where("source = 'round3_rejected_candidate'")
    targets = rows.select((F.col("candidate_index").cast("int") + 1).alias("place"), "source", "sample", "prediction_dir", "candidate_index").unionByName(spark.createDataFrame([(99, "none", "s", "d", "")], "place int, source string, sample string, prediction_dir string, candidate_index string"))
    one = rows.select("prediction_dir", "sample").distinct()
    candidates = rows.where("candidate_index % 2 = 0").select("prediction_dir", "sample", F.col("candidate_index").cast("int").alias("candidate_index"), F.lit("own").alias("source_image"), F.lit("crop").alias("crop_path"))
    out = records.teacher_tasks(targets, rows, one.select("*", F.lit("record").alias("source_image"), F.lit("overlay").alias("overlay_path")), candidates)
    return out.select("task_id", "task_type", "source_image", joined("missing_assets").alias("missing_assets"))


ACTED = taught(candidate_judgments=[judged(), judged(candidate_index=1, is_true_title_block=False, ordinary_table_false_positive_risk="high", reject_reasons_if_not_title_block=["grid", "small"], layout_evidence=["a", "b"])])


@query(f"""
WITH e AS (SELECT event_id, {picked_sql("event_id", "hardcase_positive", "confidence_calibration", "mcp_corrected_opencv")} AS kind FROM events)
SELECT event_id, kind AS task_kind, 0 AS candidate_index, '' AS reject_reasons, CASE kind WHEN 'hardcase_positive' THEN 'rule;data' ELSE 'rule;provider' END AS distill_targets, '' AS layout_evidence FROM e
UNION ALL SELECT event_id, kind, 1, 'grid;small', CASE kind WHEN 'hardcase_positive' THEN 'rule;data;model' WHEN 'confidence_calibration' THEN 'rule;provider;data;model' ELSE 'rule;data;model;provider' END, 'a | b' FROM e
""")
def teacher_actions(spark, sf_dir):
    k = F.col("event_id")
    task = F.concat(picked(k, "e__hard__", "b__low_confidence__", "a__mcp_correction__"), k.cast("string"))
    out = records.teacher_actions(read(spark, sf_dir, "events", "event_id").select(task.alias("task_id"), F.lit(ACTED).alias("parsed_response")))
    return out.select(F.regexp_extract("task_id", "([0-9]+)$", 1).cast("long").alias("event_id"), "task_kind", "candidate_index", "reject_reasons", "distill_targets", "layout_evidence")


@query("""
SELECT event_id, 'valid' AS part, '' AS error FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'errors', 'pending_response' FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, 'errors', 'missing_or_empty_parsed_response' FROM events WHERE event_id % 2 = 1
""")
def teacher_parts(spark, sf_dir):
    """Valid answers and errors apart."""
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events", "event_id").select(k.cast("string").alias("task_id"), F.when(k % 2 == 0, "ok").otherwise("pending").alias("parse_status"), F.when(k % 2 == 0, F.concat(F.lit('{"task_id": "'), k.cast("string"), F.lit('", '), F.lit(taught().removeprefix('{"task_id": "t", ')))).alias("parsed_response"), F.lit(None).cast("string").alias("_json_error"))
    valid, errors = records.teacher_outputs(records.validated_teacher(rows))
    return valid.select(F.col("task_id").cast("long").alias("event_id"), F.lit("valid").alias("part"), F.lit("").alias("error")).unionByName(errors.select(F.col("task_id").cast("long").alias("event_id"), F.lit("errors").alias("part"), "error"))


# ---- steps of a run


@query("SELECT event_id::VARCHAR AS task_id FROM events WHERE event_id % 11 = 0 OR event_id % 6 IN (2, 5) OR event_id % 7 % 6 = 5")
def failed_keys(spark, sf_dir):
    from vellumen.functions import answers

    return lifecycle.failed_keys(answers.orientation_decisions(responses(spark, sf_dir)), ["task_id"])


@query("SELECT event_id::VARCHAR AS task_id FROM events WHERE event_id % 11 = 0 OR event_id % 4 = 0")
def pending_requests(spark, sf_dir):
    raw = responses(spark, sf_dir)
    return lifecycle.pending(raw.select("task_id", "model", "request_kind"), raw.where(F.col("task_id").cast("long") % 4 != 0)).select("task_id")


@query("SELECT count(*) AS page_count, count(*) FILTER (WHERE event_id % 11 <> 0) AS orientation_api_ok_count, count(*) FILTER (WHERE event_id % 11 <> 0 AND event_id % 6 <> 5) AS orientation_parse_ok_count FROM events")
def run_counts(spark, sf_dir):
    """The summary of a run over recorded answers."""
    raw = responses(spark, sf_dir)
    path = lambda sub: F.concat(F.lit(f"/{sub}/"), "task_id", F.lit(".pdf"))
    pages = raw.select("task_id", "source_pdf", text.file_stem(F.col("source_pdf")).alias("source_stem"), "page_number", path("in").alias("split_pdf_path"), path("out").alias("output_pdf_path"))
    return lifecycle.run(pages, "model", lifecycle.Replay(raw), "/end").summary.select("page_count", "orientation_api_ok_count", "orientation_parse_ok_count")


@query("SELECT event_id::VARCHAR AS task_id, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS answered_by, 1 AS attempt_count FROM events WHERE event_id < 300 UNION ALL SELECT 'busy', 'second', 2", registered=False)
def provider_ladder(spark, sf_dir):
    """Two services in turn: the second gets what the first failed, and one of its answers comes at the second try."""
    e = read(spark, sf_dir, "events", "event_id").where("event_id < 300").select(F.col("event_id").cast("string").alias("task_id"))
    asked = e.unionByName(spark.createDataFrame([("busy",)], "task_id string")).select("task_id", F.lit("/a.pdf").alias("source_pdf"), F.lit(1).alias("page_number"), F.lit("m").alias("model"), F.lit("k").alias("request_kind"))

    def first(row: dict) -> tuple[int, str | None, str]:
        return (200, '{"by": "first"}', "") if row["task_id"].isdigit() and int(row["task_id"]) % 2 == 0 else (400, None, "no")

    seen: dict[str, int] = {}

    def second(row: dict) -> tuple[int, str | None, str]:
        seen[row["task_id"]] = seen.get(row["task_id"], 0) + 1
        return (503, None, "busy") if row["task_id"] == "busy" and seen["busy"] < 2 else (200, '{"by": "second"}', "")

    got = lifecycle.Ladder([lifecycle.Calls(first), lifecycle.Calls(second, wait=0.01)]).responses(asked)
    return got.select("task_id", F.get_json_object("response_json", "$.by").alias("answered_by"), "attempt_count")


# ---- files, written and read again


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END AS n_regionkey FROM nation")
def json_round_trip(spark, sf_dir):
    """Rows as JSON lines, nulls included, read again."""
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).alias("n_regionkey"))
    path = folder(spark)
    sinks.json_rows(n, path)
    return files.json_lines(spark, path, n.schema)


@query("SELECT CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey::BIGINT END AS x, CASE WHEN n_nationkey % 4 = 0 THEN 'bad ' || n_name END AS error, CASE WHEN n_nationkey % 4 = 0 THEN 2 * row_number() OVER (ORDER BY n_nationkey) - 1 END AS line FROM nation")
def json_places(spark, sf_dir):
    """JSON lines of which some are none, and every second is empty; bad ones know their number."""
    n, k = read(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("n_nationkey")
    line = F.when(k % 4 > 0, F.to_json(F.struct(k.alias("x")))).otherwise(F.concat(F.lit("bad "), "n_name"))
    path = folder(spark)
    n.select(k, F.concat(line, F.lit("\n")).alias("value")).coalesce(1).orderBy("n_nationkey").select("value").coalesce(1).write.text(path)
    return files.json_records(spark, path, "x long", tolerant=True).select("x", F.col("_json_error").alias("error"), F.col("_line_number").cast("long").alias("line"))


@query("SELECT n_nationkey::BIGINT AS x, n_name AS y FROM nation")
def json_arrays(spark, sf_dir):
    """A report with its rows in a list, and the same rows as one array; both read again."""
    path = on_driver(folder(spark))
    rows = [{"x": r["n_nationkey"], "y": r["n_name"]} for r in read(spark, sf_dir, "nation", "n_nationkey", "n_name").collect()]  # 25 rows, as in a report
    sinks.summary_json({"candidates": rows}, path / "report.json")
    (path / "array.json").write_text(json.dumps(rows))
    report = files.json_report(spark, str(path / "report.json"), "candidates array<struct<x:long,y:string>>")
    return report.join(files.json_array(spark, str(path / "array.json"), "x long, y string"), ["x", "y"])


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'True' ELSE 'False' END AS even, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'a;b' END AS items FROM nation")
def csv_round_trip(spark, sf_dir):
    """A report as CSV parts, and as one file with a byte order mark; both read again as text."""
    k = F.col("n_nationkey")
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name").select(k.alias("id"), F.col("n_name").alias("name"), (k % 2 == 0).alias("even"), F.when(k % 3 > 0, texts("a", "b")).alias("items"))
    path, names = on_driver(folder(spark)), ["id", "name", "even", "items"]
    sinks.csv_report(n, f"{path}/parts", names)
    sinks.driver_csv(n, path / "one.csv", names)
    return files.csv_table(spark, f"{path}/parts/*.csv", names).join(files.csv_table(spark, f"{path}/one.csv", names), names)


@query("SELECT region, CASE WHEN region = 'keep' THEN n ELSE n END AS n FROM (SELECT CASE WHEN n_regionkey < 2 THEN 'keep' ELSE 'drop' END AS region, count(*) AS n FROM nation GROUP BY 1)")
def split_outputs(spark, sf_dir):
    n, path = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), folder(spark)
    sinks.split_outputs(n, path, {"keep": F.col("n_regionkey") < 2, "drop": F.col("n_regionkey") >= 2})
    one = lambda name: files.json_lines(spark, f"{path}/{name}", n.schema).agg(F.count("*").alias("n")).select(F.lit(name).alias("region"), "n")
    return one("keep").unionByName(one("drop"))


@query("SELECT request_kind, count(*) AS n FROM (SELECT 'orientation' AS request_kind FROM events UNION ALL SELECT 'number' FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def appended_responses(spark, sf_dir):
    raw, path = responses(spark, sf_dir), folder(spark)
    sinks.append_responses(raw, path)
    sinks.append_responses(raw.where(F.col("task_id").cast("long") % 2 == 0).withColumn("request_kind", F.lit("number")), path)
    return spark.read.parquet(path).groupBy("request_kind").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def workbook_round_trip(spark, sf_dir):
    """A form as a workbook, read again."""
    path = on_driver(folder(spark)) / "form.xlsx"
    sinks.xlsx_form(read(spark, sf_dir, "nation", F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path, ["id", "name"])
    return xlsx.read_xlsx(spark, str(path), ["id", "name"]).select("id", "name")


@query("""
SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 3 WHEN 0 THEN 'copied' WHEN 1 THEN 'turned' ELSE 'missing' END AS status, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN reverse(n_name) END AS content FROM nation
""")
def published_files(spark, sf_dir):
    """Files copied to their places, some turned and some not there, and what then lies there."""
    path, k = on_driver(folder(spark)), F.col("n_nationkey")
    for r in read(spark, sf_dir, "nation", "n_nationkey", "n_name").where("n_nationkey % 3 < 2").collect():  # at most 25 small files
        (path / f"{r['n_nationkey']}.in").write_text(r["n_name"])
    at = lambda end: F.concat(F.lit(f"{path}/"), k.cast("string"), F.lit(end))
    rows = read(spark, sf_dir, "nation", "n_nationkey").select(k.cast("string").alias("task_id"), at(".in").alias("source"), F.concat(F.lit(f"{path}/end/"), k.cast("string"), F.lit(".out")).alias("target"), F.when(k % 3 == 1, 90).otherwise(0).alias("degrees"))
    done = sinks.published(rows, f"{path}/log", "source", "target", "degrees", lambda content, degrees: content[::-1])
    there = spark.read.format("binaryFile").load(f"{path}/end").select(F.regexp_extract("path", r"([0-9]+)[.]out$", 1).alias("task_id"), F.col("content").cast("string").alias("content"))
    return done.join(there, "task_id", "left").select(F.col("task_id").cast("long").alias("id"), "status", "content")


@query("""
SELECT 'doc ' || n_nationkey AS stem, p AS page_number, 'doc_' || n_nationkey || '_page_' || lpad(p::VARCHAR, 3, '0') AS task_id FROM (SELECT n_nationkey, unnest(generate_series(1, least(n_nationkey % 4, 2))) AS p FROM nation WHERE n_nationkey < 10)
""", registered=False)
def pages_of_files(spark, sf_dir):
    """Files of a folder by suffix, in any case, and a row for each of their pages, at most two."""
    path = on_driver(folder(spark))
    for n in range(10):
        (path / f"doc {n}.{'PDF' if n % 2 else 'pdf'}").write_bytes(b"x" * (n % 4))
    (path / "other.txt").write_text("")
    found = files.list_files(spark, str(path))
    found = found.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    rows = files.page_rows(found, F.col("length"), "/work", "/out", limit_pages=2)
    return rows.select(text.file_stem(F.col("source_pdf")).alias("stem"), F.col("page_number").cast("long").alias("page_number"), "task_id")


@query("""
SELECT n_nationkey::BIGINT AS n, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'format_error:line_1:field_count_3' WHEN 2 THEN 'format_error:line_1:not_numeric' ELSE 'missing_prediction_label' END AS error, CASE WHEN n_nationkey % 4 = 0 THEN 0.25::DOUBLE END AS area, CASE WHEN n_nationkey % 4 < 3 THEN 1 ELSE 0 END::BIGINT AS lines,
    CASE WHEN n_nationkey % 2 = 0 THEN 'train' END AS split FROM nation
""", registered=False)
def label_files(spark, sf_dir):
    """Label files: boxes, errors by line, files that should be there and aren't, lines, and splits."""
    from vellumen.functions import geometry

    path = on_driver(folder(spark))
    lines = ("0 0 0 0.5 0 0.5 0.5 0 0.5\n\n", "1 2 3\n", "0 a 0 0.5 0 0.5 0.5 0 0.5\n")
    for n in range(25):
        if n % 4 < 3:
            (path / f"{n}.txt").write_text(lines[n % 4])
    plain = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    expected = spark.createDataFrame([(f"{path}/{n}.txt",) for n in range(25)], "path string")
    read_ = plain(files.numbered_lines(spark, str(path)))
    found = files.with_missing(expected, files.labels(read_))
    counted = expected.join(files.line_counts(read_), "path", "left")
    splits = spark.createDataFrame([(str(n), "train") for n in range(0, 25, 2)], "sample string, split string")
    split = files.listed_splits(expected, splits)
    number = F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long")
    return found.join(counted, "path").join(split.select("path", "split"), "path").select(number.alias("n"), "error", rounded(geometry.polygon_area(F.col("points")), "area"), F.coalesce("n", F.lit(0)).cast("long").alias("lines"), "split")


@query("SELECT * FROM (VALUES ('a', 'block', 0.25::DOUBLE), ('b', 'block', 0.25::DOUBLE)) AS t(file, label, area)", registered=False)
def annotation_files(spark, sf_dir):
    """Polygons in either common shape, as shares of the image."""
    from vellumen.functions import geometry

    path = on_driver(folder(spark))
    corners = [[0, 0], [100, 100], [100, 0], [0, 100]]
    (path / "a.json").write_text(json.dumps({"shapes": [{"label": "block", "points": corners}], "imageWidth": 200, "imageHeight": 200}))
    (path / "b.json").write_text(json.dumps({"objects": [{"category": "block", "segmentation": corners}], "info": {"width": 200, "height": 200}}))
    p = files.polygons(spark, str(path))
    return p.select(F.regexp_extract("path", "([ab])[.]json$", 1).alias("file"), "label", rounded(geometry.polygon_area(F.col("points")), "area"))


@query("SELECT n_name AS sample, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'src' END AS source_sample, (n_nationkey % 4 * 90)::BIGINT AS rotation_degrees FROM nation")
def manifests(spark, sf_dir):
    n, path, k = read(spark, sf_dir, "nation", "n_nationkey", "n_name"), folder(spark), F.col("n_nationkey")
    blank = lambda name: F.lit("x").alias(name)
    rows = n.select(blank("dataset"), F.col("n_name").alias("sample"), F.when(k % 2 == 0, " ").otherwise("src").alias("source_sample"), *map(blank, ("image_path", "label_path", "title_block_position", "precise_title_block_position")), (k % 4 * 90).alias("rotation_degrees"), blank("suggested_split"))
    sinks.csv_report(rows, path, rows.columns)
    return files.manifest(spark, path).select("sample", "source_sample", F.col("rotation_degrees").cast("long").alias("rotation_degrees"))


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_keys(spark, sf_dir):
    return files.keys_of(read(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus")
