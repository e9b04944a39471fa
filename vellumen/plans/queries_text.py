"""Queries that apply scalar functions on texts, answers and numbers, and SQL for the same rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumen.functions import answers, numbers, text
from vellumen.plans import records
from vellumen.plans.queries import joined, query, read, responses


def picked(c: Column, *values: object) -> Column:
    """The value at the remainder of a number."""
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(c, F.lit(len(values))).cast("int"))


def picked_sql(c: str, *values: object) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"[{', '.join(map(one, values))}][{c} % {len(values)} + 1]"


STEM = r"regexp_replace(regexp_replace({}, '^.*[/\\]', ''), '^(.+)\.[^.]*$', '\1')"


@query(rf"""
WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/data/in/' || user_id || '/page.' || event_id || '.pdf' WHEN 1 THEN 'D:\in\sub\' || event_type || '.PDF' ELSE '.hidden' || event_id END AS p FROM events)
SELECT event_id, CASE WHEN starts_with(replace(p, '\', '/'), '/data/in/') THEN substr(p, 10) ELSE replace(p, '\', '/') END AS relative, {STEM.format("p")} AS stem FROM t
""")
def path_names(spark, sf_dir):
    e, k = read(spark, sf_dir, "events", "event_id", "user_id", "event_type"), F.col("event_id") % 3
    path = F.when(k == 0, F.concat(F.lit("/data/in/"), F.col("user_id").cast("string"), F.lit("/page."), F.col("event_id").cast("string"), F.lit(".pdf"))).when(k == 1, F.concat(F.lit("D:\\in\\sub\\"), "event_type", F.lit(".PDF"))).otherwise(F.concat(F.lit(".hidden"), F.col("event_id").cast("string")))
    return e.select("event_id", text.relative_path(path, "/data/in").alias("relative"), text.file_stem(path).alias("stem"))


@query(rf"""
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'out/sample_0' || user_id || '_rot.png' WHEN 1 THEN 'aug90_001_from_sample_' || user_id || '.png' WHEN 2 THEN 'x/page__y__abc_sample_' || user_id || '.json' ELSE 'z_sample_7_b_sample_8' END AS p FROM events),
s AS (SELECT *, {STEM.format("p")} AS s FROM t)
SELECT event_id, CASE WHEN starts_with(s, 'aug90_') THEN s ELSE 'sample_' || regexp_extract(p, 'sample_(\d+)', 1) END AS of_result,
    CASE WHEN contains(s, '_sample_') THEN regexp_replace(regexp_extract(s, '^(.*?)_sample_(.*)$', 1), '^.*__', '') || '_sample_' || regexp_extract(s, '^(.*?)_sample_(.*)$', 2) ELSE regexp_extract(s, '(sample_.*)$', 1) END AS of_stage FROM s
""")
def sample_names(spark, sf_dir):
    e, k, user = read(spark, sf_dir, "events", "event_id", "user_id"), F.col("event_id") % 4, F.col("user_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("out/sample_0"), user, F.lit("_rot.png"))).when(k == 1, F.concat(F.lit("aug90_001_from_sample_"), user, F.lit(".png"))).when(k == 2, F.concat(F.lit("x/page__y__abc_sample_"), user, F.lit(".json"))).otherwise("z_sample_7_b_sample_8")
    return e.select("event_id", text.sample_of_result(path).alias("of_result"), text.sample_of_stage(path).alias("of_stage"))


TASKS = ("a__mcp_correction__sample_5__candidate_0", "b__low_confidence__aug90_12__candidate_3", "c__rejected_candidate__unclear90_7", "d__sample_040__candidate_1", "e__hard__aug90_3__sample_4", "plain")


@query(f"""
WITH t AS (SELECT event_id, {picked_sql("event_id", *TASKS)} AS c FROM events)
SELECT event_id, CASE WHEN contains(c, 'mcp_correction') THEN 'mcp_corrected_opencv' WHEN contains(c, 'low_confidence') THEN 'confidence_calibration' WHEN contains(c, 'rejected_candidate') THEN 'non_title_table_false_positive'
        WHEN contains(c, 'sample_040') THEN 'small_angle_offset_tolerated' ELSE 'hardcase_positive' END AS kind,
    CASE WHEN contains(c, '__sample_') THEN 'sample_' || regexp_replace(substr(c, instr(c, '__sample_') + 9), '__candidate_.*$', '') WHEN contains(c, '__aug90_') THEN 'aug90_' || regexp_replace(substr(c, instr(c, '__aug90_') + 8), '__candidate_.*$', '')
        WHEN contains(c, '__unclear90_') THEN 'unclear90_' || regexp_replace(substr(c, instr(c, '__unclear90_') + 12), '__candidate_.*$', '') ELSE c END AS sample FROM t
""")
def task_names(spark, sf_dir):
    e, c = read(spark, sf_dir, "events", "event_id"), picked(F.col("event_id"), *TASKS)
    return e.select("event_id", text.task_kind(c).alias("kind"), text.task_sample(c).alias("sample"))


BASES = ("manual_review: checked", "opencv_mcp_consensus_accepted", "other", None)


@query(f"SELECT event_id, {picked_sql('event_id', 'manual_review', 'consensus_accepted', 'unknown', 'unknown')} AS level, event_id % 4 = 0 AS verified FROM events")
def source_levels(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id").withColumn("s", text.source_level(picked(F.col("event_id"), *BASES)))
    return e.select("event_id", "s.level", "s.verified")


@query(r"""
WITH t AS (SELECT p_partkey, p_name, p_size, '  ' || p_name || chr(10) || ' ' || chr(13) || chr(10) || 'x' || p_size || '  y' || chr(13) || '  end ' AS t FROM part),
f AS (SELECT *, regexp_extract_all(p_name || ' ' || p_name || ' x1 x2', '[a-z]+[0-9]?') AS l FROM t)
SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(t, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS lines,
    substr(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 9) AS short,
    array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ';') AS found, p_size % 3 = 0 AS truth,
    CASE WHEN p_size % 2 = 0 THEN least(p_size * 4, 80) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS share,
    CASE p_size % 3 WHEN 0 THEN 'Alpha;c' WHEN 1 THEN 'Beta;c;Alpha' ELSE 'c;Alpha' END AS named, p_size % 4 < 2 AS untitled, CASE p_size % 3 WHEN 0 THEN 'a;b' WHEN 1 THEN 'b;a' ELSE 'a' END AS items
FROM f
""")
def text_scraps(spark, sf_dir):
    p, size = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size"), F.col("p_size").cast("string")
    t = F.concat(F.lit("  "), "p_name", F.lit("\n \r\nx"), size, F.lit("  y\r  end "))
    k = F.col("p_size") % 3
    codes = F.when(k == 0, F.array(*map(F.lit, ("a", "c", "a")))).when(k == 1, F.array(*map(F.lit, ("b", "c", "a")))).otherwise(F.array(*map(F.lit, ("c", "a"))))
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("左侧约"), (F.col("p_size") * 4).cast("string"), F.lit("%"))).otherwise("左侧")
    note = picked(F.col("p_size"), "这里没有标题栏", "只有零件表格。", "有标题栏", None)
    items = text.unique_items(F.when(k == 1, F.array(F.lit("b"), F.lit(""))).otherwise(F.array(F.lit("a"), F.lit(None))), F.when(k == 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))))
    return p.select(
        "p_partkey",
        text.lines_joined(t).alias("lines"),
        text.excerpt(t, 9).alias("short"),
        joined(text.fallback_candidates(F.concat("p_name", F.lit(" "), "p_name", F.lit(" x1 x2")), "[a-z]+[0-9]?", 3)).alias("found"),
        text.truth_text(picked(F.col("p_size"), " TRUE ", "yes", None)).alias("truth"),
        text.percent_after(said, "左侧").alias("share"),
        text.labelled(codes, {"a": "Alpha", "b": "Beta"}).alias("named"),
        text.no_title(note).alias("untitled"),
        joined(items).alias("items"),
    )


ADDRESSES = ("https://a.example/v1/chat/completions", "https://a.example/compatible-mode/v1/", "https://a.example/api/v1?x=1", "https://a.example", " https://a.example/other ")
CHAT = ("https://a.example/v1/chat/completions", "https://a.example/compatible-mode/v1/chat/completions", "https://a.example/compatible-mode/v1/chat/completions?x=1", "https://a.example/compatible-mode/v1/chat/completions", "https://a.example/other/chat/completions")


@query(f"""
SELECT p_partkey, {picked_sql("p_partkey", *CHAT)} AS url, 'data:image/png;base64,' || base64(encode(p_name || repeat('x', 80))) AS content,
    '{{"custom_id":"kind__m-' || p_size || '__' || p_partkey || '","method":"POST","url":"/chat/completions","request_kind":"kind","body":{{"model":"m-' || p_size || '","messages":[{{"role":"user","content":[{{"type":"text","text":"' || p_name
    || '"}},{{"type":"image_url","image_url":{{"url":"<omitted_png_data_url:i' || p_partkey || '>"}}}}]}}],"temperature":0,"response_format":{{"type":"json_object"}},"enable_thinking":false}}}}' AS request FROM part
""")
def request_rows(spark, sf_dir):
    p, key = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size"), F.col("p_partkey").cast("string")
    request = text.request_row(F.lit("kind"), F.concat(F.lit("m-"), F.col("p_size").cast("string")), key, F.col("p_name"), F.concat(F.lit("i"), key))
    return p.select("p_partkey", text.endpoint(picked(F.col("p_partkey"), *ADDRESSES)).alias("url"), text.data_url(F.concat("p_name", F.lit("x" * 80)).cast("binary")).alias("content"), request.alias("request"))


SAID = ("正确", "错误", "不正确", "OK", "空白", "看不清", "范围太大", "无", "x", "", None, " Yes ")
MEANT = {
    "number": ("correct", "incorrect", "incorrect", "other", "missing", "uncertain", "other", "missing", "other", "blank", "blank", "other"),
    "roi": ("correct", "other", "other", "other", "other", "unclear", "too_large", "other", "other", "blank", "blank", "other"),
    "error_first": ("correct", "wrong", "other", "correct", "other", "other", "other", "other", "other", "blank", "blank", "correct"),
    "workbook": ("正确", "错误", "错误", "正确", "空白", "不确定", "范围太大", "无", "x", "空白", "空白", "Yes"),
    "retest": ("正确", "错误", "错误", "正确", "空白", "看不清", "范围太大", "无", "x", "", "", "Yes"),
    "mark": ("correct", *["problem"] * 2, "correct", *["problem"] * 5, "blank", "blank", "correct"),
    "rotation": ("confirmed", "corrected", "不正确", "confirmed", "空白", "看不清", "范围太大", "无", "x", "", "", "confirmed"),
    "numbers_review": ("correct", "incorrect", "incorrect", "correct", *["unreviewed_or_unknown"] * 7, "correct"),
}


@query(f"SELECT event_id, {', '.join(f'{picked_sql("event_id", *v)} AS {k}' for k, v in MEANT.items())} FROM events")
def verdict_forms(spark, sf_dir):
    said = picked(F.col("event_id"), *SAID)
    return read(spark, sf_dir, "events", "event_id").select("event_id", *(text.verdict(said, form).alias(form) for form in MEANT))


@query(f"""
SELECT event_id, {picked_sql("event_id", "bottom", "bottom", "left", "top", "right", "top")} AS coarse, {picked_sql("event_id", 0, 90, 270, 180, None)} AS rotation, {picked_sql("event_id", 90, 180, 90, 270)} AS explicit_rotation, event_id % 5 < 3 AS hit FROM events
""")
def positions(spark, sf_dir):
    k = F.col("event_id")
    code = picked(k, " bottom_right", "left_edge", "top_right", "top", "nowhere")
    explicit = text.explicit_rotation(picked(k, "90.0", " 180 ", "", None), picked(k, "bottom", "bottom", "left", "right"))
    hit = text.label_matches(F.lit("左侧"), F.lit("left"), picked(k, "左侧", " left ", "左方", "右侧", ""), {"左侧": "left", "左方": "left", "右侧": "right"})
    return read(spark, sf_dir, "events", "event_id").select("event_id", text.coarse_position(picked(k, "下方", "右下方", "左侧", "上方", "right", "top")).alias("coarse"), text.rotation_group(code).alias("rotation"), explicit.alias("explicit_rotation"), hit.alias("hit"))


NOTES = ("上侧太大，减少20%", "向右 30 % 收", "蓝色的更好", "位置错误", "模糊，需人工识别", None)
JUDGED = ("", "范围太大", "", "", "范围太小", "")
TAGS = ("percent_20;roi_too_large;trim_top", "percent_30;roi_too_large;shift_or_trim_left_toward_right", "prefer_bottom_right_blue_roi", "roi_wrong_position", "drawing_number_blurry;requires_manual_identification", "")
ADVICE = ("上侧减少约20%", "左侧向右减少约30%", "优先评估蓝框右下区域候选", "", "图号模糊样本保留人工识别或 VLM 兜底", "")


@query(f"SELECT event_id, {picked_sql('event_id', *TAGS)} AS tags, {picked_sql('event_id', *ADVICE)} AS suggestions FROM events")
def note_tags(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id").withColumn("t", text.note_tags(picked(F.col("event_id"), *NOTES), picked(F.col("event_id"), *JUDGED)))
    return e.select("event_id", joined(F.col("t.tags")).alias("tags"), joined(F.col("t.suggestions")).alias("suggestions"))


# ---- answers


def nested(position: str, share: object, evidence: object, review: object, reasons: object, candidates: object = ("A-1",)) -> str:
    return json.dumps({"page_orientation": {"title_block_position": position, "confidence": share, "evidence": evidence}, "drawing_number": {"candidates": candidates, "selected": "A-1", "confidence": 0.5, "evidence": []}, "quality_gate": {"needs_human_review": review, "review_reasons": reasons}}, ensure_ascii=False)


NESTED = (
    nested("bottom_edge", 0.9, ["x"], False, []),
    nested("nowhere", 1.5, "x", "no", [1]),
    nested("top_edge", 0.5, [], True, ["dim"], "A-1"),
    json.dumps({"page_orientation": 3, "quality_gate": {}}),
    "[1]",
)
NESTED_ERRORS = (
    "",
    "page_orientation:invalid_title_block_position;page_orientation:invalid_confidence;page_orientation:evidence_not_list;quality_gate:needs_human_review_not_bool;quality_gate:invalid_review_reasons",
    "drawing_number:invalid_candidates",
    "missing_required:drawing_number;page_orientation:not_object;drawing_number:not_object;quality_gate:missing_required:needs_human_review;quality_gate:missing_required:review_reasons;quality_gate:needs_human_review_not_bool;quality_gate:invalid_review_reasons",
    "decision_not_object",
)


@query(f"""
SELECT event_id, {picked_sql("event_id", *NESTED_ERRORS)} AS errors, {picked_sql("event_id", "bottom_edge", "nowhere", "top_edge", None, None)} AS position, {picked_sql("event_id", True, False, True, False, False)} AS fine,
    {picked_sql("event_id", "", "evidence_not_list;invalid_confidence;invalid_title_block_position;needs_human_review_not_bool;unknown_title_block_position_for_rotation", "model:dim;model_marked_needs_human_review",
                "evidence_not_list;invalid_confidence;invalid_title_block_position;missing_title_block_position_for_rotation;needs_human_review_not_bool;review_reasons_not_list", "decision_not_object;missing_title_block_position_for_rotation")} AS reasons
FROM events
""")
def nested_answers(spark, sf_dir):
    """Answers in sections: their errors as such, and read for the position of the title block."""
    body = picked(F.col("task_id").cast("long"), *NESTED)
    raw = responses(spark, sf_dir).withColumn("ok", F.lit(True)).withColumn("response_json", F.to_json(F.struct(F.array(F.struct(F.struct(body.alias("content")).alias("message"))).alias("choices"))))
    # The errors go along with their row: a join would broadcast all of them, as they are short when compressed.
    d = answers.orientation_decisions(raw.withColumn("_v", F.try_parse_json(body)).withColumn("errors", joined(answers.nested_errors(F.col("_v")))), ("errors",))
    return d.select(F.col("task_id").cast("long").alias("event_id"), "errors", F.col("title_block_position").alias("position"), (F.col("schema_status") == "ok").alias("fine"), joined("review_reasons").alias("reasons"))


def judged(**more: object) -> dict:
    return {"candidate_index": 0, "field_cluster_strength": "strong", "is_true_title_block": True, "layout_evidence": [], "ordinary_table_false_positive_risk": "low", "reject_reasons_if_not_title_block": [], "touches_drawing_frame": True} | more


def taught(**more: object) -> str:
    return json.dumps({"task_id": "t", "selected_candidate_index": 0, "title_block_position": "bottom", "rotation_degrees": 90, "candidate_judgments": [judged()], "needs_human_review": False, "confidence": 0.9} | more)


LESSER = judged()
del LESSER["layout_evidence"]
TAUGHT = (taught(), taught(task_id="u", title_block_position="side", rotation_degrees=45, confidence=2), taught(candidate_judgments=[LESSER, 3]), taught(candidate_judgments=[]), "{}", None, "")
TAUGHT_ERRORS = ("", "task_id_mismatch;invalid_title_block_position;invalid_rotation_degrees;invalid_confidence", "candidate_judgment_0:missing_required:layout_evidence;candidate_judgment_1:not_object", "missing_candidate_judgments", "missing_or_empty_parsed_response", "missing_or_empty_parsed_response", "missing_or_empty_parsed_response")


@query(f"""
SELECT event_id, CASE WHEN array_to_string(e, ';') = '' THEN 'ok' ELSE 'error' END AS status, array_to_string(e, ';') AS errors FROM (
    SELECT event_id, list_filter([CASE WHEN event_id % 11 = 3 THEN 'json_error:bad' END, CASE WHEN event_id % 5 = 4 THEN 'pending_response' END, nullif({picked_sql("event_id", *TAUGHT_ERRORS)}, '')], lambda x: x IS NOT NULL) AS e FROM events)
""")
def teacher_answers(spark, sf_dir):
    """A teacher's answers, validated; the ids go with the rows, as all answers are to one task."""
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events", "event_id").select("event_id", F.lit("t").alias("task_id"), F.when(k % 5 == 4, "pending").otherwise("ok").alias("parse_status"), picked(k, *TAUGHT).alias("parsed_response"), F.when(k % 11 == 3, "bad").alias("_json_error"))
    return records.validated_teacher(rows, keep=("event_id",)).select("event_id", "status", joined("errors").alias("errors"))


@query("""
SELECT event_id::VARCHAR AS task_id, 'orientation' AS request_kind, event_id % 11 <> 0 AS ok, CASE WHEN event_id % 11 = 0 THEN 'plain ' || event_id ELSE '' END AS response_text, event_id % 11 = 0 AS without_json FROM events
""")
def public_responses(spark, sf_dir):
    raw = responses(spark, sf_dir).withColumn("response_text", F.concat(F.lit("plain "), "task_id"))
    return answers.public_raw(raw).select("task_id", "request_kind", "ok", "response_text", F.col("response_json").isNull().alias("without_json"))


@query("""
SELECT event_id::VARCHAR AS task_id, '' AS number, 'error' AS schema_status, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 6 = 5 THEN 'AB-1;CD-2' ELSE '' END AS candidates,
    CASE WHEN event_id % 11 = 0 THEN 'drawing_number_api_error:500;missing_drawing_number;response_not_json_object' WHEN event_id % 6 = 5 THEN 'content_json_parse_failed;missing_drawing_number' ELSE 'missing_drawing_number;schema_error' END AS reasons FROM events
""")
def lenient_numbers(spark, sf_dir):
    """Number answers read leniently: any error of form is one code, and a text that is no JSON is searched."""
    raw = responses(spark, sf_dir)
    plain = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("AB-1 or CD-2, AB-1").alias("content")).alias("message"))).alias("choices")))
    wrong = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit('{"selected_drawing_number": 5}').alias("content")).alias("message"))).alias("choices")))
    k = F.col("task_id").cast("long")
    d = answers.number_decisions(raw.withColumn("response_json", F.when(F.col("ok"), F.when(k % 6 == 5, plain).otherwise(wrong))), lenient=True, fallback_pattern="[A-Z]{2}-[0-9]")
    return d.select("task_id", F.col("selected_drawing_number").alias("number"), "schema_status", joined("candidates").alias("candidates"), joined("review_reasons").alias("reasons"))


# ---- numbers in texts


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS n,
    CASE p_partkey % 5 WHEN 0 THEN 'JS' || (10 + p_size) || '-' || lpad(p_partkey::VARCHAR, 6, '0') || '-02' WHEN 3 THEN 'QX-' || lpad(p_partkey::VARCHAR, 6, '0') || '-B' WHEN 4 THEN 'JS' || (10 + p_size) || '-' || lpad(p_partkey::VARCHAR, 6, '0') || '-02' END AS selected,
    CASE p_partkey % 5 WHEN 0 THEN 'single_high_confidence_candidate' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'missing' WHEN 3 THEN 'single_candidate' ELSE 'single_high_confidence_candidate' END AS status,
    CASE p_partkey % 5 WHEN 0 THEN 0.99 WHEN 3 THEN 0.54 WHEN 4 THEN 0.99 END::DOUBLE AS confidence,
    CASE p_partkey % 5 WHEN 1 THEN 'drawing_number_ambiguous' WHEN 2 THEN 'drawing_number_missing' WHEN 3 THEN 'drawing_number_low_confidence' ELSE '' END AS blockers,
    CASE p_partkey % 5 WHEN 0 THEN 'near_label;near_drawing_number_label;after_chinese_drawing_name;before_title_block_flow_fields;project_prefix' WHEN 3 THEN 'global_pattern' WHEN 4 THEN 'near_label;near_drawing_number_label;after_chinese_drawing_name;before_title_block_flow_fields;project_prefix' END AS reasons,
    CASE p_partkey % 5 WHEN 0 THEN '' WHEN 3 THEN 'weak_alnum_mix' WHEN 4 THEN '' END AS penalties
FROM part
""")
def number_candidates(spark, sf_dir):
    """Numbers after a label, without one, in a path, and several of them."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    k, serial = F.col("p_partkey") % 5, F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    number = F.concat(F.lit("js"), (F.col("p_size") + 10).cast("string"), F.lit("_"), serial, F.lit("-02"))
    far = F.lit(" " + "说明文字。" * 30)
    made = (
        F.when(k == 0, F.concat(F.lit("泵体图号 "), number, F.lit(" 设计 "), "p_name"))
        .when(k == 1, F.concat(F.lit("泵体图号 "), number, F.lit(" 设计 "), "p_name", F.lit("\n 序号 AB12-1-7")))
        .when(k == 2, F.concat("p_name", F.lit(" 2024-01-02 \\\\10.1.2.3\\AB12-CD34-01.dwg A-B")))
        .when(k == 3, F.concat("p_name", far, F.lit(" QX-"), serial, F.lit("-B "), far))
        .otherwise(F.concat(F.lit("泵体图号 "), number, F.lit(" 设计 "), "p_name", far, F.lit(" 数量 ZZ-1-2A "), far))
    )
    found = p.select("p_partkey", numbers.number_candidates(made).alias("c"))
    s = found.select("p_partkey", F.size("c").alias("n"), numbers.selection(F.col("c")).alias("s"), F.get("c", 0).alias("best"))
    taken = F.col("s.selected").isNotNull()
    return s.select("p_partkey", "n", "s.selected", "s.status", "s.confidence", joined("s.blockers").alias("blockers"), F.when(taken, joined("best.reasons")).alias("reasons"), F.when(taken, joined("best.penalties")).alias("penalties"))


@query("""
SELECT op, machine, manual, count(*) AS n FROM (
    SELECT unnest(CASE p_partkey % 5 WHEN 1 THEN [{'op': 'replace', 'machine': 'O', 'manual': '0'}] WHEN 2 THEN [{'op': 'insert', 'machine': '', 'manual': 'X'}] WHEN 3 THEN [{'op': 'delete', 'machine': 'AB', 'manual': ''}]
        WHEN 4 THEN [{'op': 'replace', 'machine': 'I', 'manual': '1'}, {'op': 'replace', 'machine': 'O', 'manual': '0'}] ELSE [] END) AS o FROM part) GROUP BY o.op, o.machine, o.manual
""".replace("SELECT op, machine, manual,", "SELECT o.op AS op, o.machine AS machine, o.manual AS manual,"))
def diff_ops(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey")
    machine, manual = picked(F.col("p_partkey"), "JS-1", "JSO-1", "JS-1", "JSAB-1", "J-IO-S"), picked(F.col("p_partkey"), "JS-1", "JS0-1", "JS-1X", "JS-1", "J-10-S")
    ops = p.select(numbers.diff_operations(machine, manual).alias("o"))
    return ops.select(F.explode(numbers.char_confusions(F.col("o"))).alias("c")).groupBy("c.op", "c.machine", "c.manual").agg(F.count("*").alias("n"))


FIELDS = ("设计 审核 图号 材料", "设计", "", "名称 比例 重量", "设计 制图 校对 批准 日期 图名 图样代号 单位 材料")
ROLES = (2, 1, 0, 0, 5)
PROPERTIES = (2, 0, 0, 3, 4)


@query(f"""
WITH f AS (SELECT event_id, value, {picked_sql("event_id", *ROLES)} AS r, {picked_sql("event_id", *PROPERTIES)} AS p, {picked_sql("event_id", *map(len, FIELDS))} AS n FROM events),
s AS (SELECT *, (r / 8.0::DOUBLE + p / 7.0::DOUBLE) / 2 AS score FROM f)
SELECT event_id, round(score, 9) AS score, CASE WHEN r >= 2 AND p >= 2 THEN 'strong' WHEN r + p > 0 THEN 'weak' ELSE 'none' END AS level,
    CASE WHEN event_id % 4 = 0 THEN 'missing' WHEN event_id % 4 = 1 THEN 'unavailable' WHEN r >= 2 AND p >= 2 AND score >= 0.55 THEN 'strong' WHEN score > 0 THEN 'weak' ELSE 'none' END AS guarded,
    round(4 * r + 4 * p + 0.5 + least(n, 80) / 200.0::DOUBLE, 9) AS rank, {picked_sql("event_id", "180;270", "0;90", "90;180", "0;270", "0")} AS angles FROM s
""")
def field_clusters(spark, sf_dir):
    e, k = read(spark, sf_dir, "events", "event_id"), F.col("event_id")
    t = picked(k, *FIELDS)
    e = e.select("event_id", t.alias("t"), numbers.field_hits(t, numbers.ROLES).alias("r"), numbers.field_hits(t, numbers.PROPERTIES).alias("p"))
    score, status = numbers.cluster_score(F.col("r"), F.col("p")), F.when(k % 4 == 1, "failed").when(k % 4 > 1, "ok")
    return e.select(
        "event_id",
        F.round(score, 9).alias("score"),
        numbers.cluster_level(F.col("r"), F.col("p")).alias("level"),
        numbers.cluster_level(F.col("r"), F.col("p"), score, status).alias("guarded"),
        F.round(numbers.recognition_rank(F.col("r"), F.col("p"), F.lit(0.5), F.col("t")), 9).alias("rank"),
        joined(numbers.angles(picked(k, "top", "bottom", "left", "right", "nowhere"))).alias("angles"),
    )


@query(f"""
SELECT user_id, CASE WHEN n = 0 THEN 'ocr_no_successful_candidate' WHEN strong >= greatest(2, n // 2) THEN 'ocr_field_cluster_candidate' ELSE 'ocr_not_reliable_for_current_scans' END AS verdict
FROM (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS n, count(*) FILTER (WHERE event_type <> 'error' AND {picked_sql("event_id", *ROLES)} >= 2 AND {picked_sql("event_id", *PROPERTIES)} >= 2) AS strong FROM events GROUP BY user_id)
""")
def probe_verdicts(spark, sf_dir):
    t = picked(F.col("event_id"), *FIELDS)
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("user_id", (F.col("event_type") != "error").alias("ok"), numbers.field_hits(t, numbers.ROLES).alias("r"), numbers.field_hits(t, numbers.PROPERTIES).alias("p"))
    return e.groupBy("user_id").agg(numbers.probe_verdict(F.col("ok"), F.col("r"), F.col("p")).alias("verdict"))


def _settings(spark) -> DataFrame:
    """What the settings' checks say, as rows (part, item)."""
    from vellumen.sources import config

    good = {"qwen": {"base_url": "u", "model": "m", "api_key": "k", "temperature": 0}, "paths": dict.fromkeys(("input_dir", "output_dir", "work_dir", "log_dir"), "x"), "runtime": {"dry_run": True}}
    bad = {"qwen": {"base_url": 3, "temperature": "hot"}, "paths": 5}
    rows = [("good_errors", str(len(config.problems(good)[0])))] + [("error", x) for x in config.problems(bad)[0]] + [("warning", x) for x in config.problems(bad)[1]]
    rows += [("hidden", json.dumps(config.redacted({"a": 1, "Api_Key": "s", "in": {"token": "t", "x": 2}}))), ("environment", json.dumps(config.environment("# c\nexport A='b c'\nB=\"d\"\nC = e=f\nno\n"))), ("names", ",".join(config.names(" a, b ,a,,c")))]
    rows += [("below", str(config.under("/tmp/a/../b", "/tmp")))]
    try:
        config.under("/tmp/../etc", "/tmp")
    except ValueError:
        rows.append(("outside", "refused"))
    return spark.createDataFrame(rows, "part string, item string")


@query("""
SELECT * FROM (VALUES ('good_errors', '0'), ('error', 'section paths: not given, or no section'), ('error', 'section runtime: not given, or no section'), ('error', 'qwen.base_url: a text is expected'), ('error', 'qwen.model: not given'), ('error', 'qwen.temperature: a number is expected'),
    ('warning', 'qwen.api_key: not given, so that only recorded answers can be used'), ('hidden', '{"a": 1, "Api_Key": "<redacted>", "in": {"token": "<redacted>", "x": 2}}'), ('environment', '{"A": "b c", "B": "d", "C": "e=f"}'), ('names', 'a,b,c'), ('below', '/tmp/b'), ('outside', 'refused')) AS t(part, item)
""", registered=False)
def settings(spark, sf_dir):
    return _settings(spark)


# ---- the branches that plain names don't reach

NAMES = ("ＪＳ１－２", "a_b—c–d", "\u3000x\u3000y ", "无", " NULL ", "é Ⅷ", "COM1", "lpt9", "y" * 181, "tail.", 'q"*?', None)
NORMAL = {
    "plain": ("ＪＳ１－２", "a_b—c–d", "xy", "", "", "éⅧ", "COM1", "lpt9", "y" * 181, "tail.", 'q"*?', ""),
    "folded": ("ｊｓ１－２", "a_b—c–d", "xy", "无", "null", "éⅷ", "com1", "lpt9", "y" * 181, "tail.", 'q"*?', ""),
    "dashed": ("ＪＳ１－２", "a-b—c–d", "xy", "无", "NULL", "éⅧ", "COM1", "lpt9", "y" * 181, "tail.", 'q"*?', ""),
    "compatible": ("JS1-2", "A-B-C-D", "XY", "无", "NULL", "ÉVIII", "COM1", "LPT9", "Y" * 181, "TAIL.", 'Q"*?', ""),
    "blockers": ("", "", "", "missing_drawing_number", "missing_drawing_number", "", "drawing_number_is_windows_reserved_name", "drawing_number_is_windows_reserved_name", "drawing_number_too_long", "drawing_number_has_invalid_trailing_char", "drawing_number_has_illegal_filename_chars", "missing_drawing_number"),
    "safe": ("ＪＳ１－２", "a_b—c–d", "x_y", "无", "NULL", "é_Ⅷ", "COM1", "lpt9", "y" * 120, "tail", "q", None),
    "risks": ("", "", "filename_changed_by_sanitization", "", "", "filename_changed_by_sanitization", "", "", "filename_truncated", "filename_changed_by_sanitization", "filename_changed_by_sanitization", "drawing_number_missing"),
}


@query(f"SELECT event_id, {', '.join(f'{picked_sql("event_id", *v)} AS {k}' for k, v in NORMAL.items())} FROM events")
def names_of_all_scripts(spark, sf_dir):
    """Names in other scripts and forms, reserved and too long ones, and the branches of each normalisation."""
    c = picked(F.col("event_id"), *NAMES)
    s = text.sanitized(c)
    return read(spark, sf_dir, "events", "event_id").select("event_id", text.number_plain(c).alias("plain"), text.number_folded(c).alias("folded"), text.number_dashed(c).alias("dashed"), text.number_compatible(c).alias("compatible"), joined(text.filename_blockers(c)).alias("blockers"), s["name"].alias("safe"), joined(s["risks"]).alias("risks"))


@query("""
SELECT event_id::VARCHAR AS task_id, 'v' || event_id % 3 AS model_variant, 0 AS temperature, event_id % 4 <> 2 AS unknown, event_id % 4 = 2 AS fine FROM events
""")
def decisions_of_variants(spark, sf_dir):
    """Decisions that carry a model's variant and settings, and ask for a review where the drawing number isn't known."""
    def body(number: object) -> str:
        return json.dumps(json.loads(NESTED[0]) | {"drawing_number": {"selected": number}}, ensure_ascii=False)

    k = F.col("task_id").cast("long")
    raw = responses(spark, sf_dir).withColumn("ok", F.lit(True)).withColumn("http_status", F.lit("200"))
    raw = raw.withColumn("response_json", F.to_json(F.struct(F.array(F.struct(F.struct(picked(k, body(" N/A "), body("看 不清"), body("JS-1"), "no json").alias("content")).alias("message"))).alias("choices"))))
    raw = raw.select("*", F.concat(F.lit("v"), (k % 3).cast("string")).alias("model_variant"), F.lit(0).alias("temperature"))
    d = answers.orientation_decisions(raw, ("model_variant", "temperature"), number=True)
    return d.select("task_id", "model_variant", "temperature", F.array_contains("review_reasons", "drawing_number_missing_or_unknown").alias("unknown"), (~F.col("needs_review")).alias("fine"))
