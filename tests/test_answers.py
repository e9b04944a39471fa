"""Answers, numbers and texts: hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from vellumen.functions import answers, numbers, text

RAW = "task_id string, source_pdf string, page_number int, model string, ok boolean, http_status string, attempt_count int, error_type string, error_message string, response_json string, request_kind string, endpoint string, response_text string"


def row(task, body, ok=True, status="200", error=""):
    return (task, "in/a.pdf", 1, "m", ok, status, 1, error, "", body, "k", "e", "text")


def said(content):
    return json.dumps({"choices": [{"message": {"content": content}}]}, ensure_ascii=False)


GOOD = {"title_block_position": "bottom", "confidence": 0.9, "evidence": ["x"], "needs_human_review": False, "review_reasons": []}


def decided(spark, *cases):
    rows = answers.orientation_decisions(spark.createDataFrame([row(str(i), *c) for i, c in enumerate(cases)], RAW)).collect()
    return {int(r["task_id"]): r for r in rows}


def test_flat_fenced_nested_and_listed_answers(spark):
    nested = {"page_orientation": {"title_block_position": " left ", "confidence": 1, "evidence": []}, "quality_gate": {"needs_human_review": False, "review_reasons": []}}
    body = json.dumps(GOOD)
    got = decided(
        spark,
        (said(body),),
        (said(f"```json\n{body}\n```"),),
        (said(f"Here: {body} done"),),
        (said(json.dumps(nested)),),
        (json.dumps({"choices": [{"message": {"content": [{"text": body}, {"type": "image"}]}}]}),),
        (said(body[:-1] + ', "confidence": 0.4}'),),
    )
    for i in (0, 1, 2, 4):
        assert (got[i]["title_block_position"], got[i]["correction_clockwise_degrees"], got[i]["schema_status"], got[i]["needs_review"]) == ("bottom_edge", 0, "ok", False)
    assert (got[3]["title_block_position"], got[3]["current_clockwise_degrees"], got[3]["correction_clockwise_degrees"]) == ("left_edge", 90, 270)
    assert got[5]["confidence"] == 0.4  # the last of repeated keys


def test_what_is_wrong_is_told(spark):
    bad = [GOOD | x for x in ({"confidence": True}, {"confidence": 2}, {"confidence": "0.5"}, {"evidence": "x"}, {"needs_human_review": "no"}, {"review_reasons": None}, {"title_block_position": "middle"}, {"title_block_position": "unknown"}, {"needs_human_review": True, "review_reasons": ["b", "", 3, "a"]})]
    got = decided(spark, *[(said(json.dumps(b)),) for b in bad], (said("[1, 2]"),), (said(" "),), (said("none"),), ("[]",), ('{"choices": []}',), ('{"choices": [1]}',), ('{"choices": [{}]}',), (said(None),), (None, False, "503", ""), (None, False, None, "dry_run"), (None, False, None, None), (said('{"confidence": NaN}'),))
    reasons = {i: r["review_reasons"] for i, r in got.items()}
    for i, code in enumerate(("invalid_confidence",) * 3 + ("evidence_not_list", "needs_human_review_not_bool", "review_reasons_not_list")):
        assert reasons[i] == [code]
    assert reasons[6] == ["invalid_title_block_position", "unknown_title_block_position_for_rotation"]
    assert reasons[7] == ["unknown_title_block_position_for_rotation"] and got[7]["schema_status"] == "ok"
    assert reasons[8] == ["model:a", "model:b", "model_marked_needs_human_review"]
    assert reasons[9] == ["decision_not_object", "missing_title_block_position_for_rotation"] and got[9]["parse_status"] == "ok"
    assert [reasons[i][0] for i in (10, 11)] == ["empty_message_content", "content_json_parse_failed"]
    assert [reasons[i][-1] for i in (12, 13)] == ["response_not_json_object", "missing_title_block_position_for_rotation"] and "missing_choices" in reasons[13]
    assert "choice_not_object" in reasons[14] and "missing_message" in reasons[15] and "missing_message_content" in reasons[16]
    assert [next(x for x in reasons[i] if x.startswith("api_error")) for i in (17, 18, 19)] == ["api_error:503", "api_error:dry_run", "api_error:None"]
    assert "invalid_confidence" in reasons[20] and got[20]["needs_review"]


def test_number_decisions(spark):
    good = {"selected_drawing_number": " JS 01-2 ", "candidates": ["JS01-2", "无", 3], "confidence": 0.5, "evidence": [], "needs_human_review": False, "review_reasons": []}
    cases = [good, good | {"selected_drawing_number": "A/B"}, good | {"selected_drawing_number": "看不清"}, good | {"candidates": None, "confidence": True}]
    raw = spark.createDataFrame([row(str(i), said(json.dumps(c, ensure_ascii=False))) for i, c in enumerate(cases)] + [row("9", said("number AB12-3-45 seen"))], RAW)
    got = {int(r["task_id"]): r for r in answers.number_decisions(raw).collect()}
    assert (got[0]["selected_drawing_number"], got[0]["final_filename_stem"], got[0]["candidates"], got[0]["review_reasons"]) == ("JS01-2", "JS01-2", ["JS01-2"], [])
    assert got[1]["review_reasons"] == ["drawing_number_has_illegal_filename_chars"] and got[1]["final_filename_stem"] == ""
    assert got[2]["review_reasons"] == ["missing_drawing_number"] and got[2]["selected_drawing_number"] == ""
    assert got[3]["review_reasons"] == ["candidates_not_list", "invalid_drawing_number_confidence"]
    loose = {int(r["task_id"]): r for r in answers.number_decisions(raw, lenient=True, fallback_pattern=r"[A-Z]{2}\d+(?:-\d+)+").collect()}
    assert loose[3]["review_reasons"] == ["schema_error"] and loose[9]["candidates"] == ["AB12-3-45"]
    assert {r["response_text"] for r in answers.public_raw(raw).collect()} == {""}


def test_other_answers(spark):
    judgment = {f: 1 for f in answers.JUDGMENT_FIELDS}
    full = dict.fromkeys(answers.TEACHER_FIELDS) | {"rotation_degrees": 90, "title_block_position": "top"}
    cases = [full | {"confidence": True, "candidate_judgments": [judgment]}, {"task_id": "z", "rotation_degrees": 1, "confidence": 3, "candidate_judgments": [{k: v for k, v in judgment.items() if k != "candidate_index"}, 5]}, [], {"page_orientation": {"title_block_position": "top", "confidence": 1, "evidence": []}, "drawing_number": {}}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, j string").withColumn("v", F.try_parse_json("j"))
    got = df.select(answers.teacher_errors(F.col("v"), F.lit("t")), answers.nested_errors(F.col("v"))).collect()
    assert got[0][0] == [] and got[2][0] == ["missing_or_empty_parsed_response"]
    assert got[1][0] == [f"missing_required:{f}" for f in ("selected_candidate_index", "title_block_position", "needs_human_review")] + ["task_id_mismatch", "invalid_rotation_degrees", "invalid_confidence", "candidate_judgment_0:missing_required:candidate_index", "candidate_judgment_1:not_object"]
    assert got[3][1][:2] == ["missing_required:quality_gate", "page_orientation:invalid_title_block_position"] and got[3][1][-1] == "quality_gate:not_object"
    assert got[3][1][2:6] == [f"drawing_number:missing_required:{f}" for f in ("candidates", "selected", "confidence", "evidence")]


def values(spark, make, *cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r[1] for r in df.select("i", make(F.col("c"))).orderBy("i").collect()]


def test_names_and_numbers(spark):
    assert values(spark, text.safe_name, "a b/c", "..", "中文-1.x", "", None) == ["a_b_c", "pdf", "中文-1.x", "pdf", "pdf"]
    assert values(spark, text.number_plain, " A　1\t", "N/A", None, "无法确定", "x y") == ["A1", "", "", "", "xy"]
    assert values(spark, text.number_compatible, "ａ_1—2", None, " b ") == ["A-1-2", "", "B"]
    assert values(spark, text.filename_blockers, "a?.", "com1", "x" * 181, "ok", "") == [["drawing_number_has_illegal_filename_chars", "drawing_number_has_invalid_trailing_char"], ["drawing_number_is_windows_reserved_name"], ["drawing_number_too_long"], [], ["missing_drawing_number"]]
    got = values(spark, text.sanitized, " a b/c. ", "", " .. ", "x" * 130)
    assert [(r["name"], r["risks"]) for r in got] == [("a_b_c", ["filename_changed_by_sanitization"]), (None, ["drawing_number_missing"]), (None, ["filename_empty_after_sanitization"]), ("x" * 120, ["filename_truncated"])]
    assert values(spark, text.whole_number, "3.0", "x", None, "-2") == [3, None, None, -2]
    assert values(spark, text.right_angle, "450", "", None, "-90") == [90, None, None, 270]
    with pytest.raises(Exception, match="not a right angle"):
        values(spark, text.right_angle, "45")
    assert values(spark, text.lines_joined, " a \n\n b\r\n") == ["a\nb"]
    assert values(spark, text.file_stem, "/x/a.b.pdf", "c", ".hidden", "d\\e.PDF") == ["a.b", "c", ".hidden", "e"]
    assert values(spark, lambda c: text.percent_after(c, "上侧"), "上侧约20%", "上侧95%", "左侧5%") == [0.2, 0.8, 0.0]
    assert values(spark, lambda c: text.relative_path(c, "/r"), "/r/a/b", "/x/a") == ["a/b", "/x/a"]
    assert values(spark, text.endpoint, "https://h/compatible-mode/v1/", "https://h/api/v1", "https://h", "https://h/x", "https://h/v/chat/completions") == ["https://h/compatible-mode/v1/chat/completions", "https://h/compatible-mode/v1/chat/completions", "https://h/compatible-mode/v1/chat/completions", "https://h/x/chat/completions", "https://h/v/chat/completions"]
    assert values(spark, lambda c: text.verdict(c, "number"), " 正确 ", "有误", "空", "看不清", "", None, "?") == ["correct", "incorrect", "missing", "uncertain", "blank", "blank", "other"]
    assert values(spark, lambda c: text.verdict(c, "error_first"), "OK", "错", "?", "") == ["correct", "wrong", "other", "blank"]
    assert values(spark, lambda c: text.verdict(c, "workbook"), "Right", "存疑", "x", "") == ["正确", "不确定", "x", "空白"]
    assert values(spark, lambda c: text.verdict(c, "numbers_review"), "这个正确", "不正确", "有错误", "?") == ["correct", "incorrect", "incorrect", "unreviewed_or_unknown"]
    assert values(spark, text.task_sample, "a__sample_001__candidate_2", "b__aug90_3", "plain") == ["sample_001", "aug90_3", "plain"]
    assert values(spark, text.sample_of_stage, "x__y_sample_3.png", "sample_4.png", "z.png") == ["y_sample_3", "sample_4", "z"]
    assert values(spark, text.sample_of_result, "d/aug90_1.png", "p_sample_007_x.png") == ["aug90_1", "sample_007"]
    assert values(spark, text.coarse_position, "右下方", " top ") == ["bottom", "top"]
    assert values(spark, text.rotation_group, "top_right", "x", None) == [270, None, None]
    assert values(spark, lambda c: text.label_matches(F.lit("下方"), F.lit("bottom_edge"), c, {"下方": "bottom_edge", "底部": "bottom_edge"}), "下方", "底部", "x", "", None) == [True, True, False, False, False]
    note = values(spark, lambda c: text.note_tags(c, F.lit("范围太大")), "上侧减少 15%，蓝色更好，图号模糊")[0]
    assert note["tags"] == ["drawing_number_blurry", "percent_15", "prefer_bottom_right_blue_roi", "roi_too_large", "trim_top"]
    assert note["suggestions"] == ["优先评估蓝框右下区域候选", "上侧减少约15%", "图号模糊样本保留人工识别或 VLM 兜底"]
    got = json.loads(values(spark, lambda c: text.request_row(F.lit("k"), F.lit("m"), c, F.lit("p"), F.lit("i.png")), "t")[0])
    assert got["custom_id"] == "k__m__t" and got["body"]["messages"][0]["content"][1]["image_url"]["url"] == "<omitted_png_data_url:i.png>"
    assert spark.sql("SELECT X'00' c").select(text.data_url(F.unhex(F.repeat(F.lit("61"), 100)))).first()[0].count("\n") == 0


def test_candidates(spark):
    cases = ["图号JS9107-01-02 设计", "\\\\server\\AB12-1-7.dwg", "名称泵体 JS22-01-7 签字\nQQ-1-1 序号", "2024-01-02", "", None]
    got = values(spark, numbers.number_candidates, *cases)
    assert [(c["value"], c["source"]) for c in got[0]] == [("JS9107-01-02", "near_label")] and got[0][0]["score"] == 0.99
    assert got[1] == [] and got[3] == [] and got[4] == [] and got[5] == []
    assert got[2][0]["value"] == "JS22-01-7" and got[2][0]["reasons"][0] == "global_pattern"
    chosen = values(spark, lambda c: numbers.selection(numbers.number_candidates(c)), *cases)
    assert (chosen[0]["selected"], chosen[0]["status"]) == ("JS9107-01-02", "single_high_confidence_candidate")
    assert (chosen[4]["status"], chosen[4]["blockers"]) == ("missing", ["drawing_number_missing"])
    df = spark.createDataFrame([("A1-B2", "A7-B22"), ("x", "x"), ("", "y"), (None, "y")], "a string, b string")
    ops = df.select(numbers.diff_operations(F.col("a"), F.col("b")).alias("o")).collect()
    assert [(o["op"], o["machine"], o["manual"], o["machine_span"]) for o in ops[0]["o"]] == [("replace", "1", "7", "1:2"), ("insert", "", "2", "5:5")]
    assert [len(o["o"]) for o in ops[1:]] == [0, 0, 0]
    pairs = df.limit(1).select(numbers.char_confusions(numbers.diff_operations(F.lit("abX"), F.lit("cdX")))).first()[0]
    assert [(p["machine"], p["manual"]) for p in pairs] == [("a", "c"), ("b", "d")]
    hits = values(spark, lambda c: numbers.field_hits(c, numbers.ROLES), "设计 审核", "x")
    assert hits == [["设计", "审核"], []]


def test_nested_answers_stay_with_their_rows(spark, tmp_path):
    from vellumen.plans.queries_text import nested_answers

    events = spark.createDataFrame([(i, i, 1.0) for i in (0, 1, 1, 2, 3, 4)], "event_id long, user_id long, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    df = nested_answers(spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()  # nothing for the driver to broadcast
    assert sorted((r["event_id"], r["position"], r["fine"]) for r in df.collect()) == [(0, "bottom_edge", True), (1, "nowhere", False), (1, "nowhere", False), (2, "top_edge", True), (3, None, False), (4, None, False)]
