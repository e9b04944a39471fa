"""Composite records and summaries."""

import json

import pytest
from pyspark.sql import functions as F

from vellumen.plans import records


def test_calibration_memory(spark):
    form = spark.createDataFrame(
        [("s1", "范围太大", "错误", "JS-12", "上侧减少 10%"), ("s2", "正确", "正确", "", ""), ("s3", "看不清", "看不清", "", "图号模糊"), ("s4", "范围太大", "未识别", "js_9", "上侧减少 10%")],
        "sample_id string, roi_judgment string, number_judgment string, manual_number string, note string",
    )
    machine = spark.createDataFrame([("s1", "JS-17", 0.9, "", ""), ("s2", "", None, "AB-1", "0.5")], "sample_id string, fine_candidate string, fine_score double, coarse_candidate string, coarse_score string")
    events = records.calibration_events(form, machine, "day").cache()
    got = {r["sample_id"]: r for r in events.collect()}
    assert [(got[s]["calibration_outcome"], got[s]["final_drawing_number"]) for s in ("s1", "s2", "s3", "s4")] == [("manual_corrected", "JS-12"), ("machine_confirmed", "AB-1"), ("unresolved_requires_manual_identification", None), ("manual_supplied_missing", "JS-9")]
    assert [(c["machine"], c["manual"]) for c in got["s1"]["candidate_char_confusions"]] == [("7", "2")] and got["s2"]["machine_coarse_score"] == 0.5
    rules = [(r["rule_id"], r["support"]) for r in records.transplantable_rules(events).orderBy("rule_id").collect()]
    assert rules == [("manual-fallback-required", 1), ("ocr-confusion-3", 1), ("roi-adjustment-2", 2), ("roi-too-large-quality-gate", 2)]
    rate = records.confirmed_rate(events).first()
    assert (rate["events"], rate["resolved"], rate["confirmed_rate"]) == (4, 3, 0.333333)
    assert records.session_rows(events, "day").count() == 4 and records.session_rows(events, "other").count() == 0


def test_evidence(spark):
    one = spark.range(1).select(
        records.missing_evidence(F.lit(None).cast("string"), F.lit("missing"), F.lit(None).cast("string")),
        records.evidence_conflicts(F.lit("weak"), F.lit("left"), F.lit("bbox_nearest_page_side"), F.lit("right")),
        records.evidence_conflicts(F.lit("strong"), F.lit("left"), F.lit("proxy"), F.lit("right")),
        records.evidence_conflicts(F.lit("strong"), F.lit("left"), F.lit("proxy"), F.lit("left")),
        records.rename_plan(F.lit("a/b"), F.array(F.lit("z")), F.lit(False), F.lit(True)),
        records.rename_plan(F.lit("ok"), F.array().cast("array<string>"), F.lit(True), F.lit(False)),
        records.crop_blockers(F.lit("p"), F.lit(False)),
        records.recognition_blockers(F.lit(""), F.lit("weak")),
    ).first()
    assert one[0] == ["yolo_selected_title_block", "ocr_selected_candidate", "opencv_rotation_result"]
    assert one[1] == ["ocr_field_cluster_weak", "yolo_opencv_position_conflict:left!=right"] and one[2] == ["position_source_not_comparable:proxy:left!=right"] and one[3] == []
    assert one[4]["name"] == "a_b" and one[4]["changed"] and one[4]["blockers"] == ["filename_changed_by_sanitization", "renamed_pdf_candidate_would_overwrite", "upstream_rotation_blocked", "z"]
    assert one[5]["can_rename"] and one[6] == ["title_block_crop_not_found"] and one[7] == ["missing_ocr_text", "ocr_field_cluster_not_strong"]


def test_candidates_are_expanded(spark):
    recs = spark.createDataFrame([("d", "a", 0), ("d", "b", 3), ("d", "c", None)], "prediction_dir string, sample string, selected_candidate_index int")
    cand = spark.createDataFrame([("d", "a", 0, 0.9), ("d", "a", 1, 0.5)], "prediction_dir string, sample string, candidate_index int, score double")
    rej = spark.createDataFrame([("d", "a", 1, None, "why")], "prediction_dir string, sample string, candidate_index int, score double, reason string")
    seen = spark.createDataFrame([("d", "a", 0, "text")], "prediction_dir string, sample string, candidate_index int, ocr string")
    got = records.expanded_candidates(recs, cand, rej, seen).orderBy("sample", "candidate_index").collect()
    assert [(r["sample"], r["candidate_index"], r["score"], r["rejected"], r["selected"], r["ocr"]) for r in got] == [("a", 0, 0.9, False, True, "text"), ("a", 1, None, True, False, None), ("b", 3, None, False, True, None)]


def test_summaries_and_data_sets(spark):
    r = spark.createDataFrame([("accepted", ["multi_candidate_resolved"], 2, 1), ("needs_review", ["missing_title_block"], 0, 0)], "status string, issue_types array<string>, prediction_count int, rejected_count int")
    s = records.postprocess_summary(r).first()
    assert (s["total"], s["accepted"], s["missing_prediction_label"], s["multi_candidate"], s["rejected_candidates"]) == (2, 1, 1, 1, 1)
    assert records.multi_candidate_summary(r, 2).first()["expected_false_positive_rejected"] == 2
    t = spark.createDataFrame([("a", "l", "l", "l", True), ("b", "l", "r", "l", False), ("c", None, "r", "l", None)], "s string, x string, y string, t string, v boolean")
    w = records.three_way(t, F.col("x"), F.col("y"), F.col("t"), F.col("v"), "s").first()
    assert (w["ours_match"], w["theirs_match"], w["corrected_samples"], w["unsure_samples"], w["our_rate"]) == (2, 1, ["b"], ["a"], 0.666667)
    assert records.three_way(t.limit(0), F.col("x"), F.col("y"), F.col("t"), F.col("v"), "s").first()["our_rate"] == 0.0
    truth = records.ground_truth(spark.createDataFrame([("b", "left", "90", "manual_review_x"), ("a", "top", "180", None)], "sample string, title_block_position string, rotation_degrees string, basis string"))
    assert [(x["sample"], x["verified_by_human"], x["source_level"]) for x in truth.collect()] == [("a", False, "unknown"), ("b", True, "manual_review")]
    aug = records.augmented_truth(truth, ["sample"]).collect()
    assert sorted((x["sample"], x["applied_clockwise_rotation_degrees"]) for x in aug) == [("aug90_001_from_a", 270), ("aug90_002_from_b", 0)]
    man = spark.createDataFrame([("aug_1_from_s1", "g"), ("s2", "keep")], "sample string, group string")
    old = spark.createDataFrame([("s2", "s9", "d", "top", 180)], "sample string, source_sample string, dataset string, title_block_position string, rotation_degrees int")
    hard = records.hard_cases(man, old, "keep")
    assert sorted((x["source_sample"], x["split"]) for x in hard.collect()) == [("s1", "train"), ("s9", "val")]
    gate = records.dataset_summary(hard, spark.createDataFrame([("s2", 1)], "sample string, n long")).first()
    assert (gate["records"], gate["without_one_label"], gate["passed"]) == (2, 1, False)
    pred = spark.createDataFrame([("d", "x", 1), ("d", "y", 0), ("d", "z", 1)], "prediction_dir string, sample string, prediction_count int")
    groups = spark.createDataFrame([("g", "d", True)], "group string, prediction_dir string, members_only boolean")
    members = spark.createDataFrame([("x",), ("y",)], "sample string")
    assert [(x["sample"], x["needs_attention"]) for x in records.prediction_groups(pred, groups, members).collect()] == [("y", True), ("x", False)]
    assert {x["status"] for x in records.stage_status(members, pred, "sample").collect()} == {"ok"}


def test_requests_and_retests(spark):
    rec = spark.createDataFrame([("t1",), ("t2",)], "task_id string")
    var = spark.createDataFrame([("v", "m")], "variant_id string, model string")
    assert sorted(r["custom_id"] for r in records.requests(rec, var, "k").collect()) == ["k__v__t1", "k__v__t2"]
    rows = spark.createDataFrame([("t", "pending", None, None), ("", "ok", json.dumps({"x": 1}), "bad")], "task_id string, parse_status string, parsed_response string, _json_error string")
    got = {r["task_id"]: r for r in records.validated_teacher(rows).collect()}
    assert got["t"]["errors"] == ["pending_response", "missing_or_empty_parsed_response"] and got[""]["errors"][:2] == ["json_error:bad", "missing_task_id"]
    dec = spark.createDataFrame([("1", "m", "bottom_right"), ("2", "m", "odd"), ("3", "m", "left_edge")], "page_number string, model string, title_block_position string")
    tru = spark.createDataFrame([("1", "bottom_edge"), ("2", "odd")], "page_number string, expected_position string")
    out = records.decision_against_truth(dec, tru)
    assert [(r["exact_match"], r["rotation_group_match"]) for r in out.orderBy("page_number").collect()] == [(False, True), (True, True), (False, False)]
    s = records.retest_summary(out, {"m": 0.1}).first()
    assert (s["exact_accuracy"], s["rotation_accuracy"], s["exact_change"]) == (0.3333, 0.6667, 0.2333)


def test_json_lines_know_their_places(spark, tmp_path):
    from vellumen.sources import files

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2, "y": "é"}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 3}\n  \nnot json\n[4]\n{"x": "five"}\n')
    good = files.json_records(spark, str(tmp_path / "a.jsonl"), "x int, y string")
    assert sorted(map(tuple, good.collect())) == [(1, None), (2, "é")]
    with pytest.raises(Exception, match=r"b\.jsonl:3: not the JSON"):
        files.json_records(spark, str(tmp_path / "b.jsonl"), "x int, y string").collect()
    rows = files.json_records(spark, str(tmp_path / "b.jsonl"), "x int, y string", tolerant=True).collect()
    assert sorted((r["x"] or 0, r["_json_error"] or "", r["_line_number"] or 0) for r in rows) == [(0, "[4]", 4), (0, "not json", 3), (0, '{"x": "five"}', 5), (3, "", 0)]
    lines = files.numbered_lines(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["n"] for r in files.line_counts(lines).collect()} == {"a.jsonl": 2, "b.jsonl": 4}
    split = spark.createDataFrame([("a", "train"), ("a", "val")], "sample string, split string")
    assert sorted((r["sample"], r["split"]) for r in files.listed_splits(lines.select("path").distinct(), split).collect()) == [("a", "val"), ("b", None)]


def test_files_are_published_once_and_whole(spark, tmp_path):
    from vellumen.plans import lifecycle
    from vellumen.sources import sinks

    for n in (1, 2, 3):
        (tmp_path / f"p{n}.pdf").write_bytes(b"page %d" % n)
    at = lambda *parts: str(tmp_path.joinpath(*parts))
    pages = spark.createDataFrame([(f"t{n}", at(f"p{n}.pdf")) for n in (1, 2, 3, 4)], "task_id string, split_pdf_path string")
    outputs = spark.createDataFrame([(f"t{n}", at("out", f"t{n}.pdf"), d) for n, d in ((1, 90), (2, 0), (3, 180), (4, 90))], "task_id string, output_pdf_path string, applied_pdf_rotate_clockwise int")
    finals = spark.createDataFrame([("t1", at("out", "t1.pdf"), at("end", "s", "A-1.pdf")), ("t2", at("out", "t2.pdf"), at("end", "s", "needs_review", "t2.pdf")), ("t4", at("out", "t4.pdf"), at("end", "s", "needs_review", "t4.pdf"))], "task_id string, corrected_pdf_path string, final_pdf_path string")
    done, ended = lifecycle.publish(pages, outputs, finals, at("log"), lambda content, degrees: content + b" turned %d" % degrees)
    assert {r["task_id"]: (r["status"], r["bytes"]) for r in done.collect()} == {"t1": ("turned", 16), "t2": ("copied", 6), "t3": ("turned", 17), "t4": ("missing", 0)}
    assert {r["task_id"]: r["status"] for r in ended.collect()} == {"t1": "copied", "t2": "copied", "t4": "missing"}
    assert (tmp_path / "end/s/A-1.pdf").read_bytes() == b"page 1 turned 90" and (tmp_path / "end/s/needs_review/t2.pdf").read_bytes() == b"page 2"
    again = sinks.place_files(finals, "corrected_pdf_path", "final_pdf_path").collect()  # as a repeated task does
    assert len(again) == 3 and sorted(p.name for p in (tmp_path / "end/s").rglob("*.pdf*")) == ["A-1.pdf", "t2.pdf"]
    with pytest.raises(Exception):
        lifecycle.publish(pages, outputs, finals, at("log"))


def test_command_line(tmp_path, capsys):
    from vellumen.__main__ import main
    from vellumen.sources import config

    good = tmp_path / "good.toml"
    good.write_text('[qwen]\nbase_url = "u"\nmodel = "m"\napi_key = "very secret"\n[paths]\ninput_dir = "i"\noutput_dir = "o"\nwork_dir = "w"\nlog_dir = "l"\n[runtime]\ndry_run = true\n')
    bad = tmp_path / "bad.toml"
    bad.write_text("[qwen\n")
    assert main([]) == 0 and "usage" in capsys.readouterr().out
    assert main(["config", "check"]) == 1
    assert main(["config", "check", "--config", str(good)]) == 0
    out = capsys.readouterr().out
    assert "Status: OK" in out and "secret" not in out
    assert main(["config", "check", "--config", str(bad)]) == 2 and "not TOML" in capsys.readouterr().out
    assert main(["dry-run", "--config", str(good)]) == 0
    out = capsys.readouterr().out
    assert "<redacted>" in out and "very secret" not in out and json.loads(out)["ok"]
    assert main(["dry-run", "--config", str(tmp_path / "none.toml")]) == 2 and main(["dry-run"]) == 2
    with pytest.raises(SystemExit) as ended:
        main(["nonsense"])
    assert ended.value.code == 2
    folder = tmp_path / "work" / "sub"
    folder.mkdir(parents=True)
    for name in (".gitkeep", "x"):
        (folder / name).write_text("")
    (folder / "deep").mkdir()
    assert [p.name for p in config.emptied(folder, tmp_path / "work").iterdir()] == [".gitkeep"]
    for refused in (tmp_path / "work", tmp_path):
        with pytest.raises(ValueError):
            config.emptied(refused, tmp_path / "work")


def test_several_candidates_a_page(spark):
    point = lambda x, y: (x, y)
    rows = [
        ("d", "s1", 0, 0.5, 0.04, (0.0, 0.0, 0.2, 0.2), [point(0.0, 0.0), point(0.2, 0.2)], 1.0, 1.0, 0.0, 0.0, []),
        ("d", "s1", 1, 0.5, 0.04, (0.4, 0.4, 0.6, 0.6), [point(0.4, 0.4), point(1.2, 0.6)], None, None, 1.0, 1.0, ["uniform_grid_like"]),
        ("d", "s2", 0, 0.9, 0.04, (0.0, 0.0, 0.2, 0.2), [point(0.0, 0.0)], 0.0, 0.0, 0.0, 0.0, None),
    ]
    schema = "prediction_dir string, sample string, candidate_index int, confidence double, area double, box struct<xmin:double,ymin:double,xmax:double,ymax:double>, points array<struct<x:double,y:double>>, frame_contact_score double, cell_area_variance double, uniform_grid_penalty double, inside_drawing_body_penalty double, diagnostic_flags array<string>"
    candidates = spark.createDataFrame(rows, schema)
    exceptions = spark.createDataFrame([("d", "s1", 1, True, True), ("d", "s2", 0, True, False)], "prediction_dir string, sample string, reject_index int, accepted boolean, small_angle boolean")
    found, told = records.multi_candidate_records(candidates, exceptions)
    by = {r["sample"]: r for r in found.collect()}
    assert (by["s1"]["status"], by["s1"]["selected_candidate_index"], by["s1"]["issue_types"]) == ("accepted", 0, ["multi_candidate_resolved", "manual_expected_accepted", "small_angle_offset_tolerated"])
    assert (by["s2"]["status"], by["s2"]["issue_types"]) == ("needs_review", ["expected_false_positive_not_rejected"])
    scores = {(r["sample"], r["candidate_index"]): r for r in told.collect()}
    assert scores["s1", 0]["multicandidate_score"] == pytest.approx(0.5 + 0.25 + 0.15 + 0.2 + 0.05)
    assert scores["s1", 1]["multicandidate_score"] == pytest.approx(0.5 + 0.2 - 0.35 - 0.4 - 0.5)
    assert scores["s1", 1]["rejection_reasons"] == ["not_selected_by_single_title_block_rule", "non_title_table_false_positive", "uniform_grid_like", "lower_confidence_duplicate_or_neighbor"]
    grouped = records.grouped_candidates(candidates.select("prediction_dir", "sample", "candidate_index", "confidence")).where("sample = 's1'").first()
    assert [c["candidate_index"] for c in grouped["candidates"]] == [0, 1]
