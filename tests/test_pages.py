"""Geometry, rules, a whole run, files, settings and the event memory."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from vellumen.functions import geometry as g
from vellumen.plans import lifecycle, rules, steps
from vellumen.sources import config, files, sinks, xlsx
from vellumen.streaming import memory


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def points(*pairs):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pairs))


def box(*v):
    return F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("xmin", "ymin", "xmax", "ymax"), strict=True)))


def test_geometry(spark):
    square = points((0.5, 0), (1, 0), (1, 0.5), (0.5, 0.5))
    r = one(spark, g.polygon_area(square), g.bbox(square), g.nearest_side(box(0.1, 0.1, 0.5, 0.5)), g.nearest_side(box(-0.3, 0.0, 0.5, 0.5), signed=True), g.axis_offset(square), g.axis_offset(points((0, 0), (1, math.tan(math.radians(10))), (1, 1))))
    assert r[0] == 0.25 and tuple(r[1]) == (0.5, 0.0, 1.0, 0.5) and r[2] == "left" and r[3] == "left" and r[4] == 0 and 0 <= r[5] <= 10.001
    r = one(spark, g.rotated_box(box(0, 0, 0.2, 0.1), F.lit(90)), g.rotated_box(box(0, 0, 0.2, 0.1), F.lit(180)), g.rotated_box(box(0, 0, 0.2, 0.1), F.lit(270)), g.overlap_area(box(0, 0, 2, 2), box(1, 1, 3, 3)), g.union_box(box(0, 0, 1, 1), box(2, 2, 3, 3)), g.pixels(F.lit(0.5), F.lit(5)), g.pixels(F.lit(1.2), F.lit(5)))
    assert tuple(r[0]) == pytest.approx((0.9, 0, 1, 0.2)) and tuple(r[1]) == pytest.approx((0.8, 0.9, 1, 1)) and tuple(r[2]) == pytest.approx((0, 0.8, 0.1, 1))
    assert r[3] == 1 and tuple(r[4]) == (0, 0, 3, 3) and r[5] == 2 and r[6] == 5
    none = F.lit(None).cast("double")
    frame = F.struct(F.lit(0.02).alias("left"), none.alias("right"), none.alias("top"), none.alias("bottom"))
    empty = F.struct(*(none.alias(n) for n in ("left", "right", "top", "bottom")))
    r = one(spark, g.frame_contact(box(0.03, 0.2, 0.9, 0.9), frame), g.frame_contact(box(0.2, 0.2, 0.9, 0.95), empty), g.aspect_position(box(0.1, 0.8, 0.9, 0.95)), g.bottom_crop(F.lit(100), F.lit(200)), g.bottom_crop(F.lit(200), F.lit(100)), g.box_of(F.array(F.lit("1"), F.lit("2"), F.lit("3"))))
    assert r[0]["nearest_frame_side"] == "left" and r[0]["frame_contact_score"] == pytest.approx(0.6) and r[0]["touches_frame_line"]
    assert r[1]["frame_contact_status"] == "unknown" and r[1]["nearest_frame_side"] == "bottom" and not r[1]["touches_frame_line"]
    assert r[2]["side"] == "bottom" and r[3]["box"]["ymin"] == 130 and r[4]["box"]["ymin"] == 70 and r[5] is None
    r = one(spark, g.tightened(box(0, 0, 1000, 500), F.lit(0.2), F.lit(0.1)), g.tightened(box(0, 0, 130, 90), F.lit(0.5), F.lit(0.5)), F.size(g.edge_windows(F.lit(100), F.lit(80))), F.size(g.side_bands(F.lit(10), F.lit(10))), g.around_centre(points((1, 1), (0, 0), (0, 1), (1, 0))))
    assert (r[0]["box"]["xmin"], r[0]["box"]["ymin"]) == (100, 100) and r[1]["box"]["xmin"] == 0 and len(r[1]["reasons"]) == 2 and r[2] == 20 and r[3] == 4
    assert [tuple(p) for p in r[4]] == [(0, 0), (1, 0), (1, 1), (0, 1)]


def side(name, score, component=0.0, crossing=0.0):
    return F.struct(F.lit(name).alias("side"), F.lit(float(score)).alias("score"), F.lit(component).alias("component_density"), F.lit(crossing).alias("intersection_density"))


def candidate(name, score, evidence):
    return F.struct(F.lit(name).alias("side"), F.lit(float(score)).alias("score"), F.lit(evidence).alias("evidence_score"))


def test_side_decision(spark):
    none = F.array().cast("array<struct<side:string,score:double,evidence_score:double>>")
    bands = F.array(side("top", 5), side("right", 3.5, 0.3), side("left", 1), side("bottom", 1))
    r = one(spark, rules.side_decision(bands, none), rules.side_decision(bands, F.array(candidate("top", 60, 0.6))), rules.side_decision(F.array(side("top", 5), side("right", 1), side("left", 4), side("bottom", 1)), F.array(candidate("bottom", 50, 0.5), candidate("left", 48, 0.48))), rules.side_decision(F.array(side("top", 1), side("right", 1), side("left", 1), side("bottom", 1)), none))
    assert r[0]["side"] == "right" and r[1]["side"] == "right" and r[2]["side"] == "left"
    assert r[3]["side"] == "top" and r[3]["needs_review"] and r[3]["confidence"] == 0.0


def texts(*items):
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def test_routes_and_arbitration(spark):
    def chosen(conf=0.9, touches=True, status="contact", flags=(), hints=()):
        return F.struct(F.lit(conf).alias("confidence"), texts(*flags).alias("candidate_flags"), texts(*hints).alias("diagnostic_flags"), F.lit(touches).alias("touches_frame_line"), F.lit(status).alias("frame_contact_status"))

    no, acc, rev = F.lit(False), F.lit("accepted"), F.lit("needs_review")
    r = one(
        spark,
        rules.record_routes(acc, texts("multi_candidate_resolved"), chosen(), no, F.lit("")),
        rules.record_routes(acc, texts(), chosen(touches=False, status="gap", conf=0.3), no, F.lit("")),
        rules.record_routes(rev, texts("manual_rejected", "part_false_positive"), chosen(conf=0.1, hints=["ocr_unavailable"]), no, F.lit("不可接受")),
        rules.record_routes(acc, texts("missing_title_block"), F.when(no, chosen()), F.lit(True), F.lit(None)),
    )
    assert [x["routes"] for x in r] == [["auto_accept"], ["human_review", "vlm_candidate"], ["human_review", "ocr_candidate", "retrain_candidate"], ["human_review", "vlm_candidate", "retrain_candidate"]]
    assert r[0]["reasons"] == ["multi_candidate_resolved"] and r[1]["reasons"] == ["selected_candidate_not_touching_frame", "low_confidence_human_review"]
    a = one(spark, rules.arbitration(acc, chosen(), texts(), texts(), texts("ocr_selected_candidate"), F.lit(0.85)), rules.arbitration(acc, chosen(), texts(), texts("yolo_opencv_position_conflict:x"), texts(), F.lit(0.85)), rules.arbitration(rev, chosen(), texts(), texts(), texts(), F.lit(0.9)))
    assert [(x["decision_status"], x["confidence_level"]) for x in a] == [("auto_accept", "high"), ("needs_vlm", "medium"), ("needs_human_review", "low")]
    assert a[0]["reasons"] == ["accepted_by_yolo_postprocess", "ocr_missing_but_geometry_available"]
    flags = F.array(texts("center_region"), texts("size_abnormal"))
    r = one(spark, rules.record_issues(F.lit(2), F.lit(None).cast("array<string>"), flags, F.lit("不可接受"), F.lit("超出边界")), rules.record_status(F.lit(1), texts("multi_candidate_resolved")), rules.record_status(F.lit(0), texts()), rules.calibration(F.lit("错误"), F.lit("JS-1"), F.lit(""), F.lit("JS-2")), rules.calibration(F.lit("正确"), F.lit(""), F.lit(""), F.lit("JS-2")), rules.calibration(F.lit("?"), F.lit("JS-3"), F.lit(""), F.lit("")), rules.note_layers(F.lit("abc"), {"x": ("b",), "y": ("z",)}), rules.note_layers(F.lit("q"), {"x": ("b",)}))
    assert r[0] == ["multi_candidate_resolved", "part_false_positive", "boundary_too_large", "manual_rejected"] and r[1] == "accepted" and r[2] == "needs_review"
    assert [tuple(x) for x in r[3:6]] == [("manual_corrected", "JS-1"), ("machine_confirmed", "JS-2"), ("manual_override_without_standard_judgment", "JS-3")]
    assert r[6] == ["x"] and r[7] == ["未分层"]


def test_regions_layers_and_advice(spark):
    def region(top, score, area, level):
        return F.struct(F.lit(top).alias("top_candidate"), F.lit(score).alias("top_score"), F.lit(area).alias("area_ratio"), F.lit(level).alias("cluster_level"))

    none = F.when(F.lit(False), region("A", 0.9, 0.5, "strong"))
    j = F.struct(F.lit(True).alias("is_true"), F.lit(True).alias("touches_frame"), F.lit("strong").alias("strength"), F.lit("low").alias("risk"), texts().alias("reject_reasons"))
    r = one(
        spark,
        rules.finer_region(region("A", 0.9, 0.5, "strong"), F.lit("A")),
        rules.finer_region(region("A", 0.5, 0.9, "weak"), F.lit("")),
        rules.finer_region(region("B", 0.9, 0.5, "strong"), F.lit("A")),
        rules.finer_region(none, F.lit("A")),
        rules.candidate_guard(F.lit("A"), F.lit("")),
        rules.region_score(F.lit(0.5), F.lit("A"), texts("设计"), texts(), F.lit(0.6)),
        rules.form_layers("crop", judgment=F.lit("x"), issue=F.lit("右侧缺"), note=F.lit("只有一半")),
        rules.form_layers("tightening", judgment=F.lit("正确"), relative=F.lit("更好"), issue=F.lit(""), note=F.lit("")),
        rules.form_layers("recovery", judgment=F.lit(None), issue=F.lit(None), note=F.lit(None)),
        rules.distill_targets(F.lit("hardcase_positive"), j, F.lit(True)),
        rules.advice(F.lit("hardcase_positive"), F.lit(True), F.lit(0.5)),
        rules.dry_run_plan(F.lit("auto_accept"), F.lit("p"), F.lit(False), F.lit(90), F.lit(True)),
        rules.dry_run_route(F.lit(False), texts("drawing_number_ambiguous"), texts("x", "x")),
    )
    assert [x["status"] for x in r[:4]] == ["fine_roi_candidate", "needs_review", "needs_review", "needs_review"]
    assert r[1]["reasons"] == ["fine_roi_not_much_smaller", "fine_candidate_low_confidence", "fine_field_cluster_not_strong"]
    assert r[2]["reasons"] == ["coarse_fine_candidate_conflict"] and r[3]["reasons"] == ["fine_roi_missing"] and r[4] == "new_roi_lost_previous_candidate"
    assert r[5] == pytest.approx(0.5 + 0.18 / 16 + 0.04 + 0.25) and r[6] == ["右侧或图号尾部缺失", "只覆盖半截标题栏"] and r[7] == ["新版ROI通过"] and r[8] == ["未分层"]
    assert r[9] == ["rule", "data", "provider"] and r[10] == rules.ADVICE["unsure"]
    assert r[11] == ["single_page_pdf_path_not_found", "corrected_pdf_candidate_would_overwrite"] and tuple(r[12]) == ("needs_human_review", ["drawing_number_ambiguous", "x"])


def test_images(spark):
    from vellumen.functions import images

    import numpy as np

    page = np.full((40, 60), 255, np.uint8)
    page[:, 3] = 0
    page[36, :] = 0
    df = spark.createDataFrame([("t", 60, 40, bytearray(page.tobytes()))], images.PIXELS)
    r = images.frame_lines(df).first()
    assert r["left"] == pytest.approx(3 / 59) and r["bottom"] == pytest.approx(36 / 39) and r["left_strength"] == 1.0
    assert images.quality(df).first()["dark_ratio"] == pytest.approx((40 + 60 - 1) / 2400)
    back = images.turned(images.turned(df.withColumn("degrees", F.lit(90))).withColumn("degrees", F.lit(270))).first()
    assert bytes(back["pixels"]) == page.tobytes() and images.turned(df.withColumn("degrees", F.lit(90))).first()["width"] == 40


def test_table_lines(spark):
    from vellumen.functions import images

    import numpy as np

    mask = np.array([[1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 0]], bool)
    assert sorted(images.components(mask)) == [(0, 0, 3, 2, 3), (0, 3, 1, 4, 1), (3, 2, 4, 3, 1)]
    r = np.random.default_rng(1)
    for _ in range(30):  # against flooding
        m = r.random((9, 11)) < 0.4
        left, n = {tuple(p) for p in np.argwhere(m)}, 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                y, x = todo.pop()
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
        assert len(images.components(m)) == n
    page = np.full((300, 400), 255, np.uint8)
    for y in range(200, 300, 30):
        page[y : y + 2, 200:390] = 0
    for x in range(200, 400, 60):
        page[200:292, x : x + 2] = 0
    lying, standing = images.line_masks(page)
    assert lying[200, 250] and standing[220, 201] and not lying[100].any()
    df = spark.createDataFrame([("t", 400, 300, bytearray(page.tobytes()))], images.PIXELS)
    bands = images.window_features(df.withColumn("windows", g.side_bands(F.col("width"), F.col("height")))).select("*", rules.evidence_score(F.col("line_density"), F.col("intersection_density")).alias("e")).orderBy(F.desc("band_score")).collect()
    assert {b["side"] for b in bands[:2]} == {"bottom", "right"} and bands[-1]["line_density"] == 0 and len(bands) == 4
    s = images.table_structure(df).first()
    assert s["structure_status"] == "ok" and s["cell_count_estimate"] == 9 and s["uniform_grid_penalty"] == 1.0
    box = images.table_region(df).first()
    assert box["status"] == "ok" and box["xmin"] < 200 and box["xmax"] >= 390
    blank = spark.createDataFrame([("t", 30, 30, bytearray(b"\xff" * 900))], images.PIXELS)
    assert images.table_region(blank).first()["status"] == "insufficient_column_signal" and images.table_structure(blank).first()["cell_count_estimate"] == 0


def test_scores_follow_the_formula(spark):
    rows = spark.range(1).select(box(0.7, 0.7, 0.98, 0.98).alias("box"), points((0.7, 0.7), (0.98, 0.7), (0.98, 0.98), (0.7, 0.98)).alias("points"), F.lit(0.0784).alias("area"), F.lit(0.8).alias("confidence"), F.struct(F.lit(1.0).alias("frame_contact_score"), F.lit(True).alias("touches_frame_line"), F.lit("contact").alias("frame_contact_status")).alias("contact"), F.lit(1.0).alias("axis_offset"), F.lit(0.9).alias("cell_area_variance"), F.lit(0.9).alias("small_large_mix"), F.lit(0.1).alias("uniform_grid_penalty"), texts().alias("diagnostic_flags"))
    r = rules.score_candidates(rows).first()
    edge = 1 - 0.02 / 0.12
    assert r["candidate_flags"] == ["near_edge", "touches_frame_line"]
    assert r["candidate_score"] == pytest.approx(0.8 + 0.25 * edge + 0.25 + 0.2 * (1 - 0.0384 / 0.04) - 0.035 + 0.08 + 0.04 + 0.03)


def test_a_run_publishes_and_holds_back(spark, tmp_path):
    def said(content):
        return json.dumps({"choices": [{"message": {"content": json.dumps(content)}}]})

    good = {"title_block_position": "top", "confidence": 0.9, "evidence": [], "needs_human_review": False, "review_reasons": []}
    number = lambda n: {"selected_drawing_number": n, "candidates": [], "confidence": 0.9, "evidence": [], "needs_human_review": False, "review_reasons": []}
    pages, raw = [], []
    for task, source, pos, num in (("a1", "a", "top", "N-1"), ("a2", "a", "left", "N-2"), ("a3", "a", "left", "N-2"), ("b1", "b", "left", "N-1"), ("b2", "b", "unknown", "N-9"), ("b3", "b", "top", None)):
        pages.append((task, f"in/{source}.pdf", source, 1, f"split/{task}.pdf", f"out/{task}.pdf"))
        raw.append((task, f"in/{source}.pdf", 1, "m", "orientation", "e", True, "200", 1, "", "", said(good | {"title_block_position": pos}), ""))
        if num:
            raw.append((task, f"in/{source}.pdf", 1, "m", "drawing_number", "e", True, "200", 1, "", "", said(number(num)), ""))
    raw.append(("a1", "in/a.pdf", 1, "m", "orientation", "e", False, "500", 0, "", "", None, ""))  # an earlier, failed attempt
    pages = spark.createDataFrame(pages, "task_id string, source_pdf string, source_stem string, page_number int, split_pdf_path string, output_pdf_path string")
    replay = lifecycle.Replay(spark.createDataFrame(raw, lifecycle.RAW))
    run = lifecycle.run(pages, "m", replay, "/pub")
    finals = {r["task_id"]: r for r in run.finals.collect()}
    assert {t for t, r in finals.items() if r["final_status"] == "published"} == {"a1", "b1"}
    assert finals["a1"]["final_pdf_path"] == "/pub/a/N-1.pdf" and finals["a2"]["final_blockers"] == ["duplicate_drawing_number"]
    assert finals["b2"]["final_blockers"] == ["missing_drawing_number_decision", "missing_final_filename_stem", "rotation_decision_needs_review", "rotation_output_not_corrected"]
    assert "drawing_number_api_not_ok" in finals["b3"]["final_blockers"] and finals["b3"]["final_pdf_path"] == "/pub/b/needs_review/b3.pdf"
    s = run.summary.first()
    assert (s["page_count"], s["orientation_api_ok_count"], s["corrected_count"], s["copied_needs_review_count"], s["published_count"], s["final_needs_review_count"]) == (6, 6, 5, 1, 2, 4)
    report = {r["corrected_pdf_path"]: r for r in run.report.collect()}
    assert report["out/b2.pdf"]["drawing_number"] == "" and report["out/b2.pdf"]["output_blockers"] == "missing_or_invalid_correction_degrees"
    assert run.needs_review.count() == 4 and len(run.report.columns) == 24
    again = lifecycle.run(pages, "m", replay, "/pub", store=lifecycle.written(str(tmp_path)))
    assert again.summary.first() == s and spark.read.parquet(f"{tmp_path}/orientation_raw_responses").count() == 6
    dry = lifecycle.run(pages, "m", lifecycle.DryRun(), "/pub", dry_run=True)
    assert dry.summary.first()["published_count"] == 0
    with pytest.raises(RuntimeError):
        lifecycle.run(pages, "m", lifecycle.DryRun(), "/pub")
    requests = pages.select("task_id", "source_pdf", "page_number", F.lit("m").alias("model"), F.lit("orientation").alias("request_kind"))
    assert lifecycle.pending(requests, replay.responses(requests).where("task_id <> 'a1'")).count() == 1
    answered = lifecycle.Calls(lambda r: (503, None, "busy") if r["task_id"] == "a1" else (200, "{}", "")).responses(requests)
    assert {(r["task_id"], r["ok"], r["attempt_count"]) for r in answered.where("task_id IN ('a1', 'a2')").collect()} == {("a1", False, 3), ("a2", True, 1)}


def test_providers_in_turn_and_recognition(spark):
    requests = spark.createDataFrame([("a", "s", 1, "m", "k"), ("b", "s", 1, "m", "k")], "task_id string, source_pdf string, page_number int, model string, request_kind string")
    ladder = lifecycle.Ladder([lifecycle.Calls(lambda r: (200, "{}", "") if r["task_id"] == "a" else (400, None, "no")), lifecycle.Calls(lambda r: (200, '{"second": 1}', ""))])
    assert {(r["task_id"], r["response_json"]) for r in ladder.responses(requests).collect()} == {("a", "{}"), ("b", '{"second": 1}')}

    def engine():
        return lambda pixels, width, height, angle: ("设计 图号" if angle == 90 else 1 / 0 if angle == 180 else "x" * 90, 0.5)

    pages = spark.createDataFrame([("t", 1, 1, bytearray(b"0"), [0, 90, 180])], "task_id string, width int, height int, pixels binary, angles array<int>")
    assert sorted(r["status"] for r in lifecycle.Recogniser(engine).texts(pages).collect()) == ["error:ZeroDivisionError", "ok", "ok"]
    assert lifecycle.Recogniser(engine).best(pages).first()["angle"] == 90


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("b.PDF", "a.pdf", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"x")
    found = files.list_files(spark, str(tmp_path / "in"))
    assert [os.path.basename(r["path"]) for r in found.collect()] == ["a.pdf", "b.PDF"]
    pages = files.page_rows(found, F.lit(3), "/w", "/o", limit_pages=2)
    assert sorted(r["task_id"] for r in pages.collect()) == ["a_page_001", "a_page_002", "b_page_001", "b_page_002"]
    assert files.page_rows(found, F.lit(3), "/w", "/o", limit_pages=0).count() == 6
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "none"))
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n', encoding="utf-8")
    got = files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", tolerant=True).collect()
    assert sorted((r["a"] or 0, r["_json_error"] is not None) for r in got) == [(0, True), (1, False)]
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    assert [r["line_number"] for r in files.bad_json_lines(spark, str(tmp_path / "x.jsonl")).collect()] == [3]
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), "a int", missing_ok=True).count() == 0
    (tmp_path / "r.json").write_text('{"candidates": [{"i": 1}, {"i": 2}]}', encoding="utf-8")
    assert files.json_report(spark, str(tmp_path / "r.json"), "candidates array<struct<i:int>>").count() == 2
    for name, encoding in (("u", "utf-8-sig"), ("g", "gb18030")):
        (tmp_path / f"{name}.csv").write_bytes("样本编号, 备注\n1, 图号 \n\n2\n".encode(encoding))
        assert [tuple(r) for r in files.csv_table(spark, str(tmp_path / f"{name}.csv"), ["样本编号", "备注"]).orderBy("样本编号").collect()] == [("1", "图号"), ("2", "")]
    with pytest.raises(Exception, match="no encoding"):
        files.csv_table(spark, str(tmp_path / "u.csv"), ["x"]).collect()
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text("0 0 0 1 0 1 1 0 1 0.9\n\n0 0 0 1 0 1 1 0\n0 x 0 1 0 1 1 0 1\n")
    lab = files.labels(files.numbered_lines(spark, str(tmp_path / "l")), confidence=True).orderBy("line_number").collect()
    assert [(r["confidence"], r["error"]) for r in lab] == [(0.9, None), (None, "format_error:line_3:field_count_8"), (None, "format_error:line_4:not_numeric")]
    path = lab[0]["path"]
    expected = spark.createDataFrame([(path,), ("gone",)], "path string")
    assert files.with_missing(expected, files.labels(files.numbered_lines(spark, str(tmp_path / "l")))).where("error = 'missing_prediction_label'").count() == 1
    (tmp_path / "p.json").write_text(json.dumps({"imageWidth": 10, "imageHeight": 20, "shapes": [{"label": "t", "points": [[10, 20], [0, 0], [0, 20], [10, 0]]}]}))
    r = files.polygons(spark, str(tmp_path / "p.json")).first()
    assert r["label"] == "t" and [tuple(p) for p in r["points"]] == [(0, 0), (1, 0), (1, 1), (0, 1)]


def test_forms_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, ["a", "b"], None), (2, None, [], "é,\"")], "n int, ok boolean, l array<string>, t string")
    sinks.driver_csv(rows, tmp_path / "r.csv", ["n", "ok", "l", "t"])
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbfn,ok,l,t\r\n1,True,a;b,\r\n")
    sinks.driver_csv(rows.limit(0), tmp_path / "e.csv", ["n"])
    assert (tmp_path / "e.csv").read_text(encoding="utf-8-sig") == "n\n"
    with pytest.raises(ValueError):
        sinks.driver_csv(rows, tmp_path / "r.csv", ["n"], most=1)
    sinks.xlsx_form(rows, tmp_path / "f.xlsx", ["n", "t"])
    got = xlsx.read_xlsx(spark, str(tmp_path / "f.xlsx"), ["t", "n"]).orderBy("n").collect()
    assert [tuple(r) for r in got] == [("", "1", True), ('é,"', "2", True)]
    sinks.json_rows(rows, str(tmp_path / "j"))
    assert '"t":null' in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("part*"))
    with pytest.raises(Exception):
        sinks.json_rows(rows, str(tmp_path / "j"))
    sinks.summary_json(rows.where("n = 1"), tmp_path / "s.json")
    assert json.loads((tmp_path / "s.json").read_text())["l"] == ["a", "b"]
    sinks.split_outputs(rows, str(tmp_path / "parts"), {"ok": F.col("ok"), "all": F.lit(True)})
    assert spark.read.json(str(tmp_path / "parts" / "all")).count() == 2
    sinks.csv_report(rows, str(tmp_path / "c"), ["n", "l"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_settings(tmp_path):
    good = '[qwen]\nbase_url = "u"\nmodel = "m"\n[paths]\ninput_dir = "i"\noutput_dir = "o"\nwork_dir = "w"\nlog_dir = "l"\n[runtime]\n'
    (tmp_path / "a.toml").write_text(good)
    checked = config.check(tmp_path / "a.toml")
    assert checked.ok and len(checked.warnings) == 1
    (tmp_path / "b.toml").write_text('[qwen]\napi_key = 3\ntemperature = "x"\nenable_thinking = 1\nbase_url = "u"\nmodel = 5\n[runtime]\ndry_run = "y"\n')
    assert config.check(tmp_path / "b.toml").errors == ("section paths: not given, or no section", "qwen.api_key: a text is expected", "qwen.enable_thinking: true or false is expected", "qwen.model: a text is expected", "qwen.temperature: a number is expected", "runtime.dry_run: true or false is expected")
    (tmp_path / "c.toml").write_text("= 1")
    assert config.check(tmp_path / "c.toml").errors[0].startswith("not TOML") and not config.check(tmp_path / "none").ok
    assert config.redacted({"q": {"API_KEY": "s", "x": 1}, "token": 2}) == {"q": {"API_KEY": "<redacted>", "x": 1}, "token": "<redacted>"}
    assert config.found(None, [tmp_path / "none", tmp_path / "a.toml"]) == tmp_path / "a.toml" and config.found(None, []) is None
    assert config.environment("# c\nexport A='1'\nB = 2\nx\n") == {"A": "1", "B": "2"}
    assert config.names(" a, b ,a,") == ["a", "b"]
    assert config.under(tmp_path / "x", tmp_path) == (tmp_path / "x").resolve()
    for bad in (tmp_path, tmp_path / ".." / "y"):
        with pytest.raises(ValueError):
            config.under(bad, tmp_path)
    assert steps.effects()["dry_run_enabled_step_count"] == 3 and not steps.effects()["current_run_has_side_effects"] and len(steps.report()) == 11


def test_event_memory_as_a_stream(spark, tmp_path):
    schema = "event_id string, session int, outcome string"
    source, kept, mark = (str(tmp_path / n) for n in ("in", "kept", "mark"))
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], schema).coalesce(1).write.parquet(source)
    stream = lambda: memory.keep(spark.readStream.schema(schema).parquet(source), kept, mark, ["event_id"], ["session"])
    stream().awaitTermination()
    spark.createDataFrame([("b", 0, "late but last read"), ("c", 1, "w")], schema).coalesce(1).write.mode("append").parquet(source)
    stream().awaitTermination()
    got = {r["event_id"]: r["outcome"] for r in memory.current(spark, kept).collect()}
    assert got == {"a": "z", "b": "late but last read", "c": "w"}
