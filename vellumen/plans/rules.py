"""Scores, blockers, routes and gates of candidates, pages and records, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumen.functions.geometry import clamp, scaled
from vellumen.functions.text import labels, let, sorted_unique, verdict


@dataclass(frozen=True)
class Weights:
    """Fixed values of the candidate score."""

    center_min: float = 0.20
    center_max: float = 0.80
    edge_threshold: float = 0.12
    min_area: float = 0.001
    max_area: float = 0.20
    target_area: float = 0.04
    cell_variance: float = 0.80
    small_large_mix: float = 0.55
    small_angle_mix: float = 0.80
    small_angle_degrees: float = 5.0
    faint_scan_score: float = 0.65
    positive: float = 0.08
    faint_scan: float = 0.04
    small_angle: float = 0.03
    uniform_table: float = 0.12


# The evidence that a teacher's rules go by.
RULE_EVIDENCE = {
    "teacher_frame_field_proxy_positive": "frame_contact_and_non_uniform_structure_proxy",
    "teacher_faint_scan_confidence_proxy": "strong_frame_contact_for_faint_or_ocr_unavailable_case",
    "teacher_uniform_table_negative": "uniform_grid_like_without_title_block_field_proxy",
    "teacher_small_angle_tolerated": "candidate_covers_frame_contact_title_block_structure",
}


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def has(items: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(items, name), F.lit(False))


def score_candidates(rows: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Adds candidate_flags, teacher_rule_flags, teacher_rule_evidence, teacher_rule_adjustment and candidate_score.

    Reads box, points, area, confidence, contact (of frame_contact), axis_offset, and of the
    diagnostics cell_area_variance, small_large_mix, uniform_grid_penalty and diagnostic_flags,
    null where there are none.
    """
    box, contact = F.col("box"), F.col("contact")
    middle = lambda a, b: ((box[a] + box[b]) / 2).between(w.center_min, w.center_max)
    edge = F.least(box["xmin"], box["ymin"], 1.0 - box["xmax"], 1.0 - box["ymax"])
    centre = middle("xmin", "xmax") & middle("ymin", "ymax")
    outside = F.exists("points", lambda p: ~p["x"].between(0, 1) | ~p["y"].between(0, 1))
    odd_size = ~F.col("area").between(w.min_area, w.max_area)
    uniform = has(F.col("diagnostic_flags"), "uniform_grid_like")
    touches = contact["touches_frame_line"]
    flags = labels(
        (centre, "center_region"),
        (outside, "out_of_page_bounds"),
        (odd_size, "size_abnormal"),
        (edge <= w.edge_threshold, "near_edge"),
        (touches, "touches_frame_line"),
        (~touches & (contact["frame_contact_status"] == "gap"), "frame_contact_gap"),
        (~touches & (contact["frame_contact_status"] != "gap"), "frame_contact_unknown"),
        (uniform, "uniform_grid_like"),
    )
    out = rows.withColumn("candidate_flags", flags)
    near = has(F.col("candidate_flags"), "near_edge")
    structured = (zero(F.col("cell_area_variance")) >= w.cell_variance) | (zero(F.col("small_large_mix")) >= w.small_large_mix)
    rules = [
        (touches & near & structured, "teacher_frame_field_proxy_positive", w.positive),
        (touches & ~uniform & (contact["frame_contact_score"] >= w.faint_scan_score), "teacher_faint_scan_confidence_proxy", w.faint_scan),
        (uniform, "teacher_uniform_table_negative", -w.uniform_table),
        (F.col("diagnostic_flags").isNotNull() & touches & near & ~uniform & (F.col("axis_offset") <= w.small_angle_degrees) & (zero(F.col("small_large_mix")) >= w.small_angle_mix), "teacher_small_angle_tolerated", w.small_angle),
    ]
    evidence = labels(*((c, RULE_EVIDENCE[n]) for c, n, _ in rules))
    adjustment = F.lit(0.0)
    for condition, _, weight in rules:
        adjustment += F.when(condition, weight).otherwise(0.0)
    flag = lambda name, weight: F.when(has(F.col("candidate_flags"), name), weight).otherwise(0.0)
    score = (
        zero(F.col("confidence"))
        + 0.25 * clamp(1.0 - F.greatest(edge, F.lit(0.0)) / w.edge_threshold)
        + 0.25 * contact["frame_contact_score"]
        + 0.20 * clamp(1.0 - F.abs(F.col("area") - w.target_area) / w.target_area)
        - flag("center_region", 0.55)
        - flag("out_of_page_bounds", 0.50)
        - flag("size_abnormal", 0.50)
        - 0.35 * zero(F.col("uniform_grid_penalty"))
        + adjustment
    )
    return out.select("*", labels(*((c, n) for c, n, _ in rules)).alias("teacher_rule_flags"), evidence.alias("teacher_rule_evidence"), adjustment.alias("teacher_rule_adjustment"), score.alias("candidate_score"))


def weighted_score(terms: dict[str, tuple[Column, float]]) -> Column:
    """Sum of terms times weights, missing terms as zero."""
    total = F.lit(0.0)
    for value, weight in terms.values():
        total += zero(value) * weight
    return total


# Weights of a candidate's evidence.
EVIDENCE = {"grid_balance": 0.18, "edge_proximity": 0.14, "size_reasonableness": 0.10, "local_contrast": 0.06}


def evidence_score(line_density: Column, intersection_density: Column) -> Column:
    """Evidence for a title block from densities and the columns of EVIDENCE."""
    parts = {"line": (scaled(line_density, 0.015, 0.080), 0.28), "intersection": (scaled(intersection_density, 0.00008, 0.0015), 0.24), **{k: (F.col(k), v) for k, v in EVIDENCE.items()}}
    return F.bround(weighted_score(parts), 6)


# Shares of the weights in the confidence of a candidate, and of a band.
CANDIDATE = {"evidence": 0.58, "margin": 0.28, "unrivalled": 0.14}
BAND = {"evidence": 0.62, "margin": 0.23, "unrivalled": 0.15}
# When a page's side is decided for another than the best band.
SIDE = {
    "right_of_top": 0.60,
    "right_component_density": 0.25,
    "right_close_to_top": 0.90,
    "left_evidence": 0.93,
    "left_band": 0.75,
    "left_evidence_in_left_band": 0.88,
    "strong_evidence": 0.43,
    "rival": 0.88,
    "good_evidence": 0.45,
    "good_score": 0.97,
    "least_confidence_if_good": 0.32,
    "review_below": 0.30,
    "score_low": 1.0,
    "score_high": 7.0,
}


def candidate_confidence(evidence: Column, margin: Column, ambiguity: Column) -> Column:
    return F.bround(clamp(CANDIDATE["evidence"] * evidence + CANDIDATE["margin"] * margin + CANDIDATE["unrivalled"] * (1.0 - ambiguity)), 4)


def side_decision(sides: Column, candidates: Column) -> Column:
    """Struct (side, score, evidence, confidence, needs_review) of a page.

    sides: array of structs (side, score, component_density, intersection_density), a page's
    four bands. candidates: array of structs (side, score, evidence_score). The band with the
    best score counts, but a right band with good table evidence beats the top; a candidate
    with strong evidence beats the band. Equals keep their order.
    """
    def best(items: Column) -> Column:
        return F.get(F.array_sort(items, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), 0)

    def of(items: Column, side: str | Column) -> Column:
        return best(F.filter(items, lambda s: s["side"] == side))

    yes = lambda c: F.coalesce(c, F.lit(False))

    def told(more: dict[str, Column], then) -> Column:
        """then() of a struct of these values, each worked out once."""
        return let(F.struct(*(c.alias(n) for n, c in more.items())), then)

    def banded(x: Column) -> Column:
        top, right = x["top"], x["right"]
        rather_right = (top["side"] == "top") & right.isNotNull() & (((right["score"] >= top["score"] * SIDE["right_of_top"]) & (right["component_density"] >= SIDE["right_component_density"])) | ((right["score"] >= top["score"] * SIDE["right_close_to_top"]) & (right["intersection_density"] > top["intersection_density"])))
        return told({"x": x, "band": F.when(rather_right, "right").otherwise(top["side"]), "first_band": of(x["sides"], x["first"]["side"])}, sided)

    def sided(y: Column) -> Column:
        x, band = y["x"], y["band"]
        first, left = x["first"], x["left"]
        keeps_right = (band == "right") & first["side"].isin("top", "left")
        to_left = left.isNotNull() & (
            (first["side"].isin("bottom", "right") & (band != "right") & (left["evidence_score"] >= first["evidence_score"] * SIDE["left_evidence"]) & (x["left_band"]["score"] >= y["first_band"]["score"] * SIDE["left_band"]))
            | ((band == "left") & (first["side"] != "left") & (left["evidence_score"] >= first["evidence_score"] * SIDE["left_evidence_in_left_band"]))
        )
        rule = F.when(first.isNull(), "band").when(yes(keeps_right), "right").when(yes(to_left), "left").when(yes(first["evidence_score"] >= SIDE["strong_evidence"]), "first").otherwise("weak")
        return told({"x": x, "band": band, "rule": rule}, chosen)

    def chosen(y: Column) -> Column:
        x, rule = y["x"], y["rule"]
        side = F.when(rule == "left", "left").when(rule == "first", x["first"]["side"]).otherwise(y["band"])
        taken = F.when(rule == "right", F.coalesce(of(x["candidates"], "right"), x["first"])).when(rule == "left", x["left"]).otherwise(x["first"])
        return told({"x": x, "side": side, "taken": taken}, weighed)

    def weighed(y: Column) -> Column:
        sides = y["x"]["sides"]
        return told({"y": y, "own": F.get(F.filter(sides, lambda s: s["side"] == y["side"]), 0)["score"], "rival": best(F.filter(sides, lambda s: s["side"] != y["side"]))["score"]}, sure)

    def sure(z: Column) -> Column:
        y, own, rival = z["y"], z["own"], z["rival"]
        evidence = F.greatest(scaled(own, SIDE["score_low"], SIDE["score_high"]), y["taken"]["evidence_score"])
        margin = F.when(rival.isNull(), 1.0).otherwise(clamp((own - rival) / F.nullif(own, F.lit(0.0))))
        rivalled = F.when(rival >= own * SIDE["rival"], 1.0).otherwise(0.0)
        plain = F.bround(clamp(BAND["evidence"] * evidence + BAND["margin"] * F.coalesce(margin, F.lit(0.0)) + BAND["unrivalled"] * (1.0 - rivalled)), 4)
        first, taken = y["x"]["first"], y["taken"]
        good = yes((taken["evidence_score"] >= SIDE["good_evidence"]) & (first["score"] > 0) & (taken["score"] >= first["score"] * SIDE["good_score"]))
        return told({"side": y["side"], "own": own, "evidence": evidence, "plain": plain, "good": good}, ended)

    def ended(r: Column) -> Column:
        confidence = F.when(r["good"] & (r["plain"] < SIDE["least_confidence_if_good"]), SIDE["least_confidence_if_good"]).otherwise(r["plain"])
        return F.struct(r["side"].alias("side"), r["own"].alias("score"), r["evidence"].alias("evidence"), confidence.alias("confidence"), (confidence < SIDE["review_below"]).alias("needs_review"))

    return told({"sides": sides, "candidates": candidates, "top": best(sides), "right": of(sides, "right"), "left_band": of(sides, "left"), "first": best(candidates), "left": of(candidates, "left")}, banded)


def rejection_reasons(flags: Column, teacher_flags: Column, expected: Column) -> Column:
    """Why a candidate that isn't the best of its record was rejected; expected: it was foreseen as no title block."""
    return F.concat(
        F.array(F.lit("not_selected_by_single_title_block_rule"), F.lit("lower_score_duplicate_or_neighbor")),
        labels(
            (has(flags, "uniform_grid_like"), "uniform_grid_like"),
            (has(teacher_flags, "teacher_uniform_table_negative"), "teacher_uniform_table_negative"),
            (expected, "non_title_table_false_positive"),
            (has(flags, "center_region") & ~has(flags, "touches_frame_line"), "center_region_without_frame_contact"),
            (has(flags, "out_of_page_bounds"), "out_of_page_bounds"),
            (has(flags, "size_abnormal"), "size_abnormal"),
        ),
    )


@dataclass(frozen=True)
class MultiWeights:
    """Fixed values of the score among several candidates of a page."""

    edge_threshold: float = 0.12
    target_area: float = 0.04
    frame_contact: float = 0.25
    edge: float = 0.15
    size: float = 0.20
    structure: float = 0.10
    uniform_grid: float = -0.35
    centre: float = -0.40
    out_of_bounds: float = -0.50


def multi_candidate_score(w: MultiWeights = MultiWeights()) -> Column:
    """The score among several candidates, from the columns box, points, area, confidence, frame_contact_score, cell_area_variance, uniform_grid_penalty and inside_drawing_body_penalty; missing ones are zero."""
    box = F.col("box")
    edge = F.greatest(F.least(box["xmin"], box["ymin"], 1.0 - box["xmax"], 1.0 - box["ymax"]), F.lit(0.0))
    outside = F.exists("points", lambda p: ~p["x"].between(0, 1) | ~p["y"].between(0, 1))
    return weighted_score(
        {
            "confidence": (F.col("confidence"), 1.0),
            "frame_contact": (F.col("frame_contact_score"), w.frame_contact),
            "edge": (clamp(1.0 - edge / w.edge_threshold), w.edge),
            "size": (clamp(1.0 - F.abs(zero(F.col("area")) - w.target_area) / w.target_area), w.size),
            "structure": (clamp(zero(F.col("cell_area_variance")) / 2.0), w.structure),
            "uniform_grid": (F.col("uniform_grid_penalty"), w.uniform_grid),
            "centre": (F.col("inside_drawing_body_penalty"), w.centre),
            "out_of_bounds": (F.when(outside, 1.0).otherwise(0.0), w.out_of_bounds),
        }
    )


def multi_rejection_reasons(diagnostic_flags: Column, expected: Column) -> Column:
    """Why one of several candidates was not taken; expected: it was foreseen as no title block."""
    return labels(
        (F.lit(True), "not_selected_by_single_title_block_rule"),
        (F.coalesce(expected, F.lit(False)), "non_title_table_false_positive"),
        (has(diagnostic_flags, "uniform_grid_like"), "uniform_grid_like"),
        (F.lit(True), "lower_confidence_duplicate_or_neighbor"),
    )


# Issues that block a record, for classifying and for routing.
CLASSIFY_BLOCKING = ("part_false_positive", "out_of_page_bounds", "boundary_too_large", "partial_title_block", "format_error")
ROUTE_BLOCKING = ("missing_title_block", "missing_prediction_label", "manual_rejected", "partial_title_block", "part_false_positive", "out_of_page_bounds", "boundary_too_large", "expected_false_positive_not_rejected")
OCR_HINTS = ("ocr_unavailable", "role_cluster_weak", "property_cluster_weak")


def any_of(items: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(items, F.array(*map(F.lit, names))), F.lit(False))


def record_issues(count: Column, label_errors: Column, flags: Column, acceptance: Column, problem: Column) -> Column:
    """Issues of a record. flags: arrays of flags of all its candidates, the selected one's first."""
    where = lambda f: F.exists(flags, f)
    rejected = F.coalesce(acceptance == "不可接受", F.lit(False))
    said = lambda *words: rejected & F.coalesce(sum((F.when(problem.contains(x), 1).otherwise(0) for x in words), F.lit(0)) > 0, F.lit(False))
    return F.array_distinct(
        F.concat(
            F.coalesce(label_errors, F.array().cast("array<string>")),
            labels(
                (count == 0, "missing_title_block"),
                (count > 1, "multi_candidate_resolved"),
                (where(lambda x: has(x, "center_region") & ~has(x, "touches_frame_line")), "part_false_positive"),
                (where(lambda x: has(x, "out_of_page_bounds")), "out_of_page_bounds"),
                (where(lambda x: has(x, "size_abnormal")), "boundary_too_large"),
                (rejected, "manual_rejected"),
                (said("没有被完全框住"), "partial_title_block"),
                (said("超出", "延展"), "boundary_too_large"),
                (said("零件"), "part_false_positive"),
            ),
        )
    )


def record_status(count: Column, issues: Column) -> Column:
    bad = (count == 0) | has(issues, "manual_rejected") | has(issues, "expected_false_positive_not_rejected") | any_of(issues, CLASSIFY_BLOCKING)
    return F.when(bad, "needs_review").otherwise("accepted")


def record_routes(status: Column, issues: Column, selected: Column, unexplained: Column, acceptance: Column) -> Column:
    """Struct (routes, reasons): one record may go several ways.

    selected: struct (confidence, candidate_flags, diagnostic_flags, touches_frame_line,
    frame_contact_status), null if none. unexplained: a rejected candidate has no reason.
    """
    none = selected.isNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    blocked = any_of(issues, ROUTE_BLOCKING)
    review = yes(status == "needs_review")
    held = review | blocked | none
    apart = ~held & yes((selected["frame_contact_status"] == "gap") & ~selected["touches_frame_line"])
    auto = ~held & ~apart
    resolved = has(issues, "multi_candidate_resolved")
    hints = any_of(selected["diagnostic_flags"], OCR_HINTS)
    grid = has(selected["candidate_flags"], "uniform_grid_like") & ~auto
    human = held | apart | unexplained
    unsure = human & (zero(selected["confidence"]) < 0.50) & ~any_of(issues, ("manual_rejected", "boundary_too_large"))
    failure = any_of(issues, ("missing_title_block", "part_false_positive", "partial_title_block"))
    refused = yes(acceptance == "不可接受")
    routes = labels((held | apart, "human_review"), (auto, "auto_accept"), (hints | grid, "ocr_candidate"), (unexplained, "human_review"), (unexplained | unsure, "vlm_candidate"), (failure | refused, "retrain_candidate"))
    reasons = labels(
        (held & review, "postprocess_needs_review"),
        (held & blocked, "blocking_issue"),
        (none, "missing_selected_title_block"),
        (apart, "selected_candidate_not_touching_frame"),
        (auto & resolved, "multi_candidate_resolved"),
        (auto & ~resolved, "postprocess_accepted"),
        (hints, "ocr_or_field_cluster_evidence_incomplete"),
        (grid, "selected_candidate_uniform_grid_like"),
        (unexplained, "rejected_candidate_without_reason"),
        (unsure, "low_confidence_human_review"),
        (failure, "model_failure_pattern_candidate"),
        (refused, "manual_rejected_training_signal"),
    )
    return F.struct(F.array_distinct(routes).alias("routes"), reasons.alias("reasons"))


def arbitration(status: Column, selected: Column, issues: Column, conflicts: Column, missing: Column, confidence: Column) -> Column:
    """Struct (decision_status, route, confidence_level, reasons); the first rule that a record meets decides."""
    rules = [
        (selected.isNull() | ~F.coalesce(status == "accepted", F.lit(False)), "needs_human_review", "human", "yolo_postprocess_not_accepted"),
        (F.exists(conflicts, lambda c: c.contains("yolo_opencv_position_conflict")), "needs_vlm", "vlm", "local_evidence_position_conflict"),
        (~F.coalesce(selected["touches_frame_line"], F.lit(False)), "needs_human_review", "human", "selected_candidate_not_touching_frame"),
        (any_of(issues, ("manual_rejected", "boundary_too_large", "out_of_page_bounds")), "needs_human_review", "human", "blocking_issue_type"),
    ]
    decision, route, reason = F.lit("auto_accept"), F.lit("auto"), F.lit(None).cast("string")
    for condition, d, r, why in reversed(rules):
        decision, route, reason = (F.when(condition, F.lit(x)).otherwise(y) for x, y in ((d, decision), (r, route), (why, reason)))
    fine = labels((F.lit(True), "accepted_by_yolo_postprocess"), (has(issues, "multi_candidate_resolved"), "multi_candidate_resolved"), (has(missing, "ocr_selected_candidate"), "ocr_missing_but_geometry_available"))
    sure = zero(confidence)
    level = F.when((sure >= 0.8) & (F.size(conflicts) == 0) & (decision == "auto_accept"), "high").when((sure >= 0.5) & decision.isin("auto_accept", "needs_vlm"), "medium").otherwise("low")
    return F.struct(decision.alias("decision_status"), route.alias("route"), level.alias("confidence_level"), F.when(reason.isNull(), fine).otherwise(F.array(reason)).alias("reasons"))


def rotation_blockers(dry_run: bool, api_ok: Column, parse: Column, schema: Column, degrees: Column) -> Column:
    """Why a page isn't turned, in the order of the checks."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return labels((F.lit(dry_run), "dry_run"), (no(api_ok), "api_not_ok"), (no(parse == "ok"), "parse_not_ok"), (no(schema == "ok"), "schema_not_ok"), (no(degrees.isin(0, 90, 180, 270)), "missing_or_invalid_correction_degrees"))


def dry_run_plan(decision: Column, page_path: Column, page_found: Column, degrees: Column, target_exists: Column) -> Column:
    """Blockers of turning a page in a dry run."""
    empty = F.coalesce(page_path, F.lit("")) == ""
    return labels(
        (~F.coalesce(decision == "auto_accept", F.lit(False)), "arbitration_not_auto_accept"),
        (empty, "missing_single_page_pdf_path"),
        (~empty & ~F.coalesce(page_found, F.lit(False)), "single_page_pdf_path_not_found"),
        (degrees.isNull(), "missing_correction_degrees"),
        (F.coalesce(target_exists, F.lit(False)), "corrected_pdf_candidate_would_overwrite"),
    )


def dry_run_route(can_rename: Column, *blockers: Column) -> Column:
    """Struct (route, reasons) of a dry run's record."""
    reasons = sorted_unique(*blockers)
    human = has(reasons, "arbitration_not_auto_accept") | has(reasons, "drawing_number_ambiguous")
    return F.struct(F.when(can_rename, "auto_dry_run_ready").when(human, "needs_human_review").otherwise("blocked").alias("route"), reasons.alias("reasons"))


def finer_region(region: Column, coarse_top: Column, most_area: float = 0.82, least_score: float = 0.72) -> Column:
    """Struct (status, reasons) of the best finer region: a candidate, or why a person must look.

    region: struct (top_candidate, top_score, area_ratio, cluster_level), null if none.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    fine, coarse = text(region["top_candidate"]), text(coarse_top)
    first = (
        F.when(region.isNull(), "fine_roi_missing")
        .when((fine == "") & (coarse != ""), "fine_roi_lost_coarse_candidate")
        .when((fine != "") & (coarse != "") & (fine != coarse), "coarse_fine_candidate_conflict")
        .when(fine == "", "drawing_number_missing_in_fine_roi")
    )
    more = labels((region["area_ratio"] >= most_area, "fine_roi_not_much_smaller"), (zero(region["top_score"]) < least_score, "fine_candidate_low_confidence"), (text(region["cluster_level"]) != "strong", "fine_field_cluster_not_strong"))
    good = first.isNull() & (F.size(more) == 0)
    reasons = F.when(first.isNotNull(), F.array(first)).when(good, F.array(F.lit("fine_roi_candidate_matches_quality_gate"))).otherwise(more)
    return F.struct(F.when(good, "fine_roi_candidate").otherwise("needs_review").alias("status"), reasons.alias("reasons"))


def region_score(top_score: Column, top: Column, roles: Column, properties: Column, area_ratio: Column) -> Column:
    """How good a region is: its candidate, its fields, and how much smaller it is."""
    from vellumen.functions.numbers import cluster_score

    found = F.when(F.coalesce(top, F.lit("")) != "", 0.25).otherwise(0.0)
    return F.bround(zero(top_score) + cluster_score(roles, properties) * 0.18 + F.greatest(1.0 - area_ratio, F.lit(0.0)) * 0.10 + found, 6)


def region_tier(name: Column, best: Column, usable: Column, tags: Column, preferred: str = "bottom_right_band_roi", tag: str = "prefer_bottom_right_blue_roi") -> Column:
    """Order in which a sample's regions are taken: the preferred one if a note asks for it, the old best, any usable; null for none."""
    return F.when(F.coalesce(tags.contains(tag), F.lit(False)) & (name == preferred), 0).when(name == best, 1).when(usable, 2)


def candidate_guard(old: Column, new: Column) -> Column:
    """What tightening did to a sample's candidate."""
    had, has_ = F.coalesce(old, F.lit("")) != "", F.coalesce(new, F.lit("")) != ""
    return F.when(had & ~has_, "new_roi_lost_previous_candidate").when(had, "new_roi_has_candidate").when(has_, "new_roi_added_candidate").otherwise("no_candidate_before_or_after")


def distill_targets(kind: Column, judgment: Column, needs_review: Column) -> Column:
    """What a teacher's judgment can teach: struct with is_true, touches_frame, strength, risk and reject_reasons."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    true = yes(judgment["is_true"])
    risky = yes(judgment["risk"] == "high") | yes(F.size(judgment["reject_reasons"]) > 0)
    return F.array_distinct(
        labels(
            (true & yes(judgment["touches_frame"]) & yes(judgment["strength"].isin("medium", "strong")), "rule"),
            (true & kind.isin("hardcase_positive", "small_angle_offset_tolerated"), "data"),
            (kind == "confidence_calibration", "rule"),
            (kind == "confidence_calibration", "provider"),
            (risky, "rule"),
            (risky, "data"),
            (risky, "model"),
            (kind == "mcp_corrected_opencv", "rule"),
            (kind == "mcp_corrected_opencv", "provider"),
            (yes(needs_review), "provider"),
        )
    )


# Advice by what a judgment shows.
ADVICE = {
    "not_true": "作为普通表格/明细表反例，蒸馏到方向无关的误检拒绝规则，并保留为负样本。",
    "small_angle_offset_tolerated": "作为小角度 OBB 偏差可接受正例，蒸馏为覆盖标题栏主体优先于微小角度误差的规则。",
    "confidence_calibration": "作为低置信但可接受样本，蒸馏为字段簇和贴边证据的置信校准规则。",
    "mcp_corrected_opencv": "作为 MCP 纠偏 OpenCV 样本，蒸馏为标题栏字段簇优先于普通线条密度的仲裁规则。",
    "unsure": "作为 hard-case 正例保留，用于后续候选 crop 小分类器或 provider 小实验。",
    "stable": "作为稳定正例保留，用于验证贴边、字段簇和标题栏位置规则。",
}


def advice(kind: Column, is_true: Column, confidence: Column) -> Column:
    from vellumen.functions.text import lookup

    named = kind.isin("small_angle_offset_tolerated", "confidence_calibration", "mcp_corrected_opencv")
    key = F.when(~F.coalesce(is_true, F.lit(False)), "not_true").when(named, kind).when(zero(confidence) < 0.85, "unsure").otherwise("stable")
    return lookup(key, ADVICE)


# Layers of the three review forms, by words in judgment, relative judgment, issue and note.
FORMS: dict[str, tuple[tuple[str, tuple[tuple[str, str, str | tuple[str, ...]], ...]], ...]] = {
    "crop": (
        ("完整", (("judgment", "in", ("完整", "正确")),)),
        ("未完整", (("judgment", "in", ("未完整", "不完整", "错误")),)),
        ("右侧或图号尾部缺失", (("issue", "has", "右侧"), ("note", "has", "右侧"), ("note", "has", "图号未完整"))),
        ("只覆盖半截标题栏", (("note", "has", "一半"),)),
        ("错框或混入主体", (("note", "has", "位置判断错误"), ("note", "has", "零件图"), ("issue", "has", "错"))),
        ("图像质量问题", (("note", "has", "字迹"), ("note", "has", "不清"), ("note", "has", "浅"), ("note", "has", "后处理"))),
    ),
    "recovery": (
        ("完整性正确", (("judgment", "in", ("正确", "完整")),)),
        ("范围太大", (("issue", "in", ("范围太大",)), ("note", "has", "范围太大"))),
        ("包含非标题栏图纸区域", (("note", "has", "左半边"), ("note", "has", "不是标题栏"), ("note", "has", "图纸"))),
    ),
    "tightening": (
        ("收窄过度", (("judgment", "has", "太小"), ("issue", "in", ("裁掉标题栏",)))),
        ("保留旧高度", (("note", "has", "高度更好"),)),
        ("采用新版左右范围", (("note", "has", "左右范围合适"),)),
    ),
}


def form_layers(form: str, **columns: Column) -> Column:
    """Layers of a review row: judgment, issue and note, and relative for the tightening form."""
    text = {k: F.coalesce(c, F.lit("")) for k, c in columns.items()}

    def met(where: str, how: str, what: str | tuple[str, ...]) -> Column:
        return text[where].isin(*what) if how == "in" else text[where].contains(what)

    found = []
    for name, conditions in FORMS[form]:
        any_met = F.lit(False)
        for condition in conditions:
            any_met |= met(*condition)
        found.append((any_met, name))
    out = labels(*found)
    if form == "tightening":
        passed = (text["judgment"] == "正确") & (text["relative"] == "更好")
        out = F.concat(labels((passed, "新版ROI通过")), out, F.when(text["issue"] != "", F.array(text["issue"])).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("未分层")))


def calibration(judgment: Column, manual: Column, fine: Column, coarse: Column) -> Column:
    """Struct (outcome, final_number) of a person's judgment; manual, fine and coarse are normalised numbers, empty if none."""
    from vellumen.functions.text import NO_NUMBER

    said = verdict(judgment, "number")
    usable = ~F.lower(manual).isin(*NO_NUMBER)
    machine = F.coalesce(F.nullif(fine, F.lit("")), F.nullif(coarse, F.lit("")))
    outcome = (
        F.when(said == "correct", "machine_confirmed")
        .when((said == "incorrect") & usable, "manual_corrected")
        .when((said == "missing") & usable, "manual_supplied_missing")
        .when(said.isin("uncertain", "incorrect", "missing") | ~usable, "unresolved_requires_manual_identification")
        .otherwise("manual_override_without_standard_judgment")
    )
    final = F.when(said == "correct", machine).when(outcome.startswith("manual_"), manual)
    return F.struct(outcome.alias("outcome"), final.alias("final_number"))


def note_layers(note: Column, rules: dict[str, tuple[str, ...]], default: str = "未分层") -> Column:
    """Layers whose words a note has; a default where none."""
    found = labels(*((sum((F.when(note.contains(x), 1).otherwise(0) for x in words), F.lit(0)) > 0, name) for name, words in rules.items()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def all_failed(rows: DataFrame, ok: Column) -> None:
    """Fails if there are rows and not one is ok."""
    n, good = rows.agg(F.count("*"), F.count_if(F.coalesce(ok, F.lit(False)))).first()
    if n and not good:
        raise RuntimeError(f"all {n} calls failed")
