"""Records put together from several tables: evidence, events, data sets, and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumen.functions import numbers, text
from vellumen.operators import metrics, rank, relate
from vellumen.plans import rules

#: Sources of a position that may be held against the page detector's.
COMPARABLE = ("bbox_aspect_center_horizontal", "bbox_aspect_center_vertical", "bbox_nearest_page_side")


def _counted(**conditions: Column) -> list[Column]:
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]


# ---- evidence of a record


def missing_evidence(selected: Column, cluster_level: Column, detector_side: Column) -> Column:
    """What evidence a record lacks; a detector's side that is null is no result."""
    return text.labels((selected.isNull(), "yolo_selected_title_block"), (cluster_level == "missing", "ocr_selected_candidate"), (detector_side.isNull(), "opencv_rotation_result"))


def evidence_conflicts(cluster_level: Column, position: Column, source: Column, detector_side: Column) -> Column:
    """Where a record's evidence disagrees: weak fields, or another side than the detector's."""
    differs = F.coalesce(F.nullif(position, F.lit("")) != F.nullif(detector_side, F.lit("")), F.lit(False))
    pair = F.concat(position, F.lit("!="), detector_side)
    found = F.array(
        F.when(cluster_level.isin("weak", "none", "unavailable"), F.concat(F.lit("ocr_field_cluster_"), cluster_level)),
        F.when(differs & source.isin(*COMPARABLE), F.concat(F.lit("yolo_opencv_position_conflict:"), pair)),
        F.when(differs & ~source.isin(*COMPARABLE), F.concat(F.lit("position_source_not_comparable:"), source, F.lit(":"), pair)),
    )
    return F.filter(found, lambda x: x.isNotNull())


def expanded_candidates(records: DataFrame, candidates: DataFrame, rejected: DataFrame, recognised: DataFrame, keys: Sequence[str] = ("prediction_dir", "sample")) -> DataFrame:
    """A row for each candidate of a record with its recognition; columns of its rejection come before its own.

    A record without candidates has its selected one (column selected_candidate_index). The
    three candidate tables have the keys and candidate_index.
    """
    full = [*keys, "candidate_index"]
    own = relate.present_override(candidates, rejected.withColumn("rejected", F.lit(True)), full)
    alone = records.where("selected_candidate_index IS NOT NULL").select(*keys, F.col("selected_candidate_index").alias("candidate_index")).join(candidates.select(*keys).distinct(), list(keys), "left_anti")
    every = own.unionByName(alone, allowMissingColumns=True).withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    chosen = records.select(*keys, "selected_candidate_index")
    out = every.join(chosen, list(keys), "left").join(recognised, full, "left")
    return out.withColumn("selected", F.coalesce(F.col("candidate_index") == F.col("selected_candidate_index"), F.lit(False))).drop("selected_candidate_index")


def rename_plan(selected: Column, blockers: Column, can_rotate: Column, exists: Column) -> Column:
    """Struct (name, can_rename, blockers, changed) of a dry run's renaming; exists: the target is there."""
    made = text.sanitized(selected)
    all_ = text.sorted_unique(blockers, made["risks"], text.labels((~F.coalesce(can_rotate, F.lit(False)), "upstream_rotation_blocked"), (F.coalesce(exists, F.lit(False)), "renamed_pdf_candidate_would_overwrite")))
    return F.struct(made["name"].alias("name"), (F.size(all_) == 0).alias("can_rename"), all_.alias("blockers"), rules.has(made["risks"], "filename_changed_by_sanitization").alias("changed"))


def crop_blockers(path: Column, found: Column) -> Column:
    empty = F.coalesce(path, F.lit("")) == ""
    return text.labels((empty, "missing_title_block_crop"), (~empty & ~F.coalesce(found, F.lit(False)), "title_block_crop_not_found"))


def recognition_blockers(recognised: Column, cluster_level: Column) -> Column:
    return text.labels((F.coalesce(recognised, F.lit("")) == "", "missing_ocr_text"), (~F.coalesce(cluster_level == "strong", F.lit(False)), "ocr_field_cluster_not_strong"))


# ---- summaries


def postprocess_summary(records: DataFrame) -> DataFrame:
    """Counts over classified records (status, issue_types, rejected_count)."""
    issue = lambda *names: rules.any_of(F.col("issue_types"), names)
    return records.agg(
        F.count("*").alias("total"),
        *_counted(
            accepted=F.col("status") == "accepted",
            needs_review=F.col("status") == "needs_review",
            rejected=F.col("status") == "rejected",
            missing_prediction_label=issue("missing_prediction_label", "missing_title_block"),
            multi_candidate=issue("multi_candidate", "multi_candidate_resolved"),
            multi_candidate_resolved=issue("multi_candidate_resolved"),
            part_false_positive=issue("part_false_positive"),
            boundary_or_size_issue=issue("boundary_too_large", "out_of_page_bounds"),
            manual_rejected=issue("manual_rejected"),
        ),
        F.coalesce(F.sum("rejected_count"), F.lit(0)).cast("long").alias("rejected_candidates"),
    )


def multi_candidate_summary(records: DataFrame, expected: int) -> DataFrame:
    """Counts over records (status, issue_types, prediction_count, rejected_count); expected: rejections that were foreseen."""
    failed = rules.any_of(F.col("issue_types"), ("expected_false_positive_not_rejected",))
    out = records.agg(F.count("*").alias("records"), *_counted(accepted=F.col("status") == "accepted", needs_review=F.col("status") == "needs_review", multi_candidate_records=F.col("prediction_count") > 1), F.coalesce(F.sum("rejected_count"), F.lit(0)).cast("long").alias("rejected_candidates"), F.count_if(failed).alias("failed_expectations"))
    return out.withColumn("expected_false_positive_rejected", F.lit(expected) - F.col("failed_expectations"))


def three_way(rows: DataFrame, ours: Column, theirs: Column, truth: Column, review: Column, sample: str) -> DataFrame:
    """Agreement of two answers and a truth: counts, rates (0.0 if empty), and the samples where one corrects the other or is unsure."""
    a, b = F.coalesce(ours == truth, F.lit(False)), F.coalesce(theirs == truth, F.lit(False))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(sample))))
    n = F.count("*")
    return rows.agg(
        n.alias("total"),
        F.count_if(a).alias("ours_match"),
        F.count_if(b).alias("theirs_match"),
        F.count_if(a & b & F.coalesce(ours == theirs, F.lit(False))).alias("three_way_agree"),
        metrics.rate(F.count_if(a), n, 0.0, 6).alias("our_rate"),
        metrics.rate(F.count_if(b), n, 0.0, 6).alias("their_rate"),
        F.count_if(a & ~b).alias("corrections"),
        listed(a & ~b).alias("corrected_samples"),
        listed(a & b & F.coalesce(review, F.lit(False))).alias("unsure_samples"),
    )


def stage_status(records: DataFrame, stage: DataFrame, key: str) -> DataFrame:
    """Records with the first stage's columns and whether there is a row."""
    side = stage.withColumn("_there", F.lit(True))
    joined = records.join(side, key, "left")
    return joined.withColumn("status", F.when(F.col("_there"), "ok").otherwise("missing")).drop("_there")


# ---- calibration memory


def calibration_events(form: DataFrame, machine: DataFrame, session: str) -> DataFrame:
    """An event for each row of a form (sample_id, roi_judgment, number_judgment, manual_number, note).

    machine: sample_id, fine_candidate, fine_score, coarse_candidate, coarse_score. What the
    machine found is held against what the person said.
    """
    normal = text.number_compatible
    joined = form.join(machine, "sample_id", "left").select("*", normal(F.col("manual_number")).alias("manual_confirmed"), normal(F.col("fine_candidate")).alias("machine_fine"), normal(F.col("coarse_candidate")).alias("machine_coarse"))
    told = joined.select("*", rules.calibration(F.col("number_judgment"), F.col("manual_confirmed"), F.col("machine_fine"), F.col("machine_coarse")).alias("_c"), text.note_tags(F.col("note"), F.col("roi_judgment")).alias("_t"))
    compared = F.coalesce(F.nullif("machine_fine", F.lit("")), F.col("machine_coarse"))
    ops = told.withColumn("candidate_diff_operations", numbers.diff_operations(compared, F.coalesce(F.col("_c.final_number"), F.lit(""))))
    score = lambda c: F.col(c).cast("string").try_cast("double")
    return ops.select(
        F.concat(F.lit(f"{session}:"), "sample_id").alias("event_id"),
        F.lit(session).alias("review_session_id"),
        "sample_id",
        text.verdict(F.col("roi_judgment"), "roi").alias("fine_roi_judgment_code"),
        text.verdict(F.col("number_judgment"), "number").alias("drawing_number_judgment_code"),
        "manual_confirmed",
        "machine_fine",
        score("fine_score").alias("machine_fine_score"),
        "machine_coarse",
        score("coarse_score").alias("machine_coarse_score"),
        F.col("_c.outcome").alias("calibration_outcome"),
        F.col("_c.final_number").alias("final_drawing_number"),
        "candidate_diff_operations",
        numbers.char_confusions(F.col("candidate_diff_operations")).alias("candidate_char_confusions"),
        F.col("_t.tags").alias("roi_note_tags"),
        F.col("_t.suggestions").alias("roi_adjustment_suggestions"),
    )


RESOLVED = ("machine_confirmed", "manual_corrected", "manual_supplied_missing", "manual_override_without_standard_judgment")


def memory_patterns(events: DataFrame) -> DataFrame:
    """(dimension, value, n) of outcomes, judgments, tags, suggestions and confusions of events."""
    named = events.withColumn("confusion", F.transform("candidate_char_confusions", lambda c: F.concat(c["machine"], F.lit("->"), c["manual"])))
    return metrics.counters(named, ["calibration_outcome", "fine_roi_judgment_code", "drawing_number_judgment_code", "roi_note_tags", "roi_adjustment_suggestions", "confusion"])


def confirmed_rate(events: DataFrame) -> DataFrame:
    """How many events are resolved, and the share of them that confirm the machine; null over none."""
    good, done = F.count_if(F.col("calibration_outcome") == "machine_confirmed"), F.count_if(F.col("calibration_outcome").isin(*RESOLVED))
    return events.agg(F.count("*").alias("events"), done.alias("resolved"), good.alias("confirmed"), metrics.rate(good, done, digits=6).alias("confirmed_rate"))


def transplantable_rules(events: DataFrame) -> DataFrame:
    """(rule_id, type, value, support): a gate where half the events say too large, advice said twice, every confusion, and a fallback.

    Rules of a kind are numbered on from those before them, by falling support.
    """
    seen = memory_patterns(events)
    total = events.agg(F.count("*").alias("_total"))  # one row
    of = lambda name: seen.where(F.col("dimension") == name)
    gate = of("roi_note_tags").where("value = 'roi_too_large'").crossJoin(F.broadcast(total)).where("n >= 0.5 * _total").select(F.lit(1).alias("_k"), F.lit("roi_feedback").alias("type"), "value", F.col("n").alias("support"))
    advice = of("roi_adjustment_suggestions").where("n >= 2").select(F.lit(2).alias("_k"), F.lit("roi_adjustment").alias("type"), "value", F.col("n").alias("support"))
    confused = of("confusion").select(F.lit(3).alias("_k"), F.lit("ocr_candidate_diff").alias("type"), "value", F.col("n").alias("support"))
    open_ = events.where("calibration_outcome = 'unresolved_requires_manual_identification'").agg(F.count("*").alias("support")).where("support > 0").select(F.lit(4).alias("_k"), F.lit("fallback").alias("type"), F.lit("").alias("value"), "support")
    every = gate.unionByName(advice).unionByName(confused).unionByName(open_)
    every = rank.numbered(every, ["_k", F.desc("support"), "value"], "_n")
    number = F.col("_n")
    name = F.when(F.col("_k") == 1, "roi-too-large-quality-gate").when(F.col("_k") == 2, F.concat(F.lit("roi-adjustment-"), number.cast("string"))).when(F.col("_k") == 3, F.concat(F.lit("ocr-confusion-"), number.cast("string"))).otherwise("manual-fallback-required")
    return every.select(name.alias("rule_id"), "type", "value", "support")


def session_rows(memory: DataFrame, session: str) -> DataFrame:
    """A session's events with their lists joined by ;."""
    mine = memory.where(F.col("review_session_id") == session)
    return mine.select("event_id", "sample_id", "calibration_outcome", "final_drawing_number", F.array_join("roi_note_tags", ";").alias("roi_note_tags"), F.array_join("roi_adjustment_suggestions", ";").alias("roi_adjustment_suggestions"))


# ---- truth and data sets

HUMAN = "Human-reviewed disagreement or low-confidence sample."
AGREED = "Accepted from OpenCV/MCP consensus; pending full human review."


def ground_truth(items: DataFrame) -> DataFrame:
    """Truth from items (sample, title_block_position, rotation_degrees, basis), by sample."""
    rows = items.select("*", text.source_level(F.coalesce("basis", F.lit(""))).alias("_s"))
    return rows.select("sample", "title_block_position", F.col("rotation_degrees").cast("int").alias("rotation_degrees"), F.col("_s.level").alias("source_level"), F.coalesce("basis", F.lit("")).alias("source_basis"), F.col("_s.verified").alias("verified_by_human"), F.when(F.col("_s.verified"), HUMAN).otherwise(AGREED).alias("note")).orderBy("sample")


def augmented_truth(chosen: DataFrame, order: Sequence[str], target: int = 90, side: str = "left", precise: str = "左侧", prefix: str = "aug90") -> DataFrame:
    """Truth of samples that are turned to a target rotation, numbered in the order."""
    rows = rank.numbered(chosen, order, "_n")
    return rows.select(
        F.concat(F.format_string(f"{prefix}_%03d_from_", "_n"), "sample").alias("sample"),
        F.col("sample").alias("source_sample"),
        F.col("rotation_degrees").cast("int").alias("source_rotation_degrees"),
        text.applied_rotation(F.lit(target), F.col("rotation_degrees")).cast("int").alias("applied_clockwise_rotation_degrees"),
        F.lit(side).alias("title_block_position"),
        F.lit(precise).alias("precise_title_block_position"),
        F.lit(target).alias("rotation_degrees"),
    )


def source_of(sample: Column, known: Column) -> Column:
    """A sample's source: the known one, else what follows _from_ in its name, else itself."""
    tail = F.regexp_extract(sample, "^.*?_from_(.*)$", 1)
    return F.coalesce(F.nullif(known, F.lit("")), F.nullif(tail, F.lit("")), sample)


def hard_cases(manifest: DataFrame, earlier: DataFrame, protective: str) -> DataFrame:
    """Hard cases with what an earlier round knows; the protective group is for validation."""
    e = relate.last_wins(earlier, ["sample"], ["source_sample"]).select("sample", F.col("source_sample").alias("_source"), "dataset", "title_block_position", "rotation_degrees")
    joined = manifest.select("sample", "group").join(e, "sample", "left")
    is_protective = F.col("group") == protective
    return joined.select(F.coalesce("dataset", F.lit("round2_hardcase")).alias("dataset"), "sample", source_of(F.col("sample"), F.col("_source")).alias("source_sample"), F.when(is_protective, "val").otherwise("train").alias("split"), F.when(is_protective, "protective_positive").otherwise("hardcase_train").alias("role"), F.col("group").alias("hardcase_group"), "title_block_position", "rotation_degrees")


def dataset_summary(records: DataFrame, label_counts: DataFrame) -> DataFrame:
    """Counts of a data set, leaks between splits, and whether every record has one label."""
    leaks = metrics.leakage(records, "source_sample", "split", ignore_blank=False).agg(F.count("*").alias("leaked_sources"))
    counted = records.join(label_counts.select("sample", F.col("n").alias("_n")), "sample", "left")
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    out = counted.agg(F.count("*").alias("records"), F.countDistinct("sample").alias("samples"), F.count_if(~one).alias("without_one_label"))
    joined = out.crossJoin(F.broadcast(leaks))  # one row each
    return joined.withColumn("passed", (F.col("records") == F.col("samples")) & (F.col("without_one_label") == 0) & (F.col("leaked_sources") == 0))


def prediction_groups(predictions: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Samples of prediction groups (group, prediction_dir, members_only), once a group, those without just one prediction first."""
    joined = predictions.join(groups, "prediction_dir")
    inside = members.select("sample").distinct().withColumn("_in", F.lit(True))
    kept = joined.join(inside, "sample", "left").where(~F.col("members_only") | F.coalesce("_in", F.lit(False))).drop("_in")
    once = relate.first_wins(kept, ["group", "sample"], ["prediction_dir"])
    return once.withColumn("needs_attention", F.coalesce(F.col("prediction_count") != 1, F.lit(True))).orderBy(F.col("needs_attention").desc(), "group", "sample")


# ---- requests and answers


def requests(records: DataFrame, variants: DataFrame, kind: str) -> DataFrame:
    """A request for each record and variant (variant_id, model), with its id."""
    nothing = records.select("task_id").limit(0).withColumn("variant_id", F.lit(None).cast("string"))
    rows = relate.spine(records, variants, nothing, ["task_id", "variant_id"])
    return rows.withColumn("request_kind", F.lit(kind)).withColumn("custom_id", F.concat_ws("__", F.lit(kind), "variant_id", "task_id"))


def validated_teacher(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(columns in keep, task_id, status, errors) of teacher responses (task_id, parse_status, parsed_response as JSON text, _json_error)."""
    from vellumen.functions.answers import teacher_errors

    task = F.coalesce("task_id", F.lit(""))
    v = F.try_parse_json("parsed_response")
    broken = F.when(F.coalesce("_json_error", F.lit("")) != "", F.concat(F.lit("json_error:"), "_json_error"))
    first = F.filter(F.array(broken, F.when(task == "", F.lit("missing_task_id")), F.when(F.coalesce("parse_status", F.lit("")).isin("", "pending"), F.lit("pending_response"))), lambda x: x.isNotNull())
    errors = F.concat(first, F.coalesce(teacher_errors(v, task), F.array(F.lit("missing_or_empty_parsed_response"))))
    return rows.select(*keep, task.alias("task_id"), errors.alias("errors")).select(*keep, "task_id", F.when(F.size("errors") == 0, "ok").otherwise("error").alias("status"), "errors")


def teacher_outputs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task ids of valid responses, a row (task_id, error) for each error) of validated_teacher()."""
    return rows.where("status = 'ok'").select("task_id"), rows.select("task_id", F.explode("errors").alias("error"))


def decision_against_truth(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Decisions (page_number, model, title_block_position) held against truth (page_number, expected_position).

    Rotations are compared where both are known, else positions.
    """
    joined = decisions.join(relate.last_wins(truth, ["page_number"], ["expected_position"]), "page_number", "left")
    rows = joined.withColumn("expected_position", F.coalesce("expected_position", F.lit("unknown"))).withColumn("predicted_position", F.coalesce(text.stripped(F.col("title_block_position")), F.lit("")))
    exact = F.col("predicted_position") == F.col("expected_position")
    mine, theirs = text.rotation_group(F.col("predicted_position")), text.rotation_group(F.col("expected_position"))
    return rows.select("page_number", "model", "expected_position", "predicted_position", exact.alias("exact_match"), theirs.alias("expected_rotation_group"), mine.alias("predicted_rotation_group"), F.coalesce(mine == theirs, exact).alias("rotation_group_match"))


def retest_summary(compared: DataFrame, before: Mapping[str, float] | None = None) -> DataFrame:
    """Exact and rotation accuracy of each model to four digits (0 over nothing), with the change against an earlier run."""
    n = F.count("*")
    out = compared.groupBy("model").agg(n.alias("total"), metrics.rate(F.count_if("exact_match"), n, 0.0, 4).alias("exact_accuracy"), metrics.rate(F.count_if("rotation_group_match"), n, 0.0, 4).alias("rotation_accuracy"))
    old = text.lookup(F.col("model"), dict(before)) if before else F.lit(None).cast("double")
    return out.withColumn("exact_change", F.bround(F.col("exact_accuracy") - old, 4)).orderBy("model")


# ---- a manifest of hard cases


def manifest_issues(records: DataFrame, required: DataFrame, fields: Sequence[str] = ("image_status", "label_status", "prediction_image_status", "prediction_label_status")) -> DataFrame:
    """(severity, code, item) of what a manifest lacks: required samples, files (as sample:field), and labels of just one title block."""
    gone = F.filter(F.array(*(F.when(~F.coalesce(F.col(f) == "exists", F.lit(False)), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    files = records.select("sample", F.explode(gone).alias("f")).select(F.concat_ws(":", "sample", "f").alias("item"))
    odd = records.where(~F.coalesce(F.col("label_quality_status") == "ok_single_title_block", F.lit(False))).select("sample")
    return metrics.issues(error__missing_required_sample=relate.difference(required, records, ["sample"]), error__missing_file=files, error__invalid_label=odd)


def manifest_gate(records: DataFrame, required: DataFrame) -> DataFrame:
    """One row: how many records, how many issues of each kind, and whether there is none."""
    found = manifest_issues(records, required).agg(*_counted(**{c: F.col("code") == c for c in ("missing_required_sample", "missing_file", "invalid_label")}))
    out = records.agg(F.count("*").alias("total")).crossJoin(F.broadcast(found))  # one row each
    return out.withColumn("quality_gate_passed", F.col("missing_required_sample") + F.col("missing_file") + F.col("invalid_label") == 0)


# ---- several candidates of a page


def grouped_candidates(candidates: DataFrame, keys: Sequence[str] = ("prediction_dir", "sample"), index: str = "candidate_index") -> DataFrame:
    """(keys, candidates): each record's candidates as structs, by their index. A page has few."""
    others = [c for c in candidates.columns if c not in (*keys, index)]
    return candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index, *others))).alias("candidates"))


def multi_candidate_records(candidates: DataFrame, exceptions: DataFrame, keys: Sequence[str] = ("prediction_dir", "sample")) -> tuple[DataFrame, DataFrame]:
    """(records, candidates with score, selected and rejection_reasons) where pages may have several candidates.

    exceptions: a row for each record with one: keys, reject_index (foreseen as no title block,
    or null), accepted and small_angle (whether that is foreseen). The best score is selected,
    the least index of equals.
    """
    side = relate.looked_up(exceptions.select(*keys, "reject_index", "accepted", "small_angle"), keys, ())
    scored = rank.top1_with_rejects(candidates.withColumn("multicandidate_score", rules.multi_candidate_score()), list(keys), "multicandidate_score", ["candidate_index"]).join(side, list(keys), "left")
    foreseen = F.coalesce(F.col("candidate_index") == F.col("reject_index"), F.lit(False))
    told = scored.withColumn("rejection_reasons", F.when(~F.col("selected"), rules.multi_rejection_reasons(F.col("diagnostic_flags"), foreseen)))
    counted = told.groupBy(*keys).agg(
        F.count("*").alias("prediction_count"),
        F.count_if(~F.col("selected")).alias("rejected_count"),
        F.max(F.when(F.col("selected"), F.col("candidate_index"))).alias("selected_candidate_index"),
        F.bool_or(foreseen & ~F.col("selected")).alias("_rejected"),
        F.first("reject_index").alias("reject_index"),
        F.first("accepted").alias("_accepted"),
        F.first("small_angle").alias("_small"),
    )
    failed = F.col("reject_index").isNotNull() & ~F.col("_rejected")
    fine = F.when(failed, "needs_review").otherwise("accepted")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    issues = text.labels((F.col("prediction_count") > 1, "multi_candidate_resolved"), (failed, "expected_false_positive_not_rejected"), (yes("_accepted") & ~failed, "manual_expected_accepted"), (yes("_small") & ~failed, "small_angle_offset_tolerated"))
    records = counted.select(*keys, "prediction_count", "rejected_count", "selected_candidate_index", fine.alias("status"), issues.alias("issue_types"))
    return records, told.drop("reject_index", "accepted", "small_angle")


# ---- a teacher's tasks, and what is learned from its answers


def teacher_tasks(targets: DataFrame, rows: DataFrame, records: DataFrame, candidates: DataFrame) -> DataFrame:
    """A task for each target (place, source, sample, prediction_dir, candidate_index as text) that has a row.

    rows: distillation rows, of which the last with the target's key counts. records
    (prediction_dir, sample, source_image, overlay_path) and candidates (the same keys with
    candidate_index, source_image, crop_path) give the images; missing_assets names those
    that a task should have and hasn't.
    """
    keys = ["source", "sample", "prediction_dir", "candidate_index"]
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = lambda df, names: df.select(*(filled(n).alias(n) if n in keys else F.col(n) for n in names))
    asked = ["teacher_value", "reason", "expected_teacher_question", "distill_to_rule", "distill_to_data", "distill_to_model"]
    joined = keyed(targets, ["place", *keys]).join(relate.looked_up(keyed(rows, [*keys, *asked]), keys, ()), keys)
    of_record = relate.looked_up(keyed(records.withColumnRenamed("source_image", "_record_image"), ["prediction_dir", "sample", "_record_image", "overlay_path"]), ["prediction_dir", "sample"], ())
    of_candidate = relate.looked_up(keyed(candidates.withColumnRenamed("source_image", "_own_image"), ["prediction_dir", "sample", "candidate_index", "_own_image", "crop_path"]), ["prediction_dir", "sample", "candidate_index"], ())
    out = joined.join(of_record, ["prediction_dir", "sample"], "left").join(of_candidate, ["prediction_dir", "sample", "candidate_index"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    image = F.coalesce("_own_image", "_record_image")
    name = F.concat(F.format_string("teacher_%02d_", "place"), "source", F.lit("__"), F.when(F.col("prediction_dir") == "", "three_way").otherwise(F.col("prediction_dir")), F.lit("__"), "sample", F.when(F.col("candidate_index") != "", F.concat(F.lit("__candidate_"), "candidate_index")).otherwise(""))
    missing = text.labels((F.coalesce(image, F.lit("")) == "", "source"), ((F.col("prediction_dir") != "") & blank("overlay_path"), "overlay"), ((F.col("candidate_index") != "") & blank("crop_path"), "candidate_crop"))
    return out.select(name.alias("task_id"), F.col("teacher_value").alias("task_type"), *keys, *asked[1:], image.alias("source_image"), "overlay_path", "crop_path", missing.alias("missing_assets"))


# What each source of distillation rows teaches, to what, and what it asks.
DISTILLED = {
    "three_way_mcp_correction": ("mcp_corrected_opencv", "yes", "yes", "maybe", "Why is the title block at the MCP/manual position rather than the OpenCV position?"),
    "three_way_low_confidence_agreement": ("confidence_calibration", "yes", "maybe", "no", "What visual evidence makes this low-confidence case still reliable?"),
    "routing_hardcase": ("hardcase_explanation", "maybe", "yes", "maybe", "Should this selected candidate be accepted, reviewed, or used as a hard-case training signal?"),
    "round3_rejected_candidate": ("non_title_table_false_positive", "yes", "yes", "yes", "Why is this table-like candidate not the true title block?"),
}


def distillation_rows(three_way_: DataFrame, calibrated: Sequence[str], routed: DataFrame, hard: Sequence[str], rejected: DataFrame, negatives: Sequence[str]) -> DataFrame:
    """Rows from which a teacher's answers may be distilled, from three sources, once a source, record and candidate.

    three_way_: sample, mcp_matches_manual, opencv_matches_manual (texts); where both match, the
    samples in `calibrated` count. routed: prediction_dir, sample, selected_candidate_index,
    routes, route_reasons; samples in `hard`, or on the route to training. rejected:
    prediction_dir, sample, candidate_index, rejection_reasons; samples in `negatives`.
    """
    mcp, opencv = text.truth_text(F.col("mcp_matches_manual")), text.truth_text(F.col("opencv_matches_manual"))
    none = F.lit("")

    def rows(source: str, df: DataFrame, folder: Column, index: Column, reason: Column) -> DataFrame:
        value, rule, data, model, question = map(F.lit, DISTILLED[source])
        return df.select(F.lit(source).alias("source"), "sample", F.coalesce(folder, none).alias("prediction_dir"), F.coalesce(index.cast("string"), none).alias("candidate_index"), value.alias("teacher_value"), rule.alias("distill_to_rule"), data.alias("distill_to_data"), model.alias("distill_to_model"), reason.alias("reason"), question.alias("expected_teacher_question"))

    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ";")
    parts = [
        rows("three_way_mcp_correction", three_way_.where(mcp & ~opencv), none, none, F.lit("MCP matched manual while OpenCV was wrong")),
        rows("three_way_low_confidence_agreement", three_way_.where(mcp & opencv & F.col("sample").isin(*calibrated)), none, none, F.lit("MCP and OpenCV agreed with manual while OpenCV requested review")),
        rows("routing_hardcase", rank.hard_cases(routed, "sample", hard, "routes"), F.col("prediction_dir"), F.col("selected_candidate_index"), joined("route_reasons")),
        rows("round3_rejected_candidate", rejected.where(F.col("sample").isin(*negatives)), F.col("prediction_dir"), F.col("candidate_index"), joined("rejection_reasons")),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return relate.last_wins(union, ["source", "prediction_dir", "sample", "candidate_index"], ["reason"])


JUDGMENTS = "array<struct<candidate_index:int,is_true_title_block:boolean,touches_drawing_frame:boolean,field_cluster_strength:string,ordinary_table_false_positive_risk:string,reject_reasons_if_not_title_block:array<string>,layout_evidence:array<string>>>"
ANSWERED = f"struct<title_block_position:string,rotation_degrees:int,confidence:double,needs_human_review:boolean,candidate_judgments:{JUDGMENTS}>"


def teacher_actions(validated: DataFrame) -> DataFrame:
    """A row for each judgment of valid answers (task_id, parsed_response as JSON): what it can teach, and advice."""
    rows = validated.select("task_id", F.from_json("parsed_response", ANSWERED).alias("a")).select("task_id", "a", F.explode("a.candidate_judgments").alias("j"))
    kind = text.task_kind(F.col("task_id"))
    j = F.col("j")
    judgment = F.struct(j["is_true_title_block"].alias("is_true"), j["touches_drawing_frame"].alias("touches_frame"), j["field_cluster_strength"].alias("strength"), j["ordinary_table_false_positive_risk"].alias("risk"), F.coalesce(j["reject_reasons_if_not_title_block"], F.array().cast("array<string>")).alias("reject_reasons"))
    return rows.select(
        "task_id",
        text.task_sample(F.col("task_id")).alias("sample"),
        kind.alias("task_kind"),
        j["candidate_index"].alias("candidate_index"),
        j["is_true_title_block"].alias("is_true_title_block"),
        F.col("a.title_block_position").alias("title_block_position"),
        F.col("a.rotation_degrees").alias("rotation_degrees"),
        j["touches_drawing_frame"].alias("touches_drawing_frame"),
        j["field_cluster_strength"].alias("field_cluster_strength"),
        j["ordinary_table_false_positive_risk"].alias("ordinary_table_false_positive_risk"),
        F.array_join(judgment["reject_reasons"], ";").alias("reject_reasons"),
        F.array_join(rules.distill_targets(kind, judgment, F.col("a.needs_human_review")), ";").alias("distill_targets"),
        rules.advice(kind, j["is_true_title_block"], F.col("a.confidence")).alias("recommendation"),
        F.array_join(F.coalesce(j["layout_evidence"], F.array().cast("array<string>")), " | ").alias("layout_evidence"),
        F.col("a.confidence").alias("confidence"),
        F.col("a.needs_human_review").alias("needs_human_review"),
    )
