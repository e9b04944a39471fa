"""Queries that apply geometry, scores, flags and routes of pages, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumen.functions import geometry
from vellumen.plans import records, rules
from vellumen.plans.queries import BOX_SQL, POINTS_SQL, boxes, joined, query, read
from vellumen.plans.queries_text import picked, picked_sql


def texts(*items: str) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def rounded(c: Column, name: str, digits: int = 9) -> Column:
    return F.round(c, digits).alias(name)


# ---- geometry


@query(f"""
SELECT vec_id, round_even(least(greatest(a * 1.3 - 0.1, 0), 1) * (640 + vec_id % 100), 0)::INTEGER AS px, round(greatest(least((c - 0.4) / 0.3, 1), 0), 9) AS share, CASE WHEN vec_id % 4 < 2 THEN round(a, 9) END AS xmin FROM ({BOX_SQL})
""")
def pixel_boxes(spark, sf_dir):
    b, k = F.col("box"), F.col("vec_id") % 4
    four = [b[n].cast("string") for n in ("xmin", "ymin", "xmax", "ymax")]
    given = F.when(k < 2, F.array(*four)).when(k == 2, F.array(*four[:3])).otherwise(F.array(*four[:3], F.lit("x")))
    return boxes(spark, sf_dir).select("vec_id", geometry.pixels(b["xmin"] * 1.3 - 0.1, F.col("vec_id") % 100 + 640).alias("px"), rounded(geometry.scaled(b["xmax"], 0.4, 0.7), "share"), rounded(geometry.box_of(given)["xmin"], "xmin"))


@query(f"""
SELECT vec_id, round(greatest(least(c, 0.8) - greatest(a, 0.2), 0) * greatest(least(d, 0.7) - greatest(b, 0.3), 0), 9) AS overlap, round(greatest(c, 0.8) - least(a, 0.2), 9) AS union_width, round(greatest(d, 0.7) - least(b, 0.3), 9) AS union_height,
    round(greatest(a - 0.1, 0), 9) AS xmin, round(least(d + 0.1, 1), 9) AS ymax FROM ({BOX_SQL})
""")
def box_relations(spark, sf_dir):
    b = F.col("box")
    other = F.struct(F.lit(0.2).alias("xmin"), F.lit(0.3).alias("ymin"), F.lit(0.8).alias("xmax"), F.lit(0.7).alias("ymax"))
    both, more = geometry.union_box(b, other), geometry.expanded(b, 0.1)
    return boxes(spark, sf_dir).select("vec_id", rounded(geometry.overlap_area(b, other), "overlap"), rounded(both["xmax"] - both["xmin"], "union_width"), rounded(both["ymax"] - both["ymin"], "union_height"), rounded(more["xmin"], "xmin"), rounded(more["ymax"], "ymax"))


@query(f"""
WITH m AS (SELECT vec_id, p, (p[1].x + p[2].x + p[3].x + p[4].x) / 4 AS mx, (p[1].y + p[2].y + p[3].y + p[4].y) / 4 AS my FROM ({POINTS_SQL})),
s AS (SELECT vec_id, list_sort(list_transform(p, lambda q: {{'g': atan2(q.y - my, q.x - mx), 'x': q.x, 'y': q.y}})) AS p FROM m)
SELECT vec_id, round(abs(list_sum(list_transform([1, 2, 3, 4], lambda i: p[i].x * p[i % 4 + 1].y - p[i % 4 + 1].x * p[i].y))) / 2, 9) AS area, round(p[1].x, 9) AS first_x FROM s
""")
def around_centre(spark, sf_dir):
    return boxes(spark, sf_dir).select("vec_id", geometry.around_centre(F.col("points")).alias("p")).select("vec_id", rounded(geometry.polygon_area(F.col("p")), "area"), rounded(F.get("p", 0)["x"], "first_x"))


SIZE_SQL = "SELECT p_partkey, p_size * 40 + 200 AS w, p_partkey % 900 + 100 AS h, p_size % 10 AS t, p_partkey % 8 AS l FROM part"


def sizes(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_size")
    return p.select("p_partkey", (F.col("p_size") * 40 + 200).cast("int").alias("w"), (F.col("p_partkey") % 900 + 100).cast("int").alias("h"), (F.col("p_size") % 10).alias("t"), (F.col("p_partkey") % 8).alias("l"))


@query(f"""
WITH m AS (SELECT *, 10 + round_even(w * (l / 10.0::DOUBLE), 0)::INTEGER AS x, 20 + round_even(h * (t / 10.0::DOUBLE), 0)::INTEGER AS y FROM ({SIZE_SQL})),
j AS (SELECT *, greatest(10 + w - x, 0) < greatest(120, round_even(w * 0.35::DOUBLE, 0)) AS narrow, greatest(20 + h - y, 0) < greatest(80, round_even(h * 0.35::DOUBLE, 0)) AS low FROM m)
SELECT p_partkey, floor(w * 0.1::DOUBLE)::INTEGER AS part_x, floor(h * 0.95::DOUBLE)::INTEGER AS part_y, CASE WHEN narrow OR low THEN 10 ELSE x END AS xmin, CASE WHEN narrow OR low THEN 20 ELSE y END AS ymin,
    array_to_string(list_filter([CASE WHEN narrow THEN 'tightening_rejected_width_too_small' END, CASE WHEN low THEN 'tightening_rejected_height_too_small' END], lambda x: x IS NOT NULL), ';') AS reasons FROM j
""")
def crops(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    box = F.struct(F.lit(10).alias("xmin"), F.lit(20).alias("ymin"), (w + 10).alias("xmax"), (h + 20).alias("ymax"))
    rows = sizes(spark, sf_dir).select("p_partkey", geometry.fraction_box(w, h, 0.1, 0.2, 0.9, 0.95).alias("f"), geometry.tightened(box, F.col("t") / 10, F.col("l") / 10).alias("c"))
    return rows.select("p_partkey", F.col("f.xmin").alias("part_x"), F.col("f.ymax").alias("part_y"), F.col("c.box.xmin").alias("xmin"), F.col("c.box.ymin").alias("ymin"), joined(F.col("c.reasons")).alias("reasons"))


UPRIGHT_SQL = "(0, 0.00, 0.45), (1, 0.00, 0.60), (2, 0.10, 0.55), (3, 0.25, 0.60), (4, 0.40, 0.60)"
LEVEL_SQL = "(0, 0.00, 0.55), (1, 0.15, 0.70), (2, 0.35, 0.65), (3, 0.00, 1.00), (4, 0.45, 0.55)"


@query(f"""
WITH s AS ({SIZE_SQL}), e AS (SELECT p_partkey, w::INTEGER AS w, h::INTEGER AS h, floor(w * 0.4::DOUBLE)::INTEGER AS x1, floor(w * 0.6::DOUBLE)::INTEGER AS x2, floor(h * 0.4::DOUBLE)::INTEGER AS y1, floor(h * 0.6::DOUBLE)::INTEGER AS y2 FROM s),
u AS (SELECT n, b::DOUBLE AS b, m::DOUBLE AS m FROM (VALUES {UPRIGHT_SQL}) AS t(n, b, m)), v AS (SELECT n, b::DOUBLE AS b, m::DOUBLE AS m FROM (VALUES {LEVEL_SQL}) AS t(n, b, m))
SELECT p_partkey, 'window' AS kind, n, 'left' AS side, 0 AS xmin, floor(h * b)::INTEGER AS ymin, x1 AS xmax, least(h, floor(h * (b + m)))::INTEGER AS ymax FROM e, u
UNION ALL SELECT p_partkey, 'window', 5 + n, 'right', x2, floor(h * b)::INTEGER, w, least(h, floor(h * (b + m)))::INTEGER FROM e, u
UNION ALL SELECT p_partkey, 'window', 10 + n, 'top', floor(w * b)::INTEGER, 0, least(w, floor(w * (b + m)))::INTEGER, y1 FROM e, v
UNION ALL SELECT p_partkey, 'window', 15 + n, 'bottom', floor(w * b)::INTEGER, y2, least(w, floor(w * (b + m)))::INTEGER, h FROM e, v
UNION ALL SELECT p_partkey, 'band', 0, 'top', 0, 0, w, y1 FROM e UNION ALL SELECT p_partkey, 'band', 1, 'bottom', 0, h - y1, w, h FROM e
UNION ALL SELECT p_partkey, 'band', 2, 'left', 0, 0, x1, h FROM e UNION ALL SELECT p_partkey, 'band', 3, 'right', w - x1, 0, w, h FROM e
""")
def windows_of_pages(spark, sf_dir):
    s = sizes(spark, sf_dir)
    each = lambda kind, c: s.select("p_partkey", F.lit(kind).alias("kind"), F.posexplode(c).alias("n", "x")).select("p_partkey", "kind", "n", "x.side", "x.box.*")
    return each("window", geometry.edge_windows(F.col("w"), F.col("h"))).unionByName(each("band", geometry.side_bands(F.col("w"), F.col("h"))))


# ---- scores and decisions


@query(f"""
WITH s AS (SELECT vec_id, a, b, c, d, [a, b, c, d] AS l FROM ({BOX_SQL}))
SELECT vec_id, round_even(0.28 * greatest(least((a / 10 - 0.015) / 0.065, 1), 0) + 0.24 * greatest(least((b / 1000 - 0.00008) / 0.00142, 1), 0) + 0.18 * c + 0.14 * d + 0.10 * coalesce(CASE WHEN vec_id % 3 > 0 THEN a END, 0) + 0.06 * b, 6) AS evidence,
    round_even(greatest(least(0.58 * a + 0.28 * b + 0.14 * (1 - c), 1), 0), 4) AS confidence FROM s
""")
def evidence_scores(spark, sf_dir):
    b = F.col("box")
    rows = boxes(spark, sf_dir).select("vec_id", *(b[n].alias(m) for n, m in zip(("xmin", "ymin", "xmax", "ymax"), "abcd", strict=True)))
    rows = rows.select("*", F.col("c").alias("grid_balance"), F.col("d").alias("edge_proximity"), F.when(F.col("vec_id") % 3 > 0, F.col("a")).alias("size_reasonableness"), F.col("b").alias("local_contrast"))
    return rows.select("vec_id", rules.evidence_score(F.col("a") / 10, F.col("b") / 1000).alias("evidence"), rules.candidate_confidence(F.col("a"), F.col("b"), F.col("c")).alias("confidence"))


@query(f"""
WITH s AS (SELECT vec_id, 4 * a AS top, 4 * b AS bot, 4 * c AS lef, 4 * d AS rig, c AS component, a AS crossing, vec_id % 3 > 0 AS told, ['top', 'left', 'right', 'bottom'][vec_id % 4 + 1] AS who, b AS ev FROM ({BOX_SQL})),
t AS (SELECT *, CASE greatest(top, bot, lef, rig) WHEN top THEN 'top' WHEN bot THEN 'bottom' WHEN lef THEN 'left' ELSE 'right' END AS best FROM s),
u AS (SELECT *, CASE WHEN best = 'top' AND ((rig >= top * 0.60 AND component >= 0.25) OR (rig >= top * 0.90 AND crossing > 0.3)) THEN 'right' ELSE best END AS band FROM t),
v AS (SELECT *, CASE WHEN NOT told THEN band WHEN band = 'right' AND who IN ('top', 'left') THEN band WHEN ev >= 0.43 THEN who ELSE band END AS side FROM u),
w AS (SELECT *, CASE side WHEN 'top' THEN top WHEN 'bottom' THEN bot WHEN 'left' THEN lef ELSE rig END AS own,
    greatest(CASE WHEN side <> 'top' THEN top ELSE -1 END, CASE WHEN side <> 'bottom' THEN bot ELSE -1 END, CASE WHEN side <> 'left' THEN lef ELSE -1 END, CASE WHEN side <> 'right' THEN rig ELSE -1 END) AS rival FROM v),
x AS (SELECT *, greatest(greatest(least((own - 1) / 6, 1), 0), CASE WHEN told THEN ev ELSE 0 END) AS evidence FROM w),
y AS (SELECT *, round_even(greatest(least(0.62 * evidence + 0.23 * CASE WHEN own = 0 THEN 0 ELSE greatest(least((own - rival) / nullif(own, 0), 1), 0) END + 0.15 * (1 - CASE WHEN rival >= own * 0.88 THEN 1 ELSE 0 END), 1), 0), 4) AS plain FROM x)
SELECT vec_id, side, round(evidence, 9) AS evidence, CASE WHEN told AND ev >= 0.45 AND plain < 0.32 THEN 0.32 ELSE plain END AS confidence, CASE WHEN told AND ev >= 0.45 AND plain < 0.32 THEN false ELSE plain < 0.30 END AS needs_review FROM y
""")
def side_decisions(spark, sf_dir):
    """Bands scored by a box's corners, two thirds of them with a candidate."""
    b, k = F.col("box"), F.col("vec_id")
    band = lambda name, n, component, crossing: F.struct(F.lit(name).alias("side"), (4 * b[n]).alias("score"), component.alias("component_density"), crossing.alias("intersection_density"))
    none = F.lit(0.0)
    bands = F.array(band("top", "xmin", none, F.lit(0.3)), band("bottom", "ymin", none, none), band("left", "xmax", none, none), band("right", "ymax", b["xmax"], b["xmin"]))
    one = F.array(F.struct(picked(k, "top", "left", "right", "bottom").alias("side"), F.lit(50.0).alias("score"), b["ymin"].alias("evidence_score")))
    d = boxes(spark, sf_dir).select("vec_id", rules.side_decision(bands, F.when(k % 3 > 0, one).otherwise(F.array().cast("array<struct<side:string,score:double,evidence_score:double>>"))).alias("d"))
    return d.select("vec_id", "d.side", rounded(F.col("d.evidence"), "evidence"), "d.confidence", "d.needs_review")


@query(f"""
WITH f AS (SELECT vec_id, vec_id // 4 AS page, vec_id % 4 AS candidate_index, (vec_id % 10) / 10 AS conf, abs(list_sum(list_transform([1, 2, 3, 4], lambda i: p[i].x * p[i % 4 + 1].y - p[i % 4 + 1].x * p[i].y))) / 2 AS area, least(a, b, 1 - c, 1 - d) AS edge, vec_id % 5 = 0 AS uniform
    FROM ({POINTS_SQL}) JOIN ({BOX_SQL}) USING (vec_id)),
s AS (SELECT *, conf + 0.25 * (vec_id % 3) / 2 + 0.15 * greatest(least(1 - greatest(edge, 0) / 0.12, 1), 0) + 0.2 * greatest(least(1 - abs(area - 0.04) / 0.04, 1), 0) + 0.1 * CASE WHEN vec_id % 3 = 0 THEN 0.45 ELSE 0 END - 0.35 * uniform::INTEGER - 0.4 * (vec_id % 7 = 0)::INTEGER AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, candidate_index) = 1 AS selected, count(*) OVER (PARTITION BY page) AS n, CASE WHEN page % 3 = 0 THEN 1 END AS expected FROM s)
SELECT page, candidate_index, round(score, 6)::DOUBLE AS score, selected, CASE WHEN selected THEN '' ELSE array_to_string(list_filter(['not_selected_by_single_title_block_rule', CASE WHEN candidate_index = expected THEN 'non_title_table_false_positive' END, CASE WHEN uniform THEN 'uniform_grid_like' END, 'lower_confidence_duplicate_or_neighbor'], lambda x: x IS NOT NULL), ';') END AS reasons,
    CASE WHEN expected IS NOT NULL AND NOT coalesce(bool_or(candidate_index = expected AND NOT selected) OVER (PARTITION BY page), false) THEN 'needs_review' ELSE 'accepted' END AS status,
    array_to_string(list_filter([CASE WHEN n > 1 THEN 'multi_candidate_resolved' END, CASE WHEN expected IS NOT NULL AND NOT coalesce(bool_or(candidate_index = expected AND NOT selected) OVER (PARTITION BY page), false) THEN 'expected_false_positive_not_rejected' END,
        CASE WHEN expected IS NOT NULL AND coalesce(bool_or(candidate_index = expected AND NOT selected) OVER (PARTITION BY page), false) THEN 'manual_expected_accepted' END], lambda x: x IS NOT NULL), ';') AS issues FROM r
""")
def several_candidates(spark, sf_dir):
    """Scores and the choice among four candidates a page, some of them foreseen as no title block."""
    k = F.col("vec_id")
    rows = boxes(spark, sf_dir).select(
        F.floor(k / 4).cast("string").alias("prediction_dir"),
        F.lit("s").alias("sample"),
        (k % 4).alias("candidate_index"),
        (k % 10 / 10).alias("confidence"),
        geometry.polygon_area(F.col("points")).alias("area"),
        "box",
        "points",
        (k % 3 / 2).alias("frame_contact_score"),
        F.when(k % 3 == 0, 0.9).alias("cell_area_variance"),
        (k % 5 == 0).cast("double").alias("uniform_grid_penalty"),
        (k % 7 == 0).cast("double").alias("inside_drawing_body_penalty"),
        F.when(k % 5 == 0, texts("uniform_grid_like")).alias("diagnostic_flags"),
    )
    pages = rows.select("prediction_dir", "sample").distinct().where(F.col("prediction_dir").cast("long") % 3 == 0)
    found, told = records.multi_candidate_records(rows, pages.select("*", F.lit(1).cast("long").alias("reject_index"), F.lit(True).alias("accepted"), F.lit(False).alias("small_angle")))
    out = told.join(found.select("prediction_dir", "status", "issue_types"), "prediction_dir")
    return out.select(F.col("prediction_dir").cast("long").alias("page"), "candidate_index", rounded(F.col("multicandidate_score"), "score", 6), "selected", F.coalesce(joined("rejection_reasons"), F.lit("")).alias("reasons"), "status", joined("issue_types").alias("issues"))


@query(f"SELECT vec_id // 4 AS page, string_agg(vec_id % 4 || '=' || vec_id, ';' ORDER BY vec_id % 4) AS candidates FROM embeddings GROUP BY vec_id // 4")
def candidate_groups(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings", "vec_id").select(F.floor(F.col("vec_id") / 4).cast("long").alias("page"), (F.col("vec_id") % 4).alias("candidate_index"), "vec_id")
    g = records.grouped_candidates(e, ["page"])
    return g.select("page", F.array_join(F.transform("candidates", lambda c: F.concat(c["candidate_index"].cast("string"), F.lit("="), c["vec_id"].cast("string"))), ";").alias("candidates"))


PROBLEMS = ("没有被完全框住", "超出页面", "零件表", None)
ISSUE_SQL = f"""
SELECT o_orderkey, n, list_filter(l, lambda x, i: list_position(l, x) = i) AS issues FROM (SELECT *, list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'format_error' END, CASE WHEN n = 0 THEN 'missing_title_block' END, CASE WHEN n > 1 THEN 'multi_candidate_resolved' END,
    CASE WHEN o_orderkey % 4 = 0 THEN 'part_false_positive' END, CASE WHEN o_orderkey % 4 = 2 THEN 'out_of_page_bounds' END, CASE WHEN o_orderkey % 4 = 3 THEN 'boundary_too_large' END, CASE WHEN bad THEN 'manual_rejected' END,
    CASE WHEN bad AND said LIKE '%没有被完全框住%' THEN 'partial_title_block' END, CASE WHEN bad AND said LIKE '%超出%' THEN 'boundary_too_large' END, CASE WHEN bad AND said LIKE '%零件%' THEN 'part_false_positive' END], lambda x: x IS NOT NULL) AS l
    FROM (SELECT o_orderkey, o_orderkey % 3 AS n, o_orderkey % 5 = 1 AS bad, {picked_sql("o_orderkey", *PROBLEMS)} AS said FROM orders))
"""


@query(f"""
SELECT o_orderkey, array_to_string(issues, ';') AS issues, CASE WHEN n = 0 OR list_has_any(issues, ['manual_rejected', 'expected_false_positive_not_rejected', 'part_false_positive', 'out_of_page_bounds', 'boundary_too_large', 'partial_title_block', 'format_error']) THEN 'needs_review' ELSE 'accepted' END AS status FROM ({ISSUE_SQL})
""")
def record_reviews(spark, sf_dir):
    return reviewed(spark, sf_dir).select("o_orderkey", joined("issues").alias("issues"), "status")


def reviewed(spark, sf_dir):
    k = F.col("o_orderkey")
    flags = F.when(k % 4 == 0, F.array(texts("near_edge"), texts("center_region"))).when(k % 4 == 1, F.array(texts("center_region", "touches_frame_line"))).when(k % 4 == 2, F.array(texts("out_of_page_bounds"))).otherwise(F.array(texts(), texts("size_abnormal")))
    issues = rules.record_issues((k % 3).cast("int"), F.when(k % 7 == 0, texts("format_error")), flags, F.when(k % 5 == 1, "不可接受").when(k % 5 == 2, "可以接受"), picked(k, *PROBLEMS))
    return read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", (k % 3).alias("n"), issues.alias("issues")).withColumn("status", rules.record_status(F.col("n"), F.col("issues")))


@query(f"""
WITH r AS (SELECT *, CASE WHEN n = 0 OR list_has_any(issues, ['manual_rejected', 'part_false_positive', 'out_of_page_bounds', 'boundary_too_large', 'partial_title_block', 'format_error']) THEN 'needs_review' ELSE 'accepted' END AS status FROM ({ISSUE_SQL}))
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'needs_review') AS needs_review, 0::BIGINT AS rejected, count(*) FILTER (WHERE list_contains(issues, 'missing_title_block')) AS missing_prediction_label,
    count(*) FILTER (WHERE list_contains(issues, 'multi_candidate_resolved')) AS multi_candidate, count(*) FILTER (WHERE list_contains(issues, 'multi_candidate_resolved')) AS multi_candidate_resolved, count(*) FILTER (WHERE list_contains(issues, 'part_false_positive')) AS part_false_positive,
    count(*) FILTER (WHERE list_has_any(issues, ['boundary_too_large', 'out_of_page_bounds'])) AS boundary_or_size_issue, count(*) FILTER (WHERE list_contains(issues, 'manual_rejected')) AS manual_rejected, sum(greatest(n - 1, 0))::BIGINT AS rejected_candidates,
    count(*) FILTER (WHERE n > 1) AS multi_candidate_records, 9::BIGINT AS expected_false_positive_rejected FROM r
""")
def review_counts(spark, sf_dir):
    """Counts over classified records, as the one and the other report has them."""
    rows = reviewed(spark, sf_dir).withColumnRenamed("issues", "issue_types").withColumn("rejected_count", F.greatest(F.col("n") - 1, F.lit(0))).withColumn("prediction_count", F.col("n"))
    several = records.multi_candidate_summary(rows, 9).select("multi_candidate_records", F.col("expected_false_positive_rejected").cast("long").alias("expected_false_positive_rejected"))
    return records.postprocess_summary(rows).crossJoin(F.broadcast(several))  # one row each


@query(f"""
WITH e AS (SELECT event_id, event_id % 3 = 0 AS none, {picked_sql("event_id", "missing", "strong", "weak", "none", "unavailable")} AS level, {picked_sql("event_id", "left", "top", "")} AS pos, {picked_sql("event_id", "bbox_nearest_page_side", "note")} AS source, {picked_sql("event_id", "left", "right", None, "top")} AS side FROM events),
d AS (SELECT *, coalesce(nullif(pos, '') <> side, false) AS differs FROM e)
SELECT event_id, array_to_string(list_filter([CASE WHEN none THEN 'yolo_selected_title_block' END, CASE WHEN level = 'missing' THEN 'ocr_selected_candidate' END, CASE WHEN side IS NULL THEN 'opencv_rotation_result' END], lambda x: x IS NOT NULL), ';') AS missing,
    array_to_string(list_filter([CASE WHEN level IN ('weak', 'none', 'unavailable') THEN 'ocr_field_cluster_' || level END, CASE WHEN differs AND source <> 'note' THEN 'yolo_opencv_position_conflict:' || pos || '!=' || side END,
        CASE WHEN differs AND source = 'note' THEN 'position_source_not_comparable:note:' || pos || '!=' || side END], lambda x: x IS NOT NULL), ';') AS conflicts FROM d
""")
def evidence_gaps(spark, sf_dir):
    k = F.col("event_id")
    selected = F.when(k % 3 != 0, F.struct(F.lit(1).alias("x")))
    level, side = picked(k, "missing", "strong", "weak", "none", "unavailable"), picked(k, "left", "right", None, "top")
    conflicts = records.evidence_conflicts(level, picked(k, "left", "top", ""), picked(k, "bbox_nearest_page_side", "note"), side)
    return read(spark, sf_dir, "events", "event_id").select("event_id", joined(records.missing_evidence(selected, level, side)).alias("missing"), joined(conflicts).alias("conflicts"))


@query(f"""
WITH e AS (SELECT event_id, {picked_sql("event_id", "auto_accept", "needs_vlm")} AS decision, {picked_sql("event_id", "p", "", None)} AS path, event_id % 5 > 0 AS found, CASE WHEN event_id % 7 > 0 THEN 90 END AS turn, event_id % 11 = 0 AS there, {picked_sql("event_id", "JS-1", "a b", "x/y", "", "...")} AS number FROM events),
p AS (SELECT *, list_filter([CASE WHEN decision <> 'auto_accept' THEN 'arbitration_not_auto_accept' END, CASE WHEN coalesce(path, '') = '' THEN 'missing_single_page_pdf_path' END, CASE WHEN coalesce(path, '') <> '' AND NOT found THEN 'single_page_pdf_path_not_found' END, CASE WHEN turn IS NULL THEN 'missing_correction_degrees' END,
        CASE WHEN there THEN 'corrected_pdf_candidate_would_overwrite' END], lambda x: x IS NOT NULL) AS turning,
    CASE WHEN event_id % 9 = 0 THEN ['drawing_number_ambiguous'] ELSE [] END AS naming, CASE number WHEN 'JS-1' THEN 'JS-1' WHEN 'a b' THEN 'a_b' WHEN 'x/y' THEN 'x_y' END AS name,
    CASE number WHEN 'JS-1' THEN [] WHEN 'a b' THEN ['filename_changed_by_sanitization'] WHEN 'x/y' THEN ['filename_changed_by_sanitization'] WHEN '' THEN ['drawing_number_missing'] ELSE ['filename_empty_after_sanitization'] END AS risks FROM e),
q AS (SELECT *, list_sort(list_distinct(list_concat(naming, risks, CASE WHEN len(turning) > 0 THEN ['upstream_rotation_blocked'] ELSE [] END, CASE WHEN there THEN ['renamed_pdf_candidate_would_overwrite'] ELSE [] END))) AS held FROM p),
r AS (SELECT *, list_sort(list_distinct(list_concat(turning, held))) AS all_ FROM q)
SELECT event_id, array_to_string(turning, ';') AS rotation_blockers, name, len(held) = 0 AS can_rename, len(risks) > 0 AND risks[1] = 'filename_changed_by_sanitization' AS changed,
    CASE WHEN len(held) = 0 THEN 'auto_dry_run_ready' WHEN list_has_any(all_, ['arbitration_not_auto_accept', 'drawing_number_ambiguous']) THEN 'needs_human_review' ELSE 'blocked' END AS route, array_to_string(all_, ';') AS reasons,
    CASE WHEN coalesce(path, '') = '' THEN 'missing_title_block_crop' WHEN NOT found THEN 'title_block_crop_not_found' ELSE '' END AS crop, CASE WHEN coalesce(path, '') = '' THEN 'missing_ocr_text;ocr_field_cluster_not_strong' WHEN there THEN '' ELSE 'ocr_field_cluster_not_strong' END AS recognition FROM r
""")
def dry_runs(spark, sf_dir):
    """Turning and renaming in a dry run: what blocks them, and where records go."""
    k = F.col("event_id")
    path, found, there = picked(k, "p", "", None), k % 5 > 0, k % 11 == 0
    turning = rules.dry_run_plan(picked(k, "auto_accept", "needs_vlm"), path, found, F.when(k % 7 > 0, 90), there)
    rows = read(spark, sf_dir, "events", "event_id").select("event_id", turning.alias("t"))
    plan = records.rename_plan(picked(k, "JS-1", "a b", "x/y", "", "..."), F.when(k % 9 == 0, texts("drawing_number_ambiguous")).otherwise(texts()), F.size("t") == 0, there)
    rows = rows.select("*", plan.alias("p"))
    route = rules.dry_run_route(F.col("p.can_rename"), F.col("t"), F.col("p.blockers"))
    level = F.when(there, "strong").otherwise("weak")
    return rows.select("event_id", joined(F.col("t")).alias("rotation_blockers"), F.col("p.name").alias("name"), F.col("p.can_rename").alias("can_rename"), F.col("p.changed").alias("changed"), route["route"].alias("route"), joined(route["reasons"]).alias("reasons"), joined(records.crop_blockers(path, found)).alias("crop"), joined(records.recognition_blockers(path, F.when(path == "p", level))).alias("recognition"))


@query(f"""
WITH e AS (SELECT event_id, event_id % 7 = 0 AS none, {picked_sql("event_id", "A", "B", "", None)} AS fine, {picked_sql("event_id", "A", "", "C")} AS coarse, (event_id % 10) / 10.0::DOUBLE AS score, (event_id % 9) / 9.0::DOUBLE AS area, {picked_sql("event_id", "strong", "weak")} AS level FROM events),
f AS (SELECT *, CASE WHEN none THEN '' ELSE coalesce(fine, '') END AS x FROM e),
g AS (SELECT *, CASE WHEN none THEN 'fine_roi_missing' WHEN x = '' AND coarse <> '' THEN 'fine_roi_lost_coarse_candidate' WHEN x <> '' AND coarse <> '' AND x <> coarse THEN 'coarse_fine_candidate_conflict' WHEN x = '' THEN 'drawing_number_missing_in_fine_roi' END AS first,
    list_filter([CASE WHEN area >= 0.82 THEN 'fine_roi_not_much_smaller' END, CASE WHEN score < 0.72 THEN 'fine_candidate_low_confidence' END, CASE WHEN level <> 'strong' THEN 'fine_field_cluster_not_strong' END], lambda v: v IS NOT NULL) AS more FROM f)
SELECT event_id, CASE WHEN first IS NULL AND len(more) = 0 THEN 'fine_roi_candidate' ELSE 'needs_review' END AS status, CASE WHEN first IS NOT NULL THEN first WHEN len(more) = 0 THEN 'fine_roi_candidate_matches_quality_gate' ELSE array_to_string(more, ';') END AS reasons,
    round_even(score + (2 / 8.0::DOUBLE + 1 / 7.0::DOUBLE) / 2 * 0.18 + greatest(1 - area, 0) * 0.10 + CASE WHEN coalesce(fine, '') <> '' THEN 0.25 ELSE 0 END, 6)::DOUBLE AS score, CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 1 WHEN event_id % 5 = 0 THEN 2 END AS tier,
    CASE WHEN coarse <> '' AND coalesce(fine, '') = '' THEN 'new_roi_lost_previous_candidate' WHEN coarse <> '' THEN 'new_roi_has_candidate' WHEN coalesce(fine, '') <> '' THEN 'new_roi_added_candidate' ELSE 'no_candidate_before_or_after' END AS guard FROM g
""")
def finer_regions(spark, sf_dir):
    k = F.col("event_id")
    fine, coarse, score, area = picked(k, "A", "B", "", None), picked(k, "A", "", "C"), k % 10 / 10, k % 9 / 9
    region = F.when(k % 7 != 0, F.struct(fine.alias("top_candidate"), score.alias("top_score"), area.alias("area_ratio"), picked(k, "strong", "weak").alias("cluster_level")))
    r = rules.finer_region(region, coarse)
    tier = rules.region_tier(F.when(k % 4 == 0, "bottom_right_band_roi").otherwise("other"), F.when(k % 2 == 0, F.when(k % 4 == 0, "bottom_right_band_roi").otherwise("other")).otherwise("none"), k % 5 == 0, F.when(k % 3 == 0, "a;prefer_bottom_right_blue_roi"))
    return read(spark, sf_dir, "events", "event_id").select("event_id", r["status"].alias("status"), joined(r["reasons"]).alias("reasons"), rules.region_score(score, fine, texts("设计", "审核"), texts("图号"), area).alias("score"), tier.alias("tier"), rules.candidate_guard(coarse, fine).alias("guard"))


@query(f"""
SELECT event_id, {picked_sql("event_id", "完整", "右侧或图号尾部缺失;只覆盖半截标题栏", "错框或混入主体;图像质量问题", "未分层")} AS crop, {picked_sql("event_id", "完整性正确", "范围太大;包含非标题栏图纸区域", "未分层", "未分层")} AS recovery,
    {picked_sql("event_id", "新版ROI通过", "收窄过度;保留旧高度;采用新版左右范围;裁掉标题栏", "未分层", "未分层")} AS tightening, {picked_sql("event_id", "x", "y", "未分层", "x;y")} AS note FROM events
""")
def review_layers(spark, sf_dir):
    k = F.col("event_id")
    crop = rules.form_layers("crop", judgment=picked(k, "正确", "", "x", None), issue=picked(k, "", "右侧缺", "错框", None), note=picked(k, "", "只有一半", "字迹浅", None))
    recovery = rules.form_layers("recovery", judgment=picked(k, "完整", "", "x", None), issue=picked(k, "", "范围太大", "", None), note=picked(k, "", "左半边不是标题栏", "", None))
    tightening = rules.form_layers("tightening", judgment=picked(k, "正确", "太小了", "", None), relative=picked(k, "更好", "", "更好", None), issue=picked(k, "", "裁掉标题栏", "", None), note=picked(k, "", "高度更好，左右范围合适", "", None))
    note = rules.note_layers(picked(k, "b", "z", "-", "bz"), {"x": ("a", "b"), "y": ("z",)})
    return read(spark, sf_dir, "events", "event_id").select("event_id", *(joined(c).alias(n) for c, n in ((crop, "crop"), (recovery, "recovery"), (tightening, "tightening"), (note, "note"))))


KINDS = ("hardcase_positive", "confidence_calibration", "mcp_corrected_opencv", "small_angle_offset_tolerated", "non_title_table_false_positive")


@query(f"""
WITH e AS (SELECT event_id, {picked_sql("event_id", *KINDS)} AS kind, event_id % 3 > 0 AS good, {picked_sql("event_id", "weak", "strong")} AS strength, event_id % 7 = 0 AS risky, event_id % 11 = 0 AS review, (event_id % 10) / 10.0::DOUBLE AS sure FROM events),
t AS (SELECT *, list_filter([CASE WHEN good AND strength = 'strong' THEN 'rule' END, CASE WHEN good AND kind IN ('hardcase_positive', 'small_angle_offset_tolerated') THEN 'data' END, CASE WHEN kind = 'confidence_calibration' THEN 'rule' END, CASE WHEN kind = 'confidence_calibration' THEN 'provider' END,
    CASE WHEN risky THEN 'rule' END, CASE WHEN risky THEN 'data' END, CASE WHEN risky THEN 'model' END, CASE WHEN kind = 'mcp_corrected_opencv' THEN 'rule' END, CASE WHEN kind = 'mcp_corrected_opencv' THEN 'provider' END, CASE WHEN review THEN 'provider' END], lambda x: x IS NOT NULL) AS l FROM e)
SELECT event_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';') AS targets, CASE WHEN NOT good THEN '{rules.ADVICE["not_true"]}' WHEN kind = 'small_angle_offset_tolerated' THEN '{rules.ADVICE["small_angle_offset_tolerated"]}' WHEN kind = 'confidence_calibration' THEN '{rules.ADVICE["confidence_calibration"]}'
    WHEN kind = 'mcp_corrected_opencv' THEN '{rules.ADVICE["mcp_corrected_opencv"]}' WHEN sure < 0.85 THEN '{rules.ADVICE["unsure"]}' ELSE '{rules.ADVICE["stable"]}' END AS advice FROM t
""")
def distilling(spark, sf_dir):
    k = F.col("event_id")
    kind, good = picked(k, *KINDS), k % 3 > 0
    judgment = F.struct(good.alias("is_true"), F.lit(True).alias("touches_frame"), picked(k, "weak", "strong").alias("strength"), F.when(k % 7 == 0, "high").otherwise("low").alias("risk"), texts().alias("reject_reasons"))
    return read(spark, sf_dir, "events", "event_id").select("event_id", joined(rules.distill_targets(kind, judgment, k % 11 == 0)).alias("targets"), rules.advice(kind, good, k % 10 / 10).alias("advice"))


@query("SELECT * FROM (VALUES ('some', 'fine'), ('none', 'refused'), ('empty', 'fine')) AS t(calls, result)")
def failed_calls(spark, sf_dir):
    """Whether a run goes on: not when there were calls and all of them failed."""
    e = read(spark, sf_dir, "events", "event_id")
    out = []
    for name, rows, ok in (("some", e, F.col("event_id") % 2 == 0), ("none", e, F.lit(None).cast("boolean")), ("empty", e.limit(0), F.lit(False))):
        try:
            rules.all_failed(rows, ok)
            out.append((name, "fine"))
        except RuntimeError:
            out.append((name, "refused"))
    return spark.createDataFrame(out, "calls string, result string")


@query(f"""
WITH s AS ({SIZE_SQL})
SELECT p_partkey, 'right_band_roi' AS roi_name, floor(w * 0.42::DOUBLE)::INTEGER AS xmin, 0 AS ymin, w::INTEGER AS xmax, 'fixed_ratio' AS status FROM s UNION ALL SELECT p_partkey, 'bottom_right_band_roi', floor(w * 0.35::DOUBLE)::INTEGER, floor(h * 0.22::DOUBLE)::INTEGER, w::INTEGER, 'fixed_ratio' FROM s
UNION ALL SELECT p_partkey, 'table_line_right_roi', CASE WHEN l > 3 THEN l::INTEGER END, CASE WHEN l > 3 THEN 2 END, CASE WHEN l > 3 THEN w::INTEGER END, CASE WHEN l > 3 THEN 'ok' ELSE 'no_right_cluster' END FROM s
""")
def roi_proposals(spark, sf_dir):
    w, h, there = F.col("w"), F.col("h"), F.col("l") > 3
    table = F.when(there, F.struct(F.col("l").cast("int").alias("xmin"), F.lit(2).alias("ymin"), w.alias("xmax"), h.alias("ymax")))
    rows = sizes(spark, sf_dir).select("p_partkey", F.explode(geometry.roi_proposals(w, h, table, F.when(there, "ok").otherwise("no_right_cluster"))).alias("r"))
    return rows.select("p_partkey", "r.roi_name", "r.box.xmin", "r.box.ymin", "r.box.xmax", "r.status")


@query(f"""
SELECT p_partkey, round_even((w - l) * (h - t) / greatest(CASE WHEN l = 7 THEN 0 ELSE w * h END, 1)::DOUBLE, 6) AS ratio, round_even(1 - round_even((w - l) * (h - t) / greatest(CASE WHEN l = 7 THEN 0 ELSE w * h END, 1)::DOUBLE, 6), 6) AS reduction,
    CASE WHEN l % 4 = 0 THEN 1.5::DOUBLE WHEN l % 4 = 1 THEN 3.0::DOUBLE END AS xmin FROM ({SIZE_SQL})
""")
def area_changes(spark, sf_dir):
    """How much smaller a box became, and a box from the first of two fields that has one."""
    w, h, t, left = F.col("w"), F.col("h"), F.col("t"), F.col("l")
    old = F.struct(F.lit(0).alias("xmin"), F.lit(0).alias("ymin"), F.when(left == 7, 0).otherwise(w).alias("xmax"), h.alias("ymax"))
    new = F.struct(left.alias("xmin"), t.alias("ymin"), w.alias("xmax"), h.alias("ymax"))
    change, k = geometry.area_change(old, new), left % 4
    box = geometry.first_box(F.when(k == 0, texts("1.5", "2", "3", "4")).when(k == 1, texts()).when(k == 2, texts("x", "2", "3", "4")), texts("3", "4", "5", "6"))
    return sizes(spark, sf_dir).select("p_partkey", change["area_ratio"].alias("ratio"), change["area_reduction_ratio"].alias("reduction"), F.when(k < 3, box["xmin"]).alias("xmin"))


@query(f"""
SELECT vec_id % 5 AS page, max(vec_id) AS vec_id FROM ({BOX_SQL}) GROUP BY vec_id % 5, floor(a * 40 / 8), floor(b * 40 / 8), floor(c * 40 / 8), floor(d * 40 / 8)
""")
def near_boxes_of_four(spark, sf_dir):
    """Boxes whose four corners fall in the same cells, of which the last stays."""
    from vellumen.operators import rank

    b = F.col("box")
    rows = boxes(spark, sf_dir).select("vec_id", (F.col("vec_id") % 5).alias("page"), *((b[n] * 40).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")))
    return rank.near_boxes(rows, ["page"], ["xmin", "ymin", "xmax", "ymax"], ["vec_id"]).select("page", "vec_id")


@query("""
SELECT (SELECT count(*) FROM part) AS total, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)) + 1 AS missing_required_sample, (SELECT sum((p_partkey % 7 = 0)::INTEGER + (p_partkey % 11 = 0)::INTEGER)::BIGINT FROM part) AS missing_file,
    (SELECT count(*) FROM part WHERE p_partkey % 13 = 0) AS invalid_label, false AS quality_gate_passed
""")
def manifest_gates(spark, sf_dir):
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part", "p_partkey").select(k.cast("string").alias("sample"), F.when(k % 7 == 0, "missing").otherwise("exists").alias("image_status"), F.when(k % 11 != 0, "exists").alias("label_status"), F.lit("exists").alias("prediction_image_status"), F.lit("exists").alias("prediction_label_status"), F.when(k % 13 == 0, "two").otherwise("ok_single_title_block").alias("label_quality_status"))
    required = read(spark, sf_dir, "supplier", F.col("s_suppkey").cast("string").alias("sample")).unionByName(spark.createDataFrame([("none",)], "sample string"))
    return records.manifest_gate(rows, required)
