"""Boxes and polygons on a page, as column expressions.

A polygon is an array of structs (x, y); a box a struct (xmin, ymin, xmax, ymax).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def scaled(c: Column, low: float, high: float) -> Column:
    """Linear from 0 at low to 1 at high."""
    return clamp((c - low) / (high - low))


def _next(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def polygon_area(points: Column) -> Column:
    cross = F.zip_with(points, _next(points), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def bbox(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def box_of(items: Column) -> Column:
    """A box from an array of four numbers; null for any other length or item."""
    n = F.transform(items, lambda x: x.cast("string").try_cast("double"))
    good = (F.size(n) == 4) & ~F.exists(n, lambda x: x.isNull())
    return F.when(good, F.struct(*(F.get(n, i).alias(k) for i, k in enumerate(("xmin", "ymin", "xmax", "ymax")))))


def pixels(c: Column, size: Column) -> Column:
    """A share of a page in pixels: within the page, halves to even."""
    return F.bround(clamp(c) * size, 0).cast("int")


def _least_side(pairs: dict[str, Column]) -> Column:
    """The first side, in the given order, with the least distance; null distances don't count."""
    options = F.array(*(F.when(d.isNotNull(), F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(side).alias("side"))) for i, (side, d) in enumerate(pairs.items())))
    return F.array_min(F.filter(options, lambda o: o.isNotNull()))


def nearest_side(box: Column, *, signed: bool = False) -> Column:
    """left, right, top or bottom: the page's side that is nearest, the first of equals."""
    d = {"left": box["xmin"], "right": 1.0 - box["xmax"], "top": box["ymin"], "bottom": 1.0 - box["ymax"]}
    return _least_side(d if signed else {k: F.abs(v) for k, v in d.items()})["side"]


def axis_offset(points: Column) -> Column:
    """Degrees by which the two longest edges lean from the axes, the lesser of both."""
    def offset(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        angle = F.abs(F.degrees(F.atan2(dy, dx))) % 90.0
        return F.struct(F.hypot(dx, dy).alias("length"), F.least(angle, 90.0 - angle).alias("offset"))

    edges = F.filter(F.zip_with(points, _next(points), offset), lambda e: e["length"] > 0)
    return F.array_min(F.transform(F.slice(F.sort_array(edges, asc=False), 1, 2), lambda e: e["offset"]))


def aspect_position(box: Column, ratio: float = 1.15) -> Column:
    """Struct (side, source): lying boxes are at the top or bottom, standing ones left or right, others at the nearest side."""
    w, h = F.greatest(box["xmax"] - box["xmin"], F.lit(0.0)), F.greatest(box["ymax"] - box["ymin"], F.lit(0.0))
    lies, stands = (h > 0) & (w >= h * ratio), (w > 0) & (h >= w * ratio)
    middle = lambda a, b: (box[a] + box[b]) / 2 >= 0.5
    side = F.when(lies, F.when(middle("ymin", "ymax"), "bottom").otherwise("top")).when(stands, F.when(middle("xmin", "xmax"), "right").otherwise("left")).otherwise(nearest_side(box))
    source = F.when(lies, "bbox_aspect_center_horizontal").when(stands, "bbox_aspect_center_vertical").otherwise("bbox_nearest_page_side")
    return F.struct(side.alias("side"), source.alias("source"))


def frame_contact(box: Column, frame: Column, threshold: float = 0.025) -> Column:
    """How a box meets the detected frame lines; frame is a struct of left, right, top, bottom, null where none was found."""
    edges = {"left": "xmin", "right": "xmax", "top": "ymin", "bottom": "ymax"}
    best = _least_side({side: F.abs(box[edge] - frame[side]) for side, edge in edges.items()})
    line = F.coalesce(*(F.when(best["side"] == side, frame[side]) for side in edges))
    known = best.isNotNull()
    return F.struct(
        F.coalesce(best["side"], nearest_side(box)).alias("nearest_frame_side"),
        line.alias("frame_line_position"),
        best["d"].alias("frame_contact_gap"),
        F.when(known, clamp(1.0 - best["d"] / threshold)).otherwise(0.0).alias("frame_contact_score"),
        F.coalesce(best["d"] <= threshold, F.lit(False)).alias("touches_frame_line"),
        F.when(~known, "unknown").when(best["d"] <= threshold, "contact").otherwise("gap").alias("frame_contact_status"),
    )


def _box(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.struct(a.alias("xmin"), b.alias("ymin"), c.alias("xmax"), d.alias("ymax"))


def overlap_area(a: Column, b: Column) -> Column:
    wide = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    high = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def union_box(a: Column, b: Column) -> Column:
    return _box(F.least(a["xmin"], b["xmin"]), F.least(a["ymin"], b["ymin"]), F.greatest(a["xmax"], b["xmax"]), F.greatest(a["ymax"], b["ymax"]))


def expanded(box: Column, pad: Column | float, width: Column | float = 1.0, height: Column | float = 1.0) -> Column:
    """A box with padding, within the page."""
    low, wide, high = F.lit(0), F.lit(width) if not isinstance(width, Column) else width, F.lit(height) if not isinstance(height, Column) else height
    return _box(F.greatest(box["xmin"] - pad, low), F.greatest(box["ymin"] - pad, low), F.least(box["xmax"] + pad, wide), F.least(box["ymax"] + pad, high))


def rotated_box(box: Column, degrees: Column, width: Column | float = 1.0, height: Column | float = 1.0) -> Column:
    """Where a box lies after its page has turned clockwise by a right angle."""
    w, h = (c if isinstance(c, Column) else F.lit(c) for c in (width, height))
    return (
        F.when(degrees == 90, _box(h - box["ymax"], box["xmin"], h - box["ymin"], box["xmax"]))
        .when(degrees == 180, _box(w - box["xmax"], h - box["ymax"], w - box["xmin"], h - box["ymin"]))
        .when(degrees == 270, _box(box["ymin"], w - box["xmax"], box["ymax"], w - box["xmin"]))
        .otherwise(_box(box["xmin"], box["ymin"], box["xmax"], box["ymax"]))
    )


def around_centre(points: Column) -> Column:
    """Points ordered by their angle about their mean."""
    n = F.size(points)
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / n
    turned = F.transform(points, lambda p: F.struct(F.atan2(p["y"] - mean("y"), p["x"] - mean("x")).alias("angle"), p.alias("p")))
    return F.transform(F.array_sort(turned), lambda t: t["p"])


def fraction_box(width: Column, height: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return _box(*(F.floor(size * part).cast("int") for size, part in ((width, x0), (height, y0), (width, x1), (height, y1))))


def tightened(box: Column, top: Column, left: Column, least_share: float = 0.35, least_width: int = 120, least_height: int = 80) -> Column:
    """Struct (box, reasons): a box of pixels without shares of its top and left side; if that leaves too little, the old box and why."""
    whole = lambda c: F.bround(c, 0).cast("int")
    w, h = F.greatest(box["xmax"] - box["xmin"], F.lit(0)), F.greatest(box["ymax"] - box["ymin"], F.lit(0))
    x, y = box["xmin"].cast("int") + whole(w * left), box["ymin"].cast("int") + whole(h * top)
    narrow = F.greatest(box["xmax"] - x, F.lit(0)) < F.greatest(F.lit(least_width), whole(w * least_share))
    low = F.greatest(box["ymax"] - y, F.lit(0)) < F.greatest(F.lit(least_height), whole(h * least_share))
    ints = _box(*(box[k].cast("int") for k in ("xmin", "ymin", "xmax", "ymax")))
    kept = F.when(narrow | low, ints).otherwise(_box(x, y, box["xmax"].cast("int"), box["ymax"].cast("int")))
    reasons = F.filter(F.array(F.when(narrow, F.lit("tightening_rejected_width_too_small")), F.when(low, F.lit("tightening_rejected_height_too_small"))), lambda r: r.isNotNull())
    return F.struct(kept.alias("box"), reasons.alias("reasons"))


# Where windows along a side begin and how long they are, and how deep they reach.
UPRIGHT = ((0.00, 0.45), (0.00, 0.60), (0.10, 0.55), (0.25, 0.60), (0.40, 0.60))
LEVEL = ((0.00, 0.55), (0.15, 0.70), (0.35, 0.65), (0.00, 1.00), (0.45, 0.55))
DEPTH = 0.40


def edge_windows(width: Column, height: Column) -> Column:
    """Twenty windows along the sides of a page: array of structs (side, box)."""
    part = lambda size, share: F.floor(size * share).cast("int")
    found = []
    for side in ("left", "right", "top", "bottom"):
        for begin, length in UPRIGHT if side in ("left", "right") else LEVEL:
            along = height if side in ("left", "right") else width
            a, b = part(along, begin), F.least(along.cast("int"), part(along, begin + length))
            across = width if side in ("left", "right") else height
            c, d = (F.lit(0), part(across, DEPTH)) if side in ("left", "top") else (part(across, 1 - DEPTH), across.cast("int"))
            box = _box(c, a, d, b) if side in ("left", "right") else _box(a, c, b, d)
            found.append(F.struct(F.lit(side).alias("side"), box.alias("box")))
    return F.array(*found)


def side_bands(width: Column, height: Column) -> Column:
    """The four bands of a page."""
    w, h = width.cast("int"), height.cast("int")
    x, y, none = F.floor(width * DEPTH).cast("int"), F.floor(height * DEPTH).cast("int"), F.lit(0)
    parts = {"top": (none, none, w, y), "bottom": (none, h - y, w, h), "left": (none, none, x, h), "right": (w - x, none, w, h)}
    return F.array(*(F.struct(F.lit(s).alias("side"), _box(*p).alias("box")) for s, p in parts.items()))


# Proposals for a finer region of a crop, as shares of it, and how they come about.
PROPOSALS = (("right_band_roi", (0.42, 0.0, 1.0, 1.0), "right_58_percent_of_completeness_crop"), ("bottom_right_band_roi", (0.35, 0.22, 1.0, 1.0), "right_65_percent_lower_78_percent_of_completeness_crop"))
TABLE_PROPOSAL = ("table_line_right_roi", "right_table_cluster_from_line_projection")


def roi_proposals(width: Column, height: Column, table: Column, status: Column) -> Column:
    """Array of structs (roi_name, box, strategy, status): two of fixed shares, and what table lines fill (images.table_region), null if nothing."""
    fixed = [F.struct(F.lit(n).alias("roi_name"), fraction_box(width, height, *shares).alias("box"), F.lit(how).alias("strategy"), F.lit("fixed_ratio").alias("status")) for n, shares, how in PROPOSALS]
    name, how = TABLE_PROPOSAL
    return F.array(*fixed, F.struct(F.lit(name).alias("roi_name"), table.alias("box"), F.lit(how).alias("strategy"), status.alias("status")))


def area_change(old: Column, new: Column) -> Column:
    """Struct (area_ratio, area_reduction_ratio) of two boxes of pixels, to six digits; an empty old one counts as one pixel."""
    area = lambda b: F.greatest(b["xmax"] - b["xmin"], F.lit(0)) * F.greatest(b["ymax"] - b["ymin"], F.lit(0))
    ratio = F.bround(area(new) / F.greatest(area(old), F.lit(1)), 6)
    return F.struct(ratio.alias("area_ratio"), F.bround(1.0 - ratio, 6).alias("area_reduction_ratio"))


def first_box(*items: Column) -> Column:
    """The box of the first array that isn't empty or null; null if that one is none."""
    return box_of(F.coalesce(*(F.when(F.size(c) > 0, c) for c in items)))


def bottom_crop(width: Column, height: Column, lying: float = 0.30, standing: float = 0.35) -> Column:
    """The bottom strip of a page: struct (ratio, box)."""
    ratio = F.when(height > width, standing).otherwise(lying)
    return F.struct(ratio.alias("ratio"), _box(F.lit(0), F.floor(height * (1.0 - ratio)).cast("int"), width, height).alias("box"))
