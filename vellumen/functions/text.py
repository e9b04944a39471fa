"""Scalar text, number and path functions, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for "no number".
NO_NUMBER = ("", "unknown", "none", "null", "n/a", "无法确定", "不确定", "看不清", "无")
# File names that some systems reserve, and characters that they refuse.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))
ILLEGAL_IN_NAMES = r'[<>:"/\\|?*\x00-\x1f]'
BLANKS = r"(?U)\s+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def stripped(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def labels(*pairs: tuple[Column, str]) -> Column:
    """The labels whose conditions hold, in the given order; a null condition doesn't hold."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in pairs)), lambda x: x.isNotNull())


def sorted_unique(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """The table's value for a key, null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)


def safe_name(c: Column, default: str = "pdf") -> Column:
    """Letters, digits and -_. stay, all else becomes _; no . or _ at the ends."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}\-_.]", "_"), F.lit("._")), F.lit("")), F.lit(default))


def safe_id(c: Column, default: str = "model") -> Column:
    """safe_name in lower case, without dots."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\-_]", "_"), F.lit("_")), F.lit("")), F.lit(default))


def number_plain(c: Column) -> Column:
    """Without white space; what stands for no number, and null, is empty."""
    text = stripped(F.coalesce(c, F.lit("")))
    return F.when(F.lower(text).isin(*NO_NUMBER), F.lit("")).otherwise(F.regexp_replace(text, BLANKS, ""))


def number_folded(c: Column) -> Column:
    """In lower case, without white space."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), BLANKS, "")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def number_compatible(c: Column) -> Column:
    """In compatibility form and upper case, all dashes alike, without white space."""
    text = F.upper(stripped(nfkc(F.coalesce(c, F.lit("")))))
    return F.regexp_replace(F.regexp_replace(text, "[_—–－]", "-"), BLANKS, "")


def number_dashed(c: Column) -> Column:
    """Without white space, _ as -; case stays."""
    return F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, ""), F.lit("_"), F.lit("-"))


def number_plain_dashed(c: Column) -> Column:
    return F.replace(number_plain(c), F.lit("_"), F.lit("-"))


def filename_blockers(c: Column) -> Column:
    """Why a number can't be a file name; an array that is empty if it can."""
    n = number_plain(c)
    return F.when(n == "", F.array(F.lit("missing_drawing_number"))).otherwise(
        labels(
            (n.rlike(ILLEGAL_IN_NAMES), "drawing_number_has_illegal_filename_chars"),
            (n.endswith("."), "drawing_number_has_invalid_trailing_char"),
            (F.upper(n).isin(*RESERVED_NAMES), "drawing_number_is_windows_reserved_name"),
            (F.char_length(n) > 180, "drawing_number_too_long"),
        )
    )


def filename_stem(c: Column) -> Column:
    """The number, if it can be a file name; else null."""
    return F.when(F.size(filename_blockers(c)) == 0, number_plain(c))


def sanitized(c: Column, most: int = 120) -> Column:
    """Struct (name, risks): a name made fit for a file, null if nothing is left."""
    before = stripped(F.coalesce(c, F.lit("")))
    after = F.btrim(F.regexp_replace(F.regexp_replace(before, ILLEGAL_IN_NAMES, "_"), BLANKS, "_"), F.lit(" ._"))
    cut = F.rtrim(F.substring(after, 1, most), F.lit(" ._"))
    risks = labels((after != before, "filename_changed_by_sanitization"), (F.char_length(after) > most, "filename_truncated"))
    empty = F.lit(None).cast("string")
    found = F.when(F.coalesce(c, F.lit("")) == "", F.struct(empty.alias("name"), F.array(F.lit("drawing_number_missing")).alias("risks")))
    found = found.when(after == "", F.struct(empty.alias("name"), F.array(F.lit("filename_empty_after_sanitization")).alias("risks")))
    return found.otherwise(F.struct(F.when(F.char_length(after) > most, cut).otherwise(after).alias("name"), risks.alias("risks")))


def relative_path(path: Column, root: str) -> Column:
    """A path with / below a root, or as it is outside."""
    base = root.rstrip("/") + "/"
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 20)).otherwise(p)


def file_stem(path: Column) -> Column:
    """The file's name without its last suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def whole_number(c: Column) -> Column:
    """A number written with or without decimals, cut to a whole one; null if it's none."""
    return c.cast("string").try_cast("double").try_cast("int")


def right_angle(c: Column) -> Column:
    """0, 90, 180 or 270 of a number of degrees; null for null and empty, failing for others."""
    text = stripped(c.cast("string"))
    n = F.pmod(whole_number(text), F.lit(360))
    bad = F.raise_error(F.concat(F.lit("not a right angle: "), text)).cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("int")).when(n.isin(0, 90, 180, 270), n).otherwise(bad)


def correction(rotation: Column) -> Column:
    """Degrees that undo a rotation."""
    return F.pmod(F.lit(360) - rotation, F.lit(360))


def applied_rotation(target: Column, source: Column) -> Column:
    return F.pmod(target - source, F.lit(360))


def lines_joined(c: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), stripped), lambda x: x != ""), "\n")


def excerpt(c: Column, n: int) -> Column:
    return F.substring(stripped(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, " ")), 1, n)


def unique_items(*arrays: Column) -> Column:
    """Items that aren't null or empty, once each, as first seen."""
    return F.array_distinct(F.filter(F.concat(*arrays), lambda x: F.coalesce(x, F.lit("")) != ""))


def fallback_candidates(c: Column, pattern: str, most: int = 8) -> Column:
    """The first matches of a pattern in a text, once each."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))), 1, most)


def truth_text(c: Column) -> Column:
    return F.coalesce(F.lower(stripped(c.cast("string"))) == "true", F.lit(False))


def percent_after(c: Column, label: str, low: int = 0, high: int = 80) -> Column:
    """The share that a percentage after a label tells, between bounds; 0 without one."""
    n = F.regexp_extract(c, re.escape(label) + r"约?(\d{1,3})%", 1).try_cast("double")
    return F.coalesce(F.least(F.greatest(n, F.lit(float(low))), F.lit(float(high))) / 100, F.lit(0.0))


def labelled(codes: Column, names: Mapping[str, str], sep: str = ";") -> Column:
    """Codes as their names (or themselves), once each, joined."""
    return F.array_join(F.array_distinct(F.transform(codes, lambda c: F.coalesce(lookup(c, names), c))), sep)


def endpoint(base: Column) -> Column:
    """The chat address for a service's base address; fails on an empty one."""
    chat = "/chat/completions"
    url = F.regexp_replace(stripped(base), "/+$", "")
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    front = F.regexp_replace(url, r"[?#].*$", "")
    return (
        F.when(F.coalesce(url, F.lit("")) == "", F.raise_error(F.lit("the base address is empty")).cast("string"))
        .when(path.endswith(chat), url)
        .when(path.endswith("/compatible-mode/v1"), F.concat(url, F.lit(chat)))
        .when(path.endswith("/api/v1"), F.concat(F.regexp_replace(front, "/api/v1/*$", "/compatible-mode/v1" + chat), tail))
        .when(path == "", F.concat(F.regexp_replace(front, "/+$", ""), F.lit("/compatible-mode/v1" + chat), tail))
        .otherwise(F.concat(url, F.lit(chat)))
    )


def data_url(content: Column, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def request_row(kind: Column, model: Column, task: Column, prompt: Column, image: Column) -> Column:
    """A request as JSON, with the image's place in lieu of its content."""
    content = F.array(
        F.struct(F.lit("text").alias("type"), prompt.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")),
        F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.concat(F.lit("<omitted_png_data_url:"), image, F.lit(">")).alias("url")).alias("image_url")),
    )
    body = F.struct(
        model.alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"),
        F.lit(0).alias("temperature"),
        F.struct(F.lit("json_object").alias("type")).alias("response_format"),
        F.lit(False).alias("enable_thinking"),
    )
    return F.to_json(F.struct(F.concat_ws("__", kind, model, task).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/chat/completions").alias("url"), kind.alias("request_kind"), body.alias("body")))


# Answers that a reviewer's form may hold, and what they mean, for each form.
VERDICTS: dict[str, dict[str, tuple[str, ...]]] = {
    "number": {"correct": ("正确",), "incorrect": ("错误", "不正确", "有误"), "missing": ("未识别", "空白", "空", "无"), "uncertain": ("不确定", "看不清", "无法确认")},
    "roi": {"correct": ("正确",), "too_large": ("范围太大",), "too_small": ("范围太小",), "wrong_position": ("位置错误",), "unclear": ("看不清",)},
    "error_first": {"correct": ("正确", "对", "是", "ok", "yes", "true", "1"), "wrong": ("错误", "错", "否", "no", "false", "0")},
    "workbook": {"正确": ("正确", "对", "是", "ok", "OK", "right", "Right"), "错误": ("错误", "错", "否", "不正确", "wrong", "Wrong"), "不确定": ("不确定", "无法判断", "看不清", "存疑")},
    "retest": {"正确": ("正确", "对", "是", "ok", "OK"), "错误": ("错误", "错", "否", "不正确")},
    "mark": {"correct": ("正确", "对", "是", "ok", "yes", "true")},
    "rotation": {"confirmed": ("正确", "confirmed", "confirm", "ok", "yes", "y"), "corrected": ("错误", "corrected", "correction", "wrong", "no", "n")},
    "numbers_review": {"correct": ("正确", "对", "是", "ok", "yes", "true", "1"), "incorrect": ("错误", "錯誤", "错", "否", "不正确", "no", "false", "0")},
}
# Forms whose answers count in any case, those that keep unknown answers as they are, and what a blank one is.
FOLDED = ("error_first", "mark", "rotation", "numbers_review")
AS_IS = ("workbook", "retest", "rotation")
BLANK = {"workbook": "空白", "retest": "", "rotation": "", "numbers_review": "unreviewed_or_unknown"}
OTHER = {"mark": "problem", "numbers_review": "unreviewed_or_unknown"}


def verdict(c: Column, form: str, *, strict: bool = False) -> Column:
    """A reviewer's answer in the standard words of a form; strict fails on unknown answers."""
    text = stripped(F.coalesce(c, F.lit("")))
    text = F.lower(text) if form in FOLDED else text
    known = lookup(text, {answer: name for name, answers in VERDICTS[form].items() for answer in answers})
    if form == "numbers_review":  # a sentence that says so
        known = F.coalesce(known, F.when(text.contains("正确") & ~text.contains("不正确"), "correct").when(text.contains("错误"), "incorrect"))
    rest = F.raise_error(F.concat(F.lit("unknown answer: "), text)).cast("string") if strict else text if form in AS_IS else F.lit(OTHER.get(form, "other"))
    return F.when(text == "", F.lit(BLANK.get(form, "blank"))).when(known.isNotNull(), known).otherwise(rest)


# Exact positions on a form, and the coarse ones; rotation of the coarse ones and of all codes.
COARSE = {"下方": "bottom", "右下方": "bottom", "左侧": "left", "左方": "left", "上方": "top", "左上方": "top", "右侧": "right", "右方": "right", "右上方": "right", "bottom": "bottom", "left": "left", "top": "top", "right": "right"}
GROUPS = {"bottom_edge": 0, "bottom_right": 0, "bottom": 0, "bottom_left": 90, "left_edge": 90, "left": 90, "top_left": 180, "top_edge": 180, "top": 180, "top_right": 270, "right_edge": 270, "right": 270}


def coarse_position(c: Column) -> Column:
    """The coarse position; fails on an unknown one."""
    text = stripped(c)
    return F.coalesce(lookup(text, COARSE), F.raise_error(F.concat(F.lit("unknown position: "), F.coalesce(text, F.lit("")))).cast("string"))


def rotation_group(c: Column) -> Column:
    """The rotation that a position's code stands for; null for others."""
    return lookup(stripped(c), GROUPS)


def explicit_rotation(given: Column, coarse: Column) -> Column:
    """The rotation that a form gives, else that of the position."""
    return F.coalesce(whole_number(F.nullif(stripped(given), F.lit(""))), lookup(coarse, GROUPS))


def label_matches(label: Column, code: Column, expected: Column, codes: Mapping[str, str]) -> Column:
    """Whether what is expected is the label, its code, or names a label of that code."""
    text = stripped(F.coalesce(expected, F.lit("")))
    return (text != "") & F.coalesce((text == label) | (text == code), F.lit(False)) | F.coalesce(lookup(text, codes) == code, F.lit(False))


def no_title(c: Column) -> Column:
    """Whether a note says that there is no title block."""
    return F.coalesce(c.contains("没有标题栏") | c.contains("无标题栏") | c.contains("只有零件表格"), F.lit(False))


def sample_of_result(c: Column) -> Column:
    """The sample's name in a result's file name: augmented ones whole, others sample_ and number; fails on others."""
    stem, number = file_stem(c), F.regexp_extract(c, r"sample_(\d+)", 1)
    bad = F.raise_error(F.concat(F.lit("no sample in "), c)).cast("string")
    return F.when(stem.startswith("aug90_"), stem).when(number != "", F.concat(F.lit("sample_"), number)).otherwise(bad)


def sample_of_stage(c: Column) -> Column:
    """The sample's name in a first stage's file name: what precedes it stays, but for what ends in two underscores."""
    stem = file_stem(c)
    front, tail = F.regexp_extract(stem, r"^(.*?)_sample_(.*)$", 1), F.regexp_extract(stem, r"^(.*?)_sample_(.*)$", 2)
    own = F.regexp_replace(front, r"^.*__", "")
    return F.when(stem.contains("_sample_"), F.concat(own, F.lit("_sample_"), tail)).when(stem.contains("sample_"), F.regexp_extract(stem, r"(sample_.*)$", 1)).otherwise(stem)


def task_kind(c: Column) -> Column:
    return (
        F.when(c.contains("mcp_correction"), "mcp_corrected_opencv")
        .when(c.contains("low_confidence"), "confidence_calibration")
        .when(c.contains("rejected_candidate"), "non_title_table_false_positive")
        .when(c.contains("sample_040"), "small_angle_offset_tolerated")
        .otherwise("hardcase_positive")
    )


def task_sample(c: Column) -> Column:
    """The sample's name in a task's id."""
    found = c
    for name in ("unclear90_", "aug90_", "sample_"):
        mark = f"__{name}"
        tail = F.regexp_replace(F.substr(c, F.locate(mark, c) + len(mark)), "__candidate_.*$", "")
        found = F.when(c.contains(mark), F.concat(F.lit(name), tail)).otherwise(found)
    return found


def source_level(basis: Column) -> Column:
    """Struct (level, verified) of what a truth is based on."""
    level = F.when(basis.startswith("manual_review"), "manual_review").when(basis == "opencv_mcp_consensus_accepted", "consensus_accepted").otherwise("unknown")
    return F.struct(level.alias("level"), (level == "manual_review").alias("verified"))


def note_tags(note: Column, judgment: Column) -> Column:
    """Struct (tags, suggestions) of a reviewer's note on a region."""
    text = stripped(F.coalesce(note, F.lit("")))
    has = text.contains
    top = has("上侧") | has("上部") | has("上边")
    left, right = has("左侧"), has("向右")
    blurred = has("模糊")
    blue = has("蓝色") & has("更好")
    percents = F.regexp_extract_all(text, F.lit(r"(\d{1,3})\s*%"), F.lit(1))
    first = F.get(percents, 0)
    tags = labels(
        ((judgment == "范围太大") | has("太大"), "roi_too_large"),
        (has("范围太小"), "roi_too_small"),
        (has("位置错误"), "roi_wrong_position"),
        (blue, "prefer_bottom_right_blue_roi"),
        (top, "trim_top"),
        (left, "trim_left"),
        (right, "shift_or_trim_left_toward_right"),
        (blurred, "drawing_number_blurry"),
        (has("人工识别"), "requires_manual_identification"),
    )
    by = lambda what, plain: F.when(first.isNotNull(), F.concat(F.lit(what), first, F.lit("%"))).otherwise(F.lit(plain))
    told = F.array(
        F.when(blue, F.lit("优先评估蓝框右下区域候选")),
        F.when(top, by("上侧减少约", "上侧适度收窄")),
        F.when(left | right, by("左侧向右减少约", "左侧向右适度收窄")),
        F.when(blurred, F.lit("图号模糊样本保留人工识别或 VLM 兜底")),
    )
    return F.struct(sorted_unique(tags, F.transform(percents, lambda p: F.concat(F.lit("percent_"), p))).alias("tags"), F.array_distinct(F.filter(told, lambda x: x.isNotNull())).alias("suggestions"))
