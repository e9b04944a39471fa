"""Model answers: finding, parsing, checking and turning them into decisions."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumen.functions.text import NO_NUMBER, filename_blockers, filename_stem, labels, lookup, number_folded, number_plain, sorted_unique, stripped

VERSION = "page-records-1"
# Short names of positions, and the current and the correcting rotation of each position.
ALIASES = {"bottom": "bottom_edge", "top": "top_edge", "left": "left_edge", "right": "right_edge"}
ROTATIONS: dict[str, tuple[int | None, int | None]] = {
    "bottom_edge": (0, 0),
    "bottom_right": (0, 0),
    "bottom_left": (90, 270),
    "left_edge": (90, 270),
    "top_left": (180, 180),
    "top_edge": (180, 180),
    "top_right": (270, 90),
    "right_edge": (270, 90),
    "no_title_block": (None, None),
    "unknown": (None, None),
}


def kind(v: Column) -> Column:
    """Kind of a variant: OBJECT, ARRAY, STRING, NUMBER, BOOLEAN, VOID; null where there is none."""
    name = F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    return F.when(name.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT"), "NUMBER").otherwise(name)


def at(v: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(v, path, as_type)


def is_kind(v: Column, name: str) -> Column:
    return F.coalesce(kind(v) == name, F.lit(False))


def _none_of(value):
    """JSON without what isn't JSON elsewhere: NaN and infinities become null."""
    if isinstance(value, dict):
        return {k: _none_of(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_none_of(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def found_json(text: str) -> tuple[bool, object]:
    """(True, what a text is as JSON, as fenced JSON, or by the object in it), or (False, None)."""
    text = text.strip()
    tries = [text]
    if text.startswith("```"):
        inner = text.strip("`").strip()
        tries.append(inner[4:].strip() if inner[:4].lower() == "json" else inner)
    opens, closes = text.find("{"), text.rfind("}")
    if 0 <= opens < closes:
        tries.append(text[opens : closes + 1])
    for t in tries:
        try:
            return True, _none_of(json.loads(t))
        except (ValueError, RecursionError):
            continue
    return False, None


def _loosely(text: str | None) -> str | None:
    """Canonical JSON of what a text holds; null if nothing."""
    there, value = (False, None) if text is None else found_json(text)
    return json.dumps(value, ensure_ascii=False) if there else None


@F.pandas_udf(T.StringType())
def loose_json(s: pd.Series) -> pd.Series:
    """Repeated keys keep the last value, which the built-in parser refuses."""
    return s.map(_loosely, na_action="ignore")


# What is read from an answer: column of its kind, column of its value, and the value's type.
READ = (("position", "title_block_position", "STRING"), ("selected", "selected_drawing_number", "STRING"), ("confidence", "confidence", "NUMBER"), ("evidence", "evidence", "ARRAY"), ("review", "needs_human_review", "BOOLEAN"), ("reasons", "review_reasons", "ARRAY"), ("candidates", "candidates", "ARRAY"))
ARROW = {"STRING": pa.string(), "NUMBER": pa.float64(), "BOOLEAN": pa.bool_(), "ARRAY": pa.list_(pa.string())}
SPARK = {"STRING": T.StringType(), "NUMBER": T.DoubleType(), "BOOLEAN": T.BooleanType(), "ARRAY": T.ArrayType(T.StringType())}
ANSWER = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("content", "content_error", "json")]
    + [T.StructField(n, T.BooleanType()) for n in ("object", "empty")]
    + [f for n, _, k in READ for f in (T.StructField(f"{n}_kind", T.StringType()), T.StructField(n, SPARK[k]))]
)


def content_of(response: str | None) -> tuple[str, str | None]:
    """(text of a chat response's first message, None), or an empty text and what is wrong."""
    try:
        body = json.loads(response) if response is not None else None
    except ValueError:
        body = None
    for step, what, code in (("choices", list, "missing_choices"), (0, dict, "choice_not_object"), ("message", dict, "missing_message")):
        if step == "choices" and not isinstance(body, dict):
            return "", "response_not_json_object"
        body = body.get(step) if isinstance(body, dict) else body[0]
        if not isinstance(body, what) or (what is list and not body):
            return "", code
    content = body.get("content")
    if isinstance(content, list):
        texts = [p["text"] for p in content if isinstance(p, dict) and isinstance(p.get("text"), str)]
        content = "\n".join(texts) if texts else None
    return (content, None) if isinstance(content, str) else ("", "missing_message_content")


def _kind(value) -> str:
    if isinstance(value, bool):
        return "BOOLEAN"
    return "STRING" if isinstance(value, str) else "NUMBER" if isinstance(value, (int, float)) else "ARRAY" if isinstance(value, list) else "OBJECT" if isinstance(value, dict) else "VOID"


def flattened(answer) -> dict:
    """An answer's fields, from its flat or its nested shape; none of what isn't an object."""
    if not isinstance(answer, dict):
        return {}
    inner = answer.get("page_orientation")
    if not isinstance(inner, dict):
        return answer
    gate = answer.get("quality_gate")
    gate = gate if isinstance(gate, dict) else {}
    return {**{k: inner.get(k) for k in ("title_block_position", "confidence", "evidence")}, **{k: gate.get(k) for k in ("needs_human_review", "review_reasons")}}


@F.arrow_udf(ANSWER)
def read_answer(response: pa.Array) -> pa.Array:
    """The content of a chat response and the fields of the answer in it, each with its kind, null where it isn't there."""
    columns: dict[str, list] = {n: [] for n in ANSWER.names}
    for text in response.to_pylist():
        content, error = content_of(text)
        there, value = found_json(content) if error is None and content.strip() else (False, None)
        fields = flattened(value)
        row = {"content": content, "content_error": error, "json": json.dumps(value, ensure_ascii=False) if there else None, "object": isinstance(value, dict), "empty": not fields}
        for name, key, what in READ:
            item, kind_ = fields.get(key), _kind(fields.get(key)) if key in fields else None
            row[f"{name}_kind"] = kind_
            row[name] = ([x for x in item if isinstance(x, str) and x] if what == "ARRAY" else float(item) if what == "NUMBER" else item) if kind_ == what else None
        for name, cell in row.items():
            columns[name].append(cell)
    kinds = {n: ARROW[k] for n, _, k in READ}
    arrays = [pa.array(v, kinds.get(n, pa.bool_() if n in ("object", "empty") else pa.string())) for n, v in columns.items()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))


def position(c: Column) -> Column:
    text = F.nullif(stripped(c), F.lit(""))
    return F.coalesce(lookup(text, ALIASES), text)


def rotation(pos: Column) -> Column:
    """Struct (current, correction, error) of a position."""
    current = lookup(pos, {k: v[0] for k, v in ROTATIONS.items() if v[0] is not None})
    undo = lookup(pos, {k: v[1] for k, v in ROTATIONS.items() if v[1] is not None})
    error = F.when(pos.isNull(), "missing_title_block_position_for_rotation").when(current.isNull(), "unknown_title_block_position_for_rotation")
    return F.struct(current.cast("int").alias("current"), undo.cast("int").alias("correction"), error.alias("error"))


def share(v: Column) -> Column:
    """Whether a variant is a number from 0 to 1; true and false are no numbers."""
    return is_kind(v, "NUMBER") & F.coalesce(at(v, "$", "double").between(0, 1), F.lit(False))


def field_errors(answer: Column, spec: list[tuple[str, str, str]]) -> Column:
    """Codes for fields of a read answer that aren't of their kind: spec has (field, kind, code)."""
    checks = []
    for name, what, code in spec:
        good = (answer[f"{name}_kind"] == "NUMBER") & answer[name].between(0, 1) if what == "SHARE" else answer[f"{name}_kind"] == what
        checks.append((~F.coalesce(good, F.lit(False)), code))
    return labels(*checks)


ORIENTATION = [("confidence", "SHARE", "invalid_confidence"), ("evidence", "ARRAY", "evidence_not_list"), ("review", "BOOLEAN", "needs_human_review_not_bool"), ("reasons", "ARRAY", "review_reasons_not_list")]
NUMBER = [
    ("selected", "STRING", "selected_drawing_number_not_string"),
    ("candidates", "ARRAY", "candidates_not_list"),
    ("confidence", "SHARE", "invalid_drawing_number_confidence"),
    ("evidence", "ARRAY", "drawing_number_evidence_not_list"),
    ("review", "BOOLEAN", "drawing_number_needs_human_review_not_bool"),
    ("reasons", "ARRAY", "drawing_number_review_reasons_not_list"),
]


def orientation_errors(answer: Column) -> Column:
    """Codes for what is wrong with a read orientation answer; an empty or missing object is one error."""
    known = F.coalesce(position(answer["position"]).isin(*ROTATIONS), F.lit(False))
    return F.when(answer["empty"], F.array(F.lit("decision_not_object"))).otherwise(F.concat(labels((~known, "invalid_title_block_position")), field_errors(answer, ORIENTATION)))


def number_errors(answer: Column) -> Column:
    return F.when(~answer["object"], F.array(F.lit("drawing_number_response_not_object"))).otherwise(field_errors(answer, NUMBER))


# What a teacher's answer and each of its judgments must hold, and the values it may give.
TEACHER_FIELDS = ("task_id", "selected_candidate_index", "title_block_position", "rotation_degrees", "candidate_judgments", "needs_human_review", "confidence")
JUDGMENT_FIELDS = ("candidate_index", "field_cluster_strength", "is_true_title_block", "layout_evidence", "ordinary_table_false_positive_risk", "reject_reasons_if_not_title_block", "touches_drawing_frame")
TEACHER_POSITIONS = ("bottom", "left", "top", "right", "unknown")
TEACHER_ROTATIONS = (0, 90, 180, 270)


def missing_fields(obj: Column, names: tuple[str, ...], code: str) -> Column:
    """Codes for fields that an object doesn't have; a field that is null is there."""
    return labels(*((at(obj, f"$.{n}").isNull(), f"{code}{n}") for n in names))


def blank_field(v: Column) -> Column:
    return v.isNull() | is_kind(v, "VOID")


def teacher_errors(obj: Column, task: Column) -> Column:
    """Codes for a teacher's answer to a task. Here true and false pass as a confidence, and each judgment needs its fields."""
    confidence, rotation_, pos, own = (at(obj, f"$.{n}") for n in ("confidence", "rotation_degrees", "title_block_position", "task_id"))
    judgments = F.coalesce(at(obj, "$.candidate_judgments", "array<variant>"), F.array().cast("array<variant>"))
    numbered = F.zip_with(judgments, F.sequence(F.lit(0), F.greatest(F.size(judgments) - 1, F.lit(0))), lambda j, i: F.struct(j.alias("j"), i.alias("i")))

    def judged(x: Column) -> Column:
        head = F.concat(F.lit("candidate_judgment_"), x["i"].cast("string"), F.lit(":"))
        codes = F.when(~is_kind(x["j"], "OBJECT"), F.array(F.lit("not_object"))).otherwise(missing_fields(x["j"], JUDGMENT_FIELDS, "missing_required:"))
        return F.transform(codes, lambda c: F.concat(head, c))

    none = F.size(judgments) == 0
    number = F.coalesce(at(confidence, "$", "double"), F.lit(-1.0))
    empty = ~is_kind(obj, "OBJECT") | (F.to_json(obj) == "{}")
    return F.when(empty, F.array(F.lit("missing_or_empty_parsed_response"))).otherwise(
        F.concat(
            missing_fields(obj, TEACHER_FIELDS, "missing_required:"),
            labels(
                (~blank_field(own) & ~F.coalesce((at(own, "$", "string") == task) | (at(own, "$", "string") == ""), F.lit(False)), "task_id_mismatch"),
                (~blank_field(pos) & ~F.coalesce(at(pos, "$", "string").isin(*TEACHER_POSITIONS), F.lit(False)), "invalid_title_block_position"),
                (~(is_kind(rotation_, "NUMBER") & F.coalesce(at(rotation_, "$", "double").isin(*TEACHER_ROTATIONS), F.lit(False))), "invalid_rotation_degrees"),
                (~(is_kind(confidence, "BOOLEAN") | (is_kind(confidence, "NUMBER") & number.between(0, 1))), "invalid_confidence"),
                (none, "missing_candidate_judgments"),
            ),
            F.when(none, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(numbered, judged))),
        )
    )


# The sections of the combined answer, their fields with their kinds, and the codes.
SECTIONS = {
    "page_orientation": (("title_block_position", "POSITION", "invalid_title_block_position"), ("confidence", "SHARE", "invalid_confidence"), ("evidence", "ARRAY", "evidence_not_list")),
    "drawing_number": (("candidates", "STRINGS", "invalid_candidates"), ("selected", "STRING", "selected_not_string"), ("confidence", "SHARE", "invalid_confidence"), ("evidence", "ARRAY", "evidence_not_list")),
    "quality_gate": (("needs_human_review", "BOOLEAN", "needs_human_review_not_bool"), ("review_reasons", "STRINGS", "invalid_review_reasons")),
}


def nested_errors(obj: Column, positions: tuple[str, ...] = tuple(ROTATIONS)) -> Column:
    """Codes for the combined answer: sections, their fields and their kinds."""
    def good(v: Column, what: str) -> Column:
        if what == "SHARE":
            return share(v)
        if what == "POSITION":
            return is_kind(v, "STRING") & F.coalesce(at(v, "$", "string").isin(*positions), F.lit(False))
        if what == "STRINGS":
            items = F.coalesce(at(v, "$", "array<variant>"), F.array().cast("array<variant>"))
            return is_kind(v, "ARRAY") & ~F.exists(items, lambda x: ~is_kind(x, "STRING"))
        return is_kind(v, what)

    parts = [missing_fields(obj, tuple(SECTIONS), "missing_required:")]
    for section, spec in SECTIONS.items():
        part = at(obj, f"$.{section}")
        inside = F.concat(missing_fields(part, tuple(n for n, _, _ in spec), f"{section}:missing_required:"), labels(*((~good(at(part, f"$.{n}"), what), f"{section}:{code}") for n, what, code in spec)))
        parts.append(F.when(is_kind(part, "OBJECT"), inside).otherwise(F.array(F.lit(f"{section}:not_object"))))
    return F.when(~is_kind(obj, "OBJECT"), F.array(F.lit("decision_not_object"))).otherwise(F.concat(*parts))


def _parsed(raw: DataFrame) -> DataFrame:
    """Adds _a, the read answer, and _parse_error. A response is read once."""
    a = F.col("_a")
    fine = a["content_error"].isNull()
    error = F.when(fine & (stripped(a["content"]) == ""), "empty_message_content").when(fine & a["json"].isNull(), "content_json_parse_failed")
    return raw.withColumn("_a", read_answer(F.col("response_json"))).withColumn("_parse_error", error)


def _failure(prefix: str) -> Column:
    status = F.coalesce(F.nullif(F.col("error_type"), F.lit("")), F.col("http_status").cast("string"), F.lit("None"))
    return F.when(~F.coalesce(F.col("ok"), F.lit(False)), F.concat(F.lit(prefix), status))


def _some(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _prefixed(prefix: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(prefix), x))


BASE = ("task_id", "source_pdf", "page_number", "model")


def orientation_decisions(raw: DataFrame, keep: tuple[str, ...] = (), *, number: bool = False) -> DataFrame:
    """A decision for each raw response, with sorted reasons for review; any reason asks for one.

    keep: more columns of the responses, such as a model's variant and settings. number: an
    answer whose drawing number is missing or unknown is to be reviewed, too.
    """
    a, none = F.col("_a"), F.array().cast("array<string>")
    rows = _parsed(raw).withColumn("title_block_position", position(a["position"]))
    turn = rotation(F.col("title_block_position"))
    schema = F.when(a["json"].isNotNull(), orientation_errors(a)).otherwise(none)
    rows = rows.select("*", turn.alias("_r"), schema.alias("_schema"))
    named = number_folded(F.get_json_object(a["json"], "$.drawing_number.selected"))
    unknown = F.when(F.lit(number) & named.isin(*(n for n in NO_NUMBER if n != "无")), F.lit("drawing_number_missing_or_unknown"))
    reasons = sorted_unique(_some(_failure("api_error:"), a["content_error"], F.col("_parse_error"), F.col("_r.error"), F.when(a["review"], F.lit("model_marked_needs_human_review")), unknown), F.col("_schema"), _prefixed("model:", F.coalesce(a["reasons"], none)))
    ok = a["json"].isNotNull()
    return rows.withColumn("review_reasons", reasons).select(
        F.lit(VERSION).alias("record_version"),
        *BASE,
        *keep,
        F.coalesce(F.col("ok"), F.lit(False)).alias("api_ok"),
        "http_status",
        "attempt_count",
        F.when(ok, "ok").otherwise("error").alias("parse_status"),
        F.when(ok & (F.size("_schema") == 0), "ok").otherwise("error").alias("schema_status"),
        "title_block_position",
        F.col("_r.current").alias("current_clockwise_degrees"),
        F.col("_r.correction").alias("correction_clockwise_degrees"),
        a["confidence"].alias("confidence"),
        a["review"].alias("model_needs_human_review"),
        (F.size("review_reasons") > 0).alias("needs_review"),
        "review_reasons",
        F.coalesce(a["evidence"], none).alias("evidence"),
        F.coalesce("error_type", F.lit("")).alias("error_type"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.when(a["object"], a["json"]).otherwise("{}").alias("parsed_response"),
    )


def number_decisions(raw: DataFrame, *, lenient: bool = False, fallback_pattern: str | None = None) -> DataFrame:
    """Like orientation_decisions(), for drawing numbers; a number that can't be a file name asks for review.

    lenient: any schema error is the one code schema_error. fallback_pattern: candidates from
    the message's text where it isn't JSON.
    """
    from vellumen.functions.text import fallback_candidates

    a, none = F.col("_a"), F.array().cast("array<string>")
    found = number_errors(a)
    if lenient:
        found = F.when(F.size(found) > 0, F.array(F.lit("schema_error"))).otherwise(none)
    schema = F.when(a["json"].isNotNull(), found).otherwise(none)
    rows = _parsed(raw).select("*", schema.alias("_schema"), number_plain(a["selected"]).alias("selected_drawing_number"))
    reasons = sorted_unique(
        _some(_failure("drawing_number_api_error:"), a["content_error"], F.col("_parse_error"), F.when(a["review"], F.lit("drawing_number_model_marked_needs_human_review"))),
        F.col("_schema"),
        filename_blockers(F.col("selected_drawing_number")),
        _prefixed("drawing_number_model:", F.coalesce(a["reasons"], none)),
    )
    candidates = F.filter(F.transform(F.coalesce(a["candidates"], none), number_plain), lambda x: x != "")
    if fallback_pattern is not None:
        candidates = F.when(a["json"].isNull(), fallback_candidates(a["content"], fallback_pattern)).otherwise(candidates)
    ok = a["json"].isNotNull()
    return rows.withColumn("review_reasons", reasons).select(
        F.lit(VERSION).alias("record_version"),
        *BASE,
        F.coalesce(F.col("ok"), F.lit(False)).alias("api_ok"),
        "http_status",
        "attempt_count",
        F.when(ok, "ok").otherwise("error").alias("parse_status"),
        F.when(ok & (F.size("_schema") == 0), "ok").otherwise("error").alias("schema_status"),
        "selected_drawing_number",
        F.coalesce(filename_stem(F.col("selected_drawing_number")), F.lit("")).alias("final_filename_stem"),
        candidates.alias("candidates"),
        a["confidence"].alias("confidence"),
        a["review"].alias("model_needs_human_review"),
        (F.size("review_reasons") > 0).alias("needs_review"),
        "review_reasons",
        F.coalesce(a["evidence"], none).alias("evidence"),
        F.coalesce("error_type", F.lit("")).alias("error_type"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.when(a["object"], a["json"]).otherwise("{}").alias("parsed_response"),
    )


def public_raw(raw: DataFrame) -> DataFrame:
    """Raw responses as they are kept: the text only where there is no JSON."""
    text = F.when(F.col("response_json").isNull(), F.col("response_text")).otherwise("")
    return raw.select(F.lit(VERSION).alias("record_version"), *BASE, F.coalesce("request_kind", F.lit("")).alias("request_kind"), "endpoint", "ok", "http_status", "attempt_count", F.coalesce("error_type", F.lit("")).alias("error_type"), F.coalesce("error_message", F.lit("")).alias("error_message"), "response_json", text.alias("response_text"))
