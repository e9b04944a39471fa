"""From pages and recorded answers to decisions, gates, a report and a summary.

Rendering, turning and model calls are providers; the default provider replays recorded
responses. What they give should be written before it is used twice, so that no call repeats.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumen.functions.answers import number_decisions, orientation_decisions
from vellumen.functions.text import file_stem, labels, sorted_unique
from vellumen.operators.metrics import run_summary
from vellumen.operators.rank import duplicates, kept
from vellumen.operators.relate import last_wins, left_default
from vellumen.plans.rules import all_failed, rotation_blockers

RAW = "task_id string, source_pdf string, page_number int, model string, request_kind string, endpoint string, ok boolean, http_status string, attempt_count int, error_type string, error_message string, response_json string, response_text string"


class Provider(Protocol):
    """Gives raw responses for requests (task_id, source_pdf, page_number, model, request_kind)."""

    def responses(self, requests: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Replay:
    """Recorded responses; a request without one failed with error type not_recorded."""

    recorded: DataFrame

    def responses(self, requests: DataFrame) -> DataFrame:
        keys = ["task_id", "model", "request_kind"]
        fields = ["endpoint", "ok", "http_status", "attempt_count", "error_type", "error_message", "response_json", "response_text"]
        side = last_wins(self.recorded, keys, ["attempt_count", "response_json"]).select(*keys, *fields)
        missing = {"endpoint": None, "ok": False, "http_status": None, "attempt_count": 0, "error_type": "not_recorded", "error_message": "", "response_json": None, "response_text": ""}
        return left_default(requests, side, keys, missing, None)


@dataclass(frozen=True)
class DryRun:
    """Fails every request as a dry run."""

    def responses(self, requests: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        return requests.select("*", none.alias("endpoint"), F.lit(False).alias("ok"), none.alias("http_status"), F.lit(0).alias("attempt_count"), F.lit("dry_run").alias("error_type"), F.lit("").alias("error_message"), none.alias("response_json"), F.lit("").alias("response_text"))


#: Answers of a service that are worth another try.
RETRY = (408, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Calls:
    """Calls a function a request, in batches on the workers, trying again on passing failures.

    call(row) gives (http_status, response_json or None, response_text); what it raises is an
    error of the type of the exception's name.
    """

    call: Callable[[dict], tuple[int, str | None, str]]
    attempts: int = 3
    #: Seconds to wait before the second try, and as many times as long before each further one.
    wait: float = 1.0

    def responses(self, requests: DataFrame) -> DataFrame:
        names = [f.split()[0] for f in RAW.split(", ")]
        call, attempts, wait = self.call, self.attempts, self.wait

        def one(row: dict) -> dict:
            for attempt in range(1, attempts + 1):
                try:
                    status, body, text = call(row)
                    good = 200 <= status < 300
                    out = {"ok": good, "http_status": str(status), "error_type": "" if good else "http_error", "error_message": "" if good else text[:500], "response_json": body, "response_text": text}
                    again = status in RETRY
                except Exception as e:  # noqa: BLE001  whatever a provider raises is that request's failure
                    out = {"ok": False, "http_status": None, "error_type": type(e).__name__, "error_message": str(e)[:500], "response_json": None, "response_text": ""}
                    again = isinstance(e, (TimeoutError, ConnectionError))
                if out["ok"] or not again or attempt == attempts:
                    break
                time.sleep(wait * attempt)
            return {**{n: row.get(n) for n in names}, **out, "attempt_count": attempt}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([one(r) for r in batch.to_dict("records")], columns=names)

        return requests.mapInPandas(run, RAW)


@dataclass(frozen=True)
class Ladder:
    """Providers in turn: each gets the requests that those before it failed; the last answer stays.

    Each provider's answers are kept, so that no call repeats.
    """

    providers: Sequence[Provider]

    def responses(self, requests: DataFrame) -> DataFrame:
        names, rest, out = requests.columns, requests, None
        for i, provider in enumerate(self.providers):
            got = kept(provider.responses(rest))
            last = i == len(self.providers) - 1
            part = got if last else got.where("ok")
            out = part if out is None else out.unionByName(part)
            rest = got.where("NOT ok").select(*names)
        if out is None:
            raise ValueError("no provider")
        return out


@dataclass(frozen=True)
class Recogniser:
    """Recognition of text on page images, with engines that each worker makes once.

    engine() gives a function from (pixels, width, height, angle) to (text, average confidence).
    An engine that can't be made, or fails on a page, leaves it to the next of the fallbacks.
    """

    engine: Callable[[], Callable[[bytes, int, int, int], tuple[str, float]]]
    fallbacks: tuple[Callable[[], Callable[[bytes, int, int, int], tuple[str, float]]], ...] = ()

    def texts(self, pages: DataFrame) -> DataFrame:
        """(task_id, angle, text, confidence, status, engine) for pages (task_id, width, height, pixels, angles); engine is the number of the one that answered."""
        makers = (self.engine, *self.fallbacks)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            engines: dict[int, Callable] = {}
            broken: dict[int, str] = {}  # engines that can't be made here, and why

            def recognised(r, angle: int) -> tuple[str, float, str, int | None]:
                why = "error:none"
                for i, make in enumerate(makers):
                    if i in broken:
                        why = broken[i]
                        continue
                    try:
                        if i not in engines:
                            engines[i] = make()
                    except Exception as e:  # noqa: BLE001  a missing library, say, is the next engine's turn
                        broken[i] = why = f"error:{type(e).__name__}"
                        continue
                    try:
                        found, sure = engines[i](r.pixels, r.width, r.height, angle)
                        return found, float(sure), "ok", i
                    except Exception as e:  # noqa: BLE001  one page's failure is that page's status
                        why = f"error:{type(e).__name__}"
                return "", 0.0, why, None

            for batch in batches:
                rows = [(r.task_id, int(angle), *recognised(r, int(angle))) for r in batch.itertuples() for angle in r.angles]
                yield pd.DataFrame(rows, columns=["task_id", "angle", "text", "confidence", "status", "engine"]).astype({"engine": "Int32"})

        return pages.mapInPandas(run, "task_id string, angle int, text string, confidence double, status string, engine int")

    def best(self, pages: DataFrame) -> DataFrame:
        """The best angle's text for each page: by fields first, then confidence and length; the first of equals."""
        from vellumen.functions import numbers

        text_ = F.col("text")
        ranked = self.texts(pages).withColumn("rank", numbers.recognition_rank(numbers.field_hits(text_, numbers.ROLES), numbers.field_hits(text_, numbers.PROPERTIES), F.col("confidence"), text_))
        return last_wins(ranked, ["task_id"], ["rank", (-F.col("angle")).alias("a")])


def failed_keys(decisions: DataFrame, keys: Sequence[str] = ("task_id", "model")) -> DataFrame:
    """Keys of decisions of which not all of call, parsing and form went well."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return decisions.where(no(F.col("api_ok")) | no(F.col("parse_status") == "ok") | no(F.col("schema_status") == "ok")).select(*keys).distinct()


def pending(requests: DataFrame, done: DataFrame, keys: Sequence[str] = ("task_id", "model", "request_kind")) -> DataFrame:
    """Requests that have no good response yet."""
    return requests.join(done.where("ok").select(*keys), list(keys), "left_anti")


def rotation_outputs(pages: DataFrame, decisions: DataFrame, dry_run: bool = False) -> DataFrame:
    """For each page whether and how far it is turned, and what holds it back."""
    side = last_wins(decisions, ["task_id"], ["model", "http_status", "attempt_count"]).select("task_id", "api_ok", "parse_status", "schema_status", "correction_clockwise_degrees")
    joined = pages.join(side, "task_id", "left")
    blockers = rotation_blockers(dry_run, F.col("api_ok"), F.col("parse_status"), F.col("schema_status"), F.col("correction_clockwise_degrees"))
    rows = joined.withColumn("output_blockers", blockers).withColumn("needs_review", F.size("output_blockers") > 0)
    return rows.select(
        "task_id",
        "source_pdf",
        "page_number",
        "output_pdf_path",
        F.when(F.col("needs_review"), "copied_needs_review").otherwise("corrected").alias("output_status"),
        F.when(F.col("needs_review"), 0).otherwise(F.col("correction_clockwise_degrees")).alias("applied_pdf_rotate_clockwise"),
        "needs_review",
        "output_blockers",
    )


def assembled(pages: DataFrame, **sides: DataFrame) -> DataFrame:
    """A row for each page (task_id is its key) with a column for each side: the side's last row with its task_id as a struct, or null.

    All sides meet in one aggregation by task_id. A side's last row is that with the greatest
    model, http_status and attempt_count, of those that it has, and then by all its columns.
    """
    order = ["model", "http_status", "attempt_count"]
    tagged = pages.select("task_id", F.struct("*").alias("page"))
    for name, rows in sides.items():
        first = [c for c in order if c in rows.columns]
        row = F.struct(*first, *(c for c in rows.columns if c not in first))
        tagged = tagged.unionByName(rows.select("task_id", row.alias(name)), allowMissingColumns=True)
    one = tagged.groupBy("task_id").agg(*(F.max(n).alias(n) for n in ("page", *sides)))
    return one.where("page IS NOT NULL").select("page.*", *sides)


def finished(rows: DataFrame, numbers: DataFrame, output_dir: str, dry_run: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """Rows of assembled() with decision, output and number: what is published under which name, and what goes to review and why.

    A name counts as taken within its source if two numbers of it have that name. existing:
    (output_pdf_path) of the turned pages that are there; None takes them as there.
    """
    named = numbers.withColumn("_stem", file_stem(F.coalesce("source_pdf", F.lit(""))))
    taken = duplicates(named.select("_stem", "final_filename_stem"), ["_stem", "final_filename_stem"], "_taken").where("_taken").distinct()
    n = F.col("number")
    rows = rows.withColumn("_stem", file_stem("source_pdf")).withColumn("final_filename_stem", n["final_filename_stem"]).join(taken, ["_stem", "final_filename_stem"], "left")
    if existing is None:
        rows = rows.withColumn("_there", F.lit(True))
    else:
        rows = rows.join(existing.select("output_pdf_path").distinct().withColumn("_there", F.lit(True)), "output_pdf_path", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    there = n.isNotNull()
    unnamed = F.coalesce(F.col("final_filename_stem"), F.lit("")) == ""
    blockers = sorted_unique(
        labels(
            (F.lit(dry_run), "dry_run"),
            (no(F.col("output")["output_status"] == "corrected"), "rotation_output_not_corrected"),
            (yes(F.col("decision")["needs_review"]), "rotation_decision_needs_review"),
            (~there, "missing_drawing_number_decision"),
            (there & no(n["api_ok"]), "drawing_number_api_not_ok"),
            (there & no(n["parse_status"] == "ok"), "drawing_number_parse_not_ok"),
            (there & no(n["schema_status"] == "ok"), "drawing_number_schema_not_ok"),
            (there & yes(n["needs_review"]), "drawing_number_decision_needs_review"),
            (unnamed, "missing_final_filename_stem"),
            (~unnamed & yes(F.col("_taken")), "duplicate_drawing_number"),
            (no(F.col("_there")), "missing_corrected_pdf"),
        )
    )
    rows = rows.withColumn("final_blockers", blockers).withColumn("needs_review", F.size("final_blockers") > 0)
    folder = F.concat(F.lit(output_dir.rstrip("/") + "/"), F.col("source_stem"))
    path = F.when(F.col("needs_review"), F.concat(folder, F.lit("/needs_review/"), F.col("task_id"), F.lit(".pdf"))).otherwise(F.concat(folder, F.lit("/"), F.col("final_filename_stem"), F.lit(".pdf")))
    final = {
        "drawing_number": F.coalesce(n["selected_drawing_number"], F.lit("")),
        "final_filename_stem": F.coalesce("final_filename_stem", F.lit("")),
        "final_pdf_path": path,
        "corrected_pdf_path": F.col("output_pdf_path"),
        "final_status": F.when(F.col("needs_review"), "needs_review").otherwise("published"),
        "needs_review": F.col("needs_review"),
        "final_blockers": F.col("final_blockers"),
    }
    return rows.select("task_id", "source_pdf", "page_number", "decision", "output", "number", F.struct(*(c.alias(k) for k, c in final.items())).alias("final"))


def final_outputs(pages: DataFrame, decisions: DataFrame, outputs: DataFrame, numbers: DataFrame, output_dir: str, dry_run: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """A row a page with its names, paths and blockers: see finished()."""
    rows = assembled(pages, decision=decisions, output=outputs, number=numbers)
    return finished(rows, numbers, output_dir, dry_run, existing).select("task_id", "source_pdf", "page_number", "final.*")


def reported(rows: DataFrame) -> DataFrame:
    """Rows with decision, output, number and final as a report of texts: what has no row is empty, and lists are joined by ;."""
    named = {
        "final_pdf_path": "final.final_pdf_path",
        "final_status": "final.final_status",
        "drawing_number": "number.selected_drawing_number",
        "final_filename_stem": "final.final_filename_stem",
        "corrected_pdf_path": "output.output_pdf_path",
        "output_status": "output.output_status",
        **{n: f"decision.{n}" for n in ("title_block_position", "current_clockwise_degrees", "correction_clockwise_degrees", "confidence", "api_ok", "parse_status", "schema_status")},
        **{f"drawing_number_{n}": f"number.{n}" for n in ("api_ok", "parse_status", "schema_status", "confidence")},
        "needs_review": "final.needs_review",
        "review_reasons": "decision.review_reasons",
        "drawing_number_review_reasons": "number.review_reasons",
        "output_blockers": "output.output_blockers",
        "final_blockers": "final.final_blockers",
    }
    lists = {"decision.review_reasons", "number.review_reasons", "output.output_blockers", "final.final_blockers"}
    text = lambda c: F.array_join(c, ";") if c in lists else F.col(c).cast("string")
    return rows.select("source_pdf", "page_number", *(F.coalesce(text(c), F.lit("")).alias(n) for n, c in named.items()))


def report(pages: DataFrame, decisions: DataFrame, outputs: DataFrame, numbers: DataFrame, finals: DataFrame) -> DataFrame:
    """One row a page from all tables: see reported()."""
    return reported(assembled(pages, decision=decisions, output=outputs, number=numbers, final=finals))


def summary(pages: DataFrame, decisions: DataFrame, outputs: DataFrame, numbers: DataFrame, finals: DataFrame) -> DataFrame:
    """One row of counts."""
    ok = lambda prefix: {f"{prefix}_api_ok_count": F.col("api_ok"), f"{prefix}_parse_ok_count": F.col("parse_status") == "ok", f"{prefix}_schema_ok_count": F.col("schema_status") == "ok"}
    return run_summary(
        pages=(pages, {"page_count": F.lit(True)}),
        decisions=(decisions, ok("orientation")),
        numbers=(numbers, {**ok("drawing_number"), "drawing_number_non_empty_count": F.col("selected_drawing_number") != ""}),
        outputs=(outputs, {"corrected_count": F.col("output_status") == "corrected", "copied_needs_review_count": F.col("output_status") == "copied_needs_review"}),
        finals=(finals, {"published_count": F.col("final_status") == "published", "final_needs_review_count": F.coalesce(F.col("final_status"), F.lit("")) != "published"}),
    )


def split_and_rendered(pages: DataFrame, log: str, split: Callable[[bytes, int], bytes], render: Callable[[bytes, int], bytes]) -> tuple[DataFrame, DataFrame]:
    """Splits each file into its pages and renders them; what both did, as written tables below `log`.

    pages: files.page_rows(). split(content, page) gives a page's file, render(content, page)
    its image, by whatever library the workers have.
    """
    from vellumen.sources.sinks import published

    parts = published(pages, f"{log.rstrip('/')}/split", "source_pdf", "split_pdf_path", "page_number", split, "split")
    return parts, published(pages, f"{log.rstrip('/')}/rendered", "split_pdf_path", "rendered_png_path", "page_number", render, "rendered")


def publish(pages: DataFrame, outputs: DataFrame, finals: DataFrame, log: str, turn: Callable[[bytes, int], bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns or copies each page's file to its output path, and that to its final path; what both did, as written tables below `log`.

    pages: task_id, split_pdf_path. Each file is put in its place whole, so that a repeated
    task changes nothing. turn(content, degrees) turns a file; without one files are copied
    as they are.
    """
    from vellumen.sources.sinks import published

    rows = pages.select("task_id", "split_pdf_path").join(outputs.select("task_id", "output_pdf_path", "applied_pdf_rotate_clockwise"), "task_id")
    turned = published(rows, f"{log.rstrip('/')}/outputs", "split_pdf_path", "output_pdf_path", "applied_pdf_rotate_clockwise", turn)
    return turned, published(finals, f"{log.rstrip('/')}/finals", "corrected_pdf_path", "final_pdf_path")


@dataclass(frozen=True)
class Run:
    """The tables of a run."""

    decisions: DataFrame
    outputs: DataFrame
    numbers: DataFrame
    finals: DataFrame
    report: DataFrame
    needs_review: DataFrame
    summary: DataFrame


Store = Callable[[DataFrame, str], DataFrame]


def persisted(rows: DataFrame, name: str) -> DataFrame:
    """Worked out once: see rank.kept()."""
    return kept(rows)


def written(folder: str) -> Store:
    """Keeps tables below a shared folder, so that a lost executor repeats no call."""

    def store(rows: DataFrame, name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        rows.write.mode("errorifexists").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    return store


def run(pages: DataFrame, model: str, provider: Provider, output_dir: str, dry_run: bool = False, store: Store = persisted) -> Run:
    """All of it. Numbers are asked for on pages that were turned; fails if no orientation call succeeded.

    store keeps responses and decisions; give written(folder) with providers that really call.
    """
    request = lambda rows, kind: rows.select("task_id", "source_pdf", "page_number", F.lit(model).alias("model"), F.lit(kind).alias("request_kind"))
    asked = lambda rows, kind: store(provider.responses(request(rows, kind)), f"{kind}_raw_responses")
    decisions = store(orientation_decisions(asked(pages, "orientation")), "orientation_decisions")
    if not dry_run:
        all_failed(decisions, F.col("api_ok"))
    outputs = store(rotation_outputs(pages, decisions, dry_run), "rotation_output_records")
    turned = pages.join(outputs.where("output_status = 'corrected'").select("task_id"), "task_id", "left_semi")
    numbers = store(number_decisions(asked(turned, "drawing_number")), "drawing_number_decisions")
    every = store(finished(assembled(pages, decision=decisions, output=outputs, number=numbers), numbers, output_dir, dry_run), "final_output_records")
    finals = every.select("task_id", "source_pdf", "page_number", "final.*")
    rows = reported(every)
    return Run(decisions, outputs, numbers, finals, rows, rows.where("needs_review = 'true'"), summary(pages, decisions, outputs, numbers, finals))
