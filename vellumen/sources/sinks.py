"""Writers for reports and records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumen.sources.xlsx import workbook


def json_rows(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, nulls included and letters of all scripts as they are."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def flat(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as the text of a flat report: lists joined by ;, true and false as True and False, nulls empty."""
    kinds = dict(rows.dtypes)

    def text(c: str) -> Column:
        if kinds[c].startswith("array"):
            out = F.array_join(F.col(c).cast("array<string>"), ";")
        elif kinds[c] == "boolean":
            out = F.when(F.col(c), "True").otherwise(F.when(~F.col(c), "False"))
        else:
            out = F.col(c).cast("string")
        return F.coalesce(out, F.lit("")).alias(c)

    return rows.select(*map(text, columns))


def csv_report(rows: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """CSV parts with a header; other columns are left out."""
    flat(rows, columns).write.mode(mode).option("header", "true").option("emptyValue", "").csv(path)


def driver_csv(rows: DataFrame, path: str | Path, columns: Sequence[str], most: int = 100_000) -> None:
    """One CSV file with a byte order mark and a header, for people; refuses more than `most` rows."""
    import csv

    found = flat(rows, columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: write parts with csv_report()")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        out.writerows(map(tuple, found))


def summary_json(row: Mapping | DataFrame, path: str | Path) -> None:
    """One summary row as indented JSON with a last line end."""
    data = row.first().asDict(recursive=True) if isinstance(row, DataFrame) else dict(row)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def xlsx_form(rows: DataFrame, path: str | Path, columns: Sequence[str], most: int = 20_000) -> None:
    """A workbook of a form; refuses more than `most` rows."""
    found = flat(rows, columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(workbook([columns, *map(tuple, found)]))


def split_outputs(rows: DataFrame, folder: str, parts: Mapping[str, Column], mode: str = "errorifexists") -> None:
    """One folder of JSON lines for each condition; the rows are computed once."""
    rows = rows.persist()
    try:
        for name, condition in parts.items():
            json_rows(rows.where(condition), f"{folder.rstrip('/')}/{name}", mode)
    finally:
        rows.unpersist()


def append_responses(rows: DataFrame, path: str) -> None:
    """Adds responses to the record of a run, by kind of request."""
    rows.write.mode("append").partitionBy("request_kind").parquet(path)


PLACED = "task_id string, target string, status string, bytes long"


def place_files(rows: DataFrame, source: str, target: str, number: str | None = None, make: Callable[[bytes, int], bytes] | None = None, made: str = "turned") -> DataFrame:
    """Copies a file for each row (task_id) to its target; (task_id, target, status, bytes), and status is copied, missing or what `made` says.

    With a number other than 0, degrees or a page's, the content goes through make(content,
    number) first. Each file is written beside its target and then put in its place, so that running
    a task again, or two at once, leaves whole files of the same content. Both are paths or
    addresses that pyarrow's file systems reach; the target's folder is made. Something must
    read the result, or nothing is copied: see published().
    """

    def located(address: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(address if "://" in address else Path(address).absolute().as_uri())

    def one(task: str, here: str, there: str, n: int) -> tuple[str, str, str, int]:
        store, path = located(here)
        if store.get_file_info(path).type != fs.FileType.File:
            return task, there, "missing", 0
        with store.open_input_stream(path) as f:
            content = f.read()
        if n and make is not None:
            content = make(content, n)
        out, place = located(there)
        out.create_dir(place.rsplit("/", 1)[0], recursive=True)
        beside = f"{place}.{uuid.uuid4().hex}"
        with out.open_output_stream(beside) as f:
            f.write(content)
        out.move(beside, place)
        return task, there, made if n and make is not None else "copied", len(content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(t, a, b, int(d or 0)) for t, a, b, d in batch.itertuples(index=False)], columns=["task_id", "target", "status", "bytes"])

    given = F.coalesce(F.col(number), F.lit(0)) if number else F.lit(0)
    return rows.select("task_id", F.col(source).alias("source"), F.col(target).alias("target"), given.cast("int").alias("number")).mapInPandas(run, PLACED)


def published(rows: DataFrame, log: str, source: str, target: str, number: str | None = None, make: Callable[[bytes, int], bytes] | None = None, made: str = "turned", mode: str = "errorifexists") -> DataFrame:
    """place_files(), once, with what it did written to a table that is read again."""
    place_files(rows, source, target, number, make, made).write.mode(mode).parquet(log)
    return rows.sparkSession.read.schema(PLACED).parquet(log)
