"""Readers for the files of document pipelines."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumen.functions.text import stripped


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, length, modificationTime) of a folder's own files with a suffix in any case, by path; fails if none."""
    if not path_exists(spark, folder):
        raise FileNotFoundError(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length", "modificationTime")
    out = files.where(F.lower("path").endswith(suffix.lower())).orderBy("path")
    if out.isEmpty():
        raise FileNotFoundError(f"no {suffix} files in {folder}")
    return out


def page_rows(files: DataFrame, pages: Column, work_dir: str, output_dir: str, limit_pages: int | None = None) -> DataFrame:
    """A row for each page of each file (with a page count), at most limit_pages a file; 0 and None take all."""
    from vellumen.functions.text import file_stem, safe_name

    stem = safe_name(file_stem("path"))
    n = pages if not limit_pages else F.least(pages, F.lit(limit_pages))
    rows = files.select(F.col("path").alias("source_pdf"), stem.alias("source_stem"), pages.cast("int").alias("page_count"), F.explode(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))).alias("page_number"))
    rows = rows.withColumn("task_id", F.format_string("%s_page_%03d", "source_stem", "page_number"))
    below = lambda root, sub, ext: F.concat(F.lit(f"{root.rstrip('/')}/{sub}/"), F.col("task_id"), F.lit(ext))
    return rows.select("*", below(work_dir, "split", ".pdf").alias("split_pdf_path"), below(work_dir, "rendered", ".png").alias("rendered_png_path"), below(output_dir, "corrected", ".pdf").alias("output_pdf_path"))


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of files that are one JSON array each."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def json_report(spark: SparkSession, path: str, schema: T.StructType | str, column: str = "candidates") -> DataFrame:
    """Rows of a list in files that are one JSON object each."""
    return json_array(spark, path, schema).select(F.explode(column).alias("_r")).select("_r.*")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, *, tolerant: bool = False, missing_ok: bool = False) -> DataFrame:
    """Rows of JSON lines; empty lines don't count.

    A bad line fails, or with tolerant=True becomes a row with its text in _json_error. With
    missing_ok a path that isn't there is an empty table.
    """
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if tolerant:
        kind = T.StructType([*kind, T.StructField("_json_error", T.StringType())])
    if missing_ok and not path_exists(spark, path):
        return spark.createDataFrame([], kind)
    if tolerant:
        return spark.read.json(path, schema=kind, mode="PERMISSIVE", columnNameOfCorruptRecord="_json_error")
    return spark.read.json(path, schema=kind, mode="FAILFAST")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number from 1, line) of text files of any size, read in byte ranges by as many tasks as Spark cuts them into.

    A range's lines come in order, so that a line's place in its range is told without sorting;
    what ranges before hold is added, from one count a range. Lines end in a line feed, a
    carriage return or both; the last one needs no end.
    """
    from vellumen.operators.rank import kept

    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    lines = kept(read)  # both readings must see the same ranges
    ranges = lines.groupBy("path", "_from").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("path").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("path", "_from", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return lines.join(starts, ["path", "_from"]).select("path", (F.col("_id") + F.col("_shift")).cast("int").alias("line_number"), "line")


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, line) of lines that aren't JSON objects."""
    lines = numbered_lines(spark, path).where(stripped(F.col("line")) != "")
    return lines.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False)))


def json_records(spark: SparkSession, path: str, schema: T.StructType | str, *, tolerant: bool = False) -> DataFrame:
    """Rows of JSON lines that know their places; empty lines don't count.

    A line that is no JSON object, or doesn't fit the schema, fails the job with the file and
    the number of the first such line; with tolerant=True it is a row of nulls with its text in _json_error and
    its number in _line_number, which are null for good lines.
    """
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    lines = numbered_lines(spark, path).where(stripped(F.col("line")) != "")
    read = T.StructType([*kind, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("line", read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("path", "line_number", "line", parsed.alias("r"), F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False)).alias("object"))
    good = F.col("object") & F.col("r._bad").isNull()
    if tolerant:
        cells = [F.when(good, F.col("r")[n]).alias(n) for n in kind.names]
        return rows.select(*cells, F.when(~good, F.col("line")).alias("_json_error"), F.when(~good, F.col("line_number")).alias("_line_number"))
    first = rows.where(~good).agg(F.min(F.struct("path", "line_number")).alias("_first"))  # one row: whichever task fails, it names the first
    told = F.concat(F.col("_first.path"), F.lit(":"), F.col("_first.line_number").cast("string"), F.lit(": not the JSON that is expected"))
    checked = rows.crossJoin(F.broadcast(first))
    return checked.where(F.when(good, F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))).select("r.*").drop("_bad")


def line_counts(lines: DataFrame) -> DataFrame:
    """(path, n): how many lines of each file aren't empty."""
    return lines.groupBy("path").agg(F.count_if(stripped(F.col("line")) != "").alias("n"))


def listed_splits(files: DataFrame, splits: DataFrame, pattern: str = r"([^/]+)\.[^.]*$") -> DataFrame:
    """Files (path) with their sample, which the pattern finds in the path, and its split (sample, split); null where there is none."""
    from vellumen.operators.relate import looked_up

    return files.withColumn("sample", F.regexp_extract("path", pattern, 1)).join(looked_up(splits.select("sample", "split"), ["sample"], ()), "sample", "left")


def csv_table(spark: SparkSession, path: str, required: Sequence[str], encodings: Sequence[str] = ("utf-8-sig", "gb18030")) -> DataFrame:
    """Rows of a CSV form in the first encoding that reads it and has the required columns.

    Header and cells are stripped, a byte order mark and nulls are gone; all columns are
    text. A file is decoded and parsed by a worker as a whole: forms are small. Fails if no
    encoding serves.
    """
    wanted = list(required)
    kind = T.ArrayType(T.MapType(T.StringType(), T.StringType()))

    @F.pandas_udf(kind)
    def rows(content: pd.Series) -> pd.Series:
        import csv
        import io

        def one(data: bytes) -> list[dict]:
            why = "empty"
            for encoding in encodings:
                try:
                    text = bytes(data).decode(encoding)
                except UnicodeDecodeError as e:
                    why = str(e)
                    continue
                reader = csv.reader(io.StringIO(text, newline=""))
                head = [h.strip().lstrip("﻿").strip() for h in next(reader, [])]
                if missing := [c for c in wanted if c not in head]:
                    why = f"without columns {missing}"
                    continue
                return [{h: c.strip() for h, c in zip(head, [*r, *[""] * (len(head) - len(r))], strict=False)} for r in reader if any(c.strip() for c in r)]
            raise ValueError(f"no encoding of {tuple(encodings)} reads the form: {why}")

        return content.map(one)

    files = spark.read.format("binaryFile").load(path)
    spread = files.select(F.explode(rows("content")).alias("r"))
    return spread.select(*(F.coalesce(F.col("r")[c], F.lit("")).alias(c) for c in wanted))


MANIFEST = "dataset string, sample string, source_sample string, image_path string, label_path string, title_block_position string, precise_title_block_position string, rotation_degrees int, suggested_split string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of samples; one without a source is its own."""
    rows = spark.read.csv(path, header=True, schema=MANIFEST, mode="FAILFAST", enforceSchema=False)
    return rows.withColumn("source_sample", F.coalesce(F.nullif(F.trim("source_sample"), F.lit("")), F.col("sample")))


def labels(lines: DataFrame, *, confidence: bool = False) -> DataFrame:
    """Oriented boxes of label lines (path, line_number, line): class_id, points, confidence and error.

    Nine numbers, or with confidence=True nine or ten; a line that isn't so has an error and
    no points. Empty lines don't count.
    """
    rows = lines.where(stripped(F.col("line")) != "").withColumn("_f", F.split(stripped(F.col("line")), r"(?U)\s+"))
    n = F.size("_f")
    numbers = F.transform("_f", lambda x: x.try_cast("double"))
    count_ok = n.isin(9, 10) if confidence else n == 9
    bad = F.exists(numbers, lambda x: x.isNull())
    error = F.when(~count_ok, F.format_string("format_error:line_%d:field_count_%d", "line_number", n)).when(bad, F.format_string("format_error:line_%d:not_numeric", "line_number"))
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(numbers, 1 + 2 * i).alias("x"), F.get(numbers, 2 + 2 * i).alias("y")))
    good = error.isNull()
    return rows.select("path", "line_number", F.when(good, F.get(numbers, 0).cast("int")).alias("class_id"), F.when(good, points).alias("points"), F.when(good & (n == 10), F.get(numbers, 9)).alias("confidence"), error.alias("error"))


def with_missing(expected: DataFrame, found: DataFrame, key: str = "path", code: str = "missing_prediction_label") -> DataFrame:
    """Expected files with their labels; a file without a row has an error."""
    joined = expected.join(found.withColumn("_there", F.lit(True)), key, "left")
    return joined.withColumn("error", F.when(F.col("_there").isNull(), code).otherwise(F.col("error"))).drop("_there")


SHAPES = "shapes array<struct<label:string,points:array<array<double>>>>, objects array<struct<category:string,segmentation:array<array<double>>>>, imageWidth double, imageHeight double, info struct<width:double,height:double>"


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, points) of polygon annotation files in either common shape, as shares of the image, by angle about the centre."""
    from vellumen.functions.geometry import around_centre, clamp

    rows = spark.read.json(path, schema=SHAPES, multiLine=True, mode="FAILFAST").select("*", F.col("_metadata.file_path").alias("path"))
    width, height = F.coalesce("imageWidth", "info.width"), F.coalesce("imageHeight", "info.height")
    first = F.transform("shapes", lambda s: F.struct(s["label"].alias("label"), s["points"].alias("xy")))
    second = F.transform("objects", lambda s: F.struct(s["category"].alias("label"), s["segmentation"].alias("xy")))
    none = F.array().cast("array<struct<label:string,xy:array<array<double>>>>")
    each = rows.select("path", width.alias("w"), height.alias("h"), F.explode(F.concat(F.coalesce(first, none), F.coalesce(second, none))).alias("s"))
    points = F.transform("s.xy", lambda p: F.struct(clamp(p[0] / F.col("w")).alias("x"), clamp(p[1] / F.col("h")).alias("y")))
    return each.select("path", F.col("s.label").alias("label"), around_centre(points).alias("points"))


def keys_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys, in order."""
    return rows.select(*keys).distinct().orderBy(*keys)
