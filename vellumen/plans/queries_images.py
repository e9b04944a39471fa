"""Queries over page images that are drawn by the query, and SQL for what their measures must be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumen.functions import geometry, images, text
from vellumen.plans import lifecycle
from vellumen.plans.queries import query, read
from vellumen.plans.queries_pages import rounded
from vellumen.plans.queries_records import folder, on_driver
from vellumen.sources import files

# A frame of dark lines on a white page: k is a nation's number, from 0 to 24.
FRAME_SQL = "SELECT n_nationkey AS k, (100 + n_nationkey)::INTEGER AS w, 80 AS h, n_nationkey % 9 AS x1, 95 - n_nationkey % 5 AS x2, 2 + n_nationkey % 7 AS y1, 76 AS y2 FROM nation"


def framed(spark, sf_dir) -> DataFrame:
    """Pages (task_id, width, height, pixels) with four lines of one pixel."""
    k = F.col("n_nationkey")
    n = read(spark, sf_dir, "nation", "n_nationkey").select(k.alias("k"), (k + 100).cast("int").alias("width"), F.lit(80).alias("height"), (k % 9).cast("int").alias("x1"), (F.lit(95) - k % 5).cast("int").alias("x2"), (k % 7 + 2).cast("int").alias("y1"), F.lit(76).alias("y2"))
    line = F.concat(F.expr("repeat('FF', x1)"), F.lit("00"), F.expr("repeat('FF', x2 - x1 - 1)"), F.lit("00"), F.expr("repeat('FF', width - x2 - 1)"))
    dark = F.expr("repeat('00', width)")
    n = n.withColumn("line", line).withColumn("dark", dark)
    hexed = F.concat(F.expr("repeat(line, y1)"), "dark", F.expr("repeat(line, y2 - y1 - 1)"), "dark", F.expr("repeat(line, height - y2 - 1)"))
    return n.select(F.col("k").cast("string").alias("task_id"), "width", "height", F.unhex(hexed).alias("pixels"))


@query(f"SELECT k, round(x1 / (w - 1)::DOUBLE, 9) AS l, round(CASE WHEN x2 >= w - 14 THEN x2 / (w - 1)::DOUBLE END, 9) AS r, round(y1 / 79::DOUBLE, 9) AS t, round(y2 / 79::DOUBLE, 9) AS b, 1.0::DOUBLE AS strength FROM ({FRAME_SQL}) WHERE x2 >= w - 14")
def frame_lines(spark, sf_dir):
    """The lines of a frame that lie near the sides; pages whose right line lies too far off are left out."""
    pages = framed(spark, sf_dir).where(F.lit(95) - F.col("task_id").cast("int") % 5 >= F.col("width") - 14)
    return images.frame_lines(pages).select(F.col("task_id").cast("int").alias("k"), rounded(F.col("left"), "l"), rounded(F.col("right"), "r"), rounded(F.col("top"), "t"), rounded(F.col("bottom"), "b"), F.col("left_strength").alias("strength"))


@query(f"""
SELECT k, round(p, 9) AS dark_ratio, round(255 * sqrt(p * (1 - p)), 6) AS contrast FROM (SELECT k, (2 * h + 2 * w - 4) / (w * h)::DOUBLE AS p FROM ({FRAME_SQL}))
""")
def image_quality(spark, sf_dir):
    q = images.quality(framed(spark, sf_dir))
    return q.select(F.col("task_id").cast("int").alias("k"), rounded(F.col("dark_ratio"), "dark_ratio"), rounded(F.col("contrast"), "contrast", 6))


@query(f"SELECT k, w AS height, h AS width, 2 * h + 2 * w - 4 AS dark, 40 AS small_height, round_even(w * (40 / w::DOUBLE), 0)::INTEGER AS small_side, true AS is_png FROM ({FRAME_SQL})".replace("40 AS small_height, round_even(w * (40 / w::DOUBLE), 0)::INTEGER AS small_side", "round_even(h * (40 / w::DOUBLE), 0)::INTEGER AS small_height, 40 AS small_width"))
def turned_and_shrunk(spark, sf_dir):
    """Pages turned, and made small, and written as PNG files."""
    pages = framed(spark, sf_dir)
    turned = images.turned(pages.withColumn("degrees", F.lit(90))).select(F.col("task_id"), "height", "width", F.regexp_count(F.hex("pixels"), F.lit("00")).alias("dark"))
    small = images.shrunk(pages, 40)
    files_ = images.png(small).select("task_id", F.hex("content").startswith("89504E470D0A1A0A").alias("is_png"))
    out = turned.join(small.select("task_id", F.col("height").alias("small_height"), F.col("width").alias("small_width")), "task_id").join(files_, "task_id")
    return out.select(F.col("task_id").cast("int").alias("k"), "height", "width", "dark", "small_height", "small_width", "is_png")


def ruled(spark, sf_dir) -> DataFrame:
    """Pages of 400 by 300 with a table: lines of two pixels from side to side, 2 + k % 4 standing and 4 lying ones."""
    k = F.col("n_nationkey")
    n = read(spark, sf_dir, "nation", "n_nationkey").select(k.alias("k"), (k % 4 + 2).cast("int").alias("columns"))
    row = F.array_join(F.transform(F.sequence(F.lit(1), F.col("columns") - 1), lambda i: F.expr("repeat('FF', div(400, columns) - 2)")), "0000")
    n = n.withColumn("line", F.rpad(F.concat(F.lit("0000"), row, F.lit("0000")), 800, "FF")).withColumn("dark", F.expr("repeat('00', 800)"))
    band = F.expr("concat(dark, repeat(line, 98))")
    return n.select(F.col("k").cast("string").alias("task_id"), F.lit(400).alias("width"), F.lit(300).alias("height"), F.unhex(F.concat(band, band, band)).alias("pixels"))


@query("""
SELECT n_nationkey AS k, side, CASE side WHEN 'left' THEN 160 * 300 WHEN 'right' THEN 160 * 300 ELSE 400 * 120 END AS pixels FROM nation, (VALUES ('left'), ('right'), ('top'), ('bottom')) AS t(side)
""")
def window_counts(spark, sf_dir):
    """What the windows of a page cover, and that lines are found in each of them."""
    pages = ruled(spark, sf_dir).withColumn("windows", geometry.side_bands(F.col("width"), F.col("height")))
    c = images.window_counts(pages)
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    features = images.window_features(pages).where("line_density > 0 AND line_density < 1 AND intersection_density < line_density").select("task_id", "side")
    return c.where("line_pixels > 0 AND line_pixels < near_area AND crossing_pixels <= line_pixels AND lying_parts > 0").join(features, ["task_id", "side"]).select(F.col("task_id").cast("int").alias("k"), "side", area.alias("pixels"))


@query("SELECT n_nationkey::VARCHAR AS task_id, a AS angle, CASE n_nationkey % 3 WHEN 0 THEN 'first ' || a WHEN 1 THEN 'second ' || a ELSE '' END AS text, CASE WHEN n_nationkey % 3 < 2 THEN 'ok' ELSE 'error:ValueError' END AS status, CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS engine FROM nation, (VALUES (0), (90)) AS t(a)", registered=False)
def recognition_ladder(spark, sf_dir):
    """Three engines: one that can't be made, one that fails on most pages, and one that fails on a third."""

    def missing():
        raise ImportError("no such library")

    def first():
        def read_(pixels, width, height, angle):
            if (width - 100) % 3:
                raise RuntimeError("cannot read")
            return f"first {angle}", 0.9

        return read_

    def second():
        def read_(pixels, width, height, angle):
            if (width - 100) % 3 == 2:
                raise ValueError("nothing there")
            return f"second {angle}", 0.5

        return read_

    pages = framed(spark, sf_dir).withColumn("angles", F.array(F.lit(0), F.lit(90)))
    return lifecycle.Recogniser(missing, (first, second)).texts(pages).drop("confidence")


@query("SELECT 'doc_' || n AS stem, p AS page, 'split:' || p || ':xx' AS part, 'rendered:' || p || ':split:' || p || ':xx' AS image FROM (SELECT unnest(generate_series(0, 4)) AS n), (VALUES (1), (2)) AS t(p)", registered=False)
def split_and_rendered(spark, sf_dir):
    """Files split into pages and rendered by functions that are given, and what then lies in their places."""
    path = on_driver(folder(spark))
    for n in range(5):
        (path / f"doc {n}.pdf").write_bytes(b"xx")
    found = files.list_files(spark, str(path)).withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    pages = files.page_rows(found.withColumn("path", F.regexp_replace("path", "^file:/*", "/")), F.col("length"), str(path / "work"), str(path / "out"))
    lifecycle.split_and_rendered(pages, str(path / "log"), lambda content, page: f"split:{page}:".encode() + content, lambda content, page: f"rendered:{page}:".encode() + content)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(path / "work")).select(text.file_stem(F.col("path")).alias("task_id"), F.col("path").endswith(".png").alias("image"), F.col("content").cast("string").alias("content"))
    one = there.groupBy("task_id").agg(F.max(F.when(~F.col("image"), F.col("content"))).alias("part"), F.max(F.when(F.col("image"), F.col("content"))).alias("image"))
    return pages.join(one, "task_id").select(F.col("source_stem").alias("stem"), F.col("page_number").cast("int").alias("page"), "part", "image")


@query("""
SELECT n_nationkey AS k, 'ok' AS structure, (n_nationkey % 4 + 2) * 3 AS cells, 1.0::DOUBLE AS uniform, 'no_right_cluster' AS region FROM nation UNION ALL SELECT 100, 'insufficient_grid', 0, 0.0, 'insufficient_column_signal' UNION ALL SELECT 101, 'image_too_small', 0, 0.0, 'insufficient_column_signal'
""")
def table_measures(spark, sf_dir):
    """Cells of drawn tables, of a blank page and of a tiny one, and whether lines fill a region on the right."""
    blank = spark.createDataFrame([("100", 60, 40, bytearray(b"\xff" * 2400)), ("101", 10, 10, bytearray(b"\xff" * 100))], images.PIXELS)
    pages = ruled(spark, sf_dir).unionByName(blank)
    t = images.table_structure(pages).join(images.table_region(pages).select("task_id", "status"), "task_id")
    return t.select(F.col("task_id").cast("int").alias("k"), F.col("structure_status").alias("structure"), F.col("cell_count_estimate").alias("cells"), F.col("uniform_grid_penalty").alias("uniform"), F.col("status").alias("region"))
