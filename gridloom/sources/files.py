"""Files of a run: polygons, crops, recognised text, documents, summaries. Everything goes through Spark's readers, so paths may be in any store."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import boxes as B

CORNERS = ["x1", "y1", "x2", "y2"]


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """Text files of one ``x,y`` a line -> (file, polygon). Lines without two parts are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    part = F.split("line", ",")
    points = lines.where(F.size(part) == 2).select("file", "at", F.trim(part[0]).try_cast("double").alias("x"), F.trim(part[1]).try_cast("double").alias("y"))
    ordered = points.where("x is not null AND y is not null").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "x", "y"))).alias("ps"))
    return ordered.select("file", F.flatten(F.transform("ps", lambda p: F.array(p["x"], p["y"]))).alias("polygon"))


def polygon_lines(polygons_: DataFrame) -> DataFrame:
    """(file, polygon) -> (file, value): the text of its file, two decimals."""
    points = F.transform(F.sequence(F.lit(1), F.size("polygon"), F.lit(2)), lambda i: F.format_string("%.2f,%.2f", F.element_at("polygon", i), F.element_at("polygon", i + 1)))
    return polygons_.select("file", F.when(F.size("polygon") > 0, F.array_join(points, "\n")).otherwise("").alias("value"))


def crops(spark: SparkSession, root: str) -> DataFrame:
    """Crop images under root/pageN/image_N_M.png that have a polygon file image_N_M.txt: (page, idx, path, corners). Overlays are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "image_*.png").option("recursiveFileLookup", "true").load(root).select("path")
    name = r"/page(\d+)/image_(\d+)_(\d+)\.png$"
    found = found.select(
        F.regexp_extract("path", name, 1).try_cast("long").alias("page"), F.regexp_extract("path", name, 3).try_cast("int").alias("idx"), "path",
        F.regexp_replace("path", r"\.png$", "").alias("stem"),
    ).where("page is not null")
    sides = polygons(spark, f"{root}/*/image_*.txt").select(F.regexp_replace("file", r"\.txt$", "").alias("stem"), "polygon")
    sides = sides.withColumn("stem", F.regexp_replace("stem", "^file:/+", "/"))
    got = found.withColumn("stem", F.regexp_replace("stem", "^file:/+", "/")).join(sides, "stem")
    box = {"x1": F.array_min(B.xs(F.col("polygon"))), "y1": F.array_min(B.ys(F.col("polygon"))), "x2": F.array_max(B.xs(F.col("polygon"))), "y2": F.array_max(B.ys(F.col("polygon")))}
    return got.select("page", "idx", "path", *[c.cast("int").alias(n) for n, c in box.items()])


# Where a run keeps what it makes of a page and a crop. {page} and {crop} are numbers, {round} an attempt's.
NAMES = {
    "page_image": "page{page}/page{page}.png",
    "page_images": "page{page}/images",
    "crop_image": "page{page}/image_{page}_{crop}.png",
    "crop_polygon": "page{page}/image_{page}_{crop}.txt",
    "crop_overlay": "page{page}/image_overlay_{page}_{crop}.png",
    "page_overlay": "page{page}/image_overlay_{page}_{crop}_overall.png",
    "round_image": "page{page}/image_{page}_{crop}_iter{round}.png",
    "round_overlay": "page{page}/image_{page}_{crop}_iter{round}_overlay.png",
    "final_image": "page{page}/image_{page}_{crop}_final.png",
}


def named(kind: str, root: str, **numbers: Column | int) -> Column:
    """The path of ``kind`` (see NAMES) under a root, of columns or numbers."""
    parts = re.split(r"{(\w+)}", NAMES[kind])
    filled = [F.lit(p) if i % 2 == 0 else F.lit(numbers[p]).cast("string") for i, p in enumerate(parts)]
    return F.concat(F.lit(root.rstrip("/") + "/"), *filled)


def first_existing(spark: SparkSession, wanted: DataFrame, root: str) -> DataFrame:
    """wanted (key, priority, path) -> (key, path): of each key the existing path of the smallest priority. The folder is listed once, by Spark."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("there"))
    own = wanted.withColumn("there", F.regexp_replace("path", "^file:/+", "/")).join(there, "there", "left_semi")
    return own.groupBy("key").agg(F.min_by("path", "priority").alias("path"))


def document_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest): SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"))


LAYOUT = """page long, width double, height double, lines array<struct<content:string,polygon:array<double>>>,
    figures array<struct<polygon:array<double>>>, tables array<struct<polygon:array<double>>>, paragraphs array<struct<content:string,polygon:array<double>>>"""


def layout(spark: SparkSession, path: str) -> DataFrame:
    """Recognition results, one JSON object for each page."""
    return spark.read.schema(LAYOUT).json(path)


def text_lines(results: DataFrame) -> DataFrame:
    """(page, ord, content, corners): a line's box around its polygon."""
    each = results.select("page", F.posexplode("lines").alias("ord", "l"))
    return each.select("page", F.col("ord").cast("long").alias("ord"), F.col("l.content").alias("content"), *_around(F.col("l.polygon")))


def figures(results: DataFrame, kind: str = "figures") -> DataFrame:
    """(page, ord, corners) of figures (or tables, paragraphs); polygons in inches or shares come out in pixels if the results say so."""
    each = results.select("page", F.posexplode(kind).alias("ord", "f"))
    return each.select("page", F.col("ord").cast("long").alias("ord"), *_around(F.col("f.polygon")))


def relative_polygons(results: DataFrame) -> DataFrame:
    """Figure polygons as shares of the page, whatever unit they came in: (page, ord, polygon)."""
    each = results.select("page", "width", "height", F.posexplode("figures").alias("ord", "f"))
    return each.select("page", F.col("ord").cast("long").alias("ord"), B.relative(F.col("f.polygon"), F.col("width"), F.col("height")).alias("polygon"))


def _around(polygon) -> list:
    ends = (F.array_min(B.xs(polygon)), F.array_min(B.ys(polygon)), F.array_max(B.xs(polygon)), F.array_max(B.ys(polygon)))
    return [c.cast("long").alias(n) for n, c in zip(CORNERS, ends)]


def rendered_pages(documents: DataFrame, render: Callable[[bytes], Iterator[tuple[int, int, int, bytes]]]) -> DataFrame:
    """documents (doc, content) -> (doc, page, w, h, pixels), by a renderer that the caller brings: bytes -> (page, w, h, grey bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch.doc, batch.content):
                for page in render(bytes(content)):
                    yield pd.DataFrame([(doc, *page)], columns=["doc", "page", "w", "h", "pixels"])

    return documents.select("doc", "content").mapInPandas(run, "doc string, page int, w int, h int, pixels binary")


def write_summary(rows: DataFrame, path: str, by: str = "page") -> None:
    """JSON lines, a folder for each value of ``by``."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def hits_by_crop(hits: DataFrame, crops_: DataFrame) -> DataFrame:
    """Hits in their crop's coordinates, those first whose name is longest against the text found: (page, idx, rank, name, corners)."""
    from pyspark.sql import Window

    h, c = hits.alias("h"), crops_.alias("c")
    x, y = B.centre(B.box(alias="h"))
    inside = (x >= F.col("c.x1")) & (x <= F.col("c.x2")) & (y >= F.col("c.y1")) & (y <= F.col("c.y2"))
    own = h.join(c, F.col("h.page") == F.col("c.page")).where(inside)
    moved = B.shifted(B.box(alias="h"), -F.col("c.x1"), -F.col("c.y1"))
    ratio = F.length("h.name") / F.greatest(F.length("h.found"), F.lit(1))
    own = own.select("h.page", "c.idx", "h.name", ratio.alias("ratio"), *[v.alias(n) for n, v in moved._asdict().items()])
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("page", "idx").orderBy(F.desc("ratio"), "name")))


def overlays(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """regions (page, ord, polygon, color), pages (page, w, h, image) -> (page, value): an SVG text of their outlines over the page image."""
    points = F.array_join(F.transform(F.sequence(F.lit(1), F.size("polygon"), F.lit(2)), lambda i: F.format_string("%.1f,%.1f", F.element_at("polygon", i), F.element_at("polygon", i + 1))), " ")
    one = F.format_string('<polygon points="%s" fill="none" stroke="%s"/>', points, F.col("color"))
    drawn = regions.select("page", "ord", one.alias("s")).groupBy("page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("ord", "s")))["s"], "").alias("body"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d"><image href="%s"/>', "w", "h", "image")
    return pages.join(drawn, "page").select("page", F.concat(head, "body", F.lit("</svg>")).alias("value"))
