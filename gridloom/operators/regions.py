"""Regions that recognition reports: which text stays, which figures, and what to paint over in a crop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import boxes as B

CORNERS = ["x1", "y1", "x2", "y2"]


def text_reasons(paragraphs: DataFrame, pages: DataFrame, content: DataFrame, tables: DataFrame, frame_first: bool = False) -> DataFrame:
    """paragraphs (page, ord, polygon) -> (page, ord, reason): wrap_around, outside_frame (its centre), in_table (its centre) or ok.

    Wrap-around is tested before the frame, or after it as in the raw dump. A polygon without a box is neither outside nor in a table.
    """
    own = paragraphs.join(pages, "page").join(content.select("page", *[F.col(c).alias(f"c_{c}") for c in CORNERS]), "page", "left")
    w, h = F.col("w"), F.col("h")
    own = own.withColumn("around", B.polygon_to_box(B.scaled(F.col("polygon"), w, h), w, h))
    own = own.withColumns({"cx": (F.col("around.x1") + F.col("around.x2")) / 2, "cy": (F.col("around.y1") + F.col("around.y2")) / 2, "wraps": B.wraps_around(F.col("polygon"), w, h)})
    t = tables.select("page", *[F.col(c).alias(f"t_{c}") for c in CORNERS])
    hit = (F.col("p.page") == F.col("t.page")) & F.col("cx").between(F.col("t_x1"), F.col("t_x2")) & F.col("cy").between(F.col("t_y1"), F.col("t_y2"))
    inside = own.alias("p").join(t.alias("t"), hit, "left_semi").select("page", "ord").distinct().withColumn("table", F.lit(True))
    own = own.join(inside, ["page", "ord"], "left")
    framed = F.col("cx").between(F.col("c_x1"), F.col("c_x2")) & F.col("cy").between(F.col("c_y1"), F.col("c_y2"))
    outside = ~F.coalesce(framed, F.lit(True))
    tests = [(F.col("wraps"), "wrap_around"), (outside, "outside_frame")]
    (first, a), (second, b) = tests[::-1] if frame_first else tests
    return own.select("page", "ord", F.when(first, a).when(second, b).when(F.col("table"), "in_table").otherwise("ok").alias("reason"))


def figure_regions(figures: DataFrame, pages: DataFrame, content: DataFrame) -> DataFrame:
    """figures (page, ord, polygon) -> (page, ord, polygon, corners): those whose centre is in the content box, clamped to it; empty ones go."""
    own = figures.join(pages, "page").join(content.select("page", *[F.col(c).alias(f"c_{c}") for c in CORNERS]), "page", "left")
    w, h = F.col("w"), F.col("h")
    frame = B.box("c_")
    scaled = B.scaled(F.col("polygon"), w, h)
    own = own.withColumn("px", scaled).withColumn("around", B.polygon_to_box(F.col("px"), w, h))
    x, y = (F.col("around.x1") + F.col("around.x2")) / 2, (F.col("around.y1") + F.col("around.y2")) / 2
    own = own.where(frame.x1.isNull() | F.coalesce(x.between(frame.x1, frame.x2) & y.between(frame.y1, frame.y2), F.lit(True)))
    own = own.withColumn("px", F.when(frame.x1.isNull(), F.col("px")).otherwise(B.clamped(F.col("px"), frame)))
    own = own.withColumn("around", B.polygon_to_box(F.col("px"), w, h)).where("around is not null")
    return own.select("page", "ord", F.col("px").alias("polygon"), *[F.col(f"around.{c}").alias(c) for c in CORNERS])


def fill_rectangles(crops: DataFrame, painted: DataFrame, pages: DataFrame, inset: int = 30) -> DataFrame:
    """What to paint over in each crop of a page: (page, ord, painted, corners).

    A painted box that shares columns or rows with the crop is drawn in by ``inset`` on the side that faces the crop (by the centres, the
    longer way; up and down on a tie), so that text on its border stays.
    """
    n, o = crops.alias("n"), painted.alias("o")
    both = n.join(o, F.col("n.page") == F.col("o.page")).join(pages.alias("p"), F.col("n.page") == F.col("p.page"))
    (nx, ny), (ox, oy) = B.centre(B.box(alias="n")), B.centre(B.box(alias="o"))
    dx, dy = nx - ox, ny - oy
    a, b = B.box(alias="n"), B.box(alias="o")
    near = (F.least(a.x2, b.x2) > F.greatest(a.x1, b.x1)) | (F.least(a.y2, b.y2) > F.greatest(a.y1, b.y1))
    tall = F.abs(dy) >= F.abs(dx)
    by = lambda c: F.when(near & c, inset).otherwise(0)
    got = B.Box(
        F.greatest(F.lit(0), b.x1 + by(~tall & (dx <= 0))), F.greatest(F.lit(0), b.y1 + by(tall & (dy <= 0))),
        F.least(F.col("p.w"), b.x2 - by(~tall & (dx > 0))), F.least(F.col("p.h"), b.y2 - by(tall & (dy > 0))),
    )
    out = both.select(F.col("n.page").alias("page"), F.col("n.ord").alias("ord"), F.col("o.ord").alias("painted"), *[c.alias(k) for k, c in got._asdict().items()])
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
