"""What follows from a model's replies. Replies are tables that were written once; a retry of a task never asks again.

Every reply parses leniently (functions.text.json_text); one that doesn't parse is null, and each stage says what it takes for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import text as X

from .folds import fold_groups

# Where a reply may keep its names.
NAME_KEYS = ("panel_names", "panel_bays", "names", "panels")
AXES = ("x1", "y1", "x2", "y2")


def tile_names(replies: DataFrame) -> DataFrame:
    """replies (page, tile, reply) -> (page, ord, name): the lists' names in order of tile and place; none of a tile that isn't extractable."""
    own = replies.withColumn("json", X.json_text(F.col("reply")))
    usable = F.coalesce(F.lower(F.get_json_object("json", "$.extractable")), F.lit("true")) != "false"
    own = own.where(usable).withColumn("names", X.first_list(F.col("json"), NAME_KEYS))
    each = own.select("page", "tile", F.posexplode("names").alias("at", "name"))
    return each.select("page", (F.col("tile") * 100000 + F.col("at")).cast("long").alias("ord"), "name")


def verified_names(names: DataFrame, replies: DataFrame) -> DataFrame:
    """Names replaced by the page's verified list, or kept where the reply doesn't parse."""
    got = replies.select("page", X.first_list(X.json_text(F.col("reply")), NAME_KEYS).alias("list")).where("list is not null")
    kept = names.join(got, "page", "left_anti").select("page", "ord", "name")
    return kept.unionByName(got.select("page", F.posexplode("list").alias("ord", "name")).withColumn("ord", F.col("ord").cast("long")))


def chosen_reference(replies: DataFrame) -> DataFrame:
    """replies (page, n_images, reply) -> (page, choice): the 1-based choice clamped to the images; the first where the reply doesn't parse."""
    choice = F.get_json_object(X.json_text(F.col("reply")), "$.choice").try_cast("int")
    return replies.select("page", F.greatest(F.lit(1), F.least("n_images", F.coalesce(choice, F.lit(1)))).alias("choice"))


def located(replies: DataFrame, largest: float = 0.80) -> DataFrame:
    """replies (page, name, w, h, reply) -> located boxes: found, four numbers, clamped, no more than 80 % of the page."""
    json = X.json_text(F.col("reply"))
    own = replies.withColumn("found", F.get_json_object(json, "$.found") == "true")
    own = own.withColumn("bbox", B.sanitized(F.from_json(F.get_json_object(json, "$.bbox"), "array<double>"), F.col("w"), F.col("h")))
    own = own.where(F.col("found") & F.col("bbox").isNotNull())
    small = B.area(B.box_of(F.col("bbox"))) <= largest * (F.col("w").cast("long") * F.col("h"))
    return own.where(small).select("page", "name", *[F.col(f"bbox.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def electrical_corrected(crops: DataFrame, replies: DataFrame) -> DataFrame:
    """Crops a batch reply calls electrical, with its corrected edges, clamped; out go those it doesn't mention, denies, or leaves empty.

    crops (page, idx, corners, w, h); replies (page, reply) with crops: [{index, is_electrical, x1, y1, x2, y2}].
    """
    kind = "array<struct<index:int,is_electrical:boolean,x1:double,y1:double,x2:double,y2:double>>"
    got = replies.select("page", F.explode(F.from_json(F.get_json_object(X.json_text(F.col("reply")), "$.crops"), kind)).alias("r"))
    got = got.select("page", F.col("r.index").alias("idx"), F.col("r.is_electrical").alias("electrical"), *[F.col(f"r.{c}").cast("int").alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    joined = crops.join(got, ["page", "idx"]).where("electrical")
    limits = {"x1": (0, F.col("w")), "y1": (0, F.col("h")), "x2": (0, F.col("w")), "y2": (0, F.col("h"))}
    fixed = {c: F.greatest(F.lit(low), F.least(F.coalesce(f"r_{c}", c), high)) for c, (low, high) in limits.items()}
    out = joined.withColumns(fixed).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return out.select(*crops.columns)


def bays(panels: DataFrame, replies: DataFrame, full: float = 2000, narrow: int = 600) -> DataFrame:
    """panels (page, name, corners, crop_w: the width of the figure they are from), replies (page, name, reply) -> (page, name, bay, corners).

    A panel narrower than int(600 * crop_w / 2000) asks for nothing; with one box or none, or no parseable reply, it is one bay as a whole. Boxes
    are relative to the panel and clamped to it.
    """
    panel = B.box()
    w, h = B.width(panel), B.height(panel)
    got = replies.select("page", "name", F.from_json(F.get_json_object(X.json_text(F.col("reply")), "$.bboxes"), "array<array<double>>").alias("list"))
    joined = panels.join(got, ["page", "name"], "left").withColumn("list", F.coalesce("list", F.array().cast("array<array<double>>")))
    sound = F.filter(F.transform("list", lambda v: B.sanitized(v, w, h)), lambda b: b.isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), w.cast("int").alias("x2"), h.cast("int").alias("y2")))
    parts = joined.withColumn("parts", sound.cast("array<struct<x1:int,y1:int,x2:int,y2:int>>"))
    wide = F.col("x2") - F.col("x1") >= (narrow * F.col("crop_w") / full).cast("int")
    parts = parts.withColumn("parts", F.when(wide & (F.size("parts") > 1), F.col("parts")).otherwise(whole))
    each = parts.select("page", "name", F.col("x1").alias("px"), F.col("y1").alias("py"), F.posexplode("parts").alias("bay", "b"))
    at = {"x1": "px", "y1": "py", "x2": "px", "y2": "py"}
    return each.select("page", "name", (F.col("bay") + 1).alias("bay"), *[(F.col(f"b.{c}") + F.col(o)).alias(c) for c, o in at.items()])


def missing_regions(replies: DataFrame) -> DataFrame:
    """replies (page, w, h, reply) -> (page, ord, corners): regions a detection reply calls missing; the whole page for full_page; none if it doesn't parse."""
    json = X.json_text(F.col("reply"))
    own = replies.withColumns({"full": F.coalesce(F.get_json_object(json, "$.full_page") == "true", F.lit(False)), "missing": F.get_json_object(json, "$.missing")})
    found = F.from_json("missing", "array<struct<polygon:array<double>,note:string>>")
    listed = F.coalesce(F.transform(found, lambda m: m["polygon"]), F.array().cast("array<array<double>>"))
    whole = B.page_polygon(F.col("w"), F.col("h"))
    each = own.select("page", "w", "h", F.posexplode(F.when(F.col("full"), F.array(whole)).otherwise(listed)).alias("ord", "polygon"))
    each = each.withColumn("around", B.polygon_to_box(B.scaled(F.col("polygon"), F.col("w"), F.col("h")), F.col("w"), F.col("h")))
    return each.where("around is not null").select("page", F.col("ord").cast("long").alias("ord"), *[F.col(f"around.{c}").cast("long").alias(c) for c in AXES])


def dropped_regions(replies: DataFrame) -> DataFrame:
    """(page, ord): regions a detection reply drops as not electrical."""
    json = X.json_text(F.col("reply"))
    found = F.from_json(F.get_json_object(json, "$.drop_non_electrical"), "array<struct<index:long,reason:string>>")
    return replies.select("page", F.explode(found).alias("d")).select("page", F.col("d.index").alias("ord")).where("ord is not null").distinct()


def crop_checks(replies: DataFrame) -> DataFrame:
    """(page, ord, reply) -> (page, ord, is_clipped, clipped, excess, s_x1 ... s_y2): a crop check; nothing to do if it doesn't parse, nulls where it suggests no box."""
    json = X.json_text(F.col("reply"))
    listed = lambda key: F.coalesce(F.from_json(F.get_json_object(json, f"$.{key}"), "array<string>"), F.array().cast("array<string>"))
    box = F.from_json(F.get_json_object(json, "$.suggested_box"), "struct<x1:double,y1:double,x2:double,y2:double>")
    return replies.select(
        "page", "ord", F.coalesce(F.get_json_object(json, "$.is_clipped") == "true", F.lit(False)).alias("is_clipped"), listed("clipped_edges").alias("clipped"),
        listed("excess_edges").alias("excess"), *[box[c].cast("long").alias(f"s_{c}") for c in AXES],
    )


def materials(replies: DataFrame) -> DataFrame:
    """(page, name, line, cells): the rows of the markdown table in each reply, without its head and rule."""
    lines = replies.select("page", "name", F.posexplode(F.split("reply", "\n")).alias("line", "text")).withColumn("text", F.trim("text"))
    rows = lines.where(F.col("text").startswith("|") & ~F.regexp_like("text", F.lit(r"^\|[\s:|-]+\|?$")))
    cells = F.transform(F.split(F.regexp_replace("text", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    out = rows.withColumn("cells", cells)
    head = out.groupBy("page", "name").agg(F.min("line").alias("head"))
    return out.join(head, ["page", "name"]).where(F.col("line") > F.col("head")).select("page", "name", "line", "cells")


def settled(name: tuple, rows: list[tuple], w: int, h: int) -> tuple[tuple, float, str, int] | None:
    """One panel's replies in order to its box, confidence, status and the number of attempts; None if nothing is left.

    rows: (located or None, valid, wrong axes, corrected or None). A correction of the attempt before goes ahead of a new location. A box
    must hold the name and cover 80 % of the page at most. A corrected axis that swings (up and down, or down and up, in its last
    three suggestions) stays where it is. Without a valid box the first with the fewest wrong edges counts.
    """

    def sane(v):
        if v is None or len(v) != 4:
            return None
        x1, y1, x2, y2 = (int(c) for c in v)
        box = (max(0, min(x1, w - 1)), max(0, min(y1, h - 1)), max(1, min(x2, w)), max(1, min(y2, h)))
        return box if box[2] > box[0] and box[3] > box[1] else None

    holds = lambda b: b[0] <= name[0] and b[1] <= name[1] and b[2] >= name[2] and b[3] >= name[3]
    seen: list[list[int]] = [[], [], [], []]
    best, fewest, fixed = None, 5, None
    for n, (located_, valid, wrong, corrected) in enumerate(rows, 1):
        box, fixed = (fixed, None) if fixed is not None else (sane(located_), None)
        if box is None or not holds(box) or (box[2] - box[0]) * (box[3] - box[1]) > 0.8 * w * h:
            continue
        if valid:
            return box, 0.95, "verified", n
        if len(wrong) < fewest:
            fewest, best = len(wrong), box
        to = sane(corrected)
        if to and holds(to):
            out = list(to)
            for axis in range(4):
                seen[axis].append(to[axis])
                if len(seen[axis]) >= 3:
                    a, b, c = seen[axis][-3:]
                    if (a < b > c) or (a > b < c):
                        out[axis] = box[axis]
            fixed = sane(out)
    return (best, max(0.3, 1 - 0.15 * fewest), "unverified", len(rows)) if best else None


def verified_panels(attempts: DataFrame, names: DataFrame, w: int, h: int) -> DataFrame:
    """attempts (page, name, attempt, located, valid, wrong, corrected), names (page, name, n_x1 ... n_y2) -> (page, name, corners, confidence, status, attempts)."""
    joined = attempts.join(names, ["page", "name"]).select("page", "name", "attempt", "located", "valid", "wrong", "corrected", *[f"n_{a}" for a in AXES])

    def panel(rows: list[tuple]) -> list[tuple]:
        got = settled(rows[0][7:], [r[3:7] for r in rows], w, h)
        return [] if got is None else [(rows[0][0], rows[0][1], *got[0], *got[1:])]

    schema = "page long, name string, x1 long, y1 long, x2 long, y2 long, confidence double, status string, attempts long"
    return fold_groups(joined, ("page", "name"), ("attempt",), panel, schema)
