"""Spatial joins, suppression and coverage of boxes on pages.

Boxes are rows (page, ord, x1, y1, x2, y2, ...); ord is the order in which a page's boxes were found and breaks every tie. Joins are equi joins on
the page with the geometry as a residual, so a page is the unit of partitioning and no join is a nested loop over all boxes. What
depends on what was kept before (greedy suppression) folds over one page's boxes at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import boxes as B

from .folds import fold_groups, with_number

CORNERS = ["x1", "y1", "x2", "y2"]


def pairs(boxes: DataFrame, by: str = "page") -> DataFrame:
    """Each pair of a page once, a before b."""
    a, b = boxes.alias("a"), boxes.alias("b")
    return a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.ord") < F.col("b.ord")))


def overlap_issues(boxes: DataFrame, over: float = 0.05, by: str = "page") -> DataFrame:
    """Pairs with more than ``over`` in common: page, ord_a, ord_b, iou."""
    a, b = B.box(alias="a"), B.box(alias="b")
    near = (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)
    found = pairs(boxes, by).where(near).select(F.col(f"a.{by}").alias(by), F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), B.iou(a, b).alias("iou"))
    return found.where(F.col("iou") > over)


def containment(outer: DataFrame, inner: DataFrame, by: str = "page") -> DataFrame:
    """Which boxes hold which: page, outer_ord, inner_ord."""
    a, b = outer.alias("a"), inner.alias("b")
    joined = a.join(b, F.col(f"a.{by}") == F.col(f"b.{by}")).where(B.contains(B.box(alias="a"), B.box(alias="b")))
    return joined.select(F.col(f"a.{by}").alias(by), F.col("a.ord").alias("outer_ord"), F.col("b.ord").alias("inner_ord"))


# ── folds over one page's boxes ─────────────────────────────────────────────────────────────────────────────────────────────


def _area(b) -> int:
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def _common(a, b) -> int:
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def greedy(found: list[tuple[int, ...]], clashes) -> list[int]:
    """Places of the boxes kept, largest first (ties in order): one goes if it clashes with a kept one."""
    kept: list[int] = []
    for i in sorted(range(len(found)), key=lambda i: -_area(found[i])):
        if not any(clashes(found[i], found[k]) for k in kept):
            kept.append(i)
    return kept


def _iou(a, b) -> float:
    both = _common(a, b)
    union = _area(a) + _area(b) - both
    return both / union if both and union > 0 else 0.0


def _corners(df: DataFrame) -> slice:
    """Where a row of ``df`` has its corners, which must stand together."""
    first = df.columns.index("x1")
    return slice(first, first + 4)


def suppressed(boxes: DataFrame, over: float = 0.5, by: str = "page") -> DataFrame:
    """Greedy suppression: by area, each box that has no more than ``over`` (IoU) in common with any kept one. ``rank`` is the place among the kept."""
    at = _corners(boxes)

    def fold(rows: list[tuple]) -> list[tuple]:
        kept = greedy([r[at] for r in rows], lambda a, k: _iou(a, k) > over)
        return [(*rows[i], n) for n, i in enumerate(kept)]

    return fold_groups(boxes, (by,), ("ord",), fold, with_number(boxes, "rank"))


def sweep(found: list[tuple[int, ...]], share: float) -> list[int]:
    """Places left when, in order, each box with ``share`` of it in another one still there and at least as large goes."""
    left = list(range(len(found)))
    i = 0
    while i < len(left):
        own = found[left[i]]
        size = _area(own)
        inside = size > 0 and any(j != i and size <= _area(found[k]) and _common(own, found[k]) / size >= share for j, k in enumerate(left))
        if inside:
            left.pop(i)
        else:
            i += 1
    return left


def new_regions(new: DataFrame, existing: DataFrame, by: str = "page") -> DataFrame:
    """New boxes that add something.

    Out go those with over half in one existing box or over 60 % in all of them together, then, largest first, those with over half in
    a kept one, then those with 85 % in a larger or equal one.
    """
    n, e = B.box(alias="n"), B.box(alias="e")
    both = new.alias("n").join(existing.alias("e"), F.col(f"n.{by}") == F.col(f"e.{by}"), "left")
    covered = both.groupBy(F.col(f"n.{by}").alias(by), F.col("n.ord").alias("ord"), *[F.col(f"n.{c}").alias(c) for c in CORNERS]).agg(
        F.coalesce(F.max(B.intersection_area(n, e)), F.lit(0)).alias("most"), F.coalesce(F.sum(B.intersection_area(n, e)), F.lit(0)).alias("all")
    )
    size = B.area(B.box())
    fresh = covered.where((size == 0) | ((F.col("most") * 2 <= size) & (F.col("all") / size <= 0.6))).drop("most", "all")

    at = _corners(fresh)

    def fold(rows: list[tuple]) -> list[tuple]:
        found = [r[at] for r in rows]
        kept = greedy(found, lambda a, k: _area(a) > 0 and _common(k, a) / _area(a) > 0.5)
        return [rows[kept[i]] for i in sweep([found[i] for i in kept], 0.85)]

    return fold_groups(fresh, (by,), ("ord",), fold, fresh.schema)


def inside_others(boxes: DataFrame, others: DataFrame, share: float, larger: bool, strict: bool, by: str = "page") -> DataFrame:
    """(page, ord) of boxes with ``share`` of them in one of ``others``; strict: more than that; larger: only in one at least as large.

    Where both are the same boxes (larger), a box isn't compared with itself, and equal twins are both inside.
    """
    a, b = B.box(alias="a"), B.box(alias="b")
    both, size = B.intersection_area(a, b), B.area(a)
    hit = (both / size > share) if strict else (both / size >= share)
    rule = F.when(size > 0, hit).otherwise(F.lit(False))
    if larger:
        rule = rule & (F.col("a.ord") != F.col("b.ord")) & (size <= B.area(b))
    on = (F.col(f"a.{by}") == F.col(f"b.{by}")) & rule
    return boxes.alias("a").join(others.alias("b"), on, "left_semi").select(by, "ord")


def verified_filter(verified: DataFrame, existing: DataFrame, by: str = "page") -> DataFrame:
    """Verified boxes without those over 70 % inside an existing one, then without those over 70 % inside another at least as large."""
    kept = verified.join(inside_others(verified, existing, 0.7, False, True, by), [by, "ord"], "left_anti")
    return kept.join(inside_others(kept, kept, 0.7, True, True, by), [by, "ord"], "left_anti")


def merged_regions(detected: DataFrame, found: DataFrame, dropped: DataFrame, by: str = "page") -> DataFrame:
    """Detected boxes without the dropped (page, ord), and found ones that lie under 85 % in any earlier one at least as large; then the containment filter.

    Out: page, source (di or llm), ord, corners.
    """
    di = detected.join(dropped, [by, "ord"], "left_anti").select(by, F.lit("di").alias("source"), "ord", *CORNERS)
    llm = found.select(by, F.lit("llm").alias("source"), "ord", *CORNERS)
    both = di.unionByName(llm)

    def fold(rows: list[tuple]) -> list[tuple]:
        found, kept = [r[3:] for r in rows], []
        for i, own in enumerate(found):
            size = _area(own)
            if not (size and rows[i][1] == "llm" and any(_area(found[k]) >= size and _common(own, found[k]) / size >= 0.85 for k in kept)):
                kept.append(i)
        inside = lambda i, k: k != i and _area(found[i]) <= _area(found[k]) and _common(found[i], found[k]) / _area(found[i]) >= 0.85
        return [rows[i] for i in kept if not _area(found[i]) or not any(inside(i, k) for k in kept)]

    return fold_groups(both, (by,), ("source", "ord"), fold, both.schema)


def postprocessed(crops: DataFrame, content: DataFrame, by: str = "page") -> DataFrame:
    """Crops clipped to their page's content box (those outside it stay as they are), without those that lie in another.

    Of two that hold each other the earlier one goes; a dropped one holds nothing any more.
    """
    c, to = B.box(alias="c"), B.box(alias="t")
    joined = crops.alias("c").join(content.alias("t"), F.col(f"c.{by}") == F.col(f"t.{by}"), "left")
    common = B.intersect(c, to)
    cut = [F.coalesce(common[n], F.col(f"c.{n}")).alias(n) for n in CORNERS]
    clipped = joined.select(F.col(f"c.{by}").alias(by), F.col("c.ord").alias("ord"), *cut)

    at = _corners(clipped)

    def fold(rows: list[tuple]) -> list[tuple]:
        found, gone = [r[at] for r in rows], set()
        for i, a in enumerate(found):
            for j, b in enumerate(found):
                if i != j and i not in gone and j not in gone and b[0] <= a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3]:
                    gone.add(i)
        return [r for i, r in enumerate(rows) if i not in gone]

    return fold_groups(clipped, (by,), ("ord",), fold, clipped.schema)


def coverage_snap(regions: DataFrame, content: DataFrame, existing: DataFrame, by: str = "page") -> DataFrame:
    """What a page's new regions become: ``content`` (one region, the content box) or ``keep``; with the covered share.

    They become the content box if there is no existing crop and they cover over 60 %, or if they are four or more that cover over half, or if a
    single one without existing crops lies over 70 % in it and covers under 55 %.
    """
    r, c = B.box(alias="r"), B.box(alias="c")
    crops = existing.groupBy(by).agg(F.count(F.lit(1)).alias("crops"))
    per_page = (
        regions.alias("r")
        .join(content.alias("c"), F.col(f"r.{by}") == F.col(f"c.{by}"))
        .groupBy(F.col(f"r.{by}").alias(by))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(B.area(r)).alias("covered"), F.sum(B.intersection_area(r, c)).alias("inside"), F.max(B.raw_area(c)).alias("size"))
        .join(crops, by, "left")
    )
    share = F.when(F.col("size") > 0, F.col("covered") / F.col("size")).otherwise(F.lit(1.0))
    alone = F.coalesce(F.col("crops"), F.lit(0)) == 0
    partial = (F.col("n") == 1) & (F.col("inside") / F.greatest(F.col("covered"), F.lit(1)) > 0.7) & (share < 0.55)
    snap = (alone & (share > 0.6)) | ((F.col("n") >= 4) & (share > 0.5)) | (alone & partial)
    return per_page.select(by, "n", share.alias("coverage"), F.when(snap, "content").otherwise("keep").alias("action"))


def two_pass(first: DataFrame, second: DataFrame, by: str = "page", deduplicate: bool = True) -> DataFrame:
    """Both passes' boxes, the second one's only on pages where the first found any; deduplicated by suppression."""
    more = second.join(first.select(by).distinct(), by, "left_semi")
    shift = first.groupBy(by).agg(F.max("ord").alias("last"))
    more = more.join(shift, by).withColumn("ord", F.col("ord") + F.col("last") + 1).drop("last")
    both = first.select(by, "ord", *CORNERS).unionByName(more.select(by, "ord", *CORNERS))
    return suppressed(both, 0.5, by).drop("rank") if deduplicate else both


# ── lines and tiles ─────────────────────────────────────────────────────────────────────────────────────────────────────────


def lines_in_tiles(lines: DataFrame, tiles: DataFrame, share: float = 0.3, tolerance: int = 2, by: str = "page") -> DataFrame:
    """(page, tile, ord) of lines with ``share`` of their area in a tile grown by the tolerance."""
    line, tile = B.box(alias="l"), B.box(alias="t")
    grown = B.Box(tile.x1 - tolerance, tile.y1 - tolerance, tile.x2 + tolerance, tile.y2 + tolerance)
    inside = B.intersection_area(line, grown) / F.greatest(B.raw_area(line), F.lit(1)) >= share
    joined = lines.alias("l").join(tiles.alias("t"), F.col(f"l.{by}") == F.col(f"t.{by}")).where(inside)
    return joined.select(F.col(f"l.{by}").alias(by), F.col("t.tile").alias("tile"), F.col("l.ord").alias("ord"))


def lines_in_any_tile(lines: DataFrame, tiles: DataFrame, share: float = 0.3, by: str = "page") -> DataFrame:
    """One line, the first by tile and order, for each box that lies in some tile."""
    hit = lines_in_tiles(lines, tiles, share, by=by).join(lines, [by, "ord"])
    return hit.groupBy(by, *CORNERS).agg(F.min_by("ord", F.struct("tile", "ord")).alias("ord")).select(by, "ord", *CORNERS)


def assigned_tiles(lines: DataFrame, tiles: DataFrame, tolerance: int = 2, none: int = -1, by: str = "page") -> DataFrame:
    """(page, ord, tile): the first tile that holds a line's centre, grown by the tolerance; ``none`` without one."""
    tile = B.box(alias="t")
    x, y = B.centre(B.box(alias="l"))
    inside = (x >= tile.x1 - tolerance) & (x <= tile.x2 + tolerance) & (y >= tile.y1 - tolerance) & (y <= tile.y2 + tolerance)
    joined = lines.alias("l").join(tiles.alias("t"), (F.col(f"l.{by}") == F.col(f"t.{by}")) & inside, "left")
    found = joined.groupBy(F.col(f"l.{by}").alias(by), F.col("l.ord").alias("ord")).agg(F.min("t.tile").alias("tile"))
    return found.withColumn("tile", F.coalesce("tile", F.lit(none)))


def first_box(boxes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Of each key the first box that is there: the corners of the smallest ord."""
    some = boxes.where(F.col("x1").isNotNull())
    return some.groupBy(*by).agg(F.min_by(F.struct(*CORNERS), F.col("ord")).alias("_first")).select(*by, "_first.*")


# ── coverage ────────────────────────────────────────────────────────────────────────────────────────────────────────────────


def painted_area(painted: DataFrame, by: str = "page") -> DataFrame:
    """Exact union area of rectangles applied in order: kind ``panel`` covers, ``exclude`` uncovers, so a later panel covers again.

    By compression of coordinates: the cells between all edges of a page, each as the last rectangle over it left it.
    """
    def fold(rows: list[tuple]) -> list[tuple]:
        xs, ys = (np.unique([r[k] for r in rows for k in ks]) for ks in ((2, 4), (3, 5)))
        cells = np.zeros((len(ys) - 1, len(xs) - 1), dtype=bool)
        for _, kind, x1, y1, x2, y2, _ in rows:
            i, j, k, m = (np.searchsorted(v, c) for v, c in ((ys, y1), (ys, y2), (xs, x1), (xs, x2)))
            cells[i:j, k:m] = kind == "panel"
        return [(rows[0][0], int((cells * np.diff(ys)[:, None] * np.diff(xs)[None, :]).sum()))]

    own = painted.select(by, "kind", *CORNERS, "ord")
    return fold_groups(own, (by,), ("ord",), fold, f"{by} {painted.schema[by].dataType.simpleString()}, area long")


def edge_fixed(crops: DataFrame, others: DataFrame, by: str = "page") -> DataFrame:
    """One correction step of crops with (clipped, excess: arrays of edge names; s_x1 ... s_y2 the suggested box; w, h).

    Clipped edges only move outwards, excess edges only inwards, others stay. A crop that would swallow another one of its page stops one
    pixel before its far edges, on the edges that moved outwards; the others are taken in order. An empty result leaves the crop as it is.
    n_x1 ... n_y2 are the new corners; ``changed`` tells whether anything moved.
    """
    limits = {"x1": F.greatest(F.lit(0), "s_x1"), "y1": F.greatest(F.lit(0), "s_y1"), "x2": F.least("w", "s_x2"), "y2": F.least("h", "s_y2")}

    def edge(name: str, corner: str) -> Column:
        low = corner in ("x1", "y1")
        now, to = F.col(corner), limits[corner]
        outwards, inwards = (F.least(now, to), F.greatest(now, to)) if low else (F.greatest(now, to), F.least(now, to))
        clipped, excess = F.array_contains("clipped", name), F.array_contains("excess", name)
        return F.when(clipped & excess, now).when(clipped, outwards).when(excess, inwards).otherwise(now)

    edges = {"x1": "left", "y1": "top", "x2": "right", "y2": "bottom"}
    moved = crops.withColumn("start", F.struct(*[edge(n, c).cast("long").alias(c) for c, n in edges.items()]))
    near = others.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("ord", *CORNERS))).alias("others"))
    moved = moved.join(near, by, "left").withColumn("near", F.filter("others", lambda o: o["ord"] != F.col("ord")))

    def stop(s: Column, o: Column) -> Column:
        swallows = (s["x1"] <= o["x1"]) & (s["y1"] <= o["y1"]) & (s["x2"] >= o["x2"]) & (s["y2"] >= o["y2"])

        def corner(c: str) -> Column:
            low = c in ("x1", "y1")
            grew = s[c] < F.col(c) if low else s[c] > F.col(c)
            short = F.greatest(s[c], o[c] + 1) if low else F.least(s[c], o[c] - 1)
            return F.when(swallows & grew, short).otherwise(s[c]).cast("long").alias(c)

        return F.struct(*[corner(c) for c in CORNERS])

    end = F.aggregate(F.coalesce("near", F.array().cast(moved.schema["others"].dataType)), F.col("start"), stop)
    moved = moved.withColumn("end", end)
    sound = (F.col("start.x2") > F.col("start.x1")) & (F.col("start.y2") > F.col("start.y1")) & (F.col("end.x2") > F.col("end.x1")) & (F.col("end.y2") > F.col("end.y1"))
    moved = moved.withColumns({f"n_{c}": F.when(sound, F.col(f"end.{c}")).otherwise(F.col(c)) for c in CORNERS})
    changed = F.greatest(*[(F.col(f"n_{c}") != F.col(c)).cast("int") for c in CORNERS]) == 1
    return moved.withColumn("changed", changed).drop("start", "others", "near", "end")
