"""Ruling lines of a drawing: clustering segments to lines, pruning lines, and panels between lines.

segments: (page, axis, pos, s0, s1): pos across the axis (y of a horizontal one), s0..s1 along it. lines: (page, axis, pos, span_min, span_max, avg_len).
Islands, intervals and nearest lines are windows, aggregates and range joins; what compares with the last line kept folds over an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_groups

KEY = ["page", "axis"]


def clustered(segments: DataFrame, tolerance: int = 25, least: int = 3, span: int = 100, density: float = 0.20, length: float = 12.0) -> DataFrame:
    """Lines of segments: chains of positions no further apart than the tolerance, each at its (half-even) rounded mean.

    A line's members are then all segments within the tolerance of that place; it needs enough of them, a span, a density (summed length by
    span) and a mean length.
    """
    w = Window.partitionBy(*KEY).orderBy("pos")
    jump = (F.col("pos") - F.lag("pos").over(w) > tolerance).cast("int")
    chains = segments.withColumn("chain", F.sum(F.coalesce(jump, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    places = chains.groupBy(*KEY, "chain").agg(F.bround(F.avg("pos")).cast("long").alias("line")).select(*KEY, "line", "chain")
    s, p = segments.alias("s"), places.alias("p")
    near = s.join(p, (F.col("s.page") == F.col("p.page")) & (F.col("s.axis") == F.col("p.axis"))).where(F.abs(F.col("s.pos") - F.col("p.line")) <= tolerance)
    size = F.col("s.s1") - F.col("s.s0")
    got = near.groupBy("p.page", "p.axis", "p.chain", F.col("p.line").alias("pos")).agg(
        F.count(F.lit(1)).alias("n"), F.min("s.s0").alias("lo"), F.max("s.s1").alias("hi"), F.avg(size).alias("avg"), F.sum(size).alias("total")
    )
    wide = F.col("hi") - F.col("lo")
    enough = (F.col("n") >= least) & (wide >= span) & (F.col("total") / F.greatest(wide, F.lit(1)) >= density) & (F.col("avg") >= length)
    whole = lambda c: F.bround(c).cast("long")
    return got.where(enough).select("page", "axis", "pos", whole("lo").alias("span_min"), whole("hi").alias("span_max"), whole("avg").alias("avg_len"))


def merged_intervals(segments: DataFrame, lines: DataFrame, tolerance: int = 25, gap: int = 1, least: int = 4) -> DataFrame:
    """The stretches of each line that its segments cover: (page, axis, pos, s0, s1), joined where the next starts a gap later at most."""
    s, line = segments.alias("s"), lines.select(*KEY, "pos").alias("l")
    near = s.join(line, (F.col("s.page") == F.col("l.page")) & (F.col("s.axis") == F.col("l.axis"))).where(F.abs(F.col("s.pos") - F.col("l.pos")) <= tolerance)
    own = near.select("l.page", "l.axis", "l.pos", F.least("s.s0", "s.s1").alias("s0"), F.greatest("s.s0", "s.s1").alias("s1")).where(F.col("s1") - F.col("s0") >= least)
    w = Window.partitionBy(*KEY, "pos").orderBy("s0", "s1")
    before = F.max("s1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("new", F.when(F.col("s0") <= before + gap, 0).otherwise(1))
    own = own.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*KEY, "pos", "island").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1")).drop("island")


def pruned(lines: DataFrame, gap: int = 28) -> DataFrame:
    """Of lines nearer than the gap to the last one kept, the one of larger (span, mean length) stays in its place."""
    one = F.struct("pos", "span_min", "span_max", "avg_len")
    ordered = lines.groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("ls"))
    kind = ordered.schema["ls"].dataType

    def step(kept: Column, line: Column) -> Column:
        last = F.element_at(kept, -1)
        larger = F.struct((line["span_max"] - line["span_min"]).alias("a"), line["avg_len"].alias("b")) > F.struct(
            (last["span_max"] - last["span_min"]).alias("a"), last["avg_len"].alias("b")
        )
        swapped = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(line))
        close = line["pos"] - last["pos"] < gap
        return F.when(F.size(kept) == 0, F.array(line)).when(~close, F.concat(kept, F.array(line))).when(larger, swapped).otherwise(kept)

    # the first line starts the fold, so that the last kept one is always there
    kept = F.aggregate(F.slice("ls", 2, F.size("ls")), F.slice("ls", 1, 1).cast(kind), step)
    return ordered.select(*KEY, F.explode(kept).alias("_line")).select(*KEY, "_line.*")


def without_fragmented(lines: DataFrame, least: float = 200.0) -> DataFrame:
    return lines.where(F.col("avg_len") >= least)


def without_frame(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Without lines over 90 % of the page that lie at its border: 3 % of the height for horizontal ones, 8 % of the width for vertical ones."""
    joined = lines.join(pages, "page")
    level = F.col("axis") == "h"
    along, across = F.when(level, F.col("w")).otherwise(F.col("h")), F.when(level, F.col("h")).otherwise(F.col("w"))
    border = F.when(level, F.lit(0.03)).otherwise(F.lit(0.08))
    at = F.col("pos") / F.greatest(across, F.lit(1))
    frame = (F.col("span_max") - F.col("span_min") >= 0.9 * along) & ((at <= border) | (at >= 1 - border))
    return joined.where(~frame).select(*lines.columns)


def without_thick(lines: DataFrame, gap: int = 70, share: float = 0.55, thick: float = 650.0, thin: float = 220.0) -> DataFrame:
    """Without long-segment lines that have a short-segment parallel near by over ``share`` of their span."""
    a, b = lines.alias("a"), lines.alias("b")
    common = F.greatest(F.lit(0), F.least("a.span_max", "b.span_max") - F.greatest("a.span_min", "b.span_min"))
    span = F.greatest(F.lit(1), F.col("a.span_max") - F.col("a.span_min"))
    twin = (F.col("a.page") == F.col("b.page")) & (F.col("a.axis") == F.col("b.axis")) & (F.col("a.pos") != F.col("b.pos"))
    near = (F.abs(F.col("a.pos") - F.col("b.pos")) <= gap) & (F.col("b.avg_len") <= thin) & (common / span >= share)
    return a.join(b, twin & (F.col("a.avg_len") >= thick) & near, "left_anti")


def without_thick_middle(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Without vertical lines of long segments (700) in the middle (45 to 65 % of the width) with a short-segment (200) parallel within 60 px over half of them."""
    own = lines.join(pages.select("page", F.col("w").alias("_w")), "page")
    a, b = own.alias("a"), lines.alias("b")
    common = F.greatest(F.lit(0), F.least("a.span_max", "b.span_max") - F.greatest("a.span_min", "b.span_min"))
    span = F.greatest(F.lit(1), F.col("a.span_max") - F.col("a.span_min"))
    middle = (F.col("a.axis") == "v") & F.col("a.pos").between(0.45 * F.col("a._w"), 0.65 * F.col("a._w")) & (F.col("a.avg_len") >= 700)
    twin = (F.col("a.page") == F.col("b.page")) & (F.col("a.axis") == F.col("b.axis")) & (F.col("a.pos") != F.col("b.pos"))
    near = (F.abs(F.col("a.pos") - F.col("b.pos")) <= 60) & (common > 0) & (common / span >= 0.5) & (F.col("b.avg_len") <= 200)
    return a.join(b, twin & middle & near, "left_anti").select(*lines.columns)


def without_repetitive(lines: DataFrame, run: int = 4) -> DataFrame:
    """Without lines of regular spacing: from some line on, at least ``run`` (up to two more) gaps within 20 % of their mean."""
    w = Window.partitionBy(*KEY).orderBy("pos")
    ahead = lines.withColumns({"rank": F.row_number().over(w), "gap": F.lead("pos").over(w) - F.col("pos")})
    gaps = F.collect_list("gap").over(w.rowsBetween(0, run + 1))
    ahead = ahead.withColumn("gaps", F.filter(gaps, lambda g: g.isNotNull()))
    mean = F.aggregate("gaps", F.lit(0.0), lambda a, g: a + g) / F.size("gaps")
    regular = (F.size("gaps") >= run) & (mean > 0) & F.forall("gaps", lambda g: F.abs(g - mean) / mean < 0.20)
    out = ahead.where(regular).select(*KEY, F.explode(F.sequence(F.col("rank"), F.col("rank") + F.size("gaps"))).alias("rank")).distinct()
    return ahead.join(out, [*KEY, "rank"], "left_anti").select(*lines.columns)


def structural(lines: DataFrame, pages: DataFrame, level: float = 0.30, upright: float = 0.40) -> DataFrame:
    """Only lines over 30 % of the width or 40 % of the height, where a page has three or more such; upright ones then pruned by 6 % of the width (50 px at least).

    The pruning gap is the page's own, so pages are pruned together by position scaled to it.
    """
    joined = lines.join(pages, "page")
    need = F.when(F.col("axis") == "h", F.col("w") * level).otherwise(F.col("h") * upright)
    joined = joined.withColumn("long", F.col("span_max") - F.col("span_min") >= need)
    joined = joined.withColumn("many", F.sum(F.col("long").cast("int")).over(Window.partitionBy(*KEY)) >= 3)
    kept = joined.where(~F.col("many") | F.col("long"))
    gap = F.greatest(F.lit(50), (F.col("w") * 0.06).cast("int"))
    flat = kept.where("axis = 'h'").select(*lines.columns)
    tall = kept.where("axis = 'v'").withColumn("gap", gap)
    one = F.struct("pos", "span_min", "span_max", "avg_len")
    ordered = tall.groupBy(*KEY, "gap").agg(F.sort_array(F.collect_list(one)).alias("ls"))

    def step(seen: Column, line: Column) -> Column:
        last = F.element_at(seen, -1)
        larger = F.struct((line["span_max"] - line["span_min"]).alias("a"), line["avg_len"].alias("b")) > F.struct(
            (last["span_max"] - last["span_min"]).alias("a"), last["avg_len"].alias("b")
        )
        swapped = F.concat(F.slice(seen, 1, F.size(seen) - 1), F.array(line))
        return F.when(line["pos"] - last["pos"] >= F.col("gap"), F.concat(seen, F.array(line))).when(larger, swapped).otherwise(seen)

    thin = F.aggregate(F.slice("ls", 2, F.size("ls")), F.slice("ls", 1, 1), step)
    return flat.unionByName(ordered.select(*KEY, F.explode(thin).alias("_line")).select(*KEY, "_line.*"))


def _more_of(first: DataFrame, second: DataFrame, below: int | None = None) -> DataFrame:
    """Of each page and axis the set with more lines, the first on a tie; below: the first also if it has that many already."""
    n, m = (df.groupBy(*KEY).agg(F.count(F.lit(1)).alias(c)) for df, c in ((first, "n"), (second, "m")))
    sizes = n.join(m, KEY, "full_outer").fillna(0, ["n", "m"])
    swap = F.col("m") > F.col("n") if below is None else (F.col("m") > F.col("n")) & (F.col("n") < below)
    swapped = sizes.where(swap).select(*KEY)
    return first.join(swapped, KEY, "left_anti").unionByName(second.join(swapped, KEY, "left_semi"))


def grid(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines that may bound panels: solid lines first, dashed ones where those are few, without frames, tables and thick twins.

    Which pages fall back is decided by counts of a page's lines, as a join; every step is written, for the next ones read it twice.
    """
    from gridloom.sources.scratch import keep

    seg = {a: segments.where(F.col("axis") == a) for a in "hv"}
    long = seg["h"].where(F.col("s1") - F.col("s0") >= 150)
    level = _more_of(clustered(long, 25, 1, 200, 0.60, 100.0), clustered(long, 25, 1, 100, 0.40, 60.0), below=4)
    upright = _more_of(clustered(seg["v"], 25, 1, 200, 0.60, 50.0), clustered(seg["v"], 25, 1, 100, 0.40, 30.0), below=2)
    dashed = {a: clustered(s, 25, 5, 120, 0.20, 12.0) for a, s in seg.items()}
    level, upright = keep(pruned(level), "level"), keep(pruned(_more_of(upright, dashed["v"])), "upright")
    solid = level.groupBy(*KEY).agg(F.max("avg_len").alias("most")).where("most > 200").select(*KEY)
    level = level.join(solid, KEY, "left_anti").unionByName(without_fragmented(level.join(solid, KEY, "left_semi")))
    level = keep(without_thick(without_frame(level, pages)), "level")
    upright = keep(without_thick(without_thick_middle(without_frame(upright, pages), pages)), "upright")
    level = keep(without_repetitive(structural(level, pages)), "level")
    faint = {a: without_frame(pruned(_more_of(dashed[a], clustered(seg[a], 25, 3, 80, 0.10, 8.0), below=4)), pages) for a in "hv"}
    level = _more_of(level, keep(faint["h"], "faint"), below=2)
    upright = keep(_more_of(upright, keep(faint["v"], "faint"), below=6), "upright")
    bounds = keep(structural(upright, pages), "bounds")
    enough = bounds.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(*KEY)
    upright = upright.join(enough, KEY, "left_anti").unionByName(bounds.join(enough, KEY, "left_semi"))
    return level.unionByName(without_frame(without_repetitive(upright), pages))


# ── panels between lines ────────────────────────────────────────────────────────────────────────────────────────────────────


def support(stretches: DataFrame, at: DataFrame, tolerance: int = 2) -> DataFrame:
    """How far lines cover ranges: at (page, axis, id, pos, r0, r1). Adds length (covered px), ratio (1 at most) and touches."""
    a, s = at.alias("a"), stretches.alias("s")
    near = (F.col("a.page") == F.col("s.page")) & (F.col("a.axis") == F.col("s.axis")) & (F.abs(F.col("s.pos") - F.col("a.pos")) <= tolerance)
    low, high = F.least("a.r0", "a.r1"), F.greatest("a.r0", "a.r1")
    part = F.greatest(F.lit(0), F.least("s.s1", high) - F.greatest("s.s0", low))
    meets = (F.col("s.s1") >= low) & (F.col("s.s0") <= high)
    joined = a.join(s, near, "left").groupBy("a.page", "a.axis", "a.id", "a.pos", "a.r0", "a.r1")
    got = joined.agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("length"), F.coalesce(F.max(meets), F.lit(False)).alias("touches"))
    return got.withColumn("ratio", F.least(F.lit(1.0), F.col("length") / F.greatest(F.abs(F.col("r1") - F.col("r0")), F.lit(1))))


def nearest_lines(seeds: DataFrame, lines: DataFrame, stretches: DataFrame, tolerance: int = 2) -> DataFrame:
    """The nearest line of each seed's axis strictly to one side: seeds (page, id, axis, side -1 or 1, pos, ...) -> (page, id, axis, side, line).

    Lines without stretches don't count. To one side no two lines are equally near, so how well a line is supported decides nothing. Seeds and lines
    are put in one order, where the last line before a seed (from either end) is the nearest.
    """
    s, t = lines.select(*KEY, "pos").distinct().alias("l"), stretches.alias("t")
    near = (F.col("l.page") == F.col("t.page")) & (F.col("l.axis") == F.col("t.axis")) & (F.abs(F.col("t.pos") - F.col("l.pos")) <= tolerance)
    live = s.join(t, near, "left_semi")
    at = F.col("pos").cast("double").alias("at")
    asked = seeds.select(*KEY, "id", "side", at, F.lit(0).alias("kind"), F.lit(None).cast(lines.schema["pos"].dataType).alias("line"))
    known = live.select(*KEY, F.lit(None).alias("id"), F.lit(None).alias("side"), at, F.lit(1).alias("kind"), F.col("pos").alias("line"))
    w = Window.partitionBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = (F.last("line", True).over(w.orderBy(by, "kind")) for by in (F.asc("at"), F.desc("at")))  # seeds go before lines in their place
    found = asked.unionByName(known).withColumns({"low": low, "high": high}).where("kind = 0")
    return found.select("page", "id", "axis", "side", F.when(F.col("side") < 0, F.col("low")).otherwise(F.col("high")).alias("line")).where("line is not null")


def supported_line(seeds: DataFrame, lines: DataFrame, stretches: DataFrame, share: float = 0.45, least: float = 50.0) -> DataFrame:
    """Like ``nearest_lines``, but only lines that cover at least max(least, share of the range) of the seed's range count."""
    s, line = seeds.alias("s"), lines.select(*KEY, "pos").distinct().alias("l")
    side = F.col("s.side") * (F.col("l.pos") - F.col("s.pos")) > 0
    joined = s.join(line, (F.col("s.page") == F.col("l.page")) & (F.col("s.axis") == F.col("l.axis")) & side)
    t = stretches.alias("t")
    near = (F.col("l.page") == F.col("t.page")) & (F.col("l.axis") == F.col("t.axis")) & (F.abs(F.col("t.pos") - F.col("l.pos")) <= 2)
    part = F.greatest(F.lit(0), F.least("t.s1", "s.r1") - F.greatest("t.s0", "s.r0"))
    keys = ["s.page", "s.id", "s.axis", "s.side", "s.pos", "s.r0", "s.r1"]
    got = joined.join(t, near).groupBy(*keys, F.col("l.pos").alias("line")).agg(F.sum(part).alias("covered"))
    enough = F.col("covered") >= F.greatest(F.lit(least), share * F.greatest(F.lit(1.0), F.col("r1") - F.col("r0")))
    return got.where(enough).groupBy("page", "id", "axis", "side").agg(F.min_by("line", F.struct(F.abs(F.col("line") - F.col("pos")), "line")).alias("line"))


def panels_between(seeds: DataFrame, lines: DataFrame, stretches: DataFrame, pages: DataFrame, edge: int = 5) -> DataFrame:
    """Panel boxes around seeds (page, id, name, seed_x, seed_y): the nearest lines above, below, left and right, else ``edge`` px inside the page.

    A seed just before a line (1 % of the shorter page side, 50 px at least) moves past it first, for names stand on their panel's border.
    """
    own = seeds.join(pages, "page")
    snap = F.greatest(F.lit(50), (F.least("w", "h") * 0.01).cast("int"))
    for axis, c in (("h", "seed_y"), ("v", "seed_x")):
        ahead = own.alias("s").join(lines.where(F.col("axis") == axis).select("page", "pos").alias("l"), "page")
        ahead = ahead.where((F.col("pos") > F.col(c)) & (F.col("pos") - F.col(c) < snap)).groupBy("page", "id").agg(F.min("pos").alias("over"))
        own = own.join(ahead, ["page", "id"], "left").withColumn(c, F.coalesce(F.col("over") + snap, F.col(c))).drop("over")

    def sides(df: DataFrame, axis: str, at: str, orth: str, r0: Column, r1: Column) -> DataFrame:
        both = F.explode(F.array(F.lit(-1), F.lit(1)))
        asked = df.select("page", "id", F.lit(axis).alias("axis"), both.alias("side"), F.col(at).alias("pos"), F.col(orth).alias("orth"), r0.alias("r0"), r1.alias("r1"))
        return nearest_lines(asked, lines, stretches).groupBy("page", "id").pivot("side", [-1, 1]).agg(F.first("line")).toDF("page", "id", f"{axis}_low", f"{axis}_high")

    near = lambda c, limit: (F.greatest(F.lit(0.0), F.col(c) - 20.0), F.least(F.col(limit) - 1.0, F.col(c) + 20.0))
    own = own.join(sides(own, "h", "seed_y", "seed_x", *near("seed_x", "w")), ["page", "id"], "left")
    own = own.withColumns({"top": F.coalesce("h_low", F.lit(edge)), "bottom": F.coalesce("h_high", F.col("h") - edge)})
    tall = (F.greatest(F.lit(0.0), F.col("top") - 20.0), F.least(F.col("h") - 1.0, F.col("bottom") + 20.0))
    own = own.join(sides(own, "v", "seed_x", "seed_y", *tall), ["page", "id"], "left")
    own = own.withColumns({"left": F.coalesce("v_low", F.lit(edge)), "right": F.coalesce("v_high", F.col("w") - edge)})
    ordered = lambda a, b, n, f: f(a, b).cast("long").alias(n)
    return own.select(
        "page", "id", "name", ordered("left", "right", "x1", F.least), ordered("top", "bottom", "y1", F.least), ordered("left", "right", "x2", F.greatest),
        ordered("top", "bottom", "y2", F.greatest), F.bround("seed_x").cast("long").alias("seed_x"), F.bround("seed_y").cast("long").alias("seed_y"),
    )


def shared_panels_split(panels: DataFrame, pages: DataFrame, alike: float = 0.85) -> DataFrame:
    """Panels of (nearly) one box share it: it is cut midway between their seeds, along the axis on which those spread more (x on a tie).

    Of a name only the first panel counts; a panel joins the first earlier one it is alike (IoU) that no other took. Boxes are clamped to the page,
    one pixel at least. panels: (page, id, name, corners, seed_x, seed_y).
    """
    joined, columns = panels.join(pages, "page"), panels.columns
    every = joined.columns

    def page(rows: list[tuple]) -> list[tuple]:
        first: dict[str, dict] = {}
        for row in rows:
            item = dict(zip(every, row))
            first.setdefault(item["name"], item)
        items = list(first.values())
        w, h = items[0]["w"], items[0]["h"]
        size = lambda p: max(1, (p["x2"] - p["x1"]) * (p["y2"] - p["y1"]))
        groups: list[list[dict]] = []
        for p in items:
            for g in groups:
                q = g[0]
                both = max(0, min(p["x2"], q["x2"]) - max(p["x1"], q["x1"])) * max(0, min(p["y2"], q["y2"]) - max(p["y1"], q["y1"]))
                if both / max(1, size(p) + size(q) - both) >= alike:
                    g.append(p)
                    break
            else:
                groups.append([p])
        for g in groups:
            if len(g) == 1:
                continue
            outer = {c: (min if c in ("x1", "y1") else max)(p[c] for p in g) for c in ("x1", "y1", "x2", "y2")}
            spread = {a: max(p[f"seed_{a}"] for p in g) - min(p[f"seed_{a}"] for p in g) for a in "xy"}
            a = "y" if spread["y"] > spread["x"] else "x"
            g.sort(key=lambda p: p[f"seed_{a}"])
            cuts = [outer[f"{a}1"], *(int((p[f"seed_{a}"] + q[f"seed_{a}"]) / 2) for p, q in zip(g, g[1:])), outer[f"{a}2"]]
            for p, low, high in zip(g, cuts, cuts[1:]):
                p.update(outer | {f"{a}1": low, f"{a}2": high})
        for p in items:
            for a, limit in (("x", w), ("y", h)):
                low, high = (max(0, min(limit - 1, int(p[f"{a}{k}"]))) for k in (1, 2))
                p[f"{a}1"], p[f"{a}2"] = low, high if high > low else min(limit - 1, low + 1)
        return [tuple(p[c] for c in columns) for p in items]

    return fold_groups(joined, ("page",), ("id",), page, panels.schema)


# ── sequences ───────────────────────────────────────────────────────────────────────────────────────────────────────────────


def anchor_clusters(points: DataFrame, value: str, tolerance: float, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """Adds ``cluster``: sorted values go to the first cluster whose first value is within the tolerance. A chain doesn't drift: the fold keeps firsts."""
    one = F.struct(F.col(value).alias("v"), F.col("ord").alias("ord"))
    ordered = points.groupBy(*by).agg(F.sort_array(F.collect_list(one)).alias("ps"))
    kind = points.schema[value].dataType.simpleString()
    start = F.array().cast(f"array<{kind}>")
    firsts = F.aggregate("ps", start, lambda f, p: F.when(F.exists(f, lambda x: F.abs(p["v"] - x) <= tolerance), f).otherwise(F.concat(f, F.array(p["v"]))))
    each = ordered.withColumn("firsts", firsts).select(*by, "firsts", F.explode("ps").alias("p"))
    hit = F.array_position(F.transform("firsts", lambda f: F.abs(F.col("p.v") - f) <= tolerance), True) - 1
    return each.select(*by, F.col("p.ord").alias("ord"), F.col("p.v").alias(value), hit.alias("cluster"))


def frozen_axes(attempts: DataFrame, axes: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """attempts: (panel, attempt, axes: the suggested values). ``<axis>_frozen`` where the last three suggestions went up and down, or down and up."""
    w = Window.partitionBy("panel").orderBy("attempt")

    def swings(c: str) -> Column:
        a, b, now = F.lag(c, 2).over(w), F.lag(c, 1).over(w), F.col(c)
        return F.coalesce(((b > a) & (now < b)) | ((b < a) & (now > b)), F.lit(False))

    return attempts.withColumns({f"{c}_frozen": swings(c) for c in axes})


def best_attempt(attempts: DataFrame) -> DataFrame:
    """attempts: (panel, attempt, wrong: edges that weren't right, corners). The first of fewest; confidence .95 if none is wrong, else 1 - .15 each, .3 at least."""
    best = attempts.groupBy("panel").agg(F.min_by(F.struct("attempt", "wrong", "x1", "y1", "x2", "y2"), F.struct("wrong", "attempt")).alias("_best"))
    confidence = F.when(F.col("_best.wrong") == 0, 0.95).otherwise(F.greatest(F.lit(0.3), 1 - 0.15 * F.col("_best.wrong")))
    return best.select("panel", "_best.*", confidence.alias("confidence"))


def white_bands(profile: DataFrame, white: float = 0.99, least: float = 0.02) -> DataFrame:
    """profile: (page, pos, share of white). Runs of white positions of at least ``least`` of the page's length: (page, start, end), end included."""
    w = Window.partitionBy("page").orderBy("pos")
    marked = profile.withColumn("rank", F.row_number().over(w)).withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("page")))
    runs = marked.where(F.col("share") >= white).withColumn("island", F.col("rank") - F.row_number().over(w))
    got = runs.groupBy("page", "island", "length").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n"))
    return got.where(F.col("n") >= least * F.col("length")).select("page", "start", "end")


def resume_point(checkpoints: DataFrame, by: str = "run_id") -> DataFrame:
    """The last of the unbroken steps 1, 2, ... that a run has a checkpoint of; 0 without the first."""
    w = Window.partitionBy(by).orderBy("step")
    steps = checkpoints.select(by, "step").distinct().withColumn("rank", F.row_number().over(w))
    return steps.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("step") == F.col("rank"), F.col("step"))), F.lit(0)).alias("resume_after"))
