"""The registered queries of the drawing operators, each with SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import text as X
from gridloom.operators import matching, regions, replies, rulings, runs, spatial, tiling, validation
from gridloom.sources.scratch import in_slices, keep

from .fixtures import PAGE_H, PAGE_W, fixture, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CORNERS = ["x1", "y1", "x2", "y2"]
#: The columns of a box in SQL, and common expressions on two boxes a and b.
_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1)"
_IOU = f"CASE WHEN {_INTER} > 0 THEN {_INTER} / ({_AREA.format('a')} + {_AREA.format('b')} - {_INTER}) ELSE 0 END"


def _query(sql: str | None = None):
    """Register a function (get) -> DataFrame, where get(name) is a fixture."""

    def register(make: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(lambda name: fixture(spark, sf_dir, name))
        if sql is not None:
            ORACLE_SQL[make.__name__] = oracle(sql)
        return make

    return register


def _pairs(get) -> DataFrame:
    return spatial.pairs(get("boxes")).select(F.col("a.page").alias("page"), F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), "a.*", *[F.col(f"b.{c}").alias(f"b_{c}") for c in CORNERS])


_PAIR = "FROM {boxes} a JOIN {boxes} b ON a.page = b.page AND a.ord < b.ord"

# ── scalar geometry ─────────────────────────────────────────────────────────────────────────────────────────────────────────


@_query(f"SELECT a.page, a.ord AS ord_a, b.ord AS ord_b, {_IOU} AS iou, {_INTER} AS common, {_AREA.format('a')} AS area_a {_PAIR} WHERE {_INTER} > 0")
def bbox_iou_pairs(get):
    """Of boxes that meet; any two of a page would be a cross join of it."""
    a, b = B.box(alias="a"), B.box(alias="b")
    return spatial.pairs(get("boxes")).select(
        F.col("a.page").alias("page"), F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"),
        B.iou(a, b).alias("iou"), B.intersection_area(a, b).alias("common"), B.area(a).alias("area_a"),
    ).where("common > 0")


@_query("""SELECT a.page, a.ord AS outer_ord, b.ord AS inner_ord FROM {boxes} a JOIN {boxes} b ON a.page = b.page
           WHERE a.x1 <= b.x1 AND a.y1 <= b.y1 AND a.x2 >= b.x2 AND a.y2 >= b.y2""")
def bbox_contains_join(get):
    return spatial.containment(get("boxes"), get("boxes"))


@_query(f"""SELECT a.page, a.ord AS ord_a, b.ord AS ord_b, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, least(a.x2, b.x2) AS x2, least(a.y2, b.y2) AS y2
            {_PAIR} WHERE {_INTER} > 0""")
def bbox_intersect(get):
    a, b = B.box(alias="a"), B.box(alias="b")
    both = spatial.pairs(get("boxes")).select(F.col("a.page").alias("page"), F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), B.intersect(a, b).alias("common"))
    return both.where("common is not null").select("page", "ord_a", "ord_b", "common.*")


@_query("""SELECT b.page, b.ord, greatest(b.x1, c.x1) AS x1, greatest(b.y1, c.y1) AS y1, least(b.x2, c.x2) AS x2, least(b.y2, c.y2) AS y2
           FROM {boxes} b JOIN {content} c ON b.page = c.page""")
def clip_to_content(get):
    got = B.clip(B.box(alias="b"), B.box(alias="c"))
    joined = get("boxes").alias("b").join(get("content").alias("c"), F.col("b.page") == F.col("c.page"))
    return joined.select("b.page", "b.ord", *[c.alias(n) for n, c in got._asdict().items()])


@_query("""WITH v AS (SELECT page, ord, CASE WHEN ord % 7 = 0 THEN 3 WHEN ord % 7 = 1 THEN 5 ELSE 4 END AS n, x1 - 300 AS a, y1 - 200 AS b, x2 + 200 AS c, y2 AS d FROM {boxes}),
           s AS (SELECT page, ord, n, greatest(0, least(a, 1399)) AS x1, greatest(0, least(b, 899)) AS y1, greatest(1, least(c, 1400)) AS x2, greatest(1, least(d, 900)) AS y2,
                        greatest(0, a) AS u1, greatest(0, b) AS v1, least(c, 1400) AS u2, least(d, 900) AS v2 FROM v)
           SELECT page, ord, n = 4 AND x2 > x1 AND y2 > y1 AS strict_ok, CASE WHEN n = 4 AND x2 > x1 AND y2 > y1 THEN CAST(x1 AS INTEGER) END AS strict_x1,
                  CASE WHEN n = 4 AND x2 > x1 AND y2 > y1 THEN CAST(x2 AS INTEGER) END AS strict_x2,
                  n >= 4 AND u2 > u1 AND v2 > v1 AS loose_ok, CASE WHEN n >= 4 AND u2 > u1 AND v2 > v1 THEN CAST(v2 AS INTEGER) END AS loose_y2 FROM s""")
def sanitize_bbox(get):
    n = F.when(F.col("ord") % 7 == 0, 3).when(F.col("ord") % 7 == 1, 5).otherwise(4)
    values = F.slice(F.array(*[c.cast("double") for c in (F.col("x1") - 300, F.col("y1") - 200, F.col("x2") + 200, F.col("y2"), F.lit(9))]), 1, n)
    w, h = F.lit(PAGE_W), F.lit(PAGE_H)
    got = get("boxes").select("page", "ord", B.sanitized(values, w, h).alias("s"), B.sanitized(values, w, h, strict=False).alias("l"))
    return got.select(
        "page", "ord", F.col("s").isNotNull().alias("strict_ok"), F.col("s.x1").alias("strict_x1"), F.col("s.x2").alias("strict_x2"),
        F.col("l").isNotNull().alias("loose_ok"), F.col("l.y2").alias("loose_y2"),
    )


def _polygons(get) -> DataFrame:
    """Polygons in pixels, and every fourth one as shares of the page."""
    x, y = (lambda c: F.when(F.col("ord") % 4 == 0, F.col(c) / PAGE_W).otherwise(F.col(c).cast("double"))), (lambda c: F.when(F.col("ord") % 4 == 0, F.col(c) / PAGE_H).otherwise(F.col(c).cast("double")))
    return get("boxes").select("page", "ord", *CORNERS, F.array(x("x1"), y("y1"), x("x2"), y("y1"), x("x2"), y("y2"), x("x1"), y("y2")).alias("polygon"))


_POLY = f"""p AS (SELECT page, ord, ord % 4 = 0 AS rel, CASE WHEN ord % 4 = 0 THEN x1 / {PAGE_W} ELSE x1 END AS px1, CASE WHEN ord % 4 = 0 THEN y1 / {PAGE_H} ELSE y1 END AS py1,
            CASE WHEN ord % 4 = 0 THEN x2 / {PAGE_W} ELSE x2 END AS px2, CASE WHEN ord % 4 = 0 THEN y2 / {PAGE_H} ELSE y2 END AS py2 FROM {{boxes}}),
          q AS (SELECT page, ord, rel, px1, py1, px2, py2, CASE WHEN rel THEN px1 * {PAGE_W} ELSE px1 END AS sx1, CASE WHEN rel THEN py1 * {PAGE_H} ELSE py1 END AS sy1,
            CASE WHEN rel THEN px2 * {PAGE_W} ELSE px2 END AS sx2, CASE WHEN rel THEN py2 * {PAGE_H} ELSE py2 END AS sy2 FROM p)"""


@_query(f"""WITH {_POLY} SELECT page, ord, CAST(greatest(0, trunc(sx1) - 6) AS INTEGER) AS x1, CAST(greatest(0, trunc(sy1) - 6) AS INTEGER) AS y1,
            CAST(least({PAGE_W}, trunc(sx2) + 6) AS INTEGER) AS x2, CAST(least({PAGE_H}, trunc(sy2) + 6) AS INTEGER) AS y2 FROM q""")
def polygon_to_bbox(get):
    w, h = F.lit(PAGE_W), F.lit(PAGE_H)
    got = _polygons(get).withColumn("around", B.polygon_to_box(B.scaled(F.col("polygon"), w, h), w, h, 6))
    return got.select("page", "ord", "around.*")


@_query(f"""WITH {_POLY} SELECT q.page, q.ord, rel, round(sx1, 6) AS scaled_x, round(CASE WHEN rel THEN px1 ELSE px1 / {PAGE_W} END, 6) AS relative_x,
            round(greatest(c.x1, least(sx1, c.x2)), 6) AS clamped_x,
            (sx1 + sx2) / 2 >= c.x1 AND (sx1 + sx2) / 2 <= c.x2 AND (sy1 + sy2) / 2 >= c.y1 AND (sy1 + sy2) / 2 <= c.y2 AS centre_in
            FROM q JOIN {{content}} c ON q.page = c.page""")
def polygon_units(get):
    w, h = F.lit(PAGE_W), F.lit(PAGE_H)
    p = _polygons(get).select("page", "ord", "polygon", B.scaled(F.col("polygon"), w, h).alias("s")).join(get("content"), "page")
    first = lambda c, n: F.round(F.element_at(c, 1), 6).alias(n)
    return p.select(
        "page", "ord", B.is_relative(F.col("polygon")).alias("rel"), first(F.col("s"), "scaled_x"), first(B.relative(F.col("polygon"), w, h), "relative_x"),
        first(B.clamped(F.col("s"), B.box()), "clamped_x"), B.centre_inside(F.col("s"), B.box()).alias("centre_in"),
    )


@_query(f"""WITH r AS (SELECT page, ord, CASE WHEN ord % 5 = 0 THEN x1 / {PAGE_W} - 0.3 ELSE x1 / {PAGE_W} END AS a, y1 / {PAGE_H} AS b, x2 / {PAGE_W} AS c, y2 / {PAGE_H} AS d, ord % 6 = 0 AS bow FROM {{boxes}})
            SELECT page, ord, a < -0.1 OR greatest(c, d) > 1.1 OR c - a > 0.8 OR (c - a > 0.6 AND d - b > 0.3) OR bow AS wraps FROM r""")
def wrap_around(get):
    a = F.when(F.col("ord") % 5 == 0, F.col("x1") / PAGE_W - 0.3).otherwise(F.col("x1") / PAGE_W)
    b, c, d = F.col("y1") / PAGE_H, F.col("x2") / PAGE_W, F.col("y2") / PAGE_H
    bow = F.col("ord") % 6 == 0  # a bow tie: its corners turn both ways
    polygon = F.when(bow, F.array(a, b, c, d, c, b, a, d)).otherwise(F.array(a, b, c, b, c, d, a, d))
    return get("boxes").select("page", "ord", B.wraps_around(polygon, F.lit(PAGE_W), F.lit(PAGE_H)).alias("wraps"))


@_query(f"""WITH v AS (SELECT page, ord, CASE WHEN ord % 2 = 0 THEN x2 / 2000.0 ELSE x2 END AS a, CASE WHEN ord % 2 = 0 THEN y1 / 2000.0 ELSE y1 END AS b,
                         CASE WHEN ord % 2 = 0 THEN x1 / 2000.0 ELSE x1 END AS c, CASE WHEN ord % 2 = 0 THEN y2 / 2000.0 ELSE y2 END AS d FROM {{boxes}}),
            s AS (SELECT page, ord, least(a, b, c, d) >= 0 AND greatest(a, b, c, d) <= 1 AS share, a, b, c, d FROM v),
            t AS (SELECT page, ord, CASE WHEN share THEN a * {PAGE_W} ELSE a END AS a, CASE WHEN share THEN b * {PAGE_H} ELSE b END AS b,
                         CASE WHEN share THEN c * {PAGE_W} ELSE c END AS c, CASE WHEN share THEN d * {PAGE_H} ELSE d END AS d FROM s)
            SELECT page, ord, CAST(trunc(least(a, c)) AS INTEGER) AS x1, CAST(trunc(least(b, d)) AS INTEGER) AS y1, CAST(trunc(greatest(a, c)) AS INTEGER) AS x2, CAST(trunc(greatest(b, d)) AS INTEGER) AS y2 FROM t""")
def normalize_bbox(get):
    v = lambda c: F.when(F.col("ord") % 2 == 0, F.col(c) / 2000.0).otherwise(F.col(c).cast("double"))
    got = B.normalized(B.Box(v("x2"), v("y1"), v("x1"), v("y2")), F.lit(PAGE_W), F.lit(PAGE_H))
    return get("boxes").select("page", "ord", *[c.alias(n) for n, c in got._asdict().items()])


@_query(f"SELECT page, x1 <= 45 AND y1 <= 45 AND x2 >= {PAGE_W} - 45 AND y2 >= {PAGE_H} - 45 AS full_page FROM {{content}}")
def full_page_polygon(get):
    return get("content").select("page", B.covers_page(B.box(), F.lit(PAGE_W), F.lit(PAGE_H), 45).alias("full_page"))


@_query("SELECT page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM {lines} GROUP BY page")
def merged_bbox(get):
    return get("lines").groupBy("page").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


@_query("""SELECT a.page, a.ord AS ord_a, b.ord AS ord_b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 2) / greatest(a.x2 - a.x1, b.x2 - b.x1, 1) AS share
           FROM {lines} a JOIN {lines} b ON a.page = b.page AND a.ord < b.ord AND least(a.x2, b.x2) + 2 > greatest(a.x1, b.x1)""")
def x_overlap(get):
    both = spatial.pairs(get("lines"))
    share = B.x_overlap(B.box(alias="a"), B.box(alias="b")).alias("share")
    return both.select(F.col("a.page").alias("page"), F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), share).where("share > 0")


@_query("""SELECT l.page, l.ord, c.x1 AS ox, l.x1 - c.x1 AS x1, l.y1 - c.y1 AS y1, l.x2 - c.x1 AS x2, l.y2 - c.y1 AS y2 FROM {lines} l JOIN {content} c ON l.page = c.page
           WHERE (l.x1 + l.x2) / 2 BETWEEN c.x1 AND c.x2 AND (l.y1 + l.y2) / 2 BETWEEN c.y1 AND c.y2""")
def translate_to_crop(get):
    line, crop = B.box(alias="l"), B.box(alias="c")
    x, y = B.centre(line)
    joined = get("lines").alias("l").join(get("content").alias("c"), F.col("l.page") == F.col("c.page")).where(x.between(crop.x1, crop.x2) & y.between(crop.y1, crop.y2))
    got = B.shifted(line, -crop.x1, -crop.y1)
    return joined.select("l.page", "l.ord", F.col("c.x1").alias("ox"), *[c.alias(n) for n, c in got._asdict().items()])


@_query("""SELECT b.page, b.ord AS panel, n.ord AS line, n.x1 >= b.x1 AND n.y1 >= b.y1 AND n.x2 <= b.x2 AND n.y2 <= b.y2 AS strict_in
           FROM {boxes} b JOIN {lines} n ON b.page = n.page
           WHERE (n.x1 + n.x2) / 2 BETWEEN b.x1 - (n.x2 - n.x1) AND b.x2 + (n.x2 - n.x1) AND (n.y1 + n.y2) / 2 BETWEEN b.y1 - (n.y2 - n.y1) AND b.y2 + (n.y2 - n.y1)""")
def relaxed_name_containment(get):
    panel, name = B.box(alias="b"), B.box(alias="n")
    joined = get("boxes").alias("b").join(get("lines").alias("n"), F.col("b.page") == F.col("n.page")).where(B.holds_name(panel, name))
    return joined.select("b.page", F.col("b.ord").alias("panel"), F.col("n.ord").alias("line"), B.holds_name(panel, name, relaxed=False).alias("strict_in"))


@_query(f"""WITH v AS (SELECT page, ord, CAST(trunc(x1 / 0.5) AS INTEGER) AS a, CAST(trunc(y1 / 0.75) AS INTEGER) AS b, CAST(trunc(x2 / 0.5) AS INTEGER) AS c, CAST(trunc(y2 / 0.75) AS INTEGER) AS d FROM {{boxes}})
            SELECT page, ord, a AS x1, b AS y1, least({PAGE_W}, c) AS x2, least({PAGE_H}, d) AS y2 FROM v WHERE least({PAGE_W}, c) > a AND least({PAGE_H}, d) > b""")
def canvas_to_page(get):
    x1, y1, x2, y2 = (F.col(c) for c in CORNERS)
    got = B.unscaled(x1, y1, x2 - x1, y2 - y1, F.lit(0.5), F.lit(0.75), F.lit(PAGE_W), F.lit(PAGE_H))
    return get("boxes").withColumn("drawn", got).where("drawn is not null").select("page", "ord", "drawn.*")


def _edge_cases(get) -> DataFrame:
    b = get("boxes")
    edge = lambda n, c: F.when(c, F.lit(n))
    clipped = F.array_compact(F.array(edge("left", F.col("part") % 3 == 0), edge("bottom", F.col("part") % 5 == 0)))
    excess = F.array_compact(F.array(edge("right", F.col("supp") % 3 == 0), edge("top", F.col("supp") % 4 == 0)))
    more = {"s_x1": F.col("x1") - 50, "s_y1": F.col("y1") + 20, "s_x2": F.col("x2") - 15, "s_y2": F.col("y2") + 70, "w": F.lit(PAGE_W), "h": F.lit(PAGE_H)}
    return b.withColumns(more).withColumns({"clipped": clipped, "excess": excess})


@_query(f"""WITH s AS (SELECT page, ord, x1, y1, x2, y2, CASE WHEN part % 3 = 0 THEN least(x1, greatest(0, x1 - 50)) ELSE x1 END AS a,
                         CASE WHEN supp % 4 = 0 THEN greatest(y1, greatest(0, y1 + 20)) ELSE y1 END AS b,
                         CASE WHEN supp % 3 = 0 THEN least(x2, least({PAGE_W}, x2 - 15)) ELSE x2 END AS c,
                         CASE WHEN part % 5 = 0 THEN greatest(y2, least({PAGE_H}, y2 + 70)) ELSE y2 END AS d FROM {{boxes}}),
            t AS (SELECT *, c > a AND d > b AS ok FROM s)
            SELECT page, ord, CASE WHEN ok THEN a ELSE x1 END AS n_x1, CASE WHEN ok THEN b ELSE y1 END AS n_y1, CASE WHEN ok THEN c ELSE x2 END AS n_x2, CASE WHEN ok THEN d ELSE y2 END AS n_y2,
                   ok AND (a <> x1 OR b <> y1 OR c <> x2 OR d <> y2) AS changed FROM t""")
def edge_fix(get):
    none = get("boxes").where("false")
    return spatial.edge_fixed(_edge_cases(get), none).select("page", "ord", *[f"n_{c}" for c in CORNERS], "changed")


@_query()
def edge_fix_among_others(get):
    """With the other crops of the page in the way: what is cut back depends on their order; see the tests."""
    return spatial.edge_fixed(_edge_cases(get), get("boxes")).select("page", "ord", *[f"n_{c}" for c in CORNERS], "changed")


# ── tiles ───────────────────────────────────────────────────────────────────────────────────────────────────────────────────

_SIZED = f"(SELECT page, CAST({PAGE_W} + page % 2900 AS INTEGER) AS w, CAST({PAGE_H} + page % 1700 AS INTEGER) AS h FROM {{pages}})"


def _sized(get) -> DataFrame:
    return get("pages").select("page", (PAGE_W + F.col("page") % 2900).cast("int").alias("w"), (PAGE_H + F.col("page") % 1700).cast("int").alias("h"))


def _tiles_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""WITH p AS (SELECT page, w, h, CAST(greatest(0, ceil((w - {size}) / {step}.0)) AS INTEGER) + 1 AS nx, CAST(greatest(0, ceil((h - {size}) / {step}.0)) AS INTEGER) + 1 AS ny FROM {_SIZED} z),
        r AS (SELECT *, unnest(range(ny)) AS j FROM p), g AS (SELECT *, unnest(range(nx)) AS i FROM r)
        SELECT page, CAST(j * nx + i AS INTEGER) AS tile, CAST(i * {step} AS INTEGER) AS x1, CAST(j * {step} AS INTEGER) AS y1,
               CAST(least(i * {step} + {size}, w) AS INTEGER) AS x2, CAST(least(j * {step} + {size}, h) AS INTEGER) AS y2 FROM g"""


@_query(_tiles_sql(1200, 400))
def tile_fixed(get):
    return tiling.fixed_tiles(_sized(get))


@_query(_tiles_sql(2000, 400))
def tile_fixed_large(get):
    return tiling.fixed_tiles(_sized(get), 2000, 400)


def _cuts(get) -> DataFrame:
    return get("pages").select("page", F.col("w").cast("int").alias("length"), F.array((400 + F.col("page") % 90).cast("int"), (150 + F.col("page") % 70).cast("int")).alias("cuts"))


@_query("""WITH c AS (SELECT page, 1400 AS length, [0, 150 + page % 70, 400 + page % 90, 1400] AS e FROM {pages}), s AS (SELECT *, unnest(range(3)) AS i FROM c)
           SELECT page, CAST(i AS INTEGER) AS slice, CAST(greatest(0, e[i + 1] - CASE WHEN i > 0 THEN 60 ELSE 0 END) AS INTEGER) AS "start",
                  CAST(least(length, e[i + 2] + CASE WHEN i < 2 THEN 60 ELSE 0 END) AS INTEGER) AS "end" FROM s""")
def cuts_to_slices(get):
    return tiling.slices(_cuts(get), 60)


@_query("""WITH c AS (SELECT page, 1400 AS length, [0, 150 + page % 70, 400 + page % 90, 1400] AS e, [page % 30, page % 20] AS bf, [page % 11, page % 13] AS af FROM {pages}), s AS (SELECT *, unnest(range(3)) AS i FROM c)
           SELECT page, CAST(i AS INTEGER) AS slice, CAST(greatest(0, e[i + 1] - CASE WHEN i > 0 THEN af[i] ELSE 0 END) AS BIGINT) AS "start",
                  CAST(least(length, e[i + 2] + CASE WHEN i < 2 THEN bf[i + 1] ELSE 0 END) AS BIGINT) AS "end" FROM s""")
def variable_slices(get):
    extra = lambda a, b: F.array((F.col("page") % a).cast("int"), (F.col("page") % b).cast("int"))
    return tiling.variable_slices(_cuts(get).withColumns({"before": extra(30, 20), "after": extra(11, 13)}))


@_query(f"""WITH g AS (SELECT page, w, h, nv, nh FROM {_SIZED} z, (SELECT unnest(range(9)) AS nv) a, (SELECT unnest(range(9)) AS nh) b WHERE nv + nh > 0),
            e AS (SELECT *, (w / (nv + 1)) / greatest(h / (nh + 1), 1) AS r FROM g),
            k AS (SELECT page, nv, nh, row_number() OVER (PARTITION BY page ORDER BY least(abs(r - 0.75), abs(r - 4.0 / 3)), nv, nh) AS k FROM e)
            SELECT page, CAST(nv AS INTEGER) AS nv, CAST(nh AS INTEGER) AS nh FROM k WHERE k = 1""")
def best_cut_counts(get):
    return tiling.cut_counts(_sized(get))


@_query("""WITH i AS (SELECT page, k, CAST(floor(1400 * k / 4.0) AS BIGINT) AS at FROM {pages}, (SELECT unnest([1, 2, 3]) AS k) t),
           c AS (SELECT page, part % 4 AS priority, x1 AS pos FROM {boxes}),
           n AS (SELECT i.page, i.k, c.pos, row_number() OVER (PARTITION BY i.page, i.k ORDER BY c.priority, abs(c.pos - i.at), c.pos) AS r FROM i JOIN c ON i.page = c.page AND abs(c.pos - i.at) <= 40)
           SELECT DISTINCT i.page, coalesce(n.pos, i.at) AS cut FROM i LEFT JOIN n ON i.page = n.page AND i.k = n.k AND n.r = 1""")
def smart_pick_cuts(get):
    candidates = get("boxes").select("page", (F.col("part") % 4).alias("priority"), F.col("x1").alias("pos"))
    return tiling.picked_cuts(get("pages").select("page", F.col("w").alias("length"), F.lit(3).alias("n")), candidates, 40)


@_query(f"""SELECT DISTINCT page, axis, pos FROM (
              SELECT page, 'h' AS axis, y1 AS pos, y1 > 50 AS ok FROM {{boxes}} UNION ALL SELECT page, 'h', y2, y2 < {PAGE_H} - 50 FROM {{boxes}}
              UNION ALL SELECT page, 'v', x1, x1 > 50 FROM {{boxes}} UNION ALL SELECT page, 'v', x2, x2 < {PAGE_W} - 50 FROM {{boxes}}) t WHERE ok""")
def block_cut_edges(get):
    return tiling.block_edges(get("boxes").withColumns({"w": F.lit(PAGE_W), "h": F.lit(PAGE_H)}))


@_query("""WITH s AS (SELECT page % 40 AS doc, page, 1.5 + (part % 90) / 10.0 AS size, supp % 3 > 0 AND page % 3 <> 1 AS has FROM {items}),
           f AS (SELECT doc, page, min(size) FILTER (has AND size >= 2.0) AS font, bool_or(page % 3 = 1 AND page % 2 = 0) AS img FROM s GROUP BY doc, page),
           d AS (SELECT doc, min(font) AS least FROM f GROUP BY doc)
           SELECT f.doc, f.page, CAST(CASE WHEN font < 2.5 THEN 600 WHEN font < 2.7 THEN 576 WHEN font < 2.9 THEN 504 WHEN font < 3.1 THEN 432 WHEN font < 3.3 THEN 360 WHEN font < 3.5 THEN 288
                    WHEN font IS NOT NULL THEN ceil(greatest(72, least(720, 720.0 / font)) / 72) * 72
                    WHEN img THEN ceil(greatest(72, least(720, greatest((1000 + f.page % 900) / (500 / 72.0), 800 / (300 / 72.0)))) / 72) * 72
                    WHEN f.page % 5 = 0 THEN 864 ELSE 288 END AS INTEGER) AS dpi,
                  CAST(CASE WHEN least < 2.5 THEN 600 WHEN least < 2.7 THEN 576 WHEN least < 2.9 THEN 504 WHEN least < 3.1 THEN 432 WHEN least < 3.3 THEN 360 WHEN least < 3.5 THEN 288
                    WHEN least IS NOT NULL THEN ceil(greatest(72, least(720, 720.0 / least)) / 72) * 72 ELSE 288 END AS INTEGER) AS doc_dpi
           FROM f JOIN d ON f.doc = d.doc""")
def render_dpi(get):
    doc = (F.col("page") % 40).alias("doc")
    spans = get("items").where("supp % 3 > 0 AND page % 3 <> 1").select(doc, "page", (F.lit(1.5) + (F.col("part") % 90) / 10.0).alias("size"))
    pages = get("pages").select(doc, "page", F.when(F.col("page") % 5 == 0, 40000).otherwise(10).alias("drawings"))
    images = get("pages").where("page % 3 = 1 AND page % 2 = 0").select(
        doc, "page", (1000 + F.col("page") % 900).alias("w_px"), F.lit(800).alias("h_px"), F.lit(500.0).alias("w_pt"), F.lit(300.0).alias("h_pt")
    )
    return tiling.render_dpi(pages, spans, images)


# ── spatial joins and suppression ───────────────────────────────────────────────────────────────────────────────────────────


@_query(f"SELECT page, ord_a, ord_b, iou FROM (SELECT a.page, a.ord AS ord_a, b.ord AS ord_b, {_IOU} AS iou {_PAIR}) t WHERE iou > 0.05")
def overlap_issues(get):
    return spatial.overlap_issues(get("boxes"))


#: A greedy fold in SQL: boxes by rank, the list of kept ones carried along.
_NMS = """WITH RECURSIVE o AS (SELECT page, ord, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) * (y2 - y1) DESC, ord) AS r FROM {src}),
    f AS (SELECT page, CAST(0 AS BIGINT) AS r, [{{'ord': CAST(-1 AS BIGINT), 'x1': CAST(0 AS BIGINT), 'y1': CAST(0 AS BIGINT), 'x2': CAST(0 AS BIGINT), 'y2': CAST(0 AS BIGINT)}}] AS kept FROM (SELECT DISTINCT page FROM {src}) p
      UNION ALL
      SELECT f.page, o.r, CASE WHEN len(list_filter(f.kept, lambda k: {clash})) > 0 THEN f.kept
             ELSE list_append(f.kept, {{'ord': o.ord, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END
      FROM f JOIN o ON f.page = o.page AND o.r = f.r + 1),
    z AS (SELECT page, kept FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY r DESC) = 1)"""
_KI = "greatest(0, least(o.x2, k.x2) - greatest(o.x1, k.x1)) * greatest(0, least(o.y2, k.y2) - greatest(o.y1, k.y1))"
_KIOU = f"{_KI} / greatest(1, o.area + (k.x2 - k.x1) * (k.y2 - k.y1) - {_KI}) > 0.5"


@_query(
    _NMS.format(src="{boxes}", clash=_KIOU).replace("{{", "{").replace("}}", "}")
    + " SELECT page, k.ord AS ord, CAST(i - 2 AS INTEGER) AS \"rank\" FROM (SELECT page, unnest(range(2, len(kept) + 1)) AS i, kept[i] AS k FROM z) t"
)
def region_nms(get):
    return spatial.suppressed(get("boxes")).select("page", "ord", "rank")


def _kept(source: str, order: str, clash: str) -> str:
    """Boxes of a page in an order, the list of kept ones carried along; the first entry stands for none. source: page, ord, corners, flag."""
    none = "{'ord': CAST(-1 AS BIGINT), 'flag': false, " + ", ".join(f"'{c}': CAST(0 AS BIGINT)" for c in CORNERS) + "}"
    own = "{'ord': o.ord, 'flag': o.flag, " + ", ".join(f"'{c}': o.{c}" for c in CORNERS) + "}"
    return f"""WITH RECURSIVE s AS ({source}), o AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY page ORDER BY {order}) AS r FROM s),
    f AS (SELECT page, CAST(0 AS BIGINT) AS r, [{none}] AS kept FROM (SELECT DISTINCT page FROM s) p
      UNION ALL SELECT f.page, o.r, CASE WHEN len(list_filter(f.kept, lambda k: {clash})) > 0 THEN f.kept ELSE list_append(f.kept, {own}) END FROM f JOIN o ON f.page = o.page AND o.r = f.r + 1),
    z AS (SELECT page, unnest(kept) AS k FROM (SELECT page, kept FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY r DESC) = 1) q),
    w AS (SELECT page, k.ord AS ord, k.flag AS flag, {', '.join(f'k.{c} AS {c}' for c in CORNERS)} FROM z WHERE k.ord >= 0)"""


_CORNERS_A = ", ".join(f"a.{c}" for c in CORNERS)


#: What the containment filter would drop, the suppression before it has dropped already: over half in a larger or equal one.
@_query(_kept(f"""SELECT a.page, a.ord, {_CORNERS_A}, false AS flag FROM {{newer}} a LEFT JOIN {{older}} b ON a.page = b.page GROUP BY a.page, a.ord, {_CORNERS_A}
                  HAVING coalesce(max({_INTER}), 0) * 2 <= {_AREA.format('a')} AND coalesce(sum({_INTER}), 0) / ({_AREA.format('a')}) <= 0.6""", "(x2 - x1) * (y2 - y1) DESC, ord", f"{_KI} / o.area > 0.5")
        + " SELECT page, ord, x1, y1, x2, y2 FROM w")
def filter_new_polygons(get):
    return spatial.new_regions(get("newer"), get("older"))


@_query(f"""WITH v AS (SELECT a.* FROM {{newer}} a WHERE NOT EXISTS (SELECT 1 FROM {{older}} b WHERE a.page = b.page AND {_AREA.format('a')} > 0 AND {_INTER} / ({_AREA.format('a')}) > 0.7))
            SELECT a.page, a.ord FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE a.page = b.page AND a.ord <> b.ord AND {_AREA.format('a')} <= {_AREA.format('b')} AND {_INTER} / ({_AREA.format('a')}) > 0.7)""")
def batch_verify_filter(get):
    return spatial.verified_filter(get("newer"), get("older")).select("page", "ord")


_WITHIN = "k.ord >= 0 AND (k.x2 - k.x1) * (k.y2 - k.y1) >= o.area AND " + _KI + " / o.area >= 0.85"


@_query(_kept("SELECT page, ord, x1, y1, x2, y2, false AS flag FROM {older} d WHERE ord % 9 > 0 UNION ALL SELECT page, ord, x1, y1, x2, y2, true FROM {newer} n", "flag, ord", f"o.flag AND {_WITHIN}")
        + f""" SELECT a.page, CASE WHEN a.flag THEN 'llm' ELSE 'di' END AS source, a.ord, {_CORNERS_A} FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.page = a.page AND (b.flag <> a.flag OR b.ord <> a.ord)
              AND {_AREA.format('a')} <= {_AREA.format('b')} AND {_INTER} / ({_AREA.format('a')}) >= 0.85)""")  # fmt: skip
def merged_regions(get):
    return spatial.merged_regions(get("older"), get("newer"), get("older").where("ord % 9 = 0").select("page", "ord"))


_CUT = ", ".join(f"CASE WHEN least(b.x2, c.x2) > greatest(b.x1, c.x1) AND least(b.y2, c.y2) > greatest(b.y1, c.y1) THEN {'greatest' if v in ('x1', 'y1') else 'least'}(b.{v}, c.{v}) ELSE b.{v} END AS {v}" for v in CORNERS)
_HOLDS = "{0}.x1 <= {1}.x1 AND {0}.y1 <= {1}.y1 AND {0}.x2 >= {1}.x2 AND {0}.y2 >= {1}.y2"


#: A box in a later one goes at once; one in an earlier one goes if that is still there.
@_query(_kept(f"""SELECT a.*, EXISTS (SELECT 1 FROM cut l WHERE l.page = a.page AND l.ord > a.ord AND {_HOLDS.format('l', 'a')}) AS flag FROM cut a""", "ord", f"o.flag OR k.ord >= 0 AND {_HOLDS.format('k', 'o')}")
        .replace("WITH RECURSIVE s AS", f"WITH RECURSIVE cut AS (SELECT b.page, b.ord, {_CUT} FROM {{boxes}} b JOIN {{content}} c ON b.page = c.page), s AS") + " SELECT page, ord, x1, y1, x2, y2 FROM w")
def postprocess_crops(get):
    return spatial.postprocessed(get("boxes").select("page", "ord", *CORNERS), get("content"))


@_query(f"""WITH e AS (SELECT page, count(*) AS crops FROM {{older}} WHERE page % 3 > 0 GROUP BY page),
            n AS (SELECT a.page, count(*) AS n, sum({_AREA.format('a')}) AS covered, sum({_INTER}) AS inside, max((b.x2 - b.x1) * (b.y2 - b.y1)) AS size
                  FROM {{newer}} a JOIN {{content}} b ON a.page = b.page GROUP BY a.page),
            s AS (SELECT n.page, n, CAST(covered / size AS DOUBLE) AS coverage, coalesce(crops, 0) AS crops, inside / greatest(covered, 1) AS part FROM n LEFT JOIN e ON n.page = e.page)
            SELECT page, n, coverage, CASE WHEN (crops = 0 AND coverage > 0.6) OR (n >= 4 AND coverage > 0.5) OR (crops = 0 AND n = 1 AND part > 0.7 AND coverage < 0.55) THEN 'content' ELSE 'keep' END AS action FROM s""")
def coverage_snap(get):
    new = get("newer")
    return spatial.coverage_snap(new, get("content"), get("older").where("page % 3 > 0"))


@_query(f"""WITH n AS (SELECT page, max(ord) AS last FROM {{older}} WHERE page % 4 > 0 GROUP BY page)
            SELECT page, ord, x1, y1, x2, y2 FROM {{older}} WHERE page % 4 > 0
            UNION ALL SELECT b.page, b.ord + last + 1, x1, y1, x2, y2 FROM {{newer}} b JOIN n ON b.page = n.page""")
def two_pass_union(get):
    return spatial.two_pass(get("older").where("page % 4 > 0"), get("newer"), deduplicate=False)


_BOTH = """(SELECT page, ord, x1, y1, x2, y2 FROM {older} WHERE page % 4 > 0 UNION ALL SELECT b.page, b.ord + n.last + 1, b.x1, b.y1, b.x2, b.y2 FROM {newer} b
           JOIN (SELECT page, max(ord) AS last FROM {older} WHERE page % 4 > 0 GROUP BY page) n ON b.page = n.page) u"""


@_query(
    _NMS.format(src=_BOTH, clash=_KIOU).replace("{{", "{").replace("}}", "}")
    + " SELECT page, k.ord AS ord, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM (SELECT page, unnest(kept[2:]) AS k FROM z) t"
)
def two_pass_dedup(get):
    return spatial.two_pass(get("older").where("page % 4 > 0"), get("newer"))


_GROWN = "greatest(0, least(a.x2, t.x2 + 2) - greatest(a.x1, t.x1 - 2)) * greatest(0, least(a.y2, t.y2 + 2) - greatest(a.y1, t.y1 - 2)) / greatest((a.x2 - a.x1) * (a.y2 - a.y1), 1) >= 0.3"


@_query(f"SELECT a.page, t.tile, a.ord FROM {{lines}} a JOIN {{tiles}} t ON a.page = t.page WHERE {_GROWN}")
def lines_in_tile(get):
    return spatial.lines_in_tiles(get("lines"), get("tiles"))


@_query(f"""WITH h AS (SELECT a.page, t.tile, a.ord, a.x1, a.y1, a.x2, a.y2, row_number() OVER (PARTITION BY a.page, a.x1, a.y1, a.x2, a.y2 ORDER BY t.tile, a.ord) AS k
                       FROM {{lines}} a JOIN {{tiles}} t ON a.page = t.page WHERE {_GROWN})
            SELECT page, ord, x1, y1, x2, y2 FROM h WHERE k = 1""")
def lines_in_any_tile(get):
    return spatial.lines_in_any_tile(get("lines"), get("tiles"))


@_query("""SELECT a.page, a.ord, coalesce(min(t.tile), -1) AS tile FROM {lines} a LEFT JOIN {tiles} t ON a.page = t.page
           AND (a.x1 + a.x2) / 2 BETWEEN t.x1 - 2 AND t.x2 + 2 AND (a.y1 + a.y2) / 2 BETWEEN t.y1 - 2 AND t.y2 + 2 GROUP BY a.page, a.ord""")
def tile_assign_lines(get):
    return spatial.assigned_tiles(get("lines"), get("tiles"))


@_query("""SELECT page, supp, arg_min(x1, ord) AS x1, arg_min(y1, ord) AS y1, arg_min(x2, ord) AS x2, arg_min(y2, ord) AS y2 FROM {boxes} WHERE part % 3 > 0 GROUP BY page, supp""")
def first_bbox_of_crop(get):
    some = get("boxes").withColumn("x1", F.when(F.col("part") % 3 > 0, F.col("x1")))
    return spatial.first_box(some, ("page", "supp"))


def _painted(get) -> DataFrame:
    return get("boxes").select("page", "ord", F.when(F.col("part") % 4 == 0, "exclude").otherwise("panel").alias("kind"), *CORNERS)


def _edges(axis: str) -> str:
    return f"""{axis}s AS (SELECT page, {axis}, lead({axis}) OVER (PARTITION BY page ORDER BY {axis}) AS upto FROM (SELECT page, {axis}1 AS {axis} FROM p UNION SELECT page, {axis}2 FROM p) e)"""


@_query(f"""WITH p AS (SELECT page, ord, part % 4 = 0 AS cut, x1, y1, x2, y2 FROM {{boxes}}), {_edges('x')}, {_edges('y')},
            l AS (SELECT p.page, (xs.upto - x) * (ys.upto - y) AS a, arg_max(cut, ord) AS cut FROM p JOIN xs ON p.page = xs.page AND x >= x1 AND x < x2
                  JOIN ys ON p.page = ys.page AND y >= y1 AND y < y2 GROUP BY p.page, x, y, xs.upto, ys.upto)
            SELECT p.page, CAST(coalesce((SELECT sum(a) FROM l WHERE l.page = p.page AND NOT l.cut), 0) AS BIGINT) AS area FROM (SELECT DISTINCT page FROM p) p""")
def exact_union_coverage(get):
    return spatial.painted_area(_painted(get))


# ── ruling lines ────────────────────────────────────────────────────────────────────────────────────────────────────────────

_CLUSTERED = """c AS (SELECT page, axis, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY page, axis ORDER BY pos) > 25 THEN 1 ELSE 0 END AS j FROM {segments}),
    i AS (SELECT page, axis, pos, sum(j) OVER (PARTITION BY page, axis ORDER BY pos RANGE UNBOUNDED PRECEDING) AS chain FROM c),
    m AS (SELECT page, axis, chain, CAST(round_even(avg(pos), 0) AS BIGINT) AS line FROM i GROUP BY page, axis, chain),
    lines0 AS (SELECT m.page, m.axis, m.line AS pos, min(s.s0) AS span_min, max(s.s1) AS span_max, CAST(round_even(avg(s.s1 - s.s0), 0) AS BIGINT) AS avg_len
       FROM m JOIN {segments} s ON s.page = m.page AND s.axis = m.axis AND abs(s.pos - m.line) <= 25 GROUP BY m.page, m.axis, m.chain, m.line
       HAVING count(*) >= 1 AND max(s.s1) - min(s.s0) >= 60 AND sum(s.s1 - s.s0) / greatest(max(s.s1) - min(s.s0), 1) >= 0.2 AND avg(s.s1 - s.s0) >= 12)"""


def _lines(get) -> DataFrame:
    return rulings.clustered(get("segments"), 25, 1, 60)


@_query(f"WITH {_CLUSTERED} SELECT * FROM lines0")
def line_cluster_islands(get):
    return _lines(get)


_STRETCHES = """k AS (SELECT l.page, l.axis, l.pos, s.s0, s.s1 FROM lines0 l JOIN {segments} s ON s.page = l.page AND s.axis = l.axis AND abs(s.pos - l.pos) <= 25 WHERE s.s1 - s.s0 >= 4),
    k1 AS (SELECT *, max(s1) OVER (PARTITION BY page, axis, pos ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM k),
    k2 AS (SELECT *, sum(CASE WHEN s0 <= b + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY page, axis, pos ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS isl FROM k1),
    st AS (SELECT page, axis, pos, min(s0) AS s0, max(s1) AS s1 FROM k2 GROUP BY page, axis, pos, isl)"""


@_query(f"WITH {_CLUSTERED}, {_STRETCHES} SELECT * FROM st")
def interval_merge(get):
    return rulings.merged_intervals(get("segments"), _lines(get))


_ONE = "{'pos': o.pos, 'span_min': o.span_min, 'span_max': o.span_max, 'avg_len': o.avg_len}"


@_query(
    f"WITH RECURSIVE {_CLUSTERED}, o AS (SELECT *, row_number() OVER (PARTITION BY page, axis ORDER BY pos, span_min, span_max, avg_len) AS r FROM lines0),"
    f" f AS (SELECT page, axis, r, [{_ONE}] AS kept FROM o WHERE r = 1 UNION ALL"
    f" SELECT f.page, f.axis, o.r, CASE WHEN o.pos - f.kept[-1].pos >= 60 THEN list_append(f.kept, {_ONE})"
    f" WHEN o.span_max - o.span_min > f.kept[-1].span_max - f.kept[-1].span_min OR (o.span_max - o.span_min = f.kept[-1].span_max - f.kept[-1].span_min AND o.avg_len > f.kept[-1].avg_len)"
    f" THEN list_append(list_slice(f.kept, 1, len(f.kept) - 1), {_ONE}) ELSE f.kept END FROM f JOIN o ON f.page = o.page AND f.axis = o.axis AND o.r = f.r + 1),"
    " z AS (SELECT page, axis, kept FROM f QUALIFY row_number() OVER (PARTITION BY page, axis ORDER BY r DESC) = 1)"
    " SELECT page, axis, k.pos AS pos, k.span_min AS span_min, k.span_max AS span_max, k.avg_len AS avg_len FROM (SELECT page, axis, unnest(kept) AS k FROM z) t"
)
def prune_close_lines(get):
    return rulings.pruned(_lines(get), 60)


@_query(f"WITH {_CLUSTERED} SELECT * FROM lines0 WHERE avg_len >= 200")
def drop_fragmented(get):
    return rulings.without_fragmented(_lines(get))


@_query(f"""WITH {_CLUSTERED}, l AS (SELECT *, CASE axis WHEN 'h' THEN 500 ELSE 400 END AS along, CASE axis WHEN 'h' THEN 400 ELSE 500 END AS across FROM lines0)
            SELECT page, axis, pos, span_min, span_max, avg_len FROM l
            WHERE NOT (span_max - span_min >= 0.9 * along AND (pos / greatest(across, 1) <= CASE axis WHEN 'h' THEN 0.03 ELSE 0.08 END OR pos / greatest(across, 1) >= 1 - CASE axis WHEN 'h' THEN 0.03 ELSE 0.08 END))""")
def drop_frame_like(get):
    return rulings.without_frame(_lines(get), get("pages").select("page", F.lit(500).alias("w"), F.lit(400).alias("h")))


_TWIN = "a.page = b.page AND a.axis = b.axis AND a.pos <> b.pos"
_SHARED = "greatest(0, least(a.span_max, b.span_max) - greatest(a.span_min, b.span_min)) / greatest(1, a.span_max - a.span_min)"


@_query(f"""WITH {_CLUSTERED} SELECT a.* FROM lines0 a WHERE NOT EXISTS (SELECT 1 FROM lines0 b WHERE {_TWIN} AND a.avg_len >= 400 AND abs(a.pos - b.pos) <= 70 AND b.avg_len <= 350 AND {_SHARED} >= 0.55)""")
def drop_thick_parallel(get):
    return rulings.without_thick(_lines(get), 70, 0.55, 400, 350)


@_query(f"""WITH {_CLUSTERED} SELECT a.* FROM lines0 a WHERE NOT EXISTS (SELECT 1 FROM lines0 b WHERE {_TWIN} AND a.axis = 'v' AND a.pos BETWEEN 0.45 * {PAGE_W} AND 0.65 * {PAGE_W}
            AND a.avg_len >= 700 AND abs(a.pos - b.pos) <= 60 AND {_SHARED} >= 0.5 AND b.avg_len <= 200)""")
def drop_thick_middle_vertical(get):
    return rulings.without_thick_middle(_lines(get), get("pages"))


@_query("""WITH p AS (SELECT page, axis, pos, row_number() OVER (PARTITION BY page, axis ORDER BY pos) AS r FROM (SELECT DISTINCT page, axis, CASE WHEN page % 3 = 0 THEN pos // 100 * 100 ELSE pos END AS pos FROM {segments}) d),
           g AS (SELECT page, axis, pos, r, lead(pos) OVER (PARTITION BY page, axis ORDER BY pos) - pos AS gap FROM p),
           w AS (SELECT page, axis, r, list(gap) OVER (PARTITION BY page, axis ORDER BY r ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS gs0 FROM g),
           v AS (SELECT page, axis, r, list_filter(gs0, lambda x: x IS NOT NULL) AS gs FROM w),
           b AS (SELECT page, axis, r, len(gs) AS n FROM v WHERE len(gs) >= 4 AND list_avg(gs) > 0 AND len(list_filter(gs, lambda x: abs(x - list_avg(gs)) / list_avg(gs) >= 0.2)) = 0)
           SELECT p.page, p.axis, p.pos FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = p.page AND b.axis = p.axis AND p.r BETWEEN b.r AND b.r + b.n)""")
def drop_repetitive_lines(get):
    pos = F.when(F.col("page") % 3 == 0, F.floor(F.col("pos") / 100) * 100).otherwise(F.col("pos"))
    return rulings.without_repetitive(get("segments").select("page", "axis", pos.alias("pos")).distinct())


@_query()
def structural_boundaries(get):
    return rulings.structural(_lines(get), get("pages").select("page", F.lit(900).alias("w"), F.lit(900).alias("h")))


_SEEDS = "(SELECT page, ord AS id, 'h' AS axis, CASE WHEN part % 2 = 0 THEN 1 ELSE -1 END AS side, y1 AS pos, x1 AS orth, greatest(0, x1 - 20) AS r0, x1 + 20 AS r1 FROM {boxes})"


def _seeds(get) -> DataFrame:
    return get("boxes").select(
        "page", F.col("ord").alias("id"), F.lit("h").alias("axis"), F.when(F.col("part") % 2 == 0, 1).otherwise(-1).alias("side"), F.col("y1").alias("pos"),
        F.col("x1").alias("orth"), F.greatest(F.lit(0), F.col("x1") - 20).alias("r0"), (F.col("x1") + 20).alias("r1"),
    )


@_query(f"""WITH {_CLUSTERED}, {_STRETCHES}, cand AS (SELECT s.page, s.id, s.axis, s.side, l.pos AS line, abs(l.pos - s.pos) AS far,
                 max(CASE WHEN t.s0 - 5 <= s.orth AND s.orth <= t.s1 + 5 THEN 3.0 WHEN t.s1 >= s.r0 AND t.s0 <= s.r1 THEN 2.0 ELSE 0.5 END) AS sup
               FROM {_SEEDS} s JOIN (SELECT DISTINCT page, axis, pos FROM lines0) l ON s.page = l.page AND s.axis = l.axis AND s.side * (l.pos - s.pos) > 0
               JOIN st t ON t.page = l.page AND t.axis = l.axis AND abs(t.pos - l.pos) <= 2 GROUP BY ALL)
            SELECT page, id, axis, side, line FROM cand QUALIFY row_number() OVER (PARTITION BY page, id, axis, side ORDER BY far, -sup, line) = 1""")
def nearest_boundary(get):
    lines = _lines(get)
    return rulings.nearest_lines(_seeds(get), lines, rulings.merged_intervals(get("segments"), lines))


@_query(f"""WITH {_CLUSTERED}, {_STRETCHES}, cand AS (SELECT s.page, s.id, s.axis, s.side, l.pos AS line, abs(l.pos - s.pos) AS far, sum(greatest(0, least(t.s1, s.r1) - greatest(t.s0, s.r0))) AS cov, max(s.r1 - s.r0) AS len
               FROM {_SEEDS} s JOIN (SELECT DISTINCT page, axis, pos FROM lines0) l ON s.page = l.page AND s.axis = l.axis AND s.side * (l.pos - s.pos) > 0
               JOIN st t ON t.page = l.page AND t.axis = l.axis AND abs(t.pos - l.pos) <= 2 GROUP BY s.page, s.id, s.axis, s.side, l.pos, far)
            SELECT page, id, axis, side, line FROM cand WHERE cov >= greatest(10, 0.45 * greatest(1, len)) QUALIFY row_number() OVER (PARTITION BY page, id, axis, side ORDER BY far, line) = 1""")
def boundary_with_support(get):
    lines = _lines(get)
    return rulings.supported_line(_seeds(get), lines, rulings.merged_intervals(get("segments"), lines), least=10.0)


@_query(f"""WITH {_CLUSTERED}, {_STRETCHES} SELECT s.page, s.axis, s.id, s.pos, s.r0, s.r1, CAST(coalesce(sum(greatest(0, least(t.s1, s.r1) - greatest(t.s0, s.r0))), 0) AS BIGINT) AS length,
               coalesce(bool_or(t.s1 >= s.r0 AND t.s0 <= s.r1), false) AS touches, least(1.0, coalesce(sum(greatest(0, least(t.s1, s.r1) - greatest(t.s0, s.r0))), 0) / greatest(s.r1 - s.r0, 1)) AS ratio
            FROM {_SEEDS} s LEFT JOIN st t ON t.page = s.page AND t.axis = s.axis AND abs(t.pos - s.pos) <= 2 GROUP BY s.page, s.axis, s.id, s.pos, s.r0, s.r1""")
def segment_support(get):
    at = _seeds(get).select("page", "axis", "id", "pos", "r0", "r1")
    return rulings.support(rulings.merged_intervals(get("segments"), _lines(get)), at)


def _panel_seeds(get) -> DataFrame:
    return get("boxes").select("page", F.col("ord").alias("id"), F.concat(F.lit("P"), (F.col("ord") % 12).cast("string")).alias("name"), F.col("x1").alias("seed_x"), F.col("y1").alias("seed_y"))


_MOVED = lambda c, axis: f"coalesce((SELECT min(pos) FROM lines0 l WHERE l.page = s.page AND l.axis = '{axis}' AND pos > s.{c} AND pos - s.{c} < 50) + 50, s.{c})"
_SIDE = lambda f, axis, test: f"(SELECT {f}(pos) FROM live l WHERE l.page = s.page AND l.axis = '{axis}' AND pos {test})"


@_query(f"""WITH {_CLUSTERED}, {_STRETCHES}, live AS (SELECT DISTINCT page, axis, pos FROM lines0 l WHERE EXISTS (SELECT 1 FROM st t WHERE t.page = l.page AND t.axis = l.axis AND abs(t.pos - l.pos) <= 2)),
    m1 AS (SELECT s.page, s.ord AS id, concat('P', s.ord % 12) AS name, {_MOVED('x1', 'v')} AS sx, {_MOVED('y1', 'h')} AS sy FROM {{boxes}} s),
    p AS (SELECT s.*, coalesce({_SIDE('max', 'v', '< sx')}, 5) AS l, coalesce({_SIDE('min', 'v', '> sx')}, {PAGE_W} - 5) AS r, coalesce({_SIDE('max', 'h', '< sy')}, 5) AS t, coalesce({_SIDE('min', 'h', '> sy')}, {PAGE_H} - 5) AS b FROM m1 s)
    SELECT page, id, name, least(l, r) AS x1, least(t, b) AS y1, greatest(l, r) AS x2, greatest(t, b) AS y2, sx AS seed_x, sy AS seed_y FROM p""")
def panel_boundaries(get):
    lines = _lines(get)
    return rulings.panels_between(_panel_seeds(get), lines, rulings.merged_intervals(get("segments"), lines), get("pages"))


@_query()
def resolve_duplicate_panels(get):
    lines = _lines(get)
    panels = rulings.panels_between(_panel_seeds(get), lines, rulings.merged_intervals(get("segments"), lines), get("pages"))
    return rulings.shared_panels_split(panels, get("pages"))


# ── sequences ───────────────────────────────────────────────────────────────────────────────────────────────────────────────


@_query("""WITH RECURSIVE o AS (SELECT page, ord, y1, row_number() OVER (PARTITION BY page ORDER BY y1, ord) AS r FROM {lines}),
    f AS (SELECT page, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS y1, CAST([] AS BIGINT[]) AS firsts FROM (SELECT DISTINCT page FROM {lines}) p
      UNION ALL SELECT f.page, o.r, o.ord, o.y1, CASE WHEN len(list_filter(f.firsts, lambda x: abs(o.y1 - x) <= 40)) > 0 THEN f.firsts ELSE list_append(f.firsts, o.y1) END
      FROM f JOIN o ON f.page = o.page AND o.r = f.r + 1)
    SELECT page, ord, y1, CAST(list_position(list_transform(firsts, lambda x: abs(y1 - x) <= 40), true) - 1 AS BIGINT) AS cluster FROM f WHERE r > 0""")
def anchor_row_clusters(get):
    return rulings.anchor_clusters(get("lines"), "y1", 40)


def _swing(c: str) -> str:
    a, b = (f"lag({c}, {k}) OVER (PARTITION BY panel ORDER BY attempt)" for k in (2, 1))
    return f"coalesce(({b} > {a} AND {c} < {b}) OR ({b} < {a} AND {c} > {b}), false) AS {c}_frozen"


@_query(f"SELECT panel, attempt, {', '.join(map(_swing, CORNERS))} FROM {{attempts}}")
def oscillation_freeze(get):
    return rulings.frozen_axes(get("attempts")).select("panel", "attempt", *[f"{c}_frozen" for c in CORNERS])


@_query("""SELECT panel, attempt, wrong, x1, y1, x2, y2, CAST(CASE WHEN wrong = 0 THEN 0.95 ELSE greatest(0.3, 1 - 0.15 * wrong) END AS DOUBLE) AS confidence FROM {attempts}
           QUALIFY row_number() OVER (PARTITION BY panel ORDER BY wrong, attempt) = 1""")
def best_effort_attempt(get):
    return rulings.best_attempt(get("attempts"))


@_query("""WITH p AS (SELECT page, ord AS pos, CASE WHEN part % 3 > 0 THEN 1.0 ELSE 0.5 END AS share FROM {items}),
           r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS r, count(*) OVER (PARTITION BY page) AS n FROM p),
           i AS (SELECT page, pos, n, r - row_number() OVER (PARTITION BY page ORDER BY pos) AS isl FROM r WHERE share >= 0.99)
           SELECT page, min(pos) AS "start", max(pos) AS "end" FROM i GROUP BY page, isl, n HAVING count(*) >= 0.2 * n""")
def white_bands(get):
    profile = get("items").select("page", F.col("ord").alias("pos"), F.when(F.col("part") % 3 > 0, 1.0).otherwise(0.5).alias("share"))
    return rulings.white_bands(profile, least=0.2)


@_query("""WITH c AS (SELECT DISTINCT page AS run_id, part % 5 + 1 AS step FROM {items} WHERE supp % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS k FROM c)
           SELECT run_id, CAST(coalesce(max(step) FILTER (step = k), 0) AS BIGINT) AS resume_after FROM r GROUP BY run_id""")
def resume_point(get):
    return rulings.resume_point(get("items").where("supp % 3 = 0").select(F.col("page").alias("run_id"), (F.col("part") % 5 + 1).alias("step")))


# ── text ────────────────────────────────────────────────────────────────────────────────────────────────────────────────────

_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_ALPHA = f"regexp_replace({_NORM}, '[^a-z0-9]', '', 'g')"
_BARE = f"regexp_replace({_ALPHA}, '([a-z])0+([0-9])', '\\1\\2', 'g')"


@_query(f"SELECT page, ord, {_NORM.format('content')} AS normed, {_ALPHA.format('content')} AS alpha, {_BARE.format('content')} AS bare FROM {{lines}}")
def alphanum_norm(get):
    return matching.prepared(get("lines"), "content").select("page", "ord", "normed", "alpha", "bare")


_NL = "FROM n JOIN l ON n.page = l.page"
_FORMS = f"""n AS (SELECT page, ord, name, {_NORM.format('name')} AS normed, {_ALPHA.format('name')} AS alpha, {_BARE.format('name')} AS bare FROM {{names}}),
             l AS (SELECT page, ord, content, {_NORM.format('content')} AS normed, {_ALPHA.format('content')} AS alpha, {_BARE.format('content')} AS bare, x1, y1, x2, y2 FROM {{lines}})"""
_ALIKE = "least(length(n.bare), length(l.bare)) >= 3 AND (n.bare = l.bare OR translate(n.bare, 'oli', '011') = translate(l.bare, 'oli', '011'))"


def _forms(get) -> DataFrame:
    n, line = matching.prepared(get("names"), "name").alias("n"), matching.prepared(get("lines"), "content").alias("l")
    return n.join(line, F.col("n.page") == F.col("l.page"))


def _name_line(df: DataFrame) -> DataFrame:
    return df.select(F.col("n.page").alias("page"), F.col("n.name").alias("name"), F.col("l.ord").alias("line"))


@_query(f"WITH {_FORMS} SELECT n.page, n.name, l.ord AS line {_NL} WHERE {_ALIKE}")
def alphanum_similar(get):
    return _name_line(_forms(get).where(X.alike(F.col("n.bare"), F.col("l.bare"))))


def _diffs(a: str, b: str) -> str:
    return f"list_filter(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] <> {b}[i] THEN concat({a}[i], {b}[i]) END), lambda p: p IS NOT NULL)"


_CONFUSABLE = ", ".join(f"'{p}'" for p in X._both_ways(X.CONFUSED))


def _confused_sql(form: str, least: int, need: bool) -> str:
    a, b = f"n.{form}", f"l.{form}"
    d = "regexp_replace({0}, '[^0-9]', '', 'g')"
    more = f" AND {d.format(a)} <> ''" if need else ""
    return f"length({a}) >= {least} AND length({a}) = length({b}) AND {a} <> {b} AND {d.format(a)} = {d.format(b)}{more} AND len({_diffs(a, b)}) = 1 AND ({_diffs(a, b)})[1] IN ({_CONFUSABLE})"


@_query(f"WITH {_FORMS} SELECT n.page, n.name, l.ord AS line {_NL} WHERE {_confused_sql('alpha', 4, True)}")
def ocr_dist1(get):
    return _name_line(_forms(get).where(X.confused(F.col("n.alpha"), F.col("l.alpha"))))


@_query(f"WITH {_FORMS} SELECT n.page, n.name, l.ord AS line {_NL} WHERE {_confused_sql('bare', 3, False)}")
def ocr_dist1_without_zeros(get):
    return _name_line(_forms(get).where(X.confused(F.col("n.bare"), F.col("l.bare"), 3, False)))


_ALONE = r"regexp_matches(l.normed, concat('(^|[^a-z0-9-])', n.normed, '($|[^a-z0-9-])'))"


@_query(f"WITH {_FORMS} SELECT n.page, n.name, l.ord AS line {_NL} WHERE {_ALONE}")
def boundary_match(get):
    return _name_line(_forms(get).where(X.stands_alone(F.col("n.normed"), F.col("l.normed"))))


_SER = r"regexp_extract({0}, '^(.*?)(\d+)([a-z]*)$', {1})"


@_query(f"""WITH {_FORMS} SELECT page, ord, {_SER.format('normed', 1)} AS prefix, CAST({_SER.format('normed', 2)} AS BIGINT) AS number, {_SER.format('normed', 3)} AS suffix FROM l
            WHERE regexp_matches(normed, '^.*\\d+[a-z]*$')""")
def parse_serial(get):
    own = matching.prepared(get("lines"), "content").withColumn("s", X.serial(F.col("normed")))
    return own.where("s is not null").select("page", "ord", "s.*")


@_query(r"""SELECT page, ord, content FROM {lines} WHERE NOT (
    regexp_matches(content, '(?i)VCB|REACTOR|CT[x×]\d+|\d+\s*/\s*\d+\s*A\b|ZCT|MCCB|QPTR|CAPACITOR|\bFROM\b|\bTO\b|VOLTAGE|DETECTOR|LED|ALARM|\bSEE\b')
    OR regexp_matches(content, '(?i)(^|[^A-Za-z0-9_-])\d+\s*A\b') OR regexp_matches(content, '\d+(\.\d+)?\s*%'))""")
def noise_line_filter(get):
    return matching.without_noise(get("lines")).select("page", "ord", "content")


@_query(r"SELECT page, ord FROM {lines} WHERE regexp_matches(content, '(?i)\b(from|to|ref|see|via|cable)\b')")
def cross_reference_lines(get):
    return get("lines").where(X.is_cross_reference(F.col("content"))).select("page", "ord")


_REPLY = """CASE part % 5 WHEN 0 THEN concat('{"panel_names": ["A', supp, '", " B"], "extractable": true}')
    WHEN 1 THEN concat('```json', chr(10), '["C', supp, '", "D"]', chr(10), '```') WHEN 2 THEN concat('Here you are: {"names": ["E', supp, '"]} done') WHEN 3 THEN 'sorry, none' ELSE '{"extractable": false, "names": ["X"]}' END"""


def _replies(get) -> DataFrame:
    return get("items").select("page", F.col("ord").alias("tile"), "part", "supp", F.expr(_REPLY.replace("chr(10)", "char(10)")).alias("reply"))


@_query("""SELECT page, ord AS tile, part % 5 <> 3 AS parses, CASE part % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 1 END AS n FROM {items}""")
def json_lenient(get):
    json = X.json_text(F.col("reply"))
    names = X.first_list(json, replies.NAME_KEYS)
    return _replies(get).select("page", "tile", json.isNotNull().alias("parses"), F.when(names.isNotNull(), F.size(names)).alias("n"))


@_query("""WITH t AS (SELECT page, ord, CASE part % 5 WHEN 0 THEN [concat('A', supp), ' B'] WHEN 1 THEN [concat('C', supp), 'D'] WHEN 2 THEN [concat('E', supp)] END AS ns FROM {items}),
           u AS (SELECT page, ord, ns, unnest(range(len(ns))) AS i FROM t WHERE ns IS NOT NULL) SELECT page, CAST(ord * 100000 + i AS BIGINT) AS ord, ns[i + 1] AS name FROM u""")
def tile_names_from_replies(get):
    return replies.tile_names(_replies(get))


@_query(r"SELECT page, ord, CASE WHEN length(regexp_replace(content, '[^\w\-.]+', '_', 'g')) > 0 THEN regexp_replace(content, '[^\w\-.]+', '_', 'g') ELSE 'panel' END AS safe FROM {lines}")
def safe_name(get):
    return get("lines").select("page", "ord", X.safe_name(F.col("content")).alias("safe"))


@_query("SELECT page, ord, CASE WHEN part % 500 < 60 THEN printf('%.1fs', (part % 500) * 1.0) ELSE concat(part % 500 // 60, 'm ', part % 500 % 60, 's') END AS shown, [supp % 256, line * 7, part % 256] AS bgr FROM {items}")
def shown_values(get):
    """Elapsed times, and colours from hexadecimal text."""
    color = F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (F.col("part") % 256, F.col("line") * 7, F.col("supp") % 256)])
    bgr = F.transform(X.hex_to_bgr(color), lambda v: v.cast("long"))
    return get("items").select("page", "ord", X.elapsed((F.col("part") % 500).cast("double")).alias("shown"), bgr.alias("bgr"))


# ── names ───────────────────────────────────────────────────────────────────────────────────────────────────────────────────


@_query("SELECT page, min(ord) AS ord, trim(content) AS name FROM {lines} WHERE length(trim(content)) > 0 GROUP BY page, trim(content)")
def ordered_distinct(get):
    return matching.ordered_distinct(get("lines").select("page", "ord", F.col("content").alias("name")))


@_query(f"""WITH {_FORMS} SELECT n.page, n.ord, n.name FROM n WHERE EXISTS (SELECT 1 FROM l WHERE l.page = n.page AND l.ord % 4 = 0 AND length(l.alpha) > 0 AND (contains(l.alpha, n.alpha) OR contains(n.alpha, l.alpha)
            OR (length(n.alpha) >= 3 AND length(n.alpha) = length(l.alpha) AND len({_diffs('n.alpha', 'l.alpha')}) <= 1)))""")
def name_guard_semi(get):
    return matching.seen_in_text(get("names"), get("lines").where("ord % 4 = 0"))


_GN = r"regexp_replace(regexp_replace(upper(regexp_replace({0}, '[\s\-]', '', 'g')), '(^|[^0-9])0+([0-9])', '\1\2', 'g'), '^$', '')"


@_query(rf"""WITH c AS (SELECT page, {_GN.format('name')} AS g, upper(regexp_replace(name, '[\s_-]', '', 'g')) AS w FROM {{names}} WHERE ord % 2 = 0),
             o AS (SELECT page, ord, name, {_GN.format('name')} AS g, upper(regexp_replace(name, '[\s_-]', '', 'g')) AS w FROM {{names}})
             SELECT o.page, o.ord, o.name FROM o WHERE EXISTS (SELECT 1 FROM c WHERE c.page = o.page AND (c.g = o.g OR (length(c.w) = length(o.w) AND len({_diffs('o.w', 'c.w')}) = 1
               AND ({_diffs('o.w', 'c.w')})[1] IN ({', '.join(f"'{p}', '{p[::-1]}'" for p in X.GUARD_PAIRS)}))))""")
def dedup_guard(get):
    return matching.traceable(get("names"), get("names").where("ord % 2 = 0"))


@_query()
def series_gap_fill(get):
    return matching.series_gaps_filled(get("labels_of").select("page", "ord", "name"))


_SUFFIXED = "(SELECT page, ord, CASE WHEN supp % 4 = 0 THEN concat(name, ' (UPPER)') WHEN supp % 4 = 1 THEN concat(name, '(lower)') ELSE name END AS name FROM {labels_of})"


@_query(rf"""SELECT s.page, s.ord, s.name FROM {_SUFFIXED} s WHERE NOT EXISTS (SELECT 1 FROM {_SUFFIXED} t WHERE t.page = s.page AND regexp_matches(t.name, '(?i)\((upper|lower)\)$')
             AND trim(regexp_replace(t.name, '(?i)\s*\((upper|lower)\)$', '')) = s.name)""")
def suffix_supersede(get):
    name = F.when(F.col("supp") % 4 == 0, F.concat("name", F.lit(" (UPPER)"))).when(F.col("supp") % 4 == 1, F.concat("name", F.lit("(lower)"))).otherwise(F.col("name"))
    return matching.superseded(get("labels_of").select("page", "ord", name.alias("name")))


@_query(r"""SELECT DISTINCT n.page, regexp_extract(trim(l.content), concat('(?i)([A-Z0-9][-A-Z0-9]*[-_ ]', n.name, ')(?:\s|$)'), 1) AS name FROM {names} n JOIN {lines} l ON n.page = l.page
            WHERE regexp_matches(trim(l.content), concat('(?i)[A-Z0-9][-A-Z0-9]*[-_ ]', n.name, '(?:\s|$)'))
            AND NOT EXISTS (SELECT 1 FROM {names} m WHERE m.page = n.page AND m.name = regexp_extract(trim(l.content), concat('(?i)([A-Z0-9][-A-Z0-9]*[-_ ]', n.name, ')(?:\s|$)'), 1))""")
def name_supplement(get):
    return matching.supplemented(get("names"), get("lines"))


# ── matching ────────────────────────────────────────────────────────────────────────────────────────────────────────────────

_SIMPLE = ", ".join(f"'{p}', '{p[::-1]}'" for p in matching._SIMPLE_PAIRS)
_FIRST = f"""{_FORMS}, rl AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, x1, ord) AS place FROM l),
    mg AS (SELECT a.page, a.place, k, list(b.content ORDER BY b.place) AS src, min(b.x1) AS x1, min(b.y1) AS y1, max(b.x2) AS x2, max(b.y2) AS y2, count(*) AS c
           FROM rl a, (SELECT unnest([2, 3, 4]) AS k) t, rl b WHERE a.page = b.page AND b.place >= a.place AND b.place < a.place + k GROUP BY a.page, a.place, k HAVING count(*) = k),
    mf AS (SELECT *, {_BARE.format("list_aggregate(src, 'string_agg', ' ')")} AS bare FROM mg),
    hits AS (SELECT n.page, n.name, n.ord AS name_ord, l.ord, [l.content] AS source, l.x1, l.y1, l.x2, l.y2,
               CASE WHEN n.normed = l.normed THEN 0 WHEN {_ALIKE} THEN 1 WHEN length(n.alpha) >= 3 AND length(l.alpha) > 0 AND (contains(l.alpha, n.alpha) OR contains(n.alpha, l.alpha)) THEN 2
                    WHEN length(n.alpha) >= 4 AND length(n.alpha) = length(l.alpha) AND len({_diffs('n.alpha', 'l.alpha')}) = 1 AND ({_diffs('n.alpha', 'l.alpha')})[1] IN ({_SIMPLE}) THEN 4 END AS pass {_NL}
             UNION ALL SELECT n.page, n.name, n.ord, l.place * 100 + l.k, l.src, l.x1, l.y1, l.x2, l.y2, 3 FROM n JOIN mf l ON n.page = l.page WHERE {_ALIKE}),
    best AS (SELECT * FROM (SELECT *, min(pass) OVER (PARTITION BY page, name) AS f FROM hits WHERE pass IS NOT NULL) q WHERE pass = f),
    fp AS (SELECT page, name, name_ord, CAST(ord AS BIGINT) AS ord, ['exact', 'alphanum', 'substring', 'multi_line_merge', 'ocr_similar'][pass + 1] AS method, CAST([1.0, 0.9, 0.75, 0.7, 0.6][pass + 1] AS DOUBLE) AS confidence, source, x1, y1, x2, y2 FROM best)"""


def _first_pass(get) -> DataFrame:
    return matching.first_pass_matches(get("names"), get("lines"))


@_query(f"WITH {_FIRST} SELECT page, name, ord, method, confidence, list_aggregate(source, 'string_agg', '|') AS source, x1, y1, x2, y2 FROM fp")
def match_passes_a(get):
    return _first_pass(get).withColumn("source", F.array_join("source", "|")).drop("name_ord")


@_query(f"""WITH {_FIRST}, top AS (SELECT *, row_number() OVER (PARTITION BY page, name ORDER BY confidence DESC, ord) AS k FROM fp),
    claim AS (SELECT *, row_number() OVER (PARTITION BY page, x1, y1, x2, y2 ORDER BY confidence DESC, name_ord) AS c FROM top WHERE k = 1),
    rest AS (SELECT t.*, row_number() OVER (PARTITION BY t.page, t.name ORDER BY t.confidence DESC, t.ord) AS c FROM fp t JOIN claim l ON l.c > 1 AND l.page = t.page AND l.name = t.name
             AND NOT (t.x1 = l.x1 AND t.y1 = l.y1 AND t.x2 = l.x2 AND t.y2 = l.y2))
    SELECT page, name, ord, method, x1, y1, x2, y2 FROM claim WHERE c = 1 UNION ALL SELECT page, name, ord, method, x1, y1, x2, y2 FROM rest WHERE c = 1""")
def resolve_conflicts_a(get):
    resolved = lambda names, lines: matching.best_without_conflict(matching.first_pass_matches(names, lines)).select("page", "name", "ord", "method", *CORNERS)
    return in_slices(resolved, get("names"), get("lines"))


def _all_hits(get) -> DataFrame:
    return matching.all_pass_matches(get("names"), get("lines"))


_NEAR = """{1}.y1 - {0}.y2 <= greatest({0}.y2 - {0}.y1, 1) * 2.5 AND greatest(0, least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1) + 2) / greatest({0}.x2 - {0}.x1, {1}.x2 - {1}.x1, 1) >= 0.25"""
_AROUND = lambda *a: ", ".join(f"{f}({', '.join(f'{x}.{c}' for x in a)}) AS {c}" for f, c in zip(("least", "least", "greatest", "greatest"), CORNERS))
_IN = "contains({1}.normed, {0}.normed) AND regexp_matches({1}.normed, concat('(^|[^a-z0-9-])', {0}.normed, '($|[^a-z0-9-])'))"
_SAME_SERIAL = f"""CAST(nullif({_SER.format('n.normed', 2)}, '') AS BIGINT) >= 10 AND CAST(nullif({_SER.format('n.normed', 2)}, '') AS BIGINT) = CAST(nullif({_SER.format('l.normed', 2)}, '') AS BIGINT)
    AND {_SER.format('n.normed', 3)} = {_SER.format('l.normed', 3)}
    AND abs(length(regexp_replace({_SER.format('n.normed', 1)}, '[^a-z0-9]', '', 'g')) - length(regexp_replace({_SER.format('l.normed', 1)}, '[^a-z0-9]', '', 'g'))) <= 2"""
#: All hits as ``ah``: what fits, in order, and whether it counts, with the boxes and lines that have counted carried along.
_ALL = f"""WITH RECURSIVE {_FORMS}, rl AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, x1, ord) AS place FROM l),
    m AS (SELECT a.page, a.place, 2 AS n, [a.ord, b.ord] AS lines, concat(a.normed, ' ', b.normed) AS normed, {_AROUND('a', 'b')} FROM rl a JOIN rl b ON a.page = b.page AND b.place = a.place + 1 WHERE {_NEAR.format('a', 'b')}
          UNION ALL SELECT a.page, a.place, 3, [a.ord, b.ord, c.ord], concat(a.normed, ' ', b.normed, ' ', c.normed), {_AROUND('a', 'b', 'c')} FROM rl a JOIN rl b ON a.page = b.page AND b.place = a.place + 1
          JOIN rl c ON a.page = c.page AND c.place = a.place + 2 WHERE {_NEAR.format('a', 'b')} AND {_NEAR.format('b', 'c')}),
    mb AS (SELECT *, {_BARE.format('normed')} AS bare FROM m),
    sg AS (SELECT n.page, n.name, n.ord AS name_ord, l.ord, l.place, l.x1, l.y1, l.x2, l.y2, CASE WHEN n.normed = l.normed OR ({_IN.format('n', 'l')}) THEN 1 WHEN {_ALIKE} THEN 2
             WHEN list_has_all(string_split(l.normed, ' '), string_split(n.normed, ' ')) THEN 3 WHEN {_confused_sql('alpha', 4, True)} THEN 4 WHEN {_confused_sql('bare', 3, False)} THEN 5
             WHEN {_SAME_SERIAL} THEN 6 END AS pass FROM n JOIN rl l ON n.page = l.page),
    ev AS (SELECT page, name, name_ord, pass, CASE WHEN pass = 3 THEN place ELSE ord END AS spot, 1 AS n, ['rule-single', 'rule-alphanum', 'rule-token', 'rule-ocr-sub', 'rule-ocr-sub-lz', 'rule-serial-num'][pass] AS method,
             [ord] AS lines, x1, y1, x2, y2 FROM sg WHERE pass IS NOT NULL
           UNION ALL SELECT n.page, n.name, n.ord, 3, l.place, l.n, concat('rule-merge', l.n), l.lines, l.x1, l.y1, l.x2, l.y2 FROM n JOIN mb l ON n.page = l.page
             WHERE list_has_all(string_split(l.normed, ' '), string_split(n.normed, ' ')) OR ({_IN.format('n', 'l')}) OR ({_IN.format('l', 'n')}) OR ({_ALIKE})),
    oe AS (SELECT *, concat_ws(',', x1, y1, x2, y2) AS box, row_number() OVER (PARTITION BY page, name, name_ord ORDER BY pass, spot, n) AS k FROM ev),
    f AS (SELECT page, name, name_ord, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS boxes, CAST([] AS BIGINT[]) AS taken, false AS counts FROM (SELECT DISTINCT page, name, name_ord FROM oe) q
      UNION ALL SELECT f.page, f.name, f.name_ord, oe.k, CASE WHEN out THEN f.boxes ELSE list_append(f.boxes, box) END, CASE WHEN out OR n > 1 THEN f.taken ELSE list_append(f.taken, lines[1]) END, NOT out
      FROM f JOIN oe ON f.page = oe.page AND f.name = oe.name AND f.name_ord = oe.name_ord AND oe.k = f.k + 1, LATERAL (SELECT list_contains(f.boxes, oe.box) OR list_has_any(f.taken, oe.lines) AS out) t),
    ah AS (SELECT oe.page, oe.name, oe.name_ord, method, lines, x1, y1, x2, y2, row_number() OVER (PARTITION BY oe.page, oe.name, oe.name_ord ORDER BY oe.k) - 1 AS hit_ord
           FROM oe JOIN f ON f.page = oe.page AND f.name = oe.name AND f.name_ord = oe.name_ord AND f.k = oe.k WHERE f.counts)"""


@_query(f"{_ALL} SELECT page, name, name_ord, method, list_aggregate(list_transform(lines, lambda v: CAST(v AS VARCHAR)), 'string_agg', ',') AS lines, x1, y1, x2, y2, hit_ord FROM ah")
def match_all_passes_b(get):
    return _all_hits(get).withColumn("lines", F.array_join("lines", ","))


def _hits_and_texts(get) -> tuple[DataFrame, DataFrame]:
    """All hits, written once as both are read, and the text of each: the contents of its lines."""
    from .extraction import texts_of

    hits = keep(_all_hits(get), "hits")
    return hits, texts_of(hits, get("lines"))


_FOUND = f"""{_ALL}, ht AS (SELECT h.*, (SELECT string_agg(l.content, ' ' ORDER BY list_position(h.lines, l.ord)) FROM l WHERE l.page = h.page AND list_contains(h.lines, l.ord)) AS found FROM ah h),
    sc AS (SELECT *, {_ALPHA.format('name')} AS na, {_ALPHA.format('found')} AS fa FROM ht)"""
_RANKED = "CASE method " + " ".join(f"WHEN '{m}' THEN {r}" for m, r in matching.METHOD_RANK.items()) + " ELSE 5 END"


@_query(f"""{_FOUND}, wn AS (SELECT page, x1, y1, x2, y2, name FROM sc QUALIFY row_number() OVER (PARTITION BY page, x1, y1, x2, y2 ORDER BY CASE WHEN na <> fa THEN 1 ELSE 0 END, {_RANKED}, abs(length(na) - length(fa)), length(name), name) = 1)
            SELECT page, name, name_ord, method, list_aggregate(list_transform(lines, lambda v: CAST(v AS VARCHAR)), 'string_agg', ',') AS lines, x1, y1, x2, y2, hit_ord FROM ah JOIN wn USING (page, name, x1, y1, x2, y2)""")
def bbox_conflict_winner(get):
    hits, texts = _hits_and_texts(get)
    return matching.conflict_winners(hits, texts.drop("hit_ord")).withColumn("lines", F.array_join("lines", ","))


#: One winner for each box, on simple hits that SQL can make as well.
@_query(f"""WITH {_FORMS}, h AS (SELECT n.page, n.name, n.alpha AS na, l.alpha AS la, l.x1, l.y1, l.x2, l.y2, CASE WHEN n.normed = l.normed THEN 'rule-single' ELSE 'rule-alphanum' END AS method {_NL} WHERE n.normed = l.normed OR ({_ALIKE})),
    w AS (SELECT page, x1, y1, x2, y2, name FROM h QUALIFY row_number() OVER (PARTITION BY page, x1, y1, x2, y2 ORDER BY CASE WHEN na <> la THEN 1 ELSE 0 END, CASE method WHEN 'rule-single' THEN 0 ELSE 1 END, abs(length(na) - length(la)), length(name), name) = 1)
    SELECT DISTINCT h.page, h.name, h.method, h.x1, h.y1, h.x2, h.y2 FROM h JOIN w USING (page, name, x1, y1, x2, y2)""")
def bbox_conflict_winner_simple(get):
    both = _forms(get).where((F.col("n.normed") == F.col("l.normed")) | X.alike(F.col("n.bare"), F.col("l.bare")))
    method = F.when(F.col("n.normed") == F.col("l.normed"), "rule-single").otherwise("rule-alphanum")
    hits = both.select("n.page", "n.name", method.alias("method"), *[F.col(f"l.{c}").alias(c) for c in CORNERS], F.col("l.content").alias("found")).distinct()
    return matching.conflict_winners(hits.drop("found").distinct(), hits.select("page", "name", *CORNERS, "found")).distinct()


@_query(f"""{_FOUND}, q AS (SELECT *, count(*) OVER (PARTITION BY page, name) AS n, (y1 + y2) / 2 AS cy FROM ht),
    rf AS (SELECT page, x1 AS mx, (y1 + y2) / 2 AS my FROM {{lines}} WHERE regexp_matches(content, '(?i)\\b(from|to|ref|see|via|cable)\\b')),
    pn AS (SELECT q.page, q.name, q.hit_ord, CASE WHEN EXISTS (SELECT 1 FROM rf WHERE rf.page = q.page AND abs(my - cy) <= 20 AND abs(mx - q.x1) <= 300) THEN 100.0 ELSE 0.0 END
             + CASE WHEN regexp_matches(found, '(?i)\\b(from|to|ref|see|via|cable)\\b') THEN 100.0 ELSE 0.0 END + coalesce((SELECT min(abs(q.cy - o.cy)) FROM q o WHERE o.n = 1 AND o.page = q.page), 0.0) AS penalty FROM q WHERE n > 1),
    rk AS (SELECT *, row_number() OVER w AS k, lead(penalty) OVER w AS next FROM pn WINDOW w AS (PARTITION BY page, name ORDER BY penalty, hit_ord))
    SELECT page, name, hit_ord, CAST(0 AS DOUBLE) AS penalty, true AS clear FROM q WHERE n = 1 UNION ALL SELECT page, name, hit_ord, CAST(penalty AS DOUBLE), next - penalty >= 30 FROM rk WHERE k = 1""")
def multi_position(get):
    hits, texts = _hits_and_texts(get)
    return matching.single_positions(hits, get("lines"), texts.select("page", "name", "hit_ord", "found")).select("page", "name", "hit_ord", "penalty", "clear")


@_query(f"{_ALL} SELECT page, name, hit_ord, method, CAST(0.8 AS DOUBLE) AS confidence FROM ah WHERE hit_ord = 0")
def best_hit(get):
    return matching.first_hits(_all_hits(get)).select("page", "name", "hit_ord", "method", "confidence")


#: Names with a place of their own: the first line that reads like them.
def _matched(get) -> DataFrame:
    hit = _forms(get).where((F.col("n.alpha") == F.col("l.alpha")) & (F.col("n.ord") % 3 > 0))
    best = hit.groupBy(F.col("n.page").alias("page"), F.col("n.name").alias("name"), F.col("n.ord").alias("ord")).agg(F.min_by(F.struct(*[F.col(f"l.{c}").alias(c) for c in CORNERS]), F.col("l.ord")).alias("first"))
    return best.select("page", "ord", "name", "first.*")


_MATCHED = f"""{_FORMS}, mt AS (SELECT n.page, n.name, n.ord, n.normed, l.x1, l.y1, l.x2, l.y2 {_NL} AND n.alpha = l.alpha AND n.ord % 3 > 0 QUALIFY row_number() OVER (PARTITION BY n.page, n.name ORDER BY l.ord) = 1),
    pl AS (SELECT page, name, {_SER.format('normed', 1)} AS prefix, CAST({_SER.format('normed', 2)} AS BIGINT) AS number, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM mt)"""


@_query(f"WITH {_MATCHED} SELECT n.page, n.ord, n.name FROM n WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.page = n.page AND mt.name = n.name)")
def unmatched_anti(get):
    return matching.unmatched_names(get("names"), _matched(get))


@_query(f"""WITH {_MATCHED} SELECT page, prefix, count(*) AS n, round(avg(number), 6) AS mean_number, round(avg(cx), 6) AS mean_cx, round(avg(cy), 6) AS mean_cy,
            round(CASE WHEN var_pop(number) > 0 THEN covar_pop(cx, number) / var_pop(number) ELSE 0 END, 6) AS slope_cx, round(CASE WHEN var_pop(number) > 0 THEN covar_pop(cy, number) / var_pop(number) ELSE 0 END, 6) AS slope_cy
            FROM pl GROUP BY page, prefix""")
def serial_linreg(get):
    fit = matching.series_lines(_matched(get))
    return fit.select("page", "prefix", "n", *[F.round(c, 6).alias(c) for c in ("mean_number", "mean_cx", "mean_cy", "slope_cx", "slope_cy")])


def _placed_rows(order: str, tolerance: int) -> str:
    """``rw``: places with the row they fall into, by the first place of each row that is near enough."""
    near = f"abs(pr.cy - x) <= {tolerance}"
    return f"""WITH RECURSIVE {_MATCHED}, pr AS (SELECT *, row_number() OVER (PARTITION BY page, prefix ORDER BY {order}) AS r FROM pl),
    f AS (SELECT page, prefix, CAST(0 AS BIGINT) AS r, CAST([] AS DOUBLE[]) AS firsts FROM (SELECT DISTINCT page, prefix FROM pl) q
      UNION ALL SELECT f.page, f.prefix, pr.r, CASE WHEN len(list_filter(f.firsts, lambda x: {near})) > 0 THEN f.firsts ELSE list_append(f.firsts, pr.cy) END
      FROM f JOIN pr ON f.page = pr.page AND f.prefix = pr.prefix AND pr.r = f.r + 1),
    rw AS (SELECT pr.*, list_position(list_transform(f.firsts, lambda x: {near}), true) AS row FROM pr JOIN f ON f.page = pr.page AND f.prefix = pr.prefix AND f.r = pr.r)"""


@_query(f"""{_placed_rows('cy, number, cx', 40)}, ft AS (SELECT page, prefix, row, min(number) AS low, max(number) AS high, avg(number) AS mean, avg(cx) AS mx, avg(cy) AS my,
              CASE WHEN min(number) < max(number) THEN covar_pop(cx, number) / var_pop(number) ELSE 0 END AS sx, CASE WHEN min(number) < max(number) THEN covar_pop(cy, number) / var_pop(number) ELSE 0 END AS sy FROM rw GROUP BY page, prefix, row),
            ms AS (SELECT n.page, n.name, {_SER.format('n.normed', 1)} AS prefix, CAST({_SER.format('n.normed', 2)} AS BIGINT) AS number FROM n WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.page = n.page AND mt.name = n.name)),
            b AS (SELECT ms.page, ms.name, number, ft.* EXCLUDE (page, prefix) FROM ms JOIN ft ON ms.page = ft.page AND ms.prefix = ft.prefix
                  QUALIFY row_number() OVER (PARTITION BY ms.page, ms.name ORDER BY CASE WHEN number BETWEEN low AND high THEN 0 ELSE least(abs(number - low), abs(number - high)) END + high - low, row) = 1)
            SELECT page, name, round(CAST(mx + sx * (number - mean) AS DOUBLE), 6) AS cx, round(CAST(my + sy * (number - mean) AS DOUBLE), 6) AS cy FROM b""")
def serial_position_hints(get):
    matched = _matched(get)
    hints = matching.position_hints(matched, matching.unmatched_names(get("names"), matched))
    return hints.select("page", "name", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@_query(f"""{_placed_rows('cy, cx, name', 400)}, nx AS (SELECT *, lead(number) OVER w AS next, lead(name) OVER w AS next_name FROM rw WINDOW w AS (PARTITION BY page, prefix, row ORDER BY cx, name)),
            d AS (SELECT *, CASE WHEN coalesce(sum(CAST(next > number AS INTEGER)) OVER g, 0) >= coalesce(sum(CAST(next < number AS INTEGER)) OVER g, 0) THEN 1 ELSE -1 END AS direction FROM nx WINDOW g AS (PARTITION BY page, prefix, row))
            SELECT page, prefix, name, next_name, direction FROM d WHERE (direction = 1 AND next < number) OR (direction = -1 AND next > number)""")
def serial_inversions(get):
    return matching.inversions(_matched(get), 400)


@_query()
def serial_outliers(get):
    return matching.serial_outliers_corrected(_matched(get))


@_query()
def serial_gap_fill(get):
    matched = _matched(get)
    return matching.gaps_by_position(matched, matching.unmatched_names(get("names"), matched), get("lines"), 200, 150)


@_query(f"""WITH {_MATCHED}, um AS (SELECT n.page, n.name, {_SER.format('n.normed', 1)} AS prefix FROM n WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.page = n.page AND mt.name = n.name))
            SELECT DISTINCT u.page, u.name, l.ord FROM um u JOIN pl s ON u.page = s.page AND u.prefix = s.prefix JOIN l ON l.page = u.page
            WHERE abs((l.x1 + l.x2) / 2 - s.cx) <= 2 OR abs((l.y1 + l.y2) / 2 - s.cy) <= 2""")
def serial_align(get):
    matched = _matched(get)
    return matching.aligned_lines(matched, matching.unmatched_names(get("names"), matched), get("lines"))


#: Lines in reading order; of each, the lower ones that end its search or join it, in order; the lines that have been taken are carried along.
@_query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, x1, ord) AS r FROM {lines} v),
    cd AS (SELECT page, r, list({'j': j, 'ok': NOT far} ORDER BY j) AS c FROM (SELECT a.page, a.r, b.r AS j, b.y1 - a.y2 > 1.5 * (greatest(a.y2 - a.y1, 1) + greatest(b.y2 - b.y1, 1)) / 2 AS far,
             greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(a.x2 - a.x1, b.x2 - b.x1, 1) >= 0.3 AS wide FROM o a JOIN o b ON a.page = b.page AND b.r > a.r AND b.y1 >= a.y2 - 2) t WHERE far OR wide GROUP BY page, r),
    oc AS (SELECT o.page, o.r, coalesce(c, []) AS c FROM o LEFT JOIN cd ON o.page = cd.page AND o.r = cd.r),
    f AS (SELECT page, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS mate FROM (SELECT DISTINCT page FROM o) p
      UNION ALL SELECT f.page, oc.r, CASE WHEN one.ok AND NOT list_contains(f.used, oc.r) THEN list_append(f.used, one.j) ELSE f.used END, CASE WHEN one.ok AND NOT list_contains(f.used, oc.r) THEN one.j END
      FROM f JOIN oc ON f.page = oc.page AND oc.r = f.r + 1, LATERAL (SELECT list_filter(oc.c, lambda x: NOT list_contains(f.used, x.j))[1] AS one) t),
    z AS (SELECT page, unnest(used) AS r FROM (SELECT page, used FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY r DESC) = 1) q)
    SELECT a.page, a.ord, CASE WHEN b.page IS NULL THEN a.content ELSE concat(trim(a.content), ' ', trim(b.content)) END AS content, least(a.x1, coalesce(b.x1, a.x1)) AS x1, least(a.y1, coalesce(b.y1, a.y1)) AS y1,
           greatest(a.x2, coalesce(b.x2, a.x2)) AS x2, greatest(a.y2, coalesce(b.y2, a.y2)) AS y2, b.page IS NOT NULL AS merged
    FROM o a JOIN f ON f.page = a.page AND f.r = a.r LEFT JOIN o b ON b.page = f.page AND b.r = f.mate WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.page = a.page AND z.r = a.r)""")
def merge_split_lines(get):
    return matching.split_lines_merged(get("lines"))


@_query(f"""WITH w AS (SELECT page, ord, content, {_NORM.format("regexp_extract(content, '^[^0-9/]*')")} AS normed FROM {{lines}}), t AS (SELECT *, count(*) OVER (PARTITION BY page, normed) AS times FROM w),
            k AS (SELECT DISTINCT page, unnest(string_split({_NORM.format('name')}, ' ')) AS word FROM {{names}} WHERE ord % 5 = 0)
            SELECT t.page, t.ord, regexp_extract(content, '^[^0-9/]*') AS content FROM t WHERE times < 3 OR EXISTS (SELECT 1 FROM k WHERE k.page = t.page AND k.word = t.normed)""")
def freq_line_filter(get):
    short = get("lines").select("page", "ord", F.regexp_extract("content", "^[^0-9/]*", 0).alias("content"))
    return matching.without_frequent(short, get("names").where("ord % 5 = 0"), 3)


@_query("""WITH r AS (SELECT page, name, ord % 3 AS occurrence, [ord, ord + 2, 900] AS ix FROM {names}), u AS (SELECT page, name, occurrence, unnest(ix) AS place FROM r), l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord) AS place FROM {lines})
           SELECT u.page, u.name, u.occurrence, 'high' AS confidence, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM u JOIN l ON u.page = l.page AND u.place = l.place GROUP BY u.page, u.name, u.occurrence""")
def llm_match_replay(get):
    asked = get("names").select("page", "name", (F.col("ord") % 3).alias("occurrence"), F.array(F.col("ord"), F.col("ord") + 2, F.lit(900)).alias("line_indices"), F.lit("high").alias("confidence"))
    return matching.matched_by_model(asked, get("lines"))


# ── checks and tallies ──────────────────────────────────────────────────────────────────────────────────────────────────────


@_query(f"""SELECT b.page, b.ord, list_aggregate(list_filter([CASE WHEN s < 0.005 THEN 'too_small' END, CASE WHEN s > 0.8 THEN 'too_large' END, CASE WHEN n.x1 IS NOT NULL AND NOT (b.x1 <= n.x1 AND b.y1 <= n.y1 AND b.x2 >= n.x2 AND b.y2 >= n.y2) THEN 'name_outside' END,
                CASE WHEN greatest(b.x2 - b.x1, b.y2 - b.y1) > 5 * least(b.x2 - b.x1, b.y2 - b.y1) AND greatest(b.x2 - b.x1, b.y2 - b.y1) > 20 * least(b.x2 - b.x1, b.y2 - b.y1) THEN 'elongated' END], lambda v: v IS NOT NULL), 'string_agg', ',') AS issues
            FROM (SELECT *, (x2 - x1) * (y2 - y1) / ({PAGE_W} * {PAGE_H}) AS s FROM {{boxes}}) b LEFT JOIN (SELECT * FROM {{lines}} WHERE ord % 2 = 0) n ON b.page = n.page AND b.ord = n.ord""")
def validate_crop(get):
    joined = get("boxes").alias("b").join(get("lines").where("ord % 2 = 0").alias("n"), (F.col("b.page") == F.col("n.page")) & (F.col("b.ord") == F.col("n.ord")), "left")
    issues = validation.crop_issues(B.box(alias="b"), B.box(alias="n"), F.lit(PAGE_W), F.lit(PAGE_H))
    return joined.select("b.page", "b.ord", F.nullif(F.array_join(issues, ","), F.lit("")).alias("issues"))


@_query("""SELECT page, name, 'missing' AS status FROM (SELECT DISTINCT page, name FROM {names} WHERE ord % 2 = 0 EXCEPT SELECT page, name FROM {names} WHERE ord % 3 = 0) a
           UNION ALL SELECT page, name, 'extra' FROM (SELECT DISTINCT page, name FROM {names} WHERE ord % 3 = 0 EXCEPT SELECT page, name FROM {names} WHERE ord % 2 = 0) b""")
def name_coverage(get):
    key = lambda cond: get("names").where(cond).select("page", "name")
    return validation.name_coverage(key("ord % 2 = 0"), key("ord % 3 = 0"))


@_query("""SELECT p.page, count(b.page) AS n, CAST(coalesce(sum((b.x2 - b.x1) * (b.y2 - b.y1)), 0) AS BIGINT) AS covered, coalesce(sum((b.x2 - b.x1) * (b.y2 - b.y1)), 0) / max(p.w * p.h) AS coverage,
                  CASE WHEN count(b.page) = 0 THEN 'no_panels' WHEN coalesce(sum((b.x2 - b.x1) * (b.y2 - b.y1)), 0) / max(p.w * p.h) < 0.3 THEN 'low_coverage' END AS issue
           FROM {pages} p LEFT JOIN (SELECT * FROM {boxes} WHERE page % 9 > 0) b ON p.page = b.page GROUP BY p.page""")
def page_coverage(get):
    return validation.page_coverage(get("boxes").where("page % 9 > 0"), get("pages"))


@_query("""SELECT c.page, least(100.0, coalesce(sum((b.x2 - b.x1) * (b.y2 - b.y1)), 0) * 100.0 / max((c.x2 - c.x1) * (c.y2 - c.y1))) AS percent FROM {content} c LEFT JOIN {older} b ON c.page = b.page GROUP BY c.page""")
def existing_coverage(get):
    return validation.content_coverage(get("older"), get("content"))


_STATE = "(SELECT *, CASE WHEN part % 5 = 0 THEN 'pending' ELSE 'verified' END AS status, CAST(0.5 + (supp % 6) / 10.0 AS DOUBLE) AS confidence FROM {boxes})"


def _state(get) -> DataFrame:
    return get("boxes").withColumns({"status": F.when(F.col("part") % 5 == 0, "pending").otherwise("verified"), "confidence": F.lit(0.5) + (F.col("supp") % 6) / 10.0})


@_query(f"""WITH t AS (SELECT DISTINCT page, unnest([oa, ob]) AS ord FROM (SELECT a.page, a.ord AS oa, b.ord AS ob {_PAIR} WHERE {_IOU} > 0.15) q)
            SELECT s.page, s.ord, CASE WHEN status <> 'verified' THEN 'unverified' WHEN confidence < 0.7 THEN 'low_confidence' WHEN t.ord IS NOT NULL THEN 'overlap' END AS reason,
                   status <> 'verified' OR confidence < 0.7 OR t.ord IS NOT NULL AS needs_review FROM {_STATE} s LEFT JOIN t ON s.page = t.page AND s.ord = t.ord""")
def route_review(get):
    return validation.review_reasons(_state(get))


@_query(f"""SELECT s.page, s.ord, coalesce(a.x1, s.x1) AS x1, CASE WHEN a.ord IS NULL THEN s.confidence ELSE 1.0 END AS confidence, CASE WHEN a.ord IS NULL THEN s.status ELSE 'human_verified' END AS status
            FROM {_STATE} s LEFT JOIN (SELECT page, ord, x1 + 3 AS x1 FROM {{boxes}} WHERE part % 5 = 0 AND supp % 2 = 0) a ON s.page = a.page AND s.ord = a.ord""")
def apply_review(get):
    answers = get("boxes").where("part % 5 = 0 AND supp % 2 = 0").withColumn("x1", F.col("x1") + 3)
    return validation.reviewed(_state(get), answers).select("page", "ord", "x1", "confidence", "status")


_HITS = "(SELECT page, ord, concat('P', part % 40) AS name, CASE supp % 4 WHEN 0 THEN 'rule-single' WHEN 1 THEN 'rule-merge2' WHEN 2 THEN 'llm' ELSE 'rule-alphanum' END AS method FROM {items})"


def _named_hits(get) -> DataFrame:
    method = F.when(F.col("supp") % 4 == 0, "rule-single").when(F.col("supp") % 4 == 1, "rule-merge2").when(F.col("supp") % 4 == 2, "llm").otherwise("rule-alphanum")
    return get("items").select("page", "ord", F.concat(F.lit("P"), (F.col("part") % 40).cast("string")).alias("name"), method.alias("method"))


@_query(f"SELECT page, method, count(*) AS hits, count(DISTINCT name) AS names FROM {_HITS} h GROUP BY page, method")
def method_histogram(get):
    return validation.method_histogram(_named_hits(get))


@_query(f"SELECT method, count(*) AS n FROM {_HITS} h GROUP BY method")
def source_tally(get):
    return validation.tally(_named_hits(get), "method")


@_query("""SELECT source, label, count(*) AS calls, sum(s) AS seconds, CAST(sum(i) AS BIGINT) AS images FROM (SELECT 'locate' AS source, concat('p', page % 3) AS label, CAST(part % 50 AS DOUBLE) AS s, line AS i FROM {items}
           UNION ALL SELECT 'bay', concat('p', page % 2), CAST(qty AS DOUBLE), 1 FROM {items}) t GROUP BY source, label""")
def call_log(get):
    one = lambda source, n, s, i: get("items").select(F.lit(source).alias("source"), F.concat(F.lit("p"), (F.col("page") % n).cast("string")).alias("label"), s.cast("double").alias("elapsed_s"), i.cast("long").alias("n_images"))
    return validation.call_log(one("locate", 3, F.col("part") % 50, F.col("line")), one("bay", 2, F.col("qty"), F.lit(1)))


@_query("""WITH a AS (SELECT page, count(*) AS requested FROM {names} GROUP BY page), v AS (SELECT b.page, count(*) AS valid FROM {boxes} b JOIN {pages} p ON b.page = p.page
             WHERE (x2 - x1) * (y2 - y1) / (w * h) > 0.002 AND (x2 - x1) * (y2 - y1) / (w * h) < 0.5 AND x2 - x1 > 50 AND y2 - y1 > 50 GROUP BY b.page)
           SELECT a.page, requested, coalesce(valid, 0) AS valid, coalesce(valid, 0) / requested AS ratio FROM a LEFT JOIN v ON a.page = v.page""")
def panel_metrics(get):
    return validation.panel_metrics(get("names"), get("boxes"), get("pages"))


@_query("""WITH f AS (SELECT DISTINCT page, upper(name) AS name FROM {names} WHERE ord % 2 = 0), t AS (SELECT DISTINCT page, upper(name) AS name FROM {names} WHERE ord % 3 > 0)
           SELECT page, found, missed, extra, CASE WHEN found + missed > 0 THEN found / (found + missed) END AS recall FROM (
             SELECT coalesce(f.page, t.page) AS page, count(*) FILTER (f.name IS NOT NULL AND t.name IS NOT NULL) AS found, count(*) FILTER (f.name IS NULL) AS missed, count(*) FILTER (t.name IS NULL) AS extra
             FROM f FULL JOIN t ON f.page = t.page AND f.name = t.name GROUP BY 1) q""")
def recall_vs_truth(get):
    return validation.recall(get("names").where("ord % 2 = 0"), get("names").where("ord % 3 > 0"))


_RUN_A = "(SELECT page, concat('P', ord) AS name, x1, y1, x2, y2 FROM {boxes} WHERE ord % 3 > 0)"
_RUN_B = "(SELECT page, concat('P', ord) AS name, x1 + 15 AS x1, y1, x2 + 9 AS x2, y2 FROM {boxes} WHERE ord % 4 > 0)"


@_query(f"""SELECT coalesce(a.page, b.page) AS page, coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' ELSE 'both' END AS status,
            CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN {_IOU} END AS iou FROM {_RUN_A} a FULL JOIN {_RUN_B} b ON a.page = b.page AND a.name = b.name""")
def run_diff_full_outer(get):
    name = F.concat(F.lit("P"), F.col("ord").cast("string")).alias("name")
    a = get("boxes").where("ord % 3 > 0").select("page", name, *CORNERS)
    b = get("boxes").where("ord % 4 > 0").select("page", name, (F.col("x1") + 15).alias("x1"), "y1", (F.col("x2") + 9).alias("x2"), "y2")
    return validation.compared(a, b)


_KEY10 = ", ".join(f"CAST(round_even({{0}}.{c} / 10.0, 0) * 10 AS BIGINT) AS {c}" for c in CORNERS)


@_query(f"""SELECT page, x1, y1, x2, y2, 'removed' AS change FROM (SELECT page, {_KEY10.format('o')} FROM {{older}} o EXCEPT ALL SELECT page, {_KEY10.format('b')} FROM {{boxes}} b WHERE ord % 2 = 0) r
            UNION ALL SELECT page, x1, y1, x2, y2, 'added' FROM (SELECT page, {_KEY10.format('b')} FROM {{boxes}} b WHERE ord % 2 = 0 EXCEPT ALL SELECT page, {_KEY10.format('o')} FROM {{older}} o) a""")
def stage_diff(get):
    return validation.stage_changes(get("older"), get("boxes").where("ord % 2 = 0"))


@_query("""WITH bay AS (SELECT page, concat('P', ord) AS name, arg_min(supp % 4, ord) AS n_bays FROM {boxes} WHERE ord > 3 GROUP BY page, concat('P', ord))
           SELECT b.page, count(*) AS panels, string_agg(concat(b.name, ':', coalesce(CAST(n_bays AS VARCHAR), '-')), ',' ORDER BY b.ord) AS listed
           FROM (SELECT page, ord, concat('P', ord) AS name FROM {boxes}) b LEFT JOIN bay ON b.page = bay.page AND b.name = bay.name GROUP BY b.page""")
def final_summary(get):
    name = F.concat(F.lit("P"), F.col("ord").cast("string")).alias("name")
    panels = get("boxes").select("page", "ord", name, *CORNERS)
    bays = get("boxes").where("ord > 3").select("page", "ord", name, (F.col("supp") % 4).alias("n_bays"))
    out = validation.final_summary(panels, bays, panels.select("page", "name", F.lit("| a |").alias("bom")))
    kind = "array<struct<ord:long,name:string,bbox:array<long>,n_bays:long,bom:string>>"
    shown = F.transform(F.from_json("summary", kind), lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["n_bays"].cast("string"), F.lit("-"))))
    return out.select("page", "panels", F.array_join(shown, ",").alias("listed"))


# ── runs, steps, cache, review ──────────────────────────────────────────────────────────────────────────────────────────────


@_query("SELECT run_id, step, seq, kind, error FROM {step_log} QUALIFY row_number() OVER (PARTITION BY run_id, step ORDER BY secs DESC, seq DESC) = 1")
def run_latest_state(get):
    return runs.latest(get("step_log"), "run_id", "step", at="secs").select("run_id", "step", "seq", "kind", "error")


def _timed(get) -> DataFrame:
    return get("step_log").withColumn("ts", F.timestamp_seconds("secs"))


_STEPS = """e AS (SELECT run_id, step, arg_max(kind, secs * 1000 + seq) AS kind, arg_max(coalesce(error, ''), secs * 1000 + seq) AS error, max(secs * 1000 + seq) FILTER (kind = 'start') AS b, max(secs * 1000 + seq) FILTER (kind <> 'start') AS z,
      arg_max(secs, secs * 1000 + seq) FILTER (kind = 'start') AS bt, arg_max(secs, secs * 1000 + seq) FILTER (kind <> 'start') AS zt FROM {step_log} GROUP BY run_id, step),
    st AS (SELECT run_id, step, CASE kind WHEN 'start' THEN 'running' WHEN 'complete' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN z > b AND kind <> 'start' THEN CAST(zt - bt AS DOUBLE) END AS elapsed,
             CASE WHEN kind = 'fail' THEN error END AS error FROM e)"""


@_query(f"WITH {_STEPS} SELECT * FROM st")
def step_elapsed(get):
    return runs.step_states(_timed(get))


@_query(f"WITH {_STEPS} SELECT run_id, CAST(coalesce(max(step) FILTER (status = 'completed'), 0) AS BIGINT) AS current_step, sum(elapsed) FILTER (status = 'completed') AS seconds FROM st GROUP BY run_id")
def run_progress(get):
    return runs.run_progress(runs.step_states(_timed(get)))


@_query("SELECT run_id, created_at, status FROM {runs} ORDER BY created_at DESC, run_id LIMIT 20")
def recent_runs_topk(get):
    return runs.recent_runs(get("runs")).select("run_id", "created_at", "status")


@_query("SELECT run_id, created_at FROM {runs} WHERE pdf_hash = 'doc7'")
def runs_by_hash(get):
    return runs.runs_of(get("runs"), "doc7").select("run_id", "created_at")


@_query(f"WITH {_STEPS} SELECT run_id, step, CASE WHEN CAST(substr(run_id, 4) AS BIGINT) % 3 = 0 AND step > 2 THEN 'invalidated' ELSE status END AS status FROM st")
def rollback_steps(get):
    states = runs.step_states(_timed(get))
    targets = states.select("run_id").distinct().where(F.substring("run_id", 4, 20).cast("long") % 3 == 0).withColumn("target", F.lit(2))
    return runs.rolled_back_steps(states, targets).select("run_id", "step", "status")


@_query("""SELECT run_id, CASE WHEN h THEN 'running' ELSE status END AS status, CASE WHEN h THEN 2 ELSE current_step END AS current_step, regions_confirmed, names_confirmed AND NOT h AS names_confirmed, crops_confirmed AND NOT h AS crops_confirmed,
                  bom_confirmed AND NOT h AS bom_confirmed FROM (SELECT *, CAST(substr(run_id, 4) AS BIGINT) % 3 = 0 AS h FROM {runs}) r""")
def rollback_state(get):
    targets = get("runs").select("run_id").where(F.substring("run_id", 4, 20).cast("long") % 3 == 0).withColumn("target", F.lit(2).cast("long"))
    return runs.rolled_back_runs(get("runs"), targets).drop("pdf_hash", "created_at")


@_query("""SELECT pdf_hash, current_step AS step, run_id FROM {runs} WHERE created_at > TIMESTAMP '1998-06-30 00:00:00' - INTERVAL 30 DAY QUALIFY row_number() OVER (PARTITION BY pdf_hash, current_step ORDER BY created_at DESC, run_id DESC) = 1""")
def cache_ttl_live(get):
    cache = get("runs").select("pdf_hash", F.col("current_step").alias("step"), F.col("created_at").alias("ts"), F.col("run_id").alias("seq"), "run_id")
    return runs.live_cache(cache, "1998-06-30 00:00:00").select("pdf_hash", "step", "run_id")


@_query("SELECT run_id, CASE WHEN regions_confirmed AND current_step = 0 THEN 'failed' WHEN names_confirmed AND current_step = 1 THEN 'error' WHEN crops_confirmed THEN 'completed' ELSE status END AS status FROM {runs}")
def run_status(get):
    seen = get("runs").select(
        "run_id", (F.col("regions_confirmed") & (F.col("current_step") == 0)).alias("failed"), F.when(F.col("names_confirmed") & (F.col("current_step") == 1), "x").alias("exception"),
        F.col("crops_confirmed").alias("completed"), F.col("status").alias("stored"),
    )
    return runs.run_status(seen)


@_query("""WITH p AS (SELECT page, concat('R', ord) AS label, CASE ord % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'move' WHEN 2 THEN 'rename' ELSE 'add' END AS action, x1 + 5 AS px1 FROM {boxes} WHERE ord % 5 < 3)
           SELECT coalesce(r.page, p.page) AS page, CASE WHEN action = 'rename' THEN concat(p.label, 'x') ELSE coalesce(r.label, p.label) END AS label, CASE WHEN action IN ('add', 'move') THEN px1 ELSE r.x1 END AS x1
           FROM (SELECT page, concat('R', ord) AS label, x1 FROM {boxes} WHERE ord % 3 > 0) r FULL JOIN p ON r.page = p.page AND r.label = p.label WHERE coalesce(action, '') <> 'delete' AND (r.x1 IS NOT NULL OR action = 'add')""")
def review_edits(get):
    label = F.concat(F.lit("R"), F.col("ord").cast("string"))
    rows = get("boxes").where("ord % 3 > 0").select("page", label.alias("label"), *CORNERS)
    action = F.when(F.col("ord") % 4 == 0, "delete").when(F.col("ord") % 4 == 1, "move").when(F.col("ord") % 4 == 2, "rename").otherwise("add")
    patches = get("boxes").where("ord % 5 < 3").select("page", label.alias("label"), action.alias("action"), F.concat(label, F.lit("x")).alias("new_label"), (F.col("x1") + 5).alias("x1"), "y1", "x2", "y2", F.lit(1).alias("ts"), F.lit(1).alias("seq"))
    return runs.edited(rows, patches).select("page", "label", "x1")


@_query("SELECT page % 40 AS doc, page FROM {pages} WHERE page % 40 % 3 <> 0 OR page % 80 < 40")
def page_selection(get):
    pages = get("pages").select((F.col("page") % 40).alias("doc"), "page")
    return runs.selected_pages(pages, pages.where("doc % 3 = 0 AND page % 80 < 40"))


@_query("""SELECT n.page, n.ord, coalesce(t.top, 0) + n.place AS idx FROM (SELECT page, ord, x1, x2, CASE WHEN ord % 7 = 1 THEN y1 ELSE y2 END AS y2, y1, row_number() OVER (PARTITION BY page ORDER BY ord) AS place FROM {newer}) n
           LEFT JOIN (SELECT page, max(ord) AS top FROM {older} GROUP BY page) t ON n.page = t.page WHERE n.y2 > n.y1""")
def append_new_crops(get):
    new = get("newer").withColumn("y2", F.when(F.col("ord") % 7 == 1, F.col("y1")).otherwise(F.col("y2")))
    return runs.numbered_new(get("older").withColumn("idx", F.col("ord")), new).select("page", "ord", "idx")


@_query("""WITH r AS (SELECT run_id, min(secs) AS first FROM {step_log} GROUP BY run_id), a AS (SELECT run_id, min(secs) AS first, arg_min(error, secs) AS answer FROM {step_log} WHERE kind = 'fail' GROUP BY run_id)
           SELECT r.run_id, CASE WHEN a.first <= r.first + 300 THEN 'answered' ELSE 'timed_out' END AS status, CASE WHEN a.first <= r.first + 300 THEN answer END AS answer FROM r LEFT JOIN a ON r.run_id = a.run_id""")
def review_queue(get):
    requests = _timed(get).groupBy("run_id").agg(F.min("ts").alias("ts"))
    return runs.answered_requests(requests, _timed(get).where("kind = 'fail'").select("run_id", "ts", F.col("error").alias("answer")), 300)


# ── stages ──────────────────────────────────────────────────────────────────────────────────────────────────────────────────


@_query()
def run_bbox_matching(get):
    """The whole matcher, from names and lines to one box a name."""
    from . import extraction

    return in_slices(lambda names, tiles, lines: extraction.matches(names, lines, tiles), get("names"), get("tiles"), get("lines"))


@_query()
def detected_regions(get):
    from . import extraction

    return extraction.regions(get("older"), get("newer").where("ord % 2 = 0"), get("newer").where("ord % 2 = 1"), get("older").where("false"))


@_query()
def extracted_names(get):
    """Names from replayed replies, cleaned, filled and guarded by the page's text."""
    from . import extraction

    said = F.to_json(F.struct(F.collect_list("name").alias("panel_names")))
    tiles = get("labels_of").groupBy("page", (F.col("ord") % 3).alias("tile")).agg(said.alias("reply"))
    cleaned = get("names").where("page % 2 = 0").groupBy("page").agg(said.alias("reply"))
    return extraction.names(tiles, cleaned, get("lines"))


@_query("""SELECT page, name, CAST(CASE WHEN two THEN k ELSE 1 END AS INTEGER) AS bay, CASE WHEN two AND k = 2 THEN x1 + 50 ELSE x1 END AS x1, CASE WHEN two AND k = 1 THEN x1 + 50 ELSE x2 END AS x2
           FROM (SELECT page, concat('P', ord) AS name, x1, x2, supp % 3 = 0 AND x2 - x1 > 50 AND x2 - x1 >= CAST(trunc(600 * 500 / 2000.0) AS INTEGER) AS two, unnest([1, 2]) AS k FROM {boxes}) t WHERE two OR k = 1""")
def bay_split(get):
    name = F.concat(F.lit("P"), F.col("ord").cast("string"))
    panels = get("boxes").select("page", name.alias("name"), *CORNERS, F.lit(500).alias("crop_w"))
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    reply = F.format_string('{"n_bays": 2, "bboxes": [[0, 0, 50, %d], [50, 0, %d, %d]]}', h, w, h)
    answers = get("boxes").select("page", name.alias("name"), F.when(F.col("supp") % 3 == 0, reply).otherwise("one bay").alias("reply"))
    return replies.bays(panels, answers).select("page", "name", "bay", "x1", "x2")


@_query("""SELECT page, concat('P', ord) AS name, greatest(0, least(x1, 1399)) AS x1, least(x2, 1400) AS x2 FROM {boxes} WHERE part % 4 > 0 AND (x2 - x1) * (y2 - y1) <= 0.8 * 1400 * 900""")
def locate_replay(get):
    reply = F.when(F.col("part") % 4 > 0, F.format_string('```json\n{"found": true, "bbox": [%d, %d, %d, %d]}\n```', *[F.col(c) for c in CORNERS])).otherwise('{"found": false}')
    asked = get("boxes").select("page", F.concat(F.lit("P"), F.col("ord").cast("string")).alias("name"), F.lit(PAGE_W).alias("w"), F.lit(PAGE_H).alias("h"), reply.alias("reply"))
    return replies.located(asked).select("page", "name", F.col("x1").cast("long").alias("x1"), F.col("x2").cast("long").alias("x2"))


@_query("""SELECT page, concat('P', ord) AS name, CAST(k + 1 AS INTEGER) AS line, concat('D', k) AS device, CAST(qty AS VARCHAR) AS n FROM (SELECT page, ord, qty, unnest([1, 2]) AS k FROM {items}) t""")
def bom_table(get):
    table = F.format_string("| Device | Qty |\n|---|---|\n| D1 | %d |\n| D2 | %d |\nend", F.col("qty"), F.col("qty"))
    rows = replies.materials(get("items").select("page", F.concat(F.lit("P"), F.col("ord").cast("string")).alias("name"), table.alias("reply")))
    return rows.select("page", "name", "line", F.col("cells")[0].alias("device"), F.col("cells")[1].alias("n"))


@_query("""SELECT page, CAST(greatest(1, least(3, CASE WHEN page % 4 = 0 THEN 1 ELSE page % 6 END)) AS INTEGER) AS choice FROM {pages}""")
def reference_choice(get):
    reply = F.when(F.col("page") % 4 == 0, "no idea").otherwise(F.format_string('{"choice": %d, "reasoning": "it is clear"}', F.col("page") % 6))
    return replies.chosen_reference(get("pages").select("page", F.lit(3).alias("n_images"), reply.alias("reply")))


@_query("""SELECT page, ord AS idx, greatest(0, x1 - 5) AS x1, x2 FROM {boxes} WHERE part % 3 > 0""")
def electrical_crops(get):
    one = F.struct(F.col("ord").alias("index"), (F.col("part") % 3 > 0).alias("is_electrical"), (F.col("x1") - 5).alias("x1"))
    answer = get("boxes").groupBy("page").agg(F.to_json(F.struct(F.collect_list(one).alias("crops"))).alias("reply"))
    crops = get("boxes").select("page", F.col("ord").alias("idx"), *CORNERS, F.lit(PAGE_W).alias("w"), F.lit(PAGE_H).alias("h"))
    return replies.electrical_corrected(crops, answer).select("page", "idx", "x1", "x2")


@_query("""SELECT page, axis, pos, s0, s1 FROM (SELECT page, 'h' AS axis, 2 * y1 AS pos, CAST(2 * x1 AS DOUBLE) AS s0, CAST(2 * x2 AS DOUBLE) AS s1 FROM {boxes}
             UNION ALL SELECT page, 'h', 2 * y2, 2.0 * x1, 2.0 * x2 FROM {boxes} UNION ALL SELECT page, 'v', 2 * x1, 2.0 * y1, 2.0 * y2 FROM {boxes} UNION ALL SELECT page, 'v', 2 * x2, 2.0 * y1, 2.0 * y2 FROM {boxes}) t WHERE s1 - s0 > 8""")
def svg_segments(get):
    """Strokes of rectangles drawn as paths in a scaled group."""
    from gridloom.functions import svg

    path = F.format_string('<path d="M%d %dH%dV%dh%dV%d"/>', "x1", "y1", "x2", "y2", F.col("x1") - F.col("x2"), F.col("y1"))
    body = get("boxes").groupBy("page").agg(F.array_join(F.collect_list(path), "").alias("body"))
    drawing = F.concat(F.lit('<svg><g transform="matrix(2 0 0 2 0 0)">'), "body", F.lit("</g></svg>"))
    return svg.svg_segments(body.select("page", drawing.alias("svg"), F.lit(4 * PAGE_W).alias("w"), F.lit(4 * PAGE_H).alias("h")))


# ── text and figure regions, the grid, the verify loop ──────────────────────────────────────────────────────────────────────

_REL = f"(SELECT page, ord, x1, y1, least(x2, x1 + 1 + part % 300) AS x2, least(y2, y1 + 1 + supp % 90) AS y2, part % 6 = 0 AS bow FROM {{boxes}})"


def _paragraphs(get) -> DataFrame:
    x2, y2 = F.least("x2", F.col("x1") + 1 + F.col("part") % 300), F.least("y2", F.col("y1") + 1 + F.col("supp") % 90)
    a, b, c, d = (v.cast("double") for v in (F.col("x1"), F.col("y1"), x2, y2))
    polygon = F.when(F.col("part") % 6 == 0, F.array(a, b, c, d, c, b, a, d)).otherwise(F.array(a, b, c, b, c, d, a, d))
    return get("boxes").select("page", "ord", polygon.alias("polygon"))


@_query(f"""WITH p AS (SELECT page, ord, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, bow AND (x2 - x1) * (y2 - y1) > 1 AS wraps FROM {_REL} r)
            SELECT p.page, p.ord, CASE WHEN wraps THEN 'wrap_around' WHEN NOT (cx BETWEEN c.x1 AND c.x2 AND cy BETWEEN c.y1 AND c.y2) THEN 'outside_frame'
              WHEN EXISTS (SELECT 1 FROM {{older}} t WHERE t.page = p.page AND cx BETWEEN t.x1 AND t.x2 AND cy BETWEEN t.y1 AND t.y2) THEN 'in_table' ELSE 'ok' END AS reason
            FROM p JOIN {{content}} c ON p.page = c.page""")
def text_region_reasons(get):
    return regions.text_reasons(_paragraphs(get), get("pages"), get("content"), get("older"))


@_query(f"""WITH p AS (SELECT page, ord, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, bow AND (x2 - x1) * (y2 - y1) > 1 AS wraps FROM {_REL} r)
            SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT (cx BETWEEN c.x1 AND c.x2 AND cy BETWEEN c.y1 AND c.y2) THEN 'outside_frame' WHEN wraps THEN 'wrap_around'
              WHEN EXISTS (SELECT 1 FROM {{older}} t WHERE t.page = p.page AND cx BETWEEN t.x1 AND t.x2 AND cy BETWEEN t.y1 AND t.y2) THEN 'in_table' ELSE 'ok' END AS reason
            FROM p JOIN {{content}} c ON p.page = c.page) q GROUP BY reason""")
def text_filter_tally(get):
    """The order of the raw dump: the frame is tested before wrap-around."""
    return validation.tally(regions.text_reasons(_paragraphs(get), get("pages"), get("content"), get("older"), frame_first=True), "reason")


@_query("""SELECT b.page, b.ord, greatest(b.x1, c.x1) AS x1, greatest(b.y1, c.y1) AS y1, least(b.x2, c.x2) AS x2, least(b.y2, c.y2) AS y2 FROM {boxes} b JOIN {content} c ON b.page = c.page
           WHERE (b.x1 + b.x2) / 2 BETWEEN c.x1 AND c.x2 AND (b.y1 + b.y2) / 2 BETWEEN c.y1 AND c.y2""")
def figure_regions(get):
    polygon = B.box_to_polygon(B.box())
    found = regions.figure_regions(get("boxes").select("page", "ord", polygon.alias("polygon")), get("pages"), get("content"))
    return found.select("page", "ord", *[F.col(c).cast("long").alias(c) for c in CORNERS])


@_query(f"""WITH p AS (SELECT n.page, n.ord, o.ord AS painted, o.x1, o.y1, o.x2, o.y2, (n.x1 + n.x2) / 2 - (o.x1 + o.x2) / 2 AS dx, (n.y1 + n.y2) / 2 - (o.y1 + o.y2) / 2 AS dy,
               least(o.x2, n.x2) > greatest(o.x1, n.x1) OR least(o.y2, n.y2) > greatest(o.y1, n.y1) AS near FROM {{newer}} n JOIN {{older}} o ON n.page = o.page),
            s AS (SELECT page, ord, painted, CASE WHEN near AND abs(dy) < abs(dx) AND dx <= 0 THEN x1 + 30 ELSE x1 END AS x1, CASE WHEN near AND abs(dy) >= abs(dx) AND dy <= 0 THEN y1 + 30 ELSE y1 END AS y1,
               least({PAGE_W}, CASE WHEN near AND abs(dy) < abs(dx) AND dx > 0 THEN x2 - 30 ELSE x2 END) AS x2, least({PAGE_H}, CASE WHEN near AND abs(dy) >= abs(dx) AND dy > 0 THEN y2 - 30 ELSE y2 END) AS y2 FROM p)
            SELECT * FROM s WHERE x2 > x1 AND y2 > y1""")
def white_fill_rectangles(get):
    return regions.fill_rectangles(get("newer"), get("older"), get("pages"))


@_query()
def ruling_grid(get):
    """The whole cascade from segments to the lines that bound panels."""
    return rulings.grid(get("segments"), get("pages").select("page", F.lit(900).alias("w"), F.lit(900).alias("h")))


@_query()
def verify_loop_replay(get):
    """Locate and verify replies of each panel, replayed to its final box."""
    b = get("boxes")
    axis = lambda c: F.when(F.col("part") % 3 == 0, F.lit(c))
    attempts = b.select(
        "page", F.concat(F.lit("P"), (F.col("ord") % 3).cast("string")).alias("name"), F.col("ord").alias("attempt"), F.array(*[F.col(c).cast("double") for c in CORNERS]).alias("located"),
        (F.col("supp") % 11 == 0).alias("valid"), F.array_compact(F.array(axis("x1"), axis("y2"))).alias("wrong"),
        F.array(F.col("x1") - 5.0, F.col("y1").cast("double"), F.col("x2") + 5.0, F.col("y2").cast("double")).alias("corrected"),
    )
    names = b.groupBy("page", F.concat(F.lit("P"), (F.col("ord") % 3).cast("string")).alias("name")).agg(*[F.expr(f"min_by({v}, ord)").alias(f"n_{c}") for c, v in (("x1", "x1 + 2"), ("y1", "y1 + 2"), ("x2", "x1 + 8"), ("y2", "y1 + 8"))])
    return replies.verified_panels(attempts, names, PAGE_W, PAGE_H)


def _detections(get) -> DataFrame:
    one = F.struct(F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")]).alias("polygon"), F.lit("seen").alias("note"))
    gone = F.when(F.col("part") % 4 == 0, F.struct(F.col("ord").alias("index"), F.lit("a table").alias("reason")))
    said = F.to_json(F.struct((F.first("page") % 5 == 0).alias("full_page"), F.sort_array(F.collect_list(one)).alias("missing"), F.collect_list(gone).alias("drop_non_electrical")))
    reply = F.when(F.col("page") % 7 == 0, F.lit("no idea")).otherwise(F.concat(F.lit("```json\n"), "said", F.lit("\n```")))
    asked = get("boxes").groupBy("page").agg(said.alias("said")).withColumn("reply", reply)
    return asked.join(get("pages"), "page")


@_query(f"""SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY x1, y1, x2, y2) - 1 AS BIGINT) AS ord, x1, y1, least(x2, {PAGE_W}) AS x2, least(y2, {PAGE_H}) AS y2 FROM {{boxes}} WHERE page % 7 > 0 AND page % 5 > 0
            UNION ALL SELECT page, 0, 0, 0, {PAGE_W}, {PAGE_H} FROM {{pages}} WHERE page % 7 > 0 AND page % 5 = 0""")
def missing_regions_replay(get):
    return replies.missing_regions(_detections(get))


@_query("SELECT page, ord FROM {boxes} WHERE page % 7 > 0 AND part % 4 = 0")
def dropped_regions_replay(get):
    return replies.dropped_regions(_detections(get))


@_query("""SELECT page, ord, part % 3 = 0 AS is_clipped, CASE WHEN part % 3 = 0 THEN 'left,top' ELSE '' END AS edges, CASE WHEN part % 3 = 0 THEN x1 - 4 END AS s_x1 FROM {boxes} WHERE part % 3 < 2
           UNION ALL SELECT page, ord, false, '', NULL FROM {boxes} WHERE part % 3 = 2""")
def crop_check_replay(get):
    said = F.format_string('ok {"is_clipped": true, "clipped_edges": ["left", "top"], "excess_edges": [], "suggested_box": {"x1": %d, "y1": 1, "x2": 2, "y2": 3}}', F.col("x1") - 4)
    reply = F.when(F.col("part") % 3 == 0, said).when(F.col("part") % 3 == 1, F.lit('{"is_clipped": false}')).otherwise(F.lit("?"))
    got = replies.crop_checks(get("boxes").select("page", "ord", reply.alias("reply")))
    return got.select("page", "ord", "is_clipped", F.array_join("clipped", ",").alias("edges"), "s_x1")


@_query("""WITH h AS (SELECT l.page, c.ord AS idx, l.content AS name, length(l.content) / greatest(length(trim(l.content)), 1) AS ratio, l.ord, l.x1 - c.x1 AS x1, l.y1 - c.y1 AS y1 FROM {lines} l JOIN {older} c ON l.page = c.page
             WHERE (l.x1 + l.x2) / 2 BETWEEN c.x1 AND c.x2 AND (l.y1 + l.y2) / 2 BETWEEN c.y1 AND c.y2)
           SELECT page, idx, max(ratio) AS ratio, count(*) AS n, min(x1) AS x1, min(y1) AS y1 FROM h GROUP BY page, idx""")
def hits_by_crop(get):
    from gridloom.sources import files

    hits = get("lines").select("page", F.col("content").alias("name"), F.trim("content").alias("found"), *CORNERS)
    ranked = files.hits_by_crop(hits, get("older").withColumnRenamed("ord", "idx"))
    return ranked.groupBy("page", "idx").agg(F.max("ratio").alias("ratio"), F.count(F.lit(1)).alias("n"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))


@_query(f"""SELECT b.page, concat('<svg xmlns="http://www.w3.org/2000/svg" width="{PAGE_W}" height="{PAGE_H}"><image href="p', b.page, '.png"/>',
              string_agg(printf('<polygon points="%.1f,%.1f %.1f,%.1f %.1f,%.1f %.1f,%.1f" fill="none" stroke="#f00"/>', x1 * 1.0, y1 * 1.0, x2 * 1.0, y1 * 1.0, x2 * 1.0, y2 * 1.0, x1 * 1.0, y2 * 1.0), '' ORDER BY b.ord), '</svg>') AS value
            FROM {{boxes}} b GROUP BY b.page""")
def region_overlays(get):
    from gridloom.sources import files

    drawn = get("boxes").select("page", "ord", B.box_to_polygon(B.box()).alias("polygon"), F.lit("#f00").alias("color"))
    return files.overlays(drawn, get("pages").withColumn("image", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(".png"))))
