"""Checks of panels, routing to review, tallies and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import boxes as B

from .spatial import overlap_issues

CORNERS = ["x1", "y1", "x2", "y2"]


def crop_issues(panel: B.Box, name: B.Box, page_w: Column, page_h: Column) -> Column:
    """What is wrong with a crop: too_small (< .5 % of the page), too_large (> 80 %), name_outside, empty, elongated (> 20 : 1)."""
    w, h = B.width(panel), B.height(panel)
    share = B.raw_area(panel) / (page_w.cast("long") * page_h)
    long_, short = F.greatest(w, h), F.least(w, h)
    checks = {
        "too_small": share < 0.005,
        "too_large": share > 0.80,
        "name_outside": name.x1.isNotNull() & ~B.contains(panel, name),
        "empty": (w <= 0) | (h <= 0),
        "elongated": (short <= 0) | (long_ > 20 * short),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def name_coverage(expected: DataFrame, found: DataFrame, by: str = "page") -> DataFrame:
    """(page, name, status): missing or extra names."""
    missing = expected.select(by, "name").distinct().join(found, [by, "name"], "left_anti").withColumn("status", F.lit("missing"))
    extra = found.select(by, "name").distinct().join(expected, [by, "name"], "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def page_coverage(panels: DataFrame, pages: DataFrame, by: str = "page", least: float = 0.30) -> DataFrame:
    """Share of each page under panels, as the plain sum of areas; issue: no_panels or low_coverage."""
    total = panels.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(B.area(B.box())).alias("covered"))
    joined = pages.join(total, by, "left").fillna(0, ["n", "covered"])
    share = F.col("covered") / (F.col("w").cast("long") * F.col("h"))
    issue = F.when(F.col("n") == 0, "no_panels").when(share < least, "low_coverage")
    return joined.select(by, F.col("n").cast("long").alias("n"), F.col("covered").cast("long").alias("covered"), share.alias("coverage"), issue.alias("issue"))


def content_coverage(boxes: DataFrame, content: DataFrame, by: str = "page") -> DataFrame:
    """Percentage of the content box under boxes, 100 at most."""
    total = boxes.groupBy(by).agg(F.sum(B.area(B.box())).alias("covered"))
    size = B.area(B.box(alias="c"))
    joined = content.alias("c").join(total, by, "left")
    percent = F.when(size > 0, F.least(F.lit(100.0), F.coalesce("covered", F.lit(0)) * 100.0 / size)).otherwise(F.lit(0.0))
    return joined.select(by, percent.alias("percent"))


def review_reasons(panels: DataFrame, threshold: float = 0.7, over: float = 0.15) -> DataFrame:
    """Where a panel goes: page, ord, reason (unverified, low_confidence, overlap or null), needs_review.

    panels: with status and confidence. Overlap issues are joined by the panels' keys.
    """
    pairs = overlap_issues(panels, over)
    touched = pairs.select("page", F.explode(F.array("ord_a", "ord_b")).alias("ord")).distinct().withColumn("overlaps", F.lit(True))
    joined = panels.join(touched, ["page", "ord"], "left")
    reason = (
        F.when(F.col("status") != "verified", "unverified").when(F.col("confidence") < threshold, "low_confidence").when(F.col("overlaps"), "overlap")
    )
    return joined.select("page", "ord", reason.alias("reason"), reason.isNotNull().alias("needs_review"))


def reviewed(panels: DataFrame, answers: DataFrame) -> DataFrame:
    """Panels with the reviewers' boxes: those answered get the box, confidence 1 and status human_verified; approved ones stay in."""
    a = answers.select("page", "ord", *[F.col(c).alias(f"a_{c}") for c in CORNERS], F.lit(True).alias("answered"))
    joined = panels.join(a, ["page", "ord"], "left")
    fixed = {c: F.coalesce(f"a_{c}", c) for c in CORNERS}
    done = F.coalesce("answered", F.lit(False))
    status = F.when(done, "human_verified").otherwise(F.col("status"))
    return joined.withColumns(fixed | {"confidence": F.when(done, 1.0).otherwise(F.col("confidence")), "status": status}).select(*panels.columns)


def method_histogram(hits: DataFrame, by: str = "page") -> DataFrame:
    return hits.groupBy(by, "method").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("name").alias("names"))


def tally(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def call_log(*logs: DataFrame) -> DataFrame:
    """Model calls of several sources (label, elapsed_s, n_images, source): calls, seconds and images by source and label."""
    every = logs[0]
    for more in logs[1:]:
        every = every.unionByName(more)
    return every.groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("elapsed_s").alias("seconds"), F.sum("n_images").cast("long").alias("images")
    )


def panel_metrics(requested: DataFrame, panels: DataFrame, pages: DataFrame, by: str = "page") -> DataFrame:
    """Of each page: names asked for, panels that are sound (.2 % to 50 % of the page, over 50 px each way), and their ratio."""
    asked = requested.groupBy(by).agg(F.count(F.lit(1)).alias("requested"))
    p = B.box()
    share = B.raw_area(p) / (F.col("w").cast("long") * F.col("h"))
    sound = (share > 0.002) & (share < 0.5) & (B.width(p) > 50) & (B.height(p) > 50)
    valid = panels.join(pages, by).groupBy(by).agg(F.count_if(sound).alias("valid"))
    joined = asked.join(valid, by, "left").fillna(0, ["valid"])
    return joined.select(by, "requested", "valid", (F.col("valid") / F.col("requested")).alias("ratio"))


def recall(found: DataFrame, truth: DataFrame, by: str = "page") -> DataFrame:
    """Upper-case names found, missed and extra, and the recall, for each page."""
    up = lambda df, mark: df.select(by, F.upper("name").alias("name")).distinct().withColumn(mark, F.lit(1))
    both = up(found, "f").join(up(truth, "t"), [by, "name"], "full_outer")
    hit, missed, extra = (F.count_if(c) for c in ((F.col("f") == 1) & (F.col("t") == 1), F.col("f").isNull(), F.col("t").isNull()))
    out = both.groupBy(by).agg(hit.alias("found"), missed.alias("missed"), extra.alias("extra"))
    return out.withColumn("recall", F.when(F.col("found") + F.col("missed") > 0, F.col("found") / (F.col("found") + F.col("missed"))))


def compared(a: DataFrame, b: DataFrame, by: str = "page") -> DataFrame:
    """Names of two runs side by side: page, name, status (both, only_a, only_b), iou of their boxes."""
    p, q = a.alias("a"), b.alias("b")
    both = p.join(q, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.name") == F.col("b.name")), "full_outer")
    status = F.when(F.col("b.name").isNull(), "only_a").when(F.col("a.name").isNull(), "only_b").otherwise("both")
    value = F.when(status == "both", B.iou(B.box(alias="a"), B.box(alias="b")))
    return both.select(F.coalesce(f"a.{by}", f"b.{by}").alias(by), F.coalesce("a.name", "b.name").alias("name"), status.alias("status"), value.alias("iou"))


def stage_changes(before: DataFrame, after: DataFrame, grid: int = 10, by: str = "page") -> DataFrame:
    """Boxes that a stage added or removed, keyed by corners rounded to ``grid`` (half to even)."""
    key = lambda df: df.select(by, *[(F.bround(F.col(c) / grid) * grid).cast("long").alias(c) for c in CORNERS])
    gone = key(before).exceptAll(key(after)).withColumn("change", F.lit("removed"))
    return gone.unionByName(key(after).exceptAll(key(before)).withColumn("change", F.lit("added")))


def final_summary(panels: DataFrame, bays: DataFrame, materials: DataFrame) -> DataFrame:
    """Per page one JSON text of its panels in order, each with its bay count (the first record of its name) and its list of materials."""
    first = bays.groupBy("page", "name").agg(F.min_by("n_bays", "ord").alias("n_bays"))
    rows = panels.join(first, ["page", "name"], "left").join(materials.select("page", "name", "bom"), ["page", "name"], "left")
    one = F.struct("ord", "name", F.array(*CORNERS).alias("bbox"), "n_bays", "bom")
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("panels"), F.to_json(F.sort_array(F.collect_list(one))).alias("summary"))
