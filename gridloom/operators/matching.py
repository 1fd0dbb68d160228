"""Matching of panel names to recognised text lines.

names: (page, ord, name); lines: (page, ord, content, x1, y1, x2, y2). Both get their normal forms once (``prepared``), before any join, so that
the Python step that Unicode needs never runs inside one. Passes are equi joins on the page with text predicates; which pass counts
is decided by windows afterwards. What depends on earlier decisions folds over one name's hits or, in the series, over one page.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import text as X
from gridloom.sources.scratch import keep, unsized

from .folds import fold_groups, with_number

CORNERS = ["x1", "y1", "x2", "y2"]
# Rank of a method where names compete for a box (anything else ranks 5), and confidence of the simple matcher's passes.
METHOD_RANK = {
    "rule-single": 0, "rule-alphanum": 1, "rule-token": 2, "rule-merge2": 3, "rule-merge3": 4, "rule-ocr-sub": 5, "rule-ocr-sub-lz": 5,
    "rule-serial-num": 6, "llm": 7, "llm-validate": 8,
}
CONFIDENCE = {"exact": 1.0, "alphanum": 0.9, "substring": 0.75, "multi_line_merge": 0.7, "ocr_similar": 0.6}


def prepared(df: DataFrame, text: str) -> DataFrame:
    """With ``normed``, ``alpha`` (letters and digits) and ``bare`` (those without leading zeros)."""
    df = df.withColumn("normed", X.norm(F.col(text)))
    df = df.withColumn("alpha", X.alphanum(F.col("normed")))
    return df.withColumn("bare", X.strip_zeros(F.col("alpha")))


def _reading_order(lines: DataFrame) -> DataFrame:
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("y1", "x1", "ord")))


def stacks(lines: DataFrame, most: int, least: int = 2) -> DataFrame:
    """Runs of ``least`` to ``most`` lines that follow each other in reading order: page, place, n, ls (array of line structs)."""
    w = Window.partitionBy("page").orderBy("place")
    row = F.struct("ord", "content", "normed", "alpha", *CORNERS)
    ahead = _reading_order(lines).withColumn("run", F.array(*[F.lead(row, k).over(w) if k else row for k in range(most)]))
    ahead = ahead.withColumn("run", F.filter("run", lambda r: r.isNotNull()))
    return ahead.select("page", "place", F.explode(F.sequence(F.lit(least), F.greatest(F.size("run"), F.lit(least)))).alias("n"), "run").where(F.col("n") <= F.size("run")).select(
        "page", "place", "n", F.slice("run", 1, F.col("n")).alias("ls")
    )


def _union_box(ls: Column) -> list[Column]:
    pick = lambda n, f: f(F.transform(ls, lambda r: r[n])).alias(n)
    return [pick("x1", F.array_min), pick("y1", F.array_min), pick("x2", F.array_max), pick("y2", F.array_max)]


# ── the simple matcher ──────────────────────────────────────────────────────────────────────────────────────────────────────


def first_pass_matches(names: DataFrame, lines: DataFrame, max_merge: int = 3) -> DataFrame:
    """Of each name the hits of the first pass that has any: page, name, name_ord, method, confidence, source
    (array of contents), corners.

    Passes: equal, alphanumerically alike, one part of the other, up to max_merge + 1 lines together alike, one character apart.
    A name or line without letters and digits is part of nothing.
    """
    # one join of names with lines and runs of lines alike: all that follows stays within a page, so that one deal by page serves every window
    asked = prepared(names, "name").withColumn("folded", X.folded(F.col("bare"))).repartition("page").alias("n")
    runs = stacks(prepared(lines, "content").repartition("page"), max_merge + 1, 1)
    # what a run of lines reads like is its lines' letters and digits one after the other
    runs = runs.withColumn("alpha", F.array_join(F.transform("ls", lambda r: r["alpha"]), "")).withColumn("bare", X.strip_zeros(F.col("alpha")))
    first, alone = F.element_at("ls", 1), F.col("n") == 1
    runs = runs.where(alone | (F.length("bare") >= 3)).select(
        "page", "n", F.when(alone, first["normed"]).alias("normed"), "alpha", X.folded(F.col("bare")).alias("folded"),
        F.when(alone, first["ord"]).otherwise((F.col("place") * 100 + F.col("n")).cast("long")).alias("ord"), F.transform("ls", lambda r: r["content"]).alias("source"), *_union_box(F.col("ls")),
    ).alias("l")
    na, la, alone = F.col("n.alpha"), F.col("l.alpha"), F.col("l.n") == 1
    part = (F.length(na) >= 3) & (F.length(la) > 0) & (la.contains(na) | na.contains(la))
    alike = (F.col("n.folded") == F.col("l.folded")) & (F.length("n.folded") >= 3)
    method = (
        F.when(~alone, F.when(alike, "multi_line_merge"))
        .when(F.col("n.normed") == F.col("l.normed"), "exact")
        .when(alike, "alphanum")
        .when(part, "substring")
        .when(_simple_ocr(na, la), "ocr_similar")
    )
    both = asked.join(runs, F.col("n.page") == F.col("l.page")).select(
        "n.page", "n.name", F.col("n.ord").alias("name_ord"), method.alias("method"), "l.ord", "l.source", *[F.col(f"l.{c}") for c in CORNERS]
    )
    both = both.where("method is not null")
    rank = F.create_map(*[F.lit(v) for i, m in enumerate(CONFIDENCE) for v in (m, i)])
    both = both.withColumn("pass", rank[F.col("method")])
    both = both.withColumn("first", F.min("pass").over(Window.partitionBy("page", "name"))).where(F.col("pass") == F.col("first"))
    confidence = F.create_map(*[F.lit(v) for kv in CONFIDENCE.items() for v in kv])
    return both.select("page", "name", "name_ord", "ord", "method", confidence[F.col("method")].alias("confidence"), "source", *CORNERS)


# Characters that the simple matcher takes for each other.
_SIMPLE_PAIRS = ("vy", "vu", "yu", "mn", "mh", "nh", "s5", "o0", "oq", "0q", "i1", "il", "1l")


def _simple_ocr(a: Column, b: Column) -> Column:
    pairs = sorted({p for x in _SIMPLE_PAIRS for p in (x, x[::-1])})
    return (F.length(a) >= 4) & (F.length(a) == F.length(b)) & X._one_confused(a, b, pairs)


def best_without_conflict(matches: DataFrame) -> DataFrame:
    """One match or none for each name: its best (first of the most confident); of names with one box the most confident keeps it.

    The others get their best match with another box, which isn't contested again.
    """
    name = Window.partitionBy("page", "name")
    order = name.orderBy(F.desc("confidence"), "ord")
    box = F.struct(*CORNERS)
    ranked = matches.withColumns({"_rank": F.row_number().over(order), "_best": F.first(box).over(order)})
    claim = Window.partitionBy("page", *CORNERS, F.col("_rank") == 1).orderBy(F.desc("confidence"), "name_ord")
    ranked = ranked.withColumn("_claim", F.row_number().over(claim))
    wins = F.max((F.col("_rank") == 1) & (F.col("_claim") == 1)).over(name)
    other = Window.partitionBy("page", "name", F.col("_other")).orderBy("_rank")
    ranked = ranked.withColumn("_wins", wins).withColumn("_other", box != F.col("_best")).withColumn("_next", F.row_number().over(other))
    stays = (F.col("_wins") & (F.col("_rank") == 1)) | (~F.col("_wins") & F.col("_other") & (F.col("_next") == 1))
    return ranked.where(stays).select(*matches.columns)


# ── the full matcher: all passes ────────────────────────────────────────────────────────────────────────────────────────────

#: What a name may hit, in the order in which hits count: by pass, then line order, or (for tokens and runs of lines) reading order.
_EVENT = "struct<pass:int,at:long,n:int,method:string,lines:array<long>,box:struct<x1:long,y1:long,x2:long,y2:long>>"


def _words(normed: Column) -> Column:
    return F.filter(F.split(normed, " "), lambda w: w != "")


def _holds_words(text_words: Column, name_words: Column) -> Column:
    return (F.size(name_words) > 0) & (F.size(F.array_except(name_words, text_words)) == 0)


def _same_serial(a: Column, b: Column) -> Column:
    """Equal number of two digits at least and equal suffix, prefixes of about one length."""
    apart = F.abs(F.length(X.alphanum(a["prefix"])) - F.length(X.alphanum(b["prefix"])))
    return F.coalesce((a["number"] >= 10) & (a["number"] == b["number"]) & (a["suffix"] == b["suffix"]) & (apart <= 2), F.lit(False))


def _one_below_the_other(ls: Column, least: float) -> Column:
    """Each line of a run close under the one before it and sharing enough of its width."""

    def near(i: Column) -> Column:
        a, b = (B.Box(*[F.element_at(ls, at)[c] for c in CORNERS]) for at in (i, i + 1))
        return (b.y1 - a.y2 <= F.greatest(a.y2 - a.y1, F.lit(1)) * 2.5) & (B.x_overlap(a, b) >= least)

    return F.forall(F.sequence(F.lit(1), F.size(ls) - 1), near)


def _single_events(names: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, name, name_ord, event) for each line that a name fits in some pass; the first pass counts."""
    n, line = names.alias("n"), _reading_order(lines).alias("l")
    nn, ln = F.col("n.normed"), F.col("l.normed")
    # the passes' numbers leave 3 to tokens and runs of lines, which are met in reading order together
    kinds = [
        (1, "rule-single", (nn == ln) | X.stands_alone(nn, ln)),
        (2, "rule-alphanum", X.alike(F.col("n.bare"), F.col("l.bare"))),
        (3, "rule-token", _holds_words(F.col("l.words"), F.col("n.words"))),
        (4, "rule-ocr-sub", X.confused(F.col("n.alpha"), F.col("l.alpha"))),
        (5, "rule-ocr-sub-lz", X.confused(F.col("n.bare"), F.col("l.bare"), 3, False)),
        (6, "rule-serial-num", _same_serial(F.col("n.serial"), F.col("l.serial"))),
    ]
    which = F.coalesce(*[F.when(fits, F.struct(F.lit(k).alias("pass"), F.lit(m).alias("method"))) for k, m, fits in kinds])
    hit = n.join(line, F.col("n.page") == F.col("l.page")).withColumn("which", which).where("which is not null")
    at = F.when(F.col("which.pass") == 3, F.col("l.place")).otherwise(F.col("l.ord"))
    event = F.struct(F.col("which.pass"), at, F.lit(1), F.col("which.method"), F.array("l.ord"), F.struct(*[F.col(f"l.{c}") for c in CORNERS])).cast(_EVENT)
    return hit.select("n.page", "n.name", F.col("n.ord").alias("name_ord"), event.alias("event"))


def _run_events(names: DataFrame, lines: DataFrame, max_merge: int, least: float) -> DataFrame:
    """The same for runs of lines that read together like the name, or hold it or its words."""
    runs = stacks(lines, max_merge).where(_one_below_the_other(F.col("ls"), least))
    runs = runs.withColumn("normed", F.array_join(F.transform("ls", lambda r: r["normed"]), " "))
    runs = runs.withColumns({"words": _words(F.col("normed")), "bare": X.strip_zeros(X.alphanum(F.col("normed")))})
    n, m = names.alias("n"), runs.alias("m")
    nn, mn = F.col("n.normed"), F.col("m.normed")
    fits = _holds_words(F.col("m.words"), F.col("n.words")) | X.stands_alone(nn, mn) | X.stands_alone(mn, nn) | X.alike(F.col("n.bare"), F.col("m.bare"))
    method = F.concat(F.lit("rule-merge"), F.col("m.n").cast("string"))
    event = F.struct(F.lit(3), F.col("m.place"), F.col("m.n"), method, F.transform("m.ls", lambda r: r["ord"]), F.struct(*_union_box(F.col("m.ls")))).cast(_EVENT)
    return n.join(m, (F.col("n.page") == F.col("m.page")) & fits).select("n.page", "n.name", F.col("n.ord").alias("name_ord"), event.alias("event"))


def _counted(events: Column) -> Column:
    """Of sorted events those that count: a box counts once, and a line that counted alone is in no later hit."""
    state = f"struct<boxes:array<struct<x1:long,y1:long,x2:long,y2:long>>,taken:array<long>,hits:array<{_EVENT}>>"
    none = F.struct(F.array(), F.array(), F.array()).cast(state)

    def step(s: Column, e: Column) -> Column:
        out = F.array_contains(s["boxes"], e["box"]) | F.arrays_overlap(s["taken"], e["lines"])
        taken = F.when(e["n"] == 1, F.concat(s["taken"], e["lines"])).otherwise(s["taken"])
        more = F.struct(F.array_append(s["boxes"], e["box"]), taken, F.array_append(s["hits"], e)).cast(state)
        return F.when(out, s).otherwise(more)

    return F.aggregate(events, none, step, lambda s: s["hits"])


def all_pass_matches(names: DataFrame, lines: DataFrame, max_merge: int = 3, least: float = 0.25) -> DataFrame:
    """Every hit of every name against the lines of its page: page, name, name_ord, method, lines (their ords), corners, hit_ord.

    Every pass adds: lines that are the name or hold it alone, that read alike, that hold its words (with runs of up to ``max_merge`` lines one below the
    other, in reading order), that are one confusable character away, with and without zeros, and that end in the same number. What fits is joined
    and tested as a set; only which of a name's fits count depends on those before, and that folds over them in one expression.
    """
    forms = lambda df, text: prepared(df, text).withColumns({"words": _words(F.col("normed")), "serial": X.serial(F.col("normed"))})
    n, line = unsized(keep(forms(names, "name"), "names")), unsized(keep(forms(lines, "content"), "lines"))  # each is read twice
    fits = _single_events(n, line).unionByName(_run_events(n, line, max_merge, least))
    hits = fits.groupBy("page", "name", "name_ord").agg(_counted(F.sort_array(F.collect_list("event"))).alias("hits"))
    each = hits.select("page", "name", "name_ord", F.posexplode("hits").alias("hit_ord", "h"))
    return each.select("page", "name", "name_ord", "h.method", "h.lines", "h.box.*", F.col("hit_ord").cast("long").alias("hit_ord"))


# ── conflicts, positions ────────────────────────────────────────────────────────────────────────────────────────────────────


def conflict_winners(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits whose box their name wins. hits: with page, name, method, corners; texts: (page, name, corners, found) the text of each hit.

    A box goes to the name of the smallest: alphanumeric form unlike the text's, rank of the method, difference of lengths, own length, name.
    """
    both = prepared(hits.join(texts, ["page", "name", *CORNERS]), "name").withColumn("found_alpha", X.alphanum(X.norm(F.col("found"))))
    rank = F.coalesce(F.create_map(*[F.lit(v) for kv in METHOD_RANK.items() for v in kv])[F.col("method")], F.lit(5))
    score = F.struct(
        (F.col("alpha") != F.col("found_alpha")).cast("int"), rank, F.abs(F.length("alpha") - F.length("found_alpha")), F.length("name"), F.col("name")
    )
    best = both.groupBy("page", *CORNERS).agg(F.min_by("name", score).alias("name"))
    return hits.join(best, ["page", "name", *CORNERS], "left_semi")


def single_positions(hits: DataFrame, lines: DataFrame, own_text: DataFrame, gap: float = 30.0) -> DataFrame:
    """One hit for each name: names with several get the one of least penalty.

    100 for a cross reference on a line near the hit (20 px of its middle, 300 px of its left edge), 100 for one in its own text (own_text:
    page, name, hit_ord, found), and the distance to the nearest row of a name with one hit. ``clear`` tells that the second is
    ``gap`` or more behind; without a model to ask, the least penalty decides in any case.
    """
    h = hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("page", "name"))).withColumn("cy", (F.col("y1") + F.col("y2")) / 2)
    one, many = h.where("n = 1"), h.where("n > 1")
    marks = lines.where(X.is_cross_reference(F.col("content"))).select("page", F.col("x1").alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"))
    near = many.join(marks, "page").where((F.abs(F.col("my") - F.col("cy")) <= 20) & (F.abs(F.col("mx") - F.col("x1")) <= 300))
    near = near.select("page", "name", "hit_ord").distinct().withColumn("near", F.lit(100.0))
    said = own_text.where(X.is_cross_reference(F.col("found"))).select("page", "name", "hit_ord").distinct().withColumn("said", F.lit(100.0))
    rows = one.select("page", F.col("cy").alias("row_y"))
    far = many.join(rows, "page").groupBy("page", "name", "hit_ord").agg(F.min(F.abs(F.col("cy") - F.col("row_y"))).alias("far"))
    key = ["page", "name", "hit_ord"]
    scored = many.join(near, key, "left").join(said, key, "left").join(far, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = scored.withColumn("penalty", zero("near") + zero("said") + zero("far"))
    w = Window.partitionBy("page", "name").orderBy("penalty", "hit_ord")
    scored = scored.withColumns({"rank": F.row_number().over(w), "next": F.lead("penalty").over(w)}).where("rank = 1")
    scored = scored.withColumn("clear", F.col("next") - F.col("penalty") >= gap)
    out = [*hits.columns, "penalty", "clear"]
    return one.withColumns({"penalty": F.lit(0.0), "clear": F.lit(True)}).select(*out).unionByName(scored.select(*out))


# ── names ───────────────────────────────────────────────────────────────────────────────────────────────────────────────────


def ordered_distinct(names: DataFrame) -> DataFrame:
    """Trimmed, not empty, the first of each kind, in order: page, ord, name."""
    plain = names.select("page", "ord", F.trim("name").alias("name")).where(F.length("name") > 0)
    return plain.groupBy("page", "name").agg(F.min("ord").alias("ord")).select("page", "ord", "name")


def seen_in_text(names: DataFrame, lines: DataFrame) -> DataFrame:
    """Names that some line of the page backs: one holds the other, or they are one character apart. Empty forms back nothing."""
    n, line = prepared(names, "name").alias("n"), prepared(lines, "content").select("page", "alpha").distinct().alias("l")
    a, b = F.col("n.alpha"), F.col("l.alpha")
    holds = (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a) | X.one_apart(a, b))
    return n.join(line, (F.col("n.page") == F.col("l.page")) & holds, "left_semi").select(*names.columns)


def traceable(cleaned: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cleaned names whose guard form is a candidate's, or whose light form is one confusable pair away from a candidate's."""
    forms = candidates.select("page", X.guard_norm(F.col("name")).alias("g"), X.guard_light(F.col("name")).alias("w"))
    own = cleaned.withColumns({"g": X.guard_norm(F.col("name")), "w": X.guard_light(F.col("name"))})
    o, c = own.alias("o"), forms.distinct().alias("c")
    fits = (F.col("o.g") == F.col("c.g")) | X.guard_close(F.col("o.w"), F.col("c.w"))
    return o.join(c, (F.col("o.page") == F.col("c.page")) & fits, "left_semi").select(*cleaned.columns)


def gaps_filled(names: list[str]) -> list[str]:
    """Where a series has both neighbours of a missing number, and one of them twice, one of the two becomes the missing number.

    A series is a prefix, what follows the number, and the number's width. The lower neighbour gives its first, else the upper its last. Names
    without a number come first.
    """
    series: dict[tuple[str, str, int], list[int]] = {}
    out: list[str] = []
    for name in names:
        m = re.match(r"^(.*?)(\d+)([^0-9]*)$", name)
        if m:
            series.setdefault((m[1], m[3], len(m[2])), []).append(int(m[2]))
        else:
            out.append(name)
    for (prefix, suffix, width), numbers in series.items():
        left, known = Counter(numbers), sorted(set(numbers))
        numbers = list(numbers)
        for low, high in zip(known, known[1:]):
            if high - low != 2:
                continue
            if left[low] > 1:
                at, gone = numbers.index(low), low
            elif left[high] > 1:
                at, gone = len(numbers) - 1 - numbers[::-1].index(high), high
            else:
                continue
            numbers[at] = low + 1
            left[gone] -= 1
            left[low + 1] += 1
        out += [f"{prefix}{n:0{width}d}{suffix}" for n in numbers]
    return out


def series_gaps_filled(names: DataFrame) -> DataFrame:
    page = lambda rows: [(rows[0][0], n, name) for n, name in enumerate(gaps_filled([r[2] for r in rows]))]
    return fold_groups(names.select("page", "ord", "name"), ("page",), ("ord",), page, "page long, ord long, name string")


def superseded(names: DataFrame) -> DataFrame:
    """Names without those of which the page has a longer form ``name (UPPER)`` or ``name (LOWER)``."""
    ends = r"(?i)\s*\((?:upper|lower)\)$"
    longer = names.where(F.regexp_like("name", F.lit(r"(?i)^.+\((?:upper|lower)\)$"))).select("page", F.trim(F.regexp_replace("name", ends, "")).alias("name"))
    return names.join(longer.distinct(), ["page", "name"], "left_anti")


def supplemented(names: DataFrame, lines: DataFrame) -> DataFrame:
    """Longer forms that lines show, ``PREFIX-name`` (or _ or a space between) at the line's end or before a space, and the page doesn't have: (page, name)."""
    n, line = names.select("page", "name").alias("n"), lines.select("page", F.trim("content").alias("content")).distinct().alias("l")
    form = F.concat(F.lit(r"(?i)[A-Z0-9][-A-Z0-9]*[-_ ]"), X.quoted(F.col("n.name")), F.lit(r"(?=\s|$)"))
    found = n.join(line, F.col("n.page") == F.col("l.page")).select("n.page", F.regexp_substr("l.content", form).alias("name"))
    return found.where("name is not null").distinct().join(names, ["page", "name"], "left_anti")


# ── lines ───────────────────────────────────────────────────────────────────────────────────────────────────────────────────


def without_noise(lines: DataFrame) -> DataFrame:
    return lines.where(~X.is_noise(F.col("content")))


def without_frequent(lines: DataFrame, names: DataFrame, least: int = 5) -> DataFrame:
    """Without texts that a page has ``least`` times or more, unless they are a word of one of its names."""
    own = lines.withColumn("normed", X.norm(F.col("content")))
    own = own.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("page", "normed")))
    words = names.select("page", F.explode(F.split(X.norm(F.col("name")), " ")).alias("normed")).distinct().withColumn("known", F.lit(True))
    kept = own.join(words, ["page", "normed"], "left").where((F.col("times") < least) | F.col("known"))
    return kept.select(*lines.columns)


def paired(lines: list[tuple[int, str, tuple]], factor: float = 1.5, least: float = 0.3) -> list[tuple[list[int], str, tuple]]:
    """Lines that belong together in twos, top to bottom: (ords, text, box). A line takes the first lower one that is near and under it."""
    rows = sorted(lines, key=lambda r: (r[2][1], r[2][0]))
    used, out = set(), []
    for i, (ord_, text, a) in enumerate(rows):
        if i in used:
            continue
        mate = None
        for j in range(i + 1, len(rows)):
            b = rows[j][2]
            if j in used or b[1] < a[3] - 2:
                continue
            if b[1] - a[3] > factor * (max(a[3] - a[1], 1) + max(b[3] - b[1], 1)) / 2:
                break
            if max(0, min(a[2], b[2]) - max(a[0], b[0])) / max(a[2] - a[0], b[2] - b[0], 1) >= least:
                mate = j
                break
        if mate is None:
            out.append(([ord_], text, a))
        else:
            used.add(mate)
            other, more, b = rows[mate]
            out.append(([ord_, other], f"{text.strip()} {more.strip()}", (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))))
    return out


def split_lines_merged(lines: DataFrame) -> DataFrame:
    """(page, ord, content, corners, merged): ord is the upper line's."""

    def page(rows: list[tuple]) -> list[tuple]:
        own = [(ord_, text, tuple(box)) for _, ord_, text, *box in rows]
        return [(rows[0][0], ords[0], text, *box, len(ords) > 1) for ords, text, box in paired(own)]

    schema = "page long, ord long, content string, x1 long, y1 long, x2 long, y2 long, merged boolean"
    return fold_groups(lines.select("page", "ord", "content", *CORNERS), ("page",), ("ord",), page, schema)


# ── serial names ────────────────────────────────────────────────────────────────────────────────────────────────────────────


def _placed(matched: DataFrame) -> DataFrame:
    """matched: (page, name, corners) of the first hit. With prefix, number, cx, cy; names without a number go."""
    own = matched.withColumn("s", X.serial(X.norm(F.col("name")))).where("s is not null")
    x, y = B.centre(B.box())
    return own.select("page", "name", "s.prefix", "s.number", "s.suffix", x.alias("cx"), y.alias("cy"))


def series_lines(matched: DataFrame) -> DataFrame:
    """The least-squares line of cx (and cy) over the number, for each page and prefix: slopes 0 where the numbers don't vary."""
    placed = _placed(matched)
    slope = lambda c: F.coalesce(F.regr_slope(c, "number"), F.lit(0.0))
    return placed.groupBy("page", "prefix").agg(
        F.count(F.lit(1)).alias("n"), F.avg("number").alias("mean_number"), F.avg("cx").alias("mean_cx"), F.avg("cy").alias("mean_cy"),
        slope("cx").alias("slope_cx"), slope("cy").alias("slope_cy"),
    )


def anchored_rows(values: list[float], tolerance: float) -> list[int]:
    """The row of each value (ascending): the first row whose first value is within the tolerance."""
    firsts, out = [], []
    for v in values:
        row = next((k for k, f in enumerate(firsts) if abs(v - f) <= tolerance), len(firsts))
        if row == len(firsts):
            firsts.append(v)
        out.append(row)
    return out


def _in_rows(placed: DataFrame, order: tuple[str, ...], tolerance: float) -> DataFrame:
    """Adds ``row``: the row of each place among those of its page and prefix, by cy."""
    at = placed.columns.index("cy")
    fold = lambda rows: [(*r, n) for r, n in zip(rows, anchored_rows([r[at] for r in rows], tolerance))]
    return fold_groups(placed, ("page", "prefix"), order, fold, with_number(placed, "row"))


def position_hints(matched: DataFrame, unmatched: DataFrame, tolerance: float = 40.0) -> DataFrame:
    """Expected centre of unmatched serial names: (page, name, cx, cy).

    Matched names of the prefix fall into rows; the row whose numbers hold the name's in the smallest range counts, or else the one of the
    smallest distance and range; its least-squares lines give the place.
    """
    placed = _placed(matched).select("page", "prefix", "number", "cx", "cy")
    missing = unmatched.withColumn("s", X.serial(X.norm(F.col("name")))).where("s is not null").select("page", "name", "s.prefix", "s.number")

    rows = _in_rows(placed, ("cy", "number", "cx"), tolerance)
    slope = lambda c: F.coalesce(F.regr_slope(c, "number"), F.lit(0.0))
    fit = rows.groupBy("page", "prefix", "row").agg(
        F.min("number").alias("low"), F.max("number").alias("high"), F.avg("number").alias("mean"),
        F.avg("cx").alias("mx"), F.avg("cy").alias("my"), slope("cx").alias("sx"), slope("cy").alias("sy"),
    )
    n = F.col("number")
    inside = n.between(F.col("low"), F.col("high"))
    away = F.least(F.abs(n - F.col("low")), F.abs(n - F.col("high")))
    score = F.when(inside, F.lit(0)).otherwise(away) + F.col("high") - F.col("low")
    best = missing.join(fit, ["page", "prefix"]).withColumn("score", score)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("page", "name").orderBy("score", "row"))).where("rank = 1")
    at = n - F.col("mean")
    return best.select("page", "name", (F.col("mx") + F.col("sx") * at).alias("cx"), (F.col("my") + F.col("sy") * at).alias("cy"))


def inversions(matched: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """Neighbours of a row (by cx) whose numbers run against the row's direction: page, prefix, name, next_name, direction."""
    placed = _placed(matched)

    rows = _in_rows(placed, ("cy", "cx", "name"), tolerance)
    w = Window.partitionBy("page", "prefix", "row").orderBy("cx", "name")
    rows = rows.withColumns({"next": F.lead("number").over(w), "next_name": F.lead("name").over(w)})
    whole = Window.partitionBy("page", "prefix", "row")
    up, down = F.sum((F.col("next") > F.col("number")).cast("int")).over(whole), F.sum((F.col("next") < F.col("number")).cast("int")).over(whole)
    rows = rows.withColumn("direction", F.when(F.coalesce(up, F.lit(0)) >= F.coalesce(down, F.lit(0)), 1).otherwise(-1))
    against = ((F.col("direction") == 1) & (F.col("next") < F.col("number"))) | ((F.col("direction") == -1) & (F.col("next") > F.col("number")))
    return rows.where(against).select("page", "prefix", "name", "next_name", "direction")


# Digits that recognition takes for others, in the order of trial.
_DIGITS = (("1", "0"), ("6", "0"), ("8", "0"), ("5", "6"), ("0", "6"), ("0", "8"))


def renumbered(name: str, number: int) -> str:
    """The name with its last number replaced, filled up with zeros to its width."""
    m = re.search(r"(\d+)(?=[^0-9]*$)", name)
    return name if not m else name[: m.start()] + str(number).zfill(len(m[0])) + name[m.end() :]


def corrected_series(names: dict[str, tuple], rounds: int = 1000) -> tuple[dict[str, tuple], list[tuple[str, str, str]]]:
    """names: name -> box of one page. Corrected names, and what was done: (kind, before, after).

    Of neighbours in a row that run against its direction, the two swap boxes if both then fit between their neighbours; else the first gets a
    number that does, by a likely misread digit or by one more or less, unless the page has that name. A swap moves them in the row,
    which is then sorted again, so the loop ends (``rounds`` is a safeguard).
    """
    names, done = dict(names), []
    series: dict[str, list[list]] = {}
    for name, b in names.items():
        s = parse_serial(_plain(name))
        if s:
            series.setdefault(s[0], []).append([s[1], name, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2])
    for members in series.values():
        members.sort(key=lambda m: (m[3], m[2]))
        groups: dict[int, list[list]] = {}
        for m, row in zip(members, anchored_rows([m[3] for m in members], 15)):
            groups.setdefault(row, []).append(m)
        for row in groups.values():
            row.sort(key=lambda m: m[2])
            steps = [b[0] - a[0] for a, b in zip(row, row[1:])]
            sign = 1 if sum(s > 0 for s in steps) >= sum(s < 0 for s in steps) else -1
            for _ in range(rounds):
                if not _one_correction(row, sign, names, done):
                    break
    return names, done


def _alpha(normed: str) -> str:
    return re.sub("[^a-z0-9]", "", normed)


def parse_serial(normed: str) -> tuple[str, int, str] | None:
    """Prefix, number and suffix, as ``text.serial`` has them."""
    m = re.match(X.SERIAL, normed, re.ASCII)
    return (m[1], int(m[2]), m[3]) if m else None


def _plain(name: str) -> str:
    import unicodedata

    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name).strip().lower())


def _one_correction(row: list[list], sign: int, names: dict[str, tuple], done: list) -> bool:
    for i in range(len(row) - 1):
        first, second = row[i], row[i + 1]
        if sign * first[0] <= sign * second[0]:
            continue
        before = row[i - 1][0] if i else first[0] - sign
        after = row[i + 2][0] if i + 2 < len(row) else second[0] + sign
        if sign * before < sign * second[0] and sign * first[0] < sign * after:
            names[first[1]], names[second[1]] = names[second[1]], names[first[1]]
            first[2:], second[2:] = second[2:], first[2:]
            row.sort(key=lambda m: m[2])
            done.append(("swap", first[1], second[1]))
            return True
        edge = row[i - 1][0] if i else (0 if sign == 1 else first[0] + 1)
        low, high = (edge, second[0]) if sign == 1 else (second[0], edge)
        known = {_alpha(_plain(n)) for n in names if n not in (first[1], second[1])}
        shown = str(first[0])
        tries = [int(shown[:p] + good + shown[p + 1 :]) for p in range(len(shown)) for bad, good in _DIGITS if shown[p] == bad]
        for number in [*tries, first[0] + 1, first[0] - 1]:
            new = renumbered(first[1], number)
            if low < number < high and new != first[1] and _alpha(_plain(new)) not in known:
                names[new] = names.pop(first[1])
                done.append(("rename", first[1], new))
                first[0], first[1] = number, new
                return True
    return False


def serial_outliers_corrected(matched: DataFrame) -> DataFrame:
    """(page, name, corners, was): every matched name after correction; was: the name before, where it changed."""

    def page(rows: list[tuple]) -> list[tuple]:
        names, done = corrected_series({name: tuple(box) for _, _, name, *box in rows})
        was: dict[str, str] = {}
        for kind, old, new in done:
            if kind == "rename":
                was[new] = was.pop(old, old)
        return [(rows[0][0], name, *box, was.get(name)) for name, box in names.items()]

    own = matched.select("page", "ord", "name", *CORNERS)
    return fold_groups(own, ("page",), ("ord",), page, "page long, name string, x1 long, y1 long, x2 long, y2 long, was string")


def gaps_by_position(matched: DataFrame, unmatched: DataFrame, lines: DataFrame, dx: float = 30.0, dy: float = 15.0) -> DataFrame:
    """Unmatched serial names with the nearest unclaimed line at their expected place: (page, name, line, corners).

    Expected are the least-squares cx over the number and the mean cy of the matched names of the prefix, of which there must be two or more.
    Candidates come from a range join; who claims a line first (by the names' order) is a fold over one page's candidates.
    """
    fit = series_lines(matched).where("n >= 2").select("page", "prefix", "mean_number", "mean_cx", "mean_cy", "slope_cx")
    missing = unmatched.withColumn("s", X.serial(X.norm(F.col("name")))).where("s is not null").select("page", "ord", "name", "s.prefix", "s.number")
    want = missing.join(fit, ["page", "prefix"]).withColumn("want", F.col("mean_cx") + F.col("slope_cx") * (F.col("number") - F.col("mean_number")))
    x, y = B.centre(B.box(alias="l"))
    w, line = want.alias("w"), lines.alias("l")
    near = w.join(line, F.col("w.page") == F.col("l.page")).withColumn("off", F.abs(x - F.col("w.want")))
    near = near.where((F.col("off") <= dx) & (F.abs(y - F.col("w.mean_cy")) <= dy))
    near = near.select("w.page", F.col("w.ord").alias("name_ord"), "w.prefix", "w.name", "off", F.col("l.ord").alias("line"), *[F.col(f"l.{c}").alias(c) for c in CORNERS])
    free = near.join(unsized(matched.select("page", *CORNERS).distinct()), ["page", *CORNERS], "left_anti")

    def page(rows: list[tuple]) -> list[tuple]:
        taken, out, named = set(), [], set()
        for key, _, _, name, _, line_, *box in rows:
            if name not in named and tuple(box) not in taken:
                named.add(name)
                taken.add(tuple(box))
                out.append((key, name, line_, *box))
        return out

    free = free.select("page", "name_ord", "prefix", "name", "off", "line", *CORNERS)
    schema = "page long, name string, line long, x1 long, y1 long, x2 long, y2 long"
    return fold_groups(free, ("page",), ("prefix", "name_ord", "off", "line"), page, schema)


def aligned_lines(matched: DataFrame, unmatched: DataFrame, lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(page, name, ord): lines whose middle is level with a matched name of the same prefix, in x or y, for each unmatched name."""
    placed = _placed(matched).select("page", "prefix", "cx", "cy").alias("s")
    missing = unmatched.withColumn("s", X.serial(X.norm(F.col("name")))).where("s is not null").select("page", "name", "s.prefix").alias("u")
    x, y = B.centre(B.box(alias="l"))
    line = lines.alias("l")
    level = (F.abs(x - F.col("s.cx")) <= tolerance) | (F.abs(y - F.col("s.cy")) <= tolerance)
    on = missing.join(placed, (F.col("u.page") == F.col("s.page")) & (F.col("u.prefix") == F.col("s.prefix")))
    found = on.join(line, F.col("u.page") == F.col("l.page")).where(level)
    return found.select(F.col("u.page").alias("page"), F.col("u.name").alias("name"), F.col("l.ord").alias("ord")).distinct()


def unmatched_names(names: DataFrame, matched: DataFrame) -> DataFrame:
    return names.join(matched.select("page", "name"), ["page", "name"], "left_anti")


def first_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each name; confidence .8 where it has none."""
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("page", "name").orderBy("hit_ord"))).where("rank = 1").drop("rank")
    return best.withColumn("confidence", F.coalesce("confidence", F.lit(0.8)) if "confidence" in hits.columns else F.lit(0.8))


def matched_by_model(replies: DataFrame, lines: DataFrame) -> DataFrame:
    """Boxes of a model's choices: replies (page, name, occurrence, line_indices: 1-based places in the page's lines, confidence).

    Places off the list are dropped; an occurrence without any is none. Out: page, name, occurrence, confidence, corners around its lines.
    """
    placed = lines.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("ord")))
    each = replies.withColumn("place", F.explode("line_indices"))
    return each.join(placed, ["page", "place"]).groupBy("page", "name", "occurrence", "confidence").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
