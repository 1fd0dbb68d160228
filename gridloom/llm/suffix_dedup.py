"""Removal of long byte strings that occur twice, by sparse suffix sorting of what can repeat.

Every string of ``span`` bytes holds a smallest gram (by a hash; of equal ones the last): its anchor. Equal strings have equal anchors at
equal places, so only around grams that are an anchor twice can anything repeat. All strings with one anchor form a stretch of text,
the anchor's context; equal contexts are a class, and whatever lies in a class of two or more repeats. Contexts that stand alone but
share their gram with others go on: the suffixes from their anchors on, and the prefixes before them turned round, are put in order
by deep-shallow sorting (deep_shallow.py). The common prefixes of neighbours make a tree of the suffixes; in each of its nodes the neighbours in
the order of the prefixes tell how far a context agrees with any other of the node to both sides of the anchor, and so which strings it
shares. What leaves a task is runs of strings, never a row for each. Contexts of one class travel once.

Several spans can be asked for at once: contexts are those of the shortest, widened to hold the strings of the others.

A task sorts at most ``CROWD`` contexts of one gram, which bounds its memory. Beyond that a crowd is split, as often as needed, by ``PARTS`` ranges
of where strings start: the strings of a range have a core in common places, and only contexts that agree on it meet, in
sorting groups of their own; equal ones are a class again. Ranges of one start leave equal strings only, so the splitting ends.

Defined results: a null text counts as empty; matches are between all rows, so a repeated row or copy of ``span`` bytes or more repeats
whole, the first one included; a text shorter than that stays; an empty table gives an empty result; other columns are carried along,
whatever their names, but ``without_repeats`` gives its own columns in the place of any that are called alike. A text is known by 128 bits of its SHA-256, a class by its gram's hash and 64 bits of XXH3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .deep_shallow import RangeMinimum, sort_groups
from .piece_codec import _portions
from .shared import forget, keep, partitions, release_shuffles, unsized, whole_row

#: Bytes of a string that may not occur twice.
SPAN = 400
#: A passage: a run of repeating strings of PASSAGE bytes that holds WORDS words, or SPAN bytes. WORDS words of three letters have as many.
PASSAGE, WORDS = 200, 50
#: Contexts of one gram that are sorted in one task.
CROWD = 1 << 14
#: Ranges that a crowd is split into.
PARTS = 8
#: Places of one context that a row holds, at most.
PLACES = 64
#: Spans that are made at once, about.
SPANS = 200_000
#: String starts of one text that are looked at together.
STRETCH = 1 << 19

#: Bits of each of the four numbers of a context's shape.
_SHAPE = 15


def gram_bytes(span: int) -> int:
    return max(1, min(64, span // 4))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Grams:
    """Hashes of all grams of a stretch of text, from sums of byte codes times powers of an odd base, modulo 2**64."""

    def __init__(self, most: int):
        base = 0x9E3779B97F4A7C15
        self.up, self.down = _powers(base, most), _powers(pow(base, -1, 1 << 64), most)
        self.codes = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], dtype=np.uint64)

    def __call__(self, raw: np.ndarray, gram: int) -> np.ndarray:
        sums = np.append(np.uint64(0), np.cumsum(self.codes[raw] * self.up[: len(raw)]))
        n = len(raw) - gram + 1
        g = (sums[gram:] - sums[:-gram]) * self.down[:n]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        return g ^ (g >> np.uint64(32))


_GRAMS: dict[int, _Grams] = {}


def anchors(raw: bytes, span: int = SPAN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of a text: hash and place of each anchor, and the first and last start of the strings that it anchors."""
    gram, most = gram_bytes(span), STRETCH + span
    if most not in _GRAMS:
        _GRAMS[most] = _Grams(most)
    near = span - gram + 1  # grams in a string
    low = np.uint64((1 << 20) - 1)
    for at in range(0, len(raw) - span + 1, STRETCH):
        grams = _GRAMS[most](np.frombuffer(raw, dtype=np.uint8)[at : at + STRETCH + span - 1], gram)
        place = low - np.arange(len(grams), dtype=np.uint64)  # of equal hashes, the last place is the smallest
        key = np.append((grams & ~low) | place, np.full(-len(grams) % near, ~np.uint64(0))).reshape(-1, near)
        ahead = np.minimum.accumulate(key, axis=1).reshape(-1)
        back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(grams) - near + 1
        least = np.minimum(back[:n], ahead[near - 1 : near - 1 + n])
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        where = (low - (least[first] & low)).astype(np.int64)
        yield grams[where].view(np.int64), where + at, first + at, np.append(first[1:], n) - 1 + at


#: places: one after the other, where a portion of texts has the context's anchor: 16 bytes of t and 4 (big-endian) of the place.
_ANCHOR = "h long, c long, shape long, places binary"
_PLACE = 20


def _anchor_rows(spans: tuple[int, ...]):
    """(t, text as bytes) in; a row for each context (and PLACES of it) of a portion of texts out, so that a context many texts share is few rows.

    The context begins ``lead`` bytes before its anchor and has ``size`` bytes; it holds all strings that the anchor stands for. Its shape is lead, size, and how far
    before the anchor the first and the last of the shortest strings start.
    """
    least, most = spans[0], spans[-1]
    margin = (most - least) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in _portions(batch.column(1), 2 << 20):
                part = batch.slice(at, size)
                ts, found = [], []
                for t, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for h, where, first, last in anchors(raw, least):
                        begin, end = np.maximum(0, first - margin), np.minimum(len(raw), last + most - margin)
                        shape = ((((((where - begin) << _SHAPE) | (end - begin)) << _SHAPE) | (where - first)) << _SHAPE) | (where - last)
                        digest = xxhash.xxh3_64_intdigest
                        c = np.array([digest(raw[a:b], s) for a, b, s in zip(begin.tolist(), end.tolist(), shape.tolist())], dtype=np.uint64)
                        found.append((h, c.view(np.int64), shape, where))
                        ts += [t] * len(h)
                if not ts:
                    continue
                cols = [np.concatenate(x).astype(np.int64) for x in zip(*found)]
                order = np.lexsort((cols[1], cols[0]))
                h, c, shape, where = [x[order] for x in cols]
                place = np.empty((len(ts), _PLACE), dtype=np.uint8)
                place[:, :16] = np.frombuffer(b"".join(ts), dtype=np.uint8).reshape(-1, 16)[order]
                place[:, 16:] = where.astype(">i4").view(np.uint8).reshape(-1, 4)
                new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
                since = np.arange(len(ts)) - np.maximum.accumulate(np.where(new, np.arange(len(ts)), 0))
                starts = np.flatnonzero(since % PLACES == 0)
                edges = (_PLACE * np.append(starts, len(ts))).astype(np.int32)
                places = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(place.tobytes())])
                yield pa.RecordBatch.from_arrays([*[pa.array(x[starts]) for x in (h, c, shape)], places], ["h", "c", "shape", "places"])

    return run


def _shape_part(k: int) -> Column:
    """lead, size, first and last are parts 3, 2, 1 and 0 of a shape."""
    return F.shiftright("shape", _SHAPE * k).bitwiseAND(F.lit((1 << _SHAPE) - 1)).cast("int")


def _text_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(places, runs) in; (t, span, start, end) of the runs in each text out, each once in a portion of about SPANS."""
    for batch in batches:
        places = np.diff(np.frombuffer(batch.column(0).buffers()[1], dtype=np.int32)[batch.column(0).offset :][: batch.num_rows + 1]) // _PLACE
        portion = np.cumsum(places * np.diff(batch.column(1).offsets.to_numpy())) // SPANS
        edges = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield _spans_of(batch.slice(a, b - a))


def _spans_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    places, runs = batch.column(0), batch.column(1)
    edges = np.frombuffer(places.buffers()[1], dtype=np.int32)[places.offset : places.offset + len(places) + 1]
    raw = np.frombuffer(places.buffers()[2], dtype=np.uint8)[edges[0] : edges[-1]].reshape(-1, _PLACE)
    row = np.repeat(np.arange(len(places)), np.diff(edges) // _PLACE)
    anchor = raw[:, 16:].copy().view(">i4").reshape(-1).astype(np.int64)
    offsets = runs.offsets.to_numpy()
    n, begin = np.diff(offsets)[row], (offsets[:-1] - offsets[0])[row]
    flat = runs.flatten()
    span, low, high = (flat.field(k).to_numpy().astype(np.int64) for k in ("span", "from", "to"))
    place = np.repeat(np.arange(len(row)), n)
    which = begin[place] + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    out = np.empty(len(place), dtype=[("t", "V16"), ("span", "<i8"), ("start", "<i8"), ("end", "<i8")])
    out["t"] = raw[:, :16].copy().view("V16").reshape(-1)[place]
    out["span"], out["start"], out["end"] = span[which], anchor[place] + low[which], anchor[place] + high[which]
    out = np.unique(out.view("V40")).view(out.dtype)
    t = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(out), [None, pa.py_buffer(out["t"].tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([t, *[pa.array(out[k].copy()) for k in ("span", "start", "end")]], ["t", "span", "start", "end"])


#: A context of the group g: whose class it is (h, c), the span it is sorted for (0: all), where its anchor lies, its bytes.
_ITEM = "g long, h long, c long, span int, lead int, bytes binary"
_ITEM_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(raw, wanted) in; the contexts of the wanted anchors out."""
    for batch in batches:
        for at, size in _portions(batch.column(0)):
            part = batch.slice(at, size)
            rows = []
            for raw, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows += [(w["h"], w["h"], w["c"], 0, w["lead"], raw[w["begin"] : w["begin"] + w["size"]]) for w in wanted]
            yield _batch(rows, ["g", "h", "c", "span", "lead", "bytes"], _ITEM_KINDS)


def _split(spans: tuple[int, ...], step: int):
    """Items of crowded groups in; one for each range of ``step`` string starts out, g the hash of group, span, range and core, d that of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for g, h, c, own, lead, raw in zip(*(x.to_pylist() for x in batch.columns)):
                for span in (own,) if own else spans:
                    # starts of strings that hold the anchor's first byte, relative to it
                    low, high = max(-lead, 1 - span), min(0, len(raw) - lead - span)
                    for k in range(low // step, high // step + 1) if high >= low else ():
                        first, last = k * step, min(0, (k + 1) * step - 1)
                        core = raw[lead + last : lead + max(last, first + span)]  # what all strings of the range cover
                        a, b = max(low, first), min(high, last)
                        key = digest(core, (g + 0x9E3779B97F4A7C15 * (span * 4099 - k)) & 0xFFFFFFFFFFFFFFFF)
                        bytes_ = raw[lead + a : lead + b + span]
                        rows.append((_signed(key), h, c, span, -a, bytes_, _signed(digest(bytes_, -a))))
            yield _batch(rows, ["g", "h", "c", "span", "lead", "bytes", "d"], [*_ITEM_KINDS, pa.int64()])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shared_starts(items: list[tuple[int, bytes]], group: np.ndarray, spans: list[tuple[int, ...]]) -> tuple[np.ndarray, ...]:
    """items: (lead, bytes) of contexts; spans: for each group the spans asked for. Runs (item, span, from, to) of the starts, relative to the
    anchor, of strings that another item of its group has at the same place."""
    order, right = sort_groups([raw[lead:] for lead, raw in items], group)
    left_order, left = sort_groups([raw[:lead][::-1] for lead, raw in items], group)
    place = np.empty(len(items), dtype=np.int64)
    place[left_order] = np.arange(len(items))
    place = place[order]  # where the context that is i-th by its suffix stands by its prefix
    agrees = RangeMinimum(left)
    asked = sorted({s for some in spans for s in some})
    wants = np.array([[s in some for s in asked] for some in spans])
    found = []
    # the nodes of one level of the tree of suffixes: ``now`` their members, by suffix, ``head`` where a node begins
    now, head = np.arange(len(items)), np.append(True, group[order][1:] != group[order][:-1])
    while True:
        at = np.flatnonzero(head)
        stay = np.repeat(np.diff(np.append(at, len(now))) > 1, np.diff(np.append(at, len(now))))
        now, head = now[stay], head[stay]
        if not len(now):
            break
        node = np.cumsum(head) - 1
        depth = np.where(head, np.iinfo(np.int64).max, right[now])
        reach = np.minimum.reduceat(depth, np.flatnonzero(head))[node]  # how far all members of a node agree behind the anchor
        by = np.lexsort((place[now], node))
        by_place, by_node = place[now][by], node[by]
        pair = np.flatnonzero(by_node[1:] == by_node[:-1])
        common = agrees(by_place[pair] + 1, by_place[pair + 1])
        back = np.zeros(len(now), dtype=np.int64)  # how far a member agrees with the nearest other before the anchor
        np.maximum.at(back, by[pair], common)
        np.maximum.at(back, by[pair + 1], common)
        who = order[now]
        for k, span in enumerate(asked):
            hit = np.flatnonzero((back + reach >= span) & wants[group[who], k])
            found.append((who[hit], np.full(len(hit), span), -back[hit], reach[hit] - span))
        head = head | (depth == reach)
    if not found:
        return (np.empty(0, dtype=np.int64),) * 4
    return _maximal(*(np.concatenate(x) for x in zip(*found)))


def _maximal(who: np.ndarray, span: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs that overlap or touch, made one."""
    if not len(who):
        return who, span, low, high
    by = np.lexsort((low, span, who))
    who, span, low, high = who[by], span[by], low[by], high[by]
    new = np.append(True, (who[1:] != who[:-1]) | (span[1:] != span[:-1]))
    far = 1 << 32
    upto = np.maximum.accumulate(high + far * np.cumsum(new)) - far * np.cumsum(new)
    new[1:] |= low[1:] > upto[:-1] + 1
    starts = np.flatnonzero(new)
    return who[starts], span[starts], low[starts], upto[np.append(starts[1:], len(who)) - 1]


_RUN = "h long, c long, span int, from int, to int"


def _resolve(spans: tuple[int, ...]):
    """Items sorted by g; at most CROWD of one g. Out: the runs of string starts that repeat, relative to the anchor, of each item's class."""

    def resolved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        g, own = rows["g"].to_numpy(), rows["span"].to_numpy()
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g))))
        asked = [(s,) if s else spans for s in own[first].tolist()]
        who, span, low, high = shared_starts(list(zip(rows["lead"].to_pylist(), rows["bytes"].to_pylist())), group, asked)
        if len(who):
            cols = [rows["h"].to_numpy()[who], rows["c"].to_numpy()[who], *(x.astype(np.int32) for x in (span, low, high))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "c", "span", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                now = pa.Table.from_batches([batch.slice(at, 2048)])
                g = now["g"].to_numpy()
                change = np.flatnonzero(g[1:] != g[:-1])
                before = held and held[-1]["g"][-1].as_py() != g[0]
                if before or len(change):
                    cut = int(change[-1]) + 1 if len(change) else 0
                    yield from resolved(pa.concat_tables([*held, now.slice(0, cut)]).combine_chunks())
                    held, now = [], now.slice(cut)
                held.append(now)
        if held:
            yield from resolved(pa.concat_tables(held).combine_chunks())

    return run


def _sorted(items: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    own = items.select("g", "h", "c", "span", "lead", "bytes")
    return own.repartition(partitions(items.sparkSession), "g").sortWithinPartitions("g").mapInArrow(_resolve(spans), _RUN)


def _known_by(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _own(docs: DataFrame, least: int) -> DataFrame:
    own = docs.select(_known_by(_text()).alias("t"), F.encode(_text(), "UTF-8").alias("raw"))
    return own.where(F.octet_length("raw") >= least)


def _whole(classes: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """(h, c, lead, size) of contexts that repeat whole: runs of all their strings, of each span."""
    each = F.explode(F.array(*[F.lit(s) for s in spans])).alias("span")
    own = classes.select("h", "c", "lead", "size", each)
    return own.select("h", "c", "span", (-F.col("lead")).alias("from"), (F.col("size") - F.col("lead") - F.col("span")).alias("to")).where(F.col("to") >= F.col("from"))


def _crowds(items: DataFrame, spans: tuple[int, ...]) -> tuple[list[DataFrame], list[DataFrame]]:
    """items with m, the number of their group: the runs found, and the tables that hold them."""
    step, runs, tables = spans[-1], [_sorted(items.where(F.col("m") <= CROWD), spans)], []
    many = items.where(F.col("m") > CROWD)
    while step > 1 and not many.isEmpty():
        step = -(-step // PARTS)
        parts = keep(many.select("g", "h", "c", "span", "lead", "bytes").mapInArrow(_split(spans, step), _ITEM + ", d long"), "parts")
        classes = keep(parts.groupBy("g", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "c")).alias("one")), "part_classes")
        sizes = keep(classes.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("g", "m"), "sizes")
        tables += [parts, classes, sizes]
        equal = parts.join(classes.where("n > 1").select("g", "d"), ["g", "d"], "left_semi")
        runs.append(equal.select("h", "c", "span", (-F.col("lead")).alias("from"), (F.octet_length("bytes") - F.col("lead") - F.col("span")).alias("to")))
        one = parts.join(classes.select("g", "d", "one"), ["g", "d"]).where((F.col("h") == F.col("one.h")) & (F.col("c") == F.col("one.c")))
        left = one.join(sizes, "g").select("g", "m", "h", "c", "span", "lead", "bytes")
        runs.append(_sorted(left.where(F.col("m") <= CROWD), spans))
        many = left.where(F.col("m") > CROWD)
    return runs, tables


def repeated_spans(docs: DataFrame, spans: tuple[int, ...] = (SPAN,)) -> DataFrame:
    """(t, spans): for each different text with repeats, known by t, the runs (span, start, end) of starts of strings that repeat, end included.

    spans: how many bytes a string has, ascending.
    """
    spark = docs.sparkSession
    if list(spans) != sorted(set(spans)) or spans[0] < 2 or 2 * spans[-1] >= 1 << _SHAPE:
        raise ValueError(f"spans are different, ascending, from 2 to {(1 << _SHAPE - 1) - 1}")
    everything = keep(_own(docs, spans[0]).mapInArrow(_anchor_rows(spans), _ANCHOR), "anchors")
    size = F.octet_length("places") / _PLACE
    # written before they are joined, so that Spark may split the rows of a common gram among tasks
    twice = keep(everything.groupBy("h").agg(F.sum(size).alias("n")).where("n > 1").select("h"), "twice")
    release_shuffles(spark)
    found = keep(everything.join(twice, "h", "left_semi"), "repeated")
    forget(everything, twice)
    release_shuffles(spark)
    classes = found.groupBy("h", "c", "shape").agg(F.sum(size).alias("n"), F.min(F.substring("places", 1, _PLACE)).alias("one"))
    where = F.conv(F.hex(F.substring("one", 17, 4)), 16, 10).cast("int")
    classes = classes.select("h", "c", "n", F.substring("one", 1, 16).alias("t"), _shape_part(3).alias("lead"), _shape_part(2).alias("size"), where.alias("where"))
    classes = keep(classes, "classes")
    release_shuffles(spark)
    open_ = keep(classes.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("h", "m"), "open")
    wanted = classes.join(open_.select("h"), "h").groupBy("t").agg(F.collect_list(F.struct("h", "c", (F.col("where") - F.col("lead")).alias("begin"), "lead", "size")).alias("wanted"))
    texts = _own(docs, spans[0]).dropDuplicates(["t"])
    items = keep(texts.join(wanted, "t").select("raw", "wanted").mapInArrow(_contexts, _ITEM), "contexts")
    del wanted, texts
    release_shuffles(spark)
    many = not open_.where(F.col("m") > CROWD).isEmpty()
    repeats, tables = _crowds(items.join(open_.withColumnRenamed("h", "g"), "g"), spans) if many else ([_sorted(items, spans)], [])
    repeats.append(_whole(classes.where("n > 1"), spans))
    runs = repeats[0]
    for more in repeats[1:]:
        runs = runs.unionByName(more)
    runs = keep(runs.groupBy("h", "c").agg(F.sort_array(F.collect_set(F.struct("span", "from", "to"))).alias("runs")), "runs")
    release_shuffles(spark)
    # rows of a common context lie together after the join; each stands for up to PLACES spans, so they are dealt anew
    at = found.join(unsized(runs), ["h", "c"]).select("places", "runs").repartition(partitions(spark)).mapInArrow(_text_spans, "t binary, span long, start long, end long").distinct()
    spans_of = keep(at.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("span", "start", "end"))).alias("spans")), "spans")
    forget(found, classes, open_, items, runs, *tables)
    release_shuffles(spark)
    return spans_of


def _ranges(spans: list[dict] | None, span: int) -> list[tuple[int, int]]:
    """Maximal byte ranges (start, end excluded) of sorted runs of string starts."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if s["span"] == span:
            a, b = s["start"], s["end"] + span
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(out[-1][1], b)
            else:
                out.append((a, b))
    return out


def _passages(raw: bytes, spans: list[dict] | None, span: int, words: int, enough: int) -> list[tuple[int, int]]:
    """Ranges of ``words`` words or ``enough`` bytes."""
    return [(a, b) for a, b in _ranges(spans, span) if b - a >= enough or len(raw[a:b].split()) >= words]


def _without(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for pair in ranges for x in pair), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if ranges else raw


def _mapped(docs: DataFrame, spans: tuple[int, ...], made: str, row) -> DataFrame:
    """(doc, *made): doc holds all columns of ``docs``, made what ``row`` makes of a text's bytes and spans."""
    own = docs.select(whole_row(docs).alias("doc"), _known_by(_text()).alias("t"), F.encode(_text(), "UTF-8").alias("raw"))
    both = own.join(unsized(repeated_spans(docs, spans)), "t", "left").select("doc", "raw", "spans")
    more = StructType.fromDDL(made)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in _portions(batch.column(1), 2 << 20):
                part = batch.slice(at, size)
                rows = [row(raw, spans) for raw, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                cols = [pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc", *(n for n, _ in kinds)])

    return both.mapInArrow(run, StructType([own.schema["doc"], *more]))


def without_repeats(docs: DataFrame, span: int = SPAN, passage: int | None = None, words: int = WORDS) -> DataFrame:
    """All columns of ``docs`` and, last, ``n_bytes`` of each text, ``removed`` (its byte ranges that go, end excluded) and ``kept`` (its remaining bytes).

    With ``passage`` also ``passages``: byte ranges of runs of repeating strings of that many bytes which hold ``words`` words or ``span`` bytes; and ``left_over``,
    the text without these (characters that are cut in two go as well).
    """
    ranges = "array<struct<start:bigint,end:bigint>>"
    as_rows = lambda found: [{"start": a, "end": b} for a, b in found]

    def row(raw: bytes, spans: list[dict] | None) -> tuple:
        gone = _ranges(spans, span)
        out = len(raw), as_rows(gone), _without(raw, gone)
        if not passage:
            return out
        found = _passages(raw, spans, passage, words, span)
        return *out, as_rows(found), _without(raw, found).decode("utf-8", "ignore")

    made = f"n_bytes long, removed {ranges}, kept binary" + f", passages {ranges}, left_over string" * bool(passage)
    out = _mapped(docs, tuple(sorted({span, passage or span})), made, row)
    own = ["n_bytes", "removed", "kept", *(["passages", "left_over"] if passage else [])]
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in own], *own)


def drop_repeats(docs: DataFrame, passage: int = PASSAGE, words: int = WORDS, enough: int = SPAN) -> DataFrame:
    """The rows of ``docs`` without passages that repeat: runs of repeating strings of ``passage`` bytes that hold ``words`` words or ``enough`` bytes.

    Characters that are cut in two go as well; a text without passages stays as it is, null included.
    """

    def row(raw: bytes, spans: list[dict] | None) -> tuple:
        gone = _passages(raw, spans, passage, words, enough)
        return (_without(raw, gone).decode("utf-8", "ignore") if gone else None,)

    out = _mapped(docs, (passage,), "left_over string", row)
    text = F.coalesce("left_over", F.col("doc").getField("text").cast("string")).cast(docs.schema["text"].dataType)
    return out.select(*[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
