"""Near-duplicates by the similarity of word shingles.

Documents link where the Jaccard similarity of their sets of ``WORDS``-word shingles is ``SIMILARITY`` or more. Candidates come from SimHash
fingerprints of these sets by the pivot distance tables of ``simhash_dedup``, none of ``RADIUS`` or fewer differing bits lost. Pairs near the bound differ in more
bits than tables can select by (9.7 of 64 on average at .8), so what the fingerprints leave apart also meets where it agrees on one of ``BANDS`` bands of
``ROWS`` minimum hashes: a pair of similarity .8 does but for 7 in a million, a pair of higher similarity but for less. Every link is verified
on the shingles themselves.

Equal shingle sets are one class before any of this. Of a set of classes (a component of fingerprints; then an equal band, as far as several components
have it) each is first verified with one leader. In sets of three or more that this leaves in several components, classes of the largest component don't meet
each other again: blocks of ``BLOCK`` of them meet blocks of the rest, and those meet each other, each pair of blocks in a task of its own. What
leaves a task is one pair a class, never all pairs.

Shingles travel as 32-bit hashes, sorted; sets of n and m shingles count one too many in common with a chance of n * m / 2**32, which decides
only where a pair is one shingle from the bound. Bands and classes come from 64 bits.

Defined results: a null or empty text has one shingle, that of no words, and links with its like; fewer words than a shingle has are one
shingle; repeated rows are rows of their own with equal results; a row without id gets its component's smallest id and never lends one,
and the filter keeps it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .graph import components
from .shared import forget, keep, partitions, unsized, without_ids

SEED = 42
WORDS = 5
SIMILARITY = 0.8
#: Differing bits of two fingerprints up to which the pivot tables bring classes together.
RADIUS = 5
BANDS, ROWS = 30, 5
#: Classes of one set that one task compares with as many others.
BLOCK = 200
#: Shingles that are hashed at once.
PORTION = 4096

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of the distinct shingles, as sorted signed longs."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # both touch ASCII only: A-Z, and \x20 \x09-\x0D
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(parts) <= words:
        starts, ends = np.zeros(1, dtype=np.int64), np.array([len(joined)])
    else:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=len(starts))
    return np.unique(hashes.view(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band of minimum hashes."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), PORTION):
        part = hashes[at : at + PORTION].view(np.uint64)
        np.minimum(least, ((part ^ _DRAWN[0]) * (_DRAWN[1] | np.uint64(1))).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64).view(np.int64)


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, n, bands, shingles, sim): fp is a digest of the set of shingles, n their number, sim their SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t, words) for t in part.column(1).to_pylist()]
                fps = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], dtype=np.uint64).view(np.int64)
                n = np.array([len(h) for h in found], dtype=np.int64)
                lists = lambda parts: pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts))
                )
                short = [np.unique(h.astype(np.int32)) for h in found]
                sims = np.array([simhash_dedup.fingerprint_of(h.view(np.uint64)) for h in found], dtype=np.uint64).view(np.int64)
                cols = [part.column(0), pa.array(fps), pa.array(n), lists([bands(h) for h in found]), lists(short), pa.array(sims)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "n", "bands", "shingles", "sim"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long, n long, bands array<long>, shingles array<int>, sim long")


def _enough(shared: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether that many shingles in common make sets of n and m similar."""
    return shared >= F.lit(similarity) * (n + m - shared) - 1e-9


def _leader_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members: (key, fp, n), and root if some are known to be of one component. Verified links (a, b) of each set's members with the set's leader."""
    members = members if "root" in members.columns else members.withColumn("root", F.col("fp"))
    leader = members.groupBy("key").agg(F.min(F.struct("fp", "n", "root")).alias("lead"))
    pairs = members.join(leader, "key").where(F.col("root") != F.col("lead.root")).where(_enough(F.least("n", "lead.n"), F.col("n"), F.col("lead.n"), similarity))
    pairs = pairs.select(F.col("lead.fp").alias("a"), F.col("fp").alias("b")).distinct()
    # a leader of many is dealt to as many parts, so that none has them all
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    pairs = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("part"))
    mine = sets.join(blocks, sets.fp == blocks.a).select("a", F.col("shingles").alias("of_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"))
    both = pairs.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("of_b")), "b").join(mine, ["a", "part"])
    both = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("i"), F.size("of_a").alias("n"), F.size("of_b").alias("m"))
    return both.where(_enough(F.col("i"), F.col("n"), F.col("m"), similarity)).select("a", "b")


def _links_in(fps: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of some classes that join components which nothing joined so far."""
    known = {r: r for r in roots.tolist()}

    def top(r: int) -> int:
        while known[r] != r:
            known[r] = known[known[r]]
            r = known[r]
        return r

    out, order = [], sorted(range(len(sets)), key=lambda i: len(sets[i]))
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            n, m = len(sets[i]), len(sets[j])
            if n < similarity * m - 1e-9:
                break  # the sets after this one are larger still
            a, b = top(int(roots[i])), top(int(roots[j]))
            if a != b:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= similarity * (n + m - shared) - 1e-9:
                    known[max(a, b)] = min(a, b)
                    out.append((int(fps[i]), int(fps[j])))
    return out


def _block_links(similarity: float):
    """Rows (key, i, j, fp, root, shingles) sorted by set (key, i, j); a set has at most 2 * BLOCK rows or a little more. Links out."""

    def of_sets(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps, roots = rows["fp"].to_numpy(), rows["root"].to_numpy()
        column = rows["shingles"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        flat, at = column.values.to_numpy(), column.offsets.to_numpy()
        out = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if (roots[s:e] != roots[s]).any():
                out += _links_in(fps[s:e], roots[s:e], [flat[at[k] : at[k + 1]] for k in range(s, e)], similarity)
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rows = new if held is None else pa.concat_tables([held, new.cast(held.schema)])
            if not rows.num_rows:
                continue
            key = np.stack([rows[c].to_numpy() for c in ("key", "i", "j")], axis=1)
            starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)
            yield from of_sets(rows.slice(0, int(starts[-1])), starts) if len(starts) > 1 else ()
            held = rows.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield from of_sets(held, np.array([0, held.num_rows]))

    return run


def _links_across(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members: (key, fp, n). Links (a, b) between the components that the leaders' links leave within a set."""
    spark = members.sparkSession
    rows = keep(members.join(roots, members.fp == roots.node, "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("size > 2 AND roots > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    apart = sizes.select("key", F.col("main.root").alias("main"), blocks(F.col("main.n")).alias("of_main"), blocks(F.col("size") - F.col("main.n")).alias("of_rest"))
    rows = rows.join(keep(apart, "apart"), "key")
    zero = F.lit(0).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("root") == F.col("main"), F.col("of_main")).otherwise(F.col("of_rest")))
    blocks_of = lambda n, i, j: F.transform(F.sequence(zero, n - 1), lambda o: F.struct(i(o).cast("long").alias("i"), j(o).cast("long").alias("j")))
    # a block of the main component meets one of the rest at (i, -1 - j), two of the rest meet at (i, j)
    of_main = blocks_of(F.col("of_rest"), lambda o: mine, lambda o: -1 - o)
    of_rest = F.concat(blocks_of(F.col("of_main"), lambda o: o, lambda o: -1 - mine), blocks_of(F.col("of_rest"), lambda o: F.least(o, mine), lambda o: F.greatest(o, mine)))
    at = F.when(F.col("root") == F.col("main"), of_main).otherwise(of_rest)
    rows = rows.select("key", "fp", "root", F.explode(at).alias("at")).select("key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "fp", "root")
    rows = rows.join(sets, "fp").select("key", "i", "j", "fp", "root", "shingles")
    rows = rows.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_block_links(similarity), "a long, b long")


def _shared(rows: DataFrame) -> DataFrame:
    """rows: distinct (key, fp, n). Those of keys that several classes have."""
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    return unsized(rows).join(several, "key")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members: (key, fp, n). Those of sets that several components have, with their root."""
    rooted = members.join(roots, members.fp == roots.node, "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return rooted.join(several, "key")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components of those of ``roots`` and links (a, b) between them."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def near_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id, fp, component_id."""
    found = keep(sets_of(docs, words), "shingles")
    ids_of = keep(found.select("doc_id", "fp"), "fingerprints")  # stays, while the shingles go
    classes = keep(ids_of.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    # what is near by fingerprint
    sims = keep(found.select("fp", "n", "sim").distinct(), "sims")
    tables = components(simhash_dedup.links(sims.select(F.col("sim").alias("fp")).distinct(), RADIUS))
    near = keep(_shared(sims.join(tables, sims.sim == tables.node, "left").select(F.coalesce("root", "sim").alias("key"), "fp", "n")), "near")
    sets = keep(found.select("fp", "shingles").join(near.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    led = keep(_leader_links(near, sets, similarity), "led")
    roots = components(led)
    across = keep(_links_across(near, roots, sets, similarity), "across")
    roots = _joined(roots, across)
    forget(near, sets, led, across, sims)
    # what fingerprints leave apart
    members = keep(_apart(_shared(found.select("fp", "n", F.explode("bands").alias("key")).distinct()), roots), "members")
    sets = keep(found.select("fp", "shingles").join(members.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    led = keep(_leader_links(members, sets, similarity), "led")
    roots = _joined(roots, led)
    across = keep(_links_across(members.drop("root"), roots, sets, similarity), "across")
    forget(led, members, sets, found)
    roots = _joined(roots, across)
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return ids_of.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns; all rows of one id stay or go together."""
    gone = near_groups(docs, words, similarity).where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return without_ids(docs, gone)
