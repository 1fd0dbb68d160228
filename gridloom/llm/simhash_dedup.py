"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to ``REFERENCES`` fixed reference fingerprints, kept apart by six bit
blocks (they add up to the whole distances). Distances of two fingerprints to one reference differ by no more than the
fingerprints do, on the whole and within any set of blocks. Of six blocks, three at least are free of the at most three
differing bits, so on those the two table rows differ by 0 everywhere: pairs that can link meet under equal coordinates of
one of the 20 sets of three blocks. Of the pairs that meet, those whose whole coordinates differ by more than 3 anywhere are
discarded, and the survivors are verified bit by bit. No link is lost.

Exact copies are one fingerprint before any of this. A set of equal coordinates with more than ``BLOCK`` fingerprints is compared
block by block in separate tasks; what a set connects goes on as one pair a fingerprint, never as all pairs.

The tables serve other radii too (``links`` with ``bits``): as many blocks as bits and three more, of which three are free of the differing bits.

Defined results: a null or empty text has fingerprint zero, linked like any other; fewer than three words are one shingle; repeated
rows are rows of their own with equal results; a row without id gets its component's smallest id and never lends one, and the filter
keeps it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .shared import forget, keep, partitions, unsized, without_ids

SEED = 42
WORDS = 3
#: Fingerprints link at this many differing bits or fewer.
BITS = 3
REFERENCES = 16
#: Blocks of bits that are free of the differing ones.
SHARED_BLOCKS = 3
#: Fingerprints of one set that one task compares with as many others.
BLOCK = 100


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references(n: int = REFERENCES) -> list[int]:
    """Reference fingerprints: hashes of their numbers."""
    return [xxhash.xxh64_intdigest(f"reference {i}".encode(), SEED) for i in range(n)]


def blocks_for(bits: int) -> list[tuple[int, int]]:
    """(first, width) of the blocks that leave SHARED_BLOCKS free of ``bits`` differing bits, as even as can be; none over 15 wide."""
    width, wider = divmod(64, bits + SHARED_BLOCKS)
    widths = [width + (i < wider) for i in range(bits + SHARED_BLOCKS)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for part in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            counts += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return counts


def _majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of some shingles' unsigned hashes."""
    return _majority(_ones(hashes), len(hashes))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    parts = (text or "").encode("utf-8", "replace").lower().split()  # both touch ASCII only: A-Z, and \x20 \x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        s, e = starts[at : at + (1 << 16)], ends[at : at + (1 << 16)]
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(s.tolist(), e.tolist())), dtype=np.uint64, count=len(s))
        counts += _ones(hashes)
    return _majority(counts, n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def _coordinates(fp: Column, first: int, width: int) -> Column:
    """The distances within one block to all references, four bits each."""
    mask, out = ((1 << width) - 1) << first, None
    for j, ref in enumerate(references()):
        d = F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(ref))).bitwiseAND(F.lit(_signed(mask)))).cast("long"), 4 * j)
        out = d if out is None else out.bitwiseOR(d)
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _table(fps: np.ndarray) -> np.ndarray:
    return np.stack([_popcount(fps ^ np.uint64(r)) for r in references()], axis=1).astype(np.int8)


def _links_in(fps: np.ndarray, radius: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the links of some distinct fingerprints connect."""
    table = _table(fps)
    near = np.ones((len(fps), len(fps)), dtype=bool)
    for j in range(table.shape[1]):
        near &= np.abs(table[:, None, j] - table[None, :, j]) <= radius
    i, j = np.nonzero(near)
    near[i, j] = (_popcount(fps[i] ^ fps[j]) <= radius) & (i != j)
    a, b = forest(near)
    return fps[a], fps[b]


def _link_sets(radius: int):
    """Rows (key, i, j, fp) sorted by set (key, i, j); a set has at most 2 * BLOCK rows or a little more. Links out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 4), dtype=np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            if len(rows) == 0:
                continue
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            held = rows[cut:]
            yield from _of_sets(rows[:cut], radius)
        yield from _of_sets(held, radius)

    return run


def _of_sets(rows: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    if len(rows) < 2:
        return
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(rows)))
    fps = rows[:, 3].view(np.uint64) if rows[:, 3].flags.c_contiguous else np.ascontiguousarray(rows[:, 3]).view(np.uint64)
    twos = starts[sizes == 2]  # most sets are pairs: all at once
    x, y = fps[twos], fps[twos + 1]
    ok = (np.abs(_table(x) - _table(y)) <= radius).all(axis=1)
    ok[ok] = _popcount(x[ok] ^ y[ok]) <= radius
    a, b = [x[ok]], [y[ok]]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
        p, q = _links_in(fps[s : s + n], radius)
        a.append(p)
        b.append(q)
    a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """fps: distinct fp. Links (a, b) that connect all fingerprints of ``bits`` or fewer differing bits."""
    spark, blocks = fps.sparkSession, blocks_for(bits)
    named = fps.select("fp", *[_coordinates(F.col("fp"), *b).alias(f"c{i}") for i, b in enumerate(blocks)])
    sets = combinations(range(len(blocks)), SHARED_BLOCKS)
    keys = [F.xxhash64(F.lit(k), *[F.col(f"c{i}") for i in s]) for k, s in enumerate(sets)]
    rows = unsized(named.select(F.explode(F.array(*keys)).alias("key"), "fp"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    rows = rows.select("key", "fp", F.explode(others).alias("at")).select("key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "fp")
    rows = rows.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_link_sets(bits), "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, fp, component_id."""
    found = keep(fingerprints(docs), "fingerprints")
    fps = keep(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(fps.select("fp")))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns; all rows of one id stay or go together."""
    gone = near_groups(docs).where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return without_ids(docs, gone)
