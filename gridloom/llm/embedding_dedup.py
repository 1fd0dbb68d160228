"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its ``NEAREST`` nearest reference points (pivots), in order. Two vectors are compared if they share
``SHARED`` pivots or more: the inverted lists are kept by sets of that many pivots, so that a vector meets those that share a whole set
with it, and pairs of too few shared pivots never meet. A pair that shares more sets counts at the first one only. Cosines are
computed in double precision from the vectors themselves.

The index grows with the data: as many pivots as the square root of the number of vectors, ``PIVOTS[0]`` at least and ``PIVOTS[1]`` at most, so that the
inverted lists, as many as there are pairs of pivots, stay about as long. They come from a sample of ``SAMPLE`` vectors for each pivot (in the order of a
hash; this sample and the pivots are all that reaches the driver), none as near as ``APART`` to one before it, so that a crowd of like
vectors doesn't take them all. Every vector is indexed. A list with more than ``BLOCK`` members is compared block
by block in separate tasks; what leaves a task is a count for each vector and one pair for each that it connects, never all pairs.

Pairs at the very bound of .95 share two of their six nearest pivots, of random ones in 64 to 768 dimensions, with a chance of .997 (256 pivots), .988
(1024) and .97 (4096); nearer pairs with more.

Identical vectors are one class before any of this, and count as linked with each other.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, not even with equal ones; of
vectors of different lengths, the shorter counts as if zeros followed; repeated rows are vectors of their own; a vector without id gets
its component's smallest id, never lends one and isn't kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .shared import hash_sample, keep, partitions

COSINE = 0.95
SAMPLE, PIVOTS, APART = 4, (256, 4096), 0.6
NEAREST, SHARED = 6, 2
BLOCK = 200


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pa.ListArray, width: int = 0) -> np.ndarray:
    """Unit vectors in double precision, shorter ones filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return unit(out)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 5e-324)  # first, so that no square overflows or vanishes
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 5e-324)


def pivots_for(n: int) -> int:
    """How many pivots an index of n vectors has."""
    return min(PIVOTS[1], max(PIVOTS[0], math.isqrt(n)))


def choose_pivots(sample: np.ndarray, most: int, apart: float = APART) -> np.ndarray:
    """In order, those that are apart from all before them."""
    chosen, n = np.empty((most, sample.shape[1])), 0
    for x in sample:
        if n == most:
            break
        if not n or (chosen[:n] @ x).max() < apart:
            chosen[n] = x
            n += 1
    return chosen[:n]


def nearest(x: np.ndarray, pivots: np.ndarray, n: int = NEAREST) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    w = max(x.shape[1], pivots.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, w - m.shape[1])))
    return np.argsort(-(wide(x) @ wide(pivots).T), axis=1, kind="stable")[:, :n]


def _described(classes: DataFrame, pivots: np.ndarray, n: int) -> DataFrame:
    kind = classes.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.sort(nearest(matrix(batch.column(1)), pivots, n), axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["node", "vector", "n", "pivots"])

    return classes.select("node", "vector", "n").mapInArrow(run, f"node long, vector {kind}, n long, pivots array<int>")


def _first_set(p: np.ndarray, q: np.ndarray, shared: int) -> np.ndarray:
    """Of pairs of sorted pivot lists, the first ``shared`` common pivots."""
    common = (p[:, :, None] == q[:, None, :]).any(axis=2)
    order = np.argsort(~common, axis=1, kind="stable")[:, :shared]
    return np.take_along_axis(p, order, axis=1)


def _compared(x: np.ndarray, pivots: np.ndarray, own: np.ndarray, key: np.ndarray, cross: bool, least: float) -> np.ndarray:
    """Which pairs of a set's members link and count here."""
    linked = np.zeros((len(x), len(x)), dtype=bool)
    a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
    if cross:
        a, b = a[own[a] != own[b]], b[own[a] != own[b]]
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        here = (_first_set(pivots[i], pivots[j], len(key)) == key).all(axis=1)
        linked[i[here], j[here]] = linked[j[here], i[here]] = True
    return linked


def _link_sets(least: float):
    """Rows (key, i, j, own, node, n, pivots, vector) sorted by set (key, i, j). Out: (a, b, n): a links with n others; b connects with a."""

    def of_set(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, n, own = (rows[c].to_numpy() for c in ("node", "n", "own"))
        pivots = np.array(rows["pivots"].to_pylist())
        x = matrix(rows["vector"].combine_chunks() if rows["vector"].num_chunks != 1 else rows["vector"].chunk(0))
        key = np.array(rows["key"][0].as_py())
        linked = _compared(x, pivots, own, key, rows["i"][0].as_py() != rows["j"][0].as_py(), least)
        count = linked @ n
        member, first = forest(linked)
        some = np.flatnonzero(count)
        a = np.concatenate([node[some], node[first]])
        b = np.concatenate([node[some], node[member]])
        return a, b, np.concatenate([count[some], np.zeros(len(first), dtype=np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows < 2:
                return
            at = np.flatnonzero(np.append(True, _changes(rows)))
            found = [of_set(rows.slice(s, n)) for s, n in zip(at, np.diff(np.append(at, rows.num_rows))) if n > 1]
            if found:
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "n"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
            change = np.flatnonzero(_changes(now))
            cut = int(change[-1]) + 1 if len(change) else 0
            yield from flush(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None:
            yield from flush(held)

    return run


def _changes(rows: pa.Table) -> np.ndarray:
    out = np.zeros(max(0, rows.num_rows - 1), dtype=bool)
    for name in ("hash", "i", "j"):
        v = rows[name].to_numpy()
        out |= v[1:] != v[:-1]
    return out


def links(classes: DataFrame, least: float = COSINE, nearest_n: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """classes: (node, vector, n). (a, b, n): a = b links with n others (of other classes); a and b are connected."""
    spark = classes.sparkSession
    most = pivots_for(classes.count())
    sample = hash_sample(classes.select("vector"), max(16 * PIVOTS[0], SAMPLE * most), "vector").toArrow()["vector"].combine_chunks()
    sample = sample if isinstance(sample, pa.ListArray) else sample.chunk(0) if sample.num_chunks else pa.array([], pa.list_(pa.float64()))
    pivots = choose_pivots(matrix(sample), most) if len(sample) else np.zeros((1, 1))
    if len(pivots) < shared:  # so few that all vectors share them all
        pivots = np.concatenate([pivots, np.zeros((shared - len(pivots), pivots.shape[1]))])
    found = keep(_described(classes, pivots, nearest_n), "described")
    sets = F.array(*[F.array(*[F.col("pivots")[i] for i in s]) for s in combinations(range(min(nearest_n, len(pivots))), shared)])
    rows = found.withColumn("key", F.explode(sets)).withColumn("hash", F.xxhash64("key"))
    crowd = found.select(F.explode(sets).alias("key")).groupBy(F.xxhash64("key").alias("hash")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = rows.join(crowd, "hash").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("long"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    rows = rows.withColumn("at", F.explode(others)).select("hash", "key", "at.i", "at.j", "own", "node", "n", "pivots", "vector")
    rows = rows.repartition(partitions(spark), "hash", "i", "j").sortWithinPartitions("hash", "i", "j")
    return rows.mapInArrow(_link_sets(least), "a long, b long, n long")


def near_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vectors: (vec_id, embedding). One row for each: vec_id, n_links, component_id, kept."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    own = keep(own.withColumns({"row": F.monotonically_increasing_id(), "sound": usable(F.col("vector"))}), "vectors")
    classes = own.where("sound").groupBy("vector").agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = keep(classes, "classes")
    found = keep(links(classes, least), "found")
    roots = components(found.where("a != b").select("a", "b"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    named = classes.select("vector", "node", "least", "n").join(roots, "node", "left").join(counts, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("vector", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    sound = own.where("sound").join(named, "vector").select("vec_id", "n_links", "component_id")
    alone = own.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = sound.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
