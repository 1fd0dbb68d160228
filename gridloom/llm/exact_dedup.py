"""Exact deduplication by a tree-merge of sorted digest runs.

Each input partition makes one run: its distinct digests, sorted, each with its smallest identifier and count.
In each round the partitions exchange runs in binomial groups of 2**FAN_BITS and merge them into one longer run: Spark's sort
brings a group's runs into one order (it can spill), and one pass over them makes the least of equal digests and their count.
A round also deals by the first digest bits, so that the last merge isn't one task but one for each digest range.
A digest that a third of all rows share takes one row for each run, never more.

Defined results: a null text counts as empty; a document of the id null stays only if its group has no other id;
of repeated rows (same id, equal text) one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_before, keep, partitions, whole_row

SPACES = r"[\x20\x09-\x0D]+"
#: A round merges 2**FAN_BITS runs.
FAN_BITS = 3
#: Digest ranges: the digest's first 12 bits.
RANGES = 4096

_RUN = "range int, run int, digest binary, n_bytes long, witness long, no_id boolean, id long, row long, n long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _with_digest(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("id"), normalised(F.col("text")).alias("plain"))
    return own.select(
        "id",
        F.unhex(F.sha2("plain", 256)).alias("digest"),
        F.octet_length("plain").cast("long").alias("n_bytes"),
        F.xxhash64("plain").alias("witness"),
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run and digest in; of equal ones (range, run, digest, length, witness) the first stays, with the sum of n."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now.cast(held.schema)])  # Spark's columns may be marked as without nulls
        if now.num_rows == 0:
            continue
        now = now.combine_chunks()
        merged, last = _squeeze(now)
        held = merged.slice(last)
        if last:
            yield from merged.slice(0, last).to_batches()
    if held is not None and held.num_rows:
        yield from held.to_batches()


def _squeeze(rows: pa.Table) -> tuple[pa.Table, int]:
    n = rows.num_rows
    digest = np.frombuffer(b"".join(rows["digest"].to_pylist()), dtype=">u8").reshape(n, 4)
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = (digest[1:] != digest[:-1]).any(axis=1)
        for name in ("range", "run", "n_bytes", "witness"):
            values = rows[name].to_numpy()
            new[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(new)
    out = rows.take(pa.array(starts))
    total = np.add.reduceat(rows["n"].to_numpy(), starts)
    out = out.set_column(out.schema.get_field_index("n"), "n", pa.array(total, pa.int64()))
    return out, len(starts) - 1


def classes(rows: DataFrame) -> DataFrame:
    """One row for each different text: digest, n_bytes, witness, its smallest id, the row that has it, and the count n."""
    spark = rows.sparkSession
    runs = rows.groupBy(
        F.conv(F.substring(F.hex("digest"), 1, 3), 16, 10).cast("int").alias("range"), "run", "digest", "n_bytes", "witness"
    ).agg(F.min(F.struct("no_id", "id", "row")).alias("least"), F.count(F.lit(1)).alias("n"))
    runs = runs.select("range", "run", "digest", "n_bytes", "witness", "least.no_id", "least.id", "least.row", "n")
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        runs = runs.withColumn("run", F.shiftright("run", FAN_BITS))
        left = -(-left // 2**FAN_BITS)
        runs = runs.repartition(partitions(spark), "range", "run").sortWithinPartitions(
            "range", "run", "digest", "n_bytes", "witness", "no_id", "id", "row"
        )
        runs = runs.mapInArrow(_merge, _RUN)
        if left == 1:
            return runs.drop("range", "run")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, digest (of the normalised text)."""
    rows = _with_digest(docs).withColumns(
        {"run": F.spark_partition_id(), "row": F.monotonically_increasing_id(), "no_id": F.col("id").isNull()}
    )
    rows = keep(rows, "digests")
    same = ["digest", "n_bytes", "witness"]
    kept = keep(classes(rows), "classes").select(
        *same, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size")
    )
    return rows.join(kept, same).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns whatever their names; of repeated rows (same id, equal text) any one."""
    key = ["no_id", "id", "digest"]
    number = F.col("doc_id").cast("long")
    keys = [number.isNull().alias("no_id"), F.coalesce(number, F.lit(0)).alias("id")]
    stay = exact_groups(docs).where("kept").select(*keys, "digest")
    own = docs.select(whole_row(docs).alias("doc"), *keys, F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
    return as_before(docs, own.join(stay, key, "left_semi").dropDuplicates(key))
