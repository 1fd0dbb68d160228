"""What the corpus operators have in common: written tables, columns, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.scratch import forget, keep, release_shuffles, shared_folder, unsized

__all__ = ["forget", "keep", "release_shuffles", "shared_folder", "unsized"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A large table; if its files make fewer partitions than there are cores, its rows are dealt to as many."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that none clashes with those that an operator adds."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def as_before(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``df`` again, from rows that hold them as ``doc``."""
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in df.columns])


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``gone`` (gone_id long), with all their columns whatever their names; rows without id stay."""
    own = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").cast("long").alias("gone_id"))
    return as_before(docs, own.join(gone, "gone_id", "left_anti"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def hash_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows, the first by a hash of the key.

    Rows that can't be among them are left out before the sort (twice as many as needed stay, by the hash), so that no task gets more than a few times
    the sample, however large the table.
    """
    n, bits = df.count(), 1 << 30
    order = F.pmod(F.xxhash64(*key), F.lit(bits))
    if n > 2 * rows:
        df = df.where(order < -(-2 * rows * bits // n))
    return df.orderBy(order, *key).limit(rows)


def usable_labels(labels: DataFrame, column: str, parts: int, held_out: int) -> DataFrame:
    """(doc_id, label) of the labelled documents outside the held-out fold.

    Rows without id or label don't count; contradictory repeated labels count as the larger one.
    """
    usable = labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (id_remainder(F.col("doc_id"), parts) != held_out)
    )
    return usable.groupBy("doc_id").agg(F.max("label").alias("label"))


def bounded_labels(labels: DataFrame, column: str, rows: int, parts: int, held_out: int) -> DataFrame:
    """At most ``rows`` of the usable labels, in the order of a hash of the id."""
    return hash_sample(usable_labels(labels, column, parts, held_out), rows, "doc_id")
