"""Tables in the folder that all executors share, to cut lineage with."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: in_slices: rows of a slice, and the most slices.
SLICE_ROWS, SLICES = 1_000_000, 16

_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local session may go without; it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: executors lost later cost no recomputation of what stands before. The table
    goes when the process ends, or earlier by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_forget_all, spark)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def unsized(rows: DataFrame) -> DataFrame:
    """Rows that Spark takes for far less than they are, as those an explode makes or a file that packs well: joins with them sort both sides and broadcast neither."""
    return rows.hint("merge")


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``keep`` that no later plan reads, and let Spark clean shuffles nobody holds."""
    for df in tables:
        path = df._written_path
        _delete(df.sparkSession, path)
        _WRITTEN.remove(path)


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that are garbage; ask for that before the next large shuffle."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_slices(make: Callable[..., DataFrame], *tables: DataFrame, by: str = "page", rows: int = SLICE_ROWS) -> DataFrame:
    """make(*tables), for results that depend on no more than the rows of one ``by``: slice after slice where the last table is long.

    Each value of ``by`` is in one slice, whose result is written; the tables and shuffles it took go before the next. A table of up to ``rows`` rows is
    one slice; more than ``SLICES`` there never are, as each scans the inputs.
    """
    spark, n = tables[0].sparkSession, min(SLICES, -(-tables[-1].count() // rows))
    if n < 2:
        return make(*tables)
    done: list[DataFrame] = []
    for i in range(n):
        known = set(_WRITTEN)
        done.append(keep(make(*[t.where(F.pmod(F.xxhash64(by), F.lit(n)) == i) for t in tables]), "slice"))
        for path in [p for p in _WRITTEN if p not in known and p != done[-1]._written_path]:
            _delete(spark, path)
            _WRITTEN.remove(path)
        release_shuffles(spark)
    return reduce(DataFrame.unionByName, done)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget_all(spark: SparkSession) -> None:
    for path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder's owner cleans it then
            return
