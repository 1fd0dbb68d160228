"""The session that tests, the bench and scripts share."""

from __future__ import annotations

import os
import py_compile
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, whatever folder or cluster they run on; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom.zip")  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(_HERE):
            for name in sorted(names):
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    inside = os.path.join("gridloom", os.path.relpath(whole, _HERE))
                    archive.write(whole, inside)
                    # compiled as well, so that each worker need not; another version of Python takes the source
                    made = py_compile.compile(whole, os.path.join(os.path.dirname(path), "made.pyc"), doraise=True, invalidation_mode=py_compile.PycInvalidationMode.UNCHECKED_HASH)
                    archive.write(made, inside + "c")
    context.addPyFile(path)


def local_session(cpus: int | None = None, app: str = "gridloom", shuffle: int = 8) -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
