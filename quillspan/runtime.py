"""Where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger("quillspan")
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``.

    A temporary folder is made only where the setting is missing and the master is
    a single JVM (tests); on a cluster a missing setting is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        place = tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: once per application, unless PYTHONPATH already leads to it."""
    if _ROOT in map(os.path.abspath, os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        name = os.path.join(tempfile.mkdtemp(prefix="quillspan-package-"), "quillspan")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", _ROOT, "quillspan"))


@contextmanager
def timed(what: str) -> Iterator[list[float]]:
    """Logs the seconds that a step took, or that it failed; the list given holds them afterwards."""
    began = time.perf_counter()
    took: list[float] = []
    try:
        yield took
    except BaseException:
        log.error("%s failed after %.1f s", what, time.perf_counter() - began)
        raise
    took.append(time.perf_counter() - began)
    log.info("%s: %.1f s", what, took[0])


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few large pieces over all cores; one that has enough partitions stays as it is.

    For CPU-heavy work on a small file, which would be one task. Only for plain scans: it looks at their partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def kept_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted with the tables of :func:`written`."""
    path = f"{shared_dir(spark)}/quillspan/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, and lets several
    readers use one result. The files are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = kept_path(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``_rank``, from 0, in an order that must be total.

    Range partitions are written with their number, rows ranked inside, and the counts of the partitions before added: no task sees more
    than one partition, and what is summed up has a row per partition.
    """
    cut = written(df.repartitionByRange(*order).withColumn("_at", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("_at").agg(F.count(F.lit(1)).alias("_m")).select("_at", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_at").orderBy(*order)) - 1
    return cut.withColumn("_n", inside).join(counts, "_at").withColumn("_rank", F.col("_before") + F.col("_n")).drop("_at", "_n", "_before")


def remove_written() -> None:
    """Delete the tables made by :func:`written` in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the shared folder's owner cleans up
            pass


atexit.register(remove_written)
