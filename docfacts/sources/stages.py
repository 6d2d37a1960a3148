"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where it is unset, a folder is chosen: a temporary one in local mode (tests), else one in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        found = tempfile.mkdtemp(prefix="docfacts-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docfacts-{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What durable has written, by application.
_written: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> int:
    """Remove the tables that durable has written in this application, and tell how many. Only for the end of a run:
    a result that has not been read or stored yet hangs on them."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


#: Bytes of an Arrow batch that goes to Python; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that whole texts fit whatever their number; a bound that the session has set itself
    is left alone."""
    held = spark.conf.get(_BYTES, None)
    if held is None or not 0 < int(held) < 2**31 - 1:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of few large pieces (a file with one row group), dealt out over the cores before dear work on its rows.
    A scan that has a piece for every core already is not shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
