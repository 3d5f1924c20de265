"""Session helpers: table access and durable intermediate storage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One parquet table of the data directory, pruned to ``cols`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs on one machine
    (tests, for one) a folder below the SQL warehouse is used; on a real cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named and not re.fullmatch(r"local(-cluster)?(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    base = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table that one job writes and another reads."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the tables that this application has written to the shared folder. Results that still read
    them must have been written or collected before."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        at = hadoop(path)
        at.getFileSystem(conf).delete(at, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and
    survives the loss of executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for steps that cost far more than a
    shuffle. Input that is split well enough already, as any large one is, is not touched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
