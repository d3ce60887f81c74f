"""Session settings that the unrolled profile expressions need."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Let Spark split generated code that the JVM would not compile.

    The JVM interprets methods over 8,000 bytes for good. Spark by default still puts expressions of
    that size into one method; with the JVM's own limit it falls back to code that is split into small
    methods (measured on 490,000 house-days: 18.2 s before, 3.2 s after).
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Exact quantiles are object aggregates; beyond 128 groups a task would sort its rows instead of hashing them.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this driver process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/meterloom/{uuid.uuid4().hex}-{name}"
    atexit.register(_remove, spark, path)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one where that is unset in local mode (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="meterloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder belongs to the cluster's own cleaning
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: it survives lost executors and keeps how its rows are dealt."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))
    return df.checkpoint()


def tasks(spark: SparkSession) -> int:
    """How many tasks rows are dealt to before wide expressions: a file of one row group is read by a single one."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
