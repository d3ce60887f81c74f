"""What the operators share: tables in the shared folder, joins on hot keys, worker memory."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows; there are at most 1/HOT_SHARE of them.
HOT_SHARE = 1 / 500


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in local mode (tests), a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meterloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this driver process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/meterloom/{uuid.uuid4().hex}-{name}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system; quiet once the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder belongs to the cluster's own cleaning
        pass


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, key: str, least: int = 20_000) -> list:
    """Keys with more than HOT_SHARE of all rows (and over `least` rows): at most 1/HOT_SHARE values."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    floor = max(least, int(total * HOT_SHARE))
    if total <= floor:
        return []
    return [r[0] for r in counts.where(F.col("__n") > floor).select(key).collect() if r[0] is not None]


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left", least: int = 20_000) -> DataFrame:
    """left join right, where right has one row a key and left may hold a third of its rows in one key.

    Rows of hot keys meet the few matching rows of right by broadcast (at most 1/HOT_SHARE rows);
    all other rows meet by shuffle.
    """
    hot = hot_keys(left, key, least)
    if not hot:  # merged, as the planner's estimate of an exploded side is far too small to broadcast by
        return left.join(right.hint("merge"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right.where(~is_hot).hint("merge"), key, how)
    return cold.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))


def sampled(wanted: int, total: int, *parts) -> Column:
    """True for about `wanted` of `total` rows, by a hash of the parts in 2**63 steps: no total is too large for the rate."""
    if total <= wanted:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(*parts), 1) < F.lit((wanted << 63) // total)


def worker_memo(key, make):
    """An object that a Python worker process keeps between its tasks."""
    kept = sys.modules.setdefault("_meterloom_worker", types.ModuleType("_meterloom_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_bytes(path: str) -> bytes:
    """A vocabulary file of the driver; its bytes travel with the tasks (at most a few MB, checked)."""
    if os.path.getsize(path) > 64 << 20:
        raise ValueError(f"{path} is too large to send with each task")
    with open(path, "rb") as f:
        return f.read()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation of numbers: planned on the driver, without Python on executors."""
    if not rows:
        return spark.createDataFrame([], schema)
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    text = lambda v, kind: f"CAST({'NULL' if v is None else repr(v)} AS {kind})"
    values = ", ".join(f"({', '.join(text(v, k) for v, k in zip(r, kinds, strict=True))})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Collect a table that is bounded by design; an error where the bound is exceeded."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows
