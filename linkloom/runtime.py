"""Session facts that every operator shares: table access, lineage cuts, skew-safe joins."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys a heavy-hitter table may hold; it is what makes broadcasting that table safe at any input size.
MAX_HEAVY_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one is set only where the session names none and all its tasks
    run on this machine (tests). On a cluster a folder must be named, since other machines can't read a local one.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "linkloom-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before costly work, where the input has fewer splits than the session has cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may have ended; the folder is the cluster's to clear then
        pass


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: later stages neither recompute it nor depend on one
    executor, and the plan starts anew from files of known size. The table goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/linkloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def release(df: DataFrame) -> None:
    """Deletes the table of a ``cut`` before Python ends; nothing that is still to be computed may read it."""
    _drop(df.sparkSession, df.cut_path)


def heavy_keys(df: DataFrame, keys: list[str], least: int = 50_000, share: int = MAX_HEAVY_KEYS) -> DataFrame:
    """Keys that hold more than 1/``share`` of all rows and more than ``least`` rows: at most ``share`` of them, whatever the input.

    Nulls are no key. The total comes as a one-row aggregate, so nothing is collected.
    """
    counts = df.where(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.join(F.broadcast(total), F.col("_n") > F.greatest(F.lit(least), F.col("_total") / share)).select(*keys)


def join_unique(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", least: int = 50_000) -> DataFrame:
    """Equi-join of ``big`` with ``small``, whose rows are unique in ``keys``; hot keys of ``big`` never meet in one task.

    The rows of ``small`` under a heavy key (at most MAX_HEAVY_KEYS, see heavy_keys) are broadcast, all other keys go
    through a shuffle join. ``how``: inner or left_semi or left. Null keys match nothing; with left they stay. ``big`` is read
    three times (its keys are counted, then hot and other rows), so it should be a table or cheap.
    """
    heavy = heavy_keys(big, keys, least)
    hot_small = small.join(F.broadcast(heavy), keys, "left_semi").withColumn("_hot", F.lit(True))
    marked = big.join(F.broadcast(heavy.withColumn("_is_hot", F.lit(True))), keys, "left")
    hot = marked.where("_is_hot").drop("_is_hot").join(F.broadcast(hot_small.drop("_hot")), keys, how)
    cold = marked.where("_is_hot is null").drop("_is_hot").join(small, keys, how)
    return hot.unionByName(cold)
