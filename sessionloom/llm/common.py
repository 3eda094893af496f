"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a local session may go without one and gets a temporary folder:
    on a cluster a machine's own folder would lose rows, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Spark deletes a finished query's shuffle files at once; the steps below need only what they have written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write a step as Parquet into the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs only the stages that follow. Unlike ``localCheckpoint`` nothing
    depends on an executor's own disk. :func:`discard` deletes the step again. ``options``: more of the writer's.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete the files of materialized steps that nothing reads any more."""
    for step in steps:
        path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step._step)
        path.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than this share of all rows, and more than so many, is hot; so there are fewer than 1 / share of them.
HOT_SHARE, HOT_LEAST = 1 / 1000, 64


def hot_join(many: DataFrame, one: DataFrame, key: str, n: str, by: str) -> DataFrame:
    """``many`` joined to ``one``, which has a row per key and the key's number ``n`` of rows in ``many``.

    The rows of a hot key are dealt out by a hash of ``by`` and its row of ``one`` is repeated for each share, so no task
    gathers them all. The list of hot keys is bounded by their share and broadcast.
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    most = max(HOT_LEAST, int(total * HOT_SHARE))
    shares = F.ceil(F.greatest(F.col(n), F.lit(1)) / most).cast("int")
    hot = F.broadcast(one.where(F.col(n) > most).select(F.col(key).alias("_hot"), shares.alias("_shares")))
    dealt = many.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_shares")), F.lit(0)).cast("int")).drop("_hot", "_shares")
    repeated = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1)))
    return dealt.join(repeated, [key, "_salt"]).drop("_salt")


def unit_hash(*cols: Column) -> Column:
    """A reproducible number in (0, 1) from the columns: the first 52 bits of an MD5 digest.

    MD5 rather than Spark's own hashes so that a SQL oracle can restate it.
    """
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """A dictionary that outlives tasks in a reused Python worker; those of other owners are emptied.

    So a worker holds what one operator caches, not the sum over all that have run in it.
    """
    others = [cache for name, cache in _CACHES.items() if name != owner and cache]
    for cache in others:
        cache.clear()
    if others:
        give_back()
    return _CACHES.setdefault(owner, {})


def give_back() -> None:
    """Return a worker's freed memory to the machine, so that one stage's arrays do not weigh on the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
