"""Cutting lineage of iterative plans in a way that survives the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local session, whose tasks all run on this machine, gets a
    temporary folder. On a cluster it is an error: its executors share no such folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tallyloom-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def _remove(path: str, spark: SparkSession) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: its folder is left to the cluster
        pass
    _written.pop(path, None)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _remove(path, spark)


def release(df: DataFrame) -> None:
    """Removes the table of a stash that nothing reads any more."""
    if (path := getattr(df, "stash_path", None)) in _written:
        _remove(path, _written[path])


@contextmanager
def scope() -> Iterator[None]:
    """Tables stashed inside are removed at the end; results must be read or written before it.

    A long-lived session wraps each of its queries in a scope, so its shared folder
    doesn't fill up.
    """
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            _remove(path, _written[path])


def stash(df: DataFrame, instead_of: DataFrame | None = None, **observed: Column) -> DataFrame:
    """``df`` as a table written to the shared folder once and read from there.

    Written tables outlive any executor, and their known size lets small ones be broadcast
    by the planner's own threshold. ``instead_of`` is an earlier stash that nothing reads
    any more; it is removed. ``observed`` are aggregates taken while writing, so that no
    further job is needed for them; they are in the result's ``observed``. What is left is
    removed at the end of the ``scope`` or of the process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    watch = Observation() if observed else None
    seen = df.observe(watch, *[c.alias(name) for name, c in observed.items()]) if watch else df
    seen.write.parquet(path)
    _written[path] = spark
    if instead_of is not None:
        release(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    out.observed = watch.get if watch else {}
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; larger inputs stay as they are, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
