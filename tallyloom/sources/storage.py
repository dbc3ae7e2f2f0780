"""Small texts on whatever file system a path names, shared storage included."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _place(spark, path)
    return system.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of one file; a missing one is an error."""
    target, system = _place(spark, path)
    if not system.exists(target):
        raise FileNotFoundError(path)
    stream = system.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file with a text, whole or not at all: it is written aside and then put in its place."""
    target, system = _place(spark, path)
    aside, _ = _place(spark, f"{path}.part")
    stream = system.create(aside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if system.exists(target):
        system.delete(target, False)
    if not system.rename(aside, target):
        raise OSError(f"{path} couldn't be put in its place")
