"""Single files and folders in whatever store a path names, through Spark's own file systems."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return bool(fs.exists(target))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store, as Spark takes it."""
    fs, target = _at(spark, path)
    return fs.makeQualified(target).toString()


def try_rename(spark: SparkSession, path: str, to: str) -> bool:
    fs, target = _at(spark, path)
    return bool(fs.rename(target, spark._jvm.org.apache.hadoop.fs.Path(to)))


def rename(spark: SparkSession, path: str, to: str) -> None:
    if not try_rename(spark, path, to):
        raise OSError(f"{path} cannot be renamed to {to}")


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.mkdirs(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, by name; nothing where there is none."""
    fs, target = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    size = fs.getFileStatus(target).getLen()
    stream = fs.open(target)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; one that is there already is an error."""
    fs, target = _at(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def escaped(name: str) -> str:
    """A name for a path in which patterns are looked for."""
    return re.sub(r"([\\*?\[\]{},^])", r"\\\1", name)
