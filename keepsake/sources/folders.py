"""Folder operations on whatever file system a path names, through Hadoop's API."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; it is an error if the target is there."""
    fs, p = _at(spark, source)
    _, t = _at(spark, target)
    if fs.exists(t):
        raise FileExistsError(target)
    if t.getParent() is not None:
        fs.mkdirs(t.getParent())
    if not fs.rename(p, t):
        raise OSError(f"could not move {source} to {target}")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; none if it is not there."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def beside(path: str) -> str:
    """A new temporary folder name next to ``path``; hidden, so that readers skip it."""
    head, _, tail = path.rstrip("/").rpartition("/")
    return f"{head}/.{tail}.{uuid.uuid4().hex}"


def replace(spark: SparkSession, staged: str, path: str) -> None:
    """Put a finished folder in the place of another."""
    if exists(spark, path):
        old = beside(path)
        move(spark, path, old)
        move(spark, staged, path)
        drop(spark, old)
    else:
        move(spark, staged, path)
