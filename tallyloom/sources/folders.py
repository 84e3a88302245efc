"""The folder that all executors share, and small file operations by Spark's own file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a URI, or a folder of our own where the master is this machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given if "://" in given or given.startswith("file:") else f"file://{given}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tallyloom-"))
    return f"file://{_own[0]}"


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted."""
    fs, p = file_system(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one piece: readers see the old one or the new one, never a part."""
    fs, p = file_system(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(temporary, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(temporary, p):
        raise OSError(f"can't rename to {path}")


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = file_system(spark, old)
    to = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"can't rename {old}")
