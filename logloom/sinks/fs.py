"""File-system helpers through Hadoop's FileSystem (works on any store the
cluster mounts: HDFS, object stores, local)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def list_dirs(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, full path) of the entries of a folder."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [(st.getPath().getName(), st.getPath().toString()) for st in fs.listStatus(p)]


def rename(spark: SparkSession, src: str, dst: str) -> bool:
    """Move a file or folder within one file system; False if it did not move."""
    fs, p = _fs(spark, src)
    return bool(fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dst)))


def size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getFileStatus(p).getLen())


def make_dir(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
