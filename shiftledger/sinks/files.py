"""Directory operations through Hadoop's file system API, so any store Spark can write works."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _handle(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> tuple:
    """(name, modification time) of the entries of a folder."""
    fs, p = _handle(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)))


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _handle(spark, path)
    return fs.exists(p) and fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file; ValueError if it is damaged."""
    fs, p = _handle(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "ChecksumException":
            raise ValueError(f"{path}: checksum") from e
        raise
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; False if it does."""
    fs, p = _handle(spark, path)
    try:
        stream = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return True


def partition_path(spark: SparkSession, root: str, client_id: str, pay_date) -> str:
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    parts = [
        name.getPartitionPathString("client_id", client_id),
        name.getPartitionPathString("pay_date", str(pay_date)),
    ]
    return "/".join([root.rstrip("/"), *parts])
