"""Single files in any store that Spark can write to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file, replacing one that is there."""
    store, where = _place(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _place(spark, path)
    return bool(store.exists(where))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file, or a folder with all that is in it."""
    store, where = _place(spark, path)
    store.delete(where, True)
