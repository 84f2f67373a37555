"""The few file-system calls Spark's readers and writers do not cover, through Hadoop's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def _listed(spark: SparkSession, path: str, folders: bool) -> list[str]:
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)) if s.isDirectory() == folders)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted; none when it does not exist."""
    return _listed(spark, path, True)


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in ``path``, sorted; none when it does not exist."""
    return _listed(spark, path, False)


def touch(spark: SparkSession, path: str) -> None:
    _fs(spark, path).create(_path(spark, path), True).close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    out = _fs(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    source = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def rename(spark: SparkSession, old: str, new: str) -> bool:
    return _fs(spark, old).rename(_path(spark, old), _path(spark, new))
