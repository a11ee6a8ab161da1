"""File-system helpers that work on any Hadoop-compatible store."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def require_path(spark: SparkSession, path: str) -> None:
    fs, hadoop = _handle(spark, path)
    found = fs.globStatus(hadoop)
    if found is None or len(found) == 0:
        raise FileNotFoundError(path)


def suffix_of(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def write_text(spark: SparkSession, path: str, text: str, *, overwrite: bool = False) -> None:
    """A small driver-side document such as a manifest or sidecar."""
    fs, hadoop = _handle(spark, path)
    if not overwrite and fs.exists(hadoop):
        raise FileExistsError(path)
    out = fs.create(hadoop, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def arrow_store(path: str):
    """The Arrow file system of a path, for use inside tasks, and the path within it."""
    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        return arrow_fs.LocalFileSystem(), path
    if scheme == "file":
        return arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return arrow_fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
