"""File provenance: sizes and sha256 digests, checked against a manifest or written as one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.accession import accession_urls
from cohortspark.sources.paths import _handle, arrow_store

IN_MEMORY = 512 * 1024 * 1024
CHUNK = 8 * 1024 * 1024


def _digest_stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        digests = []
        for path in frame["path"]:
            store, inner = arrow_store(path)
            digest = hashlib.sha256()
            with store.open_input_stream(inner) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield frame.assign(sha256=digests)


def file_checksums(
    spark: SparkSession, path: str, pattern: str = "*", *, in_memory: int = IN_MEMORY, recursive: bool = False
) -> DataFrame:
    """``(file, size_bytes, sha256)`` of every matching file; ``file`` is its path below ``path``.

    With ``recursive`` the folders below count too, so files of one name in two folders are two files.
    Files that fit in memory are hashed inside the JVM; larger ones are streamed in
    chunks by the task that owns them, so no file size is out of reach.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = reader.option("recursiveFileLookup", recursive).load(path)
    small = files.where(F.col("length") <= in_memory).select(
        "path", "length", F.sha2("content", 256).alias("sha256")
    )
    large = (
        files.where(F.col("length") > in_memory)
        .select("path", "length")
        .mapInPandas(_digest_stream, "path string, length bigint, sha256 string")
    )
    both = small.unionByName(large)
    fs, hadoop = _handle(spark, path)
    root = fs.makeQualified(hadoop).toString().rstrip("/") + "/"
    # A pattern or a single file has no folder to be below of.
    below = F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1)))
    name = F.coalesce(below, F.element_at(F.split("path", "/"), -1))
    return both.select(name.alias("file"), F.col("length").alias("size_bytes"), "sha256")


def verify_files(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Status of every manifest entry: match, mismatch or missing."""
    got = actual.select("file", F.col("sha256").alias("found"), F.col("size_bytes").alias("found_bytes"))
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.lower("sha256") == F.col("found"), "match")
        .otherwise("mismatch")
    )
    return expected.join(got, "file", "left").withColumn("status", status)


def acquisition_manifest(files: DataFrame, accessions: DataFrame, accession: str = "accession") -> DataFrame:
    """What was acquired for each accession: (accession, kind, url, path, sha256, size_bytes), one row per archive file.

    ``files`` are ``file_checksums``; a file belongs to the accession and kind whose archive URL ends in its name. Archive
    files that are not there have NULL path, digest and size.
    """
    urls = accession_urls(accessions.select(accession).distinct(), accession)
    kinds = urls.unpivot(["accession"], ["family_soft", "raw_tar"], "kind", "url").distinct()
    kinds = kinds.withColumn("name", F.element_at(F.split("url", "/"), -1))
    got = files.select(
        F.element_at(F.split("file", "/"), -1).alias("own_name"), F.col("file").alias("path"), "sha256", "size_bytes"
    )
    joined = kinds.join(got, F.col("name") == F.col("own_name"), "left")
    return joined.select("accession", "kind", "url", "path", "sha256", "size_bytes")


def save_acquisitions(manifest: DataFrame, path: str) -> str:
    """JSON lines with a folder per accession, readable back with ``load_acquisitions``."""
    out = manifest.withColumn("of", F.col("accession"))
    out.write.mode("errorifexists").option("ignoreNullFields", False).partitionBy("of").json(path)
    return path


def load_acquisitions(spark: SparkSession, path: str) -> DataFrame:
    schema = "accession string, kind string, url string, path string, sha256 string, size_bytes bigint"
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
