"""Filtering whole rows by flags that were computed without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.session import scratch_path


def kept_rows(docs: DataFrame, id_column: str, tag: Column, flags: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``flags`` (doc_id, tag, kept: one row per row of ``docs``) keeps, with all their columns.

    Rows are told apart by id and ``tag``, a hash of their text. Of rows that agree in both, one stays if one is kept.
    """
    keys = flags.groupBy("doc_id", "tag").agg(F.max("kept").alias("stays"), F.count("*").alias("copies"))
    # The row travels as one column, so its own names clash with nothing.
    keyed = docs.select(F.struct("*").alias("all"), docs[id_column].alias("id"), tag.alias("own_tag"))

    def matched(some: DataFrame, how: str) -> DataFrame:
        on = keyed["id"].eqNullSafe(some["doc_id"]) & (keyed["own_tag"] == some["tag"])
        return keyed.join(some.select("doc_id", "tag"), on, how)

    repeated = keys.filter("stays and copies > 1")
    rest = matched(keys.filter("not stays or copies > 1"), "left_anti")
    if not repeated.isEmpty():
        rest = rest.unionByName(matched(repeated, "left_semi").dropDuplicates(["id", "own_tag"]))
    return rest.select("all.*")


def written(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` with a closer compression, for large tables that are read a few times."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
