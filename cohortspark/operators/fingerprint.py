"""Content fingerprints of tables, as one map-side aggregate."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import __version__
from cohortspark.functions.keys import hash32, hash60

NULL_MARK = "\\N"


def _as_text(name: str, dtype: T.DataType) -> Column:
    col = F.col(f"`{name}`")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(F.struct(col.alias("v")))
    elif isinstance(dtype, T.BinaryType):
        text = F.hex(col)
    else:
        text = col.cast("string")
    # The length in front keeps neighbouring values apart.
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(NULL_MARK))


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[_as_text(c, df.schema[c].dataType) for c in columns])


def content_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count, sum and xor of the row hashes: independent of row order, but not of multiplicity."""
    return df.select(row_text(df, columns).alias("t")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(hash32(F.col("t")).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)"))
        .cast("string")
        .alias("hash_sum"),
        F.coalesce(F.bit_xor(hash60(F.col("t"))), F.lit(0).cast("bigint")).alias("hash_xor"),
    )


def _schema_text(df: DataFrame, columns: Sequence[str]) -> str:
    return json.dumps([(c, df.schema[c].dataType.simpleString()) for c in columns])


def _digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    sums = content_sums(df, columns)
    parts = F.concat_ws("/", F.lit(_schema_text(df, columns)), F.col("n_rows"), "hash_sum", F.col("hash_xor"))
    return sums.select("n_rows", "hash_sum", "hash_xor", F.sha2(parts, 256).alias("fingerprint"))


def keyed_fingerprint(df: DataFrame, id: str) -> DataFrame:
    """Changes with any value, column order, column type or the id a row is filed under."""
    if id not in df.columns:
        raise KeyError(f"id column {id!r} is not in the table")
    return _digest(df, df.columns)


def multiset_fingerprint(df: DataFrame) -> DataFrame:
    """The same for any order of rows and columns."""
    return _digest(df, sorted(df.columns))


def fingerprint(df: DataFrame, id: str | None = None) -> str:
    table = multiset_fingerprint(df) if id is None else keyed_fingerprint(df, id)
    return table.first()["fingerprint"]


def _setting_lines(path: str, value: Any) -> list[str]:
    """``path type:length:text`` of every setting; mappings by key, sequences by place."""
    if isinstance(value, Mapping):
        inner = [(f"{path}.{k}", value[k]) for k in sorted(value, key=str)]
    elif isinstance(value, (list, tuple)):
        inner = [(f"{path}[{i}]", x) for i, x in enumerate(value)]
    else:
        text = repr(value)
        return [f"{path} {type(value).__name__}:{len(text)}:{text}"]
    return [f"{path} holds {len(inner)}", *(line for p, x in inner for line in _setting_lines(p, x))]


def config_fingerprint(config: Mapping[str, Any]) -> str:
    """Changes with any setting, its type or its place; the order of a mapping does not matter."""
    digest = hashlib.sha256()
    for line in _setting_lines("config", config):
        digest.update(f"{line}\n".encode())
    return digest.hexdigest()


def runtime_metadata() -> dict[str, str]:
    return {
        "created_at_utc": datetime.now(UTC).isoformat(),
        "python": platform.python_version(),
        "platform": platform.platform(),
        "spark": pyspark.__version__,
        "engine_version": __version__,
    }
