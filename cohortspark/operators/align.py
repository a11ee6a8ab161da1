"""Joining modality tables by sample id."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.audit import require_unique_ids

JOIN_KINDS = ("inner", "left", "right", "outer")


@dataclass(frozen=True)
class Modality:
    """One row per sample, with at least one feature."""

    name: str
    df: DataFrame
    id: str = "sample_id"
    source: str = ""

    @property
    def features(self) -> list[str]:
        return [c for c in self.df.columns if c != self.id]


def modality_table(
    df: DataFrame,
    name: str,
    *,
    id: str = "sample_id",
    source: str = "",
    drop: Iterable[str] = (),
    check_ids: bool = True,
) -> Modality:
    if id not in df.columns:
        raise KeyError(f"{name}: id column {id!r} is not in the table")
    kept = df.drop(*drop)
    table = Modality(name, kept, id, source)
    if not table.features:
        raise ValueError(f"{name}: the table has no feature columns")
    if check_ids:
        require_unique_ids([(name, kept)], id)
    return table


def merge_modalities(tables: Sequence[Modality], how: str = "inner") -> DataFrame:
    """Join one-to-one by id with every feature named ``modality__feature``."""
    tables = list(tables)
    if not tables:
        raise ValueError("no modality tables to merge")
    if how not in JOIN_KINDS:
        raise ValueError(f"how must be one of {JOIN_KINDS}")
    merged = None
    for table in tables:
        named = table.df.select(
            F.col(table.id).alias(tables[0].id),
            *[F.col(f"`{c}`").alias(f"{table.name}__{c}") for c in table.features],
        )
        merged = named if merged is None else merged.join(named, tables[0].id, how)
    return merged


def align_modalities(
    tables: Mapping[str, DataFrame], id: str = "sample_id", *, check: bool = True
) -> DataFrame:
    """Samples present in every table; only colliding later columns are renamed."""
    if not tables:
        raise ValueError("no modalities to align")
    for name, df in tables.items():
        if id not in df.columns:
            raise ValueError(f"{name}: id column {id!r} is not in the table")
    if check:
        require_unique_ids(list(tables.items()), id)
    aligned = None
    for name, df in tables.items():
        if aligned is None:
            aligned = df
            continue
        taken = set(aligned.columns) - {id}
        named = df.select(
            *[F.col(f"`{c}`").alias(f"{name}__{c}" if c in taken else c) for c in df.columns]
        )
        aligned = aligned.join(named, id, "inner")
    if check and aligned.isEmpty():
        raise ValueError("the modalities share no sample ids")
    return aligned


def concat_embeddings(
    blocks: Mapping[str, DataFrame], id: str = "sample_id", vector: str = "v", *, check: bool = True
) -> DataFrame:
    """Append the vectors of every block per sample; all blocks need the same ids and one width."""
    if not blocks:
        raise ValueError("no embeddings to concatenate")
    if check:
        require_unique_ids(list(blocks.items()), id)
        _require_same_ids(blocks, id, vector)
    names = list(blocks)
    joined = blocks[names[0]].select(id, F.col(vector).alias("v0"))
    for i, name in enumerate(names[1:], start=1):
        joined = joined.join(blocks[name].select(id, F.col(vector).alias(f"v{i}")), id)
    return joined.select(id, F.concat(*[f"v{i}" for i in range(len(names))]).alias(vector))


def _require_same_ids(blocks: Mapping[str, DataFrame], id: str, vector: str) -> None:
    parts = None
    for name, df in blocks.items():
        part = df.select(F.lit(name).alias("block"), F.col(id).alias("k"), F.size(vector).alias("width"))
        parts = part if parts is None else parts.unionByName(part)
    holders = parts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != len(blocks))
    if not holders.isEmpty():
        raise ValueError("the embeddings do not cover the same sample ids")
    uneven = parts.groupBy("block").agg(F.min("width").alias("lo"), F.max("width").alias("hi"))
    row = uneven.where("lo <> hi or lo is null or lo < 0").select("block").first()
    if row is not None:
        raise ValueError(f"{row['block']}: embedding vectors differ in length")
