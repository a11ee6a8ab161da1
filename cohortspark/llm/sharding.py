"""Shards through fixed virtual slots.

A record is hashed by its text into one of a fixed number of virtual slots, so that equal texts share a slot for ever.
Only the bytes per slot are gathered (``slots`` rows, whatever the input). A versioned map says which shard holds
which slot; rebalancing and growing edit the map and move as few slots as needed, no record is hashed anew.

Defined cases: a NULL text has no bytes and is hashed like the empty text; every record weighs its bytes plus one; an
empty table gives an empty result and a map of empty slots; repeated rows take places of their own; columns of the
input other than id and text are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.positions import with_positions
from cohortspark.session import materialize

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[slot]`` is the shard that holds the slot in this version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")


def initial_map(slot_bytes: list[int], shards: int) -> SlotMap:
    """Heaviest slots first, each to the lightest shard."""
    heap = [(0, shard) for shard in range(shards)]
    held = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
        load, shard = heapq.heappop(heap)
        held[slot] = shard
        heapq.heappush(heap, (load + slot_bytes[slot], shard))
    return SlotMap(1, shards, tuple(held))


def rebalanced(old: SlotMap, slot_bytes: list[int], shards: int | None = None) -> SlotMap:
    """The next version: slots leave the heaviest shard for the lightest while that evens the two out.

    With more shards than before the new ones start empty and only they receive; with fewer, the slots of the removed
    shards are dealt first.
    """
    shards = shards or old.shards
    receive = range(old.shards, shards) if shards > old.shards else range(shards)
    held: list[list[int]] = [[] for _ in range(shards)]
    homeless, loads = [], [0] * shards
    for slot, shard in enumerate(old.shard_of):
        if shard < shards:
            held[shard].append(slot)
            loads[shard] += slot_bytes[slot]
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-slot_bytes[s], s)):
        to = min(range(shards), key=lambda s: (loads[s], s))
        held[to].append(slot)
        loads[to] += slot_bytes[slot]
    for slots in held:
        slots.sort(key=lambda s: (slot_bytes[s], s))
    while True:
        heavy = max(range(shards), key=lambda s: (loads[s], -s))
        light = min(receive, key=lambda s: (loads[s], s))
        gap = loads[heavy] - loads[light]
        fits = [s for s in held[heavy] if 0 < 2 * slot_bytes[s] <= gap]
        if not fits:
            break
        slot = fits[-1]
        held[heavy].remove(slot)
        held[light].append(slot)
        held[light].sort(key=lambda s: (slot_bytes[s], s))
        loads[heavy] -= slot_bytes[slot]
        loads[light] += slot_bytes[slot]
    shard_of = [0] * len(old.shard_of)
    for shard, slots in enumerate(held):
        for slot in slots:
            shard_of[slot] = shard
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add one version to the maps under ``path``; a version is never overwritten."""
    slot_map.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/v{slot_map.version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = sorted(spark.read.parquet(f"{path}/v{version:06d}").collect(), key=lambda r: r["virtual_slot"])
    return SlotMap(rows[0]["version"], rows[0]["shards"], tuple(r["shard"] for r in rows))


def in_slots(docs: DataFrame, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size, text_crc32 and virtual_slot of every record."""
    text = F.coalesce(docs[text_column], F.lit(""))
    return docs.select(
        docs[id_column].alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def bytes_per_slot(slotted: DataFrame, slots: int) -> list[int]:
    """At most ``slots`` rows come to the driver."""
    out = [0] * slots
    for row in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("size")).collect():
        out[row["virtual_slot"]] = row["size"]
    return out


def shard(
    docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, SlotMap]:
    """The records with shard and place in it, and the first version of the map."""
    slotted = materialize(in_slots(docs, slots, id_column, text_column), "slotted")
    slot_map = initial_map(bytes_per_slot(slotted, slots), shards)
    return placed(slotted, slot_map), slot_map


def placed(slotted: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Look the shard up and count the records of each shard from 0. The map has a fixed number of rows."""
    lookup = F.broadcast(slot_map.frame(slotted.sparkSession).select("virtual_slot", "shard", "version"))
    found = slotted.join(lookup, "virtual_slot")
    return with_positions(found, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
