"""Sources interleaved to target weights by Pfair scheduling.

Each source is cut into blocks of ``BLOCK_ROWS`` documents, or of one ``MOST_BLOCKS``-th of the table where that is more. With weight w, block k (from 0) of a source is released at
slot floor(k / w) and due at slot ceil((k + 1) / w); the released block with the earliest deadline takes each slot. After any number of slots of a
phase a source then has had less than one block more or less than its weight asks for.

Weights are whole shares of ``PERIOD``, which is as fine as the doubles they come from, so windows follow the weights given
for any number of documents. The driver places block after block: some 65,000 of them however many documents there are, so its memory
and the schedule that is sent to the tasks do not grow with the table; where a document goes is then looked up. When a source has no blocks left, the rest go on with their weights scaled up: a new phase. No
document is dropped or repeated, and the driver never sees one.

Defined cases: a NULL source is a source of its own; NULL or absent weights mean no place among the targets and are an error, as
are weights that are not positive; the last block of a source may be short; repeated rows and NULL ids take places of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate, count, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.positions import with_positions

BLOCK_ROWS = 16
#: Blocks that a table is cut into at most, but for the last block of each source.
MOST_BLOCKS = 65_536
#: Numbers of a schedule up to which it is broadcast (a few MB); with more, which takes many sources, Spark picks the join.
BROADCAST_NUMBERS = 8 * MOST_BLOCKS
#: Sum of the whole shares that weights are turned into.
PERIOD = 10**17
#: Blocks of a source in one row of the schedule.
CHUNK = 256
#: Weight of a source by default: its number of documents to this power.
TEMPERATURE = 0.5


def rows_of_a_block(documents: int) -> int:
    return max(BLOCK_ROWS, -(-documents // MOST_BLOCKS))


def shares_of(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares of a period, at least 1 each, by largest remainder."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    period = max(period, 4 * len(weights))
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in parts.values()))
    whole = {s: x.numerator * (unit // x.denominator) for s, x in parts.items()}
    spare, total = period - len(weights), sum(whole.values())
    exact = {s: divmod(spare * n, total) for s, n in whole.items()}
    out = {s: 1 + n for s, (n, _) in exact.items()}
    short = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (-exact[s][1], s))[:short]:
        out[s] += 1
    return out


def turns(shares: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot from 0 on, without end, by earliest deadline first."""
    period = sum(shares.values())
    placed = dict.fromkeys(shares, 0)
    waiting = [(0, s) for s in sorted(shares)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for slot in count():
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(placed[s] + 1) * period // shares[s]), s))
        _, s = heapq.heappop(ready)
        yield s
        placed[s] += 1
        heapq.heappush(waiting, (placed[s] * period // shares[s], s))


def period_slots(shares: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of one period that each source takes."""
    slots: dict[str, list[int]] = {s: [] for s in shares}
    for slot, s in enumerate(islice(turns(shares), sum(shares.values()))):
        slots[s].append(slot)
    return slots


@dataclass(frozen=True)
class Phase:
    """From slot ``start`` on, with ``first[s]`` blocks of source s already placed; ``slots`` count from ``start``."""

    start: int
    shares: dict[str, int]
    first: dict[str, int]
    slots: dict[str, array]

    def slot(self, source: str, block: int) -> int:
        return self.start + self.slots[source][block - self.first[source]]


def phases_of(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD) -> list[Phase]:
    """Phases until all blocks are placed; one source at least runs out in each."""
    placed = dict.fromkeys(blocks, 0)
    start, out = 0, []
    while active := [s for s in blocks if placed[s] < blocks[s]]:
        shares = shares_of({s: weights[s] for s in active}, period)
        phase = Phase(start, shares, {s: placed[s] for s in active}, {s: array("q") for s in active})
        for slot, s in enumerate(turns(shares)):
            if placed[s] == blocks[s]:
                break
            phase.slots[s].append(slot)
            placed[s] += 1
        out.append(phase)
        start += slot
    return out


def schedule_rows(phases: list[Phase], counts: Mapping[str, int], block_rows: int) -> Iterator[tuple]:
    """Of each ``CHUNK`` blocks of a source: source, chunk, slots, first positions, and the phases these blocks fall into."""
    parts: dict[str, list[tuple[int, Phase]]] = {}
    for i, p in enumerate(phases):
        for s, own in p.slots.items():
            if own:
                parts.setdefault(s, []).append((i, p))
    # Only the last block of a source may be short: what it lacks is missing from all positions after its slot.
    last = {s: held[-1][1].start + held[-1][1].slots[s][-1] for s, held in parts.items()}
    short = sorted((last[s], -counts[s] % block_rows) for s in parts)
    at, lacking = [slot for slot, _ in short], [0, *accumulate(n for _, n in short)]
    for s, held in parts.items():
        slots = array("q")
        for _, p in held:
            slots.extend(p.start + x for x in p.slots[s])
        spans: dict[int, list[tuple]] = {}
        for i, p in held:
            row = (i, p.start, sum(p.shares.values()), p.first[s], p.shares[s])
            for chunk in range(p.first[s] // CHUNK, (p.first[s] + len(p.slots[s]) - 1) // CHUNK + 1):
                spans.setdefault(chunk, []).append(row)
        for chunk, found in spans.items():
            own = slots[chunk * CHUNK : (chunk + 1) * CHUNK].tolist()
            yield s, chunk, own, [x * block_rows - lacking[bisect_left(at, x)] for x in own], found


ADDED = ("mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline", "mix_position")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """All columns of ``docs``, then ``ADDED``, which replace columns of those names.

    Positions count from 0 without gaps. Inside a source the documents are in a hashed order of their ids. Without
    ``weights`` a source weighs its number of documents to the power ``TEMPERATURE``; the key of a NULL source is ``None``.
    ``options`` are those of ``scheduled``.
    """
    own = [F.col("all").getField(c).alias(c) for c in docs.columns if c not in ADDED]
    return scheduled(docs, weights, **options).select(*own, *ADDED)


def scheduled(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    source_column: str = "source",
    id_column: str = "doc_id",
    block_rows: int | None = None,
    period: int = PERIOD,
) -> DataFrame:
    """all (the row of ``docs``) and ``ADDED``; blocks follow the size of the table unless ``block_rows`` is given."""
    spark = docs.sparkSession
    source = docs[source_column].cast("string")
    keyed = docs.select(
        F.struct("*").alias("all"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("source"),
        docs[id_column].alias("id"),
    )
    counts = {r["source"]: r["count"] for r in keyed.groupBy("source").count().collect()}
    if weights is None:
        weighed = {s: n**TEMPERATURE for s, n in counts.items()}
    else:
        named = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        if missing := sorted(set(counts) - set(named)):
            raise ValueError(f"no weight for the sources {missing[:5]}")
        weighed = {s: named[s] for s in counts}
    if block_rows is None:
        block_rows = rows_of_a_block(sum(counts.values()))
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    phases = phases_of(blocks, weighed, period)

    placed = list(schedule_rows(phases, counts, block_rows))
    table = spark.createDataFrame(
        placed,
        "of string, chunk long, slots array<long>, starts array<long>, "
        "phases array<struct<phase int, start long, period long, first long, share long>>",
    )
    if sum(2 * len(slots) + 5 * len(spans) for _, _, slots, _, spans in placed) <= BROADCAST_NUMBERS:
        table = F.broadcast(table)
    ranked = with_positions(keyed, ["source"], [F.col("id")], "rank")
    block = F.floor(F.col("rank") / block_rows).cast("long")
    out = ranked.withColumn("mix_block", block)
    at = (F.col("source") == F.col("of")) & (F.expr(f"mix_block div {CHUNK}") == F.col("chunk"))
    out = out.join(table, at)
    out = out.withColumn("p", F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("mix_block")), -1))
    place = (F.pmod("mix_block", F.lit(CHUNK)) + 1).cast("int")
    # Shares have up to 18 digits: their products with block numbers need decimals.
    windows = "cast({} as decimal(19, 0)) * cast(p.period as decimal(18, 0))"
    out = out.withColumns(
        {
            "mix_phase": F.col("p.phase"),
            "mix_slot": F.element_at("slots", place),
            "mix_release": F.col("p.start") + F.expr(f"({windows.format('mix_block - p.first')}) div p.share"),
            "mix_deadline": F.col("p.start")
            + F.expr(f"({windows.format('mix_block - p.first + 1')} + p.share - 1) div p.share"),
        }
    )
    position = F.element_at("starts", place) + F.pmod(F.col("rank"), F.lit(block_rows))
    return out.withColumn("mix_position", position.cast("long")).select("all", *ADDED)


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """``docs`` with its own columns, rows in the order of the mixture: by range over the files, sorted inside."""
    mixed = scheduled(docs, weights, **options).select("all", "mix_position")
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select("all.*")
