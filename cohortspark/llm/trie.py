"""Prefix trie of conversations as balanced parentheses.

A conversation is the sequence of its turns' digests; a node of the trie is a distinct prefix. Distinct conversations are sorted by their
digests, which is the depth-first order of the trie, and dealt in ranges to shards. Each shard writes its part of the trie as balanced
parentheses: one is opened for a node before its subtree and closed after it. A tree of minima over blocks of the excess (opened
minus closed) answers ``findclose`` for every node; the subtree of a node is what stands between. Inside it, the rank of the pairs "()"
counts leaves, and differences of cumulative arrays give members and savings.

Nodes that two neighbouring shards share are prefixes of the last conversation before the boundary and of the first after it: the spines. A
shard knows the conversations next to its own, so what is counted once (nodes, their bytes, leaves, children) is counted by the first
shard of a node, and everything else adds up: shared nodes are merged by sums over shards.

Defined cases: rows without a conversation id belong to no conversation and are left out; NULL turns come first, equal turns in the order of their
digests; NULL role or text is the empty string; a conversation without turns is a member of the root alone; equal conversations are
members of the same nodes; an empty table has no nodes; columns other than the four named are not read. Turns are equal if 128 bits of
SHA-256 of role and text are. A conversation travels as one row of about 50 bytes a turn. The ids that end at a node are hashed in one
stream, as SHA-256 has no other way, of runs that were sorted and joined before; the stream holds one run at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.rows import written

#: A shard is closed once it has so many nodes.
SHARD_NODES = 200_000
#: Bytes of a turn's digest, and parentheses per leaf block of the tree of minima.
DIGEST, BLOCK = 16, 64
#: Ids that end at a node are sorted in runs of so many consecutive numbers (a power of two).
RUN_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Minima:
    """Minima over blocks, blocks of blocks and so on of an array of numbers."""

    def __init__(self, values: np.ndarray, block: int = BLOCK):
        self.block, self.levels = block, [values]
        while len(self.levels[-1]) > 1:
            under = self.levels[-1]
            padded = np.full(-(-len(under) // block) * block, np.iinfo(np.int64).max)
            padded[: len(under)] = under
            self.levels.append(padded.reshape(-1, block).min(axis=1))

    def first_below(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each query the first place from ``start`` on whose value is below ``bound``; one must exist."""
        at, level = start.astype(np.int64), np.zeros(len(start), np.int64)
        out, open_ = np.full(len(start), -1), np.arange(len(start))
        while len(open_):
            found = np.zeros(len(open_), bool)
            for k in np.unique(level):
                mine = np.flatnonzero(level == k)
                inside = at[mine] < len(self.levels[k])
                found[mine[inside]] = self.levels[k][at[mine[inside]]] < bound[open_[mine[inside]]]
            done = found & (level == 0)
            out[open_[done]] = at[done]
            # Down into a block that holds one; else on, and up at a block's end.
            at = np.where(found, at * self.block, at + 1)
            up = ~found & (at % self.block == 0)
            at, level = np.where(up, at // self.block, at), level + up - (found & ~done)
            at, level, open_ = at[~done], level[~done], open_[~done]
        return out

    def least(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The minimum of each range, none of them empty."""
        lo, hi = start.astype(np.int64), stop.astype(np.int64)
        out = np.full(len(lo), np.iinfo(np.int64).max)
        for level in self.levels:
            if not (lo < hi).any():
                break
            for _ in range(self.block - 1):  # up to the next block's start, and down from the last one's end
                front, back = (lo < hi) & (lo % self.block != 0), (lo < hi) & (hi % self.block != 0)
                if not front.any() and not back.any():
                    break
                out[front] = np.minimum(out[front], level[lo[front]])
                lo = lo + front
                back &= lo < hi
                out[back] = np.minimum(out[back], level[hi[back] - 1])
                hi = hi - back
            lo, hi = lo // self.block, np.maximum(hi // self.block, lo // self.block)
        return out


class Parentheses:
    """A forest in depth-first order; node numbers count opened parentheses."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.opens = np.flatnonzero(bits)
        excess = np.cumsum(np.where(bits, 1, -1))
        self.closes = Minima(excess).first_below(self.opens + 1, excess[self.opens])
        #: Node number after the last node of each subtree.
        self.ends = np.arange(len(self.opens)) + (self.closes - self.opens + 1) // 2
        #: Nodes that are opened and closed at once.
        self.leaf = ~bits[self.opens + 1]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of a number per node, the sum over each subtree."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.ends] - total[:-1]


def common(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Leading digests that each sequence shares with the one before; -1 for the first."""
    out = np.full(len(lengths), -1, np.int64)
    if len(lengths) < 2:
        return out
    most = np.minimum(lengths[1:], lengths[:-1])
    ends = np.cumsum(most)
    step = np.arange(ends[-1]) - np.repeat(ends - most, most)
    left, right = np.repeat(starts[:-1], most) + step, np.repeat(starts[1:], most) + step
    differ = (flat[left] != flat[right]).any(axis=1)
    first = np.where(differ, step, np.repeat(most, most))
    out[1:] = most
    full = np.flatnonzero(most)
    if len(full):
        out[1:][full] = np.minimum.reduceat(first, (ends - most)[full])
    return out


def shard_nodes(
    flat: np.ndarray,
    sizes: np.ndarray,
    lengths: np.ndarray,
    members: np.ndarray,
    ids: np.ndarray,
    before: int,
    after: int,
) -> dict[str, np.ndarray]:
    """Nodes of one shard in depth-first order, from its distinct conversations in order.

    ``flat`` has a row per turn, ``sizes`` its bytes; ``members`` and ``ids`` are the number and the smallest id of the equal conversations.
    ``before`` and ``after`` are the digests that the first shares with the one before the shard and the last with the one after; -1: none is there.
    """
    starts = np.cumsum(lengths) - lengths
    shared = common(flat, starts, lengths)
    opened = lengths - np.maximum(shared, 0)
    closed = np.concatenate([lengths[:-1] - shared[1:], [lengths[-1] + 1]])
    # The root, then what each conversation opens and what is closed before the next.
    runs = np.empty(2 * len(lengths) + 1, np.int64)
    runs[0], runs[1::2], runs[2::2] = 1, opened, closed
    kinds = np.zeros(len(runs), bool)
    kinds[0], kinds[1::2] = True, True
    tree = Parentheses(np.repeat(kinds, runs))
    n = len(tree.opens)
    last = np.cumsum(opened)  # the node at which each conversation ends (0 is the root)
    of = np.concatenate([[0], np.repeat(np.arange(len(lengths)), opened)])
    depth = np.zeros(n, np.int64)
    depth[1:] = np.arange(1, n) - np.repeat(last - lengths, opened)
    # A conversation that opens nothing is the root alone, as it differs from the one before.
    place = np.where(lengths > 0, last, 0)
    ends, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    ends[place], least[place] = members, ids
    turn = starts[of] + depth - 1
    turn_bytes = np.where(depth > 0, sizes[np.maximum(turn, 0)] if len(sizes) else 0, 0)
    first_path, last_path = np.zeros(n, bool), np.zeros(n, bool)
    first_path[: lengths[0] + 1] = True
    old = first_path & (depth <= before)
    n_convs = tree.sums(ends)
    leaf = tree.leaf.copy()
    if after >= lengths[-1]:
        leaf[place[-1]] = False  # the next shard goes on below it
    key = depth * (n + 1) + np.arange(n)
    order = np.argsort(key, kind="stable")
    parent = np.full(n, -1, np.int64)
    parent[1:] = order[np.searchsorted(key[order], (depth[1:] - 1) * (n + 1) + np.arange(1, n)) - 1]
    last_path[_path(parent, int(place[-1]))] = True
    return {
        "depth": depth,
        "turn": turn,
        "of": of,
        "parent": parent,
        "conv_id": Minima(least).least(np.arange(n), tree.ends),
        "n_convs": n_convs,
        "n_children": np.bincount(parent[1:][~old[1:]], minlength=n),
        "n_leaves": tree.sums(leaf.astype(np.int64)),
        "saved_tokens": tree.sums(n_convs * turn_bytes - np.where(old, 0, turn_bytes)),
        "shared": old | (last_path & (depth <= after)),
        "place": place,
    }


def _path(parent: np.ndarray, node: int) -> list[int]:
    out = []
    while node >= 0:
        out.append(node)
        node = int(parent[node])
    return out


def digest_of(role: Column, text: Column) -> Column:
    """128 bits of a role and a text; the role's length keeps the two apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, DIGEST)


def sequences(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    family: int = 1,
) -> DataFrame:
    """conv_id, base and path (digest, n_bytes of each turn, in order) of each conversation.

    base is the largest multiple of ``family`` up to the id; conversations of one base lie in one partition.
    """
    role_, text_ = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role, text))
    plain = turns.filter(turns[conv_id].isNotNull()).select(
        turns[conv_id].cast("long").alias("conv_id"),
        F.struct(
            turns[turn].alias("turn"),
            digest_of(role_, text_).alias("digest"),
            F.octet_length(text_).cast("long").alias("n_bytes"),
        ).alias("one"),
    )
    plain = plain.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family))).repartition("base")
    path = F.transform(F.sort_array(F.collect_list("one")), lambda x: F.struct(x["digest"], x["n_bytes"]))
    return plain.groupBy("base", "conv_id").agg(path.alias("path"))


def rerooted(paths: DataFrame, most: int = 9) -> DataFrame:
    """Each conversation with its first h turns taken from the conversation whose id is its base.

    h is the crc32 of the decimal id modulo ``most``. Where no such conversation is, these turns are lost.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    head = F.when(F.col("conv_id") == F.col("base"), F.slice("path", 1, most - 1))
    # As many conversations as a family has share a window.
    kin = paths.select("conv_id", "path", h.alias("h"), F.max(head).over(Window.partitionBy("base")).alias("head"))
    head = F.slice(F.coalesce("head", F.slice("path", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))
    return kin.select("conv_id", F.concat(head, rest).alias("path"))


def _ends(convs: DataFrame) -> DataFrame:
    """key (of the path), conv_id (the smallest), members, ends_sha256 (of the ids in order) of each distinct path."""
    runs = convs.groupBy("key", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(
        F.min("conv_id").alias("least"), F.count("*").alias("n"), F.sort_array(F.collect_list("conv_id")).alias("ids")
    )
    runs = runs.select("key", "run", "least", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for key, _, least, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now[0] == key:
                    now[2] += n
                    now[3].update(b"," + ids.encode())
                    continue
                if now is not None:
                    rows.append((*now[:3], now[3].hexdigest()))
                now = [key, least, n, hashlib.sha256(ids.encode())]
            if len(rows) > 5000:
                yield _rows(rows)
                rows = []
        if now is not None:
            yield _rows([*rows, (*now[:3], now[3].hexdigest())])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "conv_id", "members", "ends_sha256"])

    runs = runs.repartition("key").sortWithinPartitions("key", "run")
    return runs.mapInArrow(hashed, "key binary, conv_id long, members long, ends_sha256 string")


def in_order(convs: DataFrame) -> DataFrame:
    """Distinct conversations of ``convs`` (conv_id, path) in ranges of their order.

    part (number of the range), path, conv_id, members, ends_sha256; and for each part one row more, without a path, of the
    paths before and after the range.
    """
    hexes = F.transform("path", lambda x: F.hex(x["digest"]))
    key = F.substring(F.unhex(F.sha2(F.concat_ws("", F.size("path").cast("string"), hexes), 256)), 1, DIGEST)
    convs = written(convs.select("conv_id", "path", key.alias("key")), "rebuilt")
    ends = _ends(convs.select("conv_id", "key")).select("conv_id", "members", "ends_sha256")
    distinct = written(convs.join(ends, "conv_id").drop("key"), "distinct")
    ranged = distinct.repartitionByRange("path").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    bounds = ranged.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    next_to = Window.orderBy("part")  # one row per range
    bounds = bounds.select(
        F.col("part").alias("of"), F.lag("high").over(next_to).alias("before"), F.lead("low").over(next_to).alias("after")
    )
    bounds = bounds.withColumnRenamed("of", "part")
    return ranged.unionByName(bounds, allowMissingColumns=True)


NODES = (
    "shard string, id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)


def _digests(paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests (two numbers each) and bytes of all turns, and the number of turns of each conversation."""
    lengths = np.array([0 if n is None else n for n in paths.value_lengths().to_pylist()], np.int64)
    turns = paths.flatten()
    raw = b"".join(turns.field(0).to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, 2), turns.field(1).to_numpy(zero_copy_only=False).astype(np.int64), lengths


class Shard:
    """Conversations of one range, in order, until they are enough for a shard."""

    def __init__(self, part: int):
        self.part, self.number, self.nodes, self.rows = part, 0, 0, []

    def take(self, flat: np.ndarray, sizes: np.ndarray, conv_id: int, members: int, ends: str, shared: int) -> None:
        self.rows.append((flat, sizes, conv_id, members, ends, shared))
        self.nodes += len(flat) - max(shared, 0)

    def close(self, after: int) -> pa.RecordBatch:
        flats, sizes, ids, members, ends, shared = zip(*self.rows, strict=True)
        lengths = np.fromiter(map(len, flats), np.int64, len(flats))
        flat, sizes = np.concatenate(flats), np.concatenate(sizes)
        found = shard_nodes(flat, sizes, lengths, np.array(members), np.array(ids), shared[0], after)
        n, starts = len(found["depth"]), np.cumsum(lengths) - lengths
        ids_of: list[bytes | None] = [None] * n
        for node in np.flatnonzero(found["shared"]):
            start = starts[found["of"][node]]
            path = flat[start : start + found["depth"][node]].tobytes()
            ids_of[node] = hashlib.sha256(path).digest()[:DIGEST]
        parent = found["parent"]
        parent_ids = [None if p < 0 else ids_of[p] for p in parent]
        known = np.array([p >= 0 and ids_of[p] is None for p in parent], bool)
        ended = np.full(n, None, object)
        ended[found["place"]] = ends
        columns = [
            pa.array([f"{self.part}-{self.number}"] * n),
            pa.array(ids_of, pa.binary()),
            pa.array(parent_ids, pa.binary()),
            pa.array(found["conv_id"]),
            pa.array(found["depth"]),
            pa.array(found["conv_id"][parent], mask=~known),
            *(pa.array(found[c].astype(np.int64)) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
            pa.array(list(ended), pa.string()),
        ]
        self.number, self.nodes, self.rows = self.number + 1, 0, []
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODES.split(", ")])


def parts_of_trie(ordered: DataFrame, nodes_per_shard: int = SHARD_NODES) -> DataFrame:
    """Rows of ``NODES`` of every shard. Nodes that shards share have an ``id``; of the children of such nodes the parent's is told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        tail = after = None  # the conversation before, and the one after the part
        for batch in batches:
            rows_here = batch.column(1).is_valid().to_pylist()
            parts, ids, members, ends = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            flat, sizes, lengths = _digests(batch.column(1))
            stop = np.cumsum(lengths)
            inside = common(flat, stop - lengths, lengths)
            for i, part in enumerate(parts):
                if not rows_here[i]:  # the first row of a part: its neighbours
                    if shard is not None and shard.rows:
                        yield shard.close(_pair(tail, after))
                    tail, after = (_digests(batch.column(c).slice(i, 1))[0] if batch.column(c)[i].is_valid else None for c in (5, 6))
                    shard = Shard(part)
                    continue
                own = slice(int(stop[i] - lengths[i]), int(stop[i]))
                shared = int(inside[i]) if i and rows_here[i - 1] else _pair(tail, flat[own])
                if shard.nodes >= nodes_per_shard:
                    yield shard.close(shared)
                shard.take(flat[own], sizes[own], ids[i], members[i], ends[i], shared)
                tail = flat[own]
        if shard is not None and shard.rows:
            yield shard.close(_pair(tail, after))

    rows = ordered.select("part", "path", "conv_id", "members", "ends_sha256", "before", "after")
    return rows.repartition("part").sortWithinPartitions("part", "path").mapInArrow(run, NODES)


def _pair(left: np.ndarray | None, right: np.ndarray | None) -> int:
    if left is None or right is None:
        return -1
    n = min(len(left), len(right))
    differ = np.flatnonzero((left[:n] != right[:n]).any(axis=1))
    return int(differ[0]) if len(differ) else n


def trie(convs: DataFrame, nodes_per_shard: int = SHARD_NODES) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, path): the smallest member and the depth name it.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    nodes = written(parts_of_trie(in_order(convs), nodes_per_shard), "nodes")
    spines = nodes.filter("id is not null")
    merged = spines.groupBy("id").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("parent_id").alias("parent_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    merged = written(merged, "spines")
    # Parents are looked up by shard and id, so the children of one node are spread like the shards.
    named = spines.select(F.col("shard").alias("in"), "id").join(
        merged.select(F.col("id").alias("merged_id"), F.col("conv_id").alias("named")), F.col("id") == F.col("merged_id")
    )
    named = named.select("in", F.col("id").alias("up"), "named")
    inner = nodes.filter("id is null").drop("id")
    settled = inner.filter("parent_id is null")
    below = inner.filter("parent_id is not null").join(named, (F.col("shard") == F.col("in")) & (F.col("parent_id") == F.col("up")))
    tops = merged.select(F.col("id").alias("up"), F.col("conv_id").alias("named"))
    upper = merged.join(tops, F.col("parent_id") == F.col("up"), "left")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    out = settled.select(*columns, "parent_conv_id")
    for rows in (below, upper):
        out = out.unionByName(rows.select(*columns, F.col("named").alias("parent_conv_id")))
    return out.select("conv_id", "depth", "parent_conv_id", *columns[2:6], "ends_sha256")
