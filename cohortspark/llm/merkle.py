"""Merkle manifest of a dataset: a root over all rows, a subroot per group, a proof per row.

Leaves are digests of rows, ranked within their group. Every node is labelled with the interval of leaf ranks that it covers. Levels are
built and joined in bands: a band takes the nodes of one level in buckets of ``fan ** depth`` neighbours, each bucket a row, and
builds the levels above them inside the bucket. What is left of each bucket is the next band's lowest level, so a group of any size takes
a few bands, and a group that holds most of the rows is spread over as many buckets as others. Ancestors are attached from the top
band down: the nodes of a band's lowest level meet the bucket whose interval contains theirs (equal bucket numbers, then
containment). Inside it, the ancestor on each level is the node that contains the interval; what its interval has beyond the
node's own is the siblings. Subroots, ordered by group, are the leaves of one more such tree.

Defined cases: NULL fields have a digest of their own (``-``); a NULL group is a group, before all others; rows of a group are ordered by id
(NULL first), equal ids by their digest, equal rows take any order; a group of one row is its own subroot; an empty table has an empty
manifest; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.rows import written

#: Children of a node, and levels of a band.
FAN, DEPTH = 2, 8
NODE = "struct<lo:bigint,hi:bigint,hash:string>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def row_digest(fields: Sequence[Column]) -> Column:
    """Digest of the fields in order: ``-`` for NULL, else UTF-8 byte count, ``:`` and value."""

    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*map(framed, fields)))


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` (a written table) with rank, from 0 in each group by ``order``, and size, the group's number of rows.

    The rows are sorted in ranges of (group, order); only the parts of groups in a range are counted, never a whole group in one task.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = ranged.withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("range", F.shiftright("at", 33)), "ranged")
    counted = ranged.groupBy("range", group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # One row per range and group in it.
    whole = Window.partitionBy(group)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(
        F.col("range").alias("of_range"),
        F.col(group).alias("of_group"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("size"),
    )
    on = (ranged["range"] == counted["of_range"]) & ranged[group].eqNullSafe(counted["of_group"])
    return ranged.join(counted, on).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "range", "shift", "of_range", "of_group")


def _level_up(nodes: Column, fan: int) -> Column:
    """Digests of every ``fan`` consecutive nodes; the last run may be shorter."""

    def made(i: Column) -> Column:
        run = F.slice(nodes, i * fan + 1, F.lit(fan))
        joined = F.array_join(F.transform(run, lambda x: x["hash"]), "")
        return F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), digest(joined).alias("hash"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int")), made)


def band(base: DataFrame, group: str, unit: int, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """One row per bucket of the nodes ``base`` (group, size, lo, hi, hash), each of ``unit`` leaves: group, size, bucket, lo, hi, levels.

    ``levels[0]`` is the bucket's part of the lowest level, the last level is one node.
    """
    wide = unit * fan**depth
    nodes = F.sort_array(F.collect_list(F.struct("lo", "hi", "hash")))
    rows = base.groupBy(group, F.floor(F.col("lo") / wide).alias("bucket")).agg(nodes.alias("nodes"), F.max("size").alias("size"))
    # Levels above: all of the band's where the group goes on above it, else those that leave one node.
    steps = F.when(F.col("size") > wide, F.lit(depth))
    for k in range(depth):
        steps = steps.when(F.size("nodes") <= fan**k, F.lit(k))
    steps = steps.otherwise(F.lit(depth))
    zero = F.array(F.col("nodes")).cast(f"array<array<{NODE}>>")
    levels = F.reduce(
        F.slice(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), steps),
        zero,
        lambda done, _: F.concat(done, F.array(_level_up(F.element_at(done, -1), fan)).cast(f"array<array<{NODE}>>")),
    )
    whole = F.col("nodes")
    return rows.select(
        group, "size", "bucket", whole[0]["lo"].alias("lo"), F.element_at(whole, -1)["hi"].alias("hi"), levels.alias("levels")
    )


def tops(buckets: DataFrame, group: str) -> DataFrame:
    """The node that each bucket comes to, with the bucket's interval."""
    return buckets.select(group, "size", "lo", "hi", F.element_at("levels", -1)[0]["hash"].alias("hash"))


def attached(base: DataFrame, buckets: DataFrame, group: str, unit: int, carry: Sequence[str], fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """``base`` (with group, lo, hi) and ``proof``, the siblings up to the root, and the columns ``carry`` of the buckets.

    A step of the proof is (left, right): the joined digests of the siblings before and after the node.
    """
    wide = unit * fan**depth
    names = {group: "in_group", **{c: f"in_{c}" for c in ("bucket", "lo", "hi", "levels", "steps")}}
    above = buckets.select(*[F.col(c).alias(name) for c, name in names.items()], *carry)
    on = (
        base[group].eqNullSafe(above["in_group"])
        & (F.floor(base["lo"] / wide) == above["in_bucket"])
        & (base["lo"] >= above["in_lo"])
        & (base["hi"] <= above["in_hi"])
    )
    joined = base.join(above, on)

    def step(level: Column) -> Column:
        # The parent on the next level holds every fan-th child; its interval contains the node's own.
        place = F.floor((F.col("lo") - F.col("in_lo")) / (F.pow(F.lit(fan), level + 1) * unit)).cast("int")
        children = F.slice(F.get("in_levels", level), place * fan + 1, F.lit(fan))
        left = F.filter(children, lambda x: x["hi"] <= F.col("lo"))
        right = F.filter(children, lambda x: x["lo"] >= F.col("hi"))
        join = lambda x: F.array_join(F.transform(x, lambda y: y["hash"]), "")
        return F.struct(join(left).alias("left"), join(right).alias("right"))

    own = F.transform(F.slice(F.sequence(F.lit(0), F.lit(depth - 1)), F.lit(1), F.size("in_levels") - 1), step)
    proof = F.concat(own, F.col("in_steps")).alias("proof")
    return joined.select(*[base[c] for c in base.columns], proof, *carry)


def tree(leaves: DataFrame, group: str, fan: int = FAN, depth: int = DEPTH) -> tuple[list[DataFrame], DataFrame]:
    """The bands over ``leaves`` (group, size, lo, hi, hash) from the lowest up, and one node per group, its root."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    bands, base, unit = [], leaves, 1
    while not bands or largest > unit:
        bands.append(written(band(base, group, unit, fan, depth), "band"))
        base, unit = tops(bands[-1], group), unit * fan**depth
    return bands, base


def below(bands: list[DataFrame], roots: DataFrame, group: str, carry: Sequence[str], fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """The lowest band with ``steps`` (the siblings from its buckets up) and ``carry``, from ``roots`` (group, steps, carry)."""
    of = roots.withColumnRenamed(group, "of_group")
    buckets = bands[-1].join(of, bands[-1][group].eqNullSafe(of["of_group"])).drop("of_group")
    for k in range(len(bands) - 2, -1, -1):
        unit = fan ** (depth * (k + 1))
        buckets = attached(bands[k], buckets, group, unit, carry, fan, depth).withColumnRenamed("proof", "steps")
    return buckets


@dataclass(frozen=True)
class Manifest:
    """``leaves``: id, group, what was asked for, leaf, rank, size; ``bands`` of the groups' trees; ``roots``: group, steps, subroot, root."""

    leaves: DataFrame
    bands: list[DataFrame]
    roots: DataFrame
    fan: int
    depth: int

    def nodes(self) -> DataFrame:
        """group, level, lo, hi, hash of every node of the groups' trees."""
        out = None
        for k, buckets in enumerate(self.bands):
            each = buckets.select("group", F.posexplode("levels").alias("at", "nodes"))
            # A band's lowest level is the top of the band below it.
            each = each.filter("at > 0") if k else each
            each = each.select("group", (F.col("at") + k * self.depth).alias("level"), F.explode("nodes").alias("node"))
            each = each.select("group", "level", "node.lo", "node.hi", "node.hash")
            out = each if out is None else out.unionByName(each)
        return out

    def proofs(self) -> DataFrame:
        """The leaves with proof (left and right siblings, step by step up to the root), subroot and root."""
        buckets = below(self.bands, self.roots, "group", ["subroot", "root"], self.fan, self.depth)
        leaves = self.leaves.withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1})
        return attached(leaves, buckets, "group", 1, ["subroot", "root"], self.fan, self.depth).drop("lo", "hi")


def manifest(
    rows: DataFrame,
    fields: Sequence[Column],
    group: Column,
    key: Column,
    also: dict[str, Column] | None = None,
    fan: int = FAN,
    depth: int = DEPTH,
) -> Manifest:
    """Of ``rows``: a leaf is the digest of ``fields``, leaves of a group are ordered by ``key``; ``also`` travels with the leaf."""
    also = also or {}
    leaves = rows.select(
        key.alias("key"),
        group.alias("group"),
        row_digest(fields).alias("leaf"),
        F.monotonically_increasing_id().alias("row"),
        *(c.alias(f"also_{name}") for name, c in also.items()),
    )
    # Rows that are equal in all else are spread by their number.
    leaves = written(ranked(written(leaves, "leaves"), "group", ["key", "leaf", "row"]).drop("row"), "ranked")
    named = leaves.select("group", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("hash"))
    bands, subroots = tree(named, "group", fan, depth)
    subroots = written(subroots.select("group", F.col("hash").alias("subroot"), F.lit(0).alias("all")), "subroots")
    tops_ = written(ranked(subroots, "all", ["group"]), "tops")
    tops_ = tops_.withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1})
    over, root = tree(tops_.withColumnRenamed("subroot", "hash").select("all", "size", "lo", "hi", "hash"), "all", fan, depth)
    root = root.select("all", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("steps"))
    roots = attached(tops_, below(over, root, "all", ["root"], fan, depth), "all", 1, ["root"], fan, depth)
    roots = written(roots.select("group", F.col("proof").alias("steps"), "subroot", "root"), "roots")
    return Manifest(leaves, bands, roots, fan, depth)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.reduce(proof, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))
