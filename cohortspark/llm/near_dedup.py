"""Near duplicates by MinHash bands and sequential Bayesian verification.

A document is the set of its distinct word shingles. Documents with the same set are one node. The signature of a node is cut into
bands; nodes that agree in a band share a bucket. A pair of a bucket is compared on its signatures batch by batch: after
n positions with m agreements the posterior probability that the similarity reaches the threshold is
P(Binomial(n + 1, threshold) <= m), and the pair is given up once that falls below ``miss``. What survives is compared on the
full sets. Links are closed to components.

Buckets may be huge, so pairs are not listed: each bucket is compared with a leader, the member that shares most with others. Buckets
whose members are one component after that are settled. In the others all are near their leader, so what a node does not share with it is small, and linked nodes have
much of that in common: smaller buckets follow from it exactly (see ``delta_buckets``), in which nodes are compared with
members of other components, a growing number of them per round until every bucket is settled. Nodes that counts of what they share with nobody
rule out are not compared (see ``within_reach``). Every other pair of a bucket is then compared or in one component. With 32 bands of 7 rows a pair at similarity 0.85 shares no bucket with probability 4e-6 (0.8: 5e-4), and ``miss`` bounds the loss
after that.

Defined cases: a text of fewer than ``words`` words is one shingle; a NULL text or one without words has the empty set and is
linked with nothing; ids may be NULL or repeat (the smallest id of a component stands for it, NULL only where there is no other;
of rows that repeat it one is kept); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.components import components
from cohortspark.llm.packing import steps
from cohortspark.llm.rows import kept_rows
from cohortspark.session import materialize, small_batches

BANDS, BAND_ROWS, BATCH = 32, 7, 32
#: Chosen probability of giving up a pair that reaches the threshold.
MISS = 1e-7
#: Factor by which the leaders per bucket grow from round to round.
LEADERS = 32
#: Hashed counters for the order of shingles.
COUNTERS = 1 << 18
#: Bytes of text that are shingled at a time: words, hashes and sets take about twenty times as much.
SHINGLE_BYTES = 2 << 20

_draw = np.random.default_rng(20240607)
_A = _draw.integers(0, 1 << 31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _draw.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)
_M = _draw.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, A-Z lower-cased, and the end of each text in them."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pc.ascii_lower(split.flatten())
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy()]
    return (flat if full.all() else flat.filter(pa.array(full))), ends


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    flat, ends = words_of(texts)
    coded = flat.dictionary_encode()
    hashes = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    word = np.array(hashes, np.uint64)[coded.indices.to_numpy()] if len(hashes) else np.empty(0, np.uint64)
    rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for i in range(words if len(rolled) else 0):
        rolled += word[i : i + len(rolled)] * _M[i]
    rolled = _mixed(rolled)
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        if end - start >= words:
            yield np.unique(rolled[start : end - words + 1])
        elif end > start:
            n = int(end - start)
            yield _mixed(np.array([(word[start:end] * _M[32 : 32 + n]).sum()], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One minimum per hash function; the empty set has none."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A bucket number for each band of each signature."""
    rows = signatures.reshape(len(signatures), BANDS, BAND_ROWS).astype(np.uint64)
    total = (rows * _M[:BAND_ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * _M[40]
    return _mixed(total).view(np.int64)


def least_agreements(threshold: float, miss: float, batch: int = BATCH) -> list[tuple[int, int]]:
    """(positions seen, agreements below which a pair is given up) after each batch."""
    out = []
    for n in range(batch, BANDS * BAND_ROWS + 1, batch):
        cdf, m = 0.0, 0
        while True:
            cdf += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if cdf >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def sketches(docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """row, doc_id, tag (hash of the text), n_shingles, key (of the set), bands and signature of every document."""
    text = docs[text_column]
    plain = docs.select(
        docs[id_column].alias("doc_id"),
        text.alias("text"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"),
    )
    id_type = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in steps(iter([batch]), SHINGLE_BYTES):
                counts, keys, found = [], [], []
                for shingles in shingle_sets(texts, words):
                    counts.append(len(shingles))
                    keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    found.append(signature(shingles))
                found = np.stack(found)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(ids) + 1) * BANDS, pa.int32()), pa.array(band_keys(found).ravel())
                )
                columns = [batch.column(2).slice(at, len(ids)), ids, batch.column(3).slice(at, len(ids))]
                columns += [pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), bands]
                columns.append(pa.array([s.tobytes() for s in found], pa.binary()))
                at += len(ids)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["row", "doc_id", "tag", "n_shingles", "key", "bands", "signature"]
    return plain.mapInArrow(
        run,
        f"row long, doc_id {id_type}, tag long, n_shingles long, key binary, bands array<bigint>, signature binary",
    )


def survivors(pairs: DataFrame, known: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out. ``known``: node, n_shingles, signature."""
    rules = least_agreements(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(len(batch), -1) for i in (2, 3)
            )
            alive, agreed, seen = np.arange(len(batch)), np.zeros(len(batch), np.int64), 0
            for n, least in rules:
                agreed = agreed + (left[alive, seen:n] == right[alive, seen:n]).sum(axis=1)
                alive, agreed, seen = alive[agreed >= least], agreed[agreed >= least], n
            rows = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    def side(name: str) -> DataFrame:
        return known.select(*[F.col(c).alias(f"{name}_{c}") for c in ("node", "n_shingles", "signature")])

    joined = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
    sizes = F.least("a_n_shingles", "b_n_shingles") >= F.lit(threshold) * F.greatest("a_n_shingles", "b_n_shingles")
    return joined.filter(sizes).select("a", "b", "a_signature", "b_signature").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """node, shingles of the ``wanted`` nodes (node, doc_id, tag, key), read again from the texts."""
    wanted = wanted.select("node", F.col("doc_id").alias("wanted_id"), F.col("tag").alias("wanted_tag"), "key")
    text = docs[text_column]
    plain = docs.select(
        docs[id_column].alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own_tag")
    )
    on = plain["id"].eqNullSafe(wanted["wanted_id"]) & (plain["own_tag"] == wanted["wanted_tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(2).to_pylist(), 0
            for nodes, texts in steps(iter([batch]), SHINGLE_BYTES):
                sets = [s.tobytes() for s in shingle_sets(texts, words)]
                same = [hashlib.blake2b(s, digest_size=16).digest() == keys[at + i] for i, s in enumerate(sets)]
                at += len(sets)
                yield pa.RecordBatch.from_arrays([nodes, pa.array(sets, pa.binary())], names=["node", "shingles"]).filter(
                    pa.array(same)
                )

    found = plain.join(wanted, on).select("node", "text", "key").mapInArrow(run, "node long, shingles binary")
    return found.dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 x intersection >= percent x union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(f"{s}_node"), F.col("shingles").alias(f"{s}_set")) for s in "ab")
    joined = pairs.join(left, F.col("a") == F.col("a_node")).join(right, F.col("b") == F.col("b_node"))
    return joined.select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def deltas(still: DataFrame, hubs: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """What each node of an open bucket does not have in common with the hub: of the component of that bucket's leader, the
    leader that shares most with others (of equal ones the smallest, as in a bucket).

    hub_size, size (of the sets), outside (not of the hub's component), hub, node, delta (shingles, hashed with the hub).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own, found = [], [], []
            for hub, left, right in zip(batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
                c, x = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                found.append(_mixed(np.setxor1d(c, x, assume_unique=True) + np.uint64(hub * int(_M[50]) % 2**64)).tobytes())
                sizes.append(len(c))
                own.append(len(x))
            columns = [pa.array(sizes, pa.int64()), pa.array(own, pa.int64()), *(batch.column(i) for i in range(3))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=names)

    names = ["hub_size", "size", "outside", "hub", "node", "delta"]
    # One hub per component: its first leader in the order that picks the leaders, so no other leader of the component is before it.
    led = hubs.groupBy("node").agg(F.max("weight").alias("weight"))
    led = led.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    led = led.select("node", "weight", F.coalesce("label", "node").alias("hub_label"))
    best = led.groupBy("hub_label").agg(F.min_by("node", F.struct(-F.col("weight"), "node")).alias("hub"))
    met = hubs.select("bucket", F.col("node").alias("leader")).join(
        led.select(F.col("node").alias("leader"), "hub_label"), "leader"
    )
    met = met.join(best, "hub_label").select(F.col("bucket").alias("in"), "hub", "hub_label")
    pairs = still.join(met, F.col("bucket") == F.col("in")).select("hub", "hub_label", "node", "label").distinct()
    for name in ("hub", "node"):
        own = sets.select(F.col("node").alias("has"), F.col("shingles").alias(f"{name}_set"))
        pairs = pairs.join(own, F.col(name) == F.col("has")).drop("has")
    outside = F.col("label") != F.col("hub_label")
    pairs = pairs.filter("hub <> node").select(outside.alias("outside"), "hub", "node", "hub_set", "node_set")
    return materialize(
        pairs.mapInArrow(run, "hub_size long, size long, outside boolean, hub long, node long, delta binary"), "deltas"
    )


def within_reach(delta: DataFrame, percent: int) -> DataFrame:
    """The rows of ``delta`` that may have a link left, with asks and meets: whether the node may be linked as one outside the
    hub's component, and whether such a node may be linked with it.

    Of the shingles of a delta, let u be in no other delta of that hub, and n in others. Linked x and y differ in ux + uy + |nx - ny|
    shingles at least and in f (|x| + |y|) at most, so with g = u - f |x|, gx + gy + |nx - ny| <= 0. Per hub and n only the least g
    counts, so what is searched for a partner is at most as long as a set, however many nodes there are.
    """
    f = (100 - percent) / (100 + percent)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) // 8
            found = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            owners = (pa.array(np.repeat(batch.column(i).to_numpy(), sizes)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*owners, pa.array(found)], names=["hub", "node", "item"])

    alone = delta.select("hub", "node", "delta").mapInArrow(items, "hub long, node long, item long").groupBy("item")
    alone = alone.agg(F.count("*").alias("n"), F.min("hub").alias("hub"), F.min("node").alias("node")).filter("n = 1")
    alone = alone.groupBy("hub", "node").agg(F.count("*").alias("u"))
    own = delta.select("hub", "node", "outside", "size", F.expr("octet_length(delta) div 8").alias("all")).join(alone, ["hub", "node"], "left")
    u = F.coalesce("u", F.lit(0))
    own = materialize(own.select("hub", "node", "outside", (F.col("all") - u).alias("n"), (u - F.lit(f) * F.col("size")).alias("g")), "own")
    least = own.groupBy("hub", "n").agg(F.min("g").alias("any"), F.min(F.when(F.col("outside"), F.col("g"))).alias("asker"))
    upto = Window.partitionBy("hub").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("hub").orderBy("n").rowsBetween(0, Window.unboundedFollowing)
    best = [
        F.least(F.min(F.col(c) - F.col("n")).over(upto) + F.col("n"), F.min(F.col(c) + F.col("n")).over(since) - F.col("n")).alias(c)
        for c in ("any", "asker")
    ]
    own = own.join(least.select("hub", "n", *best), ["hub", "n"])
    asks = (F.col("outside") & (F.col("g") + F.col("any") <= 1e-6)).alias("asks")
    meets = F.coalesce(F.col("g") + F.col("asker") <= 1e-6, F.lit(False)).alias("meets")
    own = own.select("hub", "node", asks, meets).filter("asks or meets")
    return materialize(delta.drop("outside").join(own, ["hub", "node"]), "reach")


def delta_buckets(delta: DataFrame, percent: int) -> DataFrame:
    """bucket, node, weight, asks, meets: buckets in which every linked pair of two components that share a hub meets, one
    that asks (outside the hub's component) with one that it meets.

    Take x, y linked and x outside the component of the hub c, with dx, dy what they do not share with c. The sets x and y differ
    in B = f (|x| + |y|) shingles at most, f = (100 - p) / (100 + p), so dx and dy have t = (|dx| + |dy| - B) / 2 in common at least.
    As x is not linked with c, |dx| > f (|x| + |c|), so t > (|dy| + f (|c| - |y|)) / 2; and as |dy| >= |dx| - B, t >= |dx| - B.
    In any one order, dx and dy then share one of the first |d| - t + 1 shingles of each, with the second bound for x, which asks, and
    the first for y, which is met. Rare ones come first (by a count of ``COUNTERS`` hashed counters); any order gives the same links.
    Nodes that ``within_reach`` leaves out are in no bucket.
    """
    delta = within_reach(delta, percent).select("hub_size", "size", "asks", "meets", "node", "delta")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                np.add.at(total, (np.frombuffer(cell.as_buffer(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    counted = delta.select("delta").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    order = np.zeros(COUNTERS, np.int64)  # a fixed size, whatever the input
    order[counted["at"].to_numpy()] = counted["n"].to_numpy()
    f = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found, asking, meeting = [], [], [], []
            columns = (batch.column(i).to_pylist() for i in range(5))
            for c, n, may_ask, may_meet, node, cell in zip(*columns, batch.column(5), strict=True):
                d = np.frombuffer(cell.as_buffer(), np.uint64)
                met = int(np.ceil((len(d) + f * (c - n)) / 2 - 1e-6))
                ask = int(np.ceil(len(d) - f * (n + 100 * n / percent) - 1e-6))
                meets, asks = (max(0, len(d) - max(1, t) + 1) for t in (met, ask))
                meets, asks = meets if may_meet else 0, asks if may_ask else 0
                most = max(meets, asks)
                first = np.lexsort((d, order[(d % np.uint64(COUNTERS)).astype(np.int64)]))
                found.append(d[first[:most]])
                nodes.append(np.full(len(found[-1]), node))
                asking.append(np.arange(len(found[-1])) < asks)
                meeting.append(np.arange(len(found[-1])) < meets)
            if nodes:
                four = [np.concatenate(x) for x in (found, nodes, asking, meeting)]
                four[0] = four[0].view(np.int64)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, four)), names=["bucket", "node", "asks", "meets"])

    return shared_buckets(delta.mapInArrow(run, "bucket long, node long, asks boolean, meets boolean"))


def shared_buckets(members: DataFrame) -> DataFrame:
    """Of (bucket, node, asks, meets) the rows whose bucket has one that asks and others that are met, with the weight of
    the node: how much it shares with others."""
    members = materialize(members, "bucketed")
    shared = members.groupBy(F.col("bucket").alias("at")).agg(F.count("*").alias("n"), F.max("asks").alias("asked"))
    shared = shared.filter("n > 1 and asked").drop("asked")
    members = materialize(members.join(shared, F.col("bucket") == F.col("at")).drop("at"), "members")
    # The middle of a group of near copies agrees with most of them: it should lead.
    weight = members.groupBy(F.col("node").alias("of")).agg(F.sum("n").alias("weight"))
    members = members.join(weight, F.col("node") == F.col("of")).select("bucket", "node", "weight", "asks", "meets")
    return materialize(members, "weighed")


class Comparison:
    """Rounds of comparing the members of buckets that ask with those they meet, until all are compared or connected."""

    def __init__(self, facts: DataFrame, sets: DataFrame, percent: int, miss: float):
        self.facts, self.sets, self.percent, self.miss = facts, sets, percent, miss
        self.links = facts.sparkSession.createDataFrame([], "a long, b long")
        self.labels = facts.sparkSession.createDataFrame([], "node long, label long")

    def open(self, members: DataFrame) -> DataFrame:
        """The rows of buckets where a row that asks has yet to meet one of another component; ``open`` marks such askers."""
        of = self.labels.select(F.col("node").alias("of"), "label")
        now = members.join(of, F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("label", "node")).drop("of")
        ends = now.filter("meets").groupBy(F.col("bucket").alias("in"))
        ends = ends.agg(F.min("label").alias("low"), F.max("label").alias("high"))
        now = now.join(ends, F.col("bucket") == F.col("in")).drop("in")
        now = now.withColumn("open", F.expr("asks and (label <> low or label <> high)"))
        asked = now.groupBy(F.col("bucket").alias("in")).agg(F.max("open").alias("any")).filter("any")
        now = now.join(asked.drop("any"), F.col("bucket") == F.col("in"))
        return materialize(now.drop("in", "low", "high"), "open")

    def one_round(self, now: DataFrame, leaders: int) -> DataFrame:
        """Compare ``leaders`` of the open askers of each bucket with all that they meet; they are returned."""
        first = Window.partitionBy("bucket").orderBy(F.desc("weight"), "node")
        lead = now.filter("open").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= leaders)
        lead = materialize(lead.select("bucket", "node", "label", "weight"), "leaders")
        ask = lead.select(F.col("bucket").alias("in"), F.col("node").alias("a"), F.col("label").alias("of"))
        pairs = now.filter("meets").join(ask, (F.col("bucket") == F.col("in")) & (F.col("label") != F.col("of")))
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        alive = survivors(pairs, self.facts, self.percent / 100, self.miss)
        found = materialize(confirmed(alive, self.sets, self.percent), "confirmed")
        if not found.isEmpty():
            self.links = self.links.unionByName(found)
            self.labels = materialize(components(self.links), "labels")
        return lead

    def settle(self, members: DataFrame) -> None:
        leaders = 1
        while not (now := self.open(members)).isEmpty():
            lead = self.one_round(now, leaders).select(F.col("bucket").alias("in"), F.col("node").alias("done"))
            was = (F.col("bucket") == F.col("in")) & (F.col("node") == F.col("done"))
            members = now.join(lead, was, "left").withColumn("asks", F.col("asks") & F.col("done").isNull())
            members = members.select("bucket", "node", "weight", "asks", "meets")
            leaders *= LEADERS


def near_groups(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
    miss: float = MISS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, tag."""
    with small_batches(docs.sparkSession):  # all that runs Python is written in there
        return _near_groups(docs, words, percent, id_column, text_column, miss)


def _near_groups(docs: DataFrame, words: int, percent: int, id_column: str, text_column: str, miss: float) -> DataFrame:
    known = materialize(sketches(docs, id_column, text_column, words), "sketches")
    classes = known.filter("n_shingles > 0").groupBy("key").agg(F.min("row").alias("node"))
    classes = materialize(classes, "classes")
    nodes = known.join(classes.select("node"), known["row"] == classes["node"])
    both = F.lit(True).alias("asks"), F.lit(True).alias("meets")
    members = shared_buckets(nodes.select("node", F.explode("bands").alias("bucket"), *both))
    # Only nodes that share a bucket are looked at again: their facts and full sets are written once.
    met = members.select(F.col("node").alias("row")).distinct()
    facts = known.join(met, "row").select(F.col("row").alias("node"), "doc_id", "tag", "key", "n_shingles", "signature")
    facts = materialize(facts, "facts")
    sets = materialize(full_sets(docs, facts, id_column, text_column, words), "sets")
    compare = Comparison(facts, sets, percent, miss)
    hubs = compare.one_round(members.withColumns({"label": F.col("node"), "open": F.lit(True)}), 1)
    rest = members.join(hubs.select("bucket", "node"), ["bucket", "node"], "left_anti")
    still = compare.open(materialize(rest, "rest"))  # read three times
    if not still.isEmpty():
        # Buckets that hold several components: what their nodes do not share with the leader decides.
        compare.settle(delta_buckets(deltas(still, hubs, compare.labels, sets), percent))
    rows = known.select("row", "doc_id", "tag", "n_shingles", "key")
    rows = rows.join(classes, "key", "left")  # documents without shingles have no class
    of = compare.labels.select(F.col("node").alias("labelled"), "label")
    rows = rows.join(of, F.col("node") == F.col("labelled"), "left")
    rows = rows.select("row", "doc_id", "tag", "n_shingles", F.coalesce("label", "node").alias("group"))
    rows = materialize(rows, "grouped")
    heads = rows.filter("group is not null").groupBy(F.col("group").alias("of")).agg(
        F.count("*").alias("size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head")
    )
    heads = materialize(heads.filter("size > 1"), "heads")
    alone = F.col("of").isNull()
    return rows.join(heads, F.col("group") == F.col("of"), "left").select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (alone | (F.col("head.row") == F.col("row"))).alias("kept"),
        "tag",
    )


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns and one document of each group of near duplicates."""
    flags = materialize(near_groups(docs, id_column=id_column, text_column=text_column, **options), "near")
    return kept_rows(docs, id_column, F.xxhash64(F.coalesce(docs[text_column], F.lit(""))), flags)
