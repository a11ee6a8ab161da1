"""Removal of byte strings that occur before, by sorting sampled suffixes.

A string of ``LENGTH`` bytes is removed where it also starts earlier, in a smaller document or in the same one. All suffixes of a
corpus need not be sorted for that. A content-defined difference cover samples positions (anchors): in every window of
``LENGTH`` bytes the place of its smallest ``GRAM``-byte string. Equal windows have their anchor at the same place, so two suffixes
are only ever compared from anchors on, as with the residues of a fixed difference cover. An anchor owns the windows that chose it
(a contiguous run of starts); together they are one string around the anchor, and its name is a hash.

1. Sampled suffixes are sorted by (gram, name, document, place). Of one name, all but the first are covered with all their windows: no
   byte of them moves again.
2. Where anchors of one gram have several names, the first suffix of each name is compared byte by byte: the windows it
   owns (the suffixes that were not sampled) are merged into one order by their strings, neighbours are compared, and of equal ones
   all but the first are covered. Where one gram has more than ``HOT_NAMES`` names, which grow with the corpus, its windows are dealt
   one by one instead, by gram and a hash of the window, and all but the first of a kind are covered.
3. Covered windows are joined to runs per document and cut out of the text.

Defined cases: NULL text is the empty text; a text shorter than ``LENGTH`` bytes loses nothing; matches never cross documents; a NULL id comes
before all others; rows that repeat an id are ordered by their text; an empty table gives an empty result; other columns are not read.
A worker hashes ``STEP_BYTES`` of text at a time, also of one long text, and compares ``HELD_BYTES`` of suffixes and what is left of one gram.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.packing import steps
from cohortspark.llm.rows import written
from cohortspark.session import materialize, small_batches

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1  # gram starts in a window
#: Bytes of text that are hashed at a time (hashes and places take 64 times as much), bytes of suffixes that a worker gathers
#: before it compares them, and suffixes whose windows are hashed at a time.
STEP_BYTES, HELD_BYTES, BLOCK = 1 << 19, 1 << 20, 2048
#: Names of one gram that are compared in one task (1500 bytes each at most).
HOT_NAMES = 50_000

_draw = np.random.default_rng(417)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any range of a text, modulo 2^64."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        powers = np.full(n + 1, _BASE)
        powers[0] = 1
        inverse = np.full(n + 1, _INVERSE)
        inverse[0] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[text] * np.cumprod(powers)[:n], out=self.sums[1:])
        self.inverse = np.cumprod(inverse)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, gram, name, place, ahead, behind of the anchors of documents laid end to end.

    The anchor at ``place`` owns the windows that start from ``ahead`` to ``behind`` bytes before it.
    """
    none = np.empty(0, np.int64)
    if len(text) < LENGTH:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    rolling = Rolling(text)
    at = np.arange(len(text) - GRAM + 1)
    grams = rolling(at, at + GRAM)
    bits = max(1, int(len(text)).bit_length())
    packed = (grams >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    chosen = (_least(packed, SPAN) & np.uint64((1 << bits) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(starts, ends, strict=True) if b - a >= LENGTH] or [none])
    if not len(valid):
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    chosen = chosen[valid]
    new = np.concatenate([[True], chosen[1:] != chosen[:-1]])
    first = valid[new]
    last = valid[np.concatenate([new[1:], [True]])]
    place = chosen[new]
    document = np.searchsorted(ends, place, "right")
    names = _mixed(rolling(first, last + LENGTH) + (place - first).astype(np.uint64) * _BASE)
    return document, grams[place], names, place - starts[document], place - first, place - last


def anchors_by_piece(text: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same as ``anchors``; a document of more than ``size`` bytes, which then is the only one, comes in pieces of as many."""
    size = max(size, 4 * LENGTH)
    if len(ends) > 1 or len(text) <= size:
        yield anchors(text, ends)
        return
    start = 0
    while start + size < len(text):
        document, gram, name, place, ahead, behind = anchors(text[start : start + size], np.array([size]))
        # The last anchor may own windows beyond the piece, so the next piece begins with its first one.
        yield document[:-1], gram[:-1], name[:-1], start + place[:-1], ahead[:-1], behind[:-1]
        start += int(place[-1] - ahead[-1])
    document, gram, name, place, ahead, behind = anchors(text[start:], np.array([len(text) - start]))
    yield document, gram, name, start + place, ahead, behind


def _texts(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, pa.Array]]:
    """Row number of the first text and the texts, a bounded number of bytes at a time."""
    pair = pa.RecordBatch.from_arrays([batch.column(column), batch.column(column)], names=["a", "text"])
    row = 0
    for _, texts in steps(iter([pair]), size):
        yield row, texts
        row += len(texts)


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    cells = [b"" if x is None else x for x in texts.cast(pa.large_binary()).to_pylist()]
    return np.frombuffer(b"".join(cells), np.uint8), np.cumsum(np.fromiter(map(len, cells), np.int64, len(cells)))


def sampled(docs: DataFrame) -> DataFrame:
    """gram, name, doc, place, ahead, behind of every anchor; ``docs`` has doc and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, texts in _texts(batch, 1, STEP_BYTES):
                for document, gram, name, place, ahead, behind in anchors_by_piece(*_joined(texts), STEP_BYTES):
                    columns = [gram.view(np.int64), name.view(np.int64), ids[row + document]]
                    columns += [place.astype(np.int32), ahead.astype(np.int8), behind.astype(np.int8)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)
        pa.default_memory_pool().release_unused()  # the worker may serve other steps next

    names = ["gram", "name", "doc", "place", "ahead", "behind"]
    return docs.select("doc", "text").mapInArrow(
        run, "gram long, name long, doc long, place int, ahead byte, behind byte"
    )


def window_keys(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of every window of suffixes of ``size`` bytes laid end to end, from the one farthest ahead of the anchor on."""
    keys = []
    for at in range(0, len(size), BLOCK):
        own = size[at : at + BLOCK]
        count, first = own - LENGTH + 1, np.cumsum(own) - own
        start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        keys.append(Rolling(text[: own.sum()])(start, start + LENGTH))
        text = text[own.sum() :]
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


SUFFIX = "gram long, key long, doc long, place int, ahead byte, behind byte, bytes binary"


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``wanted`` suffixes (doc and a list ``asked`` of gram, place, ahead, behind, hot) with the bytes of their windows.

    A hot suffix gives a row for each window, with the window's hash as ``key`` and no bytes; others have no key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column(0).to_numpy(), batch.column(2)
            for row, texts in _texts(batch, 1, STEP_BYTES):
                text, ends = _joined(texts)
                own = asked.slice(row, len(texts))
                flat = own.flatten()
                count = np.diff(own.offsets.to_numpy())
                doc, shift = (np.repeat(x, count) for x in (ids[row : row + len(texts)], np.concatenate([[0], ends[:-1]])))
                fields = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(5)]
                raw = text.tobytes()
                for at in range(0, len(flat), BLOCK):
                    yield from cut(raw, shift[at : at + BLOCK], doc[at : at + BLOCK], *(x[at : at + BLOCK] for x in fields))
        pa.default_memory_pool().release_unused()

    def cut(raw: bytes, shift: np.ndarray, doc: np.ndarray, *fields: np.ndarray) -> Iterator[pa.RecordBatch]:
        gram, place, ahead, behind, hot = fields
        left, right = shift + place - ahead, shift + place - behind + LENGTH
        some = np.flatnonzero(~hot)
        cells = [raw[a:b] for a, b in zip(left[some].tolist(), right[some].tolist(), strict=True)]
        columns = [gram[some], pa.nulls(len(some), pa.int64()), *(x[some] for x in (doc, place, ahead, behind))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(cells, pa.binary())], names=names)
        some = np.flatnonzero(hot)
        if len(some):
            cells = b"".join(raw[a:b] for a, b in zip(left[some].tolist(), right[some].tolist(), strict=True))
            keys = window_keys(np.frombuffer(cells, np.uint8), right[some] - left[some])
            of = np.repeat(some, ahead[some].astype(np.int64) - behind[some] + 1)
            d = (ahead[of] - (np.arange(len(of)) - np.searchsorted(of, of))).astype(np.int8)
            columns = [gram[of], keys.view(np.int64), doc[of], place[of], d, d, pa.nulls(len(of), pa.binary())]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)

    names = [x.split()[0] for x in SUFFIX.split(", ")]
    joined = docs.join(wanted.withColumnRenamed("doc", "of"), F.col("doc") == F.col("of"))
    return joined.select("doc", "text", "asked").mapInArrow(run, SUFFIX)


def _laid_out(cells: pa.ChunkedArray) -> np.ndarray:
    """The bytes of binary cells end to end."""
    parts = [np.empty(0, np.uint8)]
    for chunk in cells.cast(pa.binary()).chunks:
        if len(chunk):
            _, ends, raw = chunk.buffers()
            ends = np.frombuffer(ends, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts)


def merged(suffixes: pa.Table) -> tuple[np.ndarray, ...]:
    """doc, start, end of what is covered among suffixes that hold whole grams: windows are sorted, neighbours compared."""
    n = len(suffixes)
    gram, doc, place = (suffixes[c].to_numpy() for c in ("gram", "doc", "place"))
    ahead, behind = (suffixes[c].to_numpy().astype(np.int64) for c in ("ahead", "behind"))
    text = _laid_out(suffixes["bytes"])
    size = ahead - behind + LENGTH
    first = np.cumsum(size) - size
    keys = window_keys(text, size)
    first_key = first - np.arange(n) * (LENGTH - 1)
    # Suffixes in order of where they stand, so that the first of equal windows is the earliest.
    rank = np.empty(n, np.int64)
    rank[np.lexsort((place, doc))] = np.arange(n)
    far, near = np.full(n, -1), np.full(n, LENGTH)
    for d in range(SPAN):
        own = np.flatnonzero((ahead >= d) & (behind <= d))
        if len(own) < 2:
            continue
        start, key = first[own] + ahead[own] - d, keys[first_key[own] + ahead[own] - d]
        order = np.lexsort((rank[own], key, gram[own]))
        own, start, key = own[order], start[order], key[order]
        like = np.flatnonzero((key[1:] == key[:-1]) & (gram[own[1:]] == gram[own[:-1]]))
        if not len(like):
            continue
        within = np.arange(LENGTH)
        for part in np.array_split(like, -(-len(like) // BLOCK)):
            same = (text[start[part][:, None] + within] == text[start[part + 1][:, None] + within]).all(axis=1)
            later = own[part[same] + 1]
            far[later] = np.maximum(far[later], d)
            near[later] = np.minimum(near[later], d)
    hit = np.flatnonzero(far >= 0)
    return doc[hit], place[hit] - far[hit], place[hit] - near[hit] + LENGTH


def covered_in_order(batches: Iterator[pa.RecordBatch], held_bytes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """doc, start, end of what is covered among suffixes in order of key, gram, document and place; those without a key come first."""
    held, heavy, before = [], 0, (None, None)
    for batch in batches:
        plain = batch.slice(0, batch.column(1).null_count)
        if len(plain):
            gram = plain.column(0).to_numpy()
            at = int(np.searchsorted(gram, gram[-1]))  # where the last gram begins
            if heavy >= held_bytes and (at or gram[0] != held[-1].column(0)[-1].as_py()):
                yield merged(pa.Table.from_batches([*held, plain.slice(0, at)]))
                held, heavy, plain = [], 0, plain.slice(at)
            held.append(plain)
            heavy += plain.nbytes
        hot = batch.slice(batch.column(1).null_count)
        if len(hot):
            gram, key, doc, place, d = (hot.column(i).to_numpy() for i in range(5))
            same = np.concatenate([[(gram[0], key[0]) == before], (gram[1:] == gram[:-1]) & (key[1:] == key[:-1])])
            before = gram[-1], key[-1]
            start = place[same] - d[same]
            yield doc[same], start, start + LENGTH
    if held:
        yield merged(pa.Table.from_batches(held))


def covered_by_merge(suffixes: DataFrame) -> DataFrame:
    """doc, start, end; the suffixes of a gram, or the windows of a key, meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, start, end in covered_in_order(batches, HELD_BYTES):
            columns = [doc.astype(np.int64), start.astype(np.int32), end.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["doc", "start", "end"])
        pa.default_memory_pool().release_unused()

    dealt = suffixes.repartition("gram", "key").sortWithinPartitions("key", "gram", "doc", "place")
    return dealt.mapInArrow(run, "doc long, start int, end int")


def numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text and a bigint doc, unique and in the order of the documents."""
    plain = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    whole = plain.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole and plain.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return plain.withColumn("doc", F.col("doc_id").cast("long"))
    # Ids that are no numbers of their own: number the rows along their order.
    ordered = plain.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return materialize(ordered.withColumn("doc", F.monotonically_increasing_id()), "numbered")


def _free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished steps stay on the executors' disks until the driver drops their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame) -> DataFrame:
    """doc, spans: the covered byte ranges (start, end) of ``docs`` (doc, text), not yet joined to runs."""
    spark = docs.sparkSession
    same_gram = Window.partitionBy("gram")
    in_order = Window.partitionBy("gram", "name").orderBy("doc", "place")
    ranked = (
        sampled(docs)
        .repartition("gram")
        .withColumn("place_in_name", F.row_number().over(in_order))
        .withColumn("names", F.count(F.when(F.col("place_in_name") == 1, 1)).over(same_gram))
        .filter("place_in_name > 1 OR names > 1")
    )
    state = [(F.col("place_in_name") > 1).alias("covered"), (F.col("names") > HOT_NAMES).alias("hot")]
    with small_batches(spark):  # holds for what is written in there
        ranked = written(ranked.select("gram", "doc", "place", "ahead", "behind", *state), "ranked")
    _free_shuffles(spark)
    whole = ranked.filter("covered").select(
        "doc",
        (F.col("place") - F.col("ahead")).alias("start"),
        (F.col("place") - F.col("behind") + LENGTH).alias("end"),
    )
    wanted = (
        ranked.filter("not covered")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("gram", "place", "ahead", "behind", "hot")).alias("asked"))
    )
    with small_batches(spark):
        partly = written(covered_by_merge(contexts(docs, wanted)), "partly")
    _free_shuffles(spark)
    return whole.unionByName(partly).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that are left) of every document."""
    plain = numbered(docs, id_column, text_column)
    found = repeats(plain.select("doc", "text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _texts(batch, 1, STEP_BYTES):
                yield cut(batch.column(0).slice(row, len(texts)), texts, batch.column(2).slice(row, len(texts)))
        pa.default_memory_pool().release_unused()

    def cut(ids: pa.Array, texts: pa.Array, found: pa.Array) -> pa.RecordBatch:
        sizes, removed, runs, kept = [], [], [], []
        for text, spans in zip(texts, found, strict=True):
            raw = text.as_py().encode() if text.is_valid else b""
            gone, count, parts, end = 0, 0, [], 0
            if spans.is_valid:
                flat = spans.values
                start, stop = (flat.field(i).to_numpy() for i in range(2))
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(stop[order])
                head = np.concatenate([[True], start[1:] > stop[:-1]])
                for a, b in zip(start[head].tolist(), stop[np.concatenate([head[1:], [True]])].tolist(), strict=True):
                    parts.append(raw[end:a])
                    gone, count, end = gone + b - a, count + 1, b
            parts.append(raw[end:])
            sizes.append(len(raw))
            removed.append(gone)
            runs.append(count)
            kept.append(b"".join(parts))
        numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
        return pa.RecordBatch.from_arrays(
            [ids, *numbers, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )

    joined = plain.join(found.withColumnRenamed("doc", "of"), F.col("doc") == F.col("of"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
