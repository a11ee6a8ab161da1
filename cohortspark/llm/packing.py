"""Token sequences of equal attention cost.

Tokens of a piece of n tokens cost n + quadratic x n^2 (attention does not cross pieces). Documents are packed in blocks of about
``block_tokens`` tokens, each block inside the task that read its documents, so nothing is shuffled. A block of T tokens
gets T // L sequences of L tokens; what is left over gets one sequence for each power of two in its binary form, so
no sequence needs padding. Documents go in descending order to the sequence of the lowest cost that has room; those that
find room nowhere whole are cut into the remaining gaps, cheapest sequence first.

Defined cases: NULL text is the empty text, whose only token is the end token; a document longer than a sequence gives whole
sequences and a rest; equal documents are packed one by one; NULL ids pass through; an empty table gives no pieces.
Columns other than id and text are not read. A retried task packs the same rows again, so its result is the same.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE_TOKENS = 2048
BLOCK_TOKENS = 1 << 20
#: Share of the quadratic term: attention against the linear layers of a model of width 1024.
QUADRATIC = 1 / 6144
END_ID = 1
#: Bytes of text that are tokenized at a time, and words that a worker remembers.
STEP_BYTES, KNOWN_WORDS = 8 << 20, 600_000
#: What ``pack`` takes of that: places and ids take about fifteen times as much.
PACK_BYTES = 2 << 20


class WordTokens:
    """Ids of words between white space; the tokenizer treats each such word by itself.

    Every distinct word of a step is encoded once, and remembered for later steps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: pa.Array) -> None:
        if len(self.words) > KNOWN_WORDS:
            self.forget()
        new = words.filter(pc.invert(pc.is_in(words, value_set=self.words)))
        if not len(new):
            return
        found = [e.ids for e in self.tokenizer.encode_batch_fast(new.to_pylist(), add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate([self.ids, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the end of each text in them."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        self.learn(coded.dictionary)
        at = pc.index_in(coded.dictionary, value_set=self.words).to_numpy()[coded.indices.to_numpy()]
        lengths = np.diff(self.ends)[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.ids[np.repeat(self.ends[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        return flat, ends[split.offsets.to_numpy()[1:]]


_known: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's own; a later task of the same worker finds its words."""
    if path not in _known:
        _known[path] = WordTokens(path)
    return _known[path]


def steps(batches: Iterator[pa.RecordBatch], step_bytes: int | None = None) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts, a bounded number of bytes at a time (or one longer text); ``STEP_BYTES`` unless said otherwise.

    Texts own their bytes: some kernels misread arrays that begin inside a buffer.
    """
    step_bytes = step_bytes or STEP_BYTES
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + step_bytes, "right")))
            yield ids.slice(start, stop - start), pa.concat_arrays([texts.slice(start, stop - start)])
            start = stop


def pack_block(
    lengths: np.ndarray, sequence_tokens: int = SEQUENCE_TOKENS, quadratic: float = QUADRATIC
) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, np.ndarray]:
    """Pieces (document, start, length, sequence, offset), then the size and the cost of each sequence."""
    total = int(lengths.sum())
    sizes = [sequence_tokens] * (total // sequence_tokens)
    sizes += [1 << b for b in range(sequence_tokens.bit_length(), -1, -1) if (total % sequence_tokens) >> b & 1]
    sizes = np.array(sizes, np.int64)
    used, cost = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
    pieces, cut = [], []

    def put(doc: int, start: int, n: int, to: int) -> None:
        pieces.append((doc, start, n, to, int(used[to])))
        used[to] += n
        cost[to] += n + quadratic * n * n

    whole, rest = np.divmod(lengths, sequence_tokens)
    to = 0
    for doc in np.flatnonzero(whole):
        for k in range(whole[doc]):
            put(int(doc), k * sequence_tokens, sequence_tokens, to)
            to += 1
    for doc in np.lexsort((np.arange(len(rest)), -rest)):
        n = int(rest[doc])
        if n:
            room = np.where(sizes - used >= n, cost, np.inf)
            best = int(room.argmin()) if len(room) else -1
            if best >= 0 and room[best] < np.inf:
                put(int(doc), int(lengths[doc]) - n, n, best)
            else:
                cut.append((int(doc), int(lengths[doc]) - n, n))
    gaps = iter(sorted(np.flatnonzero(sizes > used), key=lambda s: (cost[s], s)))
    gap = next(gaps, None)
    for doc, start, n in cut:
        while n:
            m = min(n, int(sizes[gap] - used[gap]))
            put(doc, start, m, int(gap))
            start, n = start + m, n - m
            if used[gap] == sizes[gap]:
                gap = next(gaps, None)
    return pieces, sizes, cost


PIECES = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, "
    "sequence_cost double"
)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    quadratic: float = QUADRATIC,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id and ``PIECES``; ``ids`` are little-endian unsigned 32-bit numbers.

    ``sequence_id`` is the reading task's number times 2^32 plus the sequence's number in the task.
    """
    if sequence_tokens & (sequence_tokens - 1):
        raise ValueError("sequence_tokens must be a power of two")
    plain = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()

    def packed(ids: list[pa.Array], tokens: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        pieces, sizes, cost = pack_block(lengths, sequence_tokens, quadratic)
        doc, start, length, to, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        cells = [tokens[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces]
        columns = [start, length, pa.array(cells, pa.binary()), lengths[doc], first + to, offset, sizes[to], cost[to]]
        names = ["doc_id", *(x.split()[0] for x in PIECES.split(", "))]
        keys = pa.concat_arrays(ids).take(pa.array(doc))
        return pa.RecordBatch.from_arrays([keys, *map(pa.array, columns)], names=names), first + len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(tokenizer_path)
        first = TaskContext.get().partitionId() << 32
        ids, tokens, held = [], [], 0
        for keys, texts in steps(batches, PACK_BYTES):
            flat, ends = encode(texts)
            start = 0
            for i, stop in enumerate(ends):
                ids.append(keys.slice(i, 1))
                tokens.append(np.append(flat[start:stop], np.uint32(end_id)))
                start, held = stop, held + len(tokens[-1])
                if held >= block_tokens:
                    batch, first = packed(ids, tokens, first)
                    yield batch
                    ids, tokens, held = [], [], 0
        if tokens:
            yield packed(ids, tokens, first)[0]
        pa.default_memory_pool().release_unused()  # the worker may serve other steps next

    return plain.mapInArrow(run, f"doc_id {id_type}, {PIECES}")


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_tokens",
        "sequence_cost",
    )
