"""Language of each word by a linear-chain conditional random field, and of a text by its words.

A word's features are its affixes (one to three letters at either end), its inner n-grams of two to four bytes, and itself if it
is in the lexicon of words that the labelled sample repeats. Weights of affixes and n-grams live in a table of fixed size; moves
between languages have weights too. Forward-backward gives each word's posterior, a text's language is the one
with the largest sum over its words, and the score is that sum's share. How sure the words are, whatever their languages, is the mean
of each word's largest posterior.

The field is fitted by gradient steps on a bounded sample: at most ``SAMPLE_TEXTS`` labelled texts per language. Half of the training sequences are
pieces of different texts put together, so that moves inside a text are learned. Whole texts are labelled, in their tasks;
only the fitted weights are sent there.

Defined cases: a NULL text, or one without a letter, is ``und`` with score 0; words without letters take part in no vote; NULL
labels are not learned; without any label every text is ``und``; equal sums go to the first language by name; repeated rows and NULL
ids are rows like others; an empty table gives an empty result. The columns ``lang_pred`` and ``lang_score`` (and ``lang_runs``, ``lang_sure``)
replace input columns of those names; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.chains import in_batches, recursions
from cohortspark.llm.packing import steps

SAMPLE_TEXTS = 80
BUCKETS = 1 << 16
#: A sampled word is in the lexicon from so many texts on.
LEXICON_TEXTS = 3
PIECE_WORDS, SEQUENCE_WORDS = 16, 64
STEPS, RATE, SHRINK = 40, 0.1, 1e-4
#: Bytes of text that are labelled at a time: features and posteriors take about fifty times as much.
LABEL_BYTES = 1 << 20
#: What is trimmed from the ends of a word: ASCII punctuation and digits.
TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"

_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trimmed lower-case words, whether each has a letter, the word at each place, the end of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    raw = split.flatten().dictionary_encode()
    word = pc.utf8_trim(pc.utf8_lower(raw.dictionary), characters=TRIM).dictionary_encode()
    letter = pc.match_substring_regex(word.dictionary, r"\p{L}").to_numpy(zero_copy_only=False)
    at = word.indices.to_numpy()[raw.indices.to_numpy()] if len(raw) else np.empty(0, np.int64)
    return word.dictionary, letter, at, split.offsets.to_numpy()


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every affix and n-gram of every word."""
    data = words.cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(data).to_numpy().astype(np.int64))
    size = np.diff(np.concatenate([[0], ends]))
    text = np.frombuffer(b"".join(data.to_pylist()), np.uint8).astype(np.uint64) + np.uint64(1)
    owner, first = np.repeat(np.arange(len(words)), size), ends - size
    found = []

    def add(word: np.ndarray, hashed: np.ndarray, kind: int) -> None:
        mixed = (hashed ^ (hashed >> np.uint64(29))) * _P[kind % 4] + np.uint64(kind)
        found.append((word, ((mixed >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64)))

    for n in (1, 2, 3, 4):
        rolled = np.zeros(max(0, len(text) - n + 1), np.uint64)
        for i in range(n if len(rolled) else 0):
            rolled = rolled * _P[1] + text[i : i + len(rolled)]
        if n > 1:
            inside = np.flatnonzero(owner[: len(rolled)] == owner[n - 1 :]) if len(rolled) else np.empty(0, np.int64)
            add(owner[inside], rolled[inside], n)
        if n < 4:
            long = np.flatnonzero(size >= n)
            add(long, rolled[first[long]], 10 + n)
            add(long, rolled[ends[long] - n], 20 + n)
    return np.concatenate([w for w, _ in found]), np.concatenate([b for _, b in found])


@dataclass(frozen=True)
class Field:
    languages: tuple[str, ...]
    start: np.ndarray  # languages
    move: np.ndarray  # languages x languages
    buckets: np.ndarray  # BUCKETS x languages
    lexicon: tuple[str, ...]
    entries: np.ndarray  # lexicon x languages

    def weights(self, words: pa.Array, letter: np.ndarray) -> np.ndarray:
        """Positive weight of each language for each word; words without letters weigh the same everywhere."""
        score = np.zeros((len(words), len(self.languages)))
        with_letter = np.flatnonzero(letter)
        if len(with_letter):
            some = words.take(pa.array(with_letter))
            owner, bucket = features(some)
            gathered = self.buckets[bucket]
            for y in range(len(self.languages)):
                score[with_letter, y] = np.bincount(owner, weights=gathered[:, y], minlength=len(some))
            known = pc.index_in(some, value_set=pa.array(self.lexicon, pa.large_string()))
            hit = pc.is_valid(known).to_numpy(zero_copy_only=False)
            score[with_letter[hit]] += self.entries[known.filter(pa.array(hit)).to_numpy().astype(np.int64)]
        score -= score.max(axis=1, keepdims=True)
        return np.exp(np.maximum(score, -60.0))


def fit(texts: list[str], labels: list[str], seed: int = 11) -> Field:
    """The field from labelled texts, all of them in memory."""
    languages = tuple(sorted(set(labels)))
    draw, n = np.random.default_rng(seed), len(set(labels))
    words, letter, at, ends = words_in(pa.array(texts, pa.large_string()))
    label = np.array([languages.index(x) for x in labels])
    own = [at[a:b][letter[at[a:b]]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    texts_with = np.bincount(np.concatenate([np.unique(x) for x in own]).astype(np.int64), minlength=len(words))
    in_lexicon = np.flatnonzero(texts_with >= LEXICON_TEXTS)
    # Half of the pieces stay in the order of their text, half are put together across texts.
    pieces = [
        (x[i : i + PIECE_WORDS], label[k]) for k, x in enumerate(own) for i in range(0, len(x), PIECE_WORDS)
    ]
    mixed = [pieces[i] for i in draw.permutation(len(pieces))[: len(pieces) // 2]]
    flat = np.concatenate([p for p, _ in pieces + mixed]).astype(np.int64)
    truth = np.concatenate([np.full(len(p), y) for p, y in pieces + mixed])
    lengths = []
    for total in (sum(len(p) for p, _ in pieces), sum(len(p) for p, _ in mixed)):
        lengths += [min(SEQUENCE_WORDS, total - i) for i in range(0, total, SEQUENCE_WORDS)]
    lengths = np.array(lengths)
    starts = np.cumsum(lengths) - lengths
    owner, bucket = features(words)
    slot = np.full(len(words), -1)
    slot[in_lexicon] = np.arange(len(in_lexicon))
    head = np.zeros(len(flat), bool)
    head[starts] = True
    pairs = np.flatnonzero(~head)
    told_moves = np.bincount(truth[pairs - 1] * n + truth[pairs], minlength=n * n).reshape(n, n)
    told_start = np.bincount(truth[starts], minlength=n)
    told = np.stack([np.bincount(flat[truth == y], minlength=len(words)) for y in range(n)], axis=1)
    shapes = [(n,), (n, n), (BUCKETS, n), (len(in_lexicon), n)]
    weights = [np.zeros(s) for s in shapes]
    mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, STEPS + 1):
        score = np.stack(
            [np.bincount(owner, weights=weights[2][bucket, y], minlength=len(words)) for y in range(n)], axis=1
        )
        score[in_lexicon] += weights[3]
        table = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -60.0))
        rest, moves, begin = told.astype(float), told_moves.astype(float), told_start.astype(float)
        for some in in_batches(lengths):
            done = recursions(
                np.exp(weights[0]), np.exp(weights[1]), table, flat, starts[some], lengths[some], backward=True
            )
            for y in range(n):
                rest[:, y] -= np.bincount(done.seen, weights=done.gamma[:, y], minlength=len(words))
            moves -= done.moves
            begin -= done.gamma[: done.first].sum(axis=0)
        by_bucket = np.stack([np.bincount(bucket, weights=rest[owner, y], minlength=BUCKETS) for y in range(n)], axis=1)
        slopes = [begin, moves, by_bucket, rest[in_lexicon]]
        for i, slope in enumerate(slopes):
            slope = slope / len(flat) - SHRINK * weights[i]
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope * slope
            weights[i] += RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    lexicon = tuple(words.take(pa.array(in_lexicon)).to_pylist())
    return Field(languages, np.exp(weights[0]), np.exp(weights[1]), weights[2], lexicon, weights[3])


def fitted(
    docs: DataFrame,
    learn: Column,
    text_column: str = "text",
    label_column: str = "lang",
    id_column: str = "doc_id",
    sample_texts: int = SAMPLE_TEXTS,
) -> Field | None:
    """The field from a sample of the labelled rows for which ``learn`` holds: ``sample_texts`` of each language at most."""
    labelled = docs.filter(learn).select(
        docs[id_column].alias("id"), docs[text_column].alias("text"), docs[label_column].cast("string").alias("label")
    )
    labelled = labelled.filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    chosen = labelled.select("label", "id", F.xxhash64("text").alias("tag"), F.row_number().over(first).alias("n"))
    chosen = chosen.filter(F.col("n") <= sample_texts).collect()
    if not chosen:
        return None
    keys = docs.sparkSession.createDataFrame([(r["id"], r["tag"]) for r in chosen], labelled.select("id", F.lit(1).cast("long").alias("tag")).schema)
    keys = F.broadcast(keys.distinct())  # ``sample_texts`` per language
    rows = labelled.withColumn("tag", F.xxhash64("text")).join(keys, ["id", "tag"], "left_semi")
    rows = sorted(rows.select("label", "text").distinct().collect())
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


RUNS = T.ArrayType(
    T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("lang", T.StringType())])
)


def labelled(docs: DataFrame, field: Field | None, text_column: str = "text", runs: bool = False, sure: bool = False) -> DataFrame:
    """``docs`` with lang_pred and lang_score, with ``sure`` also lang_sure (the mean of the words' largest posteriors, 0 without
    words), and with ``runs`` also lang_runs: words (from 0, between white space) first to last
    of the text that are most probably of one language; words without letters join the run around them."""
    added = ["lang_pred", "lang_score"] + ["lang_runs"] * runs + ["lang_sure"] * sure
    kept = [c for c in docs.columns if c not in added]
    # Arrow functions take columns by name: give them plain ones on the way.
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    carried = text_column in kept and docs.schema[text_column].dataType == T.StringType()
    at = kept.index(text_column) if carried else len(kept)  # the text travels once
    plain = docs.select(*own, *([] if carried else [docs[text_column].cast("string").alias("text")]))
    schema = T.StructType(
        [
            *plain.schema.fields[: len(kept)],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("lang_score", T.DoubleType()),
            *([T.StructField("lang_runs", RUNS)] if runs else []),
            *([T.StructField("lang_sure", T.DoubleType())] if sure else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            numbers = pa.RecordBatch.from_arrays([pa.nulls(len(batch)), batch.column(at)], names=["i", "text"])
            for _, texts in steps(iter([numbers]), LABEL_BYTES):
                own = batch.slice(start, len(texts)).select(list(range(len(kept))))
                start += len(texts)
                pred, score, spans, certain = _label(texts, field, runs)
                columns = [*own.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                if runs:
                    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
                    columns.append(pa.array(spans, kind))
                if sure:
                    columns.append(pa.array(certain, pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept)]
    return plain.mapInArrow(run, schema).select(*back, *added)


def _label(texts: pa.Array, field: Field | None, runs: bool) -> tuple[list[str], list[float], list, list[float]]:
    pred, score, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in range(len(texts))]
    certain = [0.0] * len(texts)
    if field is None:
        return pred, score, spans, certain
    words, letter, at, ends = words_in(texts)
    voting = letter[at] if len(at) else np.empty(0, bool)
    place = np.flatnonzero(voting)  # words with letters only, in order
    bounds = np.searchsorted(place, ends)
    lengths = np.diff(bounds)
    rows = np.flatnonzero(lengths)
    if len(rows):
        flat, table = at[place], field.weights(words, letter)
        starts, lengths = bounds[:-1][rows], lengths[rows]
        for some in in_batches(lengths):
            done = recursions(field.start, field.move, table, flat, starts[some], lengths[some], backward=True)
            votes = np.stack(
                [np.bincount(done.of, weights=g, minlength=len(some)) for g in done.gamma.T], axis=1
            ) / lengths[some][:, None]
            best = votes.argmax(axis=1)
            largest = np.bincount(done.of, weights=done.gamma.max(axis=1), minlength=len(some)) / lengths[some]
            for i, text in enumerate(rows[some]):
                pred[text] = field.languages[best[i]]
                score[text] = float(min(1.0, votes[i, best[i]]))
                certain[text] = float(min(1.0, largest[i]))
            if runs:
                state = done.gamma.argmax(axis=1)
                order = np.lexsort((done.place, done.of))
                for i, text in enumerate(rows[some]):
                    mine = order[np.searchsorted(done.of[order], i) : np.searchsorted(done.of[order], i, "right")]
                    where = place[bounds[text] : bounds[text + 1]] - ends[text]
                    cuts = np.flatnonzero(np.diff(state[mine])) + 1
                    for a, b in zip([0, *cuts], [*cuts, len(mine)], strict=True):
                        spans[text].append(
                            {"first": int(where[a]), "last": int(where[b - 1]), "lang": field.languages[state[mine[a]]]}
                        )
    return pred, score, spans, certain
