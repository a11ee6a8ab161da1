"""Text probabilities under a hidden Markov model whose counts come from the whole training corpus.

Tokens are words (A-Z lower-cased) and one end per text. Each token has a class: the end, each of the most frequent words, or one of a
fixed number of classes by the word's first and last letters. A state emits a class, a class emits a word by its training
count, so the model is a distribution over all words, known or not, while the matrices stay of a fixed size.

1. Every task codes its documents against a dictionary of its own and counts the words in it.
2. Counts are summed by word over all tasks; each dictionary gets its words' counts and classes back.
3. Baum-Welch: each task turns its training texts into expected counts, their sums give the next matrices. The first matrices are the
   class counts of all training texts, shifted a little from state to state; every round uses every training text, until a round
   gains less than ``TOLERANCE`` a token.
4. The scaled forward recursion gives each text's exact likelihood.

Defined cases: NULL text is the empty text, which is one end token; NULL ids count as the text ""; without training texts the base
score of every token is log10(1) and the model is uniform; very long texts are scored whole; repeated rows count each; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.chains import in_batches, recursions
from cohortspark.llm.near_dedup import words_of
from cohortspark.llm.packing import steps
from cohortspark.llm.rows import written

STATES, FREQUENT, AFFIX_CLASSES = 8, 2000, 2048
#: Rounds end when the mean log10 probability of a training token rose by less than this, and after ``ROUNDS`` at the latest.
TOLERANCE, ROUNDS = 0.002, 20
#: Added to every count.
ADD = 0.1
#: A dictionary is closed beyond so many words.
BLOCK_WORDS = 500_000
END_CLASS = 0


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x classes


def coded(docs: DataFrame) -> DataFrame:
    """Document rows (block, doc_id, train, tokens) and dictionary rows (block, word, at, n: count in training texts).

    ``docs`` has doc_id, text, train. Token 0 is the end, token i the word at i.
    """
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        words, counts = pa.array([], pa.large_string()), np.zeros(0, np.int64)

        def dictionary() -> pa.RecordBatch:
            n = len(words)
            none = [pa.nulls(n, t) for t in (arrow, pa.bool_(), pa.binary())]
            at = pa.array(np.arange(1, n + 1), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), none[0], none[1], none[2], words.cast(pa.string()), at, pa.array(counts)],
                names=names,
            )

        arrow = pa.null()
        for batch in batches:
            arrow, start = batch.column(0).type, 0
            for ids, texts in steps(iter([batch])):
                train = batch.column(2).slice(start, len(ids))
                start += len(ids)
                flat, ends = words_of(texts)
                own = flat.dictionary_encode()
                known = pc.index_in(own.dictionary, value_set=words)
                new = own.dictionary.filter(pc.is_null(known))
                place = pc.fill_null(known, -1).to_numpy().astype(np.int64)
                place[place < 0] = len(words) + np.arange(len(new))
                words, counts = pa.concat_arrays([words, new]), np.append(counts, np.zeros(len(new), np.int64))
                tokens = place[own.indices.to_numpy()].astype(np.int64)
                weight = np.repeat(train.to_numpy(zero_copy_only=False).astype(bool), np.diff(ends))
                counts += np.bincount(tokens[weight], minlength=len(counts))
                tokens = (tokens + 1).astype(np.uint32)
                cells = [np.append(tokens[a:b], np.uint32(0)).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                n = len(ids)
                none = [pa.nulls(n, t) for t in (pa.string(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), ids, train, pa.array(cells, pa.binary()), *none], names=names
                )
                if len(words) > BLOCK_WORDS:
                    yield dictionary()
                    block, words, counts = block + 1, pa.array([], pa.large_string()), np.zeros(0, np.int64)
        if len(words):
            yield dictionary()

    names = ["block", "doc_id", "train", "tokens", "word", "at", "n"]
    kind = f"block long, doc_id {id_type.simpleString()}, train boolean, tokens binary, word string, at int, n long"
    return docs.select("doc_id", "text", "train").mapInArrow(run, kind)


def affix_class(word: Column, frequent: int, classes: int) -> Column:
    ends = F.xxhash64(F.substring(word, 1, 2), F.substring(word, -2, 2))
    return (F.lit(frequent + 1) + F.pmod(ends, F.lit(classes))).cast("int")


def likelihoods(model: Model, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 likelihood of each class sequence."""
    starts, out = np.cumsum(lengths) - lengths, np.zeros(len(lengths))
    table = np.ascontiguousarray(model.emit.T)
    for some in in_batches(lengths):
        out[some] = recursions(model.start, model.move, table, flat, starts[some], lengths[some]).likelihood
    return out / np.log(10)


def expected(model: Model, flat: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Counts of starts, moves and emissions, and the log10 likelihood of all sequences."""
    starts, table = np.cumsum(lengths) - lengths, np.ascontiguousarray(model.emit.T)
    counts = [np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit), np.zeros(1)]
    for some in in_batches(lengths):
        done = recursions(model.start, model.move, table, flat, starts[some], lengths[some], backward=True)
        counts[0] += done.gamma[: done.first].sum(axis=0)
        counts[1] += done.moves
        counts[3] += done.likelihood.sum() / np.log(10)
        for s, weights in enumerate(np.ascontiguousarray(done.gamma.T)):
            counts[2][s] += np.bincount(done.seen, weights=weights, minlength=counts[2].shape[1])
    return counts


def from_counts(counts: list[np.ndarray], add: float = ADD) -> Model:
    return Model(*[(c + add) / (c + add).sum(axis=-1, keepdims=True) for c in counts])


def first_model(counts: np.ndarray, states: int, seed: int = 7) -> Model:
    """States that tend to stay and emit classes by their ``counts``, each state half to one and a half times as often."""
    lean = np.random.default_rng(seed).uniform(0.5, 1.5, (states, len(counts)))
    emit = (counts + ADD) * lean
    stay = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.zeros((1, 1))
    np.fill_diagonal(stay, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), stay, emit / emit.sum(axis=1, keepdims=True))


def _sequences(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(c) // 2 for c in cells), np.int64, len(cells))
    return np.frombuffer(b"".join(cells), np.uint16).astype(np.int64), lengths


def baum_welch(texts: DataFrame, model: Model) -> tuple[Model, float]:
    """One round: ``texts`` (classes) to expected counts per task, summed by cell, to the next model.

    The number is the log10 likelihood of all texts under ``model``.
    """
    shapes = [c.shape for c in (model.start, model.move, model.emit)] + [(1,)]
    sizes = [int(np.prod(s)) for s in shapes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in range(0, len(batch), 2000):
                counts = expected(model, *_sequences(batch.column(0).slice(part, 2000).to_pylist()))
                flat = np.concatenate([c.ravel() for c in counts])
                total = flat if total is None else total + flat
        if total is not None:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    # At most one row per matrix cell comes to the driver, however many tasks there are.
    sums = texts.select("classes").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(sum(sizes))
    for row in sums.collect():
        flat[row["cell"]] = row["n"]
    parts = [p.reshape(s) for p, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes, strict=True)]
    return from_counts(parts[:3]), float(parts[3][0])


def learned(texts: DataFrame, model: Model, tokens: int, rounds: int, tolerance: float) -> Model:
    """Rounds over all ``texts``, which hold so many ``tokens``, until one gained less than ``tolerance`` a token."""
    if not tokens:
        return from_counts([np.zeros_like(c) for c in (model.start, model.move, model.emit)])
    before = None
    for _ in range(rounds):
        model, reached = baum_welch(texts, model)
        if before is not None and reached - before < tolerance * tokens:
            break
        before = reached
    return model


def score(
    docs: DataFrame,
    train: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    states: int = STATES,
    frequent: int = FREQUENT,
    affix_classes: int = AFFIX_CLASSES,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    plain = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"), train.alias("train"))
    table = written(coded(plain), "coded")
    texts = table.filter("tokens is not null").select("block", "doc_id", "train", "tokens")
    entries = table.filter("word is not null").select("block", "word", "at", "n").repartition("word")
    counts = written(entries.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    top = counts.filter("c > 0").orderBy(F.desc("c"), "word").limit(frequent).collect()
    spark, n_classes = docs.sparkSession, 1 + frequent + affix_classes
    ranks = spark.createDataFrame([(r["word"], i + 1) for i, r in enumerate(top)], "frequent string, rank int")
    ranks = F.broadcast(ranks)  # ``frequent`` rows
    classed = counts.join(ranks, F.col("word") == F.col("frequent"), "left").select(
        "word", "c", F.coalesce("rank", affix_class(F.col("word"), frequent, affix_classes)).alias("class")
    )
    in_class = np.zeros((n_classes, 2))
    sums = classed.groupBy("class").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect()
    for row in sums:
        in_class[row["class"]] = row["n"], row["v"]
    ends = texts.filter("train").count()
    known, distinct = int(in_class[:, 0].sum()) + ends, int(in_class[:, 1].sum()) + (ends > 0)
    base_total = known + ADD * (distinct + 1)
    word_total = in_class[:, 0] + ADD * (in_class[:, 1] + 1)
    single = np.arange(n_classes) <= frequent  # one word each, so the class says all

    def settle(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n = max(len(right), int(pc.max(right["at"]).as_py() or 0))
        c, kind = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        at = right["at"].to_numpy()
        c[at], kind[at] = right["c"].to_numpy(), right["class"].to_numpy()
        c[0], kind[0] = ends, END_CLASS
        base = np.log10((c + ADD) / base_total)
        word = np.where(single[kind], 0.0, np.log10((c + ADD) / word_total[kind]))
        cells = [np.frombuffer(x, np.uint32) for x in left["tokens"].to_pylist()]
        columns = [
            left["doc_id"],
            left["train"],
            pa.array([len(x) for x in cells], pa.int64()),
            pa.array([int((c[x] > 0).sum()) for x in cells], pa.int64()),
            pa.array([float(base[x].sum()) for x in cells], pa.float64()),
            pa.array([float(word[x].sum()) for x in cells], pa.float64()),
            pa.array([kind[x].astype(np.uint16).tobytes() for x in cells], pa.binary()),
        ]
        return pa.table(columns, names=names)

    names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "word_score", "classes"]
    id_type = plain.schema["doc_id"].dataType.simpleString()
    kinds = (
        f"doc_id {id_type}, train boolean, n_tokens long, n_known long, base_score double, word_score double, "
        "classes binary"
    )
    answers = entries.select("block", "word", "at").join(classed, "word").select(
        F.col("block").alias("to"), "at", "c", "class"
    )
    settled = written(
        texts.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(settle, kinds), "settled"
    )
    training = settled.filter("train")
    totals = in_class[:, 0].copy()
    totals[END_CLASS] = ends
    model = learned(training.select("classes"), first_model(totals, states), known, rounds, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths = _sequences(batch.column(5).to_pylist())
            scores = batch.column(4).to_numpy() + likelihoods(model, flat, lengths)
            columns = [batch.column(i) for i in range(4)]
            columns = [*columns, batch.column(6), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
            )

    out = settled.select("doc_id", "train", "n_tokens", "n_known", "word_score", "classes", "base_score").mapInArrow(
        run, f"doc_id {id_type}, train boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.withColumn("train_tokens", F.lit(known).cast("long"))
