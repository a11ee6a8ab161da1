import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cohortspark.llm import hmm
from cohortspark.llm.hmm import score

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def base(rows, learned):
    count = Counter(t for i, text in rows if learned(i) for t in tokens(text))
    total = sum(count.values())
    out = Counter()
    for i, text in rows:
        own = tokens(text)
        s = sum(math.log10((count[t] + 0.1) / (total + 0.1 * (len(count) + 1))) for t in own)
        out[i, len(own), sum(count[t] > 0 for t in own), round(s, 6)] += 1
    return out, total


def rows(prose):
    out = [(i, prose(i % 7, 20 + i, "abcde" if i % 2 else "vwxyz")) for i in range(80)]
    return [*out, (90, None), (91, ""), (92, "Ä b\x0bB  b "), (93, prose(3, 9000, "abcde")), (90, "again"), (None, "a b")]


def test_base_and_counts(make_docs, clashing, prose, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_WORDS", 300)
    learned = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True))
    want, total = base(rows(prose), lambda i: i is None or i % 5 != 0)
    found = score(clashing(make_docs(rows(prose))), learned, states=3, frequent=40, affix_classes=16).collect()
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found)
    assert got == want and {r["train_tokens"] for r in found} == {total}
    held = [r for r in found if not r["train"] and r["n_tokens"] > 10]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_counts_of_many_steps_in_a_task(make_docs, long_texts):
    want, total = base(long_texts, lambda i: i % 5 != 0)
    found = score(make_docs(long_texts, 1), F.col("doc_id") % 5 != 0, states=2, frequent=40, affix_classes=16).collect()
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in found)
    assert got == Counter((i, n, k, round(s, 4)) for i, n, k, s in want) and {r["train_tokens"] for r in found} == {total}


def test_model_is_a_distribution(make_docs, spark):
    """The probabilities of all texts of up to two of the known words, and of what is beyond, sum to 1."""
    train = [(i, t) for i, t in enumerate(["a b", "a a b", "b", "c a", "", "b a"])]
    words = ["a", "b", "c", "dd", "xx"]
    texts = [""] + words + [f"{a} {b}" for a in words for b in words]
    probe = [(100 + i, t) for i, t in enumerate(texts)]
    kwargs = dict(states=2, frequent=3, affix_classes=1, rounds=2)
    found = {r["doc_id"]: 10 ** r["score"] for r in score(make_docs(train + probe), F.col("doc_id") < 100, **kwargs).collect()}
    assert all(p > 0 for p in found.values()) and sum(found[i] for i, _ in probe) < 1
    assert sum(found[i] for i, _ in probe) > 0.5


def test_rounds_raise_the_likelihood():
    draw = np.random.default_rng(4)
    lengths = draw.integers(5, 40, 60)
    kind = np.repeat(draw.integers(0, 2, 60), lengths)
    flat = draw.integers(0, 5, lengths.sum()) + 5 * kind
    model = hmm.first_model(np.bincount(flat, minlength=10), 2)
    last = -np.inf
    for _ in range(8):
        now = hmm.likelihoods(model, flat, lengths).sum()
        assert now >= last - 0.05 * abs(now)
        model, last = hmm.from_counts(hmm.expected(model, flat, lengths)[:3], 1e-6), now
    assert last > hmm.likelihoods(hmm.first_model(np.bincount(flat, minlength=10), 1), flat, lengths).sum()


def test_distributed_round_equals_one_in_memory(make_docs, spark):
    draw = np.random.default_rng(5)
    lengths = draw.integers(1, 30, 50)
    flat = draw.integers(0, 9, lengths.sum())
    cells = np.split(flat.astype(np.uint16), np.cumsum(lengths)[:-1])
    model = hmm.first_model(np.bincount(flat, minlength=9), 3)
    frame = spark.createDataFrame([(bytearray(c.tobytes()),) for c in cells], "classes binary").repartition(4)
    want = hmm.from_counts(hmm.expected(model, flat, lengths)[:3])
    got, reached = hmm.baum_welch(frame, model)
    assert abs(reached - hmm.likelihoods(model, flat, lengths).sum()) < 1e-6
    assert all(np.allclose(getattr(got, k), getattr(want, k)) for k in ("start", "move", "emit"))


def test_rounds_go_on_until_they_gain_less_than_the_tolerance(spark):
    draw = np.random.default_rng(6)
    lengths = draw.integers(5, 40, 80)
    flat = draw.integers(0, 5, lengths.sum()) + 5 * np.repeat(draw.integers(0, 2, 80), lengths)
    cells = np.split(flat.astype(np.uint16), np.cumsum(lengths)[:-1])
    frame = spark.createDataFrame([(bytearray(c.tobytes()),) for c in cells], "classes binary").repartition(3)
    first = hmm.first_model(np.bincount(flat, minlength=10), 2)
    model = hmm.learned(frame, first, len(flat), 20, 0.001)
    # Two kinds of texts, each of five classes at random: no model is better than half a bit a text and log10(5) a token.
    reached = hmm.likelihoods(model, flat, lengths).sum() / len(flat)
    assert hmm.likelihoods(first, flat, lengths).sum() / len(flat) < -0.85 and reached > -0.75


def test_no_training_texts_and_empty_table(make_docs):
    found = score(make_docs([(1, "a b"), (2, None)]), F.lit(False), states=2, frequent=3, affix_classes=4).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in found} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert all(r["score"] < 0 for r in found)
    assert score(make_docs([]), F.lit(True), states=2, frequent=3, affix_classes=4).collect() == []
