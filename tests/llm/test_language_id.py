import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm.chains import in_batches, recursions
from cohortspark.llm.language_id import fit, fitted, labelled

PARTS = {"xx": ["ka", "tor", "mi", "lun", "dra"], "yy": ["ès", "que", "ñol", "ri", "té"], "zz": ["sch", "ung", "bei", "ü", "ent"]}


def text(lang, n, seed):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choices(PARTS[lang], k=draw.randint(1, 3))).capitalize() + draw.choice(["", "", ",", "!!"]) for _ in range(n))


@pytest.fixture(scope="module")
def field():
    rows = [(text(lang, 60, i), lang) for lang in PARTS for i in range(20)]
    return fit([t for t, _ in rows], [x for _, x in rows])


def rows():
    return [(i, text(lang, 5 + 7 * i % 90, 1000 + i), None, None) for i, lang in enumerate(sorted(PARTS) * 20)]


def test_held_out_accuracy(make_docs, clashing, field):
    docs = clashing(make_docs(rows()))
    found = labelled(docs, field)
    assert found.columns == [*docs.columns, "lang_pred", "lang_score"]
    truth = dict(enumerate(sorted(PARTS) * 20))
    hits = [r["lang_pred"] == truth[r["doc_id"]] for r in found.collect()]
    assert np.mean(hits) > 0.97 and len(hits) == 60


def test_code_switched_text(make_docs, field):
    mixed = f"{text('xx', 12, 1)} 123 {text('yy', 20, 2)} -- {text('xx', 12, 3)}"
    row = labelled(make_docs([(1, mixed)]), field, runs=True).collect()[0]
    runs = [(r["lang"], r["first"], r["last"]) for r in row["lang_runs"]]
    assert runs == [("xx", 0, 11), ("yy", 13, 32), ("xx", 34, 45)]
    assert row["lang_pred"] == "xx" and abs(row["lang_score"] - 24 / 44) < 0.05


def test_texts_without_letters_and_long_texts(make_docs, field):
    found = labelled(make_docs([(1, None), (2, ""), (3, "12 34 !!"), (4, text("yy", 30_000, 9)), (5, "東京 東京")]), field).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in found}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "yy" and by[5][0] in PARTS
    assert all(0 <= s <= 1 for _, s in by.values())


def test_learns_from_the_given_rows_only(make_docs):
    docs = make_docs([(i, text(lang, 40, i), lang, "s") for i, lang in enumerate(sorted(PARTS) * 8)] + [(None, text("xx", 9, 1), "xx", "s"), (90, None, "xx", "s"), (91, "x y", None, "s")])
    some = fitted(docs, F.col("doc_id") % 3 != 2)
    assert some.languages == ("xx", "yy")
    assert set(fitted(docs, F.lit(True), sample_texts=5).languages) == set(PARTS)


def test_no_labels_and_empty_table(make_docs):
    docs = make_docs([(1, "some words", None, None)])
    assert fitted(docs, F.lit(True)) is None
    assert labelled(docs, None).collect()[0]["lang_pred"] == "und"
    assert labelled(make_docs([]), None, runs=True).collect() == []


def test_one_language(make_docs):
    field = fit([text("xx", 30, 1)], ["xx"])
    row = labelled(make_docs([(1, text("yy", 3, 1))]), field).collect()[0]
    assert (row["lang_pred"], row["lang_score"]) == ("xx", 1.0)


def test_recursions_equal_sums_over_all_paths():
    from itertools import product

    draw = np.random.default_rng(2)
    start, move, table = draw.random(3), draw.random((3, 3)), draw.random((7, 3))
    flat, lengths = draw.integers(0, 7, 11), np.array([4, 1, 6])
    starts = np.cumsum(lengths) - lengths
    moves, total = np.zeros((3, 3)), np.zeros(3)
    gamma = [np.zeros((n, 3)) for n in lengths]
    for k, (s, n) in enumerate(zip(starts, lengths, strict=True)):
        own = np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            p = start[path[0]] * np.prod([table[flat[s + t], y] for t, y in enumerate(path)])
            p *= np.prod([move[a, b] for a, b in zip(path, path[1:], strict=False)])
            total[k] += p
            for t, y in enumerate(path):
                gamma[k][t, y] += p
            for a, b in zip(path, path[1:], strict=False):
                own[a, b] += p
        moves += own / total[k]
        gamma[k] /= total[k]
    got = np.zeros((3, 3))
    for some in in_batches(lengths, 7):
        done = recursions(start, move, table, flat, starts[some], lengths[some], backward=True)
        assert np.allclose(done.likelihood, np.log(total[some]))
        for i, g in enumerate(done.gamma):
            assert np.allclose(g, gamma[some[done.of[i]]][done.place[i]])
        got += done.moves
    assert np.allclose(got, moves)
