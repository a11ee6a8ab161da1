import importlib.util

import pytest
from test_near_dedup import brute

from cohortspark.llm.mixing import mix
from cohortspark.session import BATCH_BYTES, BATCH_KEY

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not installed", allow_module_level=True)

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def stages(spark, docs, tmp_path):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{tmp_path}/{name}")
        out.append(spark.read.parquet(f"{tmp_path}/{name}"))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw, language, exact, near, mixed, packed = stages(spark, docs, tmp_path)
    assert language.columns == exact.columns == near.columns == mixed.columns == raw.columns
    rows = {r["doc_id"]: r["text"] for r in raw.collect()}
    kept = {r["doc_id"]: r["text"] for r in language.collect()}
    assert all(rows[i] == t for i, t in kept.items()) and len(kept) > 0.97 * len(rows)
    last = {}
    for i, t in sorted(kept.items()):
        last[t] = i
    unique = {r["doc_id"]: r["text"] for r in exact.collect()}
    assert unique == {i: t for t, i in last.items()} and len(unique) < len(kept)
    left = {r["doc_id"] for r in near.collect()}
    assert left == {i for i, (_, c) in brute(list(unique.items()), 5, 80).items() if i == c} and len(left) < len(unique)
    order = [r["doc_id"] for r in sorted(mix(near).collect(), key=lambda r: r["mix_position"])]
    assert [r["doc_id"] for r in mixed.collect()] == order and set(order) == left
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(pieces) == left
    for own in pieces.values():
        own.sort()
        ends = [s + n for s, n, _ in own]
        assert [s for s, _, _ in own] == [0, *ends[:-1]] and ends[-1] == own[0][2]


def test_odd_rows_and_run(spark, make_docs, prose, tmp_path):
    rows = [(i, prose(i, 60), "xx", f"s{i % 3}") for i in range(30)]
    rows += [(40, None, None, None), (41, "123", "xx", None), (None, prose(1, 60), None, None), (1, prose(1, 60), "xx", "s1"), (42, prose(2, 60) + " end", "xx", None)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == set(range(30)) or found == set(range(30)) - {2} | {42}


def test_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_text_of_three_languages_stays(spark, make_docs, prose):
    letters = {"xx": "abcdef", "yy": "ghijkl", "zz": "mnopqr"}
    rows = [(i, prose(i, 60, letters[k]), k, "s") for i, k in enumerate(list(letters) * 20)]
    mixed = " ".join(prose(900 + n, n, x) for n, x in zip((40, 35, 25), letters.values(), strict=True))
    rows += [(100, mixed, None, "s"), (101, "123", None, "s")]
    found = {r["doc_id"] for r in corpus_pipeline.language(spark, make_docs(rows), SF).collect()}
    assert found == set(range(60)) | {100}


def test_language_goes_in_small_batches(spark, make_docs, prose, monkeypatch):
    seen, write, before = [], corpus_pipeline.materialize, spark.conf.get(BATCH_KEY, None)
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, name: (seen.append((df.columns, spark.conf.get(BATCH_KEY, None))), write(df, name))[1])
    rows = [(i, prose(i, 60), "xx", "s") for i in range(20)] + [(None, prose(3, 60), "xx", "s")] * 2 + [(3, "123", "xx", "s")]
    docs = make_docs(rows + [(40, None, "xx", "s"), (None, None, "xx", "s"), (None, "", None, None)])
    found = corpus_pipeline.language(spark, docs, SF)
    assert found.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == sorted((r[:2] for r in rows[:22]), key=str)
    # Texts are not written once more: only what is left out is.
    assert seen == [(["id", "tag"], str(BATCH_BYTES))] and spark.conf.get(BATCH_KEY, None) == before
