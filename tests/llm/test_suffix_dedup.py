import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import suffix_dedup
from cohortspark.llm.suffix_dedup import drop_repeats


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept) by document, rows in order."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1)
        out.append((len(raw), int(gone.sum()), len(edges), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return out


def got(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()}


def corpus(prose):
    passage, other = prose(1, 40), "ünïcödé ßtraße " * 12
    rows = [(i, prose(100 + i, 30)) for i in range(8)]
    rows += [(20 + i, f"{prose(200 + i, 6)} {passage} {prose(300 + i, 7)}") for i in range(6)]
    rows += [(40, prose(5, 60)), (41, prose(5, 60)), (42, prose(5, 60)[3:-5] + "x")]
    rows += [(50, "a" * 350), (51, "ab" * 200), (52, "b" + "a" * 150), (53, other), (54, other[5:] + passage[10:150])]
    rows += [(60, None), (61, ""), (62, "short"), (63, passage[:99]), (64, passage[:100]), (65, passage + passage)]
    return rows


def test_equals_brute_force(make_docs, clashing, prose):
    rows = corpus(prose)
    want = {i: x for (i, _), x in zip(sorted(rows), brute(sorted(rows, key=lambda r: r[0])), strict=True)}
    assert got(drop_repeats(clashing(make_docs(rows)))) == want


def test_small_steps_and_long_texts(make_docs, prose, monkeypatch):
    rows = [(1, prose(1, 20_000)), (2, prose(2, 50)), (3, prose(1, 20_000)[500:9_000])]
    want = {i: x for (i, _), x in zip(rows, brute(rows), strict=True)}
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 1000)
    assert got(drop_repeats(make_docs(rows))) == want


@pytest.mark.parametrize("most", [1, 3])
def test_windows_of_hot_grams_are_dealt_one_by_one(make_docs, clashing, prose, monkeypatch, most):
    """A passage whose strings at its edges have more names than one task is to compare."""
    passage = prose(1, 40)
    rows = [*corpus(prose), *((100 + i, f"{prose(400 + i // 2, 5)} {passage} {prose(500 + i, 5)}") for i in range(12))]
    want = {i: x for (i, _), x in zip(sorted(rows), brute(sorted(rows, key=lambda r: r[0])), strict=True)}
    monkeypatch.setattr(suffix_dedup, "HOT_NAMES", most)
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", 300)
    assert got(drop_repeats(clashing(make_docs(rows)))) == want


def in_order(prose, names, grams):
    """Batches of suffixes in the order in which a task meets them; two of a gram agree each, neighbours in part."""
    raw = prose(7, 2 * names).encode()
    rows = [(g, None, i, 400, 76, 0, raw[i // 2 * 3 :][:176]) for g in range(grams) for i in range(names)]
    types = [pa.int64()] * 3 + [pa.int32()] + [pa.int8()] * 2 + [pa.binary()]
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
    whole = pa.RecordBatch.from_arrays(columns, names=["gram", "key", "doc", "place", "ahead", "behind", "bytes"])
    return [whole.slice(i, 700) for i in range(0, len(whole), 700)]


def spans(parts):
    return sorted(x for part in parts for x in zip(*(y.tolist() for y in part), strict=True))


def test_suffixes_are_compared_some_grams_at_a_time_with_the_same_result(prose):
    batches = in_order(prose, 1000, 9)
    want = spans([suffix_dedup.merged(pa.Table.from_batches(batches))])
    parts = list(suffix_dedup.covered_in_order(iter(batches), 1))
    assert spans(parts) == want
    assert len(want) >= 9 * 500
    assert len(parts) > 4


def test_comparing_takes_little_memory_for_many_names(prose):
    """It held eight numbers for every byte of a partition's suffixes."""
    table = pa.Table.from_batches(in_order(prose, 20_000, 1))
    tracemalloc.start()
    suffix_dedup.merged(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * table.nbytes


def test_anchors_of_a_long_text_take_the_memory_of_a_piece(prose):
    text = np.frombuffer((prose(1, 40_000) + "a" * 5000 + prose(2, 40_000)).encode(), np.uint8)
    ends = np.array([len(text)])
    whole = suffix_dedup.anchors(text, ends)
    tracemalloc.start()
    parts = list(suffix_dedup.anchors_by_piece(text, ends, 20_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) > 10
    for have, want in zip(zip(*parts, strict=True), whole, strict=True):
        assert np.array_equal(np.concatenate(have), want)
    assert peak < 5_000_000


def test_null_and_repeated_ids_are_ordered_by_id_then_text(make_docs, prose):
    rows = [(None, prose(1, 40)), (7, prose(1, 40)), (7, prose(2, 40)), (7, prose(2, 40)), (9, prose(2, 40))]
    found = sorted(
        ((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in drop_repeats(make_docs(rows)).collect())
    )
    full = [len(prose(s, 40)) for s in (1, 2)]
    assert found == sorted([(False, 0, 0), (True, 7, full[0]), (True, 7, 0), (True, 7, full[1]), (True, 9, full[1])])


def test_empty_table(make_docs):
    assert drop_repeats(make_docs([])).collect() == []


@pytest.mark.parametrize("size", [99, 100, 101, 260])
def test_anchors_own_every_window_once(size, prose):
    text = np.frombuffer(prose(3, 200).encode()[: size + 130], np.uint8)
    ends = np.array([size, size + 130])
    document, _, _, place, ahead, behind = suffix_dedup.anchors(text, ends)
    starts = [
        (d, s) for d, p, a, b in zip(document, place, ahead, behind, strict=True) for s in range(p - a, p - b + 1)
    ]
    assert sorted(starts) == [(d, s) for d, n in enumerate((size, 130)) for s in range(n - 99)]


def test_query_digest(spark, make_docs, tmp_path, prose):
    from cohortspark.llm.queries import QUERIES

    rows = [(1, prose(1, 50)), (2, prose(1, 50))]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert found == {1: hashlib.sha256(prose(1, 50).encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
