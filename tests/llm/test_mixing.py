from fractions import Fraction
from math import ceil

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import mixing
from cohortspark.llm.mixing import in_mixed_order, mix, period_slots, phases_of, rows_of_a_block, schedule_rows, shares_of
from cohortspark.llm.positions import PARTS
from cohortspark.llm.queries import op8_mixing


def test_deviation_stays_under_one_block():
    shares = shares_of({"a": 5, "b": 3, "c": 1, "d": 0.01}, 1000)
    slots = period_slots(shares)
    assert sorted(x for s in slots.values() for x in s) == list(range(1000)) and sum(shares.values()) == 1000
    for s, own in slots.items():
        for t in range(1, 1001):
            assert abs(sum(x < t for x in own) - t * shares[s] / 1000) < 1


def test_phases_place_every_block_once():
    blocks = {"a": 700, "b": 30, "c": 1, "d": 250}
    phases = phases_of(blocks, {"a": 1, "b": 1, "c": 3, "d": 2}, 50)
    slots = [[p for p in phases if s in p.slots and p.first[s] <= k][-1].slot(s, k) for s in blocks for k in range(blocks[s])]
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_mix_keeps_all_rows_and_shares(make_docs, clashing):
    rows = [(i, "t", None, "hot" if i % 3 else f"s{i % 7}") for i in range(900)] + [(1, "t", None, None)] * 20 + [(None, "t", None, "s1")]
    docs = clashing(make_docs(rows))
    weights = {"hot": 0.5, None: 0.1, **{f"s{k}": 0.4 / 7 for k in range(7)}}
    found = mix(docs, weights, block_rows=4, period=100).collect()
    assert sorted(r["mix_position"] for r in found) == list(range(len(rows)))
    assert sorted(str((r["doc_id"], r["source"])) for r in found) == sorted(str((r[0], r[3])) for r in rows)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in found)
    first = [r for r in found if r["mix_phase"] == 0]
    slots = max(r["mix_slot"] for r in first) + 1
    hot = len({r["mix_slot"] for r in first if r["source"] == "hot"})
    assert abs(hot - 0.5 * slots) < 2
    order = sorted(found, key=lambda r: r["mix_position"])
    assert [r["mix_slot"] for r in order] == sorted(r["mix_slot"] for r in found)


def test_order_of_rows_and_own_columns(make_docs, clashing):
    docs = clashing(make_docs([(i, "t", None, f"s{i % 3}") for i in range(60)]))
    out = in_mixed_order(docs, block_rows=2)
    want = [r["doc_id"] for r in sorted(mix(docs, block_rows=2).collect(), key=lambda r: r["mix_position"])]
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == want


def test_missing_and_bad_weights(make_docs):
    docs = make_docs([(1, "t", None, "a"), (2, "t", None, "b")])
    with pytest.raises(ValueError, match="no weight"):
        mix(docs, {"a": 1.0})
    with pytest.raises(ValueError, match="positive"):
        mix(docs, {"a": 1.0, "b": 0.0})


def test_empty_table(make_docs):
    assert mix(make_docs([])).collect() == [] and in_mixed_order(make_docs([])).collect() == []


def test_deviation_from_the_given_weights_over_the_whole_first_phase():
    blocks = {"hot": 20_000, **{f"s{k}": 40_000 // 19 for k in range(19)}, "rare": 40}
    weights = {s: n**0.5 for s, n in blocks.items()} | {"rare": 0.01}
    phase = phases_of(blocks, weights)[0]
    end = sum(len(own) for own in phase.slots.values())
    assert end > 30_000
    for s, own in phase.slots.items():
        share = weights[s] / sum(weights.values())
        for k, slot in enumerate(own):
            assert abs(k - slot * share) < 1 and abs(k + 1 - (slot + 1) * share) < 1
        assert abs(len(own) - end * share) < 1


def test_windows_of_exact_weights(make_docs):
    docs = make_docs([(i, "t", None, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)])
    weights = {"hot": 0.4, **{f"s{k}": 0.6 / 7 + k / 1e6 for k in range(7)}}
    found = mix(docs, weights, block_rows=2).collect()
    assert sorted(r["mix_position"] for r in found) == list(range(3000))
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in found)
    first = [r for r in found if r["mix_phase"] == 0]
    for r in first:
        share = weights[r["source"]] / sum(weights.values())
        assert abs(r["mix_release"] - r["mix_block"] / share) < 1 + 1e-6
        assert abs(r["mix_deadline"] - (r["mix_block"] + 1) / share) < 1 + 1e-6


def by_brute_force(held, block_rows):
    """(doc_id, position) of every document: a slot goes to the released block with the earliest deadline."""
    left = {s: [ids[i : i + block_rows] for i in range(0, len(ids), block_rows)] for s, ids in held.items()}
    weights = {s: len(ids) ** 0.5 for s, ids in held.items()}
    order = []
    while left := {s: b for s, b in left.items() if b}:
        shares = shares_of({s: weights[s] for s in left})
        w = {s: Fraction(n, sum(shares.values())) for s, n in shares.items()}
        taken, slot = dict.fromkeys(left, 0), 0
        while True:
            ready = [s for s in left if taken[s] / w[s] < slot + 1]
            s = min(ready, key=lambda s: (ceil((taken[s] + 1) / w[s]), s))
            if taken[s] == len(left[s]):
                break
            order += left[s][taken[s]]
            taken[s], slot = taken[s] + 1, slot + 1
        left = {s: b[taken[s] :] for s, b in left.items()}
    return [(d, i) for i, d in enumerate(order)]


@pytest.mark.parametrize("most", [65_536, 40])
def test_whole_query_equals_brute_force(spark, monkeypatch, most):
    sf_dir = "/root/testdata/sf0.01"
    monkeypatch.setattr(mixing, "MOST_BLOCKS", most)
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 10 * most)
    key = F.xxhash64("doc_id")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", key.alias("key"), F.pmod(F.shiftright(key, 20), F.lit(PARTS)).alias("part")
    )
    held = {}
    for r in sorted(rows.collect(), key=lambda r: (r["part"], r["key"], r["doc_id"])):
        held.setdefault("null" if r["source"] is None else f"={r['source']}", []).append(r["doc_id"])
    n = sum(map(len, held.values()))
    got = sorted((r["doc_id"], r["mix_position"]) for r in op8_mixing(spark, sf_dir).collect())
    assert got == sorted(by_brute_force(held, max(16, -(-n // most))))


def test_schedule_is_as_large_for_a_billion_documents_as_for_a_million():
    def numbers(n):
        counts = {"hot": n // 3, **{f"s{k}": 2 * n // 3 // 19 for k in range(19)}}
        rows = rows_of_a_block(n)
        blocks = {s: -(-c // rows) for s, c in counts.items()}
        placed = list(schedule_rows(phases_of(blocks, {s: c**0.5 for s, c in counts.items()}), counts, rows))
        # Positions are whole: the blocks of all sources end where the documents do.
        assert max(p + r for _, _, _, starts, _ in placed for p in starts for r in [rows]) >= sum(counts.values())
        return sum(2 * len(slots) + 5 * len(spans) for _, _, slots, _, spans in placed)

    million, billion = numbers(10**6), numbers(10**9)
    assert billion < 1.1 * million < mixing.BROADCAST_NUMBERS
