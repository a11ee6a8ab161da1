import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortspark.llm import packing
from cohortspark.llm.packing import pack, pack_block

PATH = public_tokenizers.path("word_bpe_49k.json")


def rows(prose):
    out = [(i, prose(i, 5 + 37 * i % 900)) for i in range(40)]
    return [*out, (50, None), (51, ""), (52, " \t\n"), (53, prose(9, 9000)), (54, "Éa İ ß x y 'll don't <|endoftext|>"), (54, "again"), (None, "x")]


def check(pieces, docs, sequence_tokens):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in docs)
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    back = []
    for own in by_doc.values():
        ids = [i for r in sorted(own, key=lambda r: r["start"]) for i in np.frombuffer(r["ids"], "<u4").tolist()]
        back.append(ids)
    assert sorted(back) == want
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1]]
        size = int(ends[-1])
        assert size == own[0]["sequence_tokens"] <= sequence_tokens and size & (size - 1) == 0


def test_round_trip(make_docs, clashing, prose):
    docs = rows(prose)
    check(pack(clashing(make_docs(docs)), PATH).collect(), docs, 2048)


def test_blocks_steps_and_forgetting(make_docs, prose, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 50)
    docs = rows(prose)
    check(pack(make_docs(docs), PATH, sequence_tokens=64, block_tokens=500).collect(), docs, 64)


def test_empty_table(make_docs):
    assert pack(make_docs([]), PATH).collect() == []


def test_sequence_size_must_be_a_power_of_two(make_docs):
    with pytest.raises(ValueError):
        pack(make_docs([]), PATH, sequence_tokens=1000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=60))
def test_block_holds_every_token_once_without_padding(lengths):
    pieces, sizes, cost = pack_block(np.array(lengths), 64, 0.01)
    got = np.zeros(len(lengths), int)
    cells = set()
    for doc, start, n, to, offset in pieces:
        got[doc] += n
        cells |= {(to, offset + i) for i in range(n)}
    assert got.tolist() == lengths
    assert cells == {(s, i) for s, size in enumerate(sizes) for i in range(size)}


def test_descending_documents_go_to_the_cheapest_sequence():
    pieces, sizes, cost = pack_block(np.array([60, 50, 40, 30, 20, 10, 46]), 64, 0.01)
    firsts = {doc: to for doc, _, _, to, offset in pieces if offset == 0}
    assert firsts[0] == 0 and firsts[1] == 1 and firsts[6] == 2 and sizes.sum() == 256


def test_costs_are_close(prose):
    draw = np.random.default_rng(1)
    _, sizes, cost = pack_block(draw.integers(20, 900, 3000), 2048)
    full = cost[sizes == 2048]
    assert full.std() / full.mean() < 0.05


def test_memory_of_a_step():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = pa.array([" ".join(draw.choices(words, k=5000)) for _ in range(400)])
    encode = packing.WordTokens(PATH)
    batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], names=["i", "text"])
    tracemalloc.start()
    n = sum(len(encode(some)[1]) for _, some in packing.steps(iter([batch]), packing.PACK_BYTES))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400 and most < 80 << 20, most >> 20
