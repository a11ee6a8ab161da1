import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import near_dedup
from cohortspark.llm.components import components
from cohortspark.llm.near_dedup import drop_near_copies, least_agreements, near_groups, words_of
from cohortspark.llm.packing import steps
from cohortspark.session import BATCH_BYTES, BATCH_KEY, small_batches

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def brute(rows, words, percent):
    """(n_shingles, component) of each row; ids are unique."""
    sets = {i: shingles(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, edits, seed):
    draw, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


def corpus(prose):
    rows = [(i, prose(i, 30 + i)) for i in range(60)]
    base = prose(999, 140)
    rows += [(100 + i, edited(base, i % 9, i)) for i in range(150)]  # a hot group, on both sides of the threshold
    rows += [(300 + i, base.upper() + " " * (i % 3)) for i in range(40)]  # copies of one set
    rows += [(400, None), (401, ""), (402, " \t\x0b"), (403, "one two"), (404, "ONE  two"), (405, "Ä x y z"), (406, "ä x y z")]
    rows += [(410, " ".join(["same"] * 50)), (411, " ".join(["same"] * 9)), (412, prose(77, 15_000)), (413, edited(prose(77, 15_000), 300, 1))]
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(make_docs, clashing, prose, words, percent):
    rows = corpus(prose)
    want = brute(rows, words, percent)
    found = near_groups(clashing(make_docs(rows)), words=words, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want and len(found) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_words_of_every_step(prose):
    texts = [None if i % 17 == 0 else prose(i, i % 90).title() + " Ä\tB\x0bc" * (i % 3) for i in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(texts)], names=["id", "text"]).slice(50)
    found, n = [], 0
    for ids, some in steps(iter([batch]), 5000):
        flat, ends = words_of(some)
        found += [flat[a:b].to_pylist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n += 1
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in texts[50:]]
    assert found == want and n > 20


def test_many_steps_in_a_task(make_docs, long_texts):
    """More text in one task than a step takes: every copy is found, equal texts share a component."""
    rows = long_texts + [(100 + i, t) for i, t in long_texts[::3]]  # equal texts
    want = brute(rows, 3, 85)
    found = near_groups(make_docs(rows, 1), words=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    of = {r["doc_id"]: r["component_id"] for r in found}
    assert all(of[i] == of[100 + i] for i, _ in long_texts[::3])
    assert sum(c < 40 for i, (_, c) in want.items() if 40 <= i < 80) == 40


def test_open_buckets_are_settled_exactly(make_docs, prose, monkeypatch):
    """One band of one row: everything of the group shares buckets, and few of it are linked through the leader."""
    base = prose(5, 120)
    rows = [(i, edited(edited(base, 9, i // 4), i % 4, 1000 + i)) for i in range(120)]
    found = near_groups(make_docs(rows), words=3, percent=85).collect()
    want = brute(rows, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert 10 < len({c for _, c in want.values()}) < 110


def test_null_and_repeated_ids(make_docs, clashing, prose):
    text, other = prose(1, 60), prose(2, 60)
    rows = [(None, text), (None, text + " end"), (7, text), (7, text), (8, other), (8, other + " end"), (None, prose(3, 60))]
    docs = clashing(make_docs(rows))
    found = near_groups(docs, words=3, percent=80).collect()
    assert sum(r["kept"] for r in found) == 3 and {r["component_id"] for r in found} == {7, 8, None}
    left = drop_near_copies(docs, words=3, percent=80)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["7", "8", "None"]


def test_empty_table(make_docs):
    assert near_groups(make_docs([])).collect() == [] and drop_near_copies(make_docs([])).collect() == []


def test_pairs_at_the_threshold_are_seldom_given_up():
    rules = least_agreements(0.85, 1e-7)
    assert [n for n, _ in rules] == list(range(32, 225, 32))
    draw, lost = random.Random(3), 0
    for _ in range(5000):
        agreed = [draw.random() < 0.85 for _ in range(224)]
        lost += any(sum(agreed[:n]) < least for n, least in rules)
    assert lost == 0 and rules[-1][1] > 0.6 * 224


def test_similarity_of_signatures():
    import numpy as np

    draw = np.random.default_rng(1)
    x = draw.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = near_dedup.signature(x[:900]), near_dedup.signature(x[100:])
    assert abs((a == b).mean() - 0.8) < 0.08


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(20, 40)] + [(39, 5), (7, 7), (300, 200), (200, 300)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys([5, *range(20, 40)], 5), 200: 200, 300: 200}


def test_hub_and_leaders_have_one_order(spark):
    """1 and 2 weigh the same, are one component, and 2 is a plain member of the bucket that 1 leads."""
    hubs = spark.createDataFrame([(10, 1, 5), (20, 2, 5)], "bucket long, node long, weight long")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "node long, label long")
    still = spark.createDataFrame([(10, 2, 1), (10, 3, 3), (20, 3, 3)], "bucket long, node long, label long")
    cell = lambda *x: bytearray(np.array(x, np.uint64).tobytes())
    sets = spark.createDataFrame([(1, cell(1, 2, 3)), (2, cell(1, 2, 4)), (3, cell(1, 5, 6))], "node long, shingles binary")
    found = near_dedup.deltas(still, hubs, labels, sets).select("hub", "node", "outside").collect()
    assert sorted(map(tuple, found)) == [(1, 2, False), (1, 3, True)]


def delta_table(spark, hub, sets, linked):
    """Differences of the sets from the hub, node 0; nodes in ``linked`` are of its component."""
    rows = [(len(hub), len(s), i not in linked, 0, i, bytearray(np.array(sorted(hub ^ s), np.uint64).tobytes())) for i, s in sets.items()]
    return spark.createDataFrame(rows, "hub_size long, size long, outside boolean, hub long, node long, delta binary")


def linked_sets(a, b):
    return 100 * len(a & b) >= 85 * len(a | b)


def test_nodes_far_from_all_others_are_in_no_bucket(spark):
    """Fifteen shingles of the hub are lost and fifteen new: any two differ in thirty at least, and twenty-four are allowed."""
    draw, hub = random.Random(5), set(range(1000, 1148))
    lost = [draw.randrange(1000, 1134) for _ in range(80)]
    sets = {i: hub - set(range(at, at + 15)) | {10_000 + 15 * i + k for k in range(15)} for i, at in enumerate(lost, 1)}
    assert not any(linked_sets(s, t) for i, s in sets.items() for j, t in sets.items() if i < j)
    assert near_dedup.delta_buckets(delta_table(spark, hub, sets, ()), 85).isEmpty()


def test_every_linked_pair_is_within_reach(spark):
    draw, hub = random.Random(6), set(range(1000, 1148))
    sets = {}
    for i in range(1, 161):
        old = sets[draw.randrange(1, i)] if i > 5 and draw.random() < 0.7 else hub
        gone = set(draw.sample(sorted(old), draw.randrange(2, 22)))
        sets[i] = (old - gone) | {draw.randrange(5000, 5400) for _ in range(draw.randrange(18))}
    sets |= {200 + i: hub | set(range(20_000 + 40 * i, 20_040 + 40 * i)) for i in range(20)}  # forty that nobody else has
    near = {i for i, s in sets.items() if linked_sets(s, hub)}
    delta = delta_table(spark, hub, sets, near)
    left = {r["node"]: r for r in near_dedup.within_reach(delta, 85).collect()}
    members = {}
    for r in near_dedup.delta_buckets(delta, 85).collect():
        members.setdefault(r["bucket"], []).append((r["node"], r["asks"], r["meets"]))
    met = {(x, y) for own in members.values() for x, asks, _ in own for y, _, meets in own if asks and meets}
    pairs = [(x, y) for x in sets for y in sets if x != y and x not in near and linked_sets(sets[x], sets[y])]
    assert len(pairs) > 30 and all(left[x]["asks"] and left[y]["meets"] for x, y in pairs)
    assert set(pairs) <= met and not any(i >= 200 for i in left)


def test_memory_of_a_batch(prose):
    """A batch of 8 MB is shingled a part at a time: what numpy and Python hold, without the texts, stays under 24 MB."""
    texts = pa.array([prose(i, 2000) for i in range(64)])
    texts = pa.concat_arrays([texts] * (1 + (8 << 20) // texts.nbytes))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["id", "text"])
    tracemalloc.start()
    n = sum(len(s) > 0 for _, some in steps(iter([batch]), near_dedup.SHINGLE_BYTES) for s in near_dedup.shingle_sets(some, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 24 << 20, peak


def test_batches_are_small_inside_only(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [len(batch)], "bytes": [batch.nbytes]})

    before = spark.conf.get(BATCH_KEY, None)
    # Pairs of sets as ``confirmed`` gets them, and one cell beyond the limit.
    cell = "case when id = 2000 then repeat('y', 9000000) else repeat('x', 4000) end as cell"
    rows = spark.range(0, 6000, 1, 1).selectExpr("id", cell)
    with pytest.raises(ZeroDivisionError), small_batches(spark):
        found = rows.mapInArrow(sizes, "rows long, bytes long").collect()
        raise ZeroDivisionError
    assert spark.conf.get(BATCH_KEY, None) == before
    assert sum(r["rows"] for r in found) == 6000 and len(found) > 5
    assert max(r["bytes"] for r in found) < BATCH_BYTES + 9_100_000
    assert sorted(r["bytes"] for r in found)[-2] < BATCH_BYTES + 100_000


def test_tables_are_written_in_small_batches(spark, make_docs, prose, monkeypatch):
    seen, rows = [], corpus(prose)
    usual = sorted(map(tuple, near_groups(make_docs(rows)).drop("tag").collect()), key=str)
    write = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: (seen.append((name, spark.conf.get(BATCH_KEY, None))), write(df, name))[1])
    monkeypatch.setattr("cohortspark.session.BATCH_BYTES", 1)  # a row at a time
    found = near_groups(make_docs(rows))
    assert {"sketches", "sets", "confirmed", "deltas"} <= {name for name, _ in seen} and {n for _, n in seen} == {"1"}
    assert sorted(map(tuple, found.drop("tag").collect()), key=str) == usual
