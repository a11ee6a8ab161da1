import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortspark.llm.trie import Minima, Parentheses, rerooted, sequences, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = own + sum(saved[x] for x in children[node])
    out = []
    for node, some in members.items():
        ids = ",".join(map(str, sorted(ends[node])))
        up = min(members[node[:-1]]) if node else None
        out.append((min(some), len(node), up, len(some), len(children[node]), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations(n, seed=3):
    """Many share first turns, some are equal, some are prefixes of others, turns have gaps."""
    draw, rows = random.Random(seed), []
    for c in range(n):
        if c % 17 == 4:
            continue
        style = draw.random()
        words = ["hi", "the same start", "ä", ""] if style < 0.4 else ["x", "y", f"own {c}"]
        for t in range(draw.choice([1, 2, 3, 6, 9, 11])):
            text = words[0] if t < 3 and style < 0.5 else draw.choice(words)
            rows.append((c, 3 * t, ["user", "assistant", None][t % 2 if draw.random() < 0.95 else 2], text if draw.random() < 0.97 else None))
    rows += [(None, 0, "user", "lost"), (3000, None, "user", "b"), (3000, 0, "user", "a"), (4004, 1, "user", "short")]
    return rows


def found(convs, **options):
    return sorted(map(tuple, trie(convs, **options).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize(("size", "partitions"), [(200_000, 2), (1, 2), (7, 5), (60, 3)])
def test_equals_brute_force(spark, size, partitions):
    """However the conversations are dealt to shards."""
    rows = conversations(300)
    convs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(rerooted(sequences(convs, family=5)), nodes_per_shard=size) == brute(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_plain_conversations_with_clashing_columns(spark, clashing):
    rows = conversations(60, 5)
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items() if c is not None}
    assert found(sequences(clashing(spark.createDataFrame(rows, SCHEMA)))) == brute(own)


def test_conversations_without_turns(spark):
    """Only later turns than h stay where no base is; a few conversations lose all of theirs."""
    rows = [(5 * i + 1, 0, "user", "x") for i in range(40)]
    want = brute(rebuilt(rows))
    assert found(rerooted(sequences(spark.createDataFrame(rows, SCHEMA), family=5))) == want
    rows = [(c, 0, "user", "x") for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    (root,) = found(rerooted(sequences(spark.createDataFrame(rows, SCHEMA), family=5)))
    assert root[:7] == (1, 0, None, len(rows), 0, 1, 0)


def test_hot_conversation_and_deep_one(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 9000, 2) for t in range(2)]
    rows += [(10_001, t, "user", str(t % 7)) for t in range(3000)]
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    got = {r[:2]: r for r in found(sequences(spark.createDataFrame(rows, SCHEMA)), nodes_per_shard=500)}
    ids = ",".join(str(c) for c in range(0, 9000, 2))
    assert got[0, 2] == (0, 2, 0, 4500, 0, 1, 4499 * 6, hashlib.sha256(ids.encode()).hexdigest())
    assert got[0, 0][3:7] == (4501, 2, 2, 4499 * 12) and got[10_001, 3000][4:6] == (0, 1) and len(got) == 3003


def test_empty_table(spark):
    assert trie(sequences(spark.createDataFrame([], SCHEMA))).collect() == []


def test_parentheses():
    draw = random.Random(1)
    bits, depth = [True], 1
    while depth:
        up = draw.random() < (0.55 if len(bits) < 3000 else 0.0)
        bits.append(up)
        depth += 1 if up else -1
        if not depth and len(bits) < 3000:
            bits[-1], depth = True, 2
    stack, closes, opens = [], {}, [i for i, b in enumerate(bits) if b]
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            closes[stack.pop()] = i
    tree = Parentheses(np.array(bits))
    assert tree.closes.tolist() == [closes[i] for i in opens]
    values = np.array([draw.randrange(100) for _ in opens])
    for k, i in list(enumerate(opens))[::37]:
        inside = [n for n, j in enumerate(opens) if i <= j < closes[i]]
        assert tree.sums(values)[k] == values[inside].sum() and tree.ends[k] == inside[-1] + 1
        assert Minima(values).least(np.array([k]), np.array([inside[-1] + 1]))[0] == values[inside].min()
