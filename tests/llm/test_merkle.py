import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortspark.llm.merkle import folded, manifest, proof_digest, row_digest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes, fan):
    """Root, and for each node the siblings (before, after) level by level."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i // fan * fan
            proofs[k].append((nodes[first:i], nodes[i + 1 : first + fan]))
        nodes = [sha(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        at = [i // fan for i in at]
    return nodes[0], proofs


def brute(rows, fan=2):
    """doc_id, leaf, subroot, root, proof digest, folded root, whether it is the root; of rows in the order of FIELDS."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = climb([x[2] for x in groups[g]], fan)
    root, above = climb([trees[g][0] for g in order], fan)
    out = []
    for g, up in zip(order, above, strict=True):
        for (_, _, leaf, row), own in zip(groups[g], trees[g][1], strict=True):
            proof = own + up
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = leaf_of((*row[:3], row[3] + 1, row[4])) if tampered else leaf
            for before, after in proof:
                node = sha(*before, node, *after)
            digest = sha(*(h for before, after in proof for h in before + after))
            out.append((row[0], leaf, trees[g][0], root, digest, node, node == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def documents(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(partitions)


def proven(docs, **options):
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    also = {"claimed": F.when(tampered, row_digest(changed))}
    out = manifest(docs, fields, F.col("lang"), F.col("doc_id"), also, **options).proofs()
    out = out.withColumn("f", folded(F.coalesce("also_claimed", "leaf"), F.col("proof")))
    return out.select("key", "leaf", "subroot", "root", proof_digest(F.col("proof")), "f", F.col("f") == F.col("root")).collect()


def some_rows(n):
    """One group holds most rows; groups of one row, a NULL group, NULL fields, equal ids and equal rows."""
    rows = [(i, f"s{i % 3}", "en" if i % 3 else f"l{i % 7}", i, f"text {i}\n'") for i in range(n)]
    rows += [(n + i, None, None, None if i % 2 else 3, None) for i in range(5)]
    rows += [(n + 9, "s", "Z", 1, "ü"), (n + 9, "s", "é", 1, "漢"), (n + 10, "s", "", 0, "")]
    rows += [(3, "s0", "en", 3, "other text"), (3, "s0", "en", 3, "other text"), (None, "s", "en", 2, "no id"), (None, None, "en", 5, "x" * 100_000)]
    return rows


@pytest.mark.parametrize(("fan", "depth"), [(2, 8), (2, 2), (3, 1), (4, 2)])
def test_equals_brute_force(spark, clashing, fan, depth):
    """In one band and in many."""
    rows = some_rows(150)
    found = proven(clashing(documents(spark, rows)), fan=fan, depth=depth)
    assert ordered(found) == ordered(brute(rows, fan)) and {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 15, 16, 17])
def test_small_groups(spark, n):
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    assert ordered(proven(documents(spark, rows, 2), depth=2)) == ordered(brute(rows))


def test_nodes_cover_their_leaves(spark):
    made = manifest(documents(spark, some_rows(150)), [F.col(c) for c in FIELDS], F.col("lang"), F.col("doc_id"), depth=2)
    nodes = defaultdict(dict)
    for r in made.nodes().collect():
        assert (r["lo"], r["hi"]) not in nodes[r["group"], r["level"]]
        nodes[r["group"], r["level"]][r["lo"], r["hi"]] = r["hash"]
    for (group, level), own in nodes.items():
        ranges = sorted(own)
        assert ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        if level:
            for (lo, hi), node in own.items():
                assert node == sha(*(h for (a, b), h in sorted(nodes[group, level - 1].items()) if lo <= a and b <= hi))


def test_equal_rows_are_spread(spark):
    rows = [(7, "s", "en", 1, "same")] * 3000 + [(i, "s", "en", 1, "t") for i in range(1000)]
    assert ordered(proven(documents(spark, rows, 4), depth=4)) == ordered(brute(rows))


def test_empty_table(spark):
    made = manifest(documents(spark, []), [F.col(c) for c in FIELDS], F.col("lang"), F.col("doc_id"))
    assert made.proofs().collect() == [] and made.nodes().collect() == [] and made.roots.collect() == []


def test_query(spark, tmp_path):
    from cohortspark.llm.queries import op13_merkle_manifest

    rows = some_rows(300)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op13_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(found.collect()) == ordered(brute(rows))
