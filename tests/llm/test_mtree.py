import numpy as np

from cohortspark.llm.mtree import build_index, build_pages, quantized, search, search_pages

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, asked, k):
    out = {}
    for q, v in asked:
        scored = sorted((-int(v @ x), i) for i, x in zip(ids, vectors, strict=True) if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def clustered(seed, n, dims=16, groups=20):
    draw = np.random.default_rng(seed)
    return np.floor(256 * (draw.normal(size=(groups, dims))[draw.integers(0, groups, n)] + 0.1 * draw.normal(size=(n, dims))))


def test_one_tree_is_exact_and_leaves_distances_out():
    vectors, ids = clustered(1, 3000), np.arange(3000)
    vectors[100:140] = vectors[50]
    pages = build_pages(ids, vectors, 32)
    count = [0, 0]
    asked = [(i, vectors[i]) for i in range(0, 3000, 50)]
    got = {q: [(i, s) for s, i in search_pages(pages, v, q, 5, count)] for q, v in asked}
    assert got == brute(ids, vectors, asked, 5)
    assert count[0] < 0.5 * 3000 * len(asked) and count[1] > 0


def test_pages_hold_what_their_bounds_say():
    vectors = clustered(2, 900)
    pages = build_pages(np.arange(900), vectors, 16)
    seen = []

    def below(at):
        page = pages[at]
        if "ids" in page:
            seen.extend(page["ids"].tolist())
            return page["points"]
        found = [below(c) for c in page["child"]]
        for p, r, c, x in zip(page["points"], page["radius"], page["child"], found, strict=True):
            assert np.linalg.norm(x - p, axis=1).max() <= r + 1e-6
            assert np.allclose(np.linalg.norm(pages[c]["points"] - p, axis=1), pages[c]["parent"])
        return np.concatenate(found)

    below(0)
    assert sorted(seen) == list(range(900)) and max(len(p["parent"]) for p in pages) <= 900


def test_search_equals_brute_force(spark, clashing):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(700, 8)).astype(np.float32) / 3
    x[30:60] = x[20]
    rows = [(i, x[i].tolist(), 1) for i in range(700)]
    odd = [(700, None, 1), (701, [], 1), (750, [float("nan")] * 8, 1), (751, [None] * 8, 1), (752, [1.0, float("inf")] + [0.0] * 6, 1), (None, [1.0] * 8, 1)]
    docs = clashing(spark.createDataFrame(rows + odd, SCHEMA))
    vectors = quantized(docs, "vec_id", "embedding")
    found = search(build_index(vectors, tree_rows=100, page_rows=16), vectors.filter("vec_id % 50 = 0"), 5, query_rows=5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    whole = np.floor(256 * x.astype(np.float64))
    assert got == brute(np.arange(700), whole, [(i, whole[i]) for i in range(0, 700, 50)], 5)


def test_few_candidates_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (50, [1.0], 1)]
    vectors = quantized(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    found = search(build_index(vectors), vectors.filter("vec_id % 50 = 0"), 5).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    assert got == [(0, 1, 2, 98304), (0, 2, 2, 98304), (50, 1, 1, 65536)]


def test_empty_table(spark):
    vectors = quantized(spark.createDataFrame([], SCHEMA), "vec_id", "embedding")
    assert search(build_index(vectors), vectors, 5).collect() == []
