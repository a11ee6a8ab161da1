"""Exact top-k by inner product with M-trees.

Vectors become whole numbers. With M the largest norm in a tree, (x, sqrt(M^2 - |x|^2)) and (q, 0) are at a Euclidean
distance that falls as the inner product rises, so the k largest products are the k nearest neighbours in a metric space.

Index: each vector goes to the nearest of a bounded number of pivots, and large pivots are dealt over several trees of about
``TREE_ROWS`` vectors. Each tree is built by its own task into pages: a routing page holds its children's routing objects,
covering radii and distances to the parent; a leaf page holds vectors and their distances to the parent. The pages are a
table. Search: the query set is cut into blocks, each tree meets each block once; a query walks a tree's pages best first and
leaves out pages and entries whose stored distances rule them out by the triangle inequality, without computing a distance.

Every vector is indexed; pivots only decide which tree it lies in, never whether it is found.

Defined cases: vectors that are NULL or empty or hold a NULL or non-finite component, and rows without an id, take no part; vectors of
different lengths are never compared; equal scores go to the smaller id; rows that repeat an id count as candidates one by one, but
never for a query with that id; with fewer than k candidates all are returned; an empty table gives an empty result.
Products are exact while their terms sum to less than 2^53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import materialize

#: Vectors in a tree, entries in a page, queries that meet a tree at a time, routing pivots (a bounded sample of the vectors).
TREE_ROWS, PAGE_ROWS, QUERY_ROWS, PIVOTS = 4096, 128, 4096, 64
SCALE = 256
#: Slack for rounding, in units of a product.
SLACK = 0.25


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale x) of each component; NULL where the vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def quantized(rows: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """vec_id and vec of the rows that take part."""
    out = rows.select(
        rows[id_column].cast("long").alias("vec_id"), whole_numbers(rows[vector_column], scale).alias("vec")
    )
    return out.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def _with_height(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))])


def build_pages(ids: np.ndarray, vectors: np.ndarray, page_rows: int = PAGE_ROWS) -> list[dict]:
    """The pages of one tree; page 0 is the root. Entries of a page:

    ``points`` (routing objects or vectors, with the extra coordinate), ``parent`` (distance to the routing object of
    the page), and for routing pages ``child`` and ``radius``, for leaf pages ``ids``.
    """
    points = _with_height(vectors, float((vectors * vectors).sum(1).max()))
    pages: list[dict] = []

    def grow(rows: np.ndarray, routing: np.ndarray | None) -> int:
        at = len(pages)
        pages.append({})
        if len(rows) <= page_rows:
            parent = np.zeros(len(rows)) if routing is None else np.linalg.norm(points[rows] - routing, axis=1)
            order = np.lexsort((ids[rows], parent))
            pages[at] = {"points": points[rows[order]], "parent": parent[order], "ids": ids[rows[order]]}
            return at
        fan = min(page_rows, max(2, -(-2 * len(rows) // page_rows)))
        seeds = rows[np.linspace(0, len(rows) - 1, fan).astype(int)]
        seeds = seeds[np.unique(points[seeds], axis=0, return_index=True)[1]]
        apart = -2 * points[rows] @ points[seeds].T + (points[seeds] ** 2).sum(1)
        nearest = apart.argmin(1)
        parts = [(points[s], rows[nearest == i]) for i, s in enumerate(seeds) if (nearest == i).any()]
        if len(parts) == 1:  # equal vectors, or one seed nearest to all: cut evenly
            parts = [(parts[0][0], x) for x in np.array_split(rows, -(-len(rows) // page_rows))]
        objects = np.stack([p for p, _ in parts])
        radius = np.array([np.linalg.norm(points[x] - p, axis=1).max() for p, x in parts])
        parent = np.zeros(len(parts)) if routing is None else np.linalg.norm(objects - routing, axis=1)
        child = np.array([grow(x, p) for p, x in parts])
        pages[at] = {"points": objects, "parent": parent, "child": child, "radius": radius}
        return at

    grow(np.lexsort((ids, vectors[:, 0])), None)
    return pages


def search_pages(pages: list[dict], query: np.ndarray, own: int, k: int, count: list | None = None) -> list[tuple[int, int]]:
    """The k best (score, id) of one tree, best first. ``count`` gets [distances computed, distances left out]."""
    q = np.append(query, 0.0)
    norm = float(q @ q)
    top = float((pages[0]["points"][0] ** 2).sum())  # every point of a tree has the same norm
    best: list[tuple[int, int]] = []  # (score, -id): the worst is on top

    def farthest() -> float:
        """Beyond this distance a product is below the k-th."""
        if len(best) < k:
            return np.inf
        return float(np.sqrt(max(0.0, norm + top - 2 * (best[0][0] - SLACK))))

    queue = [(0.0, 0, None)]
    computed = skipped = 0
    while queue:
        near, at, to_parent = heapq.heappop(queue)
        limit = farthest()
        if near > limit:
            break
        page = pages[at]
        slack = page.get("radius", 0.0) + 1e-6
        if to_parent is None:
            seen = np.arange(len(page["points"]))
        else:
            seen = np.flatnonzero(np.abs(to_parent - page["parent"]) <= limit + slack)
        computed, skipped = computed + len(seen), skipped + len(page["points"]) - len(seen)
        if not len(seen):
            continue
        products = page["points"][seen] @ q
        if "ids" in page:
            found = page["ids"][seen]
            if len(best) == k:
                keep = products >= best[0][0] - SLACK
                products, found = products[keep], found[keep]
            for score, i in zip(np.rint(products).astype(np.int64).tolist(), found.tolist(), strict=True):
                if i != own:
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
        else:
            apart = np.sqrt(np.maximum(0.0, norm + top - 2 * products))
            least = np.maximum(0.0, apart - page["radius"][seen] - 1e-6)
            for i in np.flatnonzero(least <= limit):
                heapq.heappush(queue, (float(least[i]), int(page["child"][seen[i]]), float(apart[i])))
    if count is not None:
        count[0] += computed
        count[1] += skipped
    return [(s, -i) for s, i in sorted(best, reverse=True)]


PAGES = "tree string, page int, points binary, parent binary, child binary, radius binary, ids binary"


def build_index(
    vectors: DataFrame, tree_rows: int = TREE_ROWS, page_rows: int = PAGE_ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """All pages of all trees, as a written table; ``vectors`` has vec_id and vec."""
    vectors = materialize(vectors.select("vec_id", "vec", F.size("vec").alias("dims")), "vectors")
    pivots = min(pivots, -(-vectors.count() // tree_rows))
    near = vectors.select("dims", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    chosen = {d: _matrix([r["vec"] for r in near if r["dims"] == d]) for d in {r["dims"] for r in near}}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            pivot = np.zeros(len(frame), np.int64)
            for d, rows in frame.groupby("dims").indices.items():
                if d and d in chosen:
                    x = _matrix(frame["vec"].iloc[rows].tolist())
                    pivot[rows] = (2 * x @ chosen[d].T - (chosen[d] ** 2).sum(1)).argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), batch.column("dims"), pa.array(pivot)],
                names=["vec_id", "vec", "dims", "pivot"],
            )

    placed = vectors.mapInArrow(assign, "vec_id long, vec array<bigint>, dims int, pivot long")
    sizes = placed.groupBy("dims", "pivot").agg(F.ceil(F.count("*") / tree_rows).cast("int").alias("trees"))
    dealt = placed.join(sizes, ["dims", "pivot"]).withColumn(
        "tree", F.concat_ws("-", "dims", "pivot", F.pmod(F.xxhash64("vec_id", "vec"), F.col("trees")))
    )

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree = frame["tree"].iloc[0]
        pages = build_pages(frame["vec_id"].to_numpy(np.int64), _matrix(frame["vec"].tolist()), page_rows)
        cells = [
            {c: p[c].tobytes() if c in p else None for c in ("points", "parent", "child", "radius", "ids")} for p in pages
        ]
        return pd.DataFrame([{"tree": tree, "page": n, **c} for n, c in enumerate(cells)])

    return materialize(dealt.select("tree", "vec_id", "vec").groupBy("tree").applyInPandas(build, PAGES), "mtree")


def _pages(frame: pd.DataFrame) -> list[dict]:
    out = []
    for row in frame.sort_values("page").itertuples():
        parent = np.frombuffer(row.parent)
        page = {"points": np.frombuffer(row.points).reshape(len(parent), -1), "parent": parent}
        if row.ids is not None:
            page["ids"] = np.frombuffer(row.ids, np.int64)
        else:
            page["child"], page["radius"] = np.frombuffer(row.child, np.int64), np.frombuffer(row.radius)
        out.append(page)
    return out


def search(index: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each row of ``queries`` (vec_id and vec)."""
    blocks = max(1, -(-queries.count() // query_rows))
    trees = index.filter("page = 0").select(
        F.concat("tree", F.lit("")).alias("meets"), F.split("tree", "-")[0].cast("int").alias("dims")
    )
    asked = queries.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "vec", F.size("vec").alias("dims")
    ).join(trees, "dims")
    there = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def walk(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pages) and len(asked):
            tree = _pages(pages)
            for own, vector in zip(asked["vec_id"].tolist(), asked["vec"].tolist(), strict=True):
                rows += [(own, i, s) for s, i in search_pages(tree, np.asarray(vector, np.float64), own, k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    found = (
        there.groupBy("tree", "block")
        .cogroup(asked.groupBy("meets", "block"))
        .applyInPandas(walk, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
