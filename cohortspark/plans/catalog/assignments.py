"""Splits and folds over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import folds, splits
from cohortspark.plans.benchmark import matrix_sizes, matrix_split
from cohortspark.plans.catalog.registry import (
    STUDY_SQL,
    bigint,
    key_sql,
    query,
    study_orders,
    table,
)
from cohortspark.roles import BenchmarkDefinition

GROUP_SQL = f"""
g AS (
  SELECT user_id, row_number() OVER (ORDER BY {key_sql('user_id')}, user_id) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT user_id FROM events)
),
cut AS (SELECT user_id, r, n, ceil(0.2::double * n) AS t FROM g),
lab AS (
  SELECT user_id,
         CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil(0.25::double * (n - t)) THEN 'validation' ELSE 'train' END AS split
  FROM cut
)"""


@query("group_split", f"WITH {GROUP_SQL} SELECT event_id, user_id, split FROM events JOIN lab USING (user_id)")
def group_split(spark, sf_dir):
    return splits.group_split(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id")


@query(
    "matrix_sizes",
    f"""
    WITH {GROUP_SQL}
    SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation,
           count(*) FILTER (split = 'test') AS n_test
    FROM events JOIN lab USING (user_id)
    """,
)
def matrix_sizes_query(spark, sf_dir):
    definition = BenchmarkDefinition("events-matrix", "1", "classification", "event_type", "subject", "user_id")
    return matrix_sizes(matrix_split(table(spark, sf_dir, "events"), definition))


@query(
    "random_split",
    f"""
    WITH r AS (
      SELECT o_orderkey, row_number() OVER (ORDER BY {key_sql('o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n
      FROM orders
    ),
    cut AS (SELECT *, ceil(0.2::double * n) AS t FROM r)
    SELECT o_orderkey,
           CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil(0.25::double * (n - t)) THEN 'validation' ELSE 'train' END AS split
    FROM cut
    """,
)
def random_split(spark, sf_dir):
    return splits.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "stratified_split",
    f"""
    WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
    size AS (SELECT sum(n)::bigint AS n, ceil(0.2::double * sum(n)::bigint)::bigint AS t FROM c),
    share1 AS (SELECT c.event_type, c.n, c.n * s.t / s.n::double AS e, s.t AS want FROM c, size s),
    quota1 AS (
      SELECT event_type, n, want,
             floor(e)::bigint + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, event_type)
                                          <= want - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS a
      FROM share1
    ),
    share2 AS (
      SELECT q.event_type, q.a, s.n - s.t AS left_rows, ceil(0.25::double * (s.n - s.t))::bigint AS want,
             (q.n - q.a) * ceil(0.25::double * (s.n - s.t))::bigint / (s.n - s.t)::double AS e
      FROM quota1 q, size s
    ),
    quota2 AS (
      SELECT event_type, a,
             floor(e)::bigint + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, event_type)
                                          <= want - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS b
      FROM share2
    ),
    r AS (
      SELECT event_id, event_type,
             row_number() OVER (PARTITION BY event_type ORDER BY {key_sql('event_id')}, event_id) AS r
      FROM events
    )
    SELECT event_id, event_type,
           CASE WHEN r <= a THEN 'test' WHEN r <= a + b THEN 'validation' ELSE 'train' END AS split
    FROM r JOIN quota2 USING (event_type)
    """,
)
def stratified_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return splits.stratified_split(events, "event_id", "event_type")


def _holdout_sql(levels: str) -> str:
    return f"""
    WITH {STUDY_SQL},
    lv AS (SELECT DISTINCT r_name AS level FROM study WHERE {levels}),
    dev AS (SELECT DISTINCT lv.level, s.o_custkey FROM study s JOIN lv ON s.r_name <> lv.level),
    g AS (
      SELECT level, o_custkey,
             row_number() OVER (PARTITION BY level ORDER BY {key_sql('o_custkey')}, o_custkey) AS r,
             count(*) OVER (PARTITION BY level) AS n
      FROM dev
    ),
    lab AS (SELECT level, o_custkey, CASE WHEN r <= ceil(0.2::double * n) THEN 'validation' ELSE 'train' END AS split FROM g)
    SELECT lv.level, s.o_orderkey,
           CASE WHEN s.r_name = lv.level THEN 'test' ELSE lab.split END AS split
    FROM study s CROSS JOIN lv LEFT JOIN lab ON lab.level = lv.level AND lab.o_custkey = s.o_custkey
    """


@query("holdout_split", f"SELECT o_orderkey, split FROM ({_holdout_sql('''r_name = 'ASIA' ''')})")
def holdout_split(spark, sf_dir):
    rows = study_orders(spark, sf_dir).select("o_orderkey", "o_custkey", "r_name")
    return splits.holdout_split(rows, "r_name", "ASIA", "o_custkey").select("o_orderkey", "split")


@query("leave_one_level_out", _holdout_sql("true"))
def leave_one_level_out(spark, sf_dir):
    rows = study_orders(spark, sf_dir)
    return splits.leave_one_level_out(rows, "o_orderkey", "r_name", "o_custkey")


@query(
    "forward_split",
    """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS t FROM orders),
    r AS (
      SELECT o_orderkey, t, row_number() OVER (ORDER BY t NULLS LAST, o_orderkey) AS r, count(*) OVER () AS n FROM o
    ),
    s AS (SELECT *, greatest(1, round_even(n * 0.2::double, 0)) AS k FROM r)
    SELECT o_orderkey, CASE WHEN r <= n - 2 * k THEN 'train' WHEN r <= n - k THEN 'validation' ELSE 'test' END AS split
    FROM s
    """,
)
def forward_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("t")
    )
    return splits.forward_split(orders, "o_orderkey", "t").select("o_orderkey", "split")


@query(
    "temporal_split",
    """
    WITH r AS (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders
    )
    SELECT o_orderkey, CASE WHEN r <= n - greatest(1, ceil(n * 0.2::double)) THEN 'development' ELSE 'test' END AS split
    FROM r
    """,
)
def temporal_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("seen"))
    return splits.temporal_split(orders, "o_orderkey", "seen").select("o_orderkey", "split")


@query(
    "temporal_group_split",
    """
    WITH o AS (
      SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS c, o_orderdate FROM orders
    ),
    last AS (SELECT c, max(o_orderdate) AS m FROM o WHERE c IS NOT NULL GROUP BY c),
    r AS (SELECT c, row_number() OVER (ORDER BY m, c) AS r, count(*) OVER () AS n FROM last)
    SELECT o_orderkey,
           CASE WHEN r > n - greatest(1, ceil(n * 0.2::double)) THEN 'test' ELSE 'development' END AS split
    FROM o LEFT JOIN r ON o.c = r.c
    """,
)
def temporal_group_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("c"), "o_orderdate"
    )
    out = splits.temporal_split(orders, "o_orderkey", "o_orderdate", group="c")
    return out.select("o_orderkey", "split")


@query(
    "kfold",
    f"""
    SELECT o_orderkey, ntile(5) OVER (ORDER BY {key_sql('o_orderkey')}, o_orderkey)::int AS fold FROM orders
    """,
)
def kfold(spark, sf_dir):
    return folds.kfold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@query(
    "stratified_kfold",
    f"""
    WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
    s AS (SELECT event_type, n, (coalesce(sum(n) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS start FROM c),
    f AS (
      SELECT event_type, fold,
             sum(n // 5 + CASE WHEN (fold - 1 - start % 5 + 5) % 5 < n % 5 THEN 1 ELSE 0 END)
               OVER (PARTITION BY event_type ORDER BY fold) AS hi
      FROM s, (SELECT unnest(generate_series(1, 5)) AS fold)
    ),
    r AS (
      SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {key_sql('event_id')}, event_id) AS r
      FROM events
    )
    SELECT event_id, r.event_type, min(fold)::int AS fold
    FROM r JOIN f ON r.event_type = f.event_type AND r.r <= f.hi GROUP BY 1, 2
    """,
)
def stratified_kfold(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return folds.stratified_kfold(events, "event_id", "event_type", 5)


PACKING_SQL = f"""
s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
o AS (
  SELECT user_id, n, row_number() OVER (ORDER BY n DESC, {key_sql('user_id')}, user_id) AS i FROM s
),
p AS (
  SELECT 0::bigint AS i, [0, 0, 0, 0, 0]::bigint[] AS loads, 0 AS fold
  UNION ALL
  SELECT q.i, list_transform([1, 2, 3, 4, 5], lambda k: q.loads[k] + CASE WHEN k = q.f THEN q.n ELSE 0 END)::bigint[], q.f
  FROM (SELECT o.i, o.n, p.loads, list_position(p.loads, list_min(p.loads))::int AS f FROM p JOIN o ON o.i = p.i + 1) q
)"""


@query(
    "group_kfold",
    f"WITH RECURSIVE {PACKING_SQL} SELECT event_id, user_id, fold::int AS fold FROM events JOIN o USING (user_id) JOIN p USING (i)",
)
def group_kfold(spark, sf_dir):
    return folds.group_kfold(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", 5)


@query(
    "group_kfold_sizes",
    f"""
    WITH RECURSIVE {PACKING_SQL}
    SELECT fold::int AS fold, count(*) AS groups, sum(n)::bigint AS n_rows FROM o JOIN p USING (i) GROUP BY 1
    """,
)
def group_kfold_sizes(spark, sf_dir):
    assigned = folds.group_folds(table(spark, sf_dir, "events"), "user_id", 5)
    return assigned.groupBy("fold").agg(
        bigint(F.count(F.lit(1)), "groups"), bigint(F.sum("n_rows"), "n_rows")
    )
