"""Audit, contracts, alignment and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators.align import align_modalities, concat_embeddings, merge_modalities, modality_table
from cohortspark.operators.audit import (
    condition_filter,
    definition_check,
    group_intersect,
    group_overlap,
    id_audit,
    integrity_report,
    integrity_warnings,
    missing_required_columns,
    protocol_gates,
    split_overlap,
)
from cohortspark.operators.omics import obs_table
from cohortspark.operators.splits import random_split
from cohortspark.plans.benchmark import matrix_union
from cohortspark.plans.catalog.registry import bigint, key_sql, query, r6, table
from cohortspark.roles import BenchmarkDefinition

DIRTY_SQL = """
dirty AS (
  SELECT CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 53 = 0 THEN 1 ELSE event_id END AS event_id,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 2 = 0 THEN NULL WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value,
         CASE WHEN event_id % 2 = 0 THEN NULL ELSE props END AS props
  FROM events
)"""


def dirty_events(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(i % 97 == 0, None).when(i % 53 == 0, 1).otherwise(i).cast("bigint").alias("event_id"),
        F.when(i % 11 != 0, F.col("user_id")).alias("user_id"),
        F.when(i % 13 != 0, F.col("event_type")).alias("event_type"),
        F.when(i % 2 == 0, None).when(i % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.when(i % 2 != 0, F.col("props")).alias("props"),
    )


REPORT_SQL = f"""
WITH {DIRTY_SQL},
r AS (
  SELECT count(*) AS n_rows, 4::bigint AS n_features, count(DISTINCT user_id) AS n_groups,
         (count(*) FILTER (event_id IS NULL) + count(*) FILTER (user_id IS NULL) + count(*) FILTER (event_type IS NULL)
          + count(*) FILTER (value IS NULL) + count(*) FILTER (props IS NULL)) / (count(*) * 5.0::double) AS missing_fraction,
         count(*) - count(DISTINCT event_id) - max(event_id IS NULL)::int AS duplicate_ids,
         count(*) FILTER (event_type IS NULL) AS target_missing
  FROM dirty
)
"""


@query(
    "integrity_report",
    REPORT_SQL
    + """
    SELECT n_rows, n_features, n_groups, round(missing_fraction, 6) + 0.0 AS missing_fraction,
           duplicate_ids::bigint AS duplicate_ids, target_missing, target_missing = 0 AS ok
    FROM r
    """,
)
def integrity_report_query(spark, sf_dir):
    report = integrity_report(dirty_events(spark, sf_dir), target="event_type", id="event_id", group="user_id")
    return report.select(
        "n_rows",
        "n_features",
        "n_groups",
        r6("missing_fraction", "missing_fraction"),
        "duplicate_ids",
        "target_missing",
        "ok",
    )


@query(
    "integrity_warnings",
    REPORT_SQL
    + """
    SELECT 'WARNING' AS severity, 'duplicate_ids' AS rule, duplicate_ids::bigint AS rows FROM r WHERE duplicate_ids > 0
    UNION ALL SELECT 'ERROR', 'target_missing', target_missing FROM r WHERE target_missing > 0
    UNION ALL SELECT 'WARNING', 'missing_fraction_high', NULL FROM r WHERE missing_fraction > 0.25
    UNION ALL SELECT 'WARNING', 'no_group_column', NULL FROM r
    """,
)
def integrity_warnings_query(spark, sf_dir):
    return integrity_warnings(dirty_events(spark, sf_dir), target="event_type", id="event_id", group=None)


@query(
    "id_audit",
    f"""
    WITH {DIRTY_SQL}
    SELECT count(*) AS n_rows, count(*) FILTER (event_id IS NULL) AS null_ids,
           (count(event_id) - count(DISTINCT event_id))::bigint AS duplicate_ids
    FROM dirty
    """,
)
def id_audit_query(spark, sf_dir):
    return id_audit(dirty_events(spark, sf_dir), "event_id")


@query(
    "definition_check",
    f"""
    WITH {DIRTY_SQL}
    SELECT 'events-check' AS benchmark_id, count(*) FILTER (event_type IS NULL) AS target_missing,
           count(*) FILTER (user_id IS NULL) AS group_missing
    FROM dirty
    """,
)
def definition_check_query(spark, sf_dir):
    definition = BenchmarkDefinition("events-check", "1", "classification", "event_type", "subject", "user_id")
    return definition_check(dirty_events(spark, sf_dir), definition)


@query(
    "condition_filter",
    "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view') AND event_type <> 'signup'",
)
def condition_filter_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return condition_filter(events, "event_type", ["error", "view"], ["signup"])


def doubled(labels):
    """Every label, under twice its id, so that either side has ids that the other lacks."""
    return labels.withColumn("doc_id", 2 * F.col("doc_id"))


@query(
    "align_modalities",
    """
    SELECT d.doc_id, d.lang, d.n_chars, l.n_chars AS labels__n_chars, l.quality
    FROM documents d JOIN (SELECT 2 * doc_id AS doc_id, quality, quality + toxic AS n_chars FROM labels) l USING (doc_id)
    """,
)
def align_modalities_query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = doubled(table(spark, sf_dir, "labels")).select(
        "doc_id", "quality", (F.col("quality") + F.col("toxic")).alias("n_chars")
    )
    return align_modalities({"documents": documents, "labels": labels}, "doc_id")


def _merge(how: str):
    def run(spark, sf_dir):
        documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
        labels = doubled(table(spark, sf_dir, "labels"))
        return merge_modalities(
            [modality_table(documents, "text", id="doc_id"), modality_table(labels, "label", id="doc_id")], how
        )

    return run


for _how, _join in {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "FULL"}.items():
    query(
        f"merge_{_how}",
        f"""
        SELECT doc_id, d.lang AS text__lang, d.n_chars AS text__n_chars, l.quality AS label__quality, l.toxic AS label__toxic
        FROM (SELECT doc_id, lang, n_chars FROM documents) d
        {_join} JOIN (SELECT 2 * doc_id AS doc_id, quality, toxic FROM labels) l USING (doc_id)
        """,
    )(_merge(_how))


@query(
    "concat_embeddings",
    """
    WITH u AS (
      SELECT vec_id, i::int AS feature, round(embedding[i + 1]::double, 6) + 0.0 AS value
      FROM embeddings, generate_series(0, 63) t(i)
      UNION ALL SELECT vec_id, 64::int, label::double FROM embeddings
    )
    SELECT vec_id, feature, value FROM u
    """,
)
def concat_embeddings_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    first = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    second = rows.select("vec_id", F.array(F.col("label").cast("double")).alias("v"))
    both = concat_embeddings({"signal": first, "label": second}, "vec_id")
    return both.select("vec_id", F.posexplode("v").alias("feature", "value")).select(
        "vec_id", "feature", r6("value", "value")
    )


RANDOM_SQL = f"""
ranked AS (
  SELECT event_id, user_id, row_number() OVER (ORDER BY {key_sql('event_id')}, event_id) AS r, count(*) OVER () AS n
  FROM events
),
cut AS (SELECT *, ceil(0.2::double * n) AS t FROM ranked),
split AS (
  SELECT event_id, user_id,
         CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil(0.25::double * (n - t)) THEN 'validation' ELSE 'train' END AS split
  FROM cut
)"""


@query(
    "group_overlap",
    f"""
    WITH {RANDOM_SQL}
    SELECT user_id, count(DISTINCT split) AS partitions FROM split GROUP BY user_id HAVING count(DISTINCT split) > 1
    """,
)
def group_overlap_query(spark, sf_dir):
    return group_overlap(random_split(table(spark, sf_dir, "events"), "event_id"), "user_id")


@query(
    "split_disjoint",
    "SELECT event_id, 2::bigint AS assignments FROM events WHERE event_id % 100 = 0",
)
def split_disjoint(spark, sf_dir):
    assigned = random_split(table(spark, sf_dir, "events").select("event_id"), "event_id")
    again = assigned.where("event_id % 100 = 0").withColumn("split", F.lit("test"))
    return split_overlap(assigned.unionByName(again), "event_id")


@query(
    "group_intersect",
    """
    SELECT user_id FROM events WHERE event_type = 'error'
    INTERSECT SELECT user_id + 1 AS user_id FROM events WHERE event_type <> 'error'
    """,
)
def group_intersect_query(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'error'")
    right = events.where("event_type <> 'error'").withColumn("user_id", F.col("user_id") + 1)
    return group_intersect(left, right, "user_id")


@query(
    "protocol_gates",
    f"""
    WITH {RANDOM_SQL},
    v AS (
      SELECT 'row_in_one_partition' AS gate,
             (SELECT count(*) FROM (SELECT event_id FROM split GROUP BY event_id HAVING count(*) > 1)) AS violations
      UNION ALL SELECT 'every_row_assigned', (SELECT count(*) FROM split WHERE split IS NULL)
      UNION ALL SELECT 'group_in_one_partition',
             (SELECT count(*) FROM (SELECT user_id FROM split GROUP BY user_id HAVING count(DISTINCT split) > 1))
    )
    SELECT gate, violations, violations = 0 AS passed FROM v
    """,
)
def protocol_gates_query(spark, sf_dir):
    rows = random_split(table(spark, sf_dir, "events"), "event_id")
    return protocol_gates(rows, id="event_id", group="user_id")


@query(
    "matrix_union",
    """
    SELECT 'orders' AS dataset, o_orderstatus AS level, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2
    """,
)
def matrix_union_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("level")).agg(
        bigint(F.count(F.lit(1)), "n")
    )
    events = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("level")).agg(
        bigint(F.count(F.lit(1)), "n")
    )
    return matrix_union([orders.withColumn("dataset", F.lit("orders")), events.withColumn("dataset", F.lit("events"))])


@query(
    "required_columns",
    """
    SELECT 'region' AS absent, count(*) AS n_rows FROM events UNION ALL SELECT 'study_id', count(*) FROM events
    """,
)
def required_columns_query(spark, sf_dir):
    """The required columns that the events lack, with the number of rows that lack them."""
    events = table(spark, sf_dir, "events")
    absent = missing_required_columns(events, ["event_id", "study_id", "user_id", "region"])
    return events.groupBy().agg(F.count("*").alias("n_rows")).select(
        F.explode(F.array(*[F.lit(c) for c in absent])).alias("absent"), "n_rows"
    )


@query(
    "obs_table",
    """
    SELECT o_orderkey AS cell_id, o_orderpriority, o_totalprice, coalesce(n, 0) AS n_lines
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    """,
)
def obs_table_query(spark, sf_dir):
    """Orders as cells: their metadata under a unique id."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    obs = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return obs_table(obs.fillna(0, ["n_lines"]), "o_orderkey", "cell_id")
