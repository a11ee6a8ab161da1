"""Sources, sinks and projections."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.feather as feather
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortspark.operators.align import modality_table
from cohortspark.operators.fingerprint import keyed_fingerprint, multiset_fingerprint
from cohortspark.plans.catalog.registry import query, table
from cohortspark.roles import Cohort, Roles
from cohortspark.session import scratch_path
from cohortspark.sources.files import file_checksums, verify_files
from cohortspark.sources.manifests import CardFields, dataset_card, load_sample_manifest
from cohortspark.sources.paths import arrow_store
from cohortspark.sources.predictions import (
    duplicate_predictions,
    evaluation_table,
    export_evaluation,
    export_predictions,
    load_predictions,
    prediction_table,
)
from cohortspark.sources.tables import (
    canonicalize_columns,
    feature_matrix,
    load_csv,
    load_feather,
    load_table,
)


@query(
    "scan_csv",
    """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
    FROM orders
    """,
)
def scan_csv(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = orders.select(
        "o_orderkey",
        "o_custkey",
        F.when(key % 10 == 0, "NA").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 7 == 0, "nan").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        "o_orderpriority",
    )
    path = scratch_path(spark, "orders") + ".csv"
    text.write.option("header", True).csv(path)
    return load_csv(spark, path)


@query("scan_tsv", "SELECT c_custkey, c_name, c_nationkey::bigint AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_tsv(spark, sf_dir):
    path = scratch_path(spark, "customer") + ".tsv"
    table(spark, sf_dir, "customer").write.option("header", True).option("sep", "\t").csv(path)
    return load_table(spark, path)


@query(
    "scan_parquet",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25",
)
def scan_parquet(spark, sf_dir):
    lines = load_table(spark, f"{sf_dir}/lineitem.parquet")
    kept = lines.where("l_returnflag = 'R' and l_quantity > 25")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("scan_feather", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def scan_feather(spark, sf_dir):
    path = scratch_path(spark, "part")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")

    def write(batches):
        """One file per task, written under its partition number so a retry replaces it."""
        from pyspark import TaskContext

        held = list(batches)
        if held:
            store, root = arrow_store(path)
            store.create_dir(root, recursive=True)
            name = f"{root}/part-{TaskContext.get().partitionId():05d}.feather"
            with store.open_output_stream(name) as out:
                feather.write_feather(pa.Table.from_batches(held), out)
        yield pa.RecordBatch.from_pydict({"rows": [sum(b.num_rows for b in held)]})

    part.repartition(4, "p_partkey").mapInArrow(write, "rows bigint").agg(F.sum("rows")).collect()
    return load_feather(spark, path, part.schema)


@query("feature_matrix", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def feature_matrix_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    return feature_matrix(lines, "l_returnflag", ["l_orderkey", "l_linenumber"])[0]


@query("feature_matrix_target", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def feature_matrix_target(spark, sf_dir):
    return feature_matrix(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber"])[1]


@query("canonical_columns", "SELECT s_suppkey AS supp_key, s_name AS name, s_acctbal AS acct_bal FROM supplier")
def canonical_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias(" supp key "),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("name "),
        F.col("s_acctbal").alias("acct bal"),
    )
    return canonicalize_columns(raw)


@query(
    "role_projection",
    "SELECT event_type, value, props FROM events",
)
def role_projection(spark, sf_dir):
    roles = Roles("event_id", "is_error", "user_id", "ts")
    events = table(spark, sf_dir, "events").withColumn("is_error", F.col("event_type") == "error")
    return Cohort(events, roles).view("feature")


@query("modality_table", "SELECT doc_id, lang, source, n_chars FROM documents")
def modality_table_query(spark, sf_dir):
    return modality_table(table(spark, sf_dir, "documents"), "text", id="doc_id", drop=["text", "absent"]).df


@query(
    "file_checksums",
    """
    SELECT string_split(filename, '/')[-1] AS file, size::bigint AS size_bytes, sha256(content) AS sha256
    FROM read_blob('/root/testdata/sf0.01/*.parquet')
    """,
)
def file_checksums_query(spark, sf_dir):
    return file_checksums(spark, sf_dir, "*.parquet")


@query(
    "file_verification",
    """
    SELECT string_split(filename, '/')[-1] AS file,
           CASE WHEN filename LIKE '%/nation.parquet' THEN 'mismatch' ELSE 'match' END AS status
    FROM read_blob('/root/testdata/sf0.01/*.parquet')
    UNION ALL SELECT 'absent.parquet', 'missing'
    """,
)
def file_verification(spark, sf_dir):
    actual = file_checksums(spark, sf_dir, "*.parquet")
    expected = actual.select(
        "file", F.when(F.col("file") == "nation.parquet", "00").otherwise(F.col("sha256")).alias("sha256")
    )
    absent = actual.limit(1).select(F.lit("absent.parquet").alias("file"), "sha256")
    return verify_files(actual, expected.unionByName(absent)).select("file", "status")


@query(
    "sample_manifest",
    """
    SELECT r_name AS accession, n_nationkey::bigint AS sample_id, n_name AS title
    FROM region JOIN nation ON n_regionkey = r_regionkey
    """,
)
def sample_manifest(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    nested = (
        region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("accession"))
        .agg(F.collect_list(F.struct(F.col("n_nationkey").alias("sample_id"), F.col("n_name").alias("title"))).alias("samples"))
    )
    path = scratch_path(spark, "manifests")
    nested.write.option("maxRecordsPerFile", 1).json(path)
    return load_sample_manifest(spark, path).select("accession", "sample_id", "title")


PROB = "(event_id * 7919 % 1000) / 1000.0::double"


@query(
    "predictions_v1",
    f"""
    SELECT event_id AS sample_id, CASE WHEN {PROB} >= 0.5 THEN 1 ELSE 0 END::bigint AS prediction,
           'validation' AS split, 'scripted' AS model_name, {PROB} AS probability
    FROM events
    """,
)
def predictions_v1(spark, sf_dir):
    p = (F.col("event_id") * 7919 % 1000) / F.lit(1000.0)
    scored = table(spark, sf_dir, "events").select(
        "event_id",
        (p >= 0.5).cast("int").alias("prediction"),
        array_to_vector(F.array(1 - p, p)).alias("probability"),
    )
    out = prediction_table(
        scored, id="event_id", probability="probability", split="validation", model_name="scripted"
    )
    path = scratch_path(spark, "predictions") + ".csv"
    return load_predictions(spark, export_predictions(out, path))


@query(
    "predictions_duplicates",
    "SELECT user_id AS sample_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1",
)
def predictions_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "value")
    return duplicate_predictions(prediction_table(rows, id="user_id", prediction="value"))


@query(
    "predictions_eval",
    f"""
    SELECT cast(event_id AS varchar) AS sample_id, event_type AS y_true,
           CASE WHEN {PROB} >= 0.5 THEN 'error' ELSE 'view' END AS y_pred, {PROB} AS score
    FROM events
    """,
)
def predictions_eval(spark, sf_dir):
    p = (F.col("event_id") * 7919 % 1000) / F.lit(1000.0)
    scored = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(p >= 0.5, "error").otherwise("view").alias("prediction"), p.alias("score")
    )
    out = evaluation_table(scored, id="event_id", y="event_type", score="score")
    path = scratch_path(spark, "evaluation") + ".json"
    return spark.read.schema(out.schema).json(export_evaluation(out, path))


@query(
    "dataset_card",
    """
    SELECT 'orders' AS dataset_id, 'retail' AS modality, 'regression' AS task, 'unknown' AS license,
           count(*) AS n_samples, count(DISTINCT o_custkey) AS study_groups
    FROM orders
    """,
)
def dataset_card_query(spark, sf_dir):
    fields = CardFields("orders", "generated", "none", "none", "none", "retail", "regression")
    card = dataset_card(table(spark, sf_dir, "orders"), fields, study_group="o_custkey")
    return card.select("dataset_id", "modality", "task", "license", "n_samples", "study_groups")


def _text_sql(column: str) -> str:
    text = f"cast({column} AS varchar)"
    return f"coalesce(length({text})::varchar || ':' || {text}, '\\N')"


def _fingerprint_sql(source: str, columns: dict[str, str]) -> str:
    import json

    schema = json.dumps(list(columns.items())).replace("'", "''")
    row = "concat_ws('|', " + ", ".join(_text_sql(c) for c in columns) + ")"
    return f"""
    WITH t AS (SELECT {row} AS t FROM {source}),
    s AS (
      SELECT count(*) AS n_rows,
             cast(sum(('0x' || substr(md5(t), 1, 8))::bigint) AS varchar) AS hash_sum,
             bit_xor(('0x' || substr(md5(t), 1, 15))::bigint) AS hash_xor
      FROM t
    )
    SELECT n_rows, hash_sum, hash_xor,
           sha256(concat_ws('/', '{schema}', n_rows, hash_sum, hash_xor)) AS fingerprint
    FROM s
    """


NULLED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderpriority FROM orders)"


def _nulled_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderpriority"
    )


@query(
    "fingerprint_rows",
    _fingerprint_sql(NULLED, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderpriority": "string"}),
)
def fingerprint_rows(spark, sf_dir):
    return keyed_fingerprint(_nulled_orders(spark, sf_dir), "o_orderkey")


@query(
    "fingerprint_multiset",
    _fingerprint_sql(NULLED, {"o_custkey": "bigint", "o_orderkey": "bigint", "o_orderpriority": "string"}),
)
def fingerprint_multiset(spark, sf_dir):
    return multiset_fingerprint(_nulled_orders(spark, sf_dir).select("o_orderpriority", "o_orderkey", "o_custkey"))
