"""Transforms and models fitted on training rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortspark.operators import prep
from cohortspark.operators.importance import permutation_importance, with_donors
from cohortspark.operators.models import build_model
from cohortspark.operators.reduce import fit_embedder, fit_supervised, pack
from cohortspark.plans.catalog.registry import query, r6, rounded, table

# Training rows: users not divisible by 5.  Some numbers and texts are removed first.
BASE_SQL = """
base AS (
  SELECT event_id, user_id % 5 <> 0 AS train, event_id % 3 = 0 AS flag,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value,
         cast(json_extract_string(props, '$.k') AS double) AS k,
         CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 1001 = 0 THEN 'rare' || user_id % 5 ELSE event_type END AS kind
  FROM events
)"""


def base(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 5 != 0).alias("train"),
        (i % 3 == 0).alias("flag"),
        F.when(i % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.when(i % 9 == 0, None)
        .when(i % 1001 == 0, F.concat(F.lit("rare"), F.col("user_id") % 5))
        .otherwise(F.col("event_type"))
        .alias("kind"),
    )


@query(
    "impute_median",
    f"""
    WITH {BASE_SQL}, m AS (SELECT quantile_cont(value, 0.5) AS mv, quantile_cont(k, 0.5) AS mk FROM base WHERE train)
    SELECT event_id, round(coalesce(value, mv), 6) + 0.0 AS value, round(coalesce(k, mk), 6) + 0.0 AS k FROM base, m
    """,
)
def impute_median(spark, sf_dir):
    rows = base(spark, sf_dir)
    out = prep.impute_median(rows, rows.where("train"), ["value", "k"])
    return rounded(out.select("event_id", "value", "k"), "event_id")


@query(
    "standard_scale",
    f"""
    WITH {BASE_SQL},
    m AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM base WHERE train)
    SELECT event_id, round((value - mv) / sv, 6) + 0.0 AS value, round((k - mk) / sk, 6) + 0.0 AS k FROM base, m
    """,
)
def standard_scale(spark, sf_dir):
    rows = base(spark, sf_dir)
    out = prep.standard_scale(rows, rows.where("train"), ["value", "k"])
    return rounded(out.select("event_id", "value", "k"), "event_id")


MODE_SQL = "mode_ AS (SELECT kind AS top FROM base WHERE train AND kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)"


@query(
    "impute_mode",
    f"WITH {BASE_SQL}, {MODE_SQL} SELECT event_id, coalesce(kind, top) AS kind FROM base, mode_",
)
def impute_mode(spark, sf_dir):
    rows = base(spark, sf_dir)
    return prep.impute_mode(rows, rows.where("train"), ["kind"]).select("event_id", "kind")


@query(
    "one_hot",
    f"""
    WITH {BASE_SQL}, known AS (SELECT DISTINCT kind FROM base WHERE train AND kind IS NOT NULL)
    SELECT event_id, coalesce('kind=' || known.kind, '') AS hot, (SELECT count(*) FROM known) AS width
    FROM base LEFT JOIN known ON base.kind = known.kind
    """,
)
def one_hot(spark, sf_dir):
    """The columns that are 1, and how many columns there are."""
    rows = base(spark, sf_dir)
    out = prep.one_hot(rows, rows.where("train"), "kind")
    columns = [c for c in out.columns if c.startswith("kind=")]
    hot = F.concat_ws(",", *[F.when(F.col(f"`{c}`") == 1, c) for c in columns])
    return out.select("event_id", hot.alias("hot"), F.lit(len(columns)).cast("bigint").alias("width"))


@query(
    "missing_indicator",
    f"WITH {BASE_SQL} SELECT event_id, (value IS NULL)::int AS value_missing FROM base",
)
def missing_indicator(spark, sf_dir):
    rows = base(spark, sf_dir)
    out = prep.missing_indicators(rows, rows.where("train"), ["value", "k"])
    return out.select("event_id", *[c for c in out.columns if c.endswith("_missing")])


@query(
    "preprocess_features",
    f"""
    WITH {BASE_SQL}, {MODE_SQL},
    d AS (SELECT quantile_cont(value, 0.5) AS dv, quantile_cont(k, 0.5) AS dk FROM base WHERE train),
    m AS (
      SELECT avg(coalesce(value, dv)) AS mv, stddev_pop(coalesce(value, dv)) AS sv, avg(coalesce(k, dk)) AS mk,
             stddev_pop(coalesce(k, dk)) AS sk, avg(flag::int) AS mf, stddev_pop(flag::int) AS sf
      FROM base, d WHERE train
    ),
    cats AS (SELECT DISTINCT kind AS c FROM base WHERE train AND kind IS NOT NULL)
    SELECT event_id, 'flag' AS slot, round((flag::int - mf) / sf, 6) + 0.0 AS x FROM base, m
    UNION ALL SELECT event_id, 'value', round((coalesce(value, dv) - mv) / sv, 6) + 0.0 FROM base, d, m
    UNION ALL SELECT event_id, 'k', round((coalesce(k, dk) - mk) / sk, 6) + 0.0 FROM base, d, m
    UNION ALL SELECT event_id, 'kind=' || c, (coalesce(kind, top) = c)::int::double FROM base, mode_, cats
    """,
)
def preprocess_features(spark, sf_dir):
    rows = base(spark, sf_dir)
    fitted = prep.fit_preprocessor(rows.where("train"), ["flag", "value", "k", "kind"])
    out = prep.apply_prep(fitted, rows.drop("train"))
    named = F.arrays_zip(
        F.array(*[F.lit(s) for s in fitted.slots]).alias("slot"), vector_to_array("features").alias("x")
    )
    return out.select("event_id", F.explode(named).alias("s")).select("event_id", "s.slot", r6("s.x", "x"))


@query(
    "pca2_variance",
    f"""
    WITH {BASE_SQL}, r AS (SELECT abs(corr(v, k)) AS r FROM (SELECT coalesce(value, 0) AS v, k FROM base))
    SELECT 0::int AS component, round(1 + r, 6) + 0.0 AS variance FROM r
    UNION ALL SELECT 1, round(1 - r, 6) + 0.0 FROM r
    """,
)
def pca2_variance(spark, sf_dir):
    rows = base(spark, sf_dir).select(
        "event_id", pack(["value", "k"]).alias("v")
    ).withColumn("v", F.transform("v", lambda x: F.when(F.isnan(x), 0.0).otherwise(x)))
    out = fit_embedder(rows, "event_id", "v", 2).transform(rows, "e")
    long = out.select(F.posexplode("e").alias("component", "x"))
    return long.groupBy("component").agg(r6(F.var_pop("x"), "variance"))


@query("tabular_embedding")
def tabular_embedding(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = fit_embedder(rows, "vec_id", "v", 32).transform(rows, "e")
    return out.select("vec_id", F.posexplode("e").alias("component", "x")).select("vec_id", "component", r6("x", "x"))


def _reduced(task: str, target: str):
    def run(spark, sf_dir):
        holes = F.transform(
            F.col("embedding").cast("array<double>"),
            lambda x, i: F.when((F.col("vec_id") + i) % 17 == 0, F.lit(float("nan"))).otherwise(x),
        )
        rows = table(spark, sf_dir, "embeddings").select(
            "vec_id", holes.alias("v"), "label", (F.col("label") * 1.5 + F.col("vec_id") % 7).alias("y")
        )
        fitted = fit_supervised(rows.where("vec_id % 4 <> 0"), "vec_id", "v", target, task, k=24, n_components=8)
        out = fitted.transform(rows, "e")
        return out.select("vec_id", F.posexplode("e").alias("component", "x")).select(
            "vec_id", "component", r6("x", "x")
        )

    return run


query("supervised_reduction")(_reduced("classification", "label"))
query("supervised_reduction_regression")(_reduced("regression", "y"))


@query(
    "ridge_1d",
    """
    WITH t AS (SELECT * FROM lineitem WHERE l_orderkey % 5 <> 0),
    m AS (
      SELECT count(*) AS n, avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my,
             covar_pop(l_quantity, l_extendedprice) AS c
      FROM t
    )
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(my + n * c / sx / (n + 1) * (l_quantity - mx) / sx, 4) + 0.0 AS prediction
    FROM lineitem, m
    """,
)
def ridge_1d(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    model = build_model("regression", "ridge").fit(
        rows.where("l_orderkey % 5 <> 0"), ["l_quantity"], "l_extendedprice"
    )
    out = model.transform(rows)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round("prediction", 4) + 0.0).alias("prediction")
    )


def _donor_sql(repeats: int) -> str:
    return f"""
    r AS (
      SELECT event_id, rep::int AS repeat, value, cast(json_extract_string(props, '$.k') AS double) AS k,
             substr(md5('42:' || rep || ':' || event_id), 1, 15) AS key
      FROM events, (SELECT unnest(generate_series(0, {repeats - 1})) AS rep)
    ),
    d AS (
      SELECT event_id, repeat, value, k,
             coalesce(lead(value) OVER w, first_value(value) OVER w) AS value_d,
             coalesce(lead(k) OVER w, first_value(k) OVER w) AS k_d
      FROM r WINDOW w AS (PARTITION BY repeat ORDER BY key, event_id)
    )"""


def _scored_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )


@query(
    "permutation_multiset",
    f"WITH {_donor_sql(2)} SELECT event_id, repeat, value_d AS value FROM d",
)
def permutation_multiset(spark, sf_dir):
    out = with_donors(_scored_events(spark, sf_dir), "event_id", ["value"], 2)
    return out.select("event_id", "repeat", F.col("donor.value").alias("value"))


@query(
    "permutation_importance_linear",
    f"""
    WITH {_donor_sql(10)},
    s AS (
      SELECT repeat, 'value' AS feature, 2 * value + 0.5 * k AS y, 2 * value_d + 0.5 * k AS p FROM d
      UNION ALL SELECT repeat, 'k', 2 * value + 0.5 * k, 2 * value + 0.5 * k_d FROM d
    ),
    q AS (
      SELECT feature, repeat, 1 - (1 - sum((y - p) ** 2) / (count(*) * var_pop(y))) AS drop_ FROM s GROUP BY 1, 2
    )
    SELECT feature, round(avg(drop_), 6) + 0.0 AS importance_mean, round(stddev_pop(drop_), 6) + 0.0 AS importance_std
    FROM q GROUP BY feature
    """,
)
def permutation_importance_linear(spark, sf_dir):
    rows = _scored_events(spark, sf_dir).withColumn("y", 2 * F.col("value") + 0.5 * F.col("k"))

    def linear(df):
        return df.withColumn("prediction", 2 * F.col("value") + 0.5 * F.col("k"))

    out = permutation_importance(linear, rows, "event_id", ["value", "k"], "y", scoring="r2")
    return rounded(out, "feature")


def _holed(spark, sf_dir):
    """Embeddings with a missing position in nine."""
    holes = F.transform(
        F.col("embedding").cast("array<double>"), lambda x, i: F.when((F.col("vec_id") + 5 * i) % 9 != 0, x)
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", holes.alias("v"))


HOLED_SQL = """
    long AS (
      SELECT vec_id, i, CASE WHEN (vec_id + 5 * i) % 9 <> 0 THEN embedding[i + 1]::double END AS x
      FROM embeddings, (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings))) AS i)
    ),
    med AS (SELECT i, quantile_cont(x, 0.5) AS m FROM long WHERE vec_id % 4 <> 0 GROUP BY 1),
    filled AS (SELECT vec_id, i, coalesce(x, m) AS x FROM long JOIN med USING (i)),
    mom AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM filled WHERE vec_id % 4 <> 0 GROUP BY 1)"""


@query(
    "preprocess_array",
    f"""
    WITH {HOLED_SQL}
    SELECT vec_id, i::int AS position, round((x - mu) / sd, 6) + 0.0 AS x FROM filled JOIN mom USING (i)
    """,
)
def preprocess_array(spark, sf_dir):
    """Every position of an array column imputed and standardised by the training rows."""
    rows = _holed(spark, sf_dir)
    fitted = prep.fit_preprocessor(rows.where("vec_id % 4 <> 0"), ["v"])
    out = prep.apply_prep(fitted, rows).select("vec_id", F.posexplode(vector_to_array("features")).alias("position", "x"))
    return out.select("vec_id", "position", r6("x", "x"))


@query(
    "ridge_array",
    """
    WITH s AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS y, l_orderkey % 5 <> 0 AS train,
             l_quantity AS a, l_discount AS b FROM lineitem),
    m AS (
      SELECT count(*) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my,
             corr(a, b) * count(*) AS c, covar_pop(a, y) / stddev_pop(a) * count(*) AS ca,
             covar_pop(b, y) / stddev_pop(b) * count(*) AS cb
      FROM s WHERE train),
    w AS (
      SELECT *, ((n + 3) * ca - c * cb) / ((n + 3) * (n + 3) - c * c) AS wa,
             ((n + 3) * cb - c * ca) / ((n + 3) * (n + 3) - c * c) AS wb FROM m)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(my + wa * (a - ma) / sa + wb * (b - mb) / sb, 4) + 0.0 AS prediction
    FROM s, w
    """,
)
def ridge_array(spark, sf_dir):
    """Two features in one array; the penalised normal equations have a closed form."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", pack(["l_quantity", "l_discount"]).alias("v")
    )
    model = build_model("regression", "ridge", alpha=3.0).fit(rows.where("l_orderkey % 5 <> 0"), ["v"], "l_extendedprice")
    return model.transform(rows).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round("prediction", 4) + 0.0).alias("prediction")
    )
