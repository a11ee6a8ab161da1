"""Metrics of scripted predictions, selection tables and cross-validation summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.operators import metrics
from cohortspark.plans.benchmark import best_run
from cohortspark.plans.catalog.registry import query, r6, rounded, table
from cohortspark.plans.crossval import rank_candidates

# y is binary, p a scripted score with ties, h a scripted class.
SCRIPT_SQL = """
s AS (
  SELECT event_id, user_id, event_type, value, (event_type IN ('error', 'purchase'))::int AS y,
         (event_id * 7919 % 1000) / 1000.0::double AS p,
         list_extract(['click', 'error', 'purchase', 'signup', 'other'], (event_id * 31 % 5)::int + 1) AS h,
         value * 0.9::double + event_id % 7 AS z
  FROM events
)"""


def scripted(spark, sf_dir):
    i = F.col("event_id")
    names = F.array(*[F.lit(v) for v in ("click", "error", "purchase", "signup", "other")])
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.col("event_type").isin("error", "purchase").cast("int").alias("y"),
        ((i * 7919 % 1000) / F.lit(1000.0)).alias("p"),
        F.element_at(names, (i * 31 % 5).cast("int") + 1).alias("h"),
        (F.col("value") * 0.9 + i % 7).alias("z"),
    )


@query(
    "classification_metrics",
    f"""
    WITH {SCRIPT_SQL},
    c AS (SELECT event_type AS y, h, count(*) AS n FROM s GROUP BY 1, 2),
    k AS (SELECT y AS label FROM c UNION SELECT h FROM c),
    l AS (
      SELECT label, coalesce((SELECT sum(n) FROM c WHERE y = label), 0) AS sup,
             coalesce((SELECT sum(n) FROM c WHERE h = label), 0) AS pr,
             coalesce((SELECT sum(n) FROM c WHERE y = label AND h = label), 0) AS tp
      FROM k
    )
    SELECT round(sum(tp) / sum(sup), 6) + 0.0 AS accuracy,
           round(avg(CASE WHEN sup > 0 THEN tp / sup END), 6) + 0.0 AS balanced_accuracy,
           round(avg(2.0 * tp / (sup + pr)), 6) + 0.0 AS f1_macro
    FROM l
    """,
)
def classification_metrics(spark, sf_dir):
    return rounded(metrics.classification_metrics(scripted(spark, sf_dir), "event_type", "h"))


AUC_SQL = f"""
WITH {SCRIPT_SQL},
c AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p),
w AS (
  SELECT pos, neg, sum(neg) OVER (ORDER BY p) - neg AS below,
         sum(pos) OVER (ORDER BY p DESC) AS rp, sum(pos + neg) OVER (ORDER BY p DESC) AS ra,
         sum(pos) OVER () AS np, sum(neg) OVER () AS nn
  FROM c
)
"""


@query(
    "auroc",
    AUC_SQL + "SELECT round(sum(pos * (below + neg / 2.0)) / (any_value(np) * any_value(nn)), 6) + 0.0 AS auroc FROM w",
)
def auroc(spark, sf_dir):
    return rounded(metrics.auroc(scripted(spark, sf_dir), "y", "p"))


@query(
    "auroc_by_user",
    f"""
    WITH {SCRIPT_SQL},
    r AS (
      SELECT user_id, y, rank() OVER w + (count(*) OVER (PARTITION BY user_id, p) - 1) / 2.0 AS r
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY p)
    ),
    a AS (SELECT user_id, sum(r) FILTER (y = 1) AS rs, sum(y) AS np, sum(1 - y) AS nn FROM r GROUP BY 1)
    SELECT user_id,
           CASE WHEN np * nn > 0 THEN round((rs - np * (np + 1) / 2.0) / (np * nn), 6) + 0.0 END::double AS auroc
    FROM a
    """,
)
def auroc_by_user(spark, sf_dir):
    out = metrics.auroc(scripted(spark, sf_dir), "y", "p", positive=1, by=["user_id"])
    return rounded(out, "user_id")


@query(
    "auprc",
    AUC_SQL + "SELECT round(sum(pos * rp / ra) / any_value(np), 6) + 0.0 AS auprc FROM w",
)
def auprc(spark, sf_dir):
    return rounded(metrics.auprc(scripted(spark, sf_dir), "y", "p", positive=1))


@query(
    "sens_spec",
    f"""
    WITH {SCRIPT_SQL}
    SELECT round(avg((p >= 0.5)::int) FILTER (y = 1), 6) + 0.0 AS sensitivity,
           round(avg((p < 0.5)::int) FILTER (y = 0), 6) + 0.0 AS specificity
    FROM s
    """,
)
def sens_spec(spark, sf_dir):
    rows = scripted(spark, sf_dir).withColumn("called", (F.col("p") >= 0.5).cast("int"))
    return rounded(metrics.sensitivity_specificity(rows, "y", "called", positive=1))


@query(
    "regression_metrics",
    f"""
    WITH {SCRIPT_SQL}
    SELECT event_type, round(avg(abs(value - z)), 6) + 0.0 AS mae, round(sqrt(avg((value - z) ** 2)), 6) + 0.0 AS rmse,
           round(1 - sum((value - z) ** 2) / (count(*) * var_pop(value)), 6) + 0.0 AS r2
    FROM s GROUP BY event_type
    """,
)
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(scripted(spark, sf_dir), "value", "z", ["event_type"]), "event_type")


@query("brier", f"WITH {SCRIPT_SQL} SELECT round(avg((p - y) ** 2), 6) + 0.0 AS brier FROM s")
def brier(spark, sf_dir):
    return rounded(metrics.brier(scripted(spark, sf_dir), "y", "p"))


# Scores are stretched so that some fall outside [0, 1].
BIN_SQL = f"""
WITH {SCRIPT_SQL},
q AS (SELECT y, p * 1.1::double - 0.05::double AS p FROM s),
b AS (
  SELECT y, p, CASE WHEN p BETWEEN 0 AND 1 THEN 1 + (SELECT count(*) FROM generate_series(1, 9) t(i) WHERE p >= i * 0.1::double) ELSE 0 END AS bin
  FROM q
),
t AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS mo FROM b GROUP BY bin)
"""


def _stretched(spark, sf_dir):
    return scripted(spark, sf_dir).withColumn("p", F.col("p") * 1.1 - 0.05)


@query(
    "calibration_bins",
    BIN_SQL
    + "SELECT bin::int AS bin, n, round(mp, 6) + 0.0 AS mean_probability, round(mo, 6) + 0.0 AS observed_rate FROM t",
)
def calibration_bins(spark, sf_dir):
    return rounded(metrics.calibration_bins(_stretched(spark, sf_dir), "y", "p"), "bin", "n")


@query(
    "ece",
    BIN_SQL
    + "SELECT round(sum(CASE WHEN bin > 0 THEN n * abs(mp - mo) ELSE 0 END) / sum(n), 6) + 0.0 AS ece FROM t",
)
def ece(spark, sf_dir):
    return rounded(metrics.ece(_stretched(spark, sf_dir), "y", "p"))


LONG_SQL = """
f AS (
  SELECT event_type AS model, 'm' || (user_id % 3) AS metric, user_id % 5 + 1 AS fold,
         CASE WHEN user_id % 5 = 3 AND event_type = 'view' THEN NULL ELSE avg(value) END AS value
  FROM events GROUP BY 1, 2, 3, user_id % 5
),
a AS (
  SELECT model, metric, avg(value) AS mean, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(value) END AS std, count(*) AS folds
  FROM f GROUP BY 1, 2
)"""


def fold_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    out = rows.groupBy(
        F.col("event_type").alias("model"),
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("metric"),
        (F.col("user_id") % 5 + 1).alias("fold"),
    ).agg(F.avg("value").alias("value"))
    gone = (F.col("fold") == 4) & (F.col("model") == "view")
    return out.withColumn("value", F.when(gone, F.lit(float("nan"))).otherwise(F.col("value")))


@query(
    "cv_aggregate",
    f"WITH {LONG_SQL} SELECT model, metric, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, folds FROM a",
)
def cv_aggregate(spark, sf_dir):
    return rounded(metrics.cv_aggregate(fold_metrics(spark, sf_dir)), "model", "metric", "folds")


@query(
    "rank_candidates",
    f"""
    WITH {LONG_SQL}
    SELECT row_number() OVER (ORDER BY mean DESC NULLS LAST, model)::int AS place, model, round(mean, 6) + 0.0 AS mean
    FROM a WHERE metric = 'm1'
    """,
)
def rank_candidates_query(spark, sf_dir):
    summary = metrics.cv_aggregate(fold_metrics(spark, sf_dir))
    ranked = rank_candidates(summary, "m1", maximise=True)
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc_nulls_last("mean"), "model"))
    return ranked.select(place.alias("place"), "model", r6("mean", "mean"))


@query(
    "best_run",
    f"""
    WITH {LONG_SQL}
    SELECT model, round(value, 6) + 0.0 AS value FROM f WHERE metric = 'm2' AND value IS NOT NULL
    ORDER BY f.value DESC, fold, model LIMIT 1
    """,
)
def best_run_query(spark, sf_dir):
    rows = fold_metrics(spark, sf_dir).select(
        F.col("fold").cast("string").alias("dataset"), "model", "metric", F.lit("validation").alias("split"), "value"
    )
    return best_run(rows, "m2").select("model", r6("value", "value"))
