"""Fitted models with a closed form: inputs that only tell groups apart, and workflows around a one-feature line."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators.calibration import calibrate
from cohortspark.operators.isotonic import Isotonic
from cohortspark.operators.models import BOOSTING, build_model
from cohortspark.operators.reduce import fit_supervised, pack
from cohortspark.plans.benchmark import run_matrix_job
from cohortspark.plans.catalog.closed_forms import CONFIG, DEFINITION, ROLES, SPLIT_SQL, line_cohort
from cohortspark.plans.catalog.registry import key_sql, query, r6, rounded, table
from cohortspark.plans.train import train
from cohortspark.roles import Cohort
from cohortspark.session import scratch_path
from cohortspark.sources.runs import load_run, save_run

PAIR_SQL = """
pair AS (
  SELECT event_id, (event_id % 3 = 0)::int AS b, value,
         CASE WHEN event_id % 3 = 0 THEN (event_id % 5 <> 0)::int ELSE (event_id % 7 = 0)::int END AS hit
  FROM events
)"""


def pair(spark, sf_dir):
    """One boolean feature; the class and the value differ between its two groups."""
    b = F.col("event_id") % 3 == 0
    hit = F.when(b, F.col("event_id") % 5 != 0).otherwise(F.col("event_id") % 7 == 0)
    return table(spark, sf_dir, "events").select("event_id", b.cast("int").alias("b"), "value", hit.cast("int").alias("hit"))


def scored(rows, task: str, name: str, target: str, digits: int, **params):
    out = build_model(task, name, **params).fit(rows, ["b"], target).transform(rows)
    value = "prediction" if task == "regression" else "score"
    return out.select("event_id", (F.round(value, digits) + 0.0).alias(value))


@query("gbt_regressor_boolean", f"WITH {PAIR_SQL} SELECT event_id, round(avg(value) OVER (PARTITION BY b), 6) + 0.0 AS prediction FROM pair")
def gbt_regressor_boolean(spark, sf_dir):
    """The first tree holds the group means, and the residuals' means are 0."""
    return scored(pair(spark, sf_dir), "regression", "hist_gradient_boosting", "value", 6)


@query(
    "gbt_classifier_boolean",
    f"""
    WITH RECURSIVE {PAIR_SQL},
    g AS (SELECT b, avg(hit) AS p FROM pair GROUP BY b),
    boost AS (
      SELECT b, p, 1 AS m, 2 * p - 1 AS f FROM g
      UNION ALL
      SELECT b, p, m + 1, f + {BOOSTING["learning_rate"]}::double * (p * 4 / (1 + exp(2 * f)) - (1 - p) * 4 / (1 + exp(-2 * f)))
      FROM boost WHERE m < {BOOSTING["max_iter"]}
    )
    SELECT event_id, round(1 / (1 + exp(-2 * f)), 6) + 0.0 AS score FROM pair JOIN boost USING (b) WHERE m = {BOOSTING["max_iter"]}
    """,
)
def gbt_classifier_boolean(spark, sf_dir):
    """Each round moves a group's margin by the mean of its residuals."""
    return scored(pair(spark, sf_dir), "classification", "hist_gradient_boosting", "hit", 6)


@query("mlp_regressor_boolean", f"WITH {PAIR_SQL} SELECT event_id, round(avg(value) OVER (PARTITION BY b), 2) + 0.0 AS prediction FROM pair")
def mlp_regressor_boolean(spark, sf_dir):
    return scored(
        pair(spark, sf_dir), "regression", "mlp", "value", 2, hidden=(4,), early_stopping=False, tol=0.0
    )


@query("logistic_boolean", f"WITH {PAIR_SQL} SELECT event_id, round(avg(hit) OVER (PARTITION BY b), 4) + 0.0 AS score FROM pair")
def logistic_boolean(spark, sf_dir):
    """With hardly any penalty the scores are the groups' shares."""
    return scored(pair(spark, sf_dir), "classification", "logistic_regression", "hit", 4, C=1e9)


@query("pca_logistic_boolean", f"WITH {PAIR_SQL} SELECT event_id, round(avg(hit) OVER (PARTITION BY b), 4) + 0.0 AS score FROM pair")
def pca_logistic_boolean(spark, sf_dir):
    """One component of one feature; with hardly any penalty the scores are the groups' shares."""
    return scored(
        pair(spark, sf_dir), "classification", "pca_then_logistic_regression", "hit", 4, C=1e9, n_components=1
    )


@query("pca_mlp_boolean", f"WITH {PAIR_SQL} SELECT event_id, round(avg(hit) OVER (PARTITION BY b), 3) + 0.0 AS score FROM pair")
def pca_mlp_boolean(spark, sf_dir):
    return scored(
        pair(spark, sf_dir), "classification", "pca_then_mlp", "hit", 3,
        hidden=(4,), early_stopping=False, tol=0.0, n_components=1,
    )


@query(
    "calibrated_isotonic_boolean",
    f"""
    WITH {PAIR_SQL},
    c AS (SELECT hit, count(*) AS n FROM pair GROUP BY 1),
    s AS (SELECT hit, n, coalesce(sum(n) OVER (ORDER BY hit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM c),
    f AS (
      SELECT hit, fold,
             sum(n // 5 + CASE WHEN (fold - 1 - start % 5 + 5) % 5 < n % 5 THEN 1 ELSE 0 END) OVER (PARTITION BY hit ORDER BY fold) AS hi
      FROM s, (SELECT unnest(generate_series(1, 5)) AS fold)
    ),
    r AS (SELECT event_id, b, hit, row_number() OVER (PARTITION BY hit ORDER BY {key_sql('event_id')}, event_id) AS r FROM pair),
    folded AS (
      SELECT event_id, b, r.hit, min(fold) AS fold FROM r JOIN f ON r.hit = f.hit AND r.r <= f.hi GROUP BY 1, 2, 3
    ),
    shares AS (SELECT b, fold, avg(hit) AS p FROM folded GROUP BY 1, 2),
    mean_ AS (SELECT b, avg(p) AS p FROM shares GROUP BY 1)
    SELECT event_id, (p > 0.5)::int AS prediction, round(p, 6) + 0.0 AS score FROM pair JOIN mean_ USING (b)
    """,
)
def calibrated_isotonic_boolean(spark, sf_dir):
    """Two margins: each fold's calibrator has that fold's shares, the model their mean."""
    rows = pair(spark, sf_dir).drop("value")
    spec = build_model("classification", "logistic_regression")
    fitted = calibrate(spec, rows, "event_id", ["b"], "hit", method="isotonic", cv=5)
    return fitted.transform(rows).select("event_id", "prediction", r6("score", "score"))


@query(
    "isotonic_fit",
    """
    WITH m AS (
      SELECT (DATE '2000-01-01' - l_shipdate::date)::double AS margin, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS pos
      FROM lineitem GROUP BY 1
    ),
    c AS (
      SELECT margin, n, row_number() OVER (ORDER BY margin) AS i,
             sum(pos) OVER (ORDER BY margin)::double AS s, sum(n) OVER (ORDER BY margin)::double AS w
      FROM m
    ),
    starts AS (SELECT i + 1 AS i, s, w FROM c UNION ALL SELECT 1, 0.0, 0.0),
    low AS (
      SELECT a.i AS start, c.i, min((c.s - a.s) / (c.w - a.w)) OVER (PARTITION BY a.i ORDER BY c.i DESC) AS mean
      FROM starts a JOIN c ON c.i >= a.i
    ),
    fit AS (SELECT i, max(mean) AS p FROM low GROUP BY 1)
    SELECT margin, n, round(p, 9) + 0.0 AS score FROM c JOIN fit USING (i)
    """,
)
def isotonic_fit(spark, sf_dir):
    """Share of returned lines by age, never falling: at every age the greatest mean from it backwards of the least mean onwards."""
    margin = F.datediff(F.lit("2000-01-01").cast("date"), F.col("l_shipdate").cast("date")).cast("double")
    lines = table(spark, sf_dir, "lineitem").select(margin.alias("margin"), "l_returnflag")
    fitted = Isotonic.fit(lines, "l_returnflag", "R")
    ages = lines.groupBy("margin").agg(F.count(F.lit(1)).alias("n"))
    return fitted.apply(ages, "p").select("margin", "n", (F.round("p", 9) + 0.0).alias("score"))


@query(
    "supervised_reduction_one",
    """
    WITH r AS (
      SELECT event_id, value + 10 * (event_id % 3) AS x FROM events
    )
    SELECT event_id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) + 0.0 AS e FROM r
    """,
)
def supervised_reduction_one(spark, sf_dir):
    """The best of three positions, standardised; its one component is the position itself."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("y"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("value") + 10 * (F.col("event_id") % 3)).alias("x"),
        (F.col("event_id") % 11).cast("double").alias("z"),
    )
    rows = events.select("event_id", "y", pack(["k", "x", "z"]).alias("v"))
    fitted = fit_supervised(rows, "event_id", "v", "y", "regression", k=1, n_components=1)
    return fitted.transform(rows, "e").select("event_id", r6(F.col("e")[0], "e"))


@query(
    "saved_run_ridge",
    f"""
    WITH {SPLIT_SQL}
    SELECT event_id, split, round(my + n * c / sx / (n + 1) * (x - mx) / sx, 6) + 0.0 AS prediction FROM s, fit
    """,
)
def saved_run_ridge(spark, sf_dir):
    """A run that was written and read back scores like the line it was fitted to."""
    cohort = Cohort(line_cohort(spark, sf_dir), ROLES)
    model, splits, _ = load_run(spark, save_run(train(cohort, CONFIG), scratch_path(spark, "run")))
    out = model.transform(cohort.df).join(splits, "event_id")
    return out.select("event_id", "split", r6("prediction", "prediction"))


def _half_sql(name: str, half: int) -> str:
    rows = SPLIT_SQL.replace("  FROM events\n", f"  FROM events WHERE user_id % 2 = {half}\n", 1)
    return f"""
    SELECT * FROM (
      WITH {rows}
      SELECT '{name}' AS dataset, metric, value, (SELECT count(*) FROM s WHERE split = 'train') AS n_train,
             (SELECT count(*) FROM s WHERE split = 'validation') AS n_validation
      FROM long WHERE split = 'validation')"""


@query("matrix_job_ridge", f"{_half_sql('even', 0)} UNION ALL {_half_sql('odd', 1)}")
def matrix_job_ridge(spark, sf_dir):
    """Tables on disk, one model, results written and read back."""
    rows, paths = line_cohort(spark, sf_dir), {}
    for half, name in enumerate(("even", "odd")):
        paths[name] = scratch_path(spark, f"{name}.parquet") + "/table.parquet"
        rows.where(F.col("user_id") % 2 == half).write.parquet(paths[name])
    path = scratch_path(spark, "results")
    out = run_matrix_job(spark, paths, DEFINITION, id="event_id", models=["ridge"], required=["x", "y"], output=path)
    kept = spark.read.schema(out.schema).json(path).where("split = 'validation'")
    return rounded(kept.select("dataset", "metric", "value", "n_train", "n_validation"), "dataset", "metric", "n_train", "n_validation")
