"""Whole workflows on one-feature ridge models, whose fits and metrics SQL can state exactly."""

from __future__ import annotations


from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortspark.operators.metrics import declared_metrics
from cohortspark.operators.models import build_model
from cohortspark.operators.prep import apply_prep, fit_preprocessor
from cohortspark.plans.benchmark import run_benchmark, run_model_matrix
from cohortspark.plans.catalog.registry import STUDY_SQL, key_sql, query, rounded, study_orders, table
from cohortspark.plans.catalog.workflows import QUALITY_ROLES, metric_table, quality_cohort
from cohortspark.plans.crossval import cross_validate, cross_validated_scores, grid_search, select_model
from cohortspark.plans.train import evaluate_held_out_test, train
from cohortspark.roles import BenchmarkDefinition, Cohort, Roles, TrainingConfig
from cohortspark.session import scratch_path
from cohortspark.sources.manifests import load_definitions
from cohortspark.sources.runs import RunRegistry, save_results

ROLES = Roles("event_id", "y", "user_id")
CONFIG = TrainingConfig("regression", "ridge", "y", "user_id")
DEFINITION = BenchmarkDefinition("event-values", "1.0", "regression", "y", "subject", "user_id")


def line_cohort(spark, sf_dir):
    """Target and one feature that predicts it."""
    k = F.get_json_object("props", "$.k").cast("double")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", (F.col("value") * 0.1 + k).alias("y"), k.alias("x"))
    )


ROWS_SQL = """
rows_ AS (
  SELECT event_id, user_id, value * 0.1::double + cast(json_extract_string(props, '$.k') AS double) AS y,
         cast(json_extract_string(props, '$.k') AS double) AS x
  FROM events
)"""

SPLIT_SQL = f"""
{ROWS_SQL},
g AS (
  SELECT user_id, row_number() OVER (ORDER BY {key_sql('user_id')}, user_id) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT user_id FROM rows_)
),
cut AS (SELECT user_id, r, n, ceil(0.2::double * n) AS t FROM g),
lab AS (
  SELECT user_id,
         CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil(0.25::double * (n - t)) THEN 'validation' ELSE 'train' END AS split
  FROM cut
),
s AS (SELECT * FROM rows_ JOIN lab USING (user_id)),
fit AS (
  SELECT count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS c FROM s WHERE split = 'train'
),
e AS (SELECT split, y, y - (my + n * c / sx / (n + 1) * (x - mx) / sx) AS err FROM s, fit),
m AS (
  SELECT split, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse, 1 - sum(err * err) / (count(*) * var_pop(y)) AS r2
  FROM e GROUP BY split
),
long AS (
  SELECT split, 'mae' AS metric, round(mae, 6) + 0.0 AS value FROM m
  UNION ALL SELECT split, 'rmse', round(rmse, 6) + 0.0 FROM m
  UNION ALL SELECT split, 'r2', round(r2, 6) + 0.0 FROM m
)"""


@query("train_ridge", f"WITH {SPLIT_SQL} SELECT split, metric, value FROM long WHERE split <> 'test'")
def train_ridge(spark, sf_dir):
    return metric_table(spark, train(Cohort(line_cohort(spark, sf_dir), ROLES), CONFIG).metrics)


@query("held_out_ridge", f"WITH {SPLIT_SQL} SELECT split, metric, value FROM long WHERE split = 'test'")
def held_out_ridge(spark, sf_dir):
    cohort = Cohort(line_cohort(spark, sf_dir), ROLES)
    return metric_table(spark, {"test": evaluate_held_out_test(train(cohort, CONFIG), cohort)})


@query("benchmark_run_ridge", f"WITH {SPLIT_SQL} SELECT split, metric, value FROM long WHERE split <> 'test'")
def benchmark_run_ridge(spark, sf_dir):
    run = run_benchmark(line_cohort(spark, sf_dir), DEFINITION, id="event_id", model="ridge")
    return metric_table(spark, run.result.metrics)


@query(
    "model_matrix_ridge",
    f"""
    WITH {SPLIT_SQL},
    z AS (SELECT split, count(*) AS n FROM s GROUP BY split)
    SELECT 'event-values' AS benchmark_id, 'ridge' AS model, split, metric, value,
           (SELECT n FROM z WHERE split = 'train') AS n_train, (SELECT n FROM z WHERE split = 'validation') AS n_validation,
           (SELECT n FROM z WHERE split = 'test') AS n_test
    FROM (SELECT split, metric, value FROM long WHERE split = 'validation'
          UNION ALL SELECT 'test', metric, NULL FROM long WHERE split = 'validation')
    """,
)
def model_matrix_ridge(spark, sf_dir):
    out = run_model_matrix(line_cohort(spark, sf_dir), DEFINITION, id="event_id", models=["ridge"])
    kept = ["benchmark_id", "model", "split", "metric", "n_train", "n_validation", "n_test"]
    return rounded(out.select(*kept, "value"), *kept)


def _cv_sql(alphas: list[float], k: int) -> str:
    zeros = ", ".join(["0"] * k)
    folds = ", ".join(str(i) for i in range(1, k + 1))
    grid = " UNION ALL ".join(f"SELECT {i} AS a, {alpha}::double AS alpha" for i, alpha in enumerate(alphas))
    return f"""
    {ROWS_SQL},
    sz AS (SELECT user_id, count(*) AS n FROM rows_ GROUP BY 1),
    o AS (SELECT user_id, n, row_number() OVER (ORDER BY n DESC, {key_sql('user_id')}, user_id) AS i FROM sz),
    p AS (
      SELECT 0::bigint AS i, [{zeros}]::bigint[] AS loads, 0 AS fold
      UNION ALL
      SELECT q.i, list_transform([{folds}], lambda k: q.loads[k] + CASE WHEN k = q.f THEN q.n ELSE 0 END)::bigint[], q.f
      FROM (SELECT o.i, o.n, p.loads, list_position(p.loads, list_min(p.loads))::int AS f FROM p JOIN o ON o.i = p.i + 1) q
    ),
    s AS (SELECT r.*, p.fold FROM rows_ r JOIN o USING (user_id) JOIN p USING (i)),
    f AS (SELECT unnest([{folds}]) AS held),
    grid AS ({grid}),
    fit AS (
      SELECT held, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS c
      FROM f JOIN s ON s.fold <> f.held GROUP BY held
    ),
    e AS (
      SELECT a, held, y, y - (my + n * c / sx / (n + alpha) * (x - mx) / sx) AS err
      FROM s JOIN fit ON s.fold = fit.held CROSS JOIN grid
    ),
    m AS (
      SELECT a, held AS fold, count(*) AS validation_size, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse,
             1 - sum(err * err) / (count(*) * var_pop(y)) AS r2
      FROM e GROUP BY 1, 2
    ),
    long AS (
      SELECT a, fold, validation_size, 'mae' AS metric, mae AS value FROM m
      UNION ALL SELECT a, fold, validation_size, 'rmse', rmse FROM m
      UNION ALL SELECT a, fold, validation_size, 'r2', r2 FROM m
    ),
    agg AS (SELECT a, metric, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS folds FROM long GROUP BY 1, 2)
    """


@query(
    "cv_ridge_folds",
    f"""
    WITH RECURSIVE {_cv_sql([1.0], 5)}
    SELECT 'ridge' AS model, fold::int AS fold, (SELECT count(*) FROM rows_) - validation_size AS train_size, validation_size,
           metric, round(value, 6) + 0.0 AS value
    FROM long
    """,
)
def cv_ridge_folds(spark, sf_dir):
    result = cross_validate(build_model("regression", "ridge"), line_cohort(spark, sf_dir), ROLES)
    return rounded(result.folds, "model", "fold", "train_size", "validation_size", "metric")


@query(
    "cv_ridge",
    f"""
    WITH RECURSIVE {_cv_sql([1.0], 5)}
    SELECT 'ridge' AS model, metric, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, folds FROM agg
    """,
)
def cv_ridge(spark, sf_dir):
    result = cross_validate(build_model("regression", "ridge"), line_cohort(spark, sf_dir), ROLES)
    return rounded(result.summary(), "model", "metric", "folds")


@query(
    "cv_scores_ridge",
    f"""
    WITH RECURSIVE {_cv_sql([1.0], 5)}
    SELECT round(-mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, 5::int AS folds FROM agg WHERE metric = 'rmse'
    """,
)
def cv_scores_ridge(spark, sf_dir):
    out = cross_validated_scores(
        build_model("regression", "ridge"),
        line_cohort(spark, sf_dir),
        ROLES,
        scoring="neg_root_mean_squared_error",
    )
    frame = spark.createDataFrame([(out["mean"], out["std"], len(out["scores"]))], "mean double, std double, folds int")
    return rounded(frame, "folds")


@query(
    "select_ridge",
    f"""
    WITH RECURSIVE {_cv_sql([1.0, 5000.0], 5)}
    SELECT CASE a WHEN 0 THEN 'strong' ELSE 'shrunk' END AS model, metric, round(mean, 6) + 0.0 AS mean,
           round(std, 6) + 0.0 AS std, folds, a = (SELECT a FROM agg WHERE metric = 'rmse' ORDER BY mean LIMIT 1) AS chosen
    FROM agg WHERE metric = 'rmse'
    """,
)
def select_ridge(spark, sf_dir):
    candidates = {
        "strong": build_model("regression", "ridge", alpha=1.0),
        "shrunk": build_model("regression", "ridge", alpha=5000.0),
    }
    best, ranking, _ = select_model(candidates, line_cohort(spark, sf_dir), ROLES, primary_metric="rmse")
    return rounded(ranking, "model", "metric", "folds").withColumn("chosen", F.col("model") == best)


@query(
    "grid_search_ridge",
    f"""
    WITH RECURSIVE {_cv_sql([5000.0, 1.0, 100.0], 5)},
    top AS (SELECT a, mean FROM agg WHERE metric = 'rmse' ORDER BY mean, a LIMIT 1),
    whole AS (SELECT count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS c FROM rows_)
    SELECT event_id, alpha, round(-top.mean, 6) + 0.0 AS best_score,
           round(my + n * c / sx / (n + alpha) * (x - mx) / sx, 6) + 0.0 AS prediction
    FROM rows_, whole, top JOIN grid USING (a)
    """,
)
def grid_search_ridge(spark, sf_dir):
    rows = line_cohort(spark, sf_dir)
    spec = build_model("regression", "ridge")
    found = grid_search(spec, rows, ROLES, {"alpha": [5000.0, 1.0, 100.0]})
    out = found.model.transform(rows).select(
        "event_id",
        F.lit(found.best_params["alpha"]).alias("alpha"),
        F.lit(found.best_score).alias("best_score"),
        "prediction",
    )
    return rounded(out, "event_id", "alpha")


@query(
    "logit_gradient",
    """
    WITH d AS (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id))
    SELECT 'intercept' AS slot, 0.0::double AS gradient
    UNION ALL SELECT unnest(['log_chars', 'chars_per_word', 'digit_share']), 0.0
    UNION ALL SELECT 'lang=' || lang, 0.0 FROM d
    """,
)
def logit_gradient(spark, sf_dir):
    """At the optimum the summed residuals times each slot equal minus its penalised weight."""
    rows = quality_cohort(spark, sf_dir)
    features = QUALITY_ROLES.features(rows)
    model = build_model("classification", "logistic_regression").fit(rows, features, "quality")
    prep = fit_preprocessor(rows, features, output="slots")
    scored = apply_prep(prep, model.transform(rows))
    gap = F.col("score") - (F.col("quality") == F.lit(model.positive)).cast("double")
    named = F.explode(
        F.arrays_zip(
            F.array(*[F.lit(s) for s in ("intercept", *prep.slots)]).alias("slot"),
            F.concat(F.array(F.lit(1.0)), vector_to_array("slots")).alias("x"),
            F.array(*[F.lit(float(w)) for w in (0.0, *model.core.coefficients)]).alias("w"),
        )
    ).alias("s")
    sums = scored.select(gap.alias("gap"), named).groupBy("s.slot").agg(
        (F.sum(F.col("gap") * F.col("s.x")) + F.max("s.w")).alias("gradient")
    )
    return sums.select("slot", (F.round("gradient", 2) + 0.0).alias("gradient"))


@query(
    "run_registry",
    """
    SELECT 'orders-' || substr(o_orderpriority, 1, 1) AS run_id, count(*) AS n_rows FROM orders GROUP BY 1
    """,
)
def run_registry(spark, sf_dir):
    sizes = (
        table(spark, sf_dir, "orders")
        .groupBy(F.concat(F.lit("orders-"), F.substring("o_orderpriority", 1, 1)).alias("run_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    registry = RunRegistry(spark, scratch_path(spark, "registry"))
    for r in sizes.collect():  # one manifest per order priority
        registry.save(r["run_id"], {"split_sizes": {"train": r["n"]}})
    n = F.get_json_object("manifest", "$.split_sizes.train").cast("bigint")
    return registry.runs().select("run_id", n.alias("n_rows"))


@query(
    "result_table",
    "SELECT event_type AS model, round(avg(value), 6) + 0.0 AS value, NULL::double AS test FROM events GROUP BY 1",
)
def result_table(spark, sf_dir):
    results = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("value"))
    results = rounded(results, "model").withColumn("test", F.lit(None).cast("double"))
    return spark.read.schema(results.schema).json(save_results(results, scratch_path(spark, "results")))


@query(
    "benchmark_definitions",
    """
    SELECT 'nation-' || n_nationkey AS benchmark_id,
           list_filter([CASE WHEN n_nationkey % 5 = 0 THEN 'missing target' END,
                        CASE WHEN n_nationkey % 3 = 0 THEN 'unknown task' END], lambda p: p IS NOT NULL)::varchar AS problems
    FROM nation
    """,
)
def benchmark_definitions(spark, sf_dir):
    i = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation-"), i).alias("benchmark_id"),
        F.lit("1").alias("version"),
        F.when(i % 3 == 0, "guessing").otherwise("classification").alias("task"),
        F.when(i % 5 != 0, F.col("n_name")).alias("target"),
        F.lit("donor").alias("split_policy"),
        F.lit("donor_id").alias("group_key"),
    )
    path = scratch_path(spark, "definitions")
    rows.write.option("maxRecordsPerFile", 1).json(path)
    table_ = load_definitions(spark, path)
    return table_.select("benchmark_id", F.concat(F.lit("["), F.concat_ws(", ", "problems"), F.lit("]")).alias("problems"))




@query(
    "mlp_onehot",
    """
    SELECT l_returnflag, count(*) AS n, CASE WHEN avg(CAST(l_linestatus = 'O' AS INT)) > 0.5 THEN 'O' ELSE 'F' END AS prediction,
           round(avg(CAST(l_linestatus = 'O' AS INT)), 3) + 0.0 AS score
    FROM lineitem GROUP BY 1
    """,
)
def mlp_onehot(spark, sf_dir):
    """Where the inputs only tell groups apart, a network without early stopping comes to each group's share of the class."""
    lines = table(spark, sf_dir, "lineitem")
    flags = {f"is_{v}": (F.col("l_returnflag") == v).cast("int") for v in ("A", "N", "R")}
    rows = lines.select("l_returnflag", "l_linestatus", *[c.alias(n) for n, c in flags.items()])
    spec = build_model("classification", "mlp", hidden=(8,), early_stopping=False, tol=0.0)
    scored = spec.fit(rows, list(flags), "l_linestatus").transform(rows)
    return scored.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.max("prediction").alias("prediction"), (F.round(F.max("score"), 3) + 0.0).alias("score")
    )


NESTED = BenchmarkDefinition(
    "order-prices", "1.0", "regression", "y", "study_held_out", "o_custkey", metrics=("rmse", "mae", "r2")
)


@query(
    "benchmark_holdout_ridge",
    f"""
    WITH {STUDY_SQL},
    rows_ AS (
      SELECT o_orderkey, o_custkey, r_name, o_totalprice / 1000 + month(o_orderdate) AS y, month(o_orderdate)::double AS x FROM study
    ),
    g AS (
      SELECT o_custkey, row_number() OVER (ORDER BY {key_sql('o_custkey')}, o_custkey) AS r, count(*) OVER () AS n
      FROM (SELECT DISTINCT o_custkey FROM rows_ WHERE r_name <> 'ASIA')
    ),
    s AS (
      SELECT rows_.*, CASE WHEN r <= ceil(0.2::double * n) THEN 'validation' ELSE 'train' END AS split
      FROM rows_ JOIN g USING (o_custkey) WHERE r_name <> 'ASIA'
    ),
    fit AS (
      SELECT count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS c FROM s WHERE split = 'train'
    ),
    e AS (SELECT split, y, y - (my + n * c / sx / (n + 1) * (x - mx) / sx) AS err FROM s, fit),
    m AS (
      SELECT split, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse, 1 - sum(err * err) / (count(*) * var_pop(y)) AS r2
      FROM e GROUP BY split
    )
    SELECT split, 'mae' AS metric, round(mae, 6) + 0.0 AS value FROM m
    UNION ALL SELECT split, 'rmse', round(rmse, 6) + 0.0 FROM m
    UNION ALL SELECT split, 'r2', round(r2, 6) + 0.0 FROM m
    """,
)
def benchmark_holdout_ridge(spark, sf_dir):
    """A held-out study: customers lie in one region each, so the group gate holds."""
    month = F.month("o_orderdate").cast("double")
    rows = study_orders(spark, sf_dir).select(
        "o_orderkey", "o_custkey", "r_name", (F.col("o_totalprice") / 1000 + month).alias("y"), month.alias("x")
    )
    run = run_benchmark(rows, NESTED, id="o_orderkey", model="ridge", holdout=("r_name", "ASIA"))
    return metric_table(spark, run.result.metrics)


@query(
    "declared_metrics",
    """
    WITH s AS (
      SELECT l_returnflag AS flag, l_linestatus = 'O' AS hit, CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END AS h,
             l_quantity / 50 AS p FROM lineitem),
    b AS (SELECT *, least(floor(p * 10), 9) AS bin FROM s),
    c AS (
      SELECT flag, bin, count(*) AS n, abs(avg(p) - avg(hit::int)) AS gap FROM b GROUP BY 1, 2)
    SELECT flag, round(brier, 6) + 0.0 AS brier_score, round(sens, 6) + 0.0 AS sensitivity, round(spec, 6) + 0.0 AS specificity,
           round(ece, 6) + 0.0 AS ece
    FROM (
      SELECT flag, avg((p - hit::int) ** 2) AS brier, sum((hit AND h = 'O')::int)::double / nullif(sum(hit::int), 0) AS sens,
             sum((NOT hit AND h = 'F')::int)::double / nullif(sum((NOT hit)::int), 0) AS spec FROM s GROUP BY 1)
    JOIN (SELECT flag, sum(n * gap) / sum(n) AS ece FROM c GROUP BY 1) USING (flag)
    """,
)
def declared_metrics_query(spark, sf_dir):
    """The metrics that a definition may declare, of fixed scores per group."""
    scored = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("y"),
        F.when(F.col("l_quantity") > 25, "O").otherwise("F").alias("prediction"),
        (F.col("l_quantity") / 50).alias("score"),
    )
    out = declared_metrics(scored, ["ece", "brier_score", "sensitivity", "specificity"], y="y", positive="O", by=["flag"])
    return rounded(out, "flag")
