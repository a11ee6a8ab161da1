"""Array, signal, image and sparse-matrix features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import accession, arrays, images, signals
from cohortspark.operators import omics
from cohortspark.plans.catalog.registry import query, r6, rounded, table

RATE = 250.0


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), "label"
    )


U_SQL = """
u AS (
  SELECT vec_id, label, i::int AS i, embedding[i + 1]::double AS x FROM embeddings, generate_series(0, 63) t(i)
)"""

SUMMARY = """
    round(avg(x), 6) + 0.0 AS {p}_mean, round(stddev_pop(x), 6) + 0.0 AS {p}_std, round(min(x), 6) + 0.0 AS {p}_min,
    round(max(x), 6) + 0.0 AS {p}_max, round(quantile_cont(x, 0.5), 6) + 0.0 AS {p}_median
"""


@query(
    "numeric_summary",
    f"WITH {U_SQL} SELECT vec_id, {SUMMARY.format(p='x')} FROM u WHERE x <= 0.2 GROUP BY vec_id",
)
def numeric_summary(spark, sf_dir):
    holes = F.transform("v", lambda x: F.when(x > 0.2, F.lit(float("nan"))).otherwise(x))
    rows = vectors(spark, sf_dir).withColumn("v", holes)
    return rounded(arrays.numeric_summary(rows, "vec_id", "v"), "vec_id")


@query("waveform_summary", f"WITH {U_SQL} SELECT vec_id, {SUMMARY.format(p='waveform')} FROM u GROUP BY vec_id")
def waveform_summary(spark, sf_dir):
    return rounded(arrays.waveform_summary(vectors(spark, sf_dir), "vec_id", "v"), "vec_id")


@query(
    "expression_variability",
    f"""
    WITH {U_SQL}, z AS (SELECT vec_id, CASE WHEN abs(x) < 0.05 THEN 0 ELSE x END AS x FROM u)
    SELECT vec_id, round(avg(x), 6) + 0.0 AS expression_mean, round(stddev_pop(x), 6) + 0.0 AS expression_std,
           round(avg((x <> 0)::int), 6) + 0.0 AS expression_nonzero_fraction
    FROM z GROUP BY vec_id
    """,
)
def expression_variability(spark, sf_dir):
    zeros = F.transform("v", lambda x: F.when(F.abs(x) < 0.05, F.lit(0.0)).otherwise(x))
    rows = vectors(spark, sf_dir).withColumn("v", zeros)
    return rounded(arrays.expression_variability(rows, "vec_id", "v"), "vec_id")


@query(
    "signal_summary",
    f"""
    WITH {U_SQL},
    c AS (
      SELECT vec_id, i, x, x - lag(x) OVER w AS dx, x - avg(x) OVER (PARTITION BY vec_id) AS centred
      FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY i)
    ),
    f AS (SELECT *, (centred < 0) <> (lag(centred) OVER (PARTITION BY vec_id ORDER BY i) < 0) AS flip FROM c)
    SELECT vec_id, count(*)::double AS n_samples, round((count(*) - 1) / {RATE}::double, 6) + 0.0 AS duration_s,
           round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS min,
           round(max(x), 6) + 0.0 AS max, round(max(x) - min(x), 6) + 0.0 AS range,
           round(sqrt(avg(x * x)), 6) + 0.0 AS rms, round(avg(abs(dx)), 6) + 0.0 AS mean_abs_derivative,
           round(stddev_pop(dx), 6) + 0.0 AS derivative_std, round(avg(flip::int), 6) + 0.0 AS zero_crossing_rate
    FROM f GROUP BY vec_id
    """,
)
def signal_summary(spark, sf_dir):
    return rounded(signals.signal_summary(vectors(spark, sf_dir), "vec_id", "v", RATE), "vec_id")


@query("waveform_duration", f"SELECT vec_id, len(embedding) / {RATE}::double AS duration_s FROM embeddings")
def waveform_duration(spark, sf_dir):
    return signals.waveform_duration(vectors(spark, sf_dir), "vec_id", "v", RATE)


@query(
    "image_statistics",
    f"""
    WITH {U_SQL}
    SELECT vec_id, 8.0::double AS height, 8.0::double AS width, 1.0::double AS channels,
           round(avg(x), 6) + 0.0 AS global_mean, round(stddev_pop(x), 6) + 0.0 AS global_std
    FROM u GROUP BY vec_id
    """,
)
def image_statistics(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", images.image_column(F.col("v"), 8, 8).alias("image"))
    return rounded(images.image_statistics(rows, "vec_id", "image"), "vec_id")


CHANNEL_SQL = ", ".join(
    f"round(avg(x) FILTER (i % 4 = {c}), 6) + 0.0 AS channel_{c}_mean, "
    f"round(stddev_pop(x) FILTER (i % 4 = {c}), 6) + 0.0 AS channel_{c}_std"
    for c in range(4)
)


@query(
    "image_statistics_channels",
    f"""
    WITH {U_SQL}
    SELECT vec_id, 4.0::double AS height, 4.0::double AS width, 4.0::double AS channels,
           round(avg(x), 6) + 0.0 AS global_mean, round(stddev_pop(x), 6) + 0.0 AS global_std, {CHANNEL_SQL}
    FROM u GROUP BY vec_id
    """,
)
def image_statistics_channels(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", images.image_column(F.col("v"), 4, 4, 4).alias("image"))
    return rounded(images.image_statistics(rows, "vec_id", "image", channels=4), "vec_id")


def _exploded(df, name):
    return df.select("vec_id", F.posexplode(name).alias("feature", "value")).select(
        "vec_id", "feature", r6("value", "value")
    )


@query(
    "image_normalize",
    f"""
    WITH {U_SQL}, e AS (SELECT vec_id, min(x) AS lo, max(x) AS hi FROM u GROUP BY vec_id)
    SELECT vec_id, i AS feature, round(CASE WHEN hi = lo THEN 0 ELSE (x - lo) / (hi - lo) END, 6) + 0.0 AS value
    FROM u JOIN e USING (vec_id)
    """,
)
def image_normalize(spark, sf_dir):
    return _exploded(vectors(spark, sf_dir).withColumn("w", images.image_normalize(F.col("v"))), "w")


@query(
    "omics_log1p",
    f"WITH {U_SQL} SELECT vec_id, i AS feature, round(ln(1 + greatest(x, 0)), 6) + 0.0 AS value FROM u",
)
def omics_log1p(spark, sf_dir):
    return _exploded(vectors(spark, sf_dir).withColumn("w", arrays.clamped_log1p(F.col("v"))), "w")


@query(
    "expression_log1p",
    """
    SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) + 0.0 AS l_quantity,
           round(ln(1 + l_extendedprice), 6) + 0.0 AS l_extendedprice
    FROM lineitem
    """,
)
def expression_log1p(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = omics.expression_log1p(lines, exclude=("l_orderkey", "l_linenumber"))
    return rounded(out, "l_orderkey", "l_linenumber")


@query(
    "zscore_features",
    f"""
    WITH {U_SQL}, m AS (SELECT i, avg(x) AS a, stddev_pop(x) AS s FROM u GROUP BY i)
    SELECT vec_id, i AS feature, round((x - a) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS value FROM u JOIN m USING (i)
    """,
)
def zscore_features(spark, sf_dir):
    long = omics.to_long(vectors(spark, sf_dir), "vec_id", "v")
    return rounded(omics.zscore_features(long), "vec_id", "feature")


@query(
    "zscore_samples",
    f"""
    WITH {U_SQL}, m AS (SELECT vec_id, avg(x) AS a, stddev_pop(x) AS s FROM u GROUP BY vec_id)
    SELECT vec_id, i AS feature, round((x - a) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS value
    FROM u JOIN m USING (vec_id)
    """,
)
def zscore_samples(spark, sf_dir):
    return _exploded(vectors(spark, sf_dir).withColumn("w", arrays.standardised(F.col("v"))), "w")


@query(
    "accession_urls",
    """
    SELECT DISTINCT 'GSE' || o_orderkey AS accession, 'GSE' || (o_orderkey // 1000) || 'nnn' AS bucket,
           'https://ftp.ncbi.nlm.nih.gov/geo/series/GSE' || (o_orderkey // 1000) || 'nnn/GSE' || o_orderkey
             || '/soft/GSE' || o_orderkey || '_family.soft.gz' AS family_soft,
           'https://ftp.ncbi.nlm.nih.gov/geo/series/GSE' || (o_orderkey // 1000) || 'nnn/GSE' || o_orderkey
             || '/suppl/GSE' || o_orderkey || '_RAW.tar' AS raw_tar
    FROM orders
    """,
)
def accession_urls(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select(F.concat(F.lit("gse"), "o_orderkey").alias("accession"))
    return accession.accession_urls(named, "accession")


def _counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cell_id"),
        F.col("l_partkey").alias("gene"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("count"),
    )


def _obs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell_id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("group"),
    )


OBS_SQL = "obs AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS grp FROM orders)"


@query(
    "pseudobulk_long",
    f"""
    WITH {OBS_SQL}
    SELECT grp AS "group", l_partkey AS gene, sum(l_quantity) AS count
    FROM lineitem JOIN obs ON l_orderkey = o_orderkey WHERE grp IS NOT NULL GROUP BY 1, 2
    """,
)
def pseudobulk_long(spark, sf_dir):
    return omics.pseudobulk(_counts(spark, sf_dir), _obs(spark, sf_dir))


WIDE_SQL = ", ".join(f'coalesce(sum(l_quantity) FILTER (l_linenumber = {i}), 0) AS "{i}"' for i in range(1, 8))


@query(
    "pseudobulk_wide",
    f"""
    WITH {OBS_SQL}
    SELECT grp AS "group", {WIDE_SQL}
    FROM lineitem JOIN obs ON l_orderkey = o_orderkey WHERE grp IS NOT NULL GROUP BY 1
    """,
)
def pseudobulk_wide(spark, sf_dir):
    counts = _counts(spark, sf_dir).select("cell_id", F.col("line").alias("gene"), "count")
    long = omics.pseudobulk(counts, _obs(spark, sf_dir))
    return omics.pseudobulk_wide(long, list(range(1, 8)))


@query(
    "qc_summary",
    """
    WITH e AS (
      SELECT o_orderpriority AS sample, l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS umi
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3 HAVING sum(l_quantity) <> 0
    ),
    c AS (
      SELECT sample, cell, count(*) AS detected, sum(umi) AS umi,
             coalesce(sum(umi) FILTER (gene % 10 = 0), 0) / sum(umi) AS marker
      FROM e GROUP BY 1, 2
    ),
    g AS (SELECT sample, count(DISTINCT gene) AS genes FROM e GROUP BY 1)
    SELECT sample, count(*) AS cells, any_value(genes) AS genes, sum(detected)::bigint AS nnz,
           round(quantile_cont(umi, 0.5), 6) + 0.0 AS median_umi_per_cell,
           round(quantile_cont(detected::double, 0.5), 6) + 0.0 AS median_detected_genes,
           round(quantile_cont(marker, 0.5), 6) + 0.0 AS median_marker_fraction,
           round(quantile_cont(marker, 0.9), 6) + 0.0 AS p90_marker_fraction
    FROM c JOIN g USING (sample) GROUP BY sample
    """,
)
def qc_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("sample"))
    # Join and sums of a cell happen where its entries are dealt to: tasks of a fixed size hold their hash tables.
    lines, orders = omics.dealt_alike(lines, "l_orderkey", orders, "o_orderkey")
    counts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = omics.qc_summary(
        counts,
        sample="sample",
        cell="l_orderkey",
        gene="l_partkey",
        count="l_quantity",
        marker=F.col("l_partkey") % 10 == 0,
    )
    return rounded(out, "sample", "cells", "genes", "nnz")


@query(
    "variance_filter",
    f"""
    WITH {U_SQL}, k AS (SELECT i FROM u GROUP BY i HAVING var_pop(x) > 0.0155)
    SELECT vec_id, i AS feature, round(x, 6) + 0.0 AS value FROM u WHERE i IN (SELECT i FROM k)
    """,
)
def variance_filter(spark, sf_dir):
    long = omics.to_long(vectors(spark, sf_dir), "vec_id", "v")
    return rounded(omics.variance_filter(long, 0.0155), "vec_id", "feature")


@query(
    "variance_filter_sparse",
    """
    WITH n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
    e AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
    v AS (SELECT l_partkey, sum(q * q) / any_value(n) - (sum(q) / any_value(n)) ** 2 AS v FROM e, n GROUP BY 1)
    SELECT l_partkey AS gene, count(*) AS entries FROM e WHERE l_partkey IN (SELECT l_partkey FROM v WHERE v > 1.7)
    GROUP BY 1
    """,
)
def variance_filter_sparse(spark, sf_dir):
    counts = _counts(spark, sf_dir).groupBy("cell_id", "gene").agg(F.sum("count").alias("count"))
    n = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().count()
    kept = omics.variance_filter(counts, 1.7, feature="gene", value="count", n_samples=n)
    return kept.groupBy("gene").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "topk_anova",
    f"""
    WITH {U_SQL},
    c AS (SELECT i, label, count(*) AS n, avg(x) AS m, var_pop(x) AS s FROM u GROUP BY 1, 2),
    g AS (SELECT i, sum(n)::double AS n, count(*) AS k, sum(n * m) / sum(n) AS gm, sum(n * s) AS w FROM c GROUP BY 1),
    f AS (
      SELECT c.i, (sum(c.n * (c.m - gm) ** 2) / (any_value(k) - 1)) / (any_value(w) / (any_value(g.n) - any_value(k))) AS score
      FROM c JOIN g USING (i) GROUP BY 1
    )
    SELECT i AS feature, round(score, 4) + 0.0 AS score FROM f ORDER BY score DESC, i LIMIT 20
    """,
)
def topk_anova(spark, sf_dir):
    long = omics.to_long(vectors(spark, sf_dir), "vec_id", "v", keep=["label"])
    top = omics.top_features(omics.anova_scores(long), 20)
    return top.select("feature", (F.round("score", 4) + 0.0).alias("score"))


@query(
    "topk_fregression",
    f"""
    WITH {U_SQL}, r AS (SELECT i, corr(x, label) ** 2 AS r2, count(*) AS n FROM u GROUP BY i)
    SELECT i AS feature, round(r2 / (1 - r2) * (n - 2), 4) + 0.0 AS score FROM r ORDER BY r2 DESC, i LIMIT 20
    """,
)
def topk_fregression(spark, sf_dir):
    long = omics.to_long(vectors(spark, sf_dir), "vec_id", "v", keep=["label"])
    top = omics.top_features(omics.regression_scores(long, target="label"), 20)
    return top.select("feature", (F.round("score", 4) + 0.0).alias("score"))
