"""Preprocessing fitted on training rows only, as persistable Spark ML stages.

Features are columns, or arrays of numbers that hold a feature per position (a gene, a pixel). The positions of an array are
fitted together, in long form and as vectors: plans do not grow with their number.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
    VectorSizeHint,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.missing import missing, present_double
from cohortspark.operators.quantiles import exact_quantiles
from cohortspark.roles import is_numeric_type


def is_array_type(dtype: T.DataType) -> bool:
    """Whether a column holds a number per position."""
    return isinstance(dtype, VectorUDT) or (isinstance(dtype, T.ArrayType) and is_numeric_type(dtype.elementType))


def typed_features(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """Numeric (and boolean) features, arrays of numbers, and all others as categorical."""
    kinds = {c: df.schema[c].dataType for c in features}
    numeric = [c for c in features if is_numeric_type(kinds[c])]
    arrays = [c for c in features if is_array_type(kinds[c])]
    known = {*numeric, *arrays}
    return numeric, arrays, [c for c in features if c not in known]


def _stacked(columns: dict[str, Column]) -> Column:
    """One ``(feature, v)`` row per column."""
    return F.explode(
        F.array(*[F.struct(F.lit(name).alias("feature"), col.alias("v")) for name, col in columns.items()])
    ).alias("s")


def column_medians(
    train: DataFrame, numeric: Sequence[str], distinct: dict[str, int] | None = None
) -> dict[str, float]:
    """Exact medians; a column without any value has no entry.

    ``distinct`` are (approximate) distinct counts already known, which spare the
    search its own look at the data.
    """
    if not numeric:
        return {}
    long = train.select(_stacked({c: present_double(train, c) for c in numeric})).select("s.feature", "s.v")
    most = max(distinct.values(), default=0) if distinct is not None else None
    rows = exact_quantiles(long, ["feature"], "v", {"median": 0.5}, most_distinct=most).collect()
    return {r["feature"]: r["median"] for r in rows if r["median"] is not None}


@dataclass(frozen=True)
class NumericFit:
    median: float | None
    mean: float
    std: float

    def imputed(self, df: DataFrame, name: str) -> Column:
        value = present_double(df, name)
        return value if self.median is None else F.coalesce(value, F.lit(self.median))


def fit_numeric(
    train: DataFrame,
    numeric: Sequence[str],
    *,
    impute: bool = True,
    extra: Sequence[Column] = (),
) -> tuple[dict[str, NumericFit], Row]:
    """Median, then mean and population std of the imputed values; zero std becomes 1.

    The moments of the imputed column follow from those of the present values, so
    one aggregate serves all columns, and ``extra`` aggregates ride along.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows"), *extra]
    for i, c in enumerate(numeric):
        x = present_double(train, c)
        aggs += [
            F.count(x).alias(f"c{i}"),
            F.avg(x).alias(f"m{i}"),
            F.var_pop(x).alias(f"v{i}"),
            F.approx_count_distinct(x).alias(f"d{i}"),
        ]
    row = train.agg(*aggs).first()
    n = row["n_rows"]
    if not impute:
        gaps = [c for i, c in enumerate(numeric) if row[f"c{i}"] < n]
        if gaps:
            raise ValueError(f"missing values in {gaps} and no imputation")
    distinct = {c: row[f"d{i}"] for i, c in enumerate(numeric) if row[f"c{i}"]}
    medians = column_medians(train, list(distinct), distinct) if impute else {}
    fits = {}
    for i, c in enumerate(numeric):
        seen = row[f"c{i}"]
        if not seen:
            continue
        mean, variance, median = row[f"m{i}"], row[f"v{i}"], medians.get(c)
        if seen < n:
            filled = n - seen
            whole = (seen * mean + filled * median) / n
            variance = (seen * (variance + (mean - whole) ** 2) + filled * (median - whole) ** 2) / n
            mean = whole
        fits[c] = NumericFit(median, mean, variance**0.5 or 1.0)
    return fits, row


def present_doubles(df: DataFrame, name: str) -> Column:
    """The array as doubles, NULL where a position is missing; NULL where the array is."""
    whole = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, VectorUDT):
        whole = vector_to_array(whole)
    return F.transform(whole.cast("array<double>"), lambda x: F.when(~F.isnan(x), x))


def _constant(values: Sequence[float]) -> Column:
    """One constant instead of thousands of literals."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<double>")


@dataclass(frozen=True)
class ArrayFit:
    """Per position: median (0 where there is no value), mean and 1 / std of the imputed values (0: the position says nothing)."""

    medians: tuple[float, ...]
    means: tuple[float, ...]
    factors: tuple[float, ...]


def fit_array(train: DataFrame, name: str, *, impute: bool = True) -> ArrayFit:
    """Medians from the long form (position, value), moments of the imputed vectors from one summary."""
    v = present_doubles(train, name)
    gaps = F.exists(v, lambda x: x.isNull())
    head = train.agg(
        F.min(F.size(v)).alias("least"),
        F.max(F.size(v)).alias("most"),
        F.count_if(v.isNull() | F.coalesce(gaps, F.lit(True))).alias("gaps"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    width = head["most"]
    if not width or head["least"] != width:
        raise ValueError(f"the arrays of {name!r} have {head['least']} to {width} positions")
    if head["gaps"] and not impute:
        raise ValueError(f"missing values in {[name]} and no imputation")
    medians = [0.0] * width
    seen = set(range(width))
    if impute:
        long = train.select(F.posexplode(v).alias("position", "v")).where("v is not null")
        # As many rows as the model has slots.
        found = exact_quantiles(long, ["position"], "v", {"median": 0.5}).collect()
        seen = {r["position"] for r in found}
        for r in found:
            medians[r["position"]] = r["median"]
    filled = F.transform(v, lambda x, i: F.coalesce(x, F.get(_constant(medians), i)))
    whole = train.select(array_to_vector(F.coalesce(filled, _constant(medians))).alias("v"))
    row = whole.agg(Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s")).first()["s"]
    shrink = (head["n"] - 1) / head["n"]  # the summary's variance is the sample's
    std = [(max(x, 0.0) * shrink) ** 0.5 or 1.0 for x in row["variance"]]
    means = [float(x) for x in row["mean"]]
    factors = [1.0 / s if i in seen else 0.0 for i, s in enumerate(std)]
    return ArrayFit(tuple(medians), tuple(means), tuple(factors))


class ArrayScaler(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the imputed and standardised positions of an array as a vector. An array that is NULL or too short is filled up."""

    inputCol = Param(Params._dummy(), "inputCol", "array of numbers", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector", TypeConverters.toString)
    medians = Param(Params._dummy(), "medians", "what a missing position gets", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "per position", TypeConverters.toListFloat)
    factors = Param(Params._dummy(), "factors", "per position", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        medians, means, factors = (_constant(self.getOrDefault(p)) for p in (self.medians, self.means, self.factors))
        value = F.coalesce(present_doubles(dataset, self.getOrDefault(self.inputCol)), F.array().cast("array<double>"))

        def scaled(median: Column, i: Column) -> Column:
            return (F.coalesce(F.get(value, i), median) - F.get(means, i)) * F.get(factors, i)

        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(F.transform(medians, scaled)))


@dataclass(frozen=True)
class CategoricalFit:
    mode: str
    categories: tuple[str, ...]


def _as_category(df: DataFrame, name: str) -> Column:
    return F.when(~missing(df, name), F.col(f"`{name}`").cast("string"))


def fit_categorical(train: DataFrame, categorical: Sequence[str]) -> dict[str, CategoricalFit]:
    """Most frequent value (ties: smallest) and the sorted categories.

    The category list is as long as the model's one-hot block, which the driver
    holds anyway as coefficients.
    """
    if not categorical:
        return {}
    long = train.select(_stacked({c: _as_category(train, c) for c in categorical})).select("s.feature", "s.v")
    counted = long.where("v is not null").groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.groupBy("feature").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("top"),
        F.array_sort(F.collect_list("v")).alias("categories"),
    )
    return {r["feature"]: CategoricalFit(r["top"]["v"], tuple(r["categories"])) for r in rows.collect()}


def impute_median(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    medians = column_medians(train, columns)
    out = {c: NumericFit(medians.get(c), 0.0, 1.0).imputed(df, c) for c in columns}
    return df.withColumns(out)


def standard_scale(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale by the training mean and population std; missing stays missing."""
    aggs = []
    for i, c in enumerate(columns):
        x = present_double(train, c)
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = train.agg(*aggs).first()
    return df.withColumns(
        {
            c: (present_double(df, c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0)
            for i, c in enumerate(columns)
        }
    )


def impute_mode(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    fits = fit_categorical(train, columns)
    return df.withColumns(
        {c: F.coalesce(_as_category(df, c), F.lit(fits[c].mode)) for c in columns if c in fits}
    )


def one_hot(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """A 0/1 column per training category; unseen and missing values are all zero."""
    fit = fit_categorical(train, [column]).get(column)
    value = _as_category(df, column)
    return df.withColumns(
        {
            f"{column}={v}": F.coalesce((value == F.lit(v)).cast("int"), F.lit(0))
            for v in (fit.categories if fit else ())
        }
    )


def missing_indicators(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A 0/1 ``<column>_missing`` for every column with a missing value among the training rows."""
    row = train.agg(*[F.max(missing(train, c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    flagged = [c for i, c in enumerate(columns) if row[f"c{i}"]]
    return df.withColumns({f"{c}_missing": missing(df, c).cast("int") for c in flagged})


def _sql_number(x: float) -> str:
    return f"cast('{x!r}' as double)"


def _numeric_sql(df: DataFrame, name: str, fit: NumericFit) -> str:
    value = f"cast(`{name}` as double)"
    kept = f"nullif({value}, double('NaN'))"  # Spark treats NaN as equal to itself
    if fit.median is not None:
        kept = f"coalesce({kept}, {_sql_number(fit.median)})"
    return f"({kept} - {_sql_number(fit.mean)}) / {_sql_number(fit.std)}"


@dataclass(frozen=True)
class FittedPrep:
    """Fitted stages that add one vector column, and the names of its slots."""

    model: PipelineModel
    slots: tuple[str, ...]
    output: str
    totals: Row
    #: Different encoded rows at most, by the (approximate) distinct values of every feature and its missing ones.
    inputs: float = float("inf")


def fit_preprocessor(
    train: DataFrame,
    features: Sequence[str],
    *,
    output: str = "features",
    numeric_only: bool = False,
    extra: Sequence[Column] = (),
) -> FittedPrep:
    """Numeric columns and array positions: median impute, standardise.  Others: mode impute, one-hot.

    ``numeric_only`` is the neural variant: standardise without imputing, and text
    features are an error.  ``extra`` aggregates of the training rows are returned in
    ``totals``, next to ``n_rows``.
    """
    numeric, arrays, categorical = typed_features(train, features)
    if numeric_only and categorical:
        raise ValueError(f"numeric features only; encode {categorical} first")
    numbers, totals = fit_numeric(train, numeric, impute=not numeric_only, extra=extra)
    texts = fit_categorical(train, categorical)
    whole = {c: fit_array(train, c, impute=not numeric_only) for c in arrays}
    if not numbers and not texts and not whole:
        raise ValueError("no usable feature columns")

    stages = []
    picks = ["*"]
    inputs = []
    slots: list[str] = []
    for i, (name, fit) in enumerate(numbers.items()):
        picks.append(f"{_numeric_sql(train, name, fit)} as __num_{i}")
        inputs.append(f"__num_{i}")
        slots.append(name)
    for i, (name, fit) in enumerate(whole.items()):
        scaler = ArrayScaler()
        scaler._set(inputCol=name, outputCol=f"__arr_{i}", medians=fit.medians, means=fit.means, factors=fit.factors)
        # The assembler reads the width from the column's metadata.
        stages += [scaler, VectorSizeHint(inputCol=f"__arr_{i}", size=len(fit.medians), handleInvalid="optimistic")]
        inputs.append(f"__arr_{i}")
        slots += [f"{name}[{k}]" for k in range(len(fit.medians))]
    for i, (name, fit) in enumerate(texts.items()):
        mode = fit.mode.replace("\\", "\\\\").replace("'", "\\'")
        picks.append(f"coalesce(cast(`{name}` as string), '{mode}') as __cat_{i}")
        slots += [f"{name}={v}" for v in fit.categories]
    stages.append(SQLTransformer(statement=f"select {', '.join(picks)} from __THIS__"))
    if texts:
        raw = [f"__cat_{i}" for i in range(len(texts))]
        index = [f"__idx_{i}" for i in range(len(texts))]
        hot = [f"__hot_{i}" for i in range(len(texts))]
        stages += [
            StringIndexerModel.from_labels(list(f.categories), inputCol=r, outputCol=x, handleInvalid="keep")
            for f, r, x in zip(texts.values(), raw, index, strict=True)
        ]
        encoder = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True, handleInvalid="error")
        # Category counts come from the index metadata, so no rows are read here.
        encoder_model = encoder.fit(PipelineModel(stages).transform(train.limit(0)))
        stages.append(encoder_model)
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep"))
    inputs = float("inf") if whole else 1.0
    for i in range(len(numeric)):
        inputs *= totals[f"d{i}"] + 1
    for fit in texts.values():
        inputs *= len(fit.categories) + 1
    return FittedPrep(PipelineModel(stages), tuple(slots), output, totals, inputs)


def apply_prep(prep: FittedPrep, df: DataFrame) -> DataFrame:
    out = prep.model.transform(df)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], prep.output)
