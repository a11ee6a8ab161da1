"""Multilayer perceptrons on summed gradients: regression and classification.

Rows are packed once into blocks of numbers. Every step is one job: each task sums loss and gradient of its blocks at the
shared weights, and the sums are added up. The driver, whose state is a few vectors as long as the model, takes the next step:
limited-memory BFGS, or with a learning rate one step of that rate along running means of slope and squared slope. The fit depends on
the rows, not on how they are partitioned. With early stopping a tenth of the rows is held out, and the best weights on it are kept;
without it all rows are learned from. Either way training ends when the loss that is watched has not fallen for a while.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

PATIENCE = 10
HELD_OUT = 10  # one row in ten
MEMORY = 10  # earlier steps that shape the next one
DIGITS = 13  # of a summed gradient; the order of summation shows in the ones after
BLOCK_BYTES = 4 << 20
# Decay of the running means of slope and squared slope, and what keeps their quotient finite.
DECAY, SQUARE_DECAY, FLOOR = 0.9, 0.999, 1e-6


def shapes(sizes: list[int]) -> list[tuple[int, int]]:
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def initial(sizes: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes(sizes):
        bound = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def unpack(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for a, b in shapes(sizes):
        w = flat[at : at + a * b].reshape(a, b)
        layers.append((w, flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def forward(x: np.ndarray, layers) -> list[np.ndarray]:
    outs = [x]
    for i, (w, b) in enumerate(layers):
        z = outs[-1] @ w + b
        outs.append(np.maximum(z, 0.0) if i < len(layers) - 1 else z)
    return outs


def probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def error_sum(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss and its slope in the outputs ``z``.

    One output: half the squared error. More: the negative log-likelihood of the class with index ``y``.
    """
    if z.shape[1] == 1:
        delta = z - y[:, None]
        return 0.5 * float((delta * delta).sum()), delta
    top = z.max(axis=1, keepdims=True)
    log_sum = top[:, 0] + np.log(np.exp(z - top).sum(axis=1))
    own = np.arange(len(z)), y.astype(np.int64)
    delta = probabilities(z)
    loss = float((log_sum - z[own]).sum())
    delta[own] -= 1.0
    return loss, delta


def gradient_sum(x: np.ndarray, y: np.ndarray, flat: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Gradient of the loss, then the loss, summed over the rows."""
    layers = unpack(flat, sizes)
    outs = forward(x, layers)
    error, delta = error_sum(outs[-1], y)
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(outs[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
        if i:
            delta = (delta @ layers[i][0].T) * (outs[i] > 0)
    return np.append(np.concatenate(parts), error)


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (x, y, held) as blocks of numbers: held, x and y as bytes."""
    most = max(1, BLOCK_BYTES // (8 * width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), width)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            apart = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for held in (False, True):
                some = np.flatnonzero(apart == held)
                for start in range(0, len(some), most):
                    own = some[start : start + most]
                    cells = [pa.array([held]), pa.array([x[own].tobytes()]), pa.array([y[own].tobytes()])]
                    yield pa.RecordBatch.from_arrays(cells, names=["held", "x", "y"])

    return rows.select("x", "y", "held").mapInArrow(pack, "held boolean, x binary, y binary")


def _evaluate(packed: DataFrame, flat: np.ndarray, sizes: list[int], l2: float) -> tuple[float, np.ndarray, float]:
    """Penalised loss and gradient on the learning rows and the mean loss on the held-out ones: one job."""
    shared = packed.sparkSession.sparkContext.broadcast(flat)  # as long as the model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One block at a time, so a task's memory does not grow with its partition."""
        total, held, seen, apart = np.zeros(len(shared.value) + 1), 0.0, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                y = np.frombuffer(row["y"])
                x = np.frombuffer(row["x"]).reshape(len(y), -1)
                if row["held"]:
                    held += error_sum(forward(x, unpack(shared.value, sizes))[-1], y)[0]
                    apart += len(y)
                else:
                    total, seen = total + gradient_sum(x, y, shared.value, sizes), seen + len(y)
        if seen or apart:
            values = np.concatenate([total, [seen, held, apart]])
            columns = [pa.array(np.arange(len(values)), pa.int32()), pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, names=["pos", "v"])

    summed = packed.mapInArrow(sums, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).toPandas()
    shared.destroy()
    values = summed.sort_values("pos")["v"].to_numpy()
    n, held, apart = values[-3:]
    weights = np.concatenate(
        [np.append(np.ones(a * b), np.zeros(b)) for a, b in shapes(sizes)]
    )  # the penalty leaves the offsets alone
    slope = (values[:-4] + l2 * weights * flat) / n
    scale = 10.0 ** (np.floor(np.log10(np.abs(slope).max() or 1.0)) + 1)
    loss = (values[-4] + 0.5 * l2 * float((weights * flat * flat).sum())) / n
    return loss, np.round(slope / scale, DIGITS) * scale, held / apart if apart else loss


def _direction(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill by the two-loop recursion over the remembered (move, change of slope) pairs."""
    q, saved = slope.copy(), []
    for move, change in reversed(steps):
        a = (move @ q) / (move @ change)
        q -= a * change
        saved.append(a)
    if steps:
        move, change = steps[-1]
        q *= (move @ change) / (change @ change)
    for (move, change), a in zip(steps, reversed(saved), strict=True):
        q += (a - (change @ q) / (move @ change)) * move
    return -q


Evaluate = Callable[[np.ndarray], tuple[float, np.ndarray, float]]


def quasi_newton(evaluate: Evaluate, flat: np.ndarray) -> Iterator[tuple[np.ndarray, float | None]]:
    """Weights and watched loss after each evaluation; the loss is None where a step was too long."""
    loss, slope, held = evaluate(flat)
    yield flat, held
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while np.abs(slope).max() > 1e-7:
        way = _direction(slope, steps)
        if way @ slope >= 0:
            way, steps = -slope, []
        length = 1.0 if steps else min(1.0, 1.0 / np.abs(slope).sum())
        while length > 1e-10:
            found = evaluate(flat + length * way)
            if found[0] <= loss + 1e-4 * length * (way @ slope):
                break
            yield flat, None
            length /= 2
        else:
            return
        move, change = length * way, found[1] - slope
        if move @ change > 1e-12 * (change @ change):
            steps = [*steps[-(MEMORY - 1) :], (move, change)]
        flat = flat + move
        loss, slope, held = found
        yield flat, held


def by_rate(evaluate: Evaluate, flat: np.ndarray, rate: float) -> Iterator[tuple[np.ndarray, float | None]]:
    """Weights and watched loss after each step of the given rate."""
    mean, square, done = np.zeros_like(flat), np.zeros_like(flat), 0
    while True:
        _, slope, held = evaluate(flat)
        yield flat, held
        done += 1
        mean = DECAY * mean + (1 - DECAY) * slope
        square = SQUARE_DECAY * square + (1 - SQUARE_DECAY) * slope * slope
        size = np.sqrt(square / (1 - SQUARE_DECAY**done)) + FLOOR
        flat = flat - rate * (mean / (1 - DECAY**done)) / size


def descend(path: Iterator[tuple[np.ndarray, float | None]], max_iter: int, tol: float) -> tuple[np.ndarray, int]:
    """The weights with the least watched loss, and the number of evaluations after the first.

    Ends after ``max_iter`` of them, or once ``PATIENCE`` steps together gained less than ``tol``.
    """
    best, least, done, seen = None, np.inf, -1, []
    for flat, held in path:
        done += 1
        if held is not None:
            if held < least:
                best, least = flat, held
            seen.append(least)
            if len(seen) > PATIENCE and seen[-PATIENCE - 1] - least < tol:
                break
        if done >= max_iter:
            break
    return best, done


def fit_weights(
    base: DataFrame,
    sizes: list[int],
    *,
    max_iter: int,
    l2: float,
    seed: int,
    learning_rate: float | None,
    early_stopping: bool,
    tol: float,
) -> tuple[np.ndarray, int]:
    """Weights for ``base`` (x, y)."""
    if max_iter < 1:
        raise ValueError("max_iter must be positive")
    if learning_rate is not None and not learning_rate > 0:
        raise ValueError("learning_rate must be positive")
    # Standardised values differ in their last digits with the order of summation; the choice must not.
    part = F.pmod(F.xxhash64(F.transform("x", lambda v: F.round(v, 6)), F.round("y", 6), F.lit(seed)), F.lit(HELD_OUT))
    parted = base.select("x", "y", (part == 0).alias("held") if early_stopping else F.lit(False).alias("held"))
    if early_stopping and parted.where("not held").isEmpty():
        parted = parted.withColumn("held", F.lit(False))
    packed = blocks(parted, sizes[0]).persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray, float]:
            return _evaluate(packed, flat, sizes, l2)

        flat = initial(sizes, seed)
        path = quasi_newton(evaluate, flat) if learning_rate is None else by_rate(evaluate, flat, learning_rate)
        return descend(path, max_iter, tol)
    finally:
        packed.unpersist()


def _outputs(flat: np.ndarray, sizes: list[int]) -> Callable[[Column], Column]:
    """The last layer's values for a column of inputs; NULL inputs have NULL outputs."""
    weights = [float(v) for v in flat]

    @F.pandas_udf(ArrayType(DoubleType()))
    def predict(x: pd.Series) -> pd.Series:
        out: list[list[float] | None] = [None] * len(x)
        known = np.flatnonzero(x.notna().to_numpy())
        if len(known):
            z = forward(np.stack(x.iloc[known].to_numpy()), unpack(np.asarray(weights), sizes))[-1]
            for i, row in zip(known, z, strict=True):
                out[i] = row.tolist()
        return pd.Series(out, dtype=object)

    return predict


class _Network(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Persists like any Spark ML stage."""

    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "flat weights", TypeConverters.toListFloat)
    sizes = Param(Params._dummy(), "sizes", "layer sizes", TypeConverters.toListInt)
    rounds = Param(Params._dummy(), "rounds", "training rounds", TypeConverters.toInt)

    def outputs(self, dataset: DataFrame) -> Column:
        name = self.getOrDefault(self.featuresCol)
        vector = F.col(name)
        if isinstance(dataset.schema[name].dataType, VectorUDT):
            vector = vector_to_array(vector)
        return _outputs(np.asarray(self.getOrDefault(self.weights)), self.getOrDefault(self.sizes))(vector)


class MLPRegressionModel(_Network):
    """Adds ``prediction`` to rows with the feature vector."""

    shift = Param(Params._dummy(), "shift", "target mean", TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", "target scale", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = self.outputs(dataset)[0] * self.getOrDefault(self.scale) + self.getOrDefault(self.shift)
        return dataset.withColumn("prediction", value)


class MLPClassificationModel(_Network):
    """Adds ``rawPrediction`` (of two classes: log-odds), ``probability`` and ``prediction``, the class index."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        added = ("rawPrediction", "probability", "prediction")
        kept = [F.col(f"`{c}`") for c in dataset.columns if c not in added]
        out = dataset.select(*kept, self.outputs(dataset).alias("__z"))
        z = F.col("__z")
        raw = z
        if self.getOrDefault(self.sizes)[-1] == 2:
            raw = F.array(z[0] - z[1], z[1] - z[0])
        top = F.array_max(z)
        grown = F.transform(z, lambda v: F.exp(v - top))
        total = F.aggregate(grown, F.lit(0.0), lambda a, v: a + v)
        return out.select(
            *kept,
            array_to_vector(raw).alias("rawPrediction"),
            array_to_vector(F.transform(grown, lambda v: v / total)).alias("probability"),
            (F.array_position(z, top) - 1).cast("double").alias("prediction"),
        )


def fit_mlp(
    rows: DataFrame,
    features: str,
    label: str,
    *,
    classes: int | None = None,
    hidden: tuple[int, ...] = (128, 64),
    max_iter: int = 300,
    l2: float = 1e-4,
    seed: int = 42,
    learning_rate: float | None = None,
    early_stopping: bool = True,
    tol: float = 1e-4,
) -> MLPRegressionModel | MLPClassificationModel:
    """Regression, or with ``classes`` classification of labels 0 to ``classes`` - 1."""
    vector = F.col(features)
    if isinstance(rows.schema[features].dataType, VectorUDT):
        vector = vector_to_array(vector)
    base = rows.select(vector.alias("x"), F.col(label).cast("double").alias("y"))
    head = base.agg(
        F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.max(F.size("x")).alias("d")
    ).first()
    sizes = [head["d"], *hidden, classes or 1]
    how = dict(
        max_iter=max_iter, l2=l2, seed=seed, learning_rate=learning_rate, early_stopping=early_stopping, tol=tol
    )
    if classes is None:
        shift, scale = head["m"], head["s"] or 1.0
        model = MLPRegressionModel()
        model._set(shift=float(shift), scale=float(scale))
        base = base.select("x", ((F.col("y") - shift) / scale).alias("y"))
    else:
        model = MLPClassificationModel()
    best, done = fit_weights(base, sizes, **how)
    model._set(featuresCol=features, weights=[float(v) for v in best], sizes=sizes, rounds=done)
    return model
