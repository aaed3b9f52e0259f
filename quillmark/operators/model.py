"""The supervised score: L2 logistic regression on training-scale percentiles.

The penalty is half the squared weights beside the summed loss, the intercept is free. Newton's
steps solve for all models at once: tasks add up gradients and Hessians of their rows for every
model, rows of the sums meet by (model, key), and what the driver solves has the size of the
keys, whatever the number of accounts. Folds are a key column of one plan: a fold's transform
and model are those of the rows outside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.staging import staged

from .ranks import apply_knots, fit_knots

_KEY = ["block", "key"]


class NotConverged(RuntimeError):
    pass


def vectors(percentiles: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """uid (and extra columns), vec: percentiles in the order of (block, key)."""
    return percentiles.groupBy("uid", *extra).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "key", "p"))), lambda x: x["p"]).alias("vec"))


class Logistic(NamedTuple):
    weights: np.ndarray
    intercept: float


def _sums(rows: DataFrame, state: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each model: the summed loss, its gradient and its Hessian (intercept first)."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            models, y = batch.column("model").to_numpy(), batch.column("is_bot").to_numpy(zero_copy_only=False).astype(float)
            vec = batch.column("vec")
            if vec.null_count or vec.values.null_count:
                raise ValueError("a vector has a missing component")
            x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(models), -1)
            x = np.hstack([np.ones((len(x), 1)), x])
            for m in np.unique(models).tolist():
                own, t = x[models == m], y[models == m]
                z = own @ state[m]
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = (np.logaddexp(0, z) - t * z).sum()
                rows_ = np.hstack([(own * (p * (1 - p))[:, None]).T @ own, (own.T @ (p - t))[:, None], np.full((own.shape[1], 1), loss)])
                sums[m] = sums[m] + rows_ if m in sums else rows_
        for m, whole in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(whole), pa.int32()), pa.array(range(len(whole)), pa.int32()), pa.array([r.tobytes() for r in whole], pa.binary())], ["model", "i", "row"])

    def merge(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(r) for r in table.column("row").to_pylist())
        return pa.table({"model": table.column("model")[:1], "i": table.column("i")[:1], "row": pa.array([whole.tobytes()], pa.binary())})

    parts = rows.select("model", "is_bot", "vec").mapInArrow(add_up, "model int, i int, row binary")
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.groupBy("model", "i").applyInArrow(merge, "model int, i int, row binary").collect():
        found.setdefault(r.model, {})[r.i] = np.frombuffer(bytes(r.row))
    wholes = {m: np.stack([own[i] for i in range(len(own))]) for m, own in found.items()}
    return {m: (w[0, -1], w[:, -2], w[:, :-2]) for m, w in wholes.items()}


def fit_models(rows: DataFrame, max_iter: int = 50, tol: float = 1e-10) -> dict[int, Logistic]:
    """rows (model, is_bot, vec) to each model's weights. A step that makes the loss greater is
    halved. Raises if a model has no optimum within the iterations, as with one label only."""
    rows = staged(rows.select(F.col("model").cast("int"), "is_bot", "vec"), "newton")
    models = rows.groupBy("model").agg(F.max(F.size("vec")).alias("d"), F.countDistinct("is_bot").alias("labels")).collect()
    if any(r.labels < 2 for r in models):
        raise NotConverged("a model has rows of one label only")
    at = {r.model: np.zeros(r.d + 1) for r in models}
    step = {m: np.zeros(len(w)) for m, w in at.items()}
    least, done = dict.fromkeys(at, np.inf), {}
    for _ in range(max_iter):
        for m, (loss, gradient, hessian) in _sums(rows.where(F.col("model").isin(list(at))), at).items():
            penalty = np.ones(len(at[m]))
            penalty[0] = 0
            loss += (penalty * at[m] ** 2).sum() / 2
            if loss > least[m] + 1e-9 * (1 + abs(loss)):
                step[m] /= 2
                at[m] = at[m] - step[m]
                continue
            least[m] = loss
            step[m] = np.linalg.solve(hessian + np.diag(penalty), -(gradient + penalty * at[m]))
            at[m] = at[m] + step[m]
            if np.abs(step[m]).max() < tol:
                done[m] = Logistic(at[m][1:], float(at[m][0]))
        at = {m: w for m, w in at.items() if m not in done}
        if not at:
            return done
    raise NotConverged(f"no convergence in {max_iter} iterations")


def fit_logistic(rows: DataFrame, max_iter: int = 50, tol: float = 1e-10) -> Logistic:
    """rows (is_bot, vec) to one model."""
    return fit_models(rows.select(F.lit(0).alias("model"), "is_bot", "vec"), max_iter, tol)[0]


def _table(spark, models: dict[int, Logistic]) -> DataFrame:
    return spark.createDataFrame([(m, own.weights.tolist(), own.intercept) for m, own in models.items()], "model int, weights array<double>, intercept double")


def _scored(rows: DataFrame) -> DataFrame:
    z = F.aggregate(F.zip_with("vec", "weights", lambda x, w: x * w), F.col("intercept"), lambda a, x: a + x)
    return rows.withColumn("L", 1 / (1 + F.exp(-z))).drop("weights", "intercept")


def score(model: Logistic, rows: DataFrame) -> DataFrame:
    """rows (uid, vec, ...) with L, the probability of a bot."""
    return _scored(rows.crossJoin(F.broadcast(_table(rows.sparkSession, {0: model}).drop("model"))))  # one row


class Bundle:
    """A fitted transform and model: knots and medians of its training rows, and the weights."""

    def __init__(self, knots: DataFrame, medians: DataFrame, model: Logistic):
        self.knots, self.medians, self.model = knots, medians, model

    def percentiles(self, long: DataFrame) -> DataFrame:
        return apply_knots(long, self.knots, self.medians)

    def save(self, path: str) -> None:
        self.knots.write.mode("overwrite").parquet(f"{path}/knots")
        self.medians.write.mode("overwrite").parquet(f"{path}/medians")
        _table(self.knots.sparkSession, {0: self.model}).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark, path: str) -> Bundle:
        row = spark.read.parquet(f"{path}/model").first()
        return Bundle(spark.read.parquet(f"{path}/knots"), spark.read.parquet(f"{path}/medians"), Logistic(np.array(row.weights), row.intercept))


def fit_bundle(long: DataFrame) -> Bundle:
    """long (uid, is_bot, block, key, value): transform and model of these rows alone."""
    knots, medians = (staged(x, "knots") for x in fit_knots(long))
    p = apply_knots(long, knots, medians)
    return Bundle(knots, medians, fit_logistic(vectors(p, ("is_bot",))))


def out_of_fold(long: DataFrame, folds: DataFrame) -> DataFrame:
    """uid, is_bot, fold, L: each fold is scored by a transform and model of the others.
    long (uid, is_bot, block, key, value), folds (uid, fold; a few)."""
    rows = long.join(folds, "uid").select("uid", "is_bot", F.col("fold").cast("int").alias("fold"), *_KEY, "value")
    names = F.array(*(F.lit(r.fold) for r in folds.select(F.col("fold").cast("int").alias("fold")).distinct().orderBy("fold").collect()))
    keyed = staged(rows.withColumn("model", F.explode(names)), "folds")
    keys = ["model", *_KEY]
    knots, medians = (staged(x, "knots") for x in fit_knots(keyed.where("model <> fold"), keys))
    vec = staged(vectors(apply_knots(keyed, knots, medians, keys), ("is_bot", "fold", "model")), "vectors")
    fitted = fit_models(vec.where("model <> fold"))
    held = vec.where("model = fold").join(F.broadcast(_table(long.sparkSession, fitted)), "model")  # a row for each fold
    return _scored(held).select("uid", "is_bot", "fold", "L")
