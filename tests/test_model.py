"""Newton's fit of several models at once, and what can't be fitted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import model, resampling
from quillmark.plans import training


def rows_of(spark, x, y, models):
    return spark.createDataFrame([(int(m), bool(t), r.tolist()) for m, t, r in zip(models, y, x)], "model int, is_bot boolean, vec array<double>")


def test_models_side_by_side_are_each_at_their_optimum(spark):
    rng = np.random.default_rng(1)
    x, models = rng.random((300, 4)), rng.integers(0, 3, 300)
    y = x[:, 0] * models + 0.3 * rng.normal(size=300) > 0.5
    fitted = model.fit_models(rows_of(spark, x, y, models).repartition(4))
    for m in range(3):
        own, t = x[models == m], y[models == m]
        w, b = fitted[m]
        p = 1 / (1 + np.exp(-(own @ w + b)))
        assert np.abs(own.T @ (p - t) + w).max() < 1e-9 and abs((p - t).sum()) < 1e-9


def test_separable_and_single_label_rows(spark):
    x = np.array([[0.0], [0.1], [0.9], [1.0]] * 5) * 50
    w, b = model.fit_models(rows_of(spark, x, x[:, 0] > 20, np.zeros(20)))[0]
    assert np.isfinite(w).all() and w[0] > 0
    with pytest.raises(model.NotConverged):
        model.fit_models(rows_of(spark, x, np.ones(20), np.zeros(20)))
    with pytest.raises(Exception, match="missing component"):
        model.fit_models(spark.createDataFrame([(0, True, [None]), (0, False, [1.0])], "model int, is_bot boolean, vec array<double>"))


def test_seeded_folds_are_the_plain_ones(spark):
    pairs = spark.createDataFrame([(i, f"b{i:02d}", f"h{i:02d}") for i in range(23)], "pair long, bot string, human string")
    want = resampling.pair_folds([(2 * i, 2 * i + 1) for i in range(23)], np.array([1, 0] * 23), 5, np.random.default_rng(42))
    got = {r.uid: r.fold for r in training.fold_table(pairs, seed=42).collect()}
    assert got == {f"{'bh'[i % 2]}{i // 2:02d}": f for i, f in want.items()}
    hashed = training.hashed_folds(pairs).withColumn("pair", F.substring("uid", 2, 2)).groupBy("pair").agg(F.countDistinct("fold").alias("n"), F.count("*").alias("m")).collect()
    assert {(r.n, r.m) for r in hashed} == {(1, 2)} and len(hashed) == 23
