"""Factor models on small inputs."""

import numpy as np

from segspark.operators import factors, training


def stats(spark, seed=0, rows=40, c=3, d=4, rank=2):
    rng = np.random.default_rng(seed)
    mu, var = rng.normal(size=(c, d)), np.ones((c, d))
    t = rng.normal(size=(c, d, rank))
    data = []
    for i in range(rows):
        n = rng.uniform(5, 15, c)
        f = n[:, None] * (mu + t @ rng.normal(size=rank)) + np.sqrt(n)[:, None] * rng.normal(size=(c, d))
        data.append((i, n.tolist(), f.ravel().tolist()))
    return spark.createDataFrame(data, "key long, n array<double>, f array<double>"), mu, var


def test_training_raises_the_likelihood(spark):
    rows, mu, var = stats(spark)
    values = [factors.log_likelihood(rows, training.train_subspace(rows, mu, var, 2, k), mu, var) for k in range(4)]
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:]))


def test_minimum_divergence_keeps_the_span(spark):
    rows, mu, var = stats(spark)
    t = training.train_subspace(rows, mu, var, 2, 2)
    moved, _ = factors.minimum_divergence(rows, t, mu, var)
    a, b = t.reshape(-1, 2), moved.reshape(-1, 2)
    assert np.linalg.matrix_rank(np.column_stack([a, b]), tol=1e-8) == 2


def test_orthonormal():
    t = factors.orthonormal(np.random.default_rng(1).normal(size=(3, 5, 4))).reshape(-1, 4)
    assert np.allclose(t.T @ t, np.eye(4))


def test_added_equals_the_sum(spark):
    rows, _, _ = stats(spark)
    total = factors.added(rows.selectExpr("key % 2 as k", "n", "f"), "k").orderBy("k").collect()
    data = rows.orderBy("key").collect()
    assert np.allclose(total[1]["f"], np.sum([r["f"] for r in data if r["key"] % 2], axis=0))


def test_plda_finds_the_class_directions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(j), (np.array([k, 0, 0]) * 3 + rng.normal(size=3)).tolist()) for i, k in enumerate(rng.normal(size=30)) for j in range(6)]
    _, load, resid = factors.train_plda(spark.createDataFrame(rows, "label long, j double, v array<double>"), "label", 1, 10)
    assert abs(load[0, 0]) > 5 * np.abs(load[1:, 0]).max() and np.allclose(np.diag(resid), 1, atol=0.5)


def test_adaptation_follows_matching_tests():
    import pandas as pd

    x = [[0.9, 0.1], [0.8, 0.3], [-1.0, 0.0]]
    score, model = factors.adapted_in_order(pd.DataFrame({"v": x}), np.array([1.0, 0.0]))
    assert score[0] > 0.9 and score[2] < 0 and model[0] > 0.8
