"""Segmentation loops, approximate factors, targets and expansions against plain computations."""

import itertools
import math

import numpy as np
import pytest

from segspark.operators import diarize, factors, scores, training, vectors
from test_factors import stats


def test_transitions_are_distributions():
    for policy in ("equal", "constant", "time"):
        assert np.allclose(diarize.transitions([3, 5, 2], policy, 0.7).sum(1), 1)
    assert (diarize.transitions([3, 5], "unity") == 1).all()
    assert np.allclose(diarize.transitions([1, 3, 1], "time", 0.6)[0], [0.6, 0.3, 0.1])
    with pytest.raises(ValueError):
        diarize.transitions([1, 2], "other")


def test_best_path_equals_all_paths():
    rng = np.random.default_rng(3)
    e, move = rng.normal(size=(6, 3)), diarize.transitions([1, 2, 3], "time", 0.5)
    value = lambda p: e[range(6), p].sum() + sum(math.log(move[a, b]) for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(3), repeat=6), key=value)
    path, score = diarize.best_path(e, move)
    assert tuple(path) == best and math.isclose(score, value(best))


def test_a_break_costs_no_transition():
    e = np.array([[0.0, -1.0], [-1.0, 0.0]])
    path, score = diarize.best_path(e, np.eye(2), np.array([False, True]))
    assert path.tolist() == [0, 1] and score == 0


def test_resegment_moves_a_boundary_and_drops_short_labels():
    x = np.concatenate([np.zeros(30), np.full(30, 9.0)])[:, None] + np.random.default_rng(0).normal(size=(60, 1)) * 0.3
    labels = ["a"] * 22 + ["b"] * 36 + ["c"] * 2
    got, _ = diarize.resegment(x, labels)
    assert got == ["a"] * 30 + ["b"] * 30


def test_constant_and_single_frames_settle(spark):
    assert diarize.resegment(np.zeros((5, 1)), ["a", "a", "a", "b", "b"])[0] == ["a"] * 5
    assert diarize.resegment(np.zeros((1, 2)), ["a"])[0] == ["a"]
    assert diarize.add_speakers(np.zeros((3, 1))) == ["S0"] * 3
    empty = spark.createDataFrame([], "source long, frame_idx long, v array<double>, label string")
    assert diarize.resegmented(empty).count() == 0 and diarize.speakers(empty).count() == 0


def test_speakers_are_found_in_each_recording(spark):
    rng = np.random.default_rng(1)
    two = np.concatenate([rng.normal(0, 1, 60), rng.normal(30, 1, 60)])
    rows = [(s, i, [float(x)]) for s, xs in ((1, two), (2, rng.normal(0, 1, 50))) for i, x in enumerate(xs)]
    got = diarize.speakers(spark.createDataFrame(rows, "source long, frame_idx long, v array<double>")).collect()
    by = {s: [r["label"] for r in sorted(got, key=lambda r: r["frame_idx"]) if r["source"] == s] for s in (1, 2)}
    assert len(set(by[1][:60])) == 1 and len(set(by[1][60:])) == 1 and by[1][0] != by[1][-1]
    assert set(by[2]) == {"S0"}


def test_delta_bic_tells_same_from_different():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(80, 2)), rng.normal(size=(80, 2)) + [4, 0]
    same, other = diarize.delta_bic(a[:40], a[40:]), diarize.delta_bic(a, np.concatenate([b[:40] * 3, b[40:] - 20]))
    assert abs(same) < 20 and other < same


def test_initial_states(spark):
    rows = spark.createDataFrame([(1, "speech"), (1, "speech"), (1, "nonspeech"), (1, "x")], "source long, label string")
    names = lambda kind: sorted((r["state"], r["model"]) for r in diarize.init_states(rows, kind).collect())
    assert names("speech") == [("nonspeech", "nonspeech"), ("speech", "speech")]
    assert names("world") == [("world", "world")] and len(names("segments")) == 3 and len(names("overlap")) == 4


@pytest.mark.parametrize("mode", ["weights", "eigen"])
def test_approximations_are_exact_where_they_hold(spark, mode):
    """weights: counts in the ratio of the weights; eigen: component blocks that commute."""
    rng = np.random.default_rng(5)
    c, d, rank = 3, 4, 2
    w, mu, var = np.array([0.5, 0.3, 0.2]), rng.normal(size=(c, d)), np.ones((c, d))
    base = rng.normal(size=(d, rank))
    t = rng.normal(size=(c, d, rank)) if mode == "weights" else np.stack([base, 2 * base, 0.5 * base])
    n = [(total * w if mode == "weights" else rng.uniform(1, 9, c)) for total in (3.0, 40.0)]
    rows = spark.createDataFrame([(i, x.tolist(), rng.normal(size=c * d).tolist()) for i, x in enumerate(n)], "key long, n array<double>, f array<double>")
    near = {r["key"]: r["w"] for r in factors.approximate_factors(rows, "key", t, mu, var, w, mode).collect()}
    exact = {r["key"]: r["w"] for r in training.factors(rows, "key", t, mu, var).collect()}
    assert all(np.allclose(near[k], exact[k]) for k in exact)


def test_targets_equal_the_plain_loop(spark):
    rows, mu, var = stats(spark, rows=8)
    u, tau = np.random.default_rng(7).normal(size=(*mu.shape, 2)), 16.0
    data = sorted(rows.collect(), key=lambda r: r["key"])
    n, f = np.array([r["n"] for r in data]), np.array([r["f"] for r in data]).reshape(8, *mu.shape)
    who = np.arange(8) % 3
    offset = np.zeros((3, *mu.shape))
    for _ in range(2):
        x, _ = training._latent(n, f - n[:, :, None] * (mu + offset[who]), u, var)
        rest = f - n[:, :, None] * (mu + np.einsum("cdi,ui->ucd", u, x))
        offset = np.stack([rest[who == s].sum(0) / (n[who == s].sum(0)[:, None] + tau) for s in range(3)])
    got = factors.train_targets(rows.selectExpr("key", "n", "f", "key % 3 as who"), "key", "who", u, mu, var).collect()
    assert all(np.allclose(r["offset"], offset[r["who"]].ravel()) for r in got)


def test_expansion_has_all_monomials(spark):
    x = [2.0, 3.0, 5.0]
    one = [1.0, *x]
    want = [a * b * c for i, a in enumerate(one) for j, b in enumerate(one[i:], i) for c in one[j:]]
    rows = spark.createDataFrame([("a", x), ("a", [0.0, 0.0, 0.0])], "k string, v array<double>")
    from pyspark.sql import functions as F

    assert rows.limit(1).select(vectors.cubic(F.col("v")).alias("m")).first()["m"] == want
    means = {(r["i"], r["j"], r["k_"]): r["x"] for r in vectors.mean_expansion(rows.withColumnRenamed("k", "key"), "key").withColumnRenamed("k", "k_").collect()}
    places = [(i, j, k) for i in range(4) for j in range(i, 4) for k in range(j, 4)]
    assert [means[p] for p in places] == [1.0] + [m / 2 for m in want[1:]]


def test_nearest_target_of_ties(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 3.0), ("e", 5.0)], "client string, llr double")
    cohort = sorted((r["client"], r["cohort"]) for r in scores.nearest_cohort(rows, 2).collect())
    assert cohort[:4] == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c")] and len(cohort) == 10
