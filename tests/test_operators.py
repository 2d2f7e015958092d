"""Operators on hand-sized inputs, and against plain Python where SQL can't express them."""

import math

import numpy as np
from pyspark.sql import functions as F

from segspark.operators import frames, scores, segments, sequences, training, vectors
from segspark.sources import formats


def test_decisions_inclusive_and_strict(spark):
    row = spark.createDataFrame([(3.0,), (2.0,), (1.0,)], "llr double").select((F.col("llr") >= 2).alias("a"), (F.col("llr") > 2).alias("b")).collect()
    assert [tuple(r) for r in row] == [(True, True), (True, False), (False, False)]


def test_fusion_of_equal_systems_is_the_identity(spark):
    rows = spark.createDataFrame([(0.1,), (-7.0,)], "s double").select(((0.5 * F.col("s") + 0.5 * F.col("s")) / 1.0).alias("x"), "s").collect()
    assert all(r["x"] == r["s"] for r in rows)


def test_time_to_frame_and_back(spark):
    row = spark.range(1).select(segments.time_to_frame(F.lit(0.25)).alias("f"), segments.time_to_frame(F.lit(0.07)).alias("g"), segments.frame_to_time(F.lit(26)).alias("t")).first()
    assert (row["f"], row["g"], row["t"]) == (25, 7, 0.26)


def test_equal_cohort_scores_give_null(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.0)], "client string, segment long, llr double")
    assert [r["llr"] for r in scores.normalised(rows, rows, "segment").collect()] == [None, None]


def test_subtract_cuts_all_of_b(spark):
    a = spark.createDataFrame([(1, 0, 10, "x"), (2, 5, 3, "y")], "source long, begin long, length long, label string")
    b = spark.createDataFrame([(1, 2, 2), (1, 3, 2), (1, 8, 9)], "source long, begin long, length long")
    got = sorted(tuple(r) for r in segments.subtract(a, b).select("source", "begin", "length", "label").collect())
    assert got == [(1, 0, 2, "x"), (1, 5, 3, "x"), (2, 5, 3, "y")]


def test_meanvar_has_mean_0_and_variance_1(spark):
    rows = spark.createDataFrame([(1, i, float(i * i)) for i in range(20)], "source long, frame_idx long, x double")
    out = frames.mean_variance(rows).agg(F.avg("x"), F.var_pop("x")).first()
    assert math.isclose(out[0], 0, abs_tol=1e-12) and math.isclose(out[1], 1)


def test_online_cmvn_equals_the_recurrence(spark):
    x = [3.0, 5.0, 4.0, 9.0, 1.0]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "source long, frame_idx long, x double")
    mean = square = None
    want = []
    for v in x:
        mean = v if mean is None else 0.75 * mean + 0.25 * v
        square = v * v if square is None else 0.75 * square + 0.25 * v * v
        want.append((v - mean) / math.sqrt(square - mean * mean) if square > mean * mean else None)
    got = [r["x"] for r in frames.online_cmvn(rows, 4.0).orderBy("frame_idx").collect()]
    assert got[0] is None and np.allclose(got[1:], want[1:])


def test_longest_match(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 1, 2, 0, 1, 3])], "source long, pos long, sym long")
    got = [(r["pos"], r["word"]) for r in sequences.longest_match(rows, [[0, 1], [0, 1, 2], [3]]).orderBy("pos").collect()]
    assert got == [(0, 1), (3, 0), (5, 2)]


def test_em_never_loses_likelihood(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(-3, 1, (60, 2)), rng.normal(3, 1, (60, 2))])
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    w, mu, var, history = training.train_mixture(rows, *training.split_init(x.mean(0), x.var(0), 1), rounds=6)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    assert np.allclose(np.sort(mu[:, 0]), [x[:60, 0].mean(), x[60:, 0].mean()], atol=0.2)


def test_viterbi_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=(7, 2))
    rows = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(e)], "source long, frame_idx long, a double, b double")
    got = [r["state"] for r in training.viterbi(rows, "frame_idx", ["a", "b"], 0.7).orderBy("frame_idx").collect()]
    best = max((sum(e[t, (k >> t) & 1] for t in range(7)) + sum(math.log(0.7 if (k >> t & 1) == (k >> t - 1 & 1) else 0.3) for t in range(1, 7)), k) for k in range(128))[1]
    assert got == [best >> t & 1 for t in range(7)]


def test_covariance_and_lda(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)) + np.repeat(np.array([[0, 0, 0], [4, 0, 0], [0, 0, 4]]), 30, 0)
    rows = spark.createDataFrame([(i, i // 30, r.tolist()) for i, r in enumerate(x)], "vec_id long, label long, v array<double>")
    mean, cov = vectors.covariance(rows)
    assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    assert vectors.lda(rows, "label", 2).shape == (2, 3)


def test_svm_separates(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-2, 0.5, (30, 2)), rng.normal(2, 0.5, (30, 2))])
    y = np.repeat([-1.0, 1.0], 30)
    w, b = training.train_svm(spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "v array<double>, y double"))
    assert (np.sign(x @ w + b) == y).all()


def test_label_and_list_files(spark, tmp_path):
    (tmp_path / "a.lbl").write_text("0 0.25 male\n\n0.3 0.4 female\n")
    (tmp_path / "l.ndx").write_text("test3  test1 test2\n")
    got = sorted(tuple(r) for r in formats.read_labels(spark, f"file://{tmp_path}/a.lbl").collect())
    assert got == [("a", 0, 26, "male"), ("a", 30, 11, "female")]
    assert sorted(tuple(r) for r in formats.read_list(spark, f"file://{tmp_path}/l.ndx").collect()) == [("test3", 0, "test1"), ("test3", 1, "test2")]


def test_running_mean_of_a_stream(spark, tmp_path):
    from segspark.streaming.online import running_mean

    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "client string, x double").write.parquet(f"{tmp_path}/in")
    stream = running_mean(spark.readStream.schema("client string, x double").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("running").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("running").collect()) == [("a", 2, 2.0), ("b", 1, 5.0)]
