"""Vectors and models: covariances, norms, subspaces, trial scores and mixture likelihoods.

Sums and joins run on the cluster in a vectorised form; what is solved densely on the driver (an
eigen- or Cholesky factor) is dims x dims, whatever the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.operators.scores import r
from segspark.operators.training import _dense, _named_world, _summed, component_likelihoods, responsibilities
from segspark.registry import query

#: Most dimensions whose square is gathered on the driver.
DIMS = 4096
#: Keys whose monomial sums a task holds.
KEYS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def mean_vectors(rows: DataFrame, by: str, out: str = "v") -> DataFrame:
    """(by, out): mean vector of each key, summed by position so that partial sums combine."""
    sums = rows.select(by, F.posexplode("v").alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(out))


def scatter(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum and sum of outer products of `v`: one dims x dims block from each task."""
    dims = rows.select(F.max(F.size("v"))).first()[0] or 0
    if dims > DIMS:
        raise ValueError(f"{dims} dimensions; at most {DIMS}")

    def work(parts):
        n, s, ss = 0, np.zeros(dims), np.zeros((dims, dims))
        for part in parts:
            x = np.stack(part["v"].to_numpy()) if len(part) else np.zeros((0, dims))
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pd.DataFrame({"row": np.arange(dims + 1), "n": n, "v": [s.tolist(), *ss.tolist()]})

    blocks = rows.select("v").mapInPandas(work, "row int, n long, v array<double>")
    total = blocks.select("row", "n", F.posexplode("v").alias("pos", "x")).groupBy("row", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    out, n = np.zeros((dims + 1, dims)), 0
    for row, pos, x, count in total:
        out[row, pos], n = x, count
    return n, out[0], out[1:]


def covariance(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance."""
    n, s, ss = scatter(rows)
    mean = s / max(n, 1)
    return mean, ss / max(n, 1) - np.outer(mean, mean)


def within_covariance(rows: DataFrame, by: str) -> np.ndarray:
    """Pooled covariance around the key's means."""
    centred = rows.join(mean_vectors(rows, by, "m"), by).select(F.zip_with("v", "m", lambda x, y: x - y).alias("v"))
    n, _, ss = scatter(centred)
    return ss / max(n, 1)


def mapped(rows: DataFrame, matrix: np.ndarray, column: str = "v") -> DataFrame:
    """matrix @ v for every row, in Arrow batches."""
    m = matrix.copy()
    kind = "array<double>"

    @F.pandas_udf(kind)
    def turn(x: pd.Series) -> pd.Series:
        return pd.Series((np.stack(x.to_numpy()) @ m.T).tolist()) if len(x) else x

    return rows.withColumn(column, turn(column))


def whitened(rows: DataFrame, rounds: int = 1) -> DataFrame:
    """Centred, whitened by the covariance and scaled to unit length, `rounds` times."""
    for _ in range(rounds):
        mean, cov = covariance(rows)
        w, q = np.linalg.eigh(cov)
        centre = F.array(*[F.lit(float(x)) for x in mean])
        rows = mapped(rows.withColumn("v", F.zip_with("v", centre, lambda x, y: x - y)), q @ np.diag(1 / np.sqrt(np.maximum(w, 1e-12))) @ q.T)
        rows = rows.withColumn("v", unit(F.col("v")))
    return rows


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def trial_scores(trials: DataFrame, models: DataFrame, segments: DataFrame, score) -> DataFrame:
    """model, segment, score(m, s) for each trial; the models' side is the small one and joins by key."""
    joined = trials.join(segments.select(F.col("vec_id").alias("segment"), F.col("v").alias("s")), "segment").join(models.select(F.col("label").alias("model"), F.col("v").alias("m")), "model")
    return joined.select("model", "segment", score(F.col("m"), F.col("s")).alias("score"))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance by coordinate of `v`, summed around the first row."""
    first = rows.select("v").first()
    if first is None:
        raise ValueError("no rows")
    around = np.array(first[0])
    s = _summed(rows.select("v"), lambda b: np.stack([(x := _dense(b["v"]) - around).sum(0), (x * x).sum(0), np.full(x.shape[1], len(x))]))
    mean = s[0] / s[2]
    return mean + around, s[1] / s[2] - mean * mean


def likelihoods(v, rows: DataFrame | None = None) -> tuple[list, DataFrame]:
    """The components' names and vec_id, label, v, lk: by component, the log of weight times the diagonal Gaussian's density."""
    names, w, mu, var = _named_world(v)

    @F.pandas_udf("array<double>")
    def densities(x: pd.Series) -> pd.Series:
        return pd.Series(list(component_likelihoods(_dense(x), w, mu, var))) if len(x) else x

    return names, (v.embeddings if rows is None else rows).withColumn("lk", densities("v"))


def log_sum(lk: Column) -> Column:
    """Log of the sum of exponentials of an array."""
    return F.array_max(lk) + F.ln(F.aggregate(lk, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(lk))))


def posteriors(rows: DataFrame) -> DataFrame:
    """rows with llk (of the mixture) and gamma, the posterior by component."""
    return rows.withColumn("llk", log_sum(F.col("lk"))).withColumn("gamma", F.transform("lk", lambda x: F.exp(x - F.col("llk"))))


def ranked(lk: Column) -> Column:
    """Components (lk, i), the likeliest first, ties by place."""
    return F.transform(F.array_sort(F.transform(lk, lambda x, i: F.struct((-x).alias("lk"), i.alias("i")))), lambda s: F.struct((-s["lk"]).alias("lk"), s["i"].alias("i")))


def named(names: list, place: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), place)


_LK = ", lk AS (SELECT vec_id, comp, ln(any_value(weight)) + sum(-0.5 * (ln(2 * pi() * var) + (x - mu) * (x - mu) / var)) AS lk FROM vectors JOIN comps USING (pos) GROUP BY vec_id, comp), top AS (SELECT vec_id, max(lk) AS top FROM lk GROUP BY vec_id), llk AS (SELECT vec_id, any_value(top) + ln(sum(exp(lk - top))) AS llk FROM lk JOIN top USING (vec_id) GROUP BY vec_id), post AS (SELECT vec_id, comp, lk, llk, exp(lk - llk) AS gamma FROM lk JOIN llk USING (vec_id))"


@query("gmm_llk", "GMM-01 SRC-08 SCO-01 AGG-10", f"{_LK} SELECT vec_id, round(llk, 5) AS llk FROM llk")
def _(v):
    return likelihoods(v)[1].select("vec_id", r(log_sum(F.col("lk")), 5).alias("llk"))


def em_stats(v, rows: DataFrame) -> DataFrame:
    """comp, pos, n, f, s: statistics of order zero to two, added up in the tasks; components x dims rows."""
    names, w, mu, var = _named_world(v)

    def step(b):
        x = _dense(b["v"])
        g, _ = responsibilities(x, w, mu, var)
        return np.stack([np.repeat(g.sum(0)[:, None], x.shape[1], 1), g.T @ x, g.T @ (x * x)])

    n, f, s = _summed(rows.select("v"), step)
    c, d = mu.shape
    cells = [(names[i], j, float(n[i, j]), float(f[i, j]), float(s[i, j])) for i in range(c) for j in range(d)]
    return v.spark.createDataFrame(cells, f"comp {dict(v.comps.dtypes)['comp']}, pos int, n double, f double, s double")


@query("gmm_em_stats", "GMM-02 JFA-01 LFA-01 TV-02 SRC-10", f"{_LK} SELECT comp, pos, round(sum(gamma * x), 5) AS f, round(sum(gamma * x * x), 5) AS s, round(sum(gamma), 5) AS n FROM post JOIN vectors USING (vec_id) GROUP BY comp, pos")
def _(v):
    return em_stats(v, v.embeddings).select("comp", "pos", *[r(c, 5).alias(c) for c in "fsn"])


@query("gmm_map_means", "GMM-13 ONL-05", f"{_LK}, st AS (SELECT comp, pos, sum(gamma * x) AS f, sum(gamma) AS n FROM post JOIN vectors USING (vec_id) WHERE vec_id % 2 = 0 GROUP BY comp, pos) SELECT comp, pos, round((f + 14 * mu) / (n + 14) + 3e-8, 6) AS mu FROM st JOIN comps USING (comp, pos)")
def _(v):
    return em_stats(v, v.embeddings.where("vec_id % 2 = 0")).join(v.comps, ["comp", "pos"]).select("comp", "pos", r((F.col("f") + 14 * F.col("mu")) / (F.col("n") + 14)).alias("mu"))


@query("gmm_top_components", "TOP-01 SRC-21 SRC-22", f"{_LK} SELECT vec_id, comp, k FROM (SELECT vec_id, comp, row_number() OVER (PARTITION BY vec_id ORDER BY lk DESC, comp) AS k FROM lk) WHERE k <= 3")
def _(v):
    names, rows = likelihoods(v)
    top = rows.select("vec_id", F.posexplode(F.slice(ranked(F.col("lk")), 1, 3)).alias("k", "c"))
    return top.select("vec_id", named(names, F.col("c.i")).alias("comp"), (F.col("k") + 1).cast("long").alias("k"))


@query("gmm_best_component", "TOP-08 GMM-17", f"{_LK} SELECT vec_id, arg_max(comp, lk) AS sym FROM lk GROUP BY vec_id")
def _(v):
    names, rows = likelihoods(v)
    return rows.select("vec_id", named(names, (F.array_position("lk", F.array_max("lk")) - 1).cast("int")).alias("sym"))


@query("gmm_top_llk", "TOP-03 SCO-01", f"{_LK}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lk DESC, comp) AS k FROM lk) SELECT vec_id, round(max(lk) + ln(sum(exp(lk - top))), 5) AS llk FROM k JOIN top USING (vec_id) WHERE k <= 3 GROUP BY vec_id")
def _(v):
    top = likelihoods(v)[1].select("vec_id", F.slice(F.reverse(F.array_sort("lk")), 1, 3).alias("lk"))
    return top.select("vec_id", r(log_sum(F.col("lk")), 5).alias("llk"))


@query("gmm_weight_rank", "TOP-04 FIL-10", "SELECT comp, round(weight + 3e-8, 6) AS weight, row_number() OVER (ORDER BY weight DESC, comp) AS k FROM (SELECT DISTINCT comp, weight FROM comps) QUALIFY k <= 5")
def _(v):
    return v.comps.where("pos = 0").select("comp", r("weight").alias("weight"), F.row_number().over(Window.orderBy(F.col("weight").desc(), "comp")).cast("long").alias("k")).where("k <= 5")


@query("gmm_confusion", "AGG-16", f"{_LK}, k AS (SELECT vec_id, comp, row_number() OVER (PARTITION BY vec_id ORDER BY lk DESC, comp) AS k FROM lk) SELECT a.comp AS best, b.comp AS other, b.k AS place, count(*) AS n FROM k a JOIN k b USING (vec_id) WHERE a.k = 1 AND b.k BETWEEN 2 AND 4 GROUP BY 1, 2, 3")
def _(v):
    names, rows = likelihoods(v)
    order = rows.select(F.slice(ranked(F.col("lk")), 1, 4).alias("c"))
    rest = order.select(F.col("c")[0]["i"].alias("best"), F.posexplode(F.slice("c", 2, 3)).alias("k", "o"))
    return rest.groupBy(named(names, F.col("best")).alias("best"), named(names, F.col("o.i")).alias("other"), (F.col("k") + 2).cast("long").alias("place")).agg(F.count("*").alias("n"))


@query("gmm_variance_floor", "GMM-07", ", g AS (SELECT pos, var_pop(x) AS gv FROM vectors GROUP BY pos) SELECT comp, pos, round(least(2.0 * gv, greatest(0.9 * gv, var)), 8) AS var FROM comps JOIN g USING (pos)")
def _(v):
    g = v.vectors.groupBy("pos").agg(F.var_pop("x").alias("gv"))
    return v.comps.join(g, "pos").select("comp", "pos", r(F.least(2.0 * F.col("gv"), F.greatest(0.9 * F.col("gv"), "var")), 8).alias("var"))


@query("gmm_merge_pair", "GMM-10 GMM-11", "SELECT pos, round(sum(weight) + 3e-8, 6) AS weight, round(sum(weight * mu) / sum(weight) + 3e-8, 6) AS mu, round(sum(weight * (var + mu * mu)) / sum(weight) - (sum(weight * mu) / sum(weight)) ** 2, 8) AS var FROM comps WHERE comp IN (0, 1) GROUP BY pos")
def _(v):
    w, mu = F.col("weight"), F.sum(F.col("weight") * F.col("mu")) / F.sum("weight")
    rows = v.comps.where("comp in (0, 1)").groupBy("pos")
    return rows.agg(r(F.sum(w)).alias("weight"), r(mu).alias("mu"), r(F.sum(w * (F.col("var") + F.col("mu") * F.col("mu"))) / F.sum(w) - mu * mu, 8).alias("var"))


@query("gmm_model_likelihood", "GMM-12", "SELECT a.comp AS a, b.comp AS b, round(sum(-0.5 * (ln(2 * pi() * b.var) + (a.var + (a.mu - b.mu) ** 2) / b.var)), 5) AS lk FROM comps a JOIN comps b USING (pos) GROUP BY 1, 2")
def _(v):
    a = v.comps.select("pos", F.col("comp").alias("a"), F.col("mu").alias("a_mu"), F.col("var").alias("a_var"))
    b = v.comps.select("pos", F.col("comp").alias("b"), "mu", "var")
    d = F.col("a_mu") - F.col("mu")
    return a.join(b, "pos").groupBy("a", "b").agg(r(F.sum(-0.5 * (F.ln(2 * math.pi * F.col("var")) + (F.col("a_var") + d * d) / F.col("var"))), 5).alias("lk"))


@query("supervector_kl", "SUP-01 SUP-05 SUP-06 SUP-07", "SELECT comp, pos, round(mu * sqrt(weight / var) + 3e-8, 6) AS kl, round(weight / sqrt(weight) + 3e-8, 6) AS fisher FROM comps")
def _(v):
    return v.comps.select("comp", "pos", r(F.col("mu") * F.sqrt(F.col("weight") / F.col("var"))).alias("kl"), r(F.col("weight") / F.sqrt("weight")).alias("fisher"))


_MODELS = ", pairs AS (SELECT t.model, t.segment, m.x AS m, v.x AS s, m.pos FROM trials t JOIN models m ON m.label = t.model JOIN vectors v ON v.vec_id = t.segment AND v.pos = m.pos)"


def _parts(v):
    return v.trials, mean_vectors(v.embeddings.where("vec_id % 2 = 0"), "label"), v.embeddings


@query("score_cosine", "SCO-07 JOI-01 JOI-07 SRC-27 SRC-28", f"{_MODELS} SELECT model, segment, round(sum(m * s) / sqrt(sum(m * m) * sum(s * s)) + 3e-8, 6) AS score FROM pairs GROUP BY 1, 2")
def _(v):
    return trial_scores(*_parts(v), lambda m, s: r(dot(m, s) / F.sqrt(dot(m, m) * dot(s, s))))


@query("score_dot", "SCA-16 SUP-10", f"{_MODELS} SELECT model, segment, round(sum(m * s) + 3e-8, 6) AS score FROM pairs GROUP BY 1, 2")
def _(v):
    return trial_scores(*_parts(v), lambda m, s: r(dot(m, s)))


@query("score_mahalanobis_diagonal", "SCO-07", f"{_MODELS}, g AS (SELECT pos, var_pop(x) AS var FROM vectors GROUP BY pos) SELECT model, segment, round(-0.5 * sum((m - s) ** 2 / var), 5) AS score FROM pairs JOIN g USING (pos) GROUP BY 1, 2")
def _(v):
    var = [x[1] for x in sorted(v.vectors.groupBy("pos").agg(F.var_pop("x")).collect())]
    weights = F.array(*[F.lit(float(x)) for x in var])

    def score(m, s):
        d = F.zip_with(m, s, lambda a, b: (a - b) * (a - b))
        return r(-0.5 * F.aggregate(F.zip_with(d, weights, lambda x, w: x / w), F.lit(0.0), lambda t, x: t + x), 5)

    return trial_scores(*_parts(v), score)


@query("vector_length_norm", "VEC-01", ", n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM vectors GROUP BY vec_id) SELECT vec_id, pos, round(x / n + 3e-8, 6) AS x FROM vectors JOIN n USING (vec_id)")
def _(v):
    return v.embeddings.select("vec_id", F.posexplode(unit(F.col("v"))).alias("pos", "x")).select("vec_id", "pos", r("x").alias("x"))


@query("vector_centre", "VEC-02", ", g AS (SELECT pos, avg(x) AS mu FROM vectors GROUP BY pos) SELECT vec_id, pos, round(x - mu + 3e-8, 6) AS x FROM vectors JOIN g USING (pos)")
def _(v):
    return v.vectors.join(F.broadcast(v.vectors.groupBy("pos").agg(F.avg("x").alias("mu"))), "pos").select("vec_id", "pos", r(F.col("x") - F.col("mu")).alias("x"))


@query("vector_centre_speaker", "VEC-02 AGG-15", ", g AS (SELECT label, pos, avg(x) AS mu FROM vectors GROUP BY label, pos) SELECT vec_id, pos, round(x - mu + 3e-8, 6) AS x FROM vectors JOIN g USING (label, pos)")
def _(v):
    means = v.vectors.groupBy("label", "pos").agg(F.avg("x").alias("mu"))
    return v.vectors.join(means, ["label", "pos"]).select("vec_id", "pos", r(F.col("x") - F.col("mu")).alias("x"))


def _matrix(v, m: np.ndarray) -> DataFrame:
    rows = [(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return v.spark.createDataFrame(rows, "i int, j int, x double").select("i", "j", r("x", 8).alias("x"))


@query("covariance_total", "AGG-11 AGG-13", "SELECT a.pos AS i, b.pos AS j, round(avg(a.x * b.x) - avg(a.x) * avg(b.x), 8) AS x FROM vectors a JOIN vectors b USING (vec_id) GROUP BY 1, 2")
def _(v):
    return _matrix(v, covariance(v.embeddings)[1])


@query("covariance_within", "AGG-11 AGG-12 AGG-14 SUP-08", ", g AS (SELECT label, pos, avg(x) AS mu FROM vectors GROUP BY label, pos), c AS (SELECT vec_id, pos, x - mu AS x FROM vectors JOIN g USING (label, pos)) SELECT a.pos AS i, b.pos AS j, round(avg(a.x * b.x), 8) AS x FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2")
def _(v):
    return _matrix(v, within_covariance(v.embeddings, "label"))


def lda(rows: DataFrame, by: str, k: int) -> np.ndarray:
    """The k leading directions of the between over the within covariance, as rows."""
    w = within_covariance(rows, by)
    between = covariance(rows)[1] - w
    chol = np.linalg.cholesky(w + 1e-9 * np.eye(len(w)))
    inv = np.linalg.inv(chol)
    values, vectors = np.linalg.eigh(inv @ between @ inv.T)
    return (inv.T @ vectors[:, np.argsort(-values)[:k]]).T


@query("vector_lda", "VEC-07 VEC-08 VEC-03")
def _(v):
    return mapped(v.embeddings, lda(v.embeddings, "label", 5)).select("vec_id", F.transform("v", lambda x: F.round(F.abs(x), 4)).alias("v"))


@query("vector_wccn", "VEC-05 VEC-06")
def _(v):
    w = within_covariance(v.embeddings, "label")
    return mapped(v.embeddings, np.linalg.cholesky(np.linalg.inv(w)).T).select("vec_id", F.transform("v", lambda x: F.round(x, 4)).alias("v"))


@query("vector_whiten", "VEC-04 VEC-13")
def _(v):
    return whitened(v.embeddings, 2).select("vec_id", F.transform("v", lambda x: F.round(x, 4)).alias("v"))


@query("score_two_covariance", "SCO-09")
def _(v):
    """(m + s)'G(m + s) - m'Hm - s'Hs, as -d(m, s) after whitening by the within covariance, both sides whitened."""
    w = within_covariance(v.embeddings, "label")
    b = covariance(v.embeddings)[1] - w
    wi, bi = np.linalg.inv(w), np.linalg.pinv(b)
    g = wi @ np.linalg.pinv(bi + 2 * wi) @ wi
    h = wi @ np.linalg.pinv(bi + wi) @ wi
    trials, models, segments = _parts(v)
    rows = mapped(segments.withColumn("gv", F.col("v")).withColumn("hv", F.col("v")), g, "gv")
    rows = mapped(rows, h, "hv")
    m = mapped(mapped(models.withColumn("gv", F.col("v")).withColumn("hv", F.col("v")), g, "gv"), h, "hv")
    s = rows.select(F.col("vec_id").alias("segment"), F.struct("v", "gv", "hv").alias("s"))
    joined = trials.join(s, "segment").join(m.select(F.col("label").alias("model"), F.struct("v", "gv", "hv").alias("m")), "model")
    quad = dot(F.col("m.v"), F.col("m.gv")) + 2 * dot(F.col("m.v"), F.col("s.gv")) + dot(F.col("s.v"), F.col("s.gv"))
    return joined.select("model", "segment", r(quad - dot(F.col("m.v"), F.col("m.hv")) - dot(F.col("s.v"), F.col("s.hv")), 4).alias("score"))


@query("nap_projection", "SUP-02 SUP-03")
def _(v):
    """x - U'Ux with U the three leading within-speaker directions."""
    values, q = np.linalg.eigh(within_covariance(v.embeddings, "label"))
    u = q[:, np.argsort(-values)[:3]]
    return mapped(v.embeddings, np.eye(len(u)) - u @ u.T).select("vec_id", F.transform("v", lambda x: F.round(x, 4)).alias("v"))


@query("criterion_bic", "DIA-02 DIA-03", ", g AS (SELECT label, pos, var_pop(x) AS var, count(*) AS n FROM vectors GROUP BY label, pos), b AS (SELECT a.label AS a, b.label AS b, v.pos, var_pop(v.x) AS var FROM (SELECT DISTINCT label FROM embeddings) a JOIN (SELECT DISTINCT label FROM embeddings) b ON a.label < b.label JOIN vectors v ON v.label IN (a.label, b.label) GROUP BY 1, 2, 3) SELECT b.a, b.b, round(0.5 * sum((x.n + y.n) * ln(b.var) - x.n * ln(x.var) - y.n * ln(y.var)) - 0.5 * (2 * 64 + 1) * ln(any_value(x.n + y.n)), 4) AS bic FROM b JOIN g x ON x.label = b.a AND x.pos = b.pos JOIN g y ON y.label = b.b AND y.pos = b.pos GROUP BY 1, 2")
def _(v):
    """GLLR of one against two diagonal Gaussians, less the penalty of the extra parameters."""
    g = v.vectors.groupBy("label", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.var_pop("x").alias("var"), F.count("*").alias("n"))
    a, b = (g.select("pos", *[F.col(c).alias(f"{k}_{c}") for c in ("label", "s", "ss", "var", "n")]) for k in "ab")
    n = F.col("a_n") + F.col("b_n")
    mean = (F.col("a_s") + F.col("b_s")) / n
    joint = (F.col("a_ss") + F.col("b_ss")) / n - mean * mean
    pairs = a.join(b, "pos").where("a_label < b_label")
    gain = F.sum(n * F.ln(joint) - F.col("a_n") * F.ln("a_var") - F.col("b_n") * F.ln("b_var"))
    return pairs.groupBy(F.col("a_label").alias("a"), F.col("b_label").alias("b")).agg(r(0.5 * gain - 0.5 * (2 * F.count("*") + 1) * F.ln(F.first(n)), 4).alias("bic"))


@query("vector_bad", "FIL-11", "SELECT vec_id, bool_and(abs(x) < 1e-12) OR bool_or(isnan(x) OR isinf(x)) AS bad FROM vectors GROUP BY vec_id")
def _(v):
    wrong = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return v.embeddings.select("vec_id", (F.forall("v", lambda x: F.abs(x) < 1e-12) | F.exists("v", wrong)).alias("bad"))


@query("online_blend", "ONL-06", ", w AS (SELECT pos, avg(x) AS x FROM vectors GROUP BY pos) SELECT label, pos, round(0.5 * m.x + 0.5 * w.x + 3e-8, 6) AS x FROM models m JOIN w USING (pos)")
def _(v):
    world = v.vectors.groupBy("pos").agg(F.avg("x").alias("w"))
    return v.models.join(world, "pos").select("label", "pos", r(0.5 * F.col("x") + 0.5 * F.col("w")).alias("x"))


def cubic(v: Column) -> Column:
    """All monomials of degree up to 3 of n coordinates, (n + 1)(n + 2)(n + 3) / 6 of them, by their places in order."""

    def terms(x: Column) -> Column:
        rest = lambda i: F.slice(x, i + 1, F.size(x))
        third = lambda a, b, at: F.transform(rest(at), lambda c: a * b * c)
        return F.flatten(F.transform(x, lambda a, i: F.flatten(F.transform(rest(i), lambda b, j: third(a, b, i + j)))))

    # A lambda's variable is computed once.
    return F.flatten(F.transform(F.array(F.concat(F.array(F.lit(1.0)), v)), terms))


def cubic_places(n: int) -> np.ndarray:
    """Places (i, j, k), i <= j <= k, of the monomials over (1, x1 .. xn)."""
    i, j, k = np.meshgrid(*[np.arange(n + 1)] * 3, indexing="ij")
    keep = (i <= j) & (j <= k)
    return np.stack([i[keep], j[keep], k[keep]])


def mean_expansion(rows: DataFrame, by: str) -> DataFrame:
    """by, i, j, k, x: mean of each monomial over the rows of a key.

    A task adds up what it has of a key and hands on at most KEYS keys' sums at a time, so a key
    with most of the rows costs one block a task.
    """
    dims = rows.select(F.max(F.size("v"))).first()[0] or 0
    places = cubic_places(dims)
    kind = dict(rows.dtypes)[by]

    def block(sums: dict) -> pd.DataFrame:
        return pd.DataFrame({by: list(sums), "n": [n for n, _ in sums.values()], "s": [s for _, s in sums.values()]})

    def work(parts):
        sums: dict = {}
        for part in parts:
            for key, group in part.groupby(by):
                x = np.column_stack([np.ones(len(group)), np.stack(group["v"].to_numpy())])
                total = np.zeros(places.shape[1])
                for row in x:
                    total += row[places[0]] * row[places[1]] * row[places[2]]
                n, s = sums.get(key, (0, 0.0))
                sums[key] = (n + len(x), s + total)
                if len(sums) >= KEYS:
                    yield block(sums)
                    sums = {}
        if sums:
            yield block(sums)

    parts = rows.select(by, "v").mapInPandas(work, f"{by} {kind}, n long, s array<double>")
    sums = parts.select(by, "n", F.posexplode("s").alias("t", "s")).groupBy(by, "t").agg((F.sum("s") / F.sum("n")).alias("x"))
    names = rows.sparkSession.createDataFrame(pd.DataFrame({"t": np.arange(places.shape[1], dtype=np.int32), "i": places[0], "j": places[1], "k": places[2]}))
    return sums.join(F.broadcast(names), "t").drop("t")


def root_normalised(means: DataFrame) -> DataFrame:
    """Each monomial over the root of its mean square over the keys; null where that is 0."""
    root = means.groupBy("i", "j", "k").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("root"))
    return means.join(root, ["i", "j", "k"]).withColumn("x", F.col("x") / F.when(F.col("root") > 0, F.col("root"))).drop("root")


_P = ", p AS (SELECT vec_id, label, pos + 1 AS pos, x FROM vectors UNION ALL SELECT vec_id, label, 0, 1.0 FROM embeddings)"


@query("cubic_expansion", "SCA-14", f"{_P} SELECT vec_id, count(*) AS terms, round(sum(a.x * b.x * c.x) + 3e-8, 6) AS total FROM p a JOIN p b USING (vec_id) JOIN p c USING (vec_id) WHERE a.pos <= b.pos AND b.pos <= c.pos GROUP BY vec_id")
def _(v):
    out = v.embeddings.select("vec_id", cubic(F.col("v")).alias("m"))
    return out.select("vec_id", F.size("m").cast("long").alias("terms"), r(F.aggregate("m", F.lit(0.0), lambda t, x: t + x)).alias("total"))


@query(
    "cubic_mean_expansion",
    "SCA-15",
    f"{_P}, m AS (SELECT a.label, a.pos AS i, b.pos AS j, c.pos AS k, avg(a.x * b.x * c.x) AS x FROM p a JOIN p b USING (vec_id) JOIN p c USING (vec_id) WHERE a.pos <= b.pos AND b.pos <= c.pos GROUP BY 1, 2, 3, 4) SELECT label, i::BIGINT AS i, j::BIGINT AS j, k::BIGINT AS k, round(x / sqrt(avg(x * x) OVER (PARTITION BY i, j, k)) + 3e-8, 6) AS x FROM m",
)
def _(v):
    return root_normalised(mean_expansion(v.embeddings, "label")).select("label", *[F.col(c).cast("long").alias(c) for c in "ijk"], r("x").alias("x"))
