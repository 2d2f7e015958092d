"""Compensation of frames, statistics and models for nuisance subspaces, and scores against adapted models.

Frames travel in blocks (key, ids, x): a batch's frames of one key, flattened. So what belongs to a key, a
session's offset or a model's means, is joined once for a block and not once for a frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.operators.factors import cells
from segspark.operators.scores import r
from segspark.operators.training import _dense, _latent, _named_world, _rows, responsibilities, session_stats
from segspark.operators.vectors import _LK, covariance, dot, mapped, mean_vectors
from segspark.registry import query

#: Frames of a block at most.
BLOCK = 256


def packed(rows: DataFrame, by: str, ident: str) -> DataFrame:
    """by, ids, x: blocks of up to BLOCK frames of a key; a batch's frames stay together, so nothing is shuffled."""

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode(null_encoding="encode")
            codes, ids, x = np.asarray(coded.indices), b.column(1), _rows(b.column(2))
            order = np.argsort(codes, kind="stable")
            edges = [int(e) for e in np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))]
            cuts = [(k, i, min(i + BLOCK, edges[k + 1])) for k in range(len(edges) - 1) for i in range(edges[k], edges[k + 1], BLOCK)]
            ends = np.array([0, *(j for _, _, j in cuts)], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(ends, ids.take(pa.array(order))), pa.ListArray.from_arrays(ends * x.shape[1], x[order].ravel())]
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array([k for k, _, _ in cuts])), *lists], [by, "ids", "x"])

    kinds = dict(rows.dtypes)
    return rows.select(by, ident, F.col("v").cast("array<double>")).mapInArrow(work, f"{by} {kinds[by]}, ids array<{kinds[ident]}>, x array<double>")


def unpacked(blocks: DataFrame, dims: int, ident: str) -> DataFrame:
    """ident, pos, x."""
    rows = blocks.select("x", F.posexplode("ids").alias("at", ident))
    return rows.select(ident, F.posexplode(F.slice("x", F.col("at") * dims + 1, F.lit(dims))).alias("pos", "x"))


def factor_offsets(stats: DataFrame, by: str, t: np.ndarray, mu: np.ndarray, var: np.ndarray) -> DataFrame:
    """by, offset: Tw of each key's own factors, flattened."""
    c, d = mu.shape

    def work(batches):
        for b in batches:
            if len(b):
                n = _dense(b["n"])
                w, _ = _latent(n, _dense(b["f"]).reshape(-1, c, d) - n[:, :, None] * mu, t, var)
                yield pd.DataFrame({by: b[by], "offset": list(w @ t.reshape(c * d, -1).T)})

    return stats.mapInPandas(work, f"{by} {dict(stats.dtypes)[by]}, offset array<double>")


def compensated(blocks: DataFrame, w: np.ndarray, mu: np.ndarray, var: np.ndarray) -> DataFrame:
    """Blocks whose frames lost the posterior-weighted `offset` (flattened, by component) of their row."""
    c, d = mu.shape

    @F.pandas_udf("array<double>")
    def moved(x: pd.Series, offset: pd.Series) -> pd.Series:
        out = []
        for frames, off in zip(x, offset):
            frames = np.asarray(frames, float).reshape(-1, d)
            g, _ = responsibilities(frames, w, mu, var)
            out.append((frames - g @ np.asarray(off, float).reshape(c, d)).ravel())
        return pd.Series(out, dtype=object)

    return blocks.withColumn("x", moved("x", "offset")).drop("offset")


def world_offset(u: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """The world's mean supervector projected on the subspace of u's orthonormal columns (components x dims x rank)."""
    flat = u.reshape(mu.size, -1)
    return flat @ (flat.T @ mu.ravel())


def adapted_means(rows: DataFrame, by: str, w: np.ndarray, mu: np.ndarray, var: np.ndarray, tau: float) -> DataFrame:
    """by, m: means adapted from the world's, (F + tau mu) / (N + tau), flattened."""
    c, d = mu.shape

    @F.pandas_udf("array<double>")
    def adapt(n: pd.Series, f: pd.Series) -> pd.Series:
        if not len(n):
            return f
        return pd.Series(list(((_dense(f).reshape(-1, c, d) + tau * mu) / (_dense(n)[:, :, None] + tau)).reshape(len(n), -1)))

    return session_stats(rows, by, w, mu, var).select(by, adapt("n", "f").alias("m"))


def model_scores(blocks: DataFrame, trials: DataFrame, models: DataFrame, w: np.ndarray, mu: np.ndarray, var: np.ndarray) -> DataFrame:
    """model, session, llr: for each trial the mean over a session's frames of ln p(x | model) - ln p(x | world)."""
    d = mu.shape[1]

    @F.pandas_udf("double")
    def world(x: pd.Series) -> pd.Series:
        return pd.Series([float(responsibilities(np.asarray(a, float).reshape(-1, d), w, mu, var)[1].sum()) for a in x], dtype=float)

    @F.pandas_udf("double")
    def client(x: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([float(responsibilities(np.asarray(a, float).reshape(-1, d), w, np.asarray(b, float).reshape(mu.shape), var)[1].sum()) for a, b in zip(x, m)], dtype=float)

    known = blocks.select("session", F.size("ids").alias("n"), "x", world("x").alias("world"))
    rows = known.join(trials.select("model", "session").distinct(), "session").join(models.select("model", "m"), "model")
    gain = rows.select("model", "session", "n", (client("x", "m") - F.col("world")).alias("gain"))
    return gain.groupBy("model", "session").agg((F.sum("gain") / F.sum("n")).alias("llr"))


def _signs(names: list, mu: np.ndarray) -> np.ndarray:
    return np.where((np.array(names)[:, None] + np.arange(mu.shape[1])) % 2 == 0, 1.0, -1.0)


def _channel(v) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The world and a fixed channel direction: a tenth of a deviation, signs by turns."""
    names, w, mu, var = _named_world(v)
    return names, w, mu, var, (0.1 * _signs(names, mu) * np.sqrt(var))[:, :, None]


_U = _LK + ", u AS (SELECT comp, pos, (CASE WHEN (comp + pos) % 2 = 0 THEN 0.1 ELSE -0.1 END) * sqrt(var) AS u, mu, var, weight FROM comps)"


def _sql_factor(key: str, where: str = "true") -> str:
    return f"{_U}, st AS (SELECT {key} AS session, comp, pos, sum(gamma * (x - mu)) AS f, sum(gamma) AS n FROM post JOIN vectors USING (vec_id) JOIN comps USING (comp, pos) WHERE {where} GROUP BY 1, 2, 3), w AS (SELECT session, sum(u * f / var) / (1 + sum(n * u * u / var)) AS w FROM st JOIN u USING (comp, pos) GROUP BY session)"


@query(
    "frame_nap_compensation",
    "NRM-05",
    f"{_LK}, s AS (SELECT sum(mu) / count(*) AS a, sum(CASE WHEN (comp + pos) % 2 = 0 THEN mu ELSE -mu END) / count(*) AS b FROM comps), o AS (SELECT comp, pos, a + CASE WHEN (comp + pos) % 2 = 0 THEN b ELSE -b END AS o FROM comps, s) SELECT vec_id, pos, round(any_value(x) - sum(gamma * o), 5) AS x FROM post JOIN o USING (comp) JOIN vectors USING (vec_id, pos) GROUP BY vec_id, pos",
)
def _(v):
    """Frames without the posterior-weighted projection of the world's supervector on a subspace of rank two."""
    names, w, mu, var = _named_world(v)
    u = np.stack([np.ones(mu.shape), _signs(names, mu)], axis=2) / np.sqrt(mu.size)
    offset = F.array(*[F.lit(float(x)) for x in world_offset(u, mu)])
    blocks = packed(v.embeddings.select("label", "vec_id", "v"), "label", "vec_id").withColumn("offset", offset)
    return unpacked(compensated(blocks, w, mu, var), mu.shape[1], "vec_id").select("vec_id", "pos", r("x", 5).alias("x"))


@query("frame_factor_compensation", "NRM-06", f"{_sql_factor('label')} SELECT vec_id, pos, round(any_value(x) - any_value(w) * sum(gamma * u), 5) + 0.0 AS x FROM post JOIN u USING (comp) JOIN vectors USING (vec_id, pos) JOIN w ON w.session = vectors.label GROUP BY vec_id, pos")
def _(v):
    """x - sum of gamma (Ux) with the channel factors of the frame's session, here its label."""
    _, w, mu, var, u = _channel(v)
    offsets = factor_offsets(session_stats(v.embeddings.select("label", "v"), "label", w, mu, var), "label", u, mu, var)
    blocks = packed(v.embeddings.select("label", "vec_id", "v"), "label", "vec_id").join(offsets, "label")
    return unpacked(compensated(blocks, w, mu, var), mu.shape[1], "vec_id").select("vec_id", "pos", r("x", 5).alias("x"))


_MM = ", mm AS (SELECT {key} AS model, comp, pos, (sum(gamma * x) + {tau} * any_value(mu)) / (sum(gamma) + {tau}) AS m FROM post JOIN vectors USING (vec_id) JOIN comps USING (comp, pos) WHERE {where} GROUP BY 1, 2, 3)"
_CL = """, cl AS (SELECT model, vec_id, session, comp, ln(any_value(weight)) + sum(-0.5 * (ln(2 * pi() * var) + (x - m) ** 2 / var)) AS lk FROM cx JOIN mm USING (pos) JOIN comps USING (comp, pos) {on} GROUP BY 1, 2, 3, 4),
ct AS (SELECT model, vec_id, session, max(lk) AS t FROM cl GROUP BY 1, 2, 3), cs AS (SELECT model, session, vec_id, any_value(t) + ln(sum(exp(lk - t))) AS llk FROM cl JOIN ct USING (model, vec_id, session) GROUP BY 1, 2, 3),
wl AS (SELECT vec_id, comp, ln(any_value(weight)) + sum(-0.5 * (ln(2 * pi() * var) + (x - mu) ** 2 / var)) AS lk FROM cx JOIN comps USING (pos) GROUP BY 1, 2), wt AS (SELECT vec_id, max(lk) AS t FROM wl GROUP BY 1), ws AS (SELECT vec_id, any_value(t) + ln(sum(exp(lk - t))) AS world FROM wl JOIN wt USING (vec_id) GROUP BY 1)"""


@query(
    "score_compensated_frames",
    "SCO-05",
    f"{_sql_factor('vec_id % 5', 'vec_id % 2 = 1')}, cx AS (SELECT vec_id, any_value(session) AS session, pos, any_value(x) - any_value(w) * sum(gamma * u) AS x FROM post JOIN u USING (comp) JOIN vectors USING (vec_id, pos) JOIN w ON session = vec_id % 5 WHERE vec_id % 2 = 1 GROUP BY vec_id, pos)"
    + _MM.format(key="vectors.label", tau=14, where="vec_id % 2 = 0")
    + _CL.format(on="")
    + " SELECT model, session, round(avg(llk - world), 5) AS llr FROM cs JOIN ws USING (vec_id) GROUP BY 1, 2",
)
def _(v):
    """Sessions of test frames, compensated by their own channel factors, against models adapted from the world."""
    _, w, mu, var, u = _channel(v)
    tests = v.embeddings.where("vec_id % 2 = 1").select(F.expr("vec_id % 5").alias("session"), "vec_id", "v")
    offsets = factor_offsets(session_stats(tests.select("session", "v"), "session", w, mu, var), "session", u, mu, var)
    blocks = compensated(packed(tests, "session", "vec_id").join(offsets, "session"), w, mu, var)
    models = adapted_means(v.embeddings.where("vec_id % 2 = 0").select(F.col("label").alias("model"), "v"), "model", w, mu, var, 14.0)
    trials = v.trials.select("model", F.expr("segment % 5").alias("session")).distinct()
    return model_scores(blocks, trials, models, w, mu, var).select("model", "session", r("llr", 5).alias("llr"))


@query("gmm_target_by_label", "GMM-14", _LK + _MM.format(key="concat(vectors.label, '_', vec_id % 3)", tau=14, where="true") + " SELECT model, comp, pos, round(m + 3e-8, 6) AS mu FROM mm")
def _(v):
    """A model for each client and label of its frames, adapted from the world."""
    names, w, mu, var = _named_world(v)
    key = F.concat_ws("_", F.col("label").cast("string"), F.expr("vec_id % 3").cast("string"))
    models = adapted_means(v.embeddings.select(key.alias("model"), "v"), "model", w, mu, var, 14.0)
    return cells(models.select("model", F.array().cast("array<double>").alias("n"), F.col("m").alias("f")), "model", names, mu.shape[1]).select("model", "comp", "pos", r("f").alias("mu"))


_CLR = _LK + _MM.format(key="vectors.label", tau=16, where="true") + ", pr AS (SELECT label AS a, lead(label) OVER (ORDER BY label) AS b FROM (SELECT DISTINCT label FROM embeddings) QUALIFY b IS NOT NULL), cx AS (SELECT vec_id, label AS session, pos, x FROM vectors)" + _CL.format(on="JOIN pr ON (pr.a = model AND pr.b = session) OR (pr.b = model AND pr.a = session)") + ", sc AS (SELECT model, session, avg(llk - world) AS llr FROM cs JOIN ws USING (vec_id) GROUP BY 1, 2)"


@query("criterion_clr", "DIA-01 DIA-06", f"{_CLR} SELECT a, b, round(x.llr + y.llr, 5) AS clr, x.llr + y.llr > 0 AS similar FROM pr JOIN sc x ON x.model = a AND x.session = b JOIN sc y ON y.model = b AND y.session = a")
def _(v):
    """Cross likelihood ratio of neighbouring clusters, each scored against the other's model adapted from the world."""
    _, w, mu, var = _named_world(v)
    labels = v.embeddings.select("label").distinct()
    # Clusters are few and in one order; the pairs asked for are the neighbours, not all.
    from pyspark.sql import Window

    pairs = labels.select(F.col("label").alias("a"), F.lead("label").over(Window.orderBy("label")).alias("b")).where("b is not null")
    trials = pairs.select(F.col("a").alias("model"), F.col("b").alias("session")).union(pairs.select("b", "a"))
    models = adapted_means(v.embeddings.select(F.col("label").alias("model"), "v"), "model", w, mu, var, 16.0)
    blocks = packed(v.embeddings.select(F.col("label").alias("session"), "vec_id", "v"), "session", "vec_id")
    found = model_scores(blocks, trials, models, w, mu, var)
    both = found.groupBy(F.least("model", "session").alias("a"), F.greatest("model", "session").alias("b")).agg(F.sum("llr").alias("clr"))
    return both.select("a", "b", r("clr", 5).alias("clr"), (F.col("clr") > 0).alias("similar"))


_SPEAKER = f"{_LK}, st AS (SELECT label, comp, pos, sum(gamma * (x - mu)) AS f, sum(gamma) AS n FROM post JOIN vectors USING (vec_id) JOIN comps USING (comp, pos) GROUP BY 1, 2, 3), z AS (SELECT label, comp, pos, var, f, n, sqrt(var / 16) AS d, 1 + n / 16 AS l, f / var * sqrt(var / 16) / (1 + n / 16) AS z FROM st JOIN comps USING (comp, pos))"


def _speaker_offsets(v) -> DataFrame:
    """label, comp, pos, n, f (around the world's means), var, d, l, z: z = F d / (var L), L = 1 + N d^2 / var, d = sqrt(var / 16)."""
    from segspark.operators.factors import _speaker_cells

    rows = _speaker_cells(v).withColumn("f", F.col("f") - F.col("n") * F.col("mu"))
    rows = rows.withColumn("d", F.sqrt(F.col("var") / 16)).withColumn("l", 1 + F.col("n") * F.col("d") * F.col("d") / F.col("var"))
    return rows.withColumn("z", F.col("f") / F.col("var") * F.col("d") / F.col("l"))


@query("offset_matrix_step", "JFA-09", f"{_SPEAKER} SELECT comp, pos, round(sum(z * f) / sum((1 / l + z * z) * n), 5) AS d FROM z GROUP BY comp, pos")
def _(v):
    """One estimate of the diagonal D over speakers: sum of zF over sum of (1 / L + z^2) N."""
    z = F.col("z")
    return _speaker_offsets(v).groupBy("comp", "pos").agg(r(F.sum(z * F.col("f")) / F.sum((1 / F.col("l") + z * z) * F.col("n")), 5).alias("d"))


@query("stats_without_speaker", "LFA-02", f"{_SPEAKER}, se AS (SELECT vec_id, label, comp, pos, gamma AS n, gamma * x AS f FROM post JOIN vectors USING (vec_id)) SELECT vec_id, comp, pos, round(se.f - se.n * (mu + z.d * z) + 3e-8, 6) + 0.0 AS f FROM se JOIN z USING (label, comp, pos) JOIN comps USING (comp, pos)")
def _(v):
    """A session's first-order statistics without N(M + Dz) of its speaker."""
    names, w, mu, var = _named_world(v)
    own = cells(session_stats(v.embeddings.select("vec_id", "v"), "vec_id", w, mu, var), "vec_id", names, mu.shape[1]).join(v.embeddings.select("vec_id", "label"), "vec_id")
    off = _speaker_offsets(v).select("label", "comp", "pos", (F.col("mu") + F.col("d") * F.col("z")).alias("off"))
    return own.join(off, ["label", "comp", "pos"]).select("vec_id", "comp", "pos", r(F.col("f") - F.col("n") * F.col("off")).alias("f"))


_SESSION = f"{_sql_factor('vec_id')}, se AS (SELECT session AS vec_id, comp, pos, n, f - n * w * u AS f FROM st JOIN w USING (session) JOIN u USING (comp, pos))"


def _without_channel(v) -> tuple[list, int, DataFrame]:
    """vec_id, n, f: a session's statistics without N(M + Ux) of its own channel factors."""
    from segspark.operators.factors import without

    names, w, mu, var, u = _channel(v)
    c, d = mu.shape
    rest = without(session_stats(v.embeddings.select("vec_id", "v"), "vec_id", w, mu, var), "vec_id", u, mu, var)
    around = F.array(*[F.lit(float(x)) for x in mu.ravel()])
    centred = F.transform(F.arrays_zip("f", around.alias("m")), lambda s, i: s["f"] - F.get("n", F.floor(i / d).cast("int")) * s["m"])
    return names, d, rest.select("vec_id", "n", centred.alias("f"))


@query("stats_without_channel", "LFA-03", f"{_SESSION}, sp AS (SELECT label, comp, pos, sum(f) AS f FROM se JOIN embeddings USING (vec_id) GROUP BY 1, 2, 3) SELECT label, comp, pos, round(f, 5) AS f FROM sp")
def _(v):
    """A speaker's statistics added up from sessions without N(M + Ux)."""
    from segspark.operators.training import added

    names, d, rest = _without_channel(v)
    speakers = added(rest.join(v.embeddings.select("vec_id", "label"), "vec_id"), "label")
    return cells(speakers, "label", names, d).select("label", "comp", "pos", r("f", 5).alias("f"))


@query(
    "score_dot_compensated",
    "SCO-04",
    f"{_SESSION}, t AS (SELECT vec_id, comp, pos, f / sum(n) OVER (PARTITION BY vec_id, pos) AS s FROM se WHERE vec_id % 2 = 1), c AS (SELECT label AS model, comp, pos, sum(f) / sum(n) AS m FROM se JOIN embeddings USING (vec_id) WHERE vec_id % 2 = 0 GROUP BY 1, 2, 3) SELECT trials.model, vec_id AS segment, round(sum(m * s), 5) + 0.0 AS score FROM trials JOIN t ON t.vec_id = trials.segment JOIN c ON c.model = trials.model AND c.comp = t.comp AND c.pos = t.pos GROUP BY 1, 2",
)
def _(v):
    """Client vector times (F - N(M + Ux)) / sum of N; a client's vector is its enrolment statistics over their counts."""
    from segspark.operators.training import added

    _, d, rest = _without_channel(v)
    total = F.aggregate("n", F.lit(0.0), lambda s, x: s + x)
    tests = rest.where("vec_id % 2 = 1").select(F.col("vec_id").alias("segment"), F.transform("f", lambda x: x / total).alias("s"))
    enrolled = added(rest.where("vec_id % 2 = 0").join(v.embeddings.select("vec_id", F.col("label").alias("model")), "vec_id"), "model")
    clients = enrolled.select("model", F.transform("f", lambda x, i: x / F.get("n", F.floor(i / d).cast("int"))).alias("m"))
    return v.trials.join(tests, "segment").join(clients, "model").select("model", "segment", r(dot(F.col("m"), F.col("s")), 5).alias("score"))


_PAIRS = ", pairs AS (SELECT t.model, t.segment, m.x AS m, v.x AS s, m.pos FROM trials t JOIN models m ON m.label = t.model JOIN vectors v ON v.vec_id = t.segment AND v.pos = m.pos)"


@query(
    "score_mahalanobis",
    "SCO-08",
    f"{_PAIRS}, k AS (SELECT a.pos AS i, b.pos AS j, avg(a.x * b.x) - avg(a.x) * avg(b.x) AS k FROM vectors a JOIN vectors b USING (vec_id) GROUP BY 1, 2), q AS (SELECT p.model, p.segment, p.pos, (p.m - p.s) AS e FROM pairs p), y AS (SELECT model, segment, j, sum(e * k) AS y FROM q JOIN k ON k.i = q.pos GROUP BY 1, 2, 3) SELECT model, segment, round(-0.5 * sum(e * y), 5) AS score FROM q JOIN y USING (model, segment) WHERE y.j = q.pos GROUP BY 1, 2",
)
def _(v):
    """-1/2 (m - s)'M(m - s) for a given full matrix M, here the total covariance; M turns each side once."""
    matrix = covariance(v.embeddings)[1]
    side = lambda rows, key, name: mapped(rows.withColumn("t", F.col("v")), matrix, "t").select(F.col(key).alias(name), F.col("v").alias(f"{name}_v"), F.col("t").alias(f"{name}_t"))
    models = side(mean_vectors(v.embeddings.where("vec_id % 2 = 0"), "label"), "label", "model")
    joined = v.trials.join(side(v.embeddings, "vec_id", "segment"), "segment").join(models, "model")
    e, t = (F.zip_with(f"model_{k}", f"segment_{k}", lambda a, b: a - b) for k in "vt")
    return joined.select("model", "segment", r(-0.5 * dot(e, t), 5).alias("score"))


@query("svm_tnorm", "SUP-11", f"{_PAIRS}, m AS (SELECT model, segment, sum(m * s) - 0.5 * sum(m * m) AS llr FROM pairs GROUP BY 1, 2) SELECT model, segment, round((llr - avg(llr) OVER w) / nullif(stddev_pop(llr) OVER w, 0), 5) AS llr FROM m WINDOW w AS (PARTITION BY segment)")
def _(v):
    """The same instances under many linear models (v, bias), each score by the instance's mean and deviation over the models."""
    from segspark.operators.scores import normalised

    models = mean_vectors(v.embeddings.where("vec_id % 2 = 0"), "label").select(F.col("label").alias("model"), F.col("v").alias("m"), (-0.5 * dot(F.col("v"), F.col("v"))).alias("bias"))
    tests = v.embeddings.select(F.col("vec_id").alias("segment"), F.col("v").alias("s"))
    raw = v.trials.join(tests, "segment").join(models, "model").select("model", "segment", (dot(F.col("m"), F.col("s")) + F.col("bias")).alias("llr"))
    return normalised(raw, raw, "segment").select("model", "segment", r("llr", 5).alias("llr"))
