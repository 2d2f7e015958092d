"""Factor models over session statistics: speaker and channel subspaces, diagonal offsets, PLDA, compensation.

Statistics rows are (key, n: array by component, f: flattened components x dims). A round of training
adds up rank x rank blocks on the cluster; the driver solves one small system for each component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segspark.operators.scores import r
from segspark.operators.training import _dense, _latent, _named_world, _summed, _world, added, factors, held, responsibilities, session_stats, train_subspace
from segspark.operators.vectors import _LK, _parts, covariance, dot, likelihoods, mapped, mean_vectors, moments, posteriors, unit, within_covariance
from segspark.registry import query


def cells(stats: DataFrame, by: str, names: list, dims: int) -> DataFrame:
    """by, comp, pos, n, f: a statistics row as one row for each component and coordinate."""
    at = F.floor(F.col("i") / dims).cast("int")
    long = stats.select(by, "n", F.posexplode("f").alias("i", "f"))
    return long.select(by, F.get(F.array(*[F.lit(x) for x in names]), at).alias("comp"), (F.col("i") % dims).alias("pos"), F.get("n", at).alias("n"), "f")


def without(stats: DataFrame, by: str, t: np.ndarray, mu: np.ndarray, var: np.ndarray) -> DataFrame:
    """Statistics with N(Tw) of each row's own factors taken off f."""
    c, d = mu.shape

    def work(batches):
        for b in batches:
            if len(b):
                n, f = _dense(b["n"]), _dense(b["f"]).reshape(-1, c, d)
                w, _ = _latent(n, f - n[:, :, None] * mu, t, var)
                yield pd.DataFrame({by: b[by], "n": list(n), "f": list((f - n[:, :, None] * np.einsum("cdi,ui->ucd", t, w)).reshape(len(f), -1))})

    return stats.select(by, "n", "f").mapInPandas(work, f"{by} {dict(stats.dtypes)[by]}, n array<double>, f array<double>")


def orthonormal(t: np.ndarray) -> np.ndarray:
    """Columns of the stacked matrix by Gram-Schmidt (QR with positive diagonal)."""
    q, up = np.linalg.qr(t.reshape(-1, t.shape[-1]))
    return (q * np.sign(np.diag(up))).reshape(t.shape)


def minimum_divergence(stats: DataFrame, t: np.ndarray, mu: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """T and means after moving the factors to mean 0 and covariance 1."""
    c, d = mu.shape

    def step(b):
        n = _dense(b["n"])
        w, cov = _latent(n, _dense(b["f"]).reshape(-1, c, d) - n[:, :, None] * mu, t, var)
        return np.concatenate([(cov + w[:, :, None] * w[:, None, :]).sum(0), w.sum(0)[None], np.full((1, t.shape[2]), len(w))])

    s = _summed(stats, step)
    mean = s[-2] / s[-1]
    root = np.linalg.cholesky(s[:-2] / s[-1, 0] - np.outer(mean, mean))
    return np.einsum("cdi,ij->cdj", t, root), mu + np.einsum("cdi,i->cd", t, mean)


def log_likelihood(stats: DataFrame, t: np.ndarray, mu: np.ndarray, var: np.ndarray) -> float:
    """Sum over rows of the factor posterior's evidence, the criterion that training raises."""
    c, d = mu.shape

    def step(b):
        n = _dense(b["n"])
        f = _dense(b["f"]).reshape(-1, c, d) - n[:, :, None] * mu
        w, cov = _latent(n, f, t, var)
        right = np.einsum("ucd,cdi->ui", f, t / var[:, :, None])
        return np.array([(0.5 * (w * right).sum(1) + 0.5 * np.linalg.slogdet(cov)[1]).sum()])

    return float(_summed(stats, step)[0])


def train_plda(rows: DataFrame, by: str, rank: int, rounds: int = 5, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, speaker loading F (dims x rank) and residual covariance of x = mean + F h + e, by EM over classes."""
    mean, total = covariance(rows)
    load, resid = np.random.default_rng(seed).normal(size=(len(mean), rank)) * 0.1, total.copy()
    centre = F.array(*[F.lit(float(x)) for x in mean])
    classes = mean_vectors(rows.withColumn("v", F.zip_with("v", centre, lambda x, y: x - y)), by, "m").join(rows.groupBy(by).agg(F.count("*").alias("n")), by)
    count = rows.count()
    for _ in range(rounds):
        inv = np.linalg.inv(resid)
        gain = load.T @ inv

        def step(b, gain=gain, load=load):
            m, n = _dense(b["m"]), b["n"].to_numpy(float)
            cov = np.linalg.inv(np.eye(rank) + n[:, None, None] * (gain @ load))
            h = np.einsum("uij,uj->ui", cov, n[:, None] * (m @ gain.T))
            return np.concatenate([np.einsum("u,uij->ij", n, cov + h[:, :, None] * h[:, None, :]), np.einsum("u,ud,ui->di", n, m, h)])

        s = _summed(classes, step)
        load = np.linalg.solve(s[:rank], s[rank:].T).T
        resid = total - load @ s[rank:].T / count
        resid = (resid + resid.T) / 2 + 1e-9 * np.eye(len(mean))
    return mean, load, resid


def _speaker_cells(v) -> DataFrame:
    """label, comp, pos, n, f, mu, var: a speaker's statistics beside the world's means."""
    names, w, mu, var = _named_world(v)
    stats = session_stats(v.embeddings.select("label", "v"), "label", w, mu, var)
    return cells(stats, "label", names, mu.shape[1]).join(v.comps.select("comp", "pos", "mu", "var"), ["comp", "pos"])


@query("map_offset", "LFA-06 JFA-10 SUP-01", f"{_LK}, st AS (SELECT label, comp, pos, sum(gamma * x) AS f, sum(gamma) AS n FROM post JOIN vectors USING (vec_id) GROUP BY label, comp, pos) SELECT label, comp, pos, round((f - n * mu) / (n + 16) + 3e-8, 6) AS z FROM st JOIN comps USING (comp, pos)")
def _(v):
    """Relevance-weighted offset of a speaker's means from the world's: (F - N mu) / (N + tau)."""
    return _speaker_cells(v).select("label", "comp", "pos", r((F.col("f") - F.col("n") * F.col("mu")) / (F.col("n") + 16)).alias("z"))


@query("stats_by_speaker", "JFA-01 LFA-01", f"{_LK}, st AS (SELECT vec_id, label, comp, pos, gamma * (x - mu) AS f FROM post JOIN vectors USING (vec_id) JOIN comps USING (comp, pos)) SELECT label, comp, pos, round(sum(f), 5) AS f FROM st GROUP BY label, comp, pos")
def _(v):
    """First-order statistics around the world's means, added over a speaker's sessions."""
    return _speaker_cells(v).select("label", "comp", "pos", r(F.col("f") - F.col("n") * F.col("mu"), 5).alias("f"))


@query("gmm_top_mass", "TOP-02", f"{_LK}, c AS (SELECT vec_id, comp, sum(gamma) OVER (PARTITION BY vec_id ORDER BY gamma DESC, comp) - gamma AS before FROM post) SELECT vec_id, count(*) AS n FROM c WHERE before < 0.9 GROUP BY vec_id")
def _(v):
    """How many components hold the first nine tenths of a row's likelihood."""
    down = F.reverse(F.array_sort(F.col("gamma")))
    held_mass = lambda gamma: F.aggregate(gamma, F.struct(F.lit(0.0).alias("mass"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct((s["mass"] + x).alias("mass"), (s["n"] + F.when(s["mass"] < 0.9, 1).otherwise(0)).alias("n")), lambda s: s["n"])
    return posteriors(likelihoods(v)[1]).select("vec_id", held_mass(down).alias("n"))


@query("feature_mapping", "GMM-15", f"{_LK}, best AS (SELECT vec_id, arg_max(comp, lk) AS comp FROM lk GROUP BY vec_id), g AS (SELECT pos, avg(x) AS gm, var_pop(x) AS gv FROM vectors GROUP BY pos) SELECT vec_id, pos, round((x - mu) * sqrt(gv / var) + gm, 5) AS x FROM vectors JOIN best USING (vec_id) JOIN comps USING (comp, pos) JOIN g USING (pos)")
def _(v):
    """Each row leaves its best component for the pooled distribution."""
    _, _, mu, var = _named_world(v)
    mean, pooled = moments(v.embeddings)

    @F.pandas_udf("array<double>")
    def moved(x: pd.Series, best: pd.Series) -> pd.Series:
        k = best.to_numpy(int)
        return pd.Series(list((_dense(x) - mu[k]) * np.sqrt(pooled / var[k]) + mean)) if len(x) else x

    best = F.array_position("lk", F.array_max("lk")) - 1
    rows = likelihoods(v)[1].select("vec_id", F.posexplode(moved("v", best)).alias("pos", "x"))
    return rows.select("vec_id", "pos", r("x", 5).alias("x"))


@query("score_max_other", "JOI-08", "SELECT a.client, a.segment, round(max(b.llr) + 3e-8, 6) AS other FROM scores a JOIN scores b ON a.segment = b.segment AND a.client <> b.client GROUP BY 1, 2")
def _(v):
    """The best score of the other clients: the top score, or the second for the top client itself."""
    whole = Window.partitionBy("segment")
    k = v.scores.select("client", "segment", "llr", F.row_number().over(whole.orderBy(F.col("llr").desc(), "client")).alias("k"))
    two = k.where("k <= 2").groupBy("segment").agg(F.max(F.when(F.col("k") == 1, F.col("llr"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("llr"))).alias("b"))
    return k.join(two, "segment").withColumn("other", F.when(F.col("k") == 1, F.col("b")).otherwise(F.col("a"))).where("other is not null").select("client", "segment", r("other").alias("other"))


@query("turn_detection", "DIA-08 WIN-12 WIN-13", """, w AS (SELECT source, frame_idx, count(*) OVER l AS nl, avg(x) OVER l AS ml, var_pop(x) OVER l AS vl, count(*) OVER h AS nh, avg(x) OVER h AS mh, var_pop(x) OVER h AS vh FROM frames WINDOW l AS (PARTITION BY source ORDER BY frame_idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), h AS (PARTITION BY source ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
    SELECT source, frame_idx, round(4 * (2 * ln((vl + vh) / 2 + (ml - mh) ** 2 / 4) - ln(vl) - ln(vh)), 5) AS glr FROM w WHERE nl = 8 AND nh = 8 AND vl > 0 AND vh > 0""")
def _(v):
    """Likelihood ratio of one against two Gaussians over twin windows of eight frames."""
    order = Window.partitionBy("source").orderBy("frame_idx")
    low, high = order.rowsBetween(-8, -1), order.rowsBetween(0, 7)
    parts = [f("x").over(w).alias(f"{n}{s}") for s, w in (("l", low), ("h", high)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    d = F.col("ml") - F.col("mh")
    glr = 4 * (2 * F.ln((F.col("vl") + F.col("vh")) / 2 + d * d / 4) - F.ln("vl") - F.ln("vh"))
    return v.frames.select("source", "frame_idx", *parts).where("nl = 8 and nh = 8 and vl > 0 and vh > 0").select("source", "frame_idx", r(glr, 5).alias("glr"))


@query("morphological_filter", "WIN-07", """, c AS (SELECT source, frame_idx, avg(CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY source ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS cover FROM frames), k AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY source ORDER BY frame_idx) AS island FROM c WHERE cover >= 0.8)
    SELECT source, min(frame_idx) AS "begin", count(*) AS length FROM k GROUP BY source, island""")
def _(v):
    """Spans whose windows of five frames are covered by at least four fifths."""
    from segspark.operators.segments import selected_runs

    near = Window.partitionBy("source").orderBy("frame_idx").rowsBetween(-2, 2)
    cover = v.frames.select("source", "frame_idx", F.avg(F.when(F.col("x") > 50, 1.0).otherwise(0.0)).over(near).alias("cover"))
    return selected_runs(cover, F.col("cover") >= 0.8)


@query("gaussian_histogram", "SCA-13", "SELECT i AS bin, round(exp(-0.5 * ((i - 50) / 10.0) ** 2) / sqrt(2 * pi()) + 3e-8, 6) AS density FROM range(0, 101) t(i)")
def _(v):
    """The target histogram of a standard normal over -5..5."""
    x = (F.col("id") - 50) / 10.0
    return v.spark.range(0, 101).select(F.col("id").alias("bin"), r(F.exp(-0.5 * x * x) / F.sqrt(F.lit(2 * np.pi))).alias("density"))


@query("subspace_minimum_divergence", "TV-08")
def _(v):
    w, mu, var = _world(v)
    stats = session_stats(v.embeddings.select("vec_id", "v"), "vec_id", w, mu, var)
    with held(stats):
        t, mu2 = minimum_divergence(stats, train_subspace(stats, mu, var, 3, 2), mu, var)
    return factors(stats, "vec_id", t, mu2, var).select("vec_id", F.transform("w", lambda x: F.round(x, 4)).alias("w"))


@query("subspace_residual", "TV-09 TV-13 JFA-15")
def _(v):
    """What each row's statistics keep once its own factors along an orthonormal basis are taken off."""
    w, mu, var = _world(v)
    stats = session_stats(v.embeddings.select("vec_id", "v"), "vec_id", w, mu, var)
    rest = without(stats, "vec_id", orthonormal(train_subspace(stats, mu, var, 3, 1)), mu, var)
    return rest.select("vec_id", F.round(F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


@query("subspace_likelihood", "TV-15 JFA-16 LFA-10 TV-14 JFA-17")
def _(v):
    """The training criterion after 0 to 3 rounds."""
    w, mu, var = _world(v)
    stats = session_stats(v.embeddings.select("vec_id", "v"), "vec_id", w, mu, var)
    with held(stats):
        rows = [(k, round(log_likelihood(stats, train_subspace(stats, mu, var, 3, k), mu, var), 4)) for k in range(4)]
    return v.spark.createDataFrame(rows, "round int, llk double")


@query("joint_factors", "JFA-03 JFA-04 JFA-05 JFA-06 JFA-08 JFA-12 JFA-13 LFA-04 LFA-05 LFA-07 LFA-08 LFA-12")
def _(v):
    """Speaker factors from added statistics, then channel factors from what they leave in each session."""
    w, mu, var = _world(v)
    sessions = session_stats(v.embeddings.select("vec_id", "v"), "vec_id", w, mu, var)
    labelled = sessions.join(v.embeddings.select("vec_id", "label"), "vec_id")
    speakers = added(labelled, "label")
    vm = train_subspace(speakers, mu, var, 3, 2)
    y = factors(speakers, "label", vm, mu, var).withColumnRenamed("w", "y")
    c, d = mu.shape
    offset = labelled.join(y, "label")

    def off(batches):
        for b in batches:
            if len(b):
                n, f = _dense(b["n"]), _dense(b["f"]).reshape(-1, c, d)
                left = f - n[:, :, None] * np.einsum("cdi,ui->ucd", vm, _dense(b["y"]))
                yield pd.DataFrame({"vec_id": b["vec_id"], "n": list(n), "f": list(left.reshape(len(f), -1))})

    rest = offset.select("vec_id", "n", "f", "y").mapInPandas(off, "vec_id long, n array<double>, f array<double>")
    um = train_subspace(rest, mu, var, 2, 2, seed=2)
    return factors(rest, "vec_id", um, mu, var).select("vec_id", F.transform("w", lambda x: F.round(x, 4)).alias("x"))


@query("score_plda", "VEC-11 SCO-11 VEC-13")
def _(v):
    """Log likelihood ratio of one speaker against two, model vectors being enrolment means."""
    mean, load, resid = train_plda(v.embeddings, "label", 5)
    between, total = load @ load.T, load @ load.T + resid
    ti = np.linalg.inv(total)
    q = ti - np.linalg.inv(total - between @ ti @ between)
    p = ti @ between @ np.linalg.inv(total - between @ ti @ between)
    centre = F.array(*[F.lit(float(x)) for x in mean])
    moved = lambda df: df.withColumn("v", F.zip_with("v", centre, lambda x, y: x - y))
    trials, models, segments = _parts(v)
    s = mapped(moved(segments).withColumn("q", F.col("v")), q, "q").select(F.col("vec_id").alias("segment"), F.col("v").alias("s"), F.col("q").alias("sq"))
    m = mapped(mapped(moved(models).withColumn("q", F.col("v")).withColumn("p", F.col("v")), q, "q"), p.T, "p").select(F.col("label").alias("model"), F.col("v").alias("m"), F.col("q").alias("mq"), F.col("p").alias("mp"))
    joined = trials.join(s, "segment").join(m, "model")
    score = 0.5 * (dot(F.col("s"), F.col("sq")) + dot(F.col("m"), F.col("mq"))) + dot(F.col("mp"), F.col("s"))
    return joined.select("model", "segment", r(score, 4).alias("score"))


@query("nap_scoring", "SCO-06")
def _(v):
    """Cosine of model and segment after both lost the leading within-speaker directions."""
    values, q = np.linalg.eigh(within_covariance(v.embeddings, "label"))
    u = q[:, np.argsort(-values)[:3]]
    keep = np.eye(len(u)) - u @ u.T
    trials, models, segments = _parts(v)
    s = mapped(segments, keep).select(F.col("vec_id").alias("segment"), unit(F.col("v")).alias("s"))
    m = mapped(models, keep).select(F.col("label").alias("model"), unit(F.col("v")).alias("m"))
    return trials.join(s, "segment").join(m, "model").select("model", "segment", r(dot(F.col("m"), F.col("s")), 4).alias("score"))


def adapted_in_order(trials: pd.DataFrame, model: np.ndarray, slope: float = 8.0) -> tuple[list[float], np.ndarray]:
    """Test by test: score against the model, weigh by a logistic, move the model by that weight."""
    n, out = 1.0, []
    for x in trials["v"].tolist():
        x = np.asarray(x, float)
        score = float(model @ x / (np.linalg.norm(model) * np.linalg.norm(x) or 1))
        w = 1 / (1 + np.exp(-slope * (score - 0.3)))
        model, n = (n * model + w * x) / (n + w), n + w
        out.append(score)
    return out, model


@query("unsupervised_adaptation", "ONL-01 ONL-03")
def _(v):
    """Each model's trials in order of segment: an ordered recurrence for each model."""
    trials, models, segments = _parts(v)
    rows = trials.where("pmod(segment, 2) = 1 and pmod(segment + model, 3) <> 0").join(segments.select(F.col("vec_id").alias("segment"), "v"), "segment").join(models.select(F.col("label").alias("model"), F.col("v").alias("m")), "model")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("segment")
        score, _ = adapted_in_order(part, np.asarray(part["m"].iloc[0], float))
        return pd.DataFrame({"model": part["model"], "segment": part["segment"], "score": np.round(score, 4)})

    return rows.groupBy("model").applyInPandas(work, "model int, segment long, score double")


@query("frame_posteriors", "GMM-02 DIA-19")
def _(v):
    """Posteriors of the world's components in Arrow batches, for wide models."""
    w, mu, var = _world(v)

    @F.pandas_udf("array<double>")
    def post(x: pd.Series) -> pd.Series:
        return pd.Series(np.round(responsibilities(np.stack(x.to_numpy()), w, mu, var)[0], 4).tolist()) if len(x) else x

    return v.embeddings.select("vec_id", post("v").alias("gamma"))


def weighted_subspace(t: np.ndarray, w: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and basis of sum over components of weight T'T/var, and each component's diagonal in that basis."""
    scaled = t / np.sqrt(var)[:, :, None]
    blocks = np.einsum("cdi,cdj->cij", scaled, scaled)
    values, q = np.linalg.eigh(np.einsum("c,cij->ij", w, blocks))
    return values, q, np.einsum("ik,cij,jk->ck", q, blocks, q)


def approximate_factors(stats: DataFrame, by: str, t: np.ndarray, mu: np.ndarray, var: np.ndarray, w: np.ndarray, mode: str = "weights") -> DataFrame:
    """by, w: factors with the inverse in one basis for all rows, so a row costs rank, not rank cubed.

    weights: a row's counts are taken to be spread like the mixture's weights; eigen: each component
    is taken to be diagonal in the weighted subspace's basis.
    """
    if mode not in ("weights", "eigen"):
        raise ValueError(f"unknown mode {mode}")
    c, d = mu.shape
    values, q, diagonal = weighted_subspace(t, w, var)
    right = t / var[:, :, None]

    def work(batches):
        for b in batches:
            if len(b):
                n = _dense(b["n"])
                f = _dense(b["f"]).reshape(-1, c, d) - n[:, :, None] * mu
                spread = n.sum(1, keepdims=True) * values if mode == "weights" else n @ diagonal
                yield pd.DataFrame({by: b[by], "w": list((np.einsum("ucd,cdi->ui", f, right) @ q / (1 + spread)) @ q.T)})

    return stats.select(by, "n", "f").mapInPandas(work, f"{by} {dict(stats.dtypes)[by]}, w array<double>")


def channel_factors(sessions: DataFrame, by: str, offset: str, u: np.ndarray, mu: np.ndarray, var: np.ndarray) -> DataFrame:
    """by, x, and the rest f - N(mu + Ux) around the channel, of sessions whose speaker's offset (flattened) is known."""
    c, d = mu.shape

    def work(batches):
        for b in batches:
            if len(b):
                n, f = _dense(b["n"]), _dense(b["f"]).reshape(-1, c, d)
                own = _dense(b[offset]).reshape(-1, c, d)
                x, _ = _latent(n, f - n[:, :, None] * (mu + own), u, var)
                rest = f - n[:, :, None] * (mu + np.einsum("cdi,ui->ucd", u, x))
                yield pd.DataFrame({by: b[by], "x": list(x), "n": list(n), "rest": list(rest.reshape(len(f), -1))})

    return sessions.select(by, "n", "f", offset).mapInPandas(work, f"{by} {dict(sessions.dtypes)[by]}, x array<double>, n array<double>, rest array<double>")


def train_targets(sessions: DataFrame, session: str, speaker: str, u: np.ndarray, mu: np.ndarray, var: np.ndarray, tau: float = 16.0, rounds: int = 2) -> DataFrame:
    """speaker, offset: what a speaker's means differ by once each session's channel is taken off.

    In turn: channels given the offsets, then offsets (relevance tau) from what the channels leave,
    added up over a speaker's sessions by position so that partial sums combine.
    """
    zero = F.array_repeat(F.lit(0.0), int(mu.size))
    offsets = sessions.select(speaker).distinct().withColumn("offset", zero)
    c, d = mu.shape
    for _ in range(rounds):
        rest = channel_factors(sessions.join(offsets, speaker), session, "offset", u, mu, var).withColumnRenamed("rest", "f")
        total = added(rest.join(sessions.select(session, speaker), session), speaker)
        n = lambda i: F.get("n", F.floor(i / d).cast("int"))
        offsets = total.select(speaker, F.transform("f", lambda f, i: f / (n(i) + tau)).alias("offset"))
    return offsets


@query("ivector_weight_approximation", "TV-11")
def _(v):
    w, mu, var = _world(v)
    stats = session_stats(v.embeddings.select("vec_id", "v"), "vec_id", w, mu, var)
    return approximate_factors(stats, "vec_id", train_subspace(stats, mu, var, 3, 2), mu, var, w).select("vec_id", F.transform("w", lambda x: F.round(x, 4)).alias("w"))


@query("ivector_eigen_approximation", "TV-12")
def _(v):
    w, mu, var = _world(v)
    stats = session_stats(v.embeddings.select("vec_id", "v"), "vec_id", w, mu, var)
    return approximate_factors(stats, "vec_id", train_subspace(stats, mu, var, 3, 2), mu, var, w, "eigen").select("vec_id", F.transform("w", lambda x: F.round(x, 4)).alias("w"))


def _sessions(v):
    w, mu, var = _world(v)
    sessions = session_stats(v.embeddings.select("vec_id", "v"), "vec_id", w, mu, var).join(v.embeddings.select("vec_id", "label"), "vec_id")
    return sessions, train_subspace(sessions, mu, var, 2, 2), mu, var


@query("train_target_factors", "LFA-11 LFA-08")
def _(v):
    sessions, u, mu, var = _sessions(v)
    return train_targets(sessions, "vec_id", "label", u, mu, var).select("label", F.transform("offset", lambda x: F.round(x, 4)).alias("offset"))


@query("known_speaker_channel", "LFA-09")
def _(v):
    """Channel factors of each session given the offset of its speaker's trained model."""
    sessions, u, mu, var = _sessions(v)
    known = sessions.join(train_targets(sessions, "vec_id", "label", u, mu, var), "label")
    return channel_factors(known, "vec_id", "offset", u, mu, var).select("vec_id", F.transform("x", lambda x: F.round(x, 4)).alias("x"))
