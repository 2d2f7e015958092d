"""Iterative training: mixtures by EM, total-variability subspaces, support vectors, hidden Markov decoding.

Each round is one pass over the rows that returns sufficient statistics, one block for each task;
only those (components x dims, or rank x rank) reach the driver, where the small systems are solved.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.registry import query


def _dense(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def _summed(rows: DataFrame, work) -> np.ndarray:
    """The sum of the arrays that work(batch) returns, added up by Spark."""

    def parts(batches):
        total = None
        for batch in batches:
            if len(batch):
                block = work(batch)
                total = block if total is None else total + block
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size, dtype=np.int32), "x": total.ravel(), "d": str(total.shape)})

    found = rows.mapInPandas(parts, "i int, x double, d string").groupBy("i").agg(F.sum("x").alias("x"), F.first("d").alias("d")).collect()
    if not found:
        raise ValueError("no rows to train on")
    shape = tuple(int(s) for s in found[0]["d"].strip("(),").split(","))
    out = np.zeros(int(np.prod(shape)))
    for r in found:
        out[r["i"]] = r["x"]
    return out.reshape(shape)


def component_likelihoods(x: np.ndarray, w: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log of weight times density, rows x components; squares are expanded around the mean of the components' means."""
    centre = mu.mean(0)
    x, m, inv = x - centre, mu - centre, 1 / var
    squares = (x * x) @ inv.T - 2 * (x @ (m * inv).T) + (m * m * inv).sum(1)
    return np.log(w) - 0.5 * (squares + np.log(2 * np.pi * var).sum(1))


def responsibilities(x: np.ndarray, w: np.ndarray, mu: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each component and log likelihood of each row."""
    e = component_likelihoods(x, w, mu, var)
    top = e.max(1, keepdims=True)
    llk = top + np.log(np.exp(e - top).sum(1, keepdims=True))
    return np.exp(e - llk), llk[:, 0]


@contextmanager
def held(rows: DataFrame) -> Iterator[DataFrame]:
    """Rows for many passes: kept by the executors while in use, and computed again where one is lost."""
    if rows.is_cached:
        yield rows
        return
    rows.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def train_mixture(rows: DataFrame, w: np.ndarray, mu: np.ndarray, var: np.ndarray, rounds: int = 5, floor: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """EM over `v`; variances are floored at `floor` of the global ones. Returns the model and each round's mean LLK."""
    world = _summed(rows, lambda b: np.stack([(x := _dense(b["v"])).sum(0), (x * x).sum(0), np.full(x.shape[1], len(x))]))
    least = floor * (world[1] / world[2] - (world[0] / world[2]) ** 2)
    history = []
    for _ in range(rounds):

        def step(b, w=w, mu=mu, var=var):
            x = _dense(b["v"])
            g, llk = responsibilities(x, w, mu, var)
            return np.concatenate([np.column_stack([g.sum(0), g.T @ x, g.T @ (x * x)]), np.pad([[llk.sum(), len(x)]], ((0, 0), (0, 2 * x.shape[1] - 1)))])

        s = _summed(rows, step)
        n, d = np.maximum(s[:-1, 0], 1e-10), mu.shape[1]
        w, mu = n / n.sum(), s[:-1, 1 : 1 + d] / n[:, None]
        var = np.maximum(s[:-1, 1 + d :] / n[:, None] - mu**2, least)
        history.append(float(s[-1, 0] / s[-1, 1]))
    return w, mu, var, history


def split_init(mean: np.ndarray, var: np.ndarray, doublings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2**doublings components: each step moves copies by one deviation both ways."""
    mu, v = mean[None], var[None]
    for _ in range(doublings):
        mu, v = np.concatenate([mu - np.sqrt(v), mu + np.sqrt(v)]), np.concatenate([v, v])
    return np.full(len(mu), 1 / len(mu)), mu, v


def train_subspace(stats: DataFrame, mu: np.ndarray, var: np.ndarray, rank: int, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """Total-variability matrix T (comps x dims x rank) by EM over rows (n: array by comp, f: array by comp x dims)."""
    c, d = mu.shape
    t = np.random.default_rng(seed).normal(size=(c, d, rank)) * np.sqrt(var)[:, :, None] * 0.1
    with held(stats):
        for _ in range(rounds):

            def step(b, t=t):
                n, f = _dense(b["n"]), _dense(b["f"]).reshape(-1, c, d) - _dense(b["n"])[:, :, None] * mu
                w, cov = _latent(n, f, t, var)
                second = cov + w[:, :, None] * w[:, None, :]
                a = np.einsum("uc,uij->cij", n, second)
                b2 = np.einsum("ucd,ui->cdi", f, w)
                return np.concatenate([a.reshape(c, -1), b2.reshape(c, -1)], axis=1)

            s = _summed(stats, step)
            a, b2 = s[:, : rank * rank].reshape(c, rank, rank), s[:, rank * rank :].reshape(c, d, rank)
            t = np.stack([np.linalg.solve(a[k] + 1e-9 * np.eye(rank), b2[k].T).T for k in range(c)])
    return t


def _latent(n: np.ndarray, f: np.ndarray, t: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and covariance of the factors: (I + sum N T'T/var)^-1 T'F/var."""
    scaled = t / var[:, :, None]
    blocks = np.einsum("cdi,cdj->cij", scaled, t)
    cov = np.linalg.inv(np.eye(t.shape[2]) + np.einsum("uc,cij->uij", n, blocks))
    return np.einsum("uij,uj->ui", cov, np.einsum("ucd,cdi->ui", f, scaled)), cov


def _rows(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _batch(by: str, keys: pa.Array, n: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel()) for m in (n, f)]
    return pa.RecordBatch.from_arrays([keys, *lists], [by, "n", "f"])


def added(parts: DataFrame, by: str) -> DataFrame:
    """Rows (by, n, f) added up by key, one pass over sorted rows, so a task holds no more than a batch and one key's sums."""

    def work(batches):
        held_key, n, f = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_pylist()
            starts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            bn, bf = np.add.reduceat(_rows(b.column(1)), starts), np.add.reduceat(_rows(b.column(2)), starts)
            if n is not None and held_key.to_pylist()[0] == keys[0]:
                bn[0], bf[0] = bn[0] + n[0], bf[0] + f[0]
            elif n is not None:
                yield _batch(by, held_key, n, f)
            if len(starts) > 1:
                yield _batch(by, b.column(0).take(pa.array(starts[:-1])), bn[:-1], bf[:-1])
            held_key, n, f = b.column(0).take(pa.array(starts[-1:])), bn[-1:], bf[-1:]
        if n is not None:
            yield _batch(by, held_key, n, f)

    ordered = parts.select(by, "n", "f").repartition(by).sortWithinPartitions(by)
    return ordered.mapInArrow(work, f"{by} {dict(parts.dtypes)[by]}, n array<double>, f array<double>")


def session_stats(rows: DataFrame, by: str, w: np.ndarray, mu: np.ndarray, var: np.ndarray) -> DataFrame:
    """by, n (array by component), f (flattened components x dims): zero and first order statistics.

    A batch is added up before the shuffle, which so moves a row for each key of a batch, not one for each cell of a frame.
    """

    def work(batches):
        for b in batches:
            if b.num_rows:
                x = _rows(b.column(1))
                g, _ = responsibilities(x, w, mu, var)
                coded = b.column(0).dictionary_encode(null_encoding="encode")
                codes = np.asarray(coded.indices)
                order = np.argsort(codes, kind="stable")
                starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary)))
                g, x = g[order], x[order]
                f = np.stack([(g[i:j].T @ x[i:j]).ravel() for i, j in zip(starts, [*starts[1:], len(x)])])
                yield _batch(by, coded.dictionary, np.add.reduceat(g, starts), f)

    parts = rows.select(by, F.col("v").cast("array<double>").alias("v")).mapInArrow(work, f"{by} {dict(rows.dtypes)[by]}, n array<double>, f array<double>")
    return added(parts, by)


def factors(stats: DataFrame, by: str, t: np.ndarray, mu: np.ndarray, var: np.ndarray) -> DataFrame:
    """by, w: the posterior mean of each session's factors (i-vector)."""
    c, d = mu.shape

    def work(batches):
        for b in batches:
            if len(b):
                n = _dense(b["n"])
                w, _ = _latent(n, _dense(b["f"]).reshape(-1, c, d) - n[:, :, None] * mu, t, var)
                yield pd.DataFrame({by: b[by], "w": list(w)})

    return stats.mapInPandas(work, f"{by} {dict(stats.dtypes)[by]}, w array<double>")


def train_svm(rows: DataFrame, rounds: int = 30, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear classifier with squared hinge loss over (v, y in -1, 1): full-gradient Newton steps on summed statistics."""
    d = rows.select(F.size("v")).first()[0]
    w = np.zeros(d + 1)
    for _ in range(rounds):

        def step(b, w=w):
            x = np.column_stack([_dense(b["v"]), np.ones(len(b))])
            y = b["y"].to_numpy(float)
            active = y * (x @ w) < 1
            xa, ya = x[active], y[active]
            return np.column_stack([xa.T @ xa, xa.T @ ya])

        s = _summed(rows, step)
        new = np.linalg.solve(np.eye(d + 1) / (2 * c) + s[:, :-1], s[:, -1])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def viterbi(rows: DataFrame, order: str, emissions: list[str], stay: float) -> DataFrame:
    """source, frame_idx, state: best path with equal switch costs; one source is one ordered pass."""
    k = len(emissions)
    cost = np.full((k, k), np.log((1 - stay) / max(1, k - 1)))
    np.fill_diagonal(cost, np.log(stay))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        e = part[emissions].to_numpy(float)
        score, back = e[0], np.zeros((len(e), k), np.int32)
        for t in range(1, len(e)):
            step = score[:, None] + cost
            back[t] = step.argmax(0)
            score = step.max(0) + e[t]
        path = [int(score.argmax())]
        for t in range(len(e) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return pd.DataFrame({"source": part["source"], order: part[order], "state": path[::-1]})

    return rows.groupBy("source").applyInPandas(work, f"source long, {order} long, state int")


def _named_world(v) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Names, weights, means and variances of the components, in the order of names."""
    rows = sorted(v.comps.collect(), key=lambda r: (r["comp"], r["pos"]))
    names = sorted({r["comp"] for r in rows})
    get = lambda key: np.array([r[key] for r in rows]).reshape(len(names), -1)
    return names, get("weight")[:, 0], get("mu"), get("var")


def _world(v) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _named_world(v)[1:]


@query("gmm_train_em", "GMM-03 GMM-05 GMM-18")
def _(v):
    s = _summed(v.embeddings, lambda b: np.stack([(x := _dense(b["v"])).sum(0), (x * x).sum(0), np.full(x.shape[1], len(x))]))
    mean = s[0] / s[2]
    w, mu, _, history = train_mixture(v.embeddings, *split_init(mean, s[1] / s[2] - mean**2, 2))
    return v.spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(history)], "round int, llk double")


@query("energy_detector", "GMM-06 GMM-16 TOP-10 FIL-04 ONL-09")
def _(v):
    """Three components on normalised energy; frames above the mid of the two highest means are speech."""
    stats = v.frames.groupBy("source").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    rows = v.frames.join(stats, "source").where("s > 0").select("source", "frame_idx", F.array((F.col("x") - F.col("m")) / F.col("s")).alias("v"))
    _, mu, _, _ = train_mixture(rows, np.full(3, 1 / 3), np.array([[-2.0], [0.0], [2.0]]), np.ones((3, 1)), 5)
    top = np.sort(mu[:, 0])
    return rows.where(F.col("v")[0] > float(top[1] + top[2]) / 2).groupBy("source").agg(F.count("*").alias("speech"))


@query("ivector_extract", "TV-01 TV-02 TV-03 TV-04 TV-05 TV-06 TV-07 TV-10 TV-14 SRC-11 JFA-06 JFA-07")
def _(v):
    w, mu, var = _world(v)
    stats = session_stats(v.embeddings.select("vec_id", "v"), "vec_id", w, mu, var)
    t = train_subspace(stats, mu, var, 4)
    return factors(stats, "vec_id", t, mu, var).select("vec_id", F.transform("w", lambda x: F.round(x, 4)).alias("w"))


@query("svm_target", "SUP-09 SUP-10")
def _(v):
    first = v.embeddings.agg(F.min("label").alias("first"))
    rows = v.embeddings.join(F.broadcast(first)).select("vec_id", "v", F.when(F.col("label") == F.col("first"), 1.0).otherwise(-1.0).alias("y"))
    w, b = train_svm(rows)
    terms = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x * y), F.lit(float(b)), lambda s, x: s + x)
    return rows.select("vec_id", F.round(terms, 4).alias("score"))


@query("viterbi_two_state", "DIA-09 DIA-11 DIA-12 DIA-13 DIA-16")
def _(v):
    gap = lambda mu: -((F.col("x") - mu) ** 2) / F.lit(2 * 80.0**2)
    rows = v.frames.select("source", "frame_idx", gap(100.0).alias("low"), gap(350.0).alias("high"))
    return viterbi(rows, "frame_idx", ["low", "high"], 0.8)
