"""Who speaks when: hidden Markov models over a recording, re-segmentation, adding speakers, delta-BIC.

Frames are (source, frame_idx, v). A recording is one ordered sequence, so its whole train-and-decode
loop runs in one task and recordings run side by side: no round of the loop goes through the driver
or a shuffle. A task holds the frames of one recording and a back pointer for each frame and state.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.registry import query

#: Relevance of the world when a state is adapted, frames a speaker needs, most rounds, and the
#: change of the path's log probability below which decoding has settled.
TAU, LEAST, ROUNDS, EPSILON = 14.0, 3, 20, 1e-6


def transitions(times: list[float], policy: str = "constant", stay: float = 0.8) -> np.ndarray:
    """Transition probabilities of states with the given frames.

    equal: all alike; constant: `stay` on the diagonal, the rest shared; unity: 1 everywhere, no cost;
    time: `stay` on the diagonal, the rest by the other states' frames.
    """
    k = len(times)
    if policy == "unity":
        return np.ones((k, k))
    if policy == "equal" or k == 1:
        return np.full((k, k), 1 / max(k, 1))
    if policy not in ("constant", "time"):
        raise ValueError(f"unknown policy {policy}")
    weight = np.tile(np.asarray(times, float) if policy == "time" else np.ones(k), (k, 1))
    np.fill_diagonal(weight, 0)
    total = weight.sum(1, keepdims=True)
    out = (1 - stay) * np.where(total > 0, weight / np.where(total > 0, total, 1), 1 / (k - 1))
    np.fill_diagonal(out, stay)
    return out


def best_path(emissions: np.ndarray, move: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Most probable states of log emissions (frames x states), and its log probability; a new piece begins where `breaks`."""
    with np.errstate(divide="ignore"):
        cost = np.log(move)
    n, k = emissions.shape
    back, score = np.zeros((n, k), np.int32), emissions[0].copy()
    for t in range(1, n):
        if breaks is not None and breaks[t]:
            back[t], score = score.argmax(), score.max() + emissions[t]
            continue
        step = score[:, None] + cost
        back[t] = step.argmax(0)
        score = step[back[t], np.arange(k)] + emissions[t]
    path = np.empty(n, np.int32)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(score.max())


def gaussian(x: np.ndarray, floor: np.ndarray | float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(0), np.maximum(x.var(0), floor)


def log_density(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * ((x - mu) ** 2 / var + np.log(2 * np.pi * var)).sum(-1)


def adapted(x: np.ndarray, world: tuple[np.ndarray, np.ndarray], tau: float = TAU) -> tuple[np.ndarray, np.ndarray]:
    """The world's Gaussian with its mean moved to x by relevance."""
    n = len(x)
    return (x.sum(0) + tau * world[0]) / (n + tau), world[1]


def resegment(x: np.ndarray, labels: list[str], policy: str = "constant", stay: float = 0.8, least: int = LEAST, rounds: int = ROUNDS, breaks: np.ndarray | None = None) -> tuple[list[str], float]:
    """Train each label's state, decode all frames again, drop short labels, until nothing changes."""
    world, now, last = gaussian(x), np.asarray(labels, object), None
    score = float("-inf")
    for _ in range(rounds):
        names, counts = np.unique(now.astype(str), return_counts=True)
        kept = [(n, c) for n, c in zip(names, counts, strict=True) if c >= least] or [max(zip(names, counts, strict=True), key=lambda p: p[1])]
        states = [adapted(x[now == n], world) for n, _ in kept]
        emissions = np.column_stack([log_density(x, *s) for s in states])
        path, score = best_path(emissions, transitions([c for _, c in kept], policy, stay), breaks)
        new = np.array([n for n, _ in kept], object)[path]
        dropped = len(kept) < len(names)
        settled = not dropped and (np.array_equal(new, now) or last is not None and abs(score - last) <= EPSILON)
        now, last = new, score
        if settled:
            break
    return now.tolist(), score


def add_speakers(x: np.ndarray, most: int = 4, window: int = 8, stay: float = 0.8, penalty: float = 1.0, breaks: np.ndarray | None = None) -> list[str]:
    """From one speaker on: the window that fits its speaker worst starts a new one; kept while the criterion rises."""
    d = x.shape[1]

    def value(labels: list[str], score: float) -> float:
        return score - penalty * 0.5 * 2 * d * len(set(labels)) * np.log(max(len(x), 2))

    labels, score = resegment(x, ["S0"] * len(x), stay=stay, breaks=breaks)
    best = value(labels, score)
    world = gaussian(x)
    for k in range(1, most):
        if len(x) < 2 * window:
            break
        names = sorted(set(labels))
        now = np.array(labels, object)
        own = np.empty(len(x))
        for n in names:
            own[now == n] = log_density(x[now == n], *adapted(x[now == n], world))
        sums = np.convolve(own, np.ones(window), "valid")
        at = int(sums.argmin())
        tried = labels[:at] + [f"S{k}"] * window + labels[at + window :]
        found, score = resegment(x, tried, stay=stay, breaks=breaks)
        if value(found, score) <= best:
            break
        labels, best = found, value(found, score)
    return labels


def decoded(frames: DataFrame, work: Callable[[np.ndarray, pd.DataFrame, np.ndarray], list[str]]) -> DataFrame:
    """source, frame_idx, label: work(x, rows, breaks) over each recording in the order of its frames."""
    kind = dict(frames.dtypes)["source"]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame_idx")
        at = part["frame_idx"].to_numpy()
        x = np.stack(part["v"].to_numpy()).astype(float)
        return pd.DataFrame({"source": part["source"].to_numpy(), "frame_idx": at, "label": work(x, part, np.diff(at, prepend=at[0] - 1) != 1)})

    return frames.groupBy("source").applyInPandas(one, f"source {kind}, frame_idx long, label string")


def resegmented(frames: DataFrame, policy: str = "constant", stay: float = 0.8, least: int = LEAST) -> DataFrame:
    """frames (source, frame_idx, v, label) with the labels of the settled decoding."""
    return decoded(frames, lambda x, part, breaks: resegment(x, part["label"].tolist(), policy, stay, least, breaks=breaks)[0])


def speakers(frames: DataFrame, most: int = 4, window: int = 8) -> DataFrame:
    """frames (source, frame_idx, v) with found speakers S0, S1, ..."""
    return decoded(frames.select("source", "frame_idx", "v"), lambda x, part, breaks: add_speakers(x, most, window, breaks=breaks))


def two_components(x: np.ndarray, rounds: int = 10) -> float:
    """Log likelihood of x under a mixture of two Gaussians: split by a deviation each way, then EM."""
    mu, var = gaussian(x)
    floor = 0.01 * var
    means, vars_, w = np.stack([mu - np.sqrt(var), mu + np.sqrt(var)]), np.stack([var, var]), np.full(2, 0.5)
    llk = 0.0
    for i in range(rounds + 1):
        e = np.column_stack([np.log(max(w[c], 1e-300)) + log_density(x, means[c], vars_[c]) for c in (0, 1)])
        each = np.logaddexp(e[:, 0], e[:, 1])
        llk = float(each.sum())
        if i < rounds:
            g = np.exp(e - each[:, None])
            n = np.maximum(g.sum(0), 1e-10)
            w, means = n / n.sum(), g.T @ x / n[:, None]
            vars_ = np.maximum(g.T @ (x * x) / n[:, None] - means**2, floor)
    return llk


def delta_bic(a: np.ndarray, b: np.ndarray) -> float:
    """LLK of both under one two-component model less the LLKs under a model for each: no penalty, as complexity is equal."""
    return two_components(np.concatenate([a, b])) - sum(float(log_density(x, *gaussian(x)).sum()) for x in (a, b))


def init_states(segments: DataFrame, kind: str = "segments") -> DataFrame:
    """(source, state, model) of a new HMM: a state for each label from the world; speech, nonspeech by name; overlap adds one."""
    labels = segments.select("source", F.col("label").alias("state")).distinct()
    if kind == "world":
        return segments.select("source", F.lit("world").alias("state"), F.lit("world").alias("model")).distinct()
    if kind == "speech":
        return labels.where("state in ('speech', 'nonspeech')").select("source", "state", F.col("state").alias("model"))
    out = labels.select("source", "state", F.lit("world").alias("model"))
    if kind == "overlap":
        out = out.unionByName(segments.select("source", F.lit("overlap").alias("state"), F.lit("world").alias("model")).distinct())
    elif kind != "segments":
        raise ValueError(f"unknown kind {kind}")
    return out


def _frames(v) -> DataFrame:
    return v.frames.select("source", "frame_idx", F.array("x").alias("v"), F.col("event_type").alias("label"))


@query("hmm_resegment", "DIA-14 DIA-15 DIA-17 DIA-18 DIA-19")
def _(v):
    return resegmented(_frames(v))


@query("hmm_add_speakers", "DIA-16 DIA-12 DIA-13")
def _(v):
    return speakers(_frames(v))


@query("hmm_init_states", "DIA-10", "SELECT DISTINCT source, label AS state, 'world' AS model FROM segments UNION ALL SELECT DISTINCT source, 'overlap', 'world' FROM segments")
def _(v):
    return init_states(v.segments, "overlap")


@query("segment_delta_bic", "DIA-04 DIA-06")
def _(v):
    """Delta-BIC of each two classes of a recording; a class needs two frames."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        x = {n: np.stack(g["v"].to_numpy()).astype(float) for n, g in part.sort_values("frame_idx").groupby("label") if len(g) > 1}
        rows = [(part["source"].iloc[0], a, b, round(delta_bic(x[a], x[b]), 4)) for a in sorted(x) for b in sorted(x) if a < b]
        return pd.DataFrame(rows, columns=["source", "a", "b", "delta_bic"])

    return _frames(v).groupBy("source").applyInPandas(work, "source long, a string, b string, delta_bic double")
