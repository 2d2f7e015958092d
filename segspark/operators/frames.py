"""Frames (source, frame_idx, x): statistics, normalisation, histograms, windows and deltas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segspark.operators.scores import r
from segspark.registry import query


def _order():
    return Window.partitionBy("source").orderBy("frame_idx")


def source_stats(frames: DataFrame) -> DataFrame:
    return frames.groupBy("source").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"), F.count("*").alias("n"))

def mean_variance(frames: DataFrame, variance: bool = True) -> DataFrame:
    """x minus its source's mean, over its population deviation unless only means are wanted."""
    joined = frames.join(source_stats(frames), "source")
    x = F.col("x") - F.col("mu")
    return joined.withColumn("x", F.try_divide(x, F.when(F.col("sigma") > 0, F.col("sigma"))) if variance else x).drop("mu", "sigma", "n")

def histogram(frames: DataFrame, by: str, bins: int, low: float, high: float) -> DataFrame:
    """(by, bin, n, density): equal bins over [low, high], values outside in the end bins."""
    width = (high - low) / bins
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("x") - low) / width))).cast("int")
    counts = frames.groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    return counts.join(totals, by).select(by, "bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))

def windowed_mean(frames: DataFrame, reach: int) -> DataFrame:
    """x minus the mean of the frames up to `reach` before and after it."""
    near = _order().rowsBetween(-reach, reach)
    return frames.withColumn("x", F.col("x") - F.avg("x").over(near))

def shifted_delta(frames: DataFrame, shift: int, step: int, count: int) -> DataFrame:
    """x[t + i * step + shift] - x[t + i * step - shift] for i < count, indices clamped to the source."""
    rows = frames.select("source", "frame_idx", "x")
    out = rows
    whole = Window.partitionBy("source")
    first_x, last_x = F.min_by("x", "frame_idx").over(whole), F.max_by("x", "frame_idx").over(whole)
    at = lambda k: F.coalesce(F.lead("x", k).over(_order()) if k >= 0 else F.lag("x", -k).over(_order()), last_x if k >= 0 else first_x)
    for i in range(count):
        out = out.withColumn(f"d{i}", at(i * step + shift) - at(i * step - shift))
    return out.drop("x")

def online_cmvn(frames: DataFrame, window: float) -> DataFrame:
    """Exponential running mean and second moment: beta = (w - 1) / w; an ordered recurrence, one source at a time."""
    beta = (window - 1) / window

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame_idx")
        out, mean, square = [], None, None
        for x in part["x"].tolist():
            mean = x if mean is None else beta * mean + (1 - beta) * x
            square = x * x if square is None else beta * square + (1 - beta) * x * x
            var = square - mean * mean
            out.append((x - mean) / var**0.5 if var > 0 else None)
        return pd.DataFrame({"source": part["source"], "frame_idx": part["frame_idx"], "x": out})

    return frames.select("source", "frame_idx", "x").groupBy("source").applyInPandas(work, "source long, frame_idx long, x double")

def smoothed_curve(curve: DataFrame) -> DataFrame:
    """1/4, 1/2, 1/4 over neighbours; the ends stay."""
    left, right = F.lag("x").over(_order()), F.lead("x").over(_order())
    return curve.withColumn("x", F.when(left.isNull() | right.isNull(), F.col("x")).otherwise(0.25 * left + 0.5 * F.col("x") + 0.25 * right))

@query("frame_stats", "AGG-01 AGG-02 NRM-02", "SELECT source, round(avg(x) + 3e-8, 6) AS mu, round(var_pop(x) + 3e-8, 6) AS var, round(stddev_pop(x) + 3e-8, 6) AS sigma, count(*) AS n FROM frames GROUP BY source")
def _(v):
    return v.frames.groupBy("source").agg(r(F.avg("x")).alias("mu"), r(F.var_pop("x")).alias("var"), r(F.stddev_pop("x")).alias("sigma"), F.count("*").alias("n"))

@query("frame_meanvar", "NRM-01 SCA-07", ", m AS (SELECT source, avg(x) AS mu, stddev_pop(x) AS sigma FROM frames GROUP BY source) SELECT source, frame_idx, round((x - mu) / nullif(sigma, 0) + 3e-8, 6) AS x FROM frames JOIN m USING (source)")
def _(v):
    return mean_variance(v.frames).select("source", "frame_idx", r("x").alias("x"))

@query("frame_cms", "SCA-08 NRM-01", ", m AS (SELECT source, avg(x) AS mu FROM frames WHERE x > 50 GROUP BY source) SELECT source, frame_idx, round(x - mu + 3e-8, 6) AS x FROM frames JOIN m USING (source) WHERE x > 50")
def _(v):
    return mean_variance(v.frames.where("x > 50"), variance=False).select("source", "frame_idx", r("x").alias("x"))

@query("frame_distribution_map", "SCA-09 GMM-09", ", m AS (SELECT source, avg(x) AS mu, var_pop(x) AS var FROM frames GROUP BY source), g AS (SELECT avg(x) AS mu, var_pop(x) AS var FROM frames) SELECT source, frame_idx, round(sqrt(g.var / nullif(m.var, 0)) * (x - m.mu) + g.mu + 3e-8, 6) AS x FROM frames JOIN m USING (source), g")
def _(v):
    world = v.frames.agg(F.avg("x").alias("g_mu"), F.var_pop("x").alias("g_var"))
    own = v.frames.groupBy("source").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"))
    rows = v.frames.join(own, "source").crossJoin(F.broadcast(world))
    return rows.select("source", "frame_idx", r(F.sqrt(F.try_divide(F.col("g_var"), F.when(F.col("var") > 0, F.col("var")))) * (F.col("x") - F.col("mu")) + F.col("g_mu")).alias("x"))

@query(
    "frame_histogram",
    "AGG-05 AGG-06 SRC-23",
    """, h AS (SELECT event_type, least(19, greatest(0, floor(x / 25)))::INT AS bin, count(*) AS n FROM frames GROUP BY 1, 2)
    SELECT event_type, bin, n, round(n / (sum(n) OVER (PARTITION BY event_type) * 25.0), 8) AS density FROM h""",
)
def _(v):
    return histogram(v.frames, "event_type", 20, 0, 500).select("event_type", "bin", "n", r("density", 8).alias("density"))

@query(
    "frame_histogram_entropy",
    "AGG-07 AGG-08 SCO-03",
    """, h AS (SELECT event_type, least(19, greatest(0, floor(x / 25)))::INT AS bin, count(*) AS n FROM frames GROUP BY 1, 2), d AS (SELECT *, n / (sum(n) OVER (PARTITION BY event_type) * 25.0) AS density FROM h)
    SELECT event_type, round(-sum(25 * density * ln(density)) + 3e-8, 6) AS entropy, round(sum(25 * density * (bin * 25 + 12.5)) + 3e-8, 6) AS mean FROM d GROUP BY event_type""",
)
def _(v):
    d = histogram(v.frames, "event_type", 20, 0, 500)
    mass = 25 * F.col("density")
    return d.groupBy("event_type").agg(r(-F.sum(mass * F.ln("density"))).alias("entropy"), r(F.sum(mass * (F.col("bin") * 25 + 12.5))).alias("mean"))

@query(
    "frame_cdf_warp",
    "SCA-10 NRM-04",
    """, c AS (SELECT source, frame_idx, (rank() OVER (PARTITION BY source ORDER BY x) - 0.5) / count(*) OVER (PARTITION BY source) AS p FROM frames)
    SELECT source, frame_idx, round(ln(p / (1 - p)) + 3e-8, 6) AS x FROM c""",
)
def _(v):
    """Source CDF to the quantiles of a logistic target."""
    whole = Window.partitionBy("source")
    p = (F.rank().over(whole.orderBy("x")) - 0.5) / F.count("*").over(whole)
    return v.frames.select("source", "frame_idx", p.alias("p")).select("source", "frame_idx", r(F.ln(F.col("p") / (1 - F.col("p")))).alias("x"))

@query("frame_window_cmn", "WIN-02", "SELECT source, frame_idx, round(x - avg(x) OVER (PARTITION BY source ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + 3e-8, 6) AS x FROM frames")
def _(v):
    return windowed_mean(v.frames, 3).select("source", "frame_idx", r("x").alias("x"))

@query("frame_window_llr", "WIN-05", "SELECT source, frame_idx, round(avg(x) OVER (PARTITION BY source ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 3e-8, 6) AS llr FROM frames QUALIFY frame_idx >= 4 AND (frame_idx - 4) % 2 = 0")
def _(v):
    mean = F.avg("x").over(_order().rowsBetween(-4, 0))
    return v.frames.select("source", "frame_idx", r(mean).alias("llr")).where("frame_idx >= 4 and (frame_idx - 4) % 2 = 0")

@query(
    "frame_shifted_delta",
    "WIN-04",
    """, e AS (SELECT source, frame_idx, x, first_value(x) OVER w AS a, last_value(x) OVER (PARTITION BY source ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z,
    lead(x, 1) OVER w AS p1, lag(x, 1) OVER w AS m1, lead(x, 4) OVER w AS p4, lead(x, 2) OVER w AS p2 FROM frames WINDOW w AS (PARTITION BY source ORDER BY frame_idx))
    SELECT source, frame_idx, round(coalesce(p1, z) - coalesce(m1, a) + 3e-8, 6) AS d0, round(coalesce(p4, z) - coalesce(p2, z) + 3e-8, 6) AS d1 FROM e""",
)
def _(v):
    return shifted_delta(v.frames, 1, 3, 2).select("source", "frame_idx", r("d0").alias("d0"), r("d1").alias("d1"))

@query("frame_online_cmvn", "WIN-03")
def _(v):
    return online_cmvn(v.frames, 10.0).select("source", "frame_idx", r("x").alias("x"))

@query("frame_smoothing", "WIN-12", "SELECT source, frame_idx, round(coalesce(0.25 * lag(x) OVER w + 0.5 * x + 0.25 * lead(x) OVER w, x) + 3e-8, 6) AS x FROM frames WINDOW w AS (PARTITION BY source ORDER BY frame_idx)")
def _(v):
    return smoothed_curve(v.frames).select("source", "frame_idx", r("x").alias("x"))

@query("frame_local_max", "WIN-13 DIA-08", ", n AS (SELECT source, frame_idx, x, lag(x) OVER (PARTITION BY source ORDER BY frame_idx) AS a, lead(x) OVER (PARTITION BY source ORDER BY frame_idx) AS b, avg(x) OVER (PARTITION BY source) AS mu FROM frames) SELECT source, frame_idx, x FROM n WHERE x > a AND x > b AND x > mu")
def _(v):
    rows = v.frames.select("source", "frame_idx", "x", F.lag("x").over(_order()).alias("a"), F.lead("x").over(_order()).alias("b"), F.avg("x").over(Window.partitionBy("source")).alias("mu"))
    return rows.where("x > a and x > b and x > mu").select("source", "frame_idx", "x")

@query("frame_decimation", "FIL-05", "SELECT source, frame_idx, x FROM frames WHERE frame_idx % 5 = 0")
def _(v):
    return v.frames.where("frame_idx % 5 = 0").select("source", "frame_idx", "x")

@query("frame_bagging", "FIL-06", "SELECT source, count(*) AS n FROM frames WHERE (source * 7919 + frame_idx * 104729) % 100 < 30 GROUP BY source")
def _(v):
    """A repeatable draw: frames whose mixed index falls in the first 30 of 100."""
    return v.frames.where("(source * 7919 + frame_idx * 104729) % 100 < 30").groupBy("source").agg(F.count("*").alias("n"))

@query("frame_trimmed_mean", "FIL-12", """, k AS (SELECT source, x, row_number() OVER (PARTITION BY source ORDER BY x, frame_idx) AS k, count(*) OVER (PARTITION BY source) AS n FROM frames) SELECT source, round(avg(x) + 3e-8, 6) AS x FROM k WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY source""")
def _(v):
    whole = Window.partitionBy("source")
    k = v.frames.select("source", "x", F.row_number().over(whole.orderBy("x", "frame_idx")).alias("k"), F.count("*").over(whole).alias("n"))
    return k.where("k > floor(n * 0.1) and k <= n - floor(n * 0.1)").groupBy("source").agg(r(F.avg("x")).alias("x"))

@query(
    "frame_percentile_threshold",
    "TOP-09",
    """, h AS (SELECT source, least(19, greatest(0, floor(x / 25)))::INT AS bin, count(*) AS n FROM frames GROUP BY 1, 2), c AS (SELECT source, bin, sum(n) OVER (PARTITION BY source ORDER BY bin DESC) * 1.0 / sum(n) OVER (PARTITION BY source) AS top FROM h)
    SELECT source, (max(bin) * 25)::DOUBLE AS threshold FROM c WHERE top > 0.3 GROUP BY source""",
)
def _(v):
    h = histogram(v.frames, "source", 20, 0, 500)
    whole = Window.partitionBy("source")
    top = F.sum("n").over(whole.orderBy(F.col("bin").desc())) / F.sum("n").over(whole)
    return h.select("source", "bin", top.alias("top")).where("top > 0.3").groupBy("source").agg((F.max("bin") * 25).cast("double").alias("threshold"))

@query("frame_block_stats", "AGG-18 TOP-07", "SELECT source, frame_idx // 8 AS block, round(sum(x) + 3e-8, 6) AS s, round(sum(x * x), 4) AS ss, round(max(x) + 3e-8, 6) AS top FROM frames GROUP BY 1, 2")
def _(v):
    return v.frames.groupBy("source", F.expr("frame_idx div 8").alias("block")).agg(r(F.sum("x")).alias("s"), r(F.sum(F.col("x") * F.col("x")), 4).alias("ss"), r(F.max("x")).alias("top"))

@query("frame_mask", "FIL-03 SRC-03", "SELECT vec_id, pos, round(x + 3e-8, 6) AS x FROM vectors WHERE pos BETWEEN 0 AND 15 OR pos BETWEEN 17 AND 32")
def _(v):
    return v.vectors.where("pos between 0 and 15 or pos between 17 and 32").select("vec_id", "pos", r("x").alias("x"))
