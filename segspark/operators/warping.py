"""Warping of scores through histograms, Gaussian draws, and weights from score densities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.operators.scores import r
from segspark.registry import query


@dataclass(frozen=True)
class Histogram:
    """Edges of the bins in rising order and each bin's share of the mass."""

    edges: np.ndarray
    area: np.ndarray

    @property
    def before(self) -> np.ndarray:
        """Mass below each bin."""
        return np.concatenate([[0.0], np.cumsum(self.area)[:-1]])

    def central(self, share: float) -> float:
        """Width between the bins that hold the tails beyond the central `share` of the mass."""
        if share == 0:
            return 0.0
        tail = (1 - share) / 2
        low = int((self.before < tail).sum())
        high = int((self.before + self.area <= 1 - tail).sum()) - 1
        if low >= len(self.area) or high < 0:
            raise ValueError("a bin holds more than the central share")
        return float(self.edges[high] - self.edges[low + 1])


def observed(rows: DataFrame, value: str, bins: int) -> Histogram:
    """Histogram of equal bins from the least to the greatest value; `bins` counts reach the driver."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        raise ValueError("no scores")
    width = (high - low) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width)).cast("int")
    area = np.zeros(bins)
    for k, n in rows.where(F.col(value).isNotNull()).groupBy(place).count().collect():
        area[k] = n
    return Histogram(low + width * np.arange(bins + 1), area / area.sum())


def gaussian(bins: int = 100, reach: float = 5.0) -> Histogram:
    """Standard normal over -reach..reach, a bin's mass being its centre's density times its width, scaled to 1."""
    at = lambda k: (2 * k - bins) * reach / bins
    mass = np.exp(-0.5 * at(np.arange(bins) + 0.5) ** 2)
    return Histogram(at(np.arange(bins + 1)), mass / np.cumsum(mass)[-1])


def warp(x: np.ndarray, raw: Histogram, target: Histogram, unobserved: float = 0.0, share: float = 0.683) -> np.ndarray:
    """Values of `raw` at equal mass of `target`, linear within a bin.

    Half the `unobserved` mass lies below the least value. Beyond raw's bounds the central widths of
    the two histograms give the scale. A bin without mass, or without width, counts as passed.
    """
    def part(v, wide):
        return np.where(wide < 1e-21, 1.0, v / np.where(wide < 1e-21, 1.0, wide))

    # A share of a bin is divided by the bin's own mass: a difference of sums near 1 has lost most digits of a tail's.
    e, t = raw.edges, target.edges
    k = np.clip(np.searchsorted(e[1:], x, side="left"), 0, len(raw.area) - 1)
    mass = unobserved / 2 + np.cumsum(raw.area)[k] - raw.area[k] + raw.area[k] * part(x - e[k], e[k + 1] - e[k])
    upper = np.cumsum(target.area)
    j = np.clip(np.searchsorted(upper, mass, side="left"), 0, len(target.area) - 1)
    inside = t[j] + (t[j + 1] - t[j]) * part(mass - upper[j] + target.area[j], target.area[j])
    wide, out = raw.central(share), target.central(share)
    below = t[0] - part(x - e[0] + wide, wide) * out
    above = t[-1] + part(x - e[-1], wide) * out
    return np.where(x < e[0], below, np.where(x > e[-1], above, inside))


def warped(rows: DataFrame, value: str, raw: Histogram, target: Histogram, unobserved: float = 0.0, share: float = 0.683) -> DataFrame:
    @F.pandas_udf("double")
    def turn(x: pd.Series) -> pd.Series:
        return pd.Series(warp(x.to_numpy(float), raw, target, unobserved, share)).where(x.notna().to_numpy())

    return rows.withColumn(value, turn(value))


def uniform(i: Column, seed: int = 1) -> Column:
    """A draw from (0, 1) that depends on the number and the seed alone, so a lost task draws the same again."""
    digest = F.md5(F.concat(i.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def normal(i: Column, mean: float, deviation: float, seed: int = 1) -> Column:
    """Box-Muller draw number i: a value shares a uniform draw with the one before it."""
    return F.sqrt(-2 * F.ln(uniform(i + 1, seed))) * F.cos(2 * np.pi * uniform(i, seed)) * deviation + mean


_HISTOGRAMS = """, b AS (SELECT min(llr) AS low, (max(llr) - min(llr)) / 20 AS width FROM scores WHERE segment % 3 = 0), c AS (SELECT least(19, floor((llr - low) / width))::INT AS k, count(*) AS n FROM scores, b WHERE segment % 3 = 0 GROUP BY 1),
h AS (SELECT k, low + width * k AS lo, low + width * (k + 1) AS hi, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS area FROM (SELECT unnest(range(0, 20)) AS k) LEFT JOIN c USING (k), b), hc AS (SELECT *, sum(area) OVER (ORDER BY k) AS upto FROM h),
g AS (SELECT k, -5 + 0.1 * k AS lo, -4.9 + 0.1 * k AS hi, exp(-0.5 * (-4.95 + 0.1 * k) ** 2) AS m FROM (SELECT unnest(range(0, 100)) AS k)), gh AS (SELECT k, lo, hi, m / sum(m) OVER () AS area FROM g), gc AS (SELECT *, sum(area) OVER (ORDER BY k) AS upto FROM gh),
hw AS (SELECT max(CASE WHEN upto <= 1 - 0.1585 THEN lo END) - min(CASE WHEN upto - area >= 0.1585 THEN hi END) AS wide FROM hc), gw AS (SELECT max(CASE WHEN upto <= 1 - 0.1585 THEN lo END) - min(CASE WHEN upto - area >= 0.1585 THEN hi END) AS wide FROM gc)"""


@query(
    "score_warp",
    "SCA-11 NRM-03 POST-10 POST-16",
    f"""{_HISTOGRAMS}, x AS (SELECT client, segment, llr, (SELECT min(lo) FROM hc) AS first, (SELECT max(hi) FROM hc) AS last FROM scores WHERE segment % 3 <> 0),
    m AS (SELECT client, segment, llr, 0.01 + upto - area + area * (llr - lo) / (hi - lo) AS mass FROM x JOIN hc ON llr <= hi AND (llr > lo OR (k = 0 AND llr >= lo)) WHERE llr BETWEEN first AND last),
    i AS (SELECT client, segment, mass, (SELECT min(k) FROM gc WHERE upto >= mass) AS k FROM m)
    SELECT client, segment, round(lo + (hi - lo) * (mass - upto + area) / area, 5) AS llr FROM i JOIN gc ON gc.k = coalesce(i.k, 99)
    UNION ALL SELECT client, segment, round(CASE WHEN llr < first THEN -5 - (llr - first + hw.wide) / hw.wide * gw.wide ELSE 5 + (llr - last) / hw.wide * gw.wide END, 5) FROM x, hw, gw WHERE llr < first OR llr > last""",
)
def _(v):
    """Scores of two thirds of the segments by the histogram of the rest, to a standard normal, with 2 % of the mass unobserved."""
    raw = observed(v.scores_in_order.where("segment % 3 = 0"), "llr", 20)
    return warped(v.scores_in_order.where("segment % 3 <> 0"), "llr", raw, gaussian(), 0.02).select("client", "segment", r("llr", 5).alias("llr"))


@query("gaussian_draws", "SCA-12", """, u AS (SELECT i, (('0x' || substr(md5(i::VARCHAR || ':1'), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM range(0, 1001) t(i)) SELECT a.i AS id, round(sqrt(-2 * ln(b.u)) * cos(2 * pi() * a.u) * 2 + 1 + 3e-8, 6) AS x FROM u a JOIN u b ON b.i = a.i + 1""")
def _(v):
    return v.spark.range(0, 1000).select("id", r(normal(F.col("id"), 1.0, 2.0)).alias("x"))


def wmap(llr: Column, target: tuple[Column, Column], other: tuple[Column, Column], prior: float) -> Column:
    """Posterior of a target trial from the Gaussian densities (mean, deviation) of target and other scores."""
    log_density = lambda m, s: -0.5 * ((llr - m) / s) * ((llr - m) / s) - F.ln(s)
    odds = log_density(*other) - log_density(*target) + float(np.log((1 - prior) / prior))
    return 1 / (1 + F.exp(F.least(odds, F.lit(700.0))))


@query(
    "score_weight_wmap",
    "",
    """, g AS (SELECT (client = (SELECT min(event_type) FROM events)) AS t, avg(llr) AS m, stddev_pop(llr) AS s FROM scores WHERE segment % 2 = 0 GROUP BY 1), p AS (SELECT max(CASE WHEN t THEN m END) AS tm, max(CASE WHEN t THEN s END) AS ts, max(CASE WHEN NOT t THEN m END) AS om, max(CASE WHEN NOT t THEN s END) AS os FROM g)
    SELECT client, segment, round(1 / (1 + exp(least(700, -0.5 * ((llr - om) / os) ** 2 - ln(os) + 0.5 * ((llr - tm) / ts) ** 2 + ln(ts) + ln(9)))) + 3e-8, 6) AS weight FROM scores, p WHERE segment % 2 = 1""",
)
def _(v):
    """Weights of unseen trials; densities from the even segments, the first client's scores being the targets."""
    first = v.table("events").agg(F.min("event_type").alias("first"))
    even = v.scores.where("segment % 2 = 0").crossJoin(first)  # one row
    when = lambda f, own: f(F.when((F.col("client") == F.col("first")) == own, F.col("llr")))
    fit = even.agg(when(F.avg, True).alias("tm"), when(F.stddev_pop, True).alias("ts"), when(F.avg, False).alias("om"), when(F.stddev_pop, False).alias("os"))
    rows = v.scores.where("segment % 2 = 1").crossJoin(fit)  # one row
    weight = wmap(F.col("llr"), (F.col("tm"), F.col("ts")), (F.col("om"), F.col("os")), 0.1)
    return rows.select("client", "segment", r(weight).alias("weight"))
