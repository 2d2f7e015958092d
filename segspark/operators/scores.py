"""Trial scores: cohort normalisation, decisions, fusion, formats. Rows are (gender, client, segment, llr)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.registry import query

#: Digits kept in results, and what is added first, so that summation order can't decide a half.
_R, TIE = 6, 3e-8


def stats(rows: DataFrame, by: str, value: str = "llr") -> DataFrame:
    """Mean and population deviation by key; no floor, so equal scores give null after try_divide."""
    return rows.groupBy(by).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"))


def normalised(rows: DataFrame, cohort: DataFrame, by: str, value: str = "llr") -> DataFrame:
    """(llr - mean) / deviation of the cohort's rows with the same key."""
    joined = rows.join(stats(cohort, by, value), by)
    return joined.withColumn(value, F.try_divide(F.col(value) - F.col("mu"), F.when(F.col("sigma") > 0, F.col("sigma")))).drop("mu", "sigma")


def trimmed(rows: DataFrame, by: str, high: float, low: float, value: str = "llr") -> DataFrame:
    """Rows without the floor(n * high) largest and floor(n * low) smallest of each key."""
    down = Window.partitionBy(by).orderBy(F.col(value).desc(), "client", "segment")
    ranked = rows.withColumn("k", F.row_number().over(down)).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    return ranked.where((F.col("k") > F.floor(F.col("n") * high)) & (F.col("k") <= F.col("n") - F.floor(F.col("n") * low))).drop("k", "n")


def median_stats(rows: DataFrame, by: str, value: str = "llr") -> DataFrame:
    """Lower median in falling order, and mean absolute deviation from it."""
    down = Window.partitionBy(by).orderBy(F.col(value).desc(), "client", "segment")
    ranked = rows.withColumn("k", F.row_number().over(down) - 1).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    middle = ranked.where("k = n div 2").select(by, F.col(value).alias("median"))
    return rows.join(middle, by).groupBy(by).agg(F.first("median").alias("median"), F.avg(F.abs(F.col(value) - F.col("median"))).alias("deviation"))


def r(c, digits: int = _R) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + TIE, digits) if digits == _R else F.round(c, digits)


_NORM = "round((s.llr - t.mu) / nullif(t.sigma, 0) + 3e-8, 6) AS llr"


@query("score_tnorm", "POST-01 JOI-03", f"SELECT s.client, s.segment, {_NORM} FROM scores s JOIN (SELECT segment, avg(llr) AS mu, stddev_pop(llr) AS sigma FROM scores GROUP BY segment) t USING (segment)")
def _(v):
    return normalised(v.scores, v.scores, "segment").select("client", "segment", r("llr").alias("llr"))


@query("score_znorm", "POST-02 JOI-03 AGG-09", f"SELECT s.client, s.segment, {_NORM} FROM scores s JOIN (SELECT client, avg(llr) AS mu, stddev_pop(llr) AS sigma FROM scores WHERE segment % 3 = 0 GROUP BY client) t USING (client) WHERE s.segment % 3 <> 0")
def _(v):
    return normalised(v.scores.where("segment % 3 <> 0"), v.scores.where("segment % 3 = 0"), "client").select("client", "segment", r("llr").alias("llr"))


_T = "t AS (SELECT s.gender, s.client, s.segment, (s.llr - m.mu) / nullif(m.sigma, 0) AS llr FROM scores s JOIN (SELECT segment, avg(llr) AS mu, stddev_pop(llr) AS sigma FROM scores GROUP BY segment) m USING (segment))"
_Z = "z AS (SELECT s.gender, s.client, s.segment, (s.llr - m.mu) / nullif(m.sigma, 0) AS llr FROM scores s JOIN (SELECT client, avg(llr) AS mu, stddev_pop(llr) AS sigma FROM scores WHERE segment % 3 = 0 GROUP BY client) m USING (client))"


@query("score_tznorm", "POST-03", f", {_T} SELECT s.client, s.segment, {_NORM} FROM t s JOIN (SELECT client, avg(llr) AS mu, stddev_pop(llr) AS sigma FROM t WHERE segment % 3 = 0 GROUP BY client) t USING (client)")
def _(v):
    t = normalised(v.scores, v.scores, "segment")
    return normalised(t, t.where("segment % 3 = 0"), "client").select("client", "segment", r("llr").alias("llr"))


@query("score_ztnorm", "POST-03", f", {_Z} SELECT s.client, s.segment, {_NORM} FROM z s JOIN (SELECT segment, avg(llr) AS mu, stddev_pop(llr) AS sigma FROM z GROUP BY segment) t USING (segment)")
def _(v):
    z = normalised(v.scores, v.scores.where("segment % 3 = 0"), "client")
    return normalised(z, z, "segment").select("client", "segment", r("llr").alias("llr"))


@query(
    "score_trimmed_stats",
    "POST-04",
    """, k AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY llr DESC, segment) AS k, count(*) OVER (PARTITION BY client) AS n FROM scores)
    SELECT client, round(avg(llr) + 3e-8, 6) AS mu, round(stddev_pop(llr) + 3e-8, 6) AS sigma FROM k WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.05) GROUP BY client""",
)
def _(v):
    return stats(trimmed(v.scores, "client", 0.1, 0.05), "client").select("client", r("mu").alias("mu"), r("sigma").alias("sigma"))


@query(
    "score_median_stats",
    "POST-05",
    """, k AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY llr DESC, segment) - 1 AS k, count(*) OVER (PARTITION BY client) AS n FROM scores), m AS (SELECT client, llr AS median FROM k WHERE k = n // 2)
    SELECT client, round(any_value(median) + 3e-8, 6) AS median, round(avg(abs(llr - median)) + 3e-8, 6) AS deviation FROM scores JOIN m USING (client) GROUP BY client""",
)
def _(v):
    return median_stats(v.scores, "client").select("client", r("median").alias("median"), r("deviation").alias("deviation"))


@query("score_decision_inclusive", "SCA-03 SRC-12", "SELECT client, segment, CASE WHEN llr >= 250 THEN 1 ELSE 0 END AS decision FROM scores")
def _(v):
    return v.scores.select("client", "segment", (F.col("llr") >= 250).cast("int").alias("decision"))


@query(
    "score_nist_format",
    "SCA-04 SCA-06 SRC-15 SRC-18 POST-06",
    "SELECT concat_ws(' ', '1side', 'n', '1side', CASE WHEN gender = 'F' THEN 'f' ELSE 'm' END, client, segment::VARCHAR, CASE WHEN llr > 250 THEN 't' ELSE 'f' END, round(llr * 1000)::BIGINT::VARCHAR) AS line FROM scores",
)
def _(v):
    gender = F.when(F.col("gender") == "F", "f").otherwise("m")
    decision = F.when(F.col("llr") > 250, "t").otherwise("f")
    line = F.concat_ws(" ", F.lit("1side"), F.lit("n"), F.lit("1side"), gender, "client", F.col("segment").cast("string"), decision, F.round(F.col("llr") * 1000).cast("long").cast("string"))
    return v.scores_in_order.select(line.alias("line"))


@query("score_etf_mdtm", "SCA-05 SCA-06 SRC-14 SRC-16 SRC-17 POST-09", """SELECT concat_ws(' ', source::VARCHAR, '1', ("begin" * 10)::VARCHAR, (length * 10 - 10)::VARCHAR, 'speaker', label, CASE WHEN source % 2 = 0 THEN 'female' ELSE 'male' END) AS etf,
    concat_ws(' ', source::VARCHAR, '1', ("begin" * 10)::VARCHAR, (length * 10)::VARCHAR, 'speaker', 'NA', CASE WHEN source % 2 = 0 THEN 'adult_female' ELSE 'adult_male' END) AS mdtm FROM segments""")
def _(v):
    ms = lambda c: (c * 10).cast("string")
    female = F.col("source") % 2 == 0
    etf = F.concat_ws(" ", F.col("source").cast("string"), F.lit("1"), ms(F.col("begin")), ms(F.col("length") - 1), F.lit("speaker"), "label", F.when(female, "female").otherwise("male"))
    mdtm = F.concat_ws(" ", F.col("source").cast("string"), F.lit("1"), ms(F.col("begin")), ms(F.col("length")), F.lit("speaker"), F.lit("NA"), F.when(female, "adult_female").otherwise("adult_male"))
    return v.segments.select(etf.alias("etf"), mdtm.alias("mdtm"))


@query("score_argmax_client", "TOP-06 TOP-12 POST-07 TOP-11", "SELECT segment, client, round(llr + 3e-8, 6) AS llr FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY llr DESC, client DESC) AS k FROM scores) WHERE k = 1")
def _(v):
    best = F.max(F.struct("llr", "client")).alias("b")
    return v.scores.groupBy("segment").agg(best).select("segment", "b.client", r("b.llr").alias("llr"))


@query("score_n_best", "TOP-05", "SELECT client, segment, round(llr + 3e-8, 6) AS llr FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY llr DESC, segment) AS k FROM scores) WHERE k <= 10")
def _(v):
    down = Window.partitionBy("client").orderBy(F.col("llr").desc(), "segment")
    return v.scores.withColumn("k", F.row_number().over(down)).where("k <= 10").select("client", "segment", r("llr").alias("llr"))


@query("score_n_best_fused", "TOP-05 POST-11", "SELECT client, round(avg(llr) + 3e-8, 6) AS llr FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY llr DESC, segment) AS k FROM scores) WHERE k <= 10 GROUP BY client")
def _(v):
    down = Window.partitionBy("client").orderBy(F.col("llr").desc(), "segment")
    return v.scores.withColumn("k", F.row_number().over(down)).where("k <= 10").groupBy("client").agg(r(F.avg("llr")).alias("llr"))


_SYSTEMS = ", two AS (SELECT user_id AS segment, event_type AS client, max(value) AS other FROM events GROUP BY user_id, event_type)"


def _systems(v) -> DataFrame:
    """Two systems' scores of the same trials, joined by trial."""
    other = v.table("events").groupBy(F.col("user_id").alias("segment"), F.col("event_type").alias("client")).agg(F.max("value").alias("other"))
    return v.scores.join(other, ["segment", "client"])


@query("fusion_arithmetic", "POST-11 JOI-06", f"{_SYSTEMS} SELECT client, segment, round((0.3 * llr + 0.7 * other) / 1.0 + 3e-8, 6) AS llr FROM scores JOIN two USING (segment, client)")
def _(v):
    return _systems(v).select("client", "segment", r((0.3 * F.col("llr") + 0.7 * F.col("other")) / 1.0).alias("llr"))


@query("fusion_geometric", "POST-12", f"{_SYSTEMS} SELECT client, segment, round(exp((0.3 * ln(llr) + 0.7 * ln(other)) / 1.0) + 3e-8, 6) AS llr FROM scores JOIN two USING (segment, client)")
def _(v):
    return _systems(v).select("client", "segment", r(F.exp((0.3 * F.ln("llr") + 0.7 * F.ln("other")) / 1.0)).alias("llr"))


@query("fusion_binned", "POST-13", f"{_SYSTEMS} SELECT client, segment, round(CASE WHEN llr < 200 THEN 0.9 * llr + 0.1 * other WHEN llr < 300 THEN 0.5 * llr + 0.5 * other ELSE 0.1 * llr + 0.9 * other END + 3e-8, 6) AS llr FROM scores JOIN two USING (segment, client)")
def _(v):
    w = F.when(F.col("llr") < 200, 0.9).when(F.col("llr") < 300, 0.5).otherwise(0.1)
    first = F.when(F.col("llr") < 200, 0.1).when(F.col("llr") < 300, 0.5).otherwise(0.9)
    return _systems(v).select("client", "segment", r(w * F.col("llr") + first * F.col("other")).alias("llr"))


@query("fusion_by_class", "POST-14 JOI-10 SCA-17", "SELECT substr(client, 1, 1) AS class, segment, round(sum(llr * (1 + length(client))) / sum(1 + length(client)) + 3e-8, 6) AS llr FROM scores GROUP BY 1, 2")
def _(v):
    w = 1 + F.length("client")
    return v.scores.groupBy(F.substring("client", 1, 1).alias("class"), "segment").agg(r(F.sum(F.col("llr") * w) / F.sum(w)).alias("llr"))


@query(
    "score_leave_max_out",
    "POST-08 AGG-18 JOI-08",
    """, m AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY llr DESC, client) AS k, max(llr) OVER (PARTITION BY segment) AS top, sum(llr) OVER (PARTITION BY segment) AS total, count(*) OVER (PARTITION BY segment) AS n FROM scores)
    SELECT client, segment, round(CASE WHEN k = 1 THEN (total - llr) / nullif(n - 1, 0) ELSE (total - llr - top) / nullif(n - 2, 0) END + 3e-8, 6) AS mu FROM m""",
)
def _(v):
    whole = Window.partitionBy("segment")
    k = F.row_number().over(whole.orderBy(F.col("llr").desc(), "client"))
    rows = v.scores.select("*", k.alias("k"), F.max("llr").over(whole).alias("top"), F.sum("llr").over(whole).alias("total"), F.count("*").over(whole).alias("n"))
    mu = F.when(F.col("k") == 1, F.try_divide(F.col("total") - F.col("llr"), F.col("n") - 1)).otherwise(F.try_divide(F.col("total") - F.col("llr") - F.col("top"), F.col("n") - 2))
    return rows.select("client", "segment", r(mu).alias("mu"))


@query("score_weight_logistic", "", "SELECT client, segment, round(1 / (1 + exp(-(llr - 250) / 50)) + 3e-8, 6) AS weight FROM scores")
def _(v):
    return v.scores.select("client", "segment", r(1 / (1 + F.exp(-(F.col("llr") - 250) / 50))).alias("weight"))


@query("score_impostor_filter", "FIL-09", "SELECT client, segment, round(llr + 3e-8, 6) AS llr FROM scores WHERE client IN (SELECT min(event_type) FROM events)")
def _(v):
    return v.scores.join(F.broadcast(v.table("events").agg(F.min("event_type").alias("client"))), "client", "left_semi").select("client", "segment", r("llr").alias("llr"))


@query(
    "score_crossed_matrix",
    "SCO-14 DIA-07",
    "SELECT a.client AS model, b.client AS file, round(avg(a.llr - b.llr) + 3e-8, 6) AS llr FROM scores a JOIN scores b USING (segment) GROUP BY 1, 2",
)
def _(v):
    a = v.scores.select("segment", F.col("client").alias("model"), F.col("llr").alias("a"))
    b = v.scores.select("segment", F.col("client").alias("file"), F.col("llr").alias("b"))
    return a.join(b, "segment").groupBy("model", "file").agg(r(F.avg(F.col("a") - F.col("b"))).alias("llr"))


@query("score_short_line", "SRC-12 SRC-13", "SELECT concat_ws(' ', gender, client, CASE WHEN llr >= 250 THEN '1' ELSE '0' END, segment::VARCHAR, round(llr * 1000)::BIGINT::VARCHAR) AS line FROM scores")
def _(v):
    return v.scores_in_order.select(F.concat_ws(" ", "gender", "client", (F.col("llr") >= 250).cast("int").cast("string"), F.col("segment").cast("string"), F.round(F.col("llr") * 1000).cast("long").cast("string")).alias("line"))


@query("score_running_mean", "ONL-07", "SELECT client, segment, round(avg(llr) OVER (PARTITION BY client ORDER BY segment) + 3e-8, 6) AS llr FROM scores")
def _(v):
    return v.scores.select("client", "segment", r(F.avg("llr").over(Window.partitionBy("client").orderBy("segment"))).alias("llr"))


@query(
    "score_online_znorm",
    "POST-15",
    """, h AS (SELECT client, segment, llr, avg(llr) OVER w AS mu, stddev_pop(llr) OVER w AS sigma FROM scores WINDOW w AS (PARTITION BY client ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT client, segment, round((llr - mu) / CASE WHEN sigma > 1e-9 THEN sigma END + 3e-8, 6) AS llr FROM h""",
)
def _(v):
    """A client's score by the mean and deviation of the scores it had before; null until those differ."""
    before = Window.partitionBy("client").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    h = v.scores.select("client", "segment", "llr", F.avg("llr").over(before).alias("mu"), F.stddev_pop("llr").over(before).alias("sigma"))
    return h.select("client", "segment", r((F.col("llr") - F.col("mu")) / F.when(F.col("sigma") > 1e-9, F.col("sigma"))).alias("llr"))


def nearest_cohort(rows: DataFrame, k: int) -> DataFrame:
    """(client, cohort): the k other clients with the nearest mean score. Clients are models, so few; ties by name."""
    means = rows.groupBy("client").agg(F.avg("llr").alias("m"))
    other = means.select(F.col("client").alias("cohort"), F.col("m").alias("c_m"))
    near = Window.partitionBy("client").orderBy(F.abs(F.col("m") - F.col("c_m")), "cohort")
    pairs = means.join(other, F.col("client") != F.col("cohort")).withColumn("k", F.row_number().over(near))
    return pairs.where(F.col("k") <= k).select("client", "cohort")


@query(
    "score_adapted_tnorm",
    "POST-15 TOP-05",
    """, m AS (SELECT client, avg(llr) AS m FROM scores GROUP BY client), k AS (SELECT a.client, b.client AS cohort, row_number() OVER (PARTITION BY a.client ORDER BY abs(a.m - b.m), b.client) AS k FROM m a JOIN m b ON a.client <> b.client),
    t AS (SELECT k.client, c.segment, avg(c.llr) AS mu, stddev_pop(c.llr) AS sigma FROM k JOIN scores c ON c.client = k.cohort WHERE k.k <= 3 GROUP BY 1, 2)
    SELECT s.client, s.segment, round((s.llr - t.mu) / CASE WHEN t.sigma > 1e-9 THEN t.sigma END + 3e-8, 6) AS llr FROM scores s JOIN t USING (client, segment)""",
)
def _(v):
    """T-norm whose cohort is chosen for each client: the three nearest."""
    cohort = v.scores.select(F.col("client").alias("cohort"), "segment", F.col("llr").alias("c_llr"))
    t = nearest_cohort(v.scores, 3).join(cohort, "cohort").groupBy("client", "segment").agg(F.avg("c_llr").alias("mu"), F.stddev_pop("c_llr").alias("sigma"))
    return v.scores.join(t, ["client", "segment"]).select("client", "segment", r((F.col("llr") - F.col("mu")) / F.when(F.col("sigma") > 1e-9, F.col("sigma"))).alias("llr"))


@query("score_lookup", "JOI-09", ", other AS (SELECT event_type AS client, user_id AS segment, max(value) AS llr FROM events WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY 1, 2) SELECT s.client, s.segment, round(o.llr + 3e-8, 6) AS llr FROM scores s LEFT JOIN other o USING (client, segment)")
def _(v):
    """Scores of another system's file by trial; null where that system has none."""
    events = v.table("events")
    known = events.join(F.broadcast(events.agg(F.min("event_type").alias("none"))), F.col("event_type") != F.col("none"))
    other = known.groupBy(F.col("event_type").alias("client"), F.col("user_id").alias("segment")).agg(F.max("value").alias("other"))
    return v.scores.join(other, ["client", "segment"], "left").select("client", "segment", r("other").alias("llr"))


@query("score_nearest_target", "ONL-04", "SELECT client, segment, other FROM (SELECT a.client, a.segment, b.client AS other, row_number() OVER (PARTITION BY a.client, a.segment ORDER BY abs(a.llr - b.llr), b.client) AS k FROM scores a JOIN scores b ON a.segment = b.segment AND a.client <> b.client) WHERE k = 1")
def _(v):
    """The other target whose score of the same segment is nearest: a neighbour in order of scores."""
    rows = v.scores_in_order.select("client", "segment", "llr").where("client is not null and segment is not null")
    # Equal scores are nearest, the least name first; else the neighbour below (its least name) or above.
    same = Window.partitionBy("segment", "llr").orderBy("client").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("first", F.first("client").over(same)).withColumn("second", F.nth_value("client", 2).over(same))
    level = rows.where("llr is not null").select("segment", "llr", F.col("first").alias("name")).distinct()
    around = Window.partitionBy("segment").orderBy("llr")
    beyond = [f("llr", 2).over(around).alias(f"{n}_2") for n, f in (("low", F.lag), ("high", F.lead))]
    level = level.select("segment", "llr", *[f(c).over(around).alias(f"{n}_{c}") for n, f in (("low", F.lag), ("high", F.lead)) for c in ("llr", "name")], *beyond)
    down, up = F.col("llr") - F.col("low_llr"), F.col("high_llr") - F.col("llr")
    below = F.col("high_name").isNull() | (down < up) | ((down == up) & (F.col("low_name") < F.col("high_name")))
    beside = F.when(F.col("low_name").isNotNull() & below, F.col("low_name")).otherwise(F.col("high_name"))
    twin = F.when(F.col("llr").isNotNull(), F.when(F.col("client") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    # Two levels on one side can be equally far once the difference is rounded; only then the name decides between them.
    level_off = F.coalesce(F.col("llr") - F.col("low_2") == down, F.lit(False)) | F.coalesce(F.col("high_2") - F.col("llr") == up, F.lit(False))
    found = rows.join(level, ["segment", "llr"], "left").select("client", "segment", "llr", F.coalesce(twin, F.when(~level_off, beside)).alias("other"))
    b = rows.select("segment", F.col("client").alias("b_client"), F.col("llr").alias("b_llr"))
    apart = F.abs(F.col("llr") - F.col("b_llr"))
    held = found.where("other is null").join(b, "segment").where("client <> b_client")
    rest = held.groupBy("client", "segment").agg(F.min(F.struct(apart.isNull(), apart, "b_client"))["b_client"].alias("other"))
    return found.where("other is not null").select("client", "segment", "other").unionByName(rest)


@query("iteration_schedule", "SCA-18", "SELECT i::INT AS round, round(0.5 + (0.01 - 0.5) * i / 9.0 + 3e-8, 6) AS value FROM range(0, 10) t(i)")
def _(v):
    """A parameter that goes from 0.5 to 0.01 in ten rounds, a straight line."""
    return v.spark.range(0, 10).select(F.col("id").cast("int").alias("round"), r(0.5 + (0.01 - 0.5) * F.col("id") / 9.0).alias("value"))


def density(x: Column, mu: Column, var: Column) -> Column:
    """Log density of a Gaussian."""
    return -0.5 * (F.ln(2 * math.pi * var) + (x - mu) * (x - mu) / var)


@query(
    "score_by_label",
    "SCO-02 JOI-02 AGG-09",
    """, f AS (SELECT source, source % 5 AS client, event_type AS label, x FROM frames), world AS (SELECT avg(x) AS mu, var_pop(x) AS var FROM frames),
    own AS (SELECT client, avg(x) AS mu, var_pop(x) AS var FROM f WHERE source % 2 = 0 GROUP BY client), lab AS (SELECT client, label, avg(x) AS mu, var_pop(x) AS var FROM f WHERE source % 2 = 0 GROUP BY client, label HAVING count(*) >= 2 AND var_pop(x) > 0),
    llr AS (SELECT o.client, f.source, f.label, avg(-0.5 * (ln(2 * pi() * coalesce(l.var, o.var)) + (f.x - coalesce(l.mu, o.mu)) ** 2 / coalesce(l.var, o.var)) + 0.5 * (ln(2 * pi() * w.var) + (f.x - w.mu) ** 2 / w.var)) AS llr FROM f CROSS JOIN own o CROSS JOIN world w LEFT JOIN lab l ON l.client = o.client AND l.label = f.label WHERE f.source % 2 = 1 GROUP BY 1, 2, 3),
    n AS (SELECT source, label, count(*) AS n FROM segments GROUP BY 1, 2) SELECT client, source, round(sum(llr * n) / sum(n) + 3e-8, 6) AS llr FROM llr JOIN n USING (source, label) GROUP BY 1, 2""",
)
def _(v):
    """A model for each client and label, the client's own where that lacks; labels weigh by their segments.

    A label's sums of x and x * x give the mean log density under any Gaussian, so frames meet no model.
    """
    f = v.frames.select("source", (F.col("source") % 5).alias("client"), F.col("event_type").alias("label"), "x")
    train, n = f.where("source % 2 = 0"), v.segments.groupBy("source", "label").agg(F.count("*").alias("n"))
    model = lambda *by: train.groupBy(*by).agg(F.avg("x").alias("_".join(("mu", *by))), F.var_pop("x").alias("_".join(("var", *by))), F.count("*").alias("count"))
    labelled = model("client", "label").where("count >= 2 and var_client_label > 0").drop("count")
    world = f.agg(F.avg("x").alias("w_mu"), F.var_pop("x").alias("w_var"))
    tests = f.where("source % 2 = 1").groupBy("source", "label").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("s"))
    rows = tests.join(n, ["source", "label"]).crossJoin(F.broadcast(model("client").drop("count"))).crossJoin(F.broadcast(world)).join(F.broadcast(labelled), ["client", "label"], "left")
    mean = lambda mu, var: -0.5 * (F.ln(2 * math.pi * var) + (F.col("s") - 2 * mu * F.col("m") + mu * mu) / var)
    llr = mean(F.coalesce("mu_client_label", "mu_client"), F.coalesce("var_client_label", "var_client")) - mean(F.col("w_mu"), F.col("w_var"))
    return rows.groupBy("client", "source").agg(r(F.sum(llr * F.col("n")) / F.sum("n")).alias("llr"))


@query(
    "score_weighted_llr",
    "SCO-13",
    """, w AS (SELECT avg(x) AS mu, var_pop(x) AS var FROM frames), c AS (SELECT event_type AS client, avg(x) AS mu, var_pop(x) AS var FROM frames WHERE source % 2 = 0 GROUP BY 1),
    l AS (SELECT f.source AS segment, c.client, f.x, -0.5 * (ln(2 * pi() * c.var) + (f.x - c.mu) ** 2 / c.var) + 0.5 * (ln(2 * pi() * w.var) + (f.x - w.mu) ** 2 / w.var) AS llr FROM frames f, c, w)
    SELECT segment, client, round(avg(llr) + 3e-8, 6) AS basic, round(sum(x * llr) / sum(x) + 3e-8, 6) AS weighted FROM l GROUP BY 1, 2""",
)
def _(v):
    """Mean log likelihood ratio of a client's Gaussian against the world's, plain and weighted by frame; clients are few."""
    world = v.frames.agg(F.avg("x").alias("w_mu"), F.var_pop("x").alias("w_var"))
    clients = v.frames.where("source % 2 = 0").groupBy(F.col("event_type").alias("client")).agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"))
    rows = v.frames.select(F.col("source").alias("segment"), "x").crossJoin(F.broadcast(clients)).crossJoin(F.broadcast(world))
    rows = rows.withColumn("llr", density(F.col("x"), F.col("mu"), F.col("var")) - density(F.col("x"), F.col("w_mu"), F.col("w_var")))
    return rows.groupBy("segment", "client").agg(r(F.avg("llr")).alias("basic"), r(F.sum(F.col("x") * F.col("llr")) / F.sum("x")).alias("weighted"))
