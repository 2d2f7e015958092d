"""Segments (source, begin, length, label) as relations: runs, interval algebra, length rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.registry import query


def _order():
    return Window.partitionBy("source").orderBy("frame_idx")


def runs(frames: DataFrame, by: str) -> DataFrame:
    """Maximal runs of equal `by` over consecutive frames of a source."""
    new = F.coalesce((F.lag(by).over(_order()) != F.col(by)) | (F.lag("frame_idx").over(_order()) != F.col("frame_idx") - 1), F.lit(True))
    marked = frames.select("source", "frame_idx", by, new.cast("int").alias("new")).withColumn("run", F.sum("new").over(_order()))
    return marked.groupBy("source", "run", by).agg(F.min("frame_idx").alias("begin"), F.count("*").alias("length")).select("source", "begin", "length", by)


def selected_runs(frames: DataFrame, keep: Column) -> DataFrame:
    """Runs of consecutive frames that meet a predicate."""
    kept = frames.where(keep).select("source", "frame_idx").withColumn("island", F.col("frame_idx") - F.row_number().over(_order()))
    return kept.groupBy("source", "island").agg(F.min("frame_idx").alias("begin"), F.count("*").alias("length")).drop("island")


def merged(segments: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """Segments that touch or overlap (up to `gap` frames apart) within the keys become one."""
    order = Window.partitionBy(*by).orderBy("begin", "length")
    reach = F.max(F.col("begin") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = segments.withColumn("new", F.coalesce(F.col("begin") > reach + gap, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    end = F.max(F.col("begin") + F.col("length"))
    return marked.groupBy(*by, "run").agg(F.min("begin").alias("begin"), (end - F.min("begin")).alias("length")).drop("run")


def overlaps(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """Intersections of the segments of a and b of equal source; an interval meets only its own time bins."""
    bins = lambda df: F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("begin") + F.col("length") - 1) / width)))
    left = a.select("*", bins(a).alias("bin"))
    right = b.select("source", F.col("begin").alias("b_begin"), F.col("length").alias("b_length"), bins(b).alias("bin"))
    start = F.greatest("begin", "b_begin")
    end = F.least(F.col("begin") + F.col("length"), F.col("b_begin") + F.col("b_length"))
    both = left.join(right, ["source", "bin"]).withColumn("start", start).withColumn("end", end)
    return both.where((F.col("end") > F.col("start")) & (F.col("bin") == F.floor(F.col("start") / width))).drop("bin")


def gaps(segments: DataFrame, ends: DataFrame) -> DataFrame:
    """source, begin, length: what the segments leave free from frame 0 to each source's `end`."""
    covered = merged(segments.select("source", "begin", "length"), ["source"])
    order = Window.partitionBy("source").orderBy("begin")
    # A row of length 0 at the end closes each source, with segments or without.
    closed = covered.unionByName(ends.select("source", F.col("end").alias("begin"), F.lit(0).cast("long").alias("length")))
    begin = F.coalesce(F.max(F.col("begin") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = closed.select("source", begin.alias("from"), F.col("begin").alias("to"))
    return free.where("to > from").select("source", F.col("from").alias("begin"), (F.col("to") - F.col("from")).alias("length"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """The parts of a outside all segments of b: its overlaps with the gaps of b."""
    ends = a.groupBy("source").agg(F.max(F.col("begin") + F.col("length")).alias("end"))
    rest = [c for c in a.columns if c not in ("begin", "length")]
    return overlaps(a, gaps(b, ends)).select(*rest, F.col("start").alias("begin"), (F.col("end") - F.col("start")).alias("length"))


def pieces(segments: DataFrame, size: int) -> DataFrame:
    """Segments cut to pieces of `size` frames; the last may be shorter."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    rest = [c for c in segments.columns if c not in ("begin", "length")]
    return segments.select(*rest, "begin", "length", at.alias("at")).select(*rest, (F.col("begin") + F.col("at")).alias("begin"), F.least(F.lit(size).cast("long"), F.col("length") - F.col("at")).alias("length"))


def frames_in(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames with the segment that holds them: an interval join as an equi-join on exploded frames."""
    held = segments.select("*", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("length") - 1)).alias("frame_idx"))
    return frames.join(held, ["source", "frame_idx"])


def time_to_frame(seconds: Column, step: float = 0.01) -> Column:
    """Whole frames of a time; one more if less than 1e-5 of a frame is missing."""
    whole = F.floor(seconds / step)
    return (whole + F.when(seconds / step - whole > 0.99999, 1).otherwise(0)).cast("long")


def frame_to_time(frame: Column, step: float = 0.01) -> Column:
    """Seconds, cut to milliseconds."""
    return F.floor(F.round(frame * F.lit(1000.0 * step), 6)) / 1000.0


@query("segment_runs", "SRC-24 WIN-15 WIN-16", 'SELECT source, "begin", length, label FROM segments')
def _(v):
    return v.segments.select("source", "begin", "length", "label")


@query("segment_energy_runs", "FIL-04", 'SELECT source, "begin", length FROM segments_b')
def _(v):
    return v.segments_b


@query("segment_end_frame", "WIN-01 SCA-02 SRC-13", 'SELECT source, "begin", "begin" + length - 1 AS last, floor(round("begin" * 10.0, 6)) / 1000.0 AS begin_s, floor(round(("begin" + length) * 10.0, 6)) / 1000.0 AS end_s FROM segments')
def _(v):
    s = v.segments
    return s.select("source", "begin", (F.col("begin") + F.col("length") - 1).alias("last"), frame_to_time(F.col("begin")).alias("begin_s"), frame_to_time(F.col("begin") + F.col("length")).alias("end_s"))


@query("segment_time_to_frame", "SCA-01 SRC-04", "SELECT event_id, (floor(value / 0.01) + CASE WHEN value / 0.01 - floor(value / 0.01) > 0.99999 THEN 1 ELSE 0 END)::BIGINT AS frame FROM events")
def _(v):
    return v.table("events").select("event_id", time_to_frame(F.col("value")).alias("frame"))


@query("segment_interval_join", "JOI-04 FIL-01", 'SELECT f.source, f.frame_idx, f.x, s.label FROM frames f JOIN segments s ON f.source = s.source AND f.frame_idx >= s."begin" AND f.frame_idx < s."begin" + s.length WHERE s.length >= 2')
def _(v):
    return frames_in(v.frames.select("source", "frame_idx", "x"), v.segments.where("length >= 2")).select("source", "frame_idx", "x", "label")


@query(
    "segment_overlap",
    "JOI-04 WIN-11",
    'SELECT a.source, a.label, greatest(a."begin", b."begin") AS start, least(a."begin" + a.length, b."begin" + b.length) AS "end" FROM segments a JOIN segments_b b ON a.source = b.source AND a."begin" < b."begin" + b.length AND b."begin" < a."begin" + a.length',
)
def _(v):
    return overlaps(v.segments, v.segments_b).select("source", "label", "start", "end")


@query(
    "segment_subtract",
    "WIN-06 WIN-11",
    """, outside AS (SELECT a.source, a."begin" AS a_begin, a.length AS a_length, a.label, f.frame_idx FROM segments a JOIN frames f ON a.source = f.source AND f.frame_idx >= a."begin" AND f.frame_idx < a."begin" + a.length WHERE f.x <= 50),
    marked AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY source, a_begin ORDER BY frame_idx) AS island FROM outside)
    SELECT source, label, min(frame_idx) AS "begin", count(*) AS length FROM marked GROUP BY source, label, a_begin, island""",
)
def _(v):
    return subtract(v.segments, v.segments_b).select("source", "label", "begin", "length")


@query("segment_merge_labels", "WIN-08 WIN-10", """, kept AS (SELECT * FROM frames WHERE event_type <> (SELECT min(event_type) FROM events)), m AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY source ORDER BY frame_idx) AS island FROM kept)
    SELECT source, min(frame_idx) AS "begin", count(*) AS length FROM m GROUP BY source, island""")
def _(v):
    none = v.table("events").agg(F.min("event_type").alias("none"))
    kept = v.segments.join(F.broadcast(none), F.col("label") != F.col("none")).select("source", "begin", "length")
    return merged(kept, ["source"])


@query("segment_rechop", "WIN-14 FIL-08", """SELECT source, label, "begin" + k * 2 AS "begin", least(2, length - k * 2) AS length FROM segments, LATERAL (SELECT unnest(range(0, (length + 1) // 2)) AS k)""")
def _(v):
    return pieces(v.segments, 2).select("source", "label", "begin", "length")


@query("segment_truncate", "FIL-02 FIL-07", 'SELECT s.source, s."begin", least(s.length, c.n // 2 - s."begin") AS length FROM segments s JOIN (SELECT source, count(*) AS n FROM frames GROUP BY source) c ON s.source = c.source WHERE s."begin" < c.n // 2')
def _(v):
    limit = v.frames.groupBy("source").agg(F.expr("count(*) div 2").alias("n"))
    return v.segments.join(limit, "source").where("begin < n").select("source", "begin", F.least("length", F.col("n") - F.col("begin")).alias("length"))


@query("segment_clamp", "FIL-07", 'SELECT source, "begin", greatest(2, least(3, length)) AS length FROM segments')
def _(v):
    return v.segments.select("source", "begin", F.greatest(F.lit(2), F.least(F.lit(3), "length")).cast("long").alias("length"))


@query("segment_duration", "AGG-03 AGG-04", "SELECT label, sum(length)::BIGINT AS frames, round(sum(length) * 0.01 + 3e-8, 6) AS seconds, count(*) AS n FROM segments GROUP BY label")
def _(v):
    return v.segments.groupBy("label").agg(F.sum("length").alias("frames"), F.round(F.sum("length") * 0.01 + 3e-8, 6).alias("seconds"), F.count("*").alias("n"))


@query(
    "segment_length_rule",
    "WIN-09 DIA-17",
    """, s AS (SELECT source, "begin", length, label, last_value(CASE WHEN length > 1 THEN label END IGNORE NULLS) OVER (PARTITION BY source ORDER BY "begin") AS kept FROM segments)
    SELECT source, "begin", length, coalesce(kept, label) AS label FROM s""",
)
def _(v):
    order = Window.partitionBy("source").orderBy("begin")
    long_label = F.last(F.when(F.col("length") > 1, F.col("label")), ignorenulls=True).over(order)
    return v.segments.select("source", "begin", "length", F.coalesce(long_label, "label").alias("label"))


@query("segment_longest", "FIL-14 WIN-16", 'SELECT source, "begin", length, label FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length DESC, "begin") AS n FROM segments) WHERE n = 1')
def _(v):
    best = F.max_by(F.struct("begin", "length", "label"), F.struct(F.col("length"), -F.col("begin"))).alias("s")
    return v.segments.groupBy("source").agg(best).select("source", "s.begin", "s.length", "s.label")


@query("segment_equality", "DIA-14", 'SELECT count(*) AS rows_a, (SELECT count(*) FROM (SELECT source, "begin", length FROM segments EXCEPT SELECT source, "begin", length FROM segments_b)) AS only_a FROM segments')
def _(v):
    a, b = v.segments.select("source", "begin", "length"), v.segments_b
    return a.agg(F.count("*").alias("rows_a")).crossJoin(F.broadcast(a.subtract(b).agg(F.count("*").alias("only_a"))))


@query("segment_drop_empty", "DIA-15", "SELECT source, label, sum(length)::BIGINT AS frames FROM segments GROUP BY source, label HAVING sum(length) >= 3")
def _(v):
    return v.segments.groupBy("source", "label").agg(F.sum("length").alias("frames")).where("frames >= 3")


@query("segment_prefix_sum", "SCA-19 FIL-13", 'SELECT source, "begin", length, (sum(length) OVER (PARTITION BY source ORDER BY "begin") - length)::BIGINT AS before FROM segments')
def _(v):
    order = Window.partitionBy("source").orderBy("begin")
    return v.segments.select("source", "begin", "length", (F.sum("length").over(order) - F.col("length")).alias("before"))


@query(
    "segment_compare",
    "WIN-17 AGG-03",
    """, s AS (SELECT f.source, f.x > 50 AS high, f.event_type FROM frames f) SELECT source, count(*) AS frames, count(*) FILTER (high) AS reference, count(*) FILTER (event_type = (SELECT min(event_type) FROM events)) AS found, count(*) FILTER (high AND event_type = (SELECT min(event_type) FROM events)) AS agreed FROM s GROUP BY source""",
)
def _(v):
    """Frames of a recording, those of a reference segmentation, of a found one, and of both."""
    first = v.table("events").agg(F.min("event_type").alias("label"))
    found = v.segments.join(F.broadcast(first), "label").select("source", "begin", "length")
    total = lambda df, name: df.groupBy("source").agg(F.sum("length").alias(name))
    agreed = overlaps(found, v.segments_b).select("source", (F.col("end") - F.col("start")).alias("length"))
    rows = total(v.segments, "frames")
    for part, name in ((v.segments_b, "reference"), (found, "found"), (agreed, "agreed")):
        rows = rows.join(total(part, name), "source", "left")
    return rows.select("source", "frames", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reference", "found", "agreed")])
