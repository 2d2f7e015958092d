"""Canonical tables over the driver's: vectors, models, components, frames, scores, segments, symbols, trials.

Each is a lazy DataFrame; PRELUDE has the same definitions as common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRELUDE = """WITH
vectors AS (SELECT vec_id, label, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
models AS (SELECT label, pos, avg(x) AS x FROM vectors WHERE vec_id % 2 = 0 GROUP BY label, pos),
comps AS (SELECT label AS comp, pos, avg(x) AS mu, var_pop(x) AS var, count(*) * 1.0 / (SELECT count(*) FROM embeddings) AS weight FROM vectors GROUP BY label, pos),
frames AS (SELECT user_id AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value AS x, event_type, event_id FROM events),
scores AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender, event_type AS client, user_id AS segment, avg(value) AS llr FROM events GROUP BY user_id, event_type),
islands AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY source, event_type ORDER BY frame_idx) AS island FROM frames),
segments AS (SELECT source, min(frame_idx) AS "begin", count(*) AS length, event_type AS label FROM islands GROUP BY source, event_type, island),
highs AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY source ORDER BY frame_idx) AS island FROM frames WHERE x > 50),
segments_b AS (SELECT source, min(frame_idx) AS "begin", count(*) AS length FROM highs GROUP BY source, island),
symbols AS (SELECT source, frame_idx AS pos, dense_rank() OVER (ORDER BY event_type) - 1 AS sym FROM frames),
trials AS (SELECT l.label AS model, e.vec_id AS segment FROM (SELECT DISTINCT label FROM embeddings) l, embeddings e WHERE e.vec_id % 2 = 1)
"""


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.embeddings.select("vec_id", "label", F.posexplode("v").alias("pos", "x"))

    @cached_property
    def models(self) -> DataFrame:
        return self.vectors.where("vec_id % 2 = 0").groupBy("label", "pos").agg(F.avg("x").alias("x"))

    @cached_property
    def comps(self) -> DataFrame:
        total = self.table("embeddings").agg(F.count("*").alias("total"))
        rows = self.vectors.groupBy(F.col("label").alias("comp"), "pos").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"), F.count("*").alias("n"))
        return rows.crossJoin(F.broadcast(total)).withColumn("weight", F.col("n") / F.col("total")).drop("n", "total")

    @cached_property
    def frames(self) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        rows = self.table("events").select("user_id", "ts", "event_id", "event_type", "value")
        return rows.select(F.col("user_id").alias("source"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), F.col("value").alias("x"), "event_type", "event_id")

    @cached_property
    def scores(self) -> DataFrame:
        rows = self.table("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("llr"))
        return rows.select(F.when(F.col("user_id") % 2 == 0, "F").otherwise("M").alias("gender"), F.col("event_type").alias("client"), F.col("user_id").alias("segment"), "llr")

    @cached_property
    def scores_in_order(self) -> DataFrame:
        """scores, their means summed one event after the other, as SQL does on one thread.

        Sums of parts differ from that in the last bit, by how the rows are split; where a half is
        rounded, equal distances are told apart or a score meets the edge of a bin, this bit decides. It costs a sort of all events.
        """
        order = Window.partitionBy("user_id", "event_type").orderBy("event_id", "ts", "value")
        upto = F.avg("value").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = self.table("events").select("user_id", "event_type", upto.alias("llr"), F.lead(F.lit(True)).over(order).alias("more")).where("more is null")
        return rows.select(F.when(F.col("user_id") % 2 == 0, "F").otherwise("M").alias("gender"), F.col("event_type").alias("client"), F.col("user_id").alias("segment"), "llr")

    @cached_property
    def segments(self) -> DataFrame:
        from segspark.operators.segments import runs

        return runs(self.frames, "event_type").withColumnRenamed("event_type", "label")

    @cached_property
    def segments_b(self) -> DataFrame:
        from segspark.operators.segments import selected_runs

        return selected_runs(self.frames, F.col("x") > 50)

    @cached_property
    def symbols(self) -> DataFrame:
        names = self.table("events").select("event_type").distinct()
        codes = names.withColumn("sym", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("long"))
        return self.frames.join(F.broadcast(codes), "event_type").select("source", F.col("frame_idx").alias("pos"), "sym")

    @cached_property
    def trials(self) -> DataFrame:
        """Models x test segments: the stated trial list, a small set of models against every segment."""
        models = self.embeddings.select(F.col("label").alias("model")).distinct()
        return self.embeddings.where("vec_id % 2 = 1").select(F.col("vec_id").alias("segment"), "v").crossJoin(F.broadcast(models)).select("model", "segment")
