"""Text formats as tables: ragged lists, label files, score lines, matrices; readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.operators.segments import time_to_frame
from segspark.registry import query

#: Place of gender, client, segment, decision and score in each score format.
FIELDS = {"short": {"gender": 0, "client": 1, "decision": 2, "segment": 3, "llr": 4}, "nist": {"gender": 3, "client": 4, "segment": 5, "decision": 6, "llr": 7}}


def ragged(lines: Column) -> Column:
    """(pos, element) of a whitespace-separated line; the first is the id."""
    return F.posexplode(F.split(F.trim(lines), r"\s+"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """id, member, pos of a list file: one line an entry, its id first."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    words = F.split(F.trim("value"), r"\s+")
    return rows.select(words[0].alias("id"), F.posexplode(F.slice(words, 2, F.size(words))).alias("pos", "member"))


def read_labels(spark: SparkSession, path: str, step: float = 0.01) -> DataFrame:
    """source (file name), begin, length, label; the end time is an inclusive frame."""
    return parse_labels(spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("source"), F.col("value").alias("line")), step)


def parse_labels(lines: DataFrame, step: float = 0.01) -> DataFrame:
    """source, begin, length, label of rows (source, line)."""
    rows = lines.where(F.trim("line") != "").select("source", F.split(F.trim("line"), r"\s+").alias("w"))
    begin, end = (time_to_frame(F.col("w")[i].cast("double"), step) for i in (0, 1))
    return rows.select("source", begin.alias("begin"), (end - begin + 1).alias("length"), F.col("w")[2].alias("label"))


def clusters(segments: DataFrame) -> DataFrame:
    """segments with `code`: labels numbered from 0 by their first segment in order of source and begin."""
    first = segments.groupBy("label").agg(F.min(F.struct("source", "begin")).alias("first"))
    # One row a label; the order over them all is one small sort.
    codes = first.select("label", (F.row_number().over(Window.orderBy("first", "label")) - 1).cast("long").alias("code"))
    return segments.join(codes, "label")


def parse_scores(lines: DataFrame, form: str, column: str = "line") -> DataFrame:
    """gender, client, segment, decision, llr of score lines of a format in FIELDS."""
    w = F.split(F.trim(column), r"\s+")
    return lines.select(*[(w[i].cast("double") if k == "llr" else w[i]).alias(k) for k, i in FIELDS[form].items()])


def snapshot(rows: DataFrame, path: str) -> DataFrame:
    """Statistics or models written as Parquet, for a later `restored`; returns what was written."""
    rows.write.mode("overwrite").parquet(path)
    return restored(rows.sparkSession, path, rows.schema)


def restored(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def sparse_line(v: Column) -> Column:
    """i:v pairs of the non-zero entries, counted from 1, values in thousandths."""
    pairs = F.transform(v, lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), F.round(x * 1000).cast("long").cast("string")))
    return F.concat_ws(" ", F.filter(pairs, lambda p: ~p.endswith(":0")))


@query("source_ragged_list", "SRC-02", ", l AS (SELECT label, string_agg(vec_id::VARCHAR, ' ' ORDER BY vec_id) AS line FROM embeddings GROUP BY label) SELECT label, unnest(range(0, len(string_split(line, ' ')))) AS pos, unnest(string_split(line, ' ')) AS element FROM l")
def _(v):
    lines = v.embeddings.groupBy("label").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string"))).alias("line"))
    return lines.select("label", ragged(F.col("line")).alias("pos", "element")).select("label", F.col("pos").cast("long").alias("pos"), "element")


@query("source_score_lines", "SRC-12 SRC-15 SRC-18", "SELECT gender, client, segment::VARCHAR AS segment, (llr >= 250)::INT::VARCHAR AS decision, round(llr * 1000)::BIGINT::DOUBLE AS llr FROM scores")
def _(v):
    s = v.scores
    line = F.concat_ws(" ", "gender", "client", (F.col("llr") >= 250).cast("int").cast("string"), F.col("segment").cast("string"), F.round(F.col("llr") * 1000).cast("long").cast("string"))
    return parse_scores(s.select(line.alias("line")), "short").select("gender", "client", "segment", "decision", "llr")


@query("source_sparse_lines", "SRC-19 SRC-25", "SELECT vec_id, string_agg((pos + 1)::VARCHAR || ':' || round(x * 1000)::BIGINT::VARCHAR, ' ' ORDER BY pos) AS line FROM vectors WHERE round(x * 1000)::BIGINT <> 0 GROUP BY vec_id")
def _(v):
    return v.embeddings.select("vec_id", sparse_line(F.col("v")).alias("line"))


@query("source_matrix_ascii", "SRC-09 SRC-20", "SELECT vec_id, string_agg(round(x * 1000)::BIGINT::VARCHAR, ' ' ORDER BY pos) AS line FROM vectors GROUP BY vec_id")
def _(v):
    return v.embeddings.select("vec_id", F.concat_ws(" ", F.transform("v", lambda x: F.round(x * 1000).cast("long").cast("string"))).alias("line"))


@query("source_default_label", "SRC-05 JOI-02", ', d AS (SELECT user_id AS source, min(event_type) AS label FROM events WHERE user_id % 2 = 0 GROUP BY user_id) SELECT DISTINCT f.source, coalesce(d.label, \'default\') AS label FROM frames f LEFT JOIN d USING (source)')
def _(v):
    known = v.table("events").where("user_id % 2 = 0").groupBy(F.col("user_id").alias("source")).agg(F.min("event_type").alias("label"))
    return v.table("events").select(F.col("user_id").alias("source")).distinct().join(known, "source", "left").select("source", F.coalesce("label", F.lit("default")).alias("label"))


@query("source_speaker_index", "JOI-05 VEC-09", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS session FROM embeddings")
def _(v):
    from pyspark.sql import Window

    return v.embeddings.select("vec_id", "label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("session"))


@query("source_label_clusters", "SRC-06 SRC-07", ', f AS (SELECT label, min((source, "begin")) AS first FROM segments GROUP BY label), c AS (SELECT label, row_number() OVER (ORDER BY first, label) - 1 AS code FROM f) SELECT source, "begin", length, label, code FROM segments JOIN c USING (label)')
def _(v):
    """Label lines of many files, read into clusters that are made as their labels come up."""
    seconds = lambda c: F.format_string("%.2f", c / 100)
    line = F.concat_ws(" ", seconds(F.col("begin")), seconds(F.col("begin") + F.col("length") - 1), "label")
    return clusters(parse_labels(v.segments.select("source", line.alias("line")))).select("source", "begin", "length", "label", "code")
