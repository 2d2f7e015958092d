"""Corpus preparation in five stages, each over all that the one before kept.

language: documents in no known language go (llm.langid); dedup: one document of each group of near
duplicates stays, the row with the least doc_id (llm.simhash); decontaminate: documents that hold a
benchmark passage go (llm.decontaminate); pii: personal data becomes its kind in brackets
(llm.pii); tokens: texts become token ids (llm.bpe).

Dedup groups rows by their texts: rows that share a doc_id but not their text are documents of their own,
and so are rows without a doc_id, which stay only if no row of their group has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm import bpe, decontaminate, langid, pii, simhash
from segspark.llm.common import discard, free, remove, scratch, sieved, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = free(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    slim, groups = simhash.near_groups(keyed.select(F.col(row).alias("row"), "doc_id", "text"))
    kept = stored(groups.select(F.col("component_id.row").alias(row)).distinct(), "kept")
    # Only rows that go, or whose key is repeated, need the join: all other texts stay where they are.
    keys = slim.groupBy(F.col("row").alias(row)).agg(F.count("*").alias("count"))
    moved = stored(keys.join(kept.withColumn("kept", F.lit(True)), row, "left").where("kept is null or `count` > 1").select(row), "moved")
    discard(slim, groups)
    hit = free(keyed, "hit")
    split = sieved(keyed, moved, row, hit)
    judged = split.where(hit).join(kept, row, "left_semi").dropDuplicates([row])
    return split.where(~F.col(hit)).select(*docs.columns).unionByName(judged.select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("dedup", dedup),
    ("decontaminate", decontaminated),
    ("pii", private),
    ("tokens", tokens),
]

#: Language models, similarity and alignment aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = None
    for name, stage in STAGES:
        last, path = path, scratch(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            remove(spark, last)
    return docs
