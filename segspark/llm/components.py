"""Connected components of a link table by alternating large-star and small-star steps.

Each step moves a few bytes per link and is written to the shared folder, so lineage stays short
and a lost executor costs one step. A hub's links are dealt over as many tasks as the table has
PER_SALT links, SALTS at most; no neighbourhood is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

SALTS, PER_SALT = 32, 1 << 20


def _least(links: DataFrame, salts: int) -> DataFrame:
    """Links (u, v) with m, the least of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if salts == 1:
        return links.join(least, "u").select("u", "v", "m")
    spread = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(spread, ["u", "salt"]).select("u", "v", "m")


def components(links: DataFrame, most: int = 200) -> DataFrame:
    """links (a, b) of longs -> (node, root): the least node reachable from each node that has a link."""
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    count = links.count()
    for _ in range(most):
        before = links
        salts = min(SALTS, 1 + 2 * count // PER_SALT)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, salts).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large, salts)
        links = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.groupBy("u").agg(F.min("m").alias("v")))
        links = stored(links.where("u <> v").distinct(), "links")
        discard(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark, count = now, now[0]
    raise RuntimeError("components did not settle")
