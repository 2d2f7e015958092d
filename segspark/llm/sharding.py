"""Sharding with sampled splitters.

Every row has a composite key (hash of its text, then its id), so equal texts are neighbours. A
size-weighted sample of keys gives quantile boundaries; rows are dealt to these ranges, and a range
that got more than twice its share is subdivided at boundaries sampled inside it. Running byte sums
over ranges, then within them, cut the key order into shards at equal byte positions.

Only (id, size, checksum, key) move; texts stay where they are.

Edge cases: a null text has size 8 and checksum 0; empty table -> empty result; repeated rows share
a key and keep separate slots; a null id sorts first among equal texts. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

#: Bytes that a row costs beside its text.
ROW_BYTES = 8
#: Sampled keys for each range.
OVERSAMPLE = 16


def keyed(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, size, text_crc32, key (32 hex digits, ordered)."""
    body = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    top = F.lit(-(2**63))
    part = lambda c: F.lpad(F.hex(c), 16, "0")
    order = F.coalesce(F.col("doc_id").cast("long").bitwiseXOR(top), F.lit(0))
    return docs.select(
        "doc_id",
        (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.concat(part(F.xxhash64(body)), part(order)).alias("key"),
    )


def sampled(rows: DataFrame, total: int, wanted: int, seed: int) -> list[str]:
    """About `wanted` keys, each row drawn with probability in proportion to its size."""
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chance = F.col("size") * F.lit(wanted / max(total, 1))
    return [r[0] for r in rows.where(draw < chance).select("key").collect()]


def splitters(keys: list[str], parts: int) -> list[str]:
    keys = sorted(keys)
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def dealt(rows: DataFrame, bounds: list[str]) -> DataFrame:
    """Adds `cell`: how many boundaries are at most the row's key."""
    edges = np.array(bounds, dtype="S32")

    @F.pandas_udf("int")
    def cell(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(dtype="S32"), side="right"))

    return rows.withColumn("cell", cell("key") if len(edges) else F.lit(0))


def shard(docs: DataFrame, shards: int = 24, rows_per_range: int = 200_000, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; shard sizes differ by about one row's bytes.

    The number of ranges follows the row count, so that a range always fits a task; the sample has
    OVERSAMPLE keys for each range and is the only thing that the driver collects besides sums.
    """
    prepare(docs.sparkSession)
    rows = stored(keyed(docs), "shard-keys")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(8 * shards, -(-count // rows_per_range))
    bounds = splitters(sampled(rows, total, ranges * OVERSAMPLE, seed), ranges)
    sums = lambda df: {r[0]: (r[1], r[2]) for r in df.groupBy("cell").agg(F.sum("size"), F.count("*")).collect()}
    cells = sums(dealt(rows, bounds))
    share = total / max(ranges, 1)
    heavy = [c for c, (size, _) in cells.items() if size > 2 * share]
    if heavy:
        edges = ["", *bounds, "g"]
        inside = dealt(rows, bounds).where(F.col("cell").isin(heavy))
        more = sorted(sampled(inside, total, 8 * ranges * OVERSAMPLE, seed + 1))
        for c in heavy:
            own = [k for k in more if edges[c] <= k < edges[c + 1]]
            bounds = sorted({*bounds, *splitters(own, 2 + int(cells[c][0] / share))})
        cells = sums(dealt(rows, bounds))
    at, nth, starts = 0, 0, []
    for c in sorted(cells):
        starts.append((c, at, nth))
        at, nth = at + cells[c][0], nth + cells[c][1]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(starts or [(0, 0, 0)], "cell int, cell_bytes long, cell_rows long")
    run = Window.partitionBy("cell").orderBy("key", "size", "text_crc32")
    placed = (
        dealt(rows, bounds)
        .withColumn("n", F.row_number().over(run))
        .withColumn("upto", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(offsets), "cell")
        .withColumn("nth", F.col("cell_rows") + F.col("n") - 1)
        .withColumn("middle", F.col("cell_bytes") + F.col("upto") - F.col("size") / 2)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(max(total, 1)))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "nth")
    )
    placed = stored(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op5."""
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
