"""What the operators share: table reading, the shared scratch folder, and worker set-up."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch.
BATCH_ROWS = 1024
#: Bits of the map that `sieved` broadcasts, whatever the number of keys: 8 MB.
SIEVE_BITS = 1 << 26
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed on them."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    # Whole texts are long: Spark's default batch of 10,000 rows would hold tens of MB in each process.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


_HELD: dict[str, Any] = {}


def held(key: str, build: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task: the last thing built, nothing before it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="segspark-")
        found = _OWN[app]
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes tables made by `stored` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def sieved(rows: DataFrame, keys: DataFrame, column: str, hit: str) -> DataFrame:
    """rows with a boolean `hit`, false only where `column` (a hash; never null) is in no row of keys.

    It spares a shuffle the rows that need no exact join; the more keys, the more other rows are
    hits too, so an exact join has to follow. Broadcasts SIEVE_BITS bits at most.
    """
    at = lambda c: F.pmod(F.col(c), F.lit(SIEVE_BITS))
    part, bits = free(rows, "sieve_part"), free(rows, "sieve_bits")
    maps = keys.groupBy(F.bitmap_bucket_number(at(column)).alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at(column))).alias(bits))
    place = F.bitmap_bit_position(at(column))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn(part, F.bitmap_bucket_number(at(column))).join(F.broadcast(maps), part, "left")
    return found.withColumn(hit, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop(part, bits)
