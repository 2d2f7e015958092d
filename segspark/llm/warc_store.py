"""Content-addressed WARC archive.

`write` keeps two tables in a shared folder: `payloads` holds each distinct payload once under its
SHA-256, `headers` holds one exact record header (WARC header and HTTP header) for each page with
the address of its payload. `reconstruct` joins them to the original record bytes, `read_back`
parses the headers, and verifies every stored payload against its address and length.

Edge cases: null html is an empty payload; a null url is an empty target; pages that share the
largest page_id of a payload are all responses; a null page_id is never the largest unless all are
null. Repeated rows give repeated headers and one payload. Empty table -> empty archive. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, scratch

#: Payloads shorter than this are stored once as well, but each record is a response.
REVISIT_FROM = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisits/identical-payload-digest"


def write(pages: DataFrame, path: str, date: str = DATE) -> str:
    prepare(pages.sparkSession)
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256)).withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    # Equal payloads meet in one row before the shuffle (group limit), so a hot payload moves once per task.
    newest = Window.partitionBy("address").orderBy(F.col("page_id").desc_nulls_last())
    once = rows.select("address", "length", "payload", "page_id").withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "page_id")
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")
    narrow = rows.select("page_id", "url", "address", "digest", "length")
    last = narrow.groupBy("address").agg(F.max("page_id").alias("newest"))
    joined = narrow.join(last, "address")
    revisit = (F.col("length") >= REVISIT_FROM) & ~F.col("page_id").eqNullSafe(F.col("newest"))
    kind = F.when(revisit, "revisit").otherwise("response")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length").cast("string"), F.lit("\r\n\r\n"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    size = F.octet_length("http") + F.when(F.col("record_type") == "response", F.col("length")).otherwise(0)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Refers-To", uri(F.col("newest"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )
    headers = joined.withColumn("record_type", kind).withColumn("http", http).withColumn("header", head)
    headers.select("page_id", "address", "header", "http").write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (binary): the exact bytes of each WARC record, payload included for responses."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    block = F.when(F.col("header").contains("WARC-Type: response\r\n"), F.col("payload")).otherwise(F.lit(b""))
    return headers.join(payloads, "address").select("page_id", F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the stored headers and payloads.

    Each stored payload is read and hashed once, whatever the number of records that point to it; a
    payload that does not match its address, length or header ends the job.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "address", (F.sha2("payload", 256) == F.col("address")).alias("sound"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")
    )
    field = lambda name, what: F.regexp_extract("header", rf"\r\n{name}: {what}\r\n", 1)
    headers = spark.read.parquet(f"{path}/headers").select(
        "page_id", "address", field("WARC-Type", "([a-z]+)").alias("record_type"), field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").alias("target"), field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("said")
    )
    joined = headers.join(payloads, "address", "left")
    good = F.coalesce(F.col("sound") & (F.col("said") == F.col("payload_digest")), F.lit(False))
    digest = F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("string"))
    return joined.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", F.when(F.col("target") != "", F.col("target").cast("long")).alias("refers_to"))


def digest(pages: DataFrame) -> DataFrame:
    """The rows of query op9."""
    spark = pages.sparkSession
    return read_back(spark, write(pages, scratch(spark, "warc")))
