"""The queries of this subpackage, each an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, gif, html_extract, langid, license_scan, pii, sharding, simhash, warc_store
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, digest: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: digest(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": _over("pages", html_extract.digest),
    "op2_bpe_coding": _over("documents", bpe.digest),
    "op3_pii": _over("documents", pii.digest),
    "op4_language_id": _over("documents", langid.digest),
    "op5_sharding": _over("documents", sharding.digest),
    "op6_decontamination": lambda spark, sf_dir: decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op7_license_scan": _over("documents", license_scan.digest),
    "op8_gif_media": _over("documents", gif.digest),
    "op9_warc_archive": _over("pages", warc_store.digest),
    "op10_simhash": _over("documents", simhash.digest),
}

#: The others can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op9_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             q AS (SELECT page_id, h, octet_length(encode(h))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
        SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
        FROM q
    """,
}
