"""Warping in the far tails, where a bin holds 2e-7 of the mass."""

from fractions import Fraction

import duckdb
import numpy as np

from segspark.catalog import ORACLE_SQL, QUERIES
from segspark.operators import warping

SF = "/root/testdata/sf0.1"


def test_tail_of_the_normal_keeps_its_digits():
    raw, target = warping.Histogram(np.arange(5.0), np.array([0.25, 0.25, 0.25, 0.25])), warping.gaussian()
    x = np.array([3.97, 3.98, 3.99, 4.0])
    area = Fraction(target.area[-1])
    want = [Fraction(49, 10) + Fraction(1, 10) * (Fraction(1, 100) + Fraction(v) / 4 - 1 + area) / area for v in x]
    got = warping.warp(x, raw, target, 0.02)
    assert max(abs(float(Fraction(g) - w)) for g, w in zip(got.tolist(), want, strict=True)) < 1e-8


def test_score_warp_equals_its_sql_on_more_rows(spark):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL["score_warp"])
    columns = [c[0] for c in want.description]
    got = QUERIES["score_warp"](spark, SF).collect()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want.fetchall())
