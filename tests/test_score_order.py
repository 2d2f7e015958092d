"""Queries whose result hangs on the last bit of a mean, against their SQL on one thread."""

import random

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from segspark.catalog import ORACLE_SQL, QUERIES


def events(path, parts):
    """Tables of events (user, type, value) in files of their own; event ids rise from file to file."""
    start = 0
    (path / "events.parquet").mkdir(parents=True)
    for k, rows in enumerate(parts):
        ids = range(start, start + len(rows))
        start += len(rows)
        columns = {"event_id": pa.array(ids, pa.int64()), "ts": pa.array([pd.Timestamp(2024, 1, 1) + pd.Timedelta(seconds=i) for i in ids], pa.timestamp("us")), "user_id": pa.array([r[0] for r in rows], pa.int64()), "event_type": pa.array([r[1] for r in rows], pa.string()), "value": pa.array([r[2] for r in rows], pa.float64()), "props": pa.array(["{}"] * len(rows))}
        pq.write_table(pa.table(columns), path / "events.parquet" / f"part-{k}.parquet")


def both(spark, path, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    con.execute("CREATE VIEW embeddings AS SELECT 0 AS vec_id, 0 AS label, [0.0] AS embedding")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    return sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, f"file://{path}").collect()), sorted(want.fetchall())


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Means of four and eight values, many of them half a thousandth, each over two files."""
    draw, path = random.Random(5), tmp_path_factory.mktemp("halves")
    groups = [(user, kind, n) for user in range(300) for kind, n in (("click", 4), ("view", 8))]
    events(path, [[(u, k, draw.randrange(1, 50000) / 100) for u, k, n in groups for _ in range(n // 2)] for _ in range(2)])
    return path


def test_nearest_target_at_equal_rounded_distance_and_without_scores(spark, tmp_path):
    # From 100 both others are 99 away once that is rounded; a target without values is farther than any other.
    odd = [(1, "a", 100.0), (1, "c", 1.0000000000000002), (1, "b", 1.0), (2, "a", 5.0), (2, "b", None), (3, "a", None), (3, "b", 4.0), (3, "c", None), (4, "a", 1.0)]
    events(tmp_path, [odd])
    got, want = both(spark, tmp_path, "score_nearest_target")
    assert got == want
    assert ("a", 1, "b") in got and ("a", 2, "b") in got and len(got) == 8


def test_nearest_target_where_the_sums_decide(spark, tmp_path):
    # 0.1 + 0.2 + 0.3 is above 0.6 if summed in order, and equal to it if 0.2 and 0.3 are summed first.
    first = [(u, "a", 0.1) for u in range(9)]
    rest = [r for u in range(9) for r in ((u, "a", 0.2), (u, "a", 0.3), (u, "b", 0.4), (u, "c", 0.0))]
    events(tmp_path, [first, rest])
    got, want = both(spark, tmp_path, "score_nearest_target")
    assert got == want


def test_nist_lines_of_halves(spark, halves):
    got, want = both(spark, halves, "score_nist_format")
    assert len(got) == 600 and got == want


def test_short_lines_of_halves(spark, halves):
    got, want = both(spark, halves, "score_short_line")
    assert len(got) == 600 and got == want
