"""Every query with a SQL counterpart in a small set must agree with DuckDB on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
NAMES = ("patch_join", "unmatched_reason", "in_out_degree", "line_length", "nearest_join", "relation_cardinality", "gap_sessionize",
         "min_angle_successor", "plan_conflict_gate", "anchor_states", "rule_decision", "connected_components")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(str([r[c] for c in sorted(columns)]) for r in df.collect())
    want = sorted(str([dict(zip(columns, r))[c] for c in sorted(columns)]) for r in cursor.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["id", "reason"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_boundary_widths_of_every_lane(spark):
    rows = entry.queries()["boundary_pair_width"](spark, SF).collect()
    lanes = [r.p_partkey + 1 for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    assert sorted(r.lane_id for r in rows) == sorted(lanes)
