"""Registered queries against their SQL on the smallest tables, and the driver's contract."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = ["i1_silent_national", "i3_reporting_rate_national", "j9_nearest_prior", "a39_effort_build", "k1_merge_partitions", "j25_reference_checks", "a14_free_text_bands"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 120


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 24 and "kind" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries()[name](spark, SF)
    rel = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    norm = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None else str(v)
    mine = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(norm(v) for v in row) for row in rel.project(", ".join(f'"{c}"' for c in order)).fetchall()), key=repr)
    assert mine == theirs
