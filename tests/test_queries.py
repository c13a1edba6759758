"""A few queries against their SQL; the driver compares all of them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def test_names_and_columns_are_registered():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90


@pytest.mark.parametrize("name", ["f1_read_pairs", "f9_read_report", "p3_cumulative_counts", "p9_scaffold_info", "v4_snvs", "r3_runtimes", "q1_contig_coverage"])
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(want.columns) == cols
    show = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) and v == v else None if v is None or v != v else v for v in r]) for r in rows)
    got = df.select(cols).toPandas()
    assert show(got[cols].astype(object).itertuples(index=False, name=None)) == show(want[cols].astype(object).itertuples(index=False, name=None))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"scaffold", "coverage", "breadth"} <= set(df.columns)
