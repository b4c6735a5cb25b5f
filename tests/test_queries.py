"""A quick cut of the registered queries against their SQL; tools/check.py runs them all."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from acopio.plans.bindings import TABLES
from tools.check import rows_of

BASE = "/root/testdata/sf0.001"
QUICK = ["match_key", "normalize_text", "numeric_code", "to_int_or_zero", "map_sex", "nullify_tokens", "nullify_counts", "trim_footer",
         "base_clean", "fact_admin", "outer_merge_nullsafe", "dim_collation_dedupe", "insert_ignore", "fk_semi", "fk_nullify",
         "detect_header_row", "detect_data_sheet", "variant_report", "upsert_by_year", "stream_new_files", "validate_constraints", "standardize"]

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, BASE)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, res.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
