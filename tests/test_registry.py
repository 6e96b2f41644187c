"""Registered queries against their SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["s05_basin_salinity", "s18_basin_named", "k09_not_exists_anti", "q_clean", "q_reject_summary", "c_split", "c_split_spread",
         "v_batch_knn", "v_prefilter_pre", "v_mmr", "g_radius_join_topk", "p_histogram", "x_sql_audit_word", "st_ingest"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_rows_agree(spark, con, name):
    ok, message, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, message


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["chunk_id", "text"] and df.count() > 0
