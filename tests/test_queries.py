"""Registered queries against their SQL on the smallest tables."""

import importlib
from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import compare

SF = "/root/testdata/sf0.001"
# One of each family; checks/compare.py runs them all.
SOME = [
    "flagship_daily_levels", "prs_5_parse_single_line", "prs_6_parse_multi_line", "win_3_message_range", "enr_1_normalize_timestamp",
    "enr_5_extract_entities", "enr_12_mask_domain", "snk_1_merge_daily", "snk_7_prepare_documents", "agg_5_cluster_quality",
    "min_1_first_match_exact", "joi_2_classify_by_template", "joi_5_classify_by_cluster_regex", "tpl_4_representative", "tpl_5_silhouette",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, name):
    ok, detail = compare(entry.queries()[name](spark, SF), entry.oracle_sql()[name], SF)
    assert ok, detail


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100
    assert importlib.import_module("checks.parsing").QUERIES


def test_entry(spark):
    assert entry.entry(spark).count() > 0
