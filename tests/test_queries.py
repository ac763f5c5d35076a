"""Every registered query against its SQL on the smallest tables, and facts about the plans."""

import re

import pytest

import __spark_entry__ as entry
import oracle
from flowlytics.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    _, rows, problems = oracle.check(spark, con, SF_DIR, name)
    assert not problems
    assert problems is not None


def plan(spark, name):
    return entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["daily_flow", "daily_context", "group_daily", "amount_bins", "history_windows", "token_frequency"])
def test_no_python_in_the_plan(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "CartesianProduct" not in text


def test_scan_is_pruned_and_filtered(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(spark, "daily_flow_by_part")
    assert "l_tax" in re.search(r"PushedFilters: \[([^]]*)\]", text).group(1)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"}
    assert text.count("Exchange") == 1


def test_windows_on_one_key_share_a_shuffle(spark):
    text = plan(spark, "lead_labels")
    # broadcast of part, shuffle of the aggregation, shuffle by product for all six labels
    assert text.count("Exchange hashpartitioning") == 2


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["product_id", "date", "purchase_amt", "redemption_amt", "net_amt"]
    assert df.count() > 0
