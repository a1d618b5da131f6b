"""Plans: what must and must not be in them."""

import re

import pytest

from trackspan.operators import aggregates as A, chat, epics as E, people as P
from trackspan.operators.enrich import enrich
from trackspan.plans import catalog, report as RP
from trackspan.sources.warehouse import AS_OF, Warehouse

FOLDER = "/root/testdata/sf0.001"
SCORED = {"resolve_epics", "epic_title_topk", "epic_title_topk_contained", "title_ratios", "build_ticket_rows"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_pairing_without_a_key(spark, name):
    text = plan(catalog.QUERIES[name](Warehouse(spark, FOLDER)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in SCORED:
        assert "Python" not in text and "Pandas" not in text and "ArrowEval" not in text


def test_scan_reads_only_what_is_used(spark):
    w = Warehouse(spark, FOLDER)
    text = plan(A.status_distribution(enrich(w.tickets())))
    assert "lineitem.parquet" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in text


def test_filters_reach_the_scan(spark):
    text = plan(Warehouse(spark, FOLDER).table("orders").where("o_orderdate >= timestamp_ntz '2001-01-01'"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", text)


def test_summary_is_one_scan_and_one_shuffle(spark):
    t = enrich(Warehouse(spark, FOLDER).tickets())
    base = plan(t)
    text = plan(RP.summarize(t))
    assert text.count("Scan parquet") == base.count("Scan parquet")
    assert text.count("Exchange hashpartitioning") == base.count("Exchange hashpartitioning") + 1
    assert "partial_sum" in text


def test_trend_never_sorts_all_timestamps_in_one_task(spark):
    """The only single-partition windows are over days."""
    series = Warehouse(spark, FOLDER).table("events").select("ts").distinct()
    text = plan(A.time_index(series, "ts"))
    single = text.split("Exchange SinglePartition")
    assert len(single) == 2 and "_day" in single[1].splitlines()[1]


def test_top_turns_are_cut_before_the_shuffle(spark):
    text = plan(chat.last_n_turns(Warehouse(spark, FOLDER).chat_history(), 5))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_top_k_does_not_sort_everything(spark):
    text = plan(catalog.QUERIES["top_assignees"](Warehouse(spark, FOLDER)))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
