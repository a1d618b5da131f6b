import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from conftest import rows
from trackspan.operators import aggregates as A, rankings as R
from trackspan.operators.enrich import enrich

SCHEMA = """key string, summary string, status string, assignee string, project string, issue_type string, created timestamp_ntz,
updated timestamp_ntz, priority string, reporter string, epic_link string, sprint_id long"""
DAY = datetime(2024, 1, 1)


def ticket(key, status="Open", assignee="ann", project="P", created=DAY, days=None, priority="High", epic=None):
    updated = None if days is None or created is None else created + timedelta(days=days)
    return (key, "s", status, assignee, project, "Task", created, updated, priority, "r", epic, None)


def table(spark, *tickets):
    return enrich(spark.createDataFrame(list(tickets), SCHEMA))


def random_tickets(n=400, seed=3):
    rng = random.Random(seed)
    return [ticket(f"K-{i}", rng.choice(["Done", "Open", "Active", "Blocked", "Closed"]), "hot" if i % 3 == 0 else f"a{rng.randint(0, 40)}",
                   rng.choice("PQR"), DAY + timedelta(hours=rng.randint(0, 999)), rng.choice([None, *range(-3, 20)]),
                   rng.choice(["Low", "High", "Highest", "None"])) for i in range(n)]


def test_overview(spark):
    t = table(spark, ticket("1", "Done", days=1), ticket("2", "Done", days=4), ticket("3", "Active"), ticket("4", "Odd"))
    assert rows(A.overview_metrics(t)) == [(4, 1, 2, 0, 2.5, 50.0)]
    assert rows(A.overview_metrics(table(spark, ticket("1")))) == [(1, 0, 0, 1, 0.0, 0.0)]


def test_half_even_rate_and_missing_mean(spark):
    stats = A.assignee_stats(table(spark, *[ticket(str(i), "Done" if i == 0 else "Open") for i in range(16)]))
    assert rows(stats) == [("ann", 16, None, 4.0, 1, 6.2)]


def test_empty_input_keeps_schema(spark):
    empty = enrich(spark.createDataFrame([], SCHEMA))
    for fn in (A.overview_metrics, A.assignee_stats, A.project_stats, A.daily_creation, A.status_flow, A.priority_resolution_times,
               A.weekly_creation, A.monthly_creation, A.resolution_series, A.status_distribution):
        out = fn(empty)
        assert out.count() == 0 and len(out.columns) > 1
    assert rows(A.creation_trend(empty)) == [(0.0,)] and rows(A.resolution_trend(empty)) == [(0.0,)]


def test_bad_dates_count_but_do_not_trend(spark):
    t = table(spark, ticket("1", created=None), ticket("2"))
    assert A.overview_metrics(t).first().total_tickets == 2
    assert rows(A.daily_creation(t)) == [(DAY.date(), 1)]


def test_trend_of_growing_days(spark):
    days = [d for d, n in enumerate([1, 2, 4, 9]) for _ in range(n)]
    t = table(spark, *[ticket(str(i), created=DAY + timedelta(days=d)) for i, d in enumerate(days)])
    assert rows(A.creation_trend(t)) == [(1.0,)]
    assert rows(A.creation_trend(table(spark, ticket("1")))) == [(0.0,)]


def test_time_index_is_the_global_position(spark):
    rng = random.Random(1)
    base = [DAY + timedelta(days=rng.randint(0, 3), seconds=rng.randint(0, 5), microseconds=rng.randint(0, 999999)) for _ in range(500)]
    times = sorted(set(base) | {DAY, DAY + timedelta(days=9)})
    got = A.time_index(spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz").repartition(7), "ts")
    assert [r.ts for r in got.orderBy("idx").collect()] == times
    assert [r.idx for r in got.orderBy("idx").collect()] == list(range(len(times)))


def test_exact_median(spark):
    t = table(spark, *[ticket(str(d), "Done", days=d) for d in (1, 2, 4, 9)], ticket("x", "Open", priority="Low"))
    assert rows(A.priority_resolution_times(t)) == [("High", 4.0, 3.0, 4), ("Low", None, None, 0)]


def test_statistics_against_plain_python(spark):
    source = random_tickets()
    t = table(spark, *source).repartition(7).persist()
    stats = {r.assignee: r for r in A.assignee_stats(t).collect()}
    for name in {s[3] for s in source}:
        mine = [s for s in source if s[3] == name]
        done = [s for s in mine if s[2] in ("Done", "Closed")]
        days = [(s[7] - s[6]).days for s in done if s[7]]
        row = stats[name]
        assert (row.total_tickets, row.resolved_tickets) == (len(mine), len(done))
        assert row.resolution_rate == round(len(done) / len(mine) * 100, 1)
        assert row.avg_resolution_time == (pytest.approx(sum(days) / len(days)) if days else None)
    flow = A.status_flow(t)
    assert flow.count() == 3 * 4
    assert rows(flow.groupBy("status_category").agg(F.sum("n"))) == rows(A.status_category_distribution(t))
    cross = A.priority_by_project(t)
    assert rows(cross.groupBy("priority").agg(F.sum("n"))) == rows(A.priority_distribution(t))
    wide = {r.project: r for r in A.crosstab_wide(cross, "project", "priority", ["Low", "High", "Absent"]).collect()}
    assert wide["P"].Absent == 0 and wide["P"].Low == sum(s[4] == "P" and s[8] == "Low" for s in source)
    for r in A.priority_resolution_times(t).collect():
        days = [(s[7] - s[6]).days for s in source if s[8] == r.priority and s[2] in ("Done", "Closed") and s[7]]
        assert (r.median_days, r.n_days) == (median(days), len(days))
    t.unpersist()


def test_partition_count_does_not_matter(spark):
    t = table(spark, *random_tickets())
    for fn in (A.assignee_stats, A.project_stats, A.resolution_series, A.resolution_trend, A.priority_resolution_times):
        assert rows(fn(t.coalesce(1))) == rows(fn(t.repartition(7)))


def test_grain(spark):
    t = table(spark, ticket("1", "Done", days=0.2), ticket("2", "Done", days=0.3), ticket("3", "Open", days=1))
    assert A.resolution_series(t).count() == 2
    assert rows(A.resolution_series(t, "day")) == [(DAY.date(), 2)]
    with pytest.raises(ValueError):
        A.resolution_series(t, "hour")


def test_drilldown_counts(spark):
    got = rows(A.drilldown_counts(table(spark, ticket("1"), ticket("2", "Done"), ticket("3", project="Q"))))
    assert got == sorted([("status", "Open", 2), ("status", "Done", 1), ("project", "P", 2), ("project", "Q", 1),
                          ("status_category", "Pending", 2), ("status_category", "Resolved", 1), ("rows", None, 3)], key=repr)


# -- rankings -----------------------------------------------------------------------

STATS = "assignee string, total_tickets long, avg_resolution_time double, avg_priority double, resolved_tickets long, resolution_rate double"


@pytest.fixture
def stats(spark):
    return spark.createDataFrame([("ann", 5, 3.0, 1.0, 4, 80.0), ("bob", 5, None, 1.0, 0, 0.0), ("cy", 3, 1.5, 1.0, 3, 100.0),
                                  ("dan", 1, 9.0, 1.0, 1, 100.0), ("Annabel", 9, 2.0, 1.0, 1, 11.1)], STATS)


def names(df):
    return [r.assignee for r in df.collect()]


def test_orders(stats):
    assert names(R.top_assignees(stats, 3)) == ["Annabel", "ann", "bob"]
    assert names(R.most_efficient(stats)) == ["cy", "ann", "Annabel", "bob"]
    assert names(R.slowest_resolvers(stats, 2)) == ["bob", "Annabel"]
    assert names(R.top_assignees_by(stats, "avg_resolution_time")) == ["cy", "Annabel", "ann", "dan"]
    assert names(R.top_assignees_by(stats, "resolution_rate", 2)) == ["cy", "dan"]
    assert names(R.assignee_table(stats, 2, "avg_resolution_time")) == ["cy", "Annabel", "ann", "bob"]
    assert names(R.assignee_performance_summary(stats, 4, 2)) == ["Annabel", "ann"]
    assert names(R.assignee_detail(stats, " ANN ")) == ["Annabel"]


def test_limits_and_metric_names(stats):
    assert len(names(R.top_assignees_by(stats, limit=0))) == 1
    assert R.min_clamp(-1) == 0 and R.min_tickets_filter(stats, -1).count() == 5
    with pytest.raises(ValueError, match="avg_resolution_time, resolution_rate, resolved_tickets, total_tickets"):
        R.top_assignees_by(stats, "foo")
    with pytest.raises(ValueError):
        R.assignee_detail(stats, "  ")
