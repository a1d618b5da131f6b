import json
from datetime import datetime, timedelta

import pytest

from conftest import rows
from test_aggregates import SCHEMA, random_tickets, table, ticket
from trackspan.operators import aggregates as A, rankings as R
from trackspan.operators.chat import message_events
from trackspan.operators.enrich import enrich
from trackspan.plans import report as RP
from trackspan.sources.schemas import ACTIVITY
from trackspan.staging import Snapshot, stage
from trackspan.streaming.messages import message_stream, write_available
from trackspan.streaming.refresh import refreshed_report

EPICS = "key string, project string"


def test_sections_equal_the_single_operators(spark):
    t = table(spark, *random_tickets(), ticket("e1", "Done", days=1, epic="E-1"), ticket("e2", epic="E-1"))
    epics = spark.createDataFrame([("E-1", "P"), ("E-2", "P")], EPICS)
    report = RP.comprehensive_report(t, epics, datetime(2024, 5, 1))
    for section, fn in {"overview": A.overview_metrics, "assignees.assignee_stats": A.assignee_stats, "projects.project_stats": A.project_stats,
                        "trends.daily_creation": A.daily_creation, "trends.weekly_creation": A.weekly_creation,
                        "trends.monthly_creation": A.monthly_creation, "trends.daily_resolution": A.resolution_series,
                        "trends.creation_trend": A.creation_trend, "trends.resolution_trend": A.resolution_trend,
                        "status.status_distribution": A.status_distribution, "status.status_flow": A.status_flow,
                        "priority.priority_by_project": A.priority_by_project,
                        "priority.priority_resolution_times": A.priority_resolution_times}.items():
        assert rows(report[section]) == rows(fn(t)), section
    assert rows(report["assignees.top_assignees"]) == rows(R.top_assignees(A.assignee_stats(t)))
    assert rows(report["epics.epic_progress"]) == [("E-1", "P", 2, 1, 50.0), ("E-2", "P", 0, 0, 0.0)]
    assert rows(report["total_records"]) == [(402,)] and report["error"].count() == 0
    tall = RP.tall(report)
    assert tall.columns == ["section", "metric", "dim1", "dim2", "value"]
    assert rows(tall.where("section = 'overview' AND metric = 'total_tickets'"), "value") == [(402.0,)]
    assert tall.where("section = 'data_freshness'").count() == 1


def test_empty_report_is_the_error_entry(spark):
    empty = enrich(spark.createDataFrame([], SCHEMA))
    report = RP.comprehensive_report(empty, spark.createDataFrame([], EPICS), datetime(2024, 5, 1))
    assert rows(RP.tall(report)) == [("error", "No data available", None, None, None)]


def test_written_report(spark, tmp_path):
    report = RP.comprehensive_report(table(spark, ticket("1")))
    RP.write_report(report, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == RP.tall(report).count()


def test_stage_keeps_schema_and_rows(spark):
    t = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, None)], "a int, b timestamp_ntz")
    staged = stage(t, "test")
    assert staged.schema == t.schema and rows(staged) == rows(t)


def test_snapshot_lifetime(spark):
    now, loads = [1000.0], []

    def load():
        loads.append(now[0])
        return spark.range(0 if len(loads) == 1 else 3)

    snapshot = Snapshot(load, ttl=300, clock=lambda: now[0])
    assert snapshot.get().isEmpty() and snapshot.loaded_at is None
    first = snapshot.get()
    now[0] += 299
    assert snapshot.get() is first and len(loads) == 2
    assert snapshot.get(force_refresh=True) is not first and snapshot.loaded_at == 1299.0
    now[0] += 300
    snapshot.get()
    assert len(loads) == 4
    snapshot.release()


def activity(i, kind, text):
    return {"type": kind, "text": text, "id": str(i), "from": {"id": "u"}, "recipient": {"id": "b"}}


def test_message_stream_equals_batch_and_takes_only_new_files(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    texts = ["hi", "  ", " there \n", None]

    def arrive(name, start):
        (tmp_path / "in" / name).write_text("".join(
            json.dumps(activity(start + i, "message" if i % 5 else "typing", texts[i % 4])) + "\n" for i in range(20)))

    arrive("a.json", 0)
    write_available(message_stream(spark, source), out, checkpoint).awaitTermination()
    arrive("b.json", 100)
    write_available(message_stream(spark, source, 1), out, checkpoint).awaitTermination()
    batch = message_events(spark.read.schema(ACTIVITY).json(source))
    assert rows(spark.read.schema(batch.schema).parquet(out), "id", "text") == rows(batch, "id", "text")
    assert batch.count() == 16


def test_refreshed_report(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*tickets):
        spark.createDataFrame(list(tickets), SCHEMA).write.mode("append").parquet(source)

    def run():
        arrivals = spark.readStream.schema(SCHEMA).parquet(source)
        refreshed_report(arrivals, lambda batch: enrich(spark.read.schema(SCHEMA).parquet(source)), out, str(tmp_path / "cp"), period=None).awaitTermination()

    arrive(ticket("1"), ticket("2", "Done", days=1))
    run()
    arrive(ticket("3"))
    run()
    total = spark.read.parquet(out).where("section = 'total_records'").select("batch", "value")
    assert rows(total) == [(0, 2.0), (1, 3.0)]
