import itertools
import os
import random
import threading
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from test_aggregates import SCHEMA, ticket
from trackspan.operators import aggregates as A, trend_blocks as B
from trackspan.operators.enrich import enrich
from trackspan.plans import report as RP
from trackspan.staging import Scope, Snapshot, scope, shared_dir, stage
from trackspan.streaming.batchlog import BatchLog
from trackspan.streaming.maintained import ReportState, maintained_report

NAMES = [c.split()[0] for c in SCHEMA.split(",")]


def table_of(spark, data):
    return enrich(spark.createDataFrame([tuple(d) for d in data], SCHEMA))


def versions(seed, waves):
    """Batches of ticket rows in which tickets come again with other values, never twice with one ``updated``."""
    rnd, seen, out = random.Random(seed), set(), []
    for _ in range(waves):
        batch = []
        for _ in range(25):
            row = dict(zip(NAMES, ticket(str(rnd.randint(0, 30)), rnd.choice(["Done", "To Do", "In Progress"]), rnd.choice(["Ann", "Bo", "Cy"]))))
            row["updated"] = datetime(2024, 1, 1) + timedelta(days=rnd.randint(0, 40), seconds=rnd.randint(0, 3))
            if (row["key"], row["updated"]) not in seen:
                seen.add((row["key"], row["updated"]))
                batch.append(tuple(row.values()))
        out.append(batch)
    return out


def by_state(spark, state, batch):
    return rows(RP.tall(state.sections(batch)))


def settled(batches):
    """The version that holds per key."""
    held = {}
    for row in itertools.chain(*batches):
        r = dict(zip(NAMES, row))
        if r["key"] not in held or r["updated"] > held[r["key"]][0]:
            held[r["key"]] = r["updated"], row
    return [row for _, row in held.values()]


def test_state_equals_the_report_over_all_and_repeats_do_no_harm(spark, tmp_path):
    batches = versions(1, 5)
    state = ReportState(spark, str(tmp_path / "s"), every=2, buckets=8)
    for i, batch in enumerate(batches):
        state.apply(table_of(spark, batch), i)
        if i in (1, 3):
            state.apply(table_of(spark, batch), i)
        if i in (0, 4):
            whole = table_of(spark, settled(batches[:i + 1]))
            assert by_state(spark, state, i) == rows(RP.tall(RP.comprehensive_report(whole)))


def test_deleted_tickets_are_taken_back(spark, tmp_path):
    state = ReportState(spark, str(tmp_path / "s"), buckets=4)
    both = table_of(spark, [ticket("1", "Done", days=1), ticket("2", "Done", days=2)]).withColumn("deleted", F.lit(False))
    state.apply(both, 0)
    state.apply(both.where("key LIKE '%1'").withColumn("deleted", F.lit(True)), 1)
    assert rows(state.sections(1)["total_records"]) == [(1,)]
    state.apply(both.where("key LIKE '%2'").withColumn("deleted", F.lit(True)), 2)
    assert rows(RP.tall(state.sections(2))) == [("error", "No data available", None, None, None)]


def test_stream_of_changing_tickets(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = versions(2, 3)
    state = ReportState(spark, str(tmp_path / "s"), buckets=8)
    schema = spark.createDataFrame([], SCHEMA).schema
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(schema).parquet(source)
        maintained_report(arrivals, enrich, state, out, str(tmp_path / "cp"), period=None).awaitTermination()
    last = spark.read.parquet(f"{out}/batch=2").drop("batch")
    assert rows(last) == rows(RP.tall(RP.comprehensive_report(table_of(spark, settled(batches)))))


def test_batch_log_keeps_what_a_repeat_reads(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path), "k string, n long", every=2)
    for b in range(6):
        log.add(b, spark.createDataFrame([("a", b)], "k string, n long"))
        if log.due(b):
            log.rebase(b, log.before(b + 1).groupBy("k").agg(F.sum("n").alias("n")))
        assert log.before(b + 1).agg(F.sum("n")).first()[0] == sum(range(b + 1))
        assert (log.before(b).agg(F.sum("n")).first()[0] or 0) == sum(range(b))
    assert log._batches("base") == [3, 5] and log._batches("added") == [4, 5]


# -- trends -----------------------------------------------------------------------------------------------


def points(n, seed):
    rnd = random.Random(seed)
    return {datetime(2024, 1, 1) + timedelta(seconds=rnd.randint(0, 5 * 86400), microseconds=rnd.choice([0, 0, 1, 999999])): rnd.randint(1, 50) for _ in range(n)}


def test_blocks_give_the_slope(spark):
    for n in (0, 1, 2, 300):
        series = spark.createDataFrame(list(points(n, n).items()), "updated timestamp_ntz, tickets_resolved long")
        blocks = B.time_blocks(series, "updated", "tickets_resolved")
        assert rows(B.trend_of_blocks(blocks, "t")) == rows(A.resolution_trend_of(series))


def test_a_late_point_changes_its_own_block_only(spark):
    early = points(200, 7)
    late = {datetime(2024, 1, 2, 3): 40, datetime(2024, 2, 1): 3}
    schema = "updated timestamp_ntz, tickets_resolved long"
    before = B.time_blocks(spark.createDataFrame(list(early.items()), schema), "updated", "tickets_resolved")
    both = spark.createDataFrame(list((early | late).items()), schema)
    days = [d.date() for d in late]
    changed = B.time_blocks(both.where(F.to_date("updated").isin(days)), "updated", "tickets_resolved")
    after = B.replaced(before, changed)
    assert rows(after) == rows(B.time_blocks(both, "updated", "tickets_resolved"))
    assert rows(B.trend_of_blocks(after, "t")) == rows(A.resolution_trend_of(both))
    gone = spark.createDataFrame([(date(2024, 2, 1), 0, Decimal(0), Decimal(0))], B.BLOCKS)
    assert date(2024, 2, 1) not in {r.day for r in B.replaced(after, gone).collect()}


# -- lifetimes --------------------------------------------------------------------------------------------


def held(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_scopes_release_what_was_staged_inside(spark):
    before = held(spark)
    with scope():
        inner = stage(spark.range(5), "inner")
        with scope():
            stage(spark.range(3), "innermost")
            result = stage(inner.where("id > 2"), "result", kept=True)
        assert len(held(spark) - before) == 2 and result.count() == 2
    assert held(spark) == before
    with pytest.raises(RuntimeError), scope():
        stage(spark.range(5), "lost")
        raise RuntimeError
    assert held(spark) == before
    own = Scope()
    own.release()


def test_readers_keep_the_version_they_opened(spark):
    now, loads = [0.0], []
    before = held(spark)

    def load():
        loads.append(1)
        return spark.range(len(loads))

    snapshot = Snapshot(load, ttl=10, clock=lambda: now[0])
    other = spark.newSession()
    with snapshot.reading() as first:
        now[0] = 20.0
        with snapshot.reading(other) as second:
            assert second.sparkSession is other and (first.count(), second.count()) == (1, 2)
            assert len(held(spark) - before) == 2
        assert first.count() == 1
    assert len(held(spark) - before) == 1 and snapshot.get().count() == 2
    snapshot.release()
    assert held(spark) == before


def test_a_load_in_progress_does_not_stop_readers(spark):
    now, gate, entered = [0.0], threading.Event(), threading.Event()

    def load():
        if now[0] > 0:
            entered.set()
            assert gate.wait(30)
        return spark.range(1 if now[0] == 0 else 2)

    snapshot = Snapshot(load, ttl=10, clock=lambda: now[0])
    snapshot.get()
    now[0] = 20.0
    loader = threading.Thread(target=snapshot.get)
    loader.start()
    assert entered.wait(30)
    with snapshot.reading() as old:
        assert old.count() == 1
    gate.set()
    loader.join()
    with snapshot.reading() as new:
        assert new.count() == 2
    snapshot.release()


def test_waves_read_tickets_that_were_made_once(spark, monkeypatch):
    from trackspan.plans import catalog
    kept, stage = [], catalog.stage
    monkeypatch.setattr(catalog, "stage", lambda df, name: kept.append(name) or stage(df, name))
    report = catalog.runnable()["maintained_report"](spark, "/root/testdata/sf0.001")
    assert kept == ["tickets"] and report.count() > 0
