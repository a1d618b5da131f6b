"""The report, maintained by increments while tickets arrive and change.

Three logs hold the state: the versions of tickets with their measures, the signed summaries of the batches, and the trend blocks of
changed days. A batch looks up the versions it replaces (in their hash buckets only), adds the measures of the new ones and takes
the old ones back, and makes the blocks of the days it touched again. The tracker is never reread, and as every
log is written by batch number, a batch that runs twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import aggregates as A, trend_blocks as B
from ..plans import report as RP
from ..staging import scope, stage
from .batchlog import EVERY, BatchLog

BUCKETS = 64
_MEASURES = ", ".join(f"{m} long" for m in A.MEASURES)
_DIMENSIONS = ("project string, assignee string, status string, status_category string, priority string, created_date date, "
               "resolved_at {time}, resolution_time_days long, epic_link string")
BLOCKS = f"series string, {B.BLOCKS}"


class ReportState:
    """The state of one report in ``folder``, a shared one. ``time`` is the type of the tickets' times."""

    def __init__(self, spark: SparkSession, folder: str, time: str = "timestamp_ntz", every: int = EVERY, buckets: int = BUCKETS):
        dims = _DIMENSIONS.format(time=time)
        self.spark, self.buckets = spark, buckets
        self.versions = BatchLog(spark, f"{folder}/versions", f"key string, updated {time}, live boolean, {dims}, {_MEASURES}, bucket int", every, ("bucket",))
        self.summaries = BatchLog(spark, f"{folder}/summaries", f"part string, {dims}, {_MEASURES}", every, ("part",))
        self.blocks = BatchLog(spark, f"{folder}/blocks", BLOCKS, every)

    # -- versions ------------------------------------------------------------

    def _arrived(self, enriched: DataFrame) -> DataFrame:
        """The newest version per key that arrived; a row marked ``deleted`` ends its ticket."""
        live = ~F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in enriched.columns else F.lit(True)
        rows = RP.report_rows(enriched.withColumn("live", live), "key", "updated", "live")
        content = [c for c in rows.columns if c not in ("key", "updated")]
        newest = rows.where("key IS NOT NULL").groupBy("key").agg(F.max(F.struct("updated", F.xxhash64(*content).alias("_h"), F.struct(*content).alias("r"))).alias("v"))
        return newest.select("key", "v.updated", "v.r.*").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    @staticmethod
    def _latest(versions: DataFrame) -> DataFrame:
        """The version that holds per key: the latest ``updated``, of equal ones the one that came last."""
        content = [c for c in versions.columns if c not in ("key", "updated", "batch")]
        best = versions.groupBy("key").agg(F.max(F.struct("updated", "batch", F.struct(*content).alias("r"))).alias("v"))
        return best.select("key", "v.updated", "v.r.*")

    def _changes(self, arrived: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """The versions that take effect, and the ones they replace."""
        touched = [r.bucket for r in arrived.select("bucket").distinct().collect()]  # at most the number of buckets
        known = self.versions.before(batch).where(F.col("bucket").isin(touched or [-1]))
        held = stage(self._latest(known.join(arrived.select("key"), "key", "left_semi")), "held")
        since = held.select("key", F.col("updated").alias("_since"), F.lit(True).alias("_known"))
        # A null time is older than any; an arrival as old as what is held replaces it.
        late = F.col("_known") & F.coalesce(F.col("_since") > F.col("updated"), F.col("_since").isNotNull() & F.col("updated").isNull())
        effective = stage(arrived.join(since, "key", "left").where(~F.coalesce(late, F.lit(False))).drop("_since", "_known"), "effective")
        return effective, held.join(effective.select("key"), "key", "left_semi")

    # -- one batch -----------------------------------------------------------

    def apply(self, enriched: DataFrame, batch: int) -> None:
        """Takes in a batch of enriched tickets (``key, updated`` and what the report reads), new or changed."""
        with scope():
            arrived = stage(self._arrived(enriched), "arrived")
            effective, replaced = self._changes(arrived, batch)
            self.versions.add(batch, effective)
            fields = [c for c in effective.columns if c not in ("key", "updated", "live", "bucket")]
            negative = [(-F.col(c)).alias(c) if c in A.MEASURES else F.col(c) for c in fields]
            signed = effective.where("live").select(*fields).union(replaced.where("live").select(*negative))
            delta = stage(RP.summarize_rows(signed), "delta")
            self.summaries.add(batch, delta)
            self.blocks.add(batch, self._changed_blocks(delta, batch))
            if self.versions.due(batch):
                self.versions.rebase(batch, self._latest(self.versions.before(batch + 1)))
                self.summaries.rebase(batch, self.summary(batch))
                self.blocks.rebase(batch, self.current_blocks(batch))

    def summary(self, batch: int) -> DataFrame:
        """The summary after a batch."""
        return RP.merged(self.summaries.before(batch + 1).drop("batch"))

    def _changed_blocks(self, delta: DataFrame, batch: int) -> DataFrame:
        """Blocks of the days that the batch touched, without points (n = 0) where none are left."""
        found = []
        for series, part, at, make in (("created", "created", "created_date", B.date_blocks), ("resolved", "resolved", "resolved_at", B.time_blocks)):
            days = stage(delta.where((F.col("part") == part) & F.col(at).isNotNull()).select(F.to_date(at).alias("day")).distinct(), "days")
            rows = self.summaries.before(batch + 1).where(F.col("part") == part).withColumn("day", F.to_date(at)).join(days, "day", "left_semi")
            points = rows.groupBy(at).agg(F.sum("n").alias("y")).where("y <> 0")
            blocks = days.join(make(points, at, "y"), "day", "left").select(
                F.lit(series).alias("series"), "day", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0).cast(B.EXACT)).alias(c) for c in ("sum_y", "sum_iy")])
            found.append(blocks)
        return found[0].union(found[1])

    def current_blocks(self, batch: int) -> DataFrame:
        """The blocks after a batch: per day the ones made last."""
        made = self.blocks.before(batch + 1)
        last = made.groupBy("series", "day").agg(F.max(F.struct("batch", "n", "sum_y", "sum_iy")).alias("b"))
        return last.select("series", "day", "b.n", "b.sum_y", "b.sum_iy").where("n > 0")

    def sections(self, batch: int, epics: DataFrame | None = None, loaded_at=None) -> dict[str, DataFrame]:
        """The report after a batch; its trends come from the blocks."""
        summary = stage(self.summary(batch), "summary")
        found = RP._sections(summary, epics, loaded_at)
        blocks = stage(self.current_blocks(batch), "blocks")
        for series, name in (("created", "creation_trend"), ("resolved", "resolution_trend")):
            own = B.trend_of_blocks(blocks.where(F.col("series") == series), name)
            some = F.coalesce(A.cardinalities_of(summary.where("part = 'cube'")).select("total_records").scalar(), F.lit(0)) > 0
            found[f"trends.{name}"] = own.where(some)
        return found


def maintained_report(arrivals: DataFrame, prepare: Callable[[DataFrame], DataFrame], state: ReportState, out: str, checkpoint: str,
                      epics: DataFrame | None = None, period: str | None = "5 minutes", clock: Callable[[], datetime | str] | None = None) -> StreamingQuery:
    """Writes the tall report over all tickets so far to ``out/batch=<id>`` for each batch of arrivals.

    ``prepare`` enriches the arrived rows. A ticket may arrive again with other values; the version updated last holds, and one
    marked ``deleted`` no longer counts. ``period=None`` processes what is there and stops. ``clock`` gives the
    time of the load, left out with ``None``.
    """
    def refresh(rows: DataFrame, batch: int) -> None:
        with scope():
            state.apply(prepare(rows), batch)
            found = state.sections(batch, epics, clock() if clock else None)
            RP.tall(found).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")

    writer = arrivals.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if period is None else {"processingTime": period}
    return writer.trigger(**trigger).start()
