"""The report, kept up to date while ticket files arrive."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.report import summarize, tall, _sections
from ..staging import scope, stage


def refreshed_report(arrivals: DataFrame, load: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                     epics: DataFrame | None = None, period: str | None = "5 minutes") -> StreamingQuery:
    """Writes a fresh tall report to ``out/batch=<id>`` each ``period`` in which tickets arrived.

    ``load`` gets the arrived rows and returns the enriched tickets to report on: the whole table, or the
    arrived rows alone. Writing by batch id makes a repeated batch replace its own report.
    ``period=None`` processes what is there and stops.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        with scope():
            summary = stage(summarize(load(batch)), "summary")
            report = _sections(summary, epics, datetime.now(timezone.utc))
            tall(report).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    writer = arrivals.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if period is None else {"processingTime": period}
    return writer.trigger(**trigger).start()
