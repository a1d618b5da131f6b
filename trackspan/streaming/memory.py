"""The last turns of every conversation, kept while turns arrive."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import values as V
from .batchlog import BatchLog

# Executors get these functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TURNS = "conv_id long, turn long, role string, text string"
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
HELD = "turns array<long>, roles array<string>, texts array<string>"


def _newest(n: int, expire_ms: int) -> Callable:
    """Merges what arrived into what is held and gives the window out whole; a conversation that was silent too long, as one row without a turn."""
    def order(t: tuple) -> tuple:
        return t[0], t[1] or "", t[2] or ""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"conv_id": [key[0]], "turn": [None], "role": [None], "text": [None]}, dtype=object)
            return
        held = list(zip(*state.get)) if state.exists else []
        for frame in frames:  # a piece of the batch at a time, however long the conversation
            rows = frame.astype(object).where(frame.notna(), None)
            held = heapq.nlargest(n, [*held, *zip(map(int, rows["turn"]), rows["role"], rows["text"])], key=order)
        turns, roles, texts = (list(x) for x in zip(*held))
        state.update((turns, roles, texts))
        state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame({"conv_id": [key[0]] * len(held), "turn": turns, "role": roles, "text": texts}, dtype=object)

    return update


def last_turns(turns: DataFrame, n: int = V.SHOWN_TURNS, expire_ms: int = 86_400_000) -> DataFrame:
    """From a stream of ``conv_id, turn, role, text``: the last ``n`` turns of each conversation that a batch changes.

    State holds ``n`` turns per conversation, whatever its length, and is dropped ``expire_ms`` after the last arrival; a
    conversation that starts again then starts empty. Turns may arrive in any order. Rows without a conversation or a turn number are left out.
    """
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    return rows.groupBy("conv_id").applyInPandasWithState(_newest(n, expire_ms), TURNS, HELD, "update", "ProcessingTimeTimeout")


class ChatMemory:
    """The current windows of all conversations, as a table in ``folder`` that other sessions can read."""

    def __init__(self, spark, folder: str, n: int = V.SHOWN_TURNS, expire_ms: int = 86_400_000, every: int = 16):
        self.n, self.expire_ms = n, expire_ms
        self.log = BatchLog(spark, folder, TURNS, every)

    def keep(self, turns: DataFrame, checkpoint: str, period: str | None = "10 seconds") -> StreamingQuery:
        """Takes in arriving turns; ``period=None`` processes what is there and stops. A repeated batch replaces its own rows."""
        def write(rows: DataFrame, batch: int) -> None:
            rows = rows.persist()
            if not rows.isEmpty():
                self.log.add(batch, rows)
            rows.unpersist()
            if self.log.due(batch):
                self.log.rebase(batch, self.current(batch))

        trigger = {"availableNow": True} if period is None else {"processingTime": period}
        writer = last_turns(turns, self.n, self.expire_ms).writeStream.outputMode("update").foreachBatch(write)
        spark = turns.sparkSession
        before = spark.conf.get(IDLE_BATCHES, "true")
        # Waiting for expiries would keep a query that is to stop from stopping; the setting is taken over when it starts.
        spark.conf.set(IDLE_BATCHES, "false" if period is None else before)
        try:
            return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
        finally:
            spark.conf.set(IDLE_BATCHES, before)

    def current(self, batch: int | None = None) -> DataFrame:
        """The windows after a batch, by default the last one: per conversation the rows of the batch that changed it last."""
        rows = self.log.before((1 << 62) if batch is None else batch + 1)
        last = rows.groupBy("conv_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["conv_id", "batch"]).where("turn IS NOT NULL").select("conv_id", "turn", "role", "text")
