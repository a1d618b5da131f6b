"""Chat history and chat activities. Everything but ``last_n_turns`` also runs on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import values as V
from ..functions import text as X


def last_n_turns(turns: DataFrame, n: int = V.SHOWN_TURNS) -> DataFrame:
    """The last ``n`` turns per conversation. Each task keeps at most ``n`` before the shuffle."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def message_events(activities: DataFrame) -> DataFrame:
    """Messages with text; the text comes out trimmed."""
    text = X.strip(F.coalesce(F.col("text"), F.lit("")))
    return activities.where((F.col("type") == "message") & (text != "")).withColumn("text", text)


def reply_rows(messages: DataFrame, reply_text: Column) -> DataFrame:
    """Reply activities: sender and recipient swapped, addressed to the message."""
    path = F.concat(F.col("serviceUrl"), F.lit("/v3/conversations/"), F.col("conversation.id"), F.lit("/activities/"), F.col("id"))
    return messages.select(
        path.alias("reply_url"), F.lit("message").alias("type"), reply_text.alias("text"),
        F.col("recipient").alias("from"), F.col("from").alias("recipient"), F.col("id").alias("replyToId"))
