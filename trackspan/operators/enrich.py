"""Ticket rows with their metric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import values as V
from ..functions import metrics as M


def with_ticket_defaults(raw: DataFrame) -> DataFrame:
    return raw.fillna({"assignee": V.DEFAULT_ASSIGNEE, "priority": V.DEFAULT_PRIORITY, "reporter": V.DEFAULT_REPORTER})


def enrich(tickets: DataFrame, priority_scores: dict[str, int] | None = None) -> DataFrame:
    """Adds the eight metric columns.

    Durations use ``created``/``updated``; calendar columns use ``created_local`` where the source has it.
    """
    local = "created_local" if "created_local" in tickets.columns else "created"
    return tickets.withColumns({
        "resolution_time_days": M.resolution_days("status", "created", "updated"),
        "is_resolved": M.is_resolved("status"),
        "created_date": F.to_date(local),
        "created_week": F.weekofyear(local),
        "created_month": M.calendar_month(local),
        "created_year": F.year(local),
        "priority_score": M.priority_score("priority", priority_scores),
        "status_category": M.status_category("status"),
    })
