"""Rankings over assignee and project statistics.

Each order is total (metric, more tickets, name), so a ranking is the same on every run. Limits are part
of the reports and run as a bounded top-k per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import values as V
from .aggregates import performance_columns


def limit_clamp(limit) -> int:
    return max(1, int(limit))


def min_clamp(min_tickets) -> int:
    return max(0, int(min_tickets))


def min_tickets_filter(stats: DataFrame, min_tickets: int) -> DataFrame:
    return stats.where(F.col("total_tickets") >= min_clamp(min_tickets))


def ranked(stats: DataFrame, key: str, metric: str = "total_tickets", ascending: bool = False) -> DataFrame:
    first = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return stats.orderBy(first, F.col("total_tickets").desc(), key)


def top_assignees(stats: DataFrame, limit: int = 10) -> DataFrame:
    return ranked(stats, "assignee").limit(limit_clamp(limit))


def most_efficient(stats: DataFrame, limit: int = 5) -> DataFrame:
    return ranked(min_tickets_filter(stats, V.MIN_TICKETS_FOR_RATE), "assignee", "resolution_rate").limit(limit)


def slowest_resolvers(stats: DataFrame, limit: int = 5) -> DataFrame:
    """Lowest resolution rate, not longest time."""
    return ranked(min_tickets_filter(stats, V.MIN_TICKETS_FOR_RATE), "assignee", "resolution_rate", True).limit(limit)


def most_active_projects(stats: DataFrame, limit: int = 10) -> DataFrame:
    return ranked(stats, "project").limit(limit)


def most_completed_projects(stats: DataFrame, limit: int = 5) -> DataFrame:
    return ranked(stats, "project", "completion_rate").limit(limit)


def _check_metric(metric: str) -> str:
    metric = (metric or "").strip()
    if metric not in V.ASSIGNEE_METRICS:
        raise ValueError(f"metric must be one of: {', '.join(V.ASSIGNEE_METRICS)}")
    return metric


def top_assignees_by(stats: DataFrame, metric: str = "total_tickets", limit: int = 10) -> DataFrame:
    """Top assignees by a metric; mean time ranks the shortest first and leaves out missing means."""
    metric = _check_metric(metric)
    time = metric == "avg_resolution_time"
    kept = stats.where(F.col(metric).isNotNull()) if time else stats
    return performance_columns(ranked(kept, "assignee", metric, time).limit(limit_clamp(limit)))


def assignee_performance_summary(stats: DataFrame, min_tickets: int = 1, limit: int = 25) -> DataFrame:
    top = ranked(min_tickets_filter(stats, min_tickets), "assignee").limit(limit_clamp(limit))
    return performance_columns(top)


def assignee_table(stats: DataFrame, min_tickets: int = 1, metric: str = "total_tickets") -> DataFrame:
    """All assignees with enough tickets, sorted by the metric; missing means come last."""
    metric = _check_metric(metric)
    kept = min_tickets_filter(stats, min_tickets)
    return ranked(kept, "assignee", metric, metric == "avg_resolution_time").select(
        "assignee", "total_tickets", "resolved_tickets", "avg_resolution_time", "resolution_rate")


def assignee_detail(stats: DataFrame, query: str) -> DataFrame:
    """The busiest assignee whose name contains the text."""
    q = (query or "").strip().lower()
    if not q:
        raise ValueError("provide an assignee substring")
    hits = stats.where(F.contains(F.lower("assignee"), F.lit(q)))
    return performance_columns(ranked(hits, "assignee").limit(1))
