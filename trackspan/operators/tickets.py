"""Ticket filters, searches and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..functions import text as X
from ..staging import stage
from .people import resolve_users_ranked


def _as_column(c) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def recent_tickets(tickets: DataFrame, as_of, days: int = V.LOOKBACK_DAYS, ordered: bool = True) -> DataFrame:
    """Tickets created since midnight ``days`` before ``as_of``, newest first."""
    bound = F.date_sub(F.lit(as_of).cast("date"), days).cast(tickets.schema["created"].dataType)
    kept = tickets.where(F.col("created") >= bound)
    return kept.orderBy(F.col("created").desc(), "key") if ordered else kept


def search_tickets(tickets: DataFrame, where, as_of, base_url: str, bounded: bool = True,
                   accounts: DataFrame | None = None) -> DataFrame:
    """Tickets that satisfy ``where`` (Column or SQL text).

    ``bounded`` adds the look-back bound and is for predicates that say nothing on the dates;
    ``accounts`` (column ``accountId``) restricts the assignee.
    """
    found = tickets.where(_as_column(where))
    if bounded:
        found = recent_tickets(found, as_of, ordered=False)
    if accounts is not None:
        found = found.join(accounts.select(F.col("accountId").alias("assignee_id")), "assignee_id", "left_semi")
    return found.select("key", "summary", "status", "assignee", X.browse_url(base_url, "key").alias("url"))


def project_status_filter(tickets: DataFrame, project: str, not_status: str = "Done") -> DataFrame:
    return tickets.where((F.col("project") == project) & (F.col("status") != not_status))


def _details(tickets: DataFrame) -> DataFrame:
    def missing(c: str, default: str) -> Column:
        return F.coalesce(F.col(c), F.lit(default)).alias(c)

    return tickets.select(
        "key", "summary", missing("description", ""), "status", missing("assignee", V.DEFAULT_ASSIGNEE), "reporter",
        "created", "updated", "project", "issue_type", missing("priority", V.DEFAULT_PRIORITY))


def ticket_details(tickets: DataFrame, key: str) -> DataFrame:
    """The eleven detail columns of one ticket."""
    return _details(tickets.where(F.col("key") == key.strip().upper()))


def only_keys(tickets: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The tickets that ``keys`` names.

    Cuts the tickets down before an outer join against them: a small key set is broadcast and the tickets are
    filtered where they lie; a large one shuffles both by ticket key, which the outer join then reuses.
    """
    return tickets.join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_semi")


def ticket_details_batch(tickets: DataFrame, keys: DataFrame) -> DataFrame:
    """Details per requested key; an unknown key keeps its row."""
    asked = keys.select(X.norm_upper("key").alias("key"))
    return asked.join(_details(only_keys(tickets, asked, "key")), "key", "left")


def filter_assignee_any(tickets: DataFrame, tokens: DataFrame, users: DataFrame, domain: str, token: str = "q") -> DataFrame:
    """Tickets whose assignee is any of the tokens: account ids, names or addresses.

    A token that resolves to nobody is kept as it is.
    """
    resolved = resolve_users_ranked(tokens, users, domain, token, pass_ids="search")
    # Staged, so that Spark broadcasts a short list and does not shuffle the tickets for it.
    wanted = stage(resolved.select(F.coalesce("accountId", F.col(token)).alias("assignee_id")).distinct(), "accounts")
    return tickets.join(wanted, "assignee_id", "left_semi")


def has_sprint(tickets: DataFrame) -> DataFrame:
    """Projects with at least one ticket in a sprint."""
    return tickets.where("sprint_id IS NOT NULL").select("project").distinct()


def assignee_contains(tickets: DataFrame, query: str) -> DataFrame:
    """Literal, case-insensitive."""
    return tickets.where(F.contains(F.lower("assignee"), F.lit(query.strip().lower())))


def assignee_matches(tickets: DataFrame, pattern: str) -> DataFrame:
    """Regular expression on the lower-case assignee."""
    return tickets.where(F.lower("assignee").rlike(pattern.strip().lower()))


def assignee_drilldown(tickets: DataFrame, pattern: str) -> DataFrame:
    """Matching tickets in the drill-down's column order, as far as the columns exist."""
    return assignee_matches(tickets, pattern).select([c for c in V.DRILLDOWN_COLUMNS if c in tickets.columns])


def resolved_only(enriched: DataFrame) -> DataFrame:
    return enriched.where("is_resolved")


def non_null_metric(df: DataFrame, metric: str) -> DataFrame:
    return df.where(F.col(metric).isNotNull())
