"""New and changed ticket rows from tables of requests. Nothing is sent anywhere.

Requests that cannot be carried out keep their row, with ``accepted`` false and the reason in ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..functions import text as X
from . import epics as E
from . import people
from .tickets import only_keys


def _default(c: str, value: str) -> Column:
    return F.coalesce(X.blank_to_null(c), F.lit(value))


# -- lookups shared by the builders ------------------------------------------------


def ticket_project_lookup(requests: DataFrame, tickets: DataFrame, keys: str = "dev_keys") -> DataFrame:
    """The first listed ticket's project overrides the given one."""
    asked = requests.withColumn("_first", F.get(keys, F.lit(0)))
    homes = only_keys(tickets, asked, "_first").select(F.col("key").alias("_first"), F.col("project").alias("_home"))
    return (asked.join(homes, "_first", "left")
            .withColumn("project", F.coalesce("_home", "project")).drop("_first", "_home"))


def link_edges(created: DataFrame, key: str = "key", keys: str = "dev_keys", link_type: str = V.DEFAULT_LINK_TYPE) -> DataFrame:
    """One edge per (new ticket, development ticket)."""
    return created.select(F.col(key).alias("src"), F.explode(keys).alias("dst"), F.lit(link_type).alias("link_type"))


def validate_transition(requests: DataFrame, transitions: DataFrame) -> DataFrame:
    """The first transition whose name equals the requested status, case ignored.

    A miss lists the names its ticket offers; their number is that of one workflow state's moves.
    """
    by_name = (transitions.groupBy("ticket_key", F.lower("name").alias("_name"))
               .agg(F.min(F.struct("pos", "id", "name")).alias("t")))
    matched = (requests.withColumn("_name", F.lower("new_status")).join(by_name, ["ticket_key", "_name"], "left")
               .select("ticket_key", "new_status", F.col("t.id").alias("transition_id"), F.col("t.name").alias("target")))
    missed = matched.where("transition_id IS NULL").select("ticket_key").distinct()
    offered = (transitions.join(missed, "ticket_key", "left_semi").groupBy("ticket_key")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda t: t["name"]),
                                 ", ").alias("_offered")))
    return (matched.join(offered, "ticket_key", "left")
            .withColumn("available", F.when(F.col("transition_id").isNull(), F.coalesce("_offered", F.lit(""))))
            .drop("_offered"))


def story_points_field(fields: DataFrame, default: str = V.STORY_POINTS_FIELD) -> DataFrame:
    """Id of the first field with a known name, else the default. One row."""
    known = X.norm("name").isin(*V.STORY_POINTS_NAMES)
    first = F.min(F.when(known, F.struct("pos", "id")))["id"]
    return fields.agg(F.coalesce(first, F.lit(default)).alias("field_id"))


def _resolve_or_reject(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Adds ``assignee_id`` and, for a name nobody bears, ``_user_error``."""
    visible = people.first_visible_users(users).scalar()
    asked = F.coalesce(F.col("assignee"), F.lit("")) != ""
    resolved = people.resolve_users_simple(requests, users, "assignee").withColumn("_visible", visible)
    return (resolved.withColumn("_user_error", F.when(asked & F.col("accountId").isNull(), people.not_found_message(
        F.col("assignee"), F.col("_visible"))))
        .withColumnRenamed("accountId", "assignee_id").drop("_visible"))


def _outcome(df: DataFrame, error: Column) -> DataFrame:
    return df.withColumn("error", error).withColumn("accepted", F.col("error").isNull())


# -- builders ------------------------------------------------------------------------


def build_ticket_rows(requests: DataFrame, users: DataFrame, epics: DataFrame, project_sprints: DataFrame, domain: str,
                      min_ratio: float | None = V.MIN_TITLE_RATIO) -> DataFrame:
    """Ticket rows from new-ticket requests.

    A name nobody bears leaves the ticket unassigned with a note; so does an epic title nobody uses. (A
    second, unranked search cannot help: the ranked one already tries the raw name on every user.)
    """
    with_user = people.resolve_users_ranked(requests, users, domain, "assignee", pass_ids="tool")
    with_epic = E.resolve_epics(with_user, epics, "epic_link", min_ratio)
    sprint_of = project_sprints.select("project", F.col("sprint_id").alias("_sprint"))
    asked_user = F.coalesce(F.col("assignee"), F.lit("")) != ""
    asked_epic = F.coalesce(F.col("epic_link"), F.lit("")) != ""
    epic_note = (F.when(F.col("tier") == "key", None)
                 .when(F.col("epic_key").isNotNull(), F.concat(F.lit("linked to "), "epic_key", F.lit(" for '"), "epic_link", F.lit("'")))
                 .when(asked_epic, F.concat(F.lit("epic '"), "epic_link", F.lit("' not found in "), X.norm_upper("project"))))
    return with_epic.join(sprint_of, "project", "left").select(
        "request_id", "project", "summary",
        F.coalesce("description", F.lit("")).alias("description"),
        _default("issue_type", V.NEW_TICKET_TYPE).alias("issue_type"),
        F.col("accountId").alias("assignee_id"),
        "epic_key",
        _default("priority", V.NEW_TICKET_PRIORITY).alias("priority"),
        X.positive_or_null("story_points").alias("story_points"),
        F.when(F.coalesce("assign_active_sprint", F.lit(True)), F.col("_sprint")).alias("sprint_id"),
        _default("status", V.NEW_TICKET_STATUS).alias("status"),
        F.when(asked_user & F.col("accountId").isNull(), "unassigned; provide accountId to assign").alias("assignee_note"),
        epic_note.alias("epic_note"))


def build_epic_rows(requests: DataFrame, users: DataFrame) -> DataFrame:
    resolved = _resolve_or_reject(requests, users)
    return _outcome(resolved, F.col("_user_error")).select(
        "request_id", "project", "summary", F.coalesce("description", F.lit("")).alias("description"),
        F.lit(V.EPIC_TYPE).alias("issue_type"), "assignee_id", "accepted", "error")


def build_deployment_rows(requests: DataFrame, tickets: DataFrame, users: DataFrame, epics: DataFrame,
                          project_sprints: DataFrame, base_url: str, epic_name: str = V.STANDARD_EPIC_NAME) -> DataFrame:
    """Deployment tickets: project of the first development ticket, standard title, epic and description."""
    placed = ticket_project_lookup(_resolve_or_reject(requests, users), tickets)
    standard = E.match_standard_epic(placed, epics, epic_name)
    sprint_of = project_sprints.select("project", "sprint_id")
    titled = (placed.withColumn("summary", X.deployment_title("title", "project", "dev_keys"))
              .join(standard, "project", "left").join(sprint_of, "project", "left"))
    no_title = F.when(F.col("summary").isNull(), "no title and no development tickets")
    return _outcome(titled, F.coalesce("_user_error", no_title)).select(
        "request_id", "project", "summary",
        X.deployment_description("description", "pr_link", "qa_contacts", "qa_instructions", "dev_keys", base_url).alias("description"),
        F.lit(V.NEW_TICKET_TYPE).alias("issue_type"), "assignee_id", "epic_key", F.col("new_title").alias("new_epic_title"),
        _default("priority", V.NEW_TICKET_PRIORITY).alias("priority"),
        X.positive_or_null("story_points").alias("story_points"), "sprint_id",
        F.lit(V.NEW_TICKET_STATUS).alias("status"), "dev_keys", "accepted", "error")


def _last_text(c: str) -> Column:
    """The last non-empty value in request order; edits with nothing in the column do not count."""
    return F.max(F.when(F.col(c) != "", F.struct("seq", c)))[c].alias("_" + c)


def apply_edits(tickets: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited tickets after all edits in ``seq`` order; empty fields change nothing."""
    fields = ["summary", "description", "priority"]
    latest = edits.groupBy(F.col("ticket_key").alias("key")).agg(*[_last_text(c) for c in fields])
    current = only_keys(tickets, latest, "key").select("key", *fields, F.lit(True).alias("_known"))
    joined = latest.join(current, "key", "left")
    nothing = F.coalesce(*["_" + c for c in fields]).isNull()
    error = F.when(F.col("_known").isNull(), "no such ticket").when(nothing, "No fields provided to update")
    return _outcome(joined, error).select(
        "key", *[F.coalesce("_" + c, c).alias(c) for c in fields], "accepted", "error")


def apply_assignments(tickets: DataFrame, assignments: DataFrame, users: DataFrame) -> DataFrame:
    """Tickets with their new assignee; of several requests for a ticket the last one that resolves wins."""
    resolved = _resolve_or_reject(assignments, users)
    per_ticket = resolved.groupBy(F.col("ticket_key").alias("key")).agg(
        F.max(F.when(F.col("assignee_id").isNotNull(), F.struct("seq", "assignee_id")))["assignee_id"].alias("_new"),
        F.max(F.struct("seq", "_user_error"))["_user_error"].alias("_user_error"))
    current = only_keys(tickets, per_ticket, "key").select("key", "assignee_id", F.lit(True).alias("_known"))
    joined = per_ticket.join(current, "key", "left")
    error = F.when(F.col("_known").isNull(), "no such ticket").when(
        F.col("_new").isNull(), F.coalesce("_user_error", F.lit("no assignee given")))
    return _outcome(joined, error).select(
        "key", F.coalesce("_new", "assignee_id").alias("assignee_id"), F.col("assignee_id").alias("old_assignee_id"),
        "accepted", "error")


def apply_transitions(tickets: DataFrame, requests: DataFrame, transitions: DataFrame) -> DataFrame:
    """Tickets with their new status, or the moves they offer instead."""
    checked = validate_transition(requests, transitions)
    joined = checked.withColumnRenamed("ticket_key", "key").join(
        only_keys(tickets, requests, "ticket_key").select("key", F.col("status").alias("old_status"), F.lit(True).alias("_known")), "key", "left")
    error = F.when(F.col("_known").isNull(), "no such ticket").when(
        F.col("transition_id").isNull(), F.concat(F.lit("No transition to '"), "new_status", F.lit("'. Available: "), "available"))
    return _outcome(joined, error).select(
        "key", "old_status", F.when(F.col("error").isNull(), F.col("target")).otherwise(F.col("old_status")).alias("status"),
        "transition_id", "accepted", "error")
