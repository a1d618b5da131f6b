"""Active sprint per project and sprint membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..staging import stage
from . import lookup


def sprint_number() -> Column:
    """The sprint id, else the last part of its ``self`` link."""
    return F.coalesce(F.col("id").cast("string"), X.blank_to_null(F.substring_index("self", "/", -1)))


def _first_active(boards: DataFrame, sprints: DataFrame) -> DataFrame:
    """Per board its first active sprint, null when it has none."""
    active = (sprints.where("state = 'active'").withColumn("sprint_id", sprint_number())
              .groupBy("board_id").agg(F.min(F.struct("id", "self", "sprint_id", "name")).alias("s"))
              .select("board_id", F.col("s.sprint_id").alias("sprint_id"), F.col("s.name").alias("sprint_name")))
    return boards.join(active, F.col("id") == F.col("board_id"), "left").select(
        "id", F.col("name").alias("board_name"), "type", "sprint_id", "sprint_name")


def _first_choice(condition: Column | None = None) -> Column:
    has_sprint = F.col("sprint_id").isNotNull()
    return F.min(F.when(has_sprint if condition is None else has_sprint & condition,
                        F.struct("id", "board_name", "sprint_id", "sprint_name")))


def active_sprint(projects: DataFrame, boards: DataFrame, sprints: DataFrame, tickets: DataFrame) -> DataFrame:
    """First board, in id order, with an active sprint, per project.

    The boards looked at are those named after the project when it has tickets in sprints, else the scrum
    boards, else all boards. The last two sets do not depend on the project and are one value.
    """
    with_sprint = _first_active(boards, sprints)
    keys = projects.select(F.col("key").alias("project")).distinct()
    in_sprints = tickets.where("sprint_id IS NOT NULL").select("project").distinct()
    asked = keys.join(in_sprints, "project", "left_semi").withColumn("_needle", F.upper("project"))
    named = (lookup.occurrences(with_sprint.withColumn("_name", F.upper("board_name")), "_name", asked, "_needle")
             .groupBy("_needle").agg(_first_choice().alias("own")))
    own = asked.join(named, "_needle").select("project", "own", F.lit(True).alias("has_own"))
    shared = with_sprint.agg(
        F.bool_or(F.col("type") == "scrum").alias("any_scrum"),
        _first_choice(F.col("type") == "scrum").alias("scrum"),
        _first_choice().alias("any")).select(F.expr("IF(coalesce(any_scrum, false), scrum, any)").alias("s")).scalar()
    chosen = (keys.join(own, "project", "left").withColumn("_shared", shared)
              .withColumn("s", F.when(F.col("has_own"), F.col("own")).otherwise(F.col("_shared")))
              .select("project", F.col("s.id").alias("board_id"), F.col("s.board_name").alias("board_name"),
                      F.col("s.sprint_id").alias("sprint_id"), F.col("s.sprint_name").alias("sprint_name")))
    # Staged, because tickets are joined to it: Spark sees its real size and need not shuffle them by project.
    return stage(chosen, "sprints")


def sprint_membership(issues: DataFrame, project_sprints: DataFrame) -> DataFrame:
    """Issue keys with the sprint they join; ``added`` is false where the project has no active sprint."""
    chosen = project_sprints.select("project", "sprint_id")
    return issues.select("key", "project").join(chosen, "project", "left").select(
        "key", "project", "sprint_id", F.col("sprint_id").isNotNull().alias("added"))
