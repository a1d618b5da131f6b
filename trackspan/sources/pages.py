"""Exported JSON records to flat tables.

Each ``read_*`` scans JSON files with a fixed schema, one record per line, and fails on a malformed
record instead of dropping it. Each ``parse_*`` does the same for a column of JSON text (a message bus or
a table of payloads). All pages are kept and nothing is de-duplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import values as V
from ..functions import metrics as M
from . import paging, schemas as S


def _scan(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """One struct per JSON text, expanded to its fields."""
    return df.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def issues(pages: DataFrame) -> DataFrame:
    """All issues of all pages. The outer form keeps the optimizer from parsing twice to pre-check sizes."""
    return pages.select(F.explode_outer("issues").alias("issue")).where("issue IS NOT NULL").select("issue.*")


def read_issue_pages(spark: SparkSession, path) -> DataFrame:
    return issues(_scan(spark, path, S.PAGE))


def parse_issue_pages(df: DataFrame, column: str = "value") -> DataFrame:
    return issues(parse_json(df, column, S.PAGE))


def ordered_issues(pages: DataFrame) -> DataFrame:
    """All issues of all pages with their position ``pos``; fails on an export whose pages do not form one chain."""
    linked = paging.token_pages(pages, "issues", F.col("export"))
    return paging.whole(paging.positioned_records(linked)).select("pos", "record.*")


def ordered_users(pages: DataFrame) -> DataFrame:
    """All user records of pages asked for by offset, with their position ``pos``; fails if a page is missing."""
    linked = paging.offset_pages(pages, "values", F.col("export"))
    return paging.whole(paging.positioned_records(linked)).select("pos", "record.*")


def _or(c: str, default) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def _times() -> list[Column]:
    return [
        M.parse_ts("fields.created").alias("created"),
        M.parse_ts("fields.updated").alias("updated"),
        M.local_ts("fields.created").alias("created_local"),
        M.local_ts("fields.updated").alias("updated_local"),
    ]


def _position(raw: DataFrame) -> list[str]:
    return ["pos"] if "pos" in raw.columns else []


def flatten_issues(raw: DataFrame) -> DataFrame:
    """Nested issues to ticket rows; instants for durations, wall clocks for calendar columns."""
    f = "fields."
    return raw.select(
        *_position(raw),
        "key",
        F.col(f + "summary").alias("summary"),
        F.col(f + "description").alias("description"),
        F.col(f + "status.name").alias("status"),
        _or(f + "assignee.displayName", V.DEFAULT_ASSIGNEE).alias("assignee"),
        F.col(f + "project.key").alias("project"),
        F.col(f + "issuetype.name").alias("issue_type"),
        _or(f + "priority.name", V.DEFAULT_PRIORITY).alias("priority"),
        _or(f + "reporter.displayName", V.DEFAULT_REPORTER).alias("reporter"),
        F.col(f + V.EPIC_LINK_FIELD).alias("epic_link"),
        F.col(f + V.STORY_POINTS_FIELD).alias("story_points"),
        *_times(),
    )


def flatten_epics(raw: DataFrame) -> DataFrame:
    f = "fields."
    return raw.select(
        "key",
        _or(f + "summary", "").alias("summary"),
        _or(f + "description", "").alias("description"),
        _or(f + "status.name", V.DEFAULT_EPIC_STATUS).alias("status"),
        _or(f + "assignee.displayName", V.DEFAULT_ASSIGNEE).alias("assignee"),
        _or(f + "reporter.displayName", V.DEFAULT_REPORTER).alias("reporter"),
        *_times(),
        _or(f + "project.key", "").alias("project"),
    )


def flatten_users(raw: DataFrame) -> DataFrame:
    """User rows, with the position of the record where the pages gave one."""
    return raw.select(
        *_position(raw),
        *[_or(c, "").alias(c) for c in ("accountId", "displayName", "emailAddress")],
        _or("active", True).alias("active"),
    )


def flatten_projects(raw: DataFrame) -> DataFrame:
    return raw.select("key", "name", "id", _or("description", "").alias("description"),
                      _or("lead.displayName", "").alias("lead"))


def read_users(spark: SparkSession, path) -> DataFrame:
    return flatten_users(_scan(spark, path, S.USER))


def read_user_pages(spark: SparkSession, path) -> DataFrame:
    """Users with their position, as the resolvers need them, from exported pages."""
    return flatten_users(ordered_users(_scan(spark, path, S.USER_PAGE)))


def read_ordered_issues(spark: SparkSession, path) -> DataFrame:
    return ordered_issues(_scan(spark, path, S.PAGE))


def read_projects(spark: SparkSession, path) -> DataFrame:
    return flatten_projects(_scan(spark, path, S.PROJECT))


def read_boards(spark: SparkSession, path) -> DataFrame:
    return _scan(spark, path, S.BOARD)


def read_sprints(spark: SparkSession, path) -> DataFrame:
    return _scan(spark, path, S.SPRINT)


def parse_activities(df: DataFrame, column: str = "value") -> DataFrame:
    """Chat activities from JSON text; a text that is not JSON gives a row of nulls."""
    return df.select(F.from_json(column, S.ACTIVITY).alias("_a")).select("_a.*")


def load_chat_history(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(S.CHAT_TURN).parquet(path)
