import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from trackspan.operators.enrich import enrich
from trackspan.sources import pages


def issue(key, **fields):
    base = {"summary": key.lower(), "status": {"name": "Done"}, "project": {"key": "P"}, "issuetype": {"name": "Task"},
            "created": "2024-01-01T10:00:00.000+0500", "updated": "2024-01-03T10:00:00.000+0500"}
    return {"key": key, "fields": {**base, **fields}}


def write(path, *records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records))


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "p1.json", {"issues": [issue("P-1", assignee={"displayName": "Ann"}, priority={"name": "High"}), issue("P-2")],
                                 "isLast": False, "nextPageToken": "x"})
    write(tmp_path / "p2.json", {"issues": [issue("P-2", assignee={}, customfield_10014="E-1", customfield_10016=2.5)], "isLast": True},
          {"issues": [], "isLast": True})
    return str(tmp_path)


def test_pages_are_all_kept(spark, folder):
    flat = pages.flatten_issues(pages.read_issue_pages(spark, folder))
    assert rows(flat, "key", "assignee", "priority", "reporter", "epic_link", "story_points") == [
        ("P-1", "Ann", "High", "Unknown", None, None),
        ("P-2", "Unassigned", "None", "Unknown", "E-1", 2.5),
        ("P-2", "Unassigned", "None", "Unknown", None, None)]


def test_calendar_follows_the_wall_clock(spark, tmp_path):
    write(tmp_path / "p.json", {"issues": [issue("P-1", created="2024-01-01T01:00:00.000+0500")]})
    t = enrich(pages.flatten_issues(pages.read_issue_pages(spark, str(tmp_path))))
    row = t.select("created_date", F.unix_seconds("created").alias("s"), "created_local").first()
    assert str(row.created_date) == "2024-01-01" and row.created_local == datetime(2024, 1, 1, 1)
    assert row.s == 1704052800


def test_parse_equals_read(spark, folder):
    text = spark.read.text(folder)
    assert rows(pages.flatten_issues(pages.parse_issue_pages(text))) == rows(pages.flatten_issues(pages.read_issue_pages(spark, folder)))


def test_malformed_pages_fail(spark, tmp_path):
    (tmp_path / "p.json").write_text("{not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        pages.read_issue_pages(spark, str(tmp_path)).collect()


def test_epics_defaults(spark, tmp_path):
    write(tmp_path / "p.json", {"issues": [{"key": "E-1", "fields": {"summary": None, "created": "bad"}}]})
    epic = pages.flatten_epics(pages.read_issue_pages(spark, str(tmp_path))).first()
    assert (epic.summary, epic.description, epic.status, epic.assignee, epic.reporter, epic.project, epic.created) == (
        "", "", "Unknown", "Unassigned", "Unknown", "", None)


def test_users_projects_boards_sprints(spark, tmp_path):
    for name, record in {"u": {"accountId": "1", "active": False}, "p": {"key": "P", "name": "Pro", "id": "7", "lead": {"displayName": "Ann"}},
                         "b": {"id": 1, "name": "P board", "type": "scrum"}, "s": {"board_id": 1, "name": "S", "state": "active", "self": "x/77"}}.items():
        (tmp_path / name).mkdir()
        write(tmp_path / name / "x.json", record)
    at = str(tmp_path)
    assert rows(pages.read_users(spark, at + "/u")) == [("1", "", "", False)]
    assert rows(pages.read_projects(spark, at + "/p")) == [("P", "Pro", "7", "", "Ann")]
    assert rows(pages.read_boards(spark, at + "/b")) == [(1, "P board", "scrum")]
    assert rows(pages.read_sprints(spark, at + "/s")) == [(None, 1, "S", "active", "x/77")]
