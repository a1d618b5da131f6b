from datetime import datetime

import pytest

from conftest import rows
from trackspan.operators import changes as C, sprints as S
from trackspan.operators.chat import last_n_turns, message_events, reply_rows
from trackspan.sources.schemas import ACTIVITY
from pyspark.sql import functions as F


def df(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


@pytest.fixture
def users(spark):
    return df(spark, "pos long, accountId string, displayName string, emailAddress string, active boolean",
              (1, "id1", "Ann Lee", "ann@d.io", True), (2, "id2", "Bo Ek", "bo@d.io", True))


@pytest.fixture
def epics(spark):
    return df(spark, "key string, project string, summary string, created timestamp_ntz",
              ("E-1", "P", "Login page", datetime(2024, 1, 1)), ("E-2", "Q", "Bugs and Configuration", datetime(2024, 1, 1)))


def sprint_tables(spark, boards, sprints, tickets):
    return (df(spark, "id long, name string, type string", *boards),
            df(spark, "id long, board_id long, name string, state string, self string", *sprints),
            df(spark, "project string, sprint_id long", *tickets))


def active(spark, boards, sprints, tickets, keys=("P",)):
    b, s, t = sprint_tables(spark, boards, sprints, tickets)
    return {r.project: (r.board_id, r.sprint_id) for r in S.active_sprint(df(spark, "key string", *[(k,) for k in keys]), b, s, t).collect()}


def test_own_board_needs_sprint_tickets(spark):
    boards = [(1, "scrum one", "scrum"), (2, "the p board", "kanban")]
    sprints = [(11, 1, "a", "active", ""), (12, 2, "b", "active", ""), (10, 2, "c", "closed", "")]
    assert active(spark, boards, sprints, [("P", 5)]) == {"P": (2, "12")}
    assert active(spark, boards, sprints, [("P", None)]) == {"P": (1, "11")}


def test_own_board_without_active_sprint_does_not_fall_back(spark):
    boards = [(1, "scrum one", "scrum"), (2, "the p board", "kanban")]
    assert active(spark, boards, [(11, 1, "a", "active", "")], [("P", 5)]) == {"P": (None, None)}


def test_last_tier_and_id_from_link(spark):
    boards = [(3, "k", "kanban"), (4, "l", "kanban")]
    sprints = [(None, 4, "s", "active", "https://x/sprint/77")]
    assert active(spark, boards, sprints, [("P", 5)]) == {"P": (4, "77")}
    assert active(spark, [], [], [("P", 5)]) == {"P": (None, None)}


def test_board_names_match_as_substrings(spark):
    boards = [(1, "N_10 board", "kanban"), (2, "N_1 board", "kanban")]
    sprints = [(11, 1, "a", "active", ""), (12, 2, "b", "active", "")]
    assert active(spark, boards, sprints, [("N_1", 5), ("N_10", 5)], ("N_1", "N_10")) == {"N_1": (1, "11"), "N_10": (1, "11")}


def test_membership(spark):
    issues = df(spark, "key string, project string", ("K-1", "P"), ("K-2", "Q"))
    chosen = df(spark, "project string, sprint_id string", ("P", "7"), ("Q", None))
    assert rows(S.sprint_membership(issues, chosen)) == [("K-1", "P", "7", True), ("K-2", "Q", None, False)]


TRANSITIONS = [("K-1", "21", "Done", 1), ("K-1", "11", "Start", 0), ("K-1", "22", "DONE", 2)]


def test_transitions(spark):
    moves = df(spark, "ticket_key string, id string, name string, pos int", *TRANSITIONS)
    asked = df(spark, "ticket_key string, new_status string", ("K-1", "DONE"), ("K-1", "Nope"), ("K-9", "Done"))
    assert rows(C.validate_transition(asked, moves), "ticket_key", "new_status", "transition_id", "available") == [
        ("K-1", "DONE", "21", None), ("K-1", "Nope", None, "Start, Done, DONE"), ("K-9", "Done", None, "")]
    tickets = df(spark, "key string, status string", ("K-1", "Open"))
    assert rows(C.apply_transitions(tickets, asked, moves), "key", "status", "accepted") == [
        ("K-1", "Done", True), ("K-1", "Open", False), ("K-9", None, False)]


def test_story_points_field(spark):
    fields = df(spark, "pos int, id string, name string", (2, "f2", "Story point estimate"), (1, "f1", " STORY Points"), (0, "f0", "Other"))
    assert rows(C.story_points_field(fields)) == [("f1",)]
    assert rows(C.story_points_field(fields.where("pos = 0"))) == [("customfield_10016",)]
    assert rows(C.story_points_field(fields.where("false"))) == [("customfield_10016",)]


def test_edits_apply_in_order(spark):
    tickets = df(spark, "key string, summary string, description string, priority string", ("K-1", "old", "d", "Low"), ("K-2", "old", None, "Low"))
    edits = df(spark, "ticket_key string, seq int, summary string, description string, priority string",
               ("K-1", 1, "first", None, "High"), ("K-1", 2, "second", "", None), ("K-1", 3, "", None, ""), ("K-2", 1, None, "", None), ("K-3", 1, "x", None, None))
    assert rows(C.apply_edits(tickets, edits)) == [
        ("K-1", "second", "d", "High", True, None), ("K-2", "old", None, "Low", False, "No fields provided to update"),
        ("K-3", "x", None, None, False, "no such ticket")]


def test_assignments(spark, users):
    tickets = df(spark, "key string, assignee_id string", ("K-1", "old"), ("K-2", "old"))
    asked = df(spark, "ticket_key string, seq int, assignee string", ("K-1", 1, "ann"), ("K-1", 2, "BO"), ("K-2", 1, "zed"), ("K-3", 1, "ann"))
    got = rows(C.apply_assignments(tickets, asked, users), "key", "assignee_id", "accepted", "error")
    assert got == [("K-1", "id2", True, None),
                   ("K-2", "old", False, "User 'zed' not found. Available users: Ann Lee, Bo Ek..."),
                   ("K-3", "id1", False, "no such ticket")]


REQUEST = """request_id int, project string, summary string, description string, issue_type string, assignee string, epic_link string,
priority string, story_points double, assign_active_sprint boolean, status string"""


def test_ticket_rows(spark, users, epics):
    sprints = df(spark, "project string, sprint_id string", ("P", "7"))
    asked = df(spark, REQUEST, (1, "P", "s", None, None, "ann lee", "login", None, 0.0, None, None),
               (2, "P", "s", "d", "Bug", "zed", "qqqq", "High", 3.0, False, "Open"), (3, "Q", "s", "", "", "557058:9", "AB-1", "", None, True, ""),
               (4, "P", "s", None, None, None, "lgin pge", None, None, True, None))
    got = [tuple(r) for r in C.build_ticket_rows(asked, users, epics, sprints, "d.io").drop("summary", "description").orderBy("request_id").collect()]
    assert got == [
        (1, "P", "Task", "id1", "E-1", "Medium", None, "7", "To Do", None, "linked to E-1 for 'login'"),
        (2, "P", "Bug", None, None, "High", 3.0, None, "Open", "unassigned; provide accountId to assign", "epic 'qqqq' not found in P"),
        (3, "Q", "Task", "557058:9", "AB-1", "Medium", None, None, "To Do", None, None),
        (4, "P", "Task", None, "E-1", "Medium", None, "7", "To Do", None, "linked to E-1 for 'lgin pge'")]


def test_epic_rows(spark, users):
    asked = df(spark, "request_id int, project string, summary string, description string, assignee string",
               (1, "P", "s", None, None), (2, "P", "s", "d", "bo"), (3, "P", "s", "d", "zed"))
    assert rows(C.build_epic_rows(asked, users), "request_id", "issue_type", "assignee_id", "accepted", "error") == [
        (1, "Epic", None, True, None), (2, "Epic", "id2", True, None),
        (3, "Epic", None, False, "User 'zed' not found. Available users: Ann Lee, Bo Ek...")]


DEPLOYMENT = """request_id int, project string, dev_keys array<string>, title string, description string, assignee string, priority string,
pr_link string, qa_contacts string, qa_instructions string, story_points double"""


def test_deployment_rows(spark, users, epics):
    tickets = df(spark, "key string, project string", ("Q-1", "Q"))
    sprints = df(spark, "project string, sprint_id string", ("Q", "9"))
    asked = df(spark, DEPLOYMENT, (1, "P", ["Q-1", "P-2"], None, "", "ann", None, "x", None, None, None),
               (2, "P", [], None, "", None, None, None, None, None, None), (3, "P", [], "Ship", "go", "zed", "High", None, None, None, 1.0),
               (4, "P", ["ZZ-1"], "Ship", "go", None, "High", None, None, None, 1.0))
    built = C.build_deployment_rows(asked, tickets, users, epics, sprints, "https://t/")
    assert rows(built, "request_id", "project", "summary", "assignee_id", "epic_key", "new_epic_title", "sprint_id", "accepted") == [
        (1, "Q", "(Q) Deployment ticket for Q-1, P-2", "id1", "E-2", None, "9", True),
        (2, "P", None, None, None, "(P) Bugs and Configuration", None, False),
        (3, "P", "Ship", None, None, "(P) Bugs and Configuration", None, False),
        (4, "P", "Ship", None, None, "(P) Bugs and Configuration", None, True)]
    assert built.where("request_id = 1").first().description == "PR: x\n\nRelated development tickets:\n- https://t/browse/Q-1\n- https://t/browse/P-2"
    edges = C.link_edges(built.where("accepted").withColumn("key", F.concat(F.lit("D-"), "request_id")))
    assert rows(edges) == [("D-1", "P-2", "Relates"), ("D-1", "Q-1", "Relates"), ("D-4", "ZZ-1", "Relates")]


def activity(kind, text):
    return (kind, text, "m1", "https://c", ("conv",), ("u", "User"), ("b", "Bot"))


def test_messages_and_replies(spark):
    a = spark.createDataFrame([activity("message", " hi \n"), activity("message", " \t\n"), activity("typing", "x"), activity("message", None)], ACTIVITY)
    kept = message_events(a)
    assert rows(kept, "text") == [("hi",)]
    reply = reply_rows(kept, F.lit("ok")).first()
    assert (reply["from"].id, reply.recipient.id, reply.replyToId) == ("b", "u", "m1")
    assert reply.reply_url == "https://c/v3/conversations/conv/activities/m1"


def test_last_turns_of_a_hot_conversation(spark):
    turns = df(spark, "conv_id long, turn long, role string, text string", *[(0 if i % 3 else i, i, "user", "t") for i in range(300)])
    kept = last_n_turns(turns.repartition(5), 4)
    assert rows(kept.where("conv_id = 0"), "turn") == [(295,), (296,), (298,), (299,)]
    assert kept.groupBy("conv_id").count().where("count > 4").count() == 0
