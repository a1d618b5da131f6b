import random
import re

import pytest

from conftest import rows
from trackspan.operators import lookup, people as P, tickets as T

USER = "pos long, accountId string, displayName string, emailAddress string, active boolean"
DOMAIN = "d.io"


def users_table(spark, *people):
    return spark.createDataFrame([(i, f"id{i}", n, e, True) for i, (n, e) in enumerate(people)], USER)


def random_people(n, seed):
    rng = random.Random(seed)
    first, last = ["ann", "anna", "bo", "chris", "system", "Jo"], ["lee", "leeds", "o'neil", "x", ""]
    out = []
    for _ in range(n):
        f, l = rng.choice(first), rng.choice(last)
        name = rng.choice([f"{f} {l}", f"{l} {f}".strip(), f.upper(), None])
        mail = rng.choice([f"{f}.{l}@d.io", f"{f}@d.io", f"{f[0]}{l}@d.io", "", None])
        out.append((name, mail))
    return out


def random_queries(n, seed):
    rng = random.Random(seed)
    pool = ["ann", "ANN", " ann lee ", "anna leeds", "bo", "chris o'neil", "zed", "zed lee", "lee", "x", "a", "!!", "", None, "ann.lee@d.io",
            "jo !!", "e", "nn le", "chris x lee", "@d.io", "id:none"]
    return [(i, rng.choice(pool)) for i in range(n)]


def ranked_by_hand(people, query):
    """Smallest (candidate, user) pair over an explicit table of all matches."""
    q = (query or "").strip().lower()
    if not q:
        return None
    parts = [re.sub("[^a-z0-9]", "", w) for w in q.split()]
    f, l = parts[0], parts[-1] if len(parts) > 1 else ""
    wanted = [q] if "@" in q else []
    wanted += [f"{f}@{DOMAIN}"] if f else []
    wanted += [f"{x}@{DOMAIN}" for x in (f"{f}.{l}", f + l, f"{f}_{l}", f[:1] + l)] if f and l else []
    wanted += [q]
    hits = []
    for u, (name, mail) in enumerate(people):
        name, mail = (name or "").lower(), (mail or "").lower()
        hits += [(c, u) for c, w in enumerate(wanted) if w in name or w in mail]
        if f and (name.startswith(f) if not l else f in name and l in name):
            hits.append((0, u))
    return f"id{min(hits)[1]}" if hits else None


@pytest.mark.parametrize("near", [500, 2])
def test_ranked_resolution_against_all_matches(spark, monkeypatch, near):
    monkeypatch.setattr(lookup, "NEAR", near)
    people, queries = random_people(60, 4), random_queries(80, 5)
    q = spark.createDataFrame(queries, "query_id long, q string")
    got = {r.query_id: r.accountId for r in P.resolve_users_ranked(q, users_table(spark, *people), DOMAIN).collect()}
    assert got == {i: ranked_by_hand(people, text) for i, text in queries}
    assert None in got.values() and len(set(got.values())) > 4


def test_candidate_order_beats_user_order(spark):
    u = users_table(spark, ("Zed", "ann.lee@d.io"), ("Zed", "ann@d.io"))
    q = spark.createDataFrame([("ann lee",)], "q string")
    assert rows(P.resolve_users_ranked(q, u, DOMAIN), "accountId") == [("id1",)]


def test_account_id_variants(spark):
    u = users_table(spark, ("Ann", "ann@d.io"))
    q = spark.createDataFrame([("557058:x",), ("5dzz",)], "q string")
    assert rows(P.resolve_users_ranked(q, u, DOMAIN, pass_ids="search"), "accountId") == [("557058:x",), ("5dzz",)]
    assert rows(P.resolve_users_ranked(q, u, DOMAIN, pass_ids="tool"), "accountId") == [("557058:x",), (None,)]
    assert rows(P.resolve_users_simple(q, u), "accountId") == [("557058:x",), (None,)]


def test_simple_resolution_against_all_matches(spark):
    people, queries = random_people(60, 6), random_queries(60, 7)

    def by_hand(q):
        if not q:
            return None
        return next((f"id{i}" for i, (n, m) in enumerate(people) if q.lower() in (m or "").lower() or q.lower() in (n or "").lower()), None)

    q = spark.createDataFrame(queries, "query_id long, q string")
    got = {r.query_id: r.accountId for r in P.resolve_users_simple(q, users_table(spark, *people)).collect()}
    assert got == {i: by_hand(text) for i, text in queries}


def test_hot_query_is_complete(spark):
    """A third of all names share one word: every count and the first match stay exact."""
    people = [(f"hot name {i}" if i % 3 == 0 else f"cold {i}", "") for i in range(900)]
    q = spark.createDataFrame([(i, "hot name") for i in range(30)] + [(99, "cold 1")], "query_id long, q string")
    u = users_table(spark, *people)
    assert {r.accountId for r in P.resolve_users_simple(q, u).where("query_id < 99").collect()} == {"id0"}
    found = P.search_users(q, u)
    assert found.where("query_id < 99").groupBy("query_id").count().where("count <> 10").count() == 0
    assert {r.overflow for r in found.where("query_id < 99").collect()} == {290}


def test_search_users_against_all_matches(spark):
    people, queries = random_people(80, 8), random_queries(40, 9)
    got = {}
    for r in P.search_users(spark.createDataFrame(queries, "query_id long, q string"), users_table(spark, *people), limit=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.find_pos, r.pos, r.overflow)
    want = {}
    for i, text in queries:
        q = (text or "").strip().lower()
        hits = sorted((((n or "").lower().find(q), u) for u, (n, m) in enumerate(people)
                       if "system" not in (n or "").lower() and (q in (n or "").lower() or q in (m or "").lower()))) if q else []
        if hits:
            want[i] = {k + 1: (*h, max(0, len(hits) - 5)) for k, h in enumerate(hits[:5])}
    assert got == want


def test_bots_and_first_visible(spark):
    u = users_table(spark, ("Slack Bot", ""), (None, "x@d.io"), ("Ann", ""), ("Bo", ""))
    assert rows(P.exclude_bot_users(u), "pos") == [(1,), (2,), (3,)]
    assert rows(P.first_visible_users(u.where("pos <> 1"), 2)) == [("Slack Bot, Ann",)]


def test_filter_assignee_any(spark):
    u = users_table(spark, ("Ann Lee", "ann@d.io"), ("Bo", "bo@d.io"))
    t = spark.createDataFrame([("A", "id0"), ("B", "id1"), ("C", "5dq"), ("D", None), ("E", "zed")], "key string, assignee_id string")
    tokens = spark.createDataFrame([("ann",), ("5dq",), ("zed",)], "q string")
    assert rows(T.filter_assignee_any(t, tokens, u, DOMAIN), "key") == [("A",), ("C",), ("E",)]


def test_regex_and_literal(spark):
    t = spark.createDataFrame([("1", "A.b"), ("2", "axb"), ("3", "c")], "key string, assignee string")
    assert T.assignee_drilldown(t, "a.B").columns == ["key"]
    assert rows(T.assignee_drilldown(t, "a.B")) == [("1",), ("2",)]
    assert rows(T.assignee_contains(t, " A.B "), "key") == [("1",)]


def test_search_tickets_bound_is_day_granular(spark):
    from datetime import datetime
    t = spark.createDataFrame([("1", datetime(2024, 1, 1)), ("2", datetime(2023, 12, 31, 23, 59))], "key string, created timestamp_ntz").selectExpr(
        "*", "'s' summary", "'Open' status", "'x' assignee", "'id' assignee_id")
    assert rows(T.search_tickets(t, "status = 'Open'", "2024-06-29", "u/"), "key", "url") == [("1", "u/browse/1")]
    assert T.search_tickets(t, "true", "2024-06-29", "u", bounded=False).count() == 2
    nobody = spark.createDataFrame([("other",)], "accountId string")
    assert T.search_tickets(t, "true", "2024-06-29", "u", accounts=nobody).count() == 0
