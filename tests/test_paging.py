import random

import pytest

from conftest import rows
from trackspan.operators import people as P
from trackspan.sources import pages, paging
from trackspan.sources.schemas import PAGE, USER_PAGE

LINKED = "export string, token string, next string, size long, checksum long, records array<string>"


def chain(export, tokens, sizes=None, last=None):
    """Pages that answer ``tokens`` in order; the last one names ``last``."""
    following = [*tokens[1:], last]
    return [(export, t, n, s, hash((t, s)) % 10**9, [f"{t}{i}" for i in range(s)])
            for t, n, s in zip(tokens, following, sizes or [2] * len(tokens))]


def places(spark, data):
    found, problems = paging.page_places(spark.createDataFrame(data, LINKED))
    return {(r.export, r.token): (r.page, r.offset) for r in found.collect()}, rows(problems, "export", "problem", "token", "pages")


def test_places_of_chains_of_any_length(spark):
    rnd = random.Random(1)
    data, want = [], {}
    for n in (1, 2, 3, 4, 5, 8, 31, 64, 65):
        tokens = ["", *(f"t{rnd.random()}" for _ in range(n - 1))]
        sizes = [rnd.randint(0, 4) for _ in tokens]
        data += chain(f"e{n}", tokens, sizes)
        want |= {(f"e{n}", t): (i, sum(sizes[:i])) for i, t in enumerate(tokens)}
    rnd.shuffle(data)
    assert places(spark, data) == (want, [])


def test_what_is_wrong_is_reported(spark):
    data = [*chain("gap", ["", "a"], last="b"), *chain("gap", ["c", "d"]),
            *chain("loop", ["", "a", "b", "c"], last="a"), *chain("self", [""], last=""),
            *chain("twice", ["", "a", "b"]), ("twice", "a", "b", 1, 7, ["other"]),
            *chain("copy", ["", "a"]), *chain("copy", ["", "a"]), *chain("headless", ["a", "b"])]
    found, problems = places(spark, data)
    assert problems == [
        ("gap", "missing", "b", 1), ("gap", "unreached", "c", 1), ("gap", "unreached", "d", 1), ("headless", "headless", "", 2),
        ("headless", "unreached", "a", 1), ("headless", "unreached", "b", 1), ("loop", "looping", "a", 1), ("self", "looping", "", 1),
        ("twice", "repeated", "a", 2)]
    assert [found["loop", t] for t in ("", "a", "b", "c")] == [(0, 0), (1, 2), (2, 4), (3, 6)]
    assert found["copy", "a"] == (1, 2) and ("gap", "c") not in found


def test_records_count_through_all_exports(spark):
    data = [*chain("b", ["", "x"], [1, 2]), *chain("a", ["", "y"], [2, 0]), *chain("a", ["", "y"], [2, 0])]
    records, problems = paging.positioned_records(spark.createDataFrame(data, LINKED))
    assert rows(records, "pos", "export", "record") == [(0, "a", "0"), (1, "a", "1"), (2, "b", "0"), (3, "b", "x0"), (4, "b", "x1")]
    empty = spark.createDataFrame([], LINKED)
    assert paging.positioned_records(empty)[0].count() == 0 and paging.page_places(empty)[1].count() == 0


def test_users_of_pages_feed_the_resolvers(spark, tmp_path):
    import json

    def person(i):
        return {"accountId": f"id{i}", "displayName": f"Ann N{i}", "active": True}

    (tmp_path / "u").mkdir()
    found = [{"startAt": 4, "maxResults": 2, "values": [person(4)]}, {"maxResults": 2, "values": [person(0), person(1)]},
             {"startAt": 2, "maxResults": 2, "values": [person(2), person(3)]}]
    (tmp_path / "u" / "p.json").write_text("".join(json.dumps(p) + "\n" for p in found))
    users = pages.read_user_pages(spark, str(tmp_path / "u"))
    assert rows(users, "pos", "accountId") == [(i, f"id{i}") for i in range(5)]
    asked = spark.createDataFrame([("ann",), ("n3",)], "q string")
    assert rows(P.resolve_users_simple(asked, users), "q", "accountId") == [("ann", "id0"), ("n3", "id3")]
    broken = spark.createDataFrame([(0, 2, [("a", "", "", True), ("b", "", "", True)], None)], USER_PAGE)
    with pytest.raises(paging.BrokenExport, match="missing page '2'"):
        pages.ordered_users(broken)


def test_issue_pages_end_where_they_say(spark):
    def page(token, following, last, *keys):
        return ([(k, None) for k in keys], last, following, token, "e")

    data = [page("b", "never", True, "K-3"), page(None, "a", False, "K-1"), page("a", "b", False, "K-2")]
    assert rows(pages.ordered_issues(spark.createDataFrame(data, PAGE)), "pos", "key") == [(0, "K-1"), (1, "K-2"), (2, "K-3")]
    # A page that does not say whether it is the last one is.
    lone = spark.createDataFrame([page(None, "a", None, "K-1")], PAGE)
    assert rows(pages.ordered_issues(lone), "pos", "key") == [(0, "K-1")]
    assert rows(pages.flatten_issues(pages.ordered_issues(lone)), "pos", "key", "assignee") == [(0, "K-1", "Unassigned")]
