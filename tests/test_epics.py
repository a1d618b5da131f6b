import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest

from conftest import rows
from trackspan.operators import epics as E, lookup

EPIC = "key string, project string, summary string, created timestamp_ntz"
T0 = datetime(2024, 1, 1)
WORDS = "login page error data export import user admin billing invoice mobile Search".split()


def epics_table(spark, *epics):
    """Listed oldest first."""
    return spark.createDataFrame([(k, p, s, T0 + timedelta(hours=i)) for i, (k, p, s) in enumerate(epics)], EPIC)


def random_epics(n, seed):
    rng = random.Random(seed)
    return [(f"E-{i:03}", "HOT" if i % 3 == 0 else rng.choice("PQ"),
             rng.choice([" ".join(rng.choices(WORDS, k=rng.randint(1, 5))), "", None, "Login Page "])) for i in range(n)]


def random_queries(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 5)))
        mangled = "".join(c for c in text if rng.random() > 0.3)
        out.append((i, rng.choice(["HOT", "P", "Q", "NONE", " p "]), rng.choice([text, mangled, mangled + " zz", text[3:9], "abc-12", "  ", None])))
    return out


def newest(epics, project):
    return [(k, (s or "").strip().lower()) for k, p, s in reversed(epics) if p == project and (s or "").strip()]


def by_hand(epics, project, title, min_ratio=0.5):
    q, pool = (title or "").strip().lower(), newest(epics, project.strip().upper())
    if not q:
        return None, None
    tiers = {"contains": [k for k, s in pool if q in s or s in q],
             "words": [k for k, s in pool if 2 * len(set(q.split()) & set(s.split())) >= len(set(q.split()))]}
    for tier, hits in tiers.items():
        if hits:
            return hits[0], tier
    ratios = [(SequenceMatcher(None, q, s).ratio(), -i, k) for i, (k, s) in enumerate(pool)]
    best = max(ratios, default=(0, 0, None))
    return (best[2], "ratio") if best[0] >= min_ratio and best[2] else (None, None)


@pytest.mark.parametrize("tile", [2000, 7])
def test_resolution_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE_TITLES", tile)
    monkeypatch.setattr(E, "TILE_QUERIES", max(2, tile // 3))
    monkeypatch.setattr(lookup, "NEAR", 500 if tile > 100 else 3)
    epics, queries = random_epics(150, 1), random_queries(150, 2)
    got = E.resolve_epics(spark.createDataFrame(queries, "query_id long, project string, title string"), epics_table(spark, *epics))
    found = {r.query_id: (r.epic_key, r.tier) for r in got.collect()}
    assert found == {i: ((t, "key") if t == "abc-12" else by_hand(epics, p, t)) for i, p, t in queries}
    assert {"contains", "words", "ratio", "key", None} == {t for _, t in found.values()}


def test_half_of_the_words_is_enough(spark):
    e = epics_table(spark, ("E-1", "P", "alpha beta"))
    q = spark.createDataFrame([(1, "P", "zz alpha yy beta"), (2, "P", "zz alpha yy xx")], "query_id long, project string, title string")
    assert rows(E.resolve_epics(q, e, min_ratio=None), "query_id", "tier") == [(1, "words"), (2, None)]


@pytest.mark.parametrize("tile,k", [(2000, 4), (9, 4), (9, 1)])
def test_topk_against_all_pairs(spark, monkeypatch, tile, k):
    monkeypatch.setattr(E, "TILE_TITLES", tile)
    monkeypatch.setattr(E, "TILE_QUERIES", max(2, tile // 2))
    epics = random_epics(120, 3)
    queries = [(i, p if i % 4 else None, t) for i, p, t in random_queries(60, 4) if t != "abc-12"]
    got = {}
    for r in E.epic_title_topk(spark.createDataFrame(queries, "query_id long, project string, title string"), epics_table(spark, *epics), limit=k).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.epic_key, r.score)
    want = {}
    for i, p, t in queries:
        q = (t or "").strip().lower()
        pool = [(key, (s or "").strip().lower()) for key, pr, s in reversed(epics) if p is None or pr == p.strip().upper()]
        if q and pool:
            scored = [(max(SequenceMatcher(None, q, s).ratio(), float(q in s)), -n, key) for n, (key, s) in enumerate(pool)]
            want[i] = {n + 1: (key, score) for n, (score, _, key) in enumerate(sorted(scored, reverse=True)[:k])}
    assert got == want


def test_hot_title_does_not_crowd_one_tile(spark):
    """Many epics under one title: only the first k of them can rank, and they do."""
    e = epics_table(spark, *[(f"E-{i:03}", "P", "same title") for i in range(300)])
    q = spark.createDataFrame([(1, "P", "sane titel")], "query_id long, project string, title string")
    assert [r.epic_key for r in E.epic_title_topk(q, e, limit=3).orderBy("rank").collect()] == ["E-299", "E-298", "E-297"]


def test_standard_epic(spark):
    e = epics_table(spark, ("A-1", "A", "Bugs and Configuration Overflow"), ("A-2", "A", " bugs AND configuration"), ("A-3", "A", "Configuration of Bugs"),
                    ("B-1", "B", "(B) Bugs and Configuration"), ("B-2", "B", "old bugs"), ("C-1", "C", "configuration"))
    projects = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "project string")
    assert rows(E.match_standard_epic(projects, e)) == [
        ("A", "A-2", "exact", None), ("B", "B-1", "partial", None), ("C", None, "create", "(C) Bugs and Configuration"),
        ("D", None, "create", "(D) Bugs and Configuration")]
    assert rows(E.standard_epics_to_create(projects, e), "project", "description")[0] == (
        "C", "Auto-created epic for deployment & configuration tickets in C")


def test_list_is_newest_first(spark):
    e = epics_table(spark, ("A-1", "A", "x"), ("B-1", "B", "y"), ("A-2", "A", "z")).selectExpr(
        "*", "'' description", "'' status", "'' assignee", "'' reporter", "created updated")
    assert [r.key for r in E.list_epics(e).collect()] == ["A-2", "B-1", "A-1"]
    assert [r.key for r in E.list_epics(e, "A").collect()] == ["A-2", "A-1"]


def test_equal_titles_are_scored_once(spark, monkeypatch):
    """A title that many epics bear, some under one key, goes to the similarity search as one row; its epics come back."""
    sent, best = [], E._best_titles
    monkeypatch.setattr(E, "_best_titles", lambda asked, titles, *a: sent.append(titles.count()) or best(asked, titles, *a))
    e = epics_table(spark, *[(f"E-{i:03}", "P", "same title") for i in range(40)], ("E-900", "P", "sane titel"), ("E-900", "P", "sane titel"), ("E-901", "P", "other"))
    q = spark.createDataFrame([(1, "P", "sane title"), (2, None, "samx title")], "query_id long, project string, title string")
    got = E.epic_title_topk(q, e, limit=5).groupBy("query_id", "rank", "epic_key").count().orderBy("query_id", "rank").collect()
    assert sent == [6]  # three titles in the project's scope and in that of all
    assert [r.epic_key for r in got if r.query_id == 2] == ["E-039", "E-038", "E-037", "E-036", "E-035"]
    # Both rows of a key that comes twice take a place, and each meets both names.
    assert [(r.epic_key, r["count"]) for r in got if r.query_id == 1] == [("E-900", 2), ("E-900", 2), ("E-039", 1), ("E-038", 1), ("E-037", 1)]


def test_bounds_of_a_tile_are_sums_of_lesser_counts():
    import numpy as np
    from trackspan.functions import ratio as R
    rnd = random.Random(9)
    texts = ["", "a" * 3000, *["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 30))) for _ in range(40)]]
    for part in R.profiles(texts)[1:]:
        assert (R.shared_counts(part[:7], part) == np.minimum(part[:7, None, :], part[None, :, :]).sum(axis=2)).all()
    bounds, _ = R.tile_bounds(R.profiles(texts[:7]), R.profiles(texts))
    assert all(SequenceMatcher(None, a, b).ratio() <= bounds[i][j] + 1e-12 for i, a in enumerate(texts[2:7], 2) for j, b in enumerate(texts))
