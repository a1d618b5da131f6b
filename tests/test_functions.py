from datetime import date, datetime
from difflib import SequenceMatcher
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from trackspan.functions import metrics as M, text as X
from trackspan.functions.ratio import profiles, title_ratio, upper_bounds

BASE = "https://t.example.com/"


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


@pytest.mark.parametrize("status,created,updated,days", [
    ("Done", datetime(2024, 1, 1, 12), datetime(2024, 1, 1), -1),
    ("Done", datetime(2024, 1, 1), datetime(2024, 1, 2, 23), 1),
    ("Open", datetime(2024, 1, 1), datetime(2024, 1, 9), None),
    ("Closed", None, datetime(2024, 1, 9), None),
    ("done", datetime(2024, 1, 1), datetime(2024, 1, 9), None),
])
def test_resolution_days_floor(spark, status, created, updated, days):
    assert one(spark, "s string, c timestamp_ntz, u timestamp_ntz", (status, created, updated),
               M.resolution_days("s", "c", "u")) == (days,)


def test_status_and_priority(spark):
    df = spark.createDataFrame([("done", "Highest"), ("Done", "Critical"), ("Blocked", None), ("Backlog", "Lowest"),
                                ("Development", "None"), (None, "Low")], "s string, p string")
    assert [tuple(r) for r in df.select(M.status_category("s"), M.priority_score("p"), M.is_resolved("s")).collect()] == [
        ("Other", 0, False), ("Resolved", 5, True), ("Other", 0, False), ("Pending", 1, False), ("Active", 0, False), ("Other", 2, False)]
    assert one(spark, "p string", ("Highest",), M.priority_score("p", {"Highest": 9})) == (9,)


def test_calendar(spark):
    c = "c timestamp_ntz"
    week = F.weekofyear("c")
    assert one(spark, c, (datetime(2021, 1, 3),), week) == (53,)
    assert one(spark, c, (datetime(2024, 12, 30),), week, M.calendar_month("c")) == (1, date(2024, 12, 1))
    assert one(spark, c, (datetime(2024, 1, 7, 23),), M.week_start("c")) == (date(2024, 1, 1),)


def test_parse_mixed_offsets(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00.000+0100",), ("2024-01-01T10:00:00.000+0200",), ("bad",), (None,)], "t string")
    got = [tuple(r) for r in df.select(F.unix_seconds(M.parse_ts("t")), M.local_ts("t")).collect()]
    ten = datetime(2024, 1, 1, 10)
    assert got == [(1704099600, ten), (1704096000, ten), (None, None), (None, None)]


def test_rounding_rates_and_trend(spark):
    assert one(spark, "a long, b long", (1, 16), M.round1(M.safe_pct("a", "b"))) == (6.2,)
    assert one(spark, "a long, b long", (1, 0), M.safe_pct("a", "b")) == (0.0,)
    for slope, want in [(2.6, 1.0), (-0.25, -0.25), (-7.0, -1.0), (None, 0.0)]:
        assert one(spark, "s double", (slope,), M.clamp_trend("s")) == (want,)


def test_trimming_is_not_limited_to_blanks(spark):
    text = " \t Mixed Case \n"
    assert one(spark, "t string", (text,), X.norm("t"), X.norm_upper("t"), X.words("t")) == (
        "mixed case", "MIXED CASE", ["Mixed", "Case"])
    assert one(spark, "t string", (None,), X.norm("t")) == ("",)


@pytest.mark.parametrize("name,want", [
    ("ana", ["ana@d.io", "ana"]),
    ("ana o'neil", ["ana@d.io", "ana.oneil@d.io", "anaoneil@d.io", "ana_oneil@d.io", "aoneil@d.io", "ana o'neil"]),
    ("ana b. diaz", ["ana@d.io", "ana.diaz@d.io", "anadiaz@d.io", "ana_diaz@d.io", "adiaz@d.io", "ana b. diaz"]),
    ("ana@x.io", ["ana@x.io", "anaxio@d.io"]),
    ("!!", ["!!"]),
    ("ana !!", ["ana@d.io", "ana !!"]),
])
def test_email_candidates(spark, name, want):
    df = spark.createDataFrame([(name,)], "q string").withColumns({"f": X.name_part("q", 1), "l": X.name_part("q", -1)})
    assert df.select(X.email_candidates("q", "f", "l", "d.io")).first()[0] == want


def test_ids_and_keys(spark):
    df = spark.createDataFrame([("557058:x",), ("5dzz",), ("5d8b8c8e1",), ("ann",), (None,)], "a string")
    assert [tuple(r) for r in df.select(X.is_account_id("a"), X.is_account_id("a", "search")).collect()] == [
        (True, True), (False, True), (True, True), (False, False), (False, False)]
    keys = spark.createDataFrame([(" abc-12 ",), ("A1-2",), ("ab-",), (None,)], "k string")
    assert [r[0] for r in keys.select(X.is_ticket_key("k")).collect()] == [True, False, False, False]
    assert one(spark, "k string", (" fiji-1, ,ds-2",), X.key_list("k")) == (["FIJI-1", "DS-2"],)
    assert one(spark, "x double", (0.0,), X.positive_or_null("x")) == (None,)
    assert one(spark, "k string", ("K-1",), X.browse_url(BASE, "k")) == ("https://t.example.com/browse/K-1",)


def test_deployment_text(spark):
    schema = "d string, pr string, qa string, ins string, keys array<string>, t string, p string"
    text = X.deployment_description("d", "pr", "qa", "ins", "keys", BASE)
    title = X.deployment_title("t", "p", "keys")
    assert one(spark, schema, ("", "x/1", None, "run it", ["A-1", "A-2"], None, "A"), text, title) == (
        "PR: x/1\n\nQA Instructions:\nrun it\n\nRelated development tickets:\n"
        "- https://t.example.com/browse/A-1\n- https://t.example.com/browse/A-2", "(A) Deployment ticket for A-1, A-2")
    assert one(spark, schema, ("hi", None, "ann", "", [], "", "A"), text, title) == ("hi\n\nQA: ann", None)


def test_report_line(spark):
    schema = "n string, t long, r long, a double, p double"
    line = X.report_line("n", "t", "r", "a", "p")
    assert one(spark, schema, ("ann", 16, 1, None, 6.25), line) == ("ann: total=16, resolved=1, avg_days=nan, rate=6.2%",)
    assert one(spark, schema, ("bob", 2, 2, 6.35, 100.0), line) == ("bob: total=2, resolved=2, avg_days=6.4, rate=100.0%",)


def test_words_and_positions(spark):
    assert one(spark, "q string, t string", ("a b c d", "x b d"), X.share_of_words(X.word_set("q"), X.word_set("t"))) == (0.5,)
    assert one(spark, "t string", ("some big words big",), X.word_set("t", 3)) == (["some", "words"],)
    assert one(spark, "t string", ("abc",), X.find_pos("t", F.lit("c")), X.find_pos("t", F.lit("z"))) == (2, -1)
    assert one(spark, "t string", ("abcdef",), X.truncate_text("t", 3)) == ("abc",)


def _texts(seed, n, letters="abcde ", longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_ratio_equals_difflib(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), *zip(_texts(1, 60), _texts(2, 60)), *zip(_texts(3, 4, "ab", 400), _texts(4, 4, "ab", 400))]
    got = spark.createDataFrame(pairs, "q string, t string").select(title_ratio("q", "t")).collect()
    assert [r[0] for r in got] == [SequenceMatcher(None, q, t).ratio() for q, t in pairs]
    assert [r[0] for r in got[:2]] == [0.25, 0.5]


@pytest.mark.parametrize("letters", ["ab", "abcdefghij ", "".join(map(chr, range(0x3b1, 0x3c9))) + "xyz\U0001f600"])
def test_bound_never_below_ratio(letters):
    queries, titles = _texts(5, 40, letters) + ["", letters], _texts(6, 60, letters) + ["", letters]
    q, t = profiles(queries), profiles(titles)
    for row, query in enumerate(queries):
        bounds = upper_bounds(q, row, t)
        for i, title in enumerate(titles):
            assert bounds[i] >= SequenceMatcher(None, query, title).ratio()
