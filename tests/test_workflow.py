import random

from conftest import rows
from trackspan.operators import ordering, workflow as WF

TICKETS = "key string, project string, status string"
REQUESTS = "ticket_key string, seq long, new_status string"
MOVES = "workflow string, from_status string, pos int, id string, name string, to_status string"


def brute(tickets, requests, moves):
    """Requests in order, one at a time."""
    first = {}
    for w, frm, pos, _, name, to in sorted(moves, key=lambda m: m[2]):
        first.setdefault((w, frm, name.lower()), to)
    state = {k: (p, s) for k, p, s in tickets}
    now, out = {k: s for k, (_, s) in state.items()}, []
    for key, seq, name in sorted(requests, key=lambda r: (r[0], r[1])):
        if key not in state:
            out.append((key, seq, None, None, False))
            continue
        to = first.get((state[key][0], now[key], name.lower()))
        out.append((key, seq, now[key], to or now[key], to is not None))
        now[key] = to or now[key]
    return out, now


def sample(seed, hot):
    rnd = random.Random(seed)
    states, names = ["A", "B", "C", "D"], ["go", "Back", "jump", "stay"]
    moves = [(w, s, i, f"{w}{i}", rnd.choice(names), rnd.choice(states)) for w in ("P", "Q") for i, s in enumerate(rnd.choices(states, k=9))]
    tickets = [(f"K{i}", rnd.choice("PQ"), rnd.choice([*states, "Odd"])) for i in range(12)]
    requests = [(f"K{rnd.randint(0, 13)}", i, rnd.choice(names).upper()) for i in range(200)]
    return tickets, requests + [("K1", 1000 + i, rnd.choice(names)) for i in range(hot)], moves


def test_histories_equal_one_request_at_a_time(spark):
    for seed, hot, size in ((1, 0, 64), (2, 1500, 4), (3, 300, 2)):
        data = sample(seed, hot)
        frames = [spark.createDataFrame(d, s) for d, s in zip(data, (TICKETS, REQUESTS, MOVES))]
        want, final = brute(*data)
        got = WF.transition_history(*frames, size=size)
        assert rows(got, "ticket_key", "seq", "from_status", "to_status", "accepted") == sorted(want, key=repr)
        asked = {r[0] for r in data[1]}
        last = WF.apply_transitions_in_order(*frames, size=size)
        assert {r.key: r.status for r in last.collect()} == {k: s for k, s in final.items() if k in asked}


def test_only_runs_are_kept_on_the_way_to_the_last_status(spark, monkeypatch):
    """Requests meet the workflow as runs: nothing kept besides their places has a row per request."""
    kept, stage = [], WF.stage
    monkeypatch.setattr(WF, "stage", lambda df, name: kept.append(stage(df, name)) or kept[-1])
    tickets, requests, moves = sample(7, 400)
    tickets += [("K20", "P", None), ("K21", None, "A"), ("K1", *tickets[1][1:]), (None, "P", "A")]
    requests += [("K20", 5, "go"), ("K21", 5, "go"), ("K2", 5000, None), (None, 5001, "go")]
    frames = [spark.createDataFrame(d, s) for d, s in zip((tickets, requests, moves), (TICKETS, REQUESTS, MOVES))]
    _, final = brute(tickets[:-1], [(k, n, name or "") for k, n, name in requests if k], moves)
    asked = {r[0] for r in requests if r[0]}
    got = WF.apply_transitions_in_order(*frames, size=16).collect()
    assert {r.key: r.status for r in got} == {k: s for k, s in final.items() if k in asked} and len(got) == len({r.key for r in got})
    assert max(df.count() for df in kept) < len(requests) / 5


def test_refusals_name_what_the_status_offers(spark):
    tickets = spark.createDataFrame([("K", "P", "Open")], TICKETS)
    moves = spark.createDataFrame([("P", "Open", 1, "2", "Close", "Done"), ("P", "Open", 0, "1", "Start", "Busy"), ("P", "Busy", 0, "3", "Close", "Done")], MOVES)
    asked = spark.createDataFrame([("K", 1, "start"), ("K", 2, "START"), ("K", 3, "close"), ("X", 1, "close")], REQUESTS)
    got = WF.transition_history(tickets, asked, moves)
    assert rows(got, "ticket_key", "seq", "from_status", "to_status", "error") == [
        ("K", 1, "Open", "Busy", None), ("K", 2, "Busy", "Busy", "No transition to 'START'. Available: Close"), ("K", 3, "Busy", "Done", None),
        ("X", 1, None, None, "no such ticket")]
    assert rows(WF.transition_history(tickets, asked.where("false"), moves)) == []


def test_places_do_not_depend_on_partitions(spark):
    rnd = random.Random(5)
    data = [("hot", i) for i in range(500)] + [(f"k{rnd.randint(0, 40)}", 1000 + i) for i in range(300)]
    rnd.shuffle(data)
    for parts in (1, 7):
        got = ordering.place_within(spark.createDataFrame(data, "k string, seq long").repartition(parts), "k", "seq")
        by = {}
        for k, seq in sorted(data):
            by.setdefault(k, []).append(seq)
        assert rows(got, "k", "seq", "place") == sorted(((k, s, i) for k, own in by.items() for i, s in enumerate(own)), key=repr)
