"""Several status changes per ticket, each judged against the status that those before it left.

Within one workflow a request is a map of states: the state its transition leads to for every state that offers it, the
same state for all others. Such maps compose associatively, so a ticket's history is cut into short runs of requests, each run
becomes one map, runs of runs become one map again, and so on until one map per ticket is left. Going back down gives every run,
and at last every request, the state it starts in. No task ever holds more of one ticket than a run, however long its history.

A workflow is a table ``workflow, from_status, pos, id, name, to_status``: where a transition named ``name`` (case ignored, the
first by ``pos``) leads from a status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .ordering import place_within
from .tickets import only_keys

RUN = 64


def _moves(workflow: DataFrame) -> DataFrame:
    """``workflow, name, move``: per lower-case transition name a map from status to the status reached, and the ids."""
    first = workflow.groupBy("workflow", F.lower("name").alias("name"), "from_status").agg(
        F.min(F.struct("pos", "id", "to_status")).alias("t"))
    return first.groupBy("workflow", "name").agg(F.map_from_entries(F.collect_list(F.struct("from_status", "t.to_status"))).alias("move"))


def _states(workflow: DataFrame) -> DataFrame:
    """``workflow, states``: every status a workflow knows, as an array. Workflows are small; tickets are many."""
    both = workflow.select("workflow", F.explode(F.array("from_status", "to_status")).alias("state"))
    return both.groupBy("workflow").agg(F.array_sort(F.collect_set("state")).alias("states"))


def _after(move: Column, state: Column) -> Column:
    """The state that a map leads to; one that the map does not name stays."""
    return F.coalesce(F.try_element_at(move, state), state)


def _composed(moves: Column, states: Column) -> Column:
    """One map for an array of maps applied in order, over all states."""
    return F.map_from_arrays(states, F.transform(states, lambda s: F.aggregate(moves, s, lambda at, m: _after(m, at))))


def _levels(requests: DataFrame, size: int) -> list[DataFrame]:
    """Level 0 holds the requests, each further one the runs of the level before; the last one has a single run per ticket.

    Every level has ``ticket_key, place, move, states`` with places counted from 0; a row belongs to run ``place DIV size``,
    which is its place one level up.
    """
    levels, rows = [requests], requests
    longest = requests.agg(F.max("place")).first()[0] or 0
    while longest > 0:
        up = rows.groupBy("ticket_key", F.expr(f"place DIV {size}").alias("place")).agg(
            F.first("states").alias("states"), F.array_sort(F.collect_list(F.struct("place", F.map_entries("move").alias("m")))).alias("steps"))
        moves = F.transform("steps", lambda x: F.map_from_entries(x["m"]))
        rows = stage(up.select("ticket_key", "place", _composed(moves, F.col("states")).alias("move"), "states"), "composed")
        levels.append(rows)
        longest //= size
    return levels


def _prepared(tickets: DataFrame, requests: DataFrame, workflow: DataFrame, key: str) -> DataFrame:
    """Requests with the workflow and status of their ticket, and the map of their transition; unknown tickets have a null ``_known``."""
    known = only_keys(tickets, requests, "ticket_key").select(
        F.col("key").alias("ticket_key"), F.col("status").alias("old_status"), F.col(key).alias("workflow"), F.lit(True).alias("_known"))
    asked = place_within(requests.select("ticket_key", "seq", "new_status"), "ticket_key", "seq").withColumn("name", F.lower("new_status"))
    none = F.array().cast("array<string>")
    return (asked.join(known, "ticket_key", "left").join(_moves(workflow), ["workflow", "name"], "left")
            .join(_states(workflow), "workflow", "left")
            .withColumn("move", F.coalesce("move", F.map_from_arrays(none, none)))
            # The ticket's status may be one that the workflow does not know.
            .withColumn("states", F.array_distinct(F.concat(F.coalesce("states", none), F.array(F.coalesce("old_status", F.lit("")))))))


def transition_history(tickets: DataFrame, requests: DataFrame, workflow: DataFrame, key: str = "project", size: int = RUN) -> DataFrame:
    """``ticket_key, seq, new_status, from_status, to_status, accepted, error`` for every request.

    ``requests`` has ``ticket_key, seq, new_status``, a ticket's ``seq`` being distinct; ``key`` names the ticket column that holds the workflow. A
    request that its status does not offer is refused and changes nothing. An unknown ticket has no status.
    """
    asked = stage(_prepared(tickets, requests, workflow, key), "asked")
    levels = _levels(asked.where("_known").select("ticket_key", "place", "move", "states"), size)
    entry = asked.where("_known").select("ticket_key", F.lit(0).cast("long").alias("place"), F.col("old_status").alias("state")).distinct()
    none = F.array().cast("array<string>")
    for rows in reversed(levels[:-1]):
        held = rows.groupBy("ticket_key", F.expr(f"place DIV {size}").alias("run")).agg(
            F.array_sort(F.collect_list(F.struct("place", F.map_entries("move").alias("m")))).alias("steps"))
        # The states before each step: the fold appends where the last one led.
        before = F.aggregate("steps", F.struct(F.col("state").alias("at"), none.alias("seen")), lambda acc, x: F.struct(
            _after(F.map_from_entries(x["m"]), acc["at"]).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")))["seen"]
        opened = held.join(entry.withColumnRenamed("place", "run"), ["ticket_key", "run"]).select(
            "ticket_key", F.explode(F.arrays_zip(F.col("steps.place").alias("place"), before.alias("state"))).alias("x"))
        entry = stage(opened.select("ticket_key", "x.place", "x.state"), "entries")
    judged = asked.join(entry.withColumnRenamed("state", "from_status"), ["ticket_key", "place"], "left")
    offered = F.coalesce(F.map_contains_key("move", F.coalesce("from_status", F.lit(""))), F.lit(False)) & F.col("from_status").isNotNull()
    options = (workflow.groupBy("workflow", F.col("from_status"), F.lower("name")).agg(F.min(F.struct("pos", "name")).alias("t"))
               .groupBy("workflow", "from_status").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["name"]), ", ").alias("options")))
    judged = judged.join(options, ["workflow", "from_status"], "left")
    error = F.when(F.col("_known").isNull(), "no such ticket").when(
        ~offered, F.concat(F.lit("No transition to '"), "new_status", F.lit("'. Available: "), F.coalesce("options", F.lit(""))))
    return judged.select("ticket_key", "seq", "new_status", "from_status", _after(F.col("move"), F.col("from_status")).alias("to_status"),
                         error.isNull().alias("accepted"), error.alias("error"))


def _rules(workflow: DataFrame) -> DataFrame:
    """``workflow, rules, states``: the maps of all its transitions by lower-case name, and every status it knows."""
    moves = _moves(workflow).where("name IS NOT NULL").groupBy("workflow").agg(F.map_from_entries(F.collect_list(F.struct("name", "move"))).alias("rules"))
    return moves.join(_states(workflow), "workflow")


def apply_transitions_in_order(tickets: DataFrame, requests: DataFrame, workflow: DataFrame, key: str = "project", size: int = RUN) -> DataFrame:
    """``key, old_status, status`` of every requested ticket after all its requests in ``seq`` order. Only maps go up; nothing goes back down.

    Requests are cut into runs by name; maps come in with the run's workflow. A ticket's first run begins in its status, so its map needs
    that status alone.
    """
    none = F.array().cast("array<string>")
    known = tickets.where("key IS NOT NULL").select(F.col("key").alias("ticket_key"), F.col("status").alias("old_status"), F.col(key).alias("workflow")).distinct()
    asked = place_within(requests.select("ticket_key", "seq", F.lower("new_status").alias("name")), "ticket_key", "seq")
    runs = asked.groupBy("ticket_key", F.expr(f"place DIV {size}").alias("place")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    # The ticket's status may be one that the workflow does not know.
    every = F.array_distinct(F.concat(F.coalesce("states", none), F.array(F.coalesce("old_status", F.lit("")))))
    runs = runs.join(known, "ticket_key").join(_rules(workflow), "workflow", "left").withColumn(
        "states", F.when(F.col("place") == 0, F.array(F.coalesce("old_status", F.lit("")))).otherwise(every))
    after = F.transform("states", lambda s: F.aggregate("names", s, lambda at, n: F.coalesce(F.try_element_at(F.try_element_at("rules", n), at), at)))
    owner = ["ticket_key", "old_status", "workflow"]
    rows = stage(runs.select(*owner, "place", "states", F.map_from_arrays("states", after).alias("move")), "composed")
    longest = rows.agg(F.max("place")).first()[0] or 0
    while longest > 0:
        up = rows.groupBy(*owner, F.expr(f"place DIV {size}").alias("place")).agg(
            F.min_by("states", "place").alias("states"), F.array_sort(F.collect_list(F.struct("place", F.map_entries("move").alias("m")))).alias("steps"))
        moves = F.transform("steps", lambda x: F.map_from_entries(x["m"]))
        rows = stage(up.select(*owner, "place", "states", _composed(moves, F.col("states")).alias("move")), "composed")
        longest //= size
    return rows.select(F.col("ticket_key").alias("key"), "old_status", _after(F.col("move"), F.col("old_status")).alias("status"))
