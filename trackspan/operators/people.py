"""Users: bot filter, search, and resolution of names and addresses to accounts.

User tables carry an input position (``pos``, unique); "first match" means the smallest position. A miss
keeps its row with a null account.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import values as V
from ..functions import text as X
from ..staging import stage
from . import lookup
from .gram_index import SubstringIndex


def _accounts(hits: DataFrame, users: DataFrame, *keys: str) -> DataFrame:
    """Adds the account at each ``pos``. The lookups carry positions alone, which aggregate by hashing."""
    return hits.join(users.select("pos", "accountId"), "pos").select(*keys, "accountId")


def exclude_bot_users(users: DataFrame) -> DataFrame:
    return users.where(~X.is_bot_name("displayName"))


def _texts(users: DataFrame) -> DataFrame:
    """Two rows per user: the lower-case name and the lower-case address."""
    name, email = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("displayName", "emailAddress"))
    return users.select("pos", name.alias("name"), F.explode(F.array(
        F.struct(F.lit(True).alias("is_name"), name.alias("text")),
        F.struct(F.lit(False).alias("is_name"), email.alias("text")))).alias("_t")).select("pos", "name", "_t.*")


Find = Callable[[DataFrame, str], DataFrame]


def _finder(users: DataFrame, index: SubstringIndex | None) -> Find:
    """Looks needles up in the names and addresses of users, in a kept index where there is one."""
    if index is not None:
        return index.occurrences
    texts = _texts(users)
    return lambda needles, needle: lookup.occurrences(texts, "text", needles, needle)


def user_index(spark: SparkSession, folder: str, **options) -> SubstringIndex:
    """An index of users in a shared folder, for ``index_users`` and the lookups below."""
    return SubstringIndex(spark, folder, "pos long, name string, is_name boolean", **options)


def index_users(index: SubstringIndex, batch: int, users: DataFrame, removed: DataFrame | None = None) -> None:
    """Takes in new and changed users by position, and takes out those of ``removed``."""
    gone = None if removed is None else removed.select(F.explode(F.array(F.col("pos") * 2, F.col("pos") * 2 + 1)).alias("id"))
    index.update(batch, _texts(users).withColumn("id", F.col("pos") * 2 + F.col("is_name").cast("long")), gone)


def resolve_users_simple(queries: DataFrame, users: DataFrame, query: str = "q", index: SubstringIndex | None = None) -> DataFrame:
    """First user whose address or name contains the lower-cased query; account ids pass through. ``index``, if given, must hold ``users``."""
    needle = F.lower(F.col(query))
    asked = queries.withColumns({"_id": X.is_account_id(query, "tool"), "_needle": needle})
    wanted = asked.where(~F.col("_id") & (F.length("_needle") > 0)).select("_needle").distinct()
    first = _finder(users, index)(wanted, "_needle").groupBy("_needle").agg(F.min("pos").alias("pos"))
    return (asked.join(_accounts(first, users, "_needle"), "_needle", "left")
            .withColumn("accountId", F.when(F.col("_id"), F.col(query)).otherwise(F.col("accountId")))
            .drop("_needle", "_id"))


def _ranked_hits(names: DataFrame, texts: DataFrame, domain: str, find: Find) -> DataFrame:
    """Per normalised name: the position of the user found first.

    Candidates are tried in order, users in order within one. The two rules that do not depend on the
    candidate (both name parts inside the display name; display name starts with a lone first part) hold
    already for candidate 0.
    """
    parts = stage(names.withColumns({"_first": X.name_part("nq", 1), "_last": X.name_part("nq", -1)}), "names")
    candidates = parts.select("nq", F.posexplode(X.email_candidates("nq", "_first", "_last", domain)).alias("rank", "needle"))
    pairs = parts.where((F.col("_first") != "") & (F.col("_last") != "")).select("_first", "_last").distinct()
    lone = parts.where((F.col("_first") != "") & (F.col("_last") == "")).select("nq", F.col("_first").alias("needle"))

    # One pass over the users answers candidates and, for the name parts, how often each occurs in names.
    sides = pairs.select(F.explode(F.array("_first", "_last")).alias("needle"))
    wanted = (candidates.select("needle", F.lit(False).alias("_in_name"))
              .unionByName(sides.select("needle", F.lit(True).alias("_in_name")))
              .groupBy("needle").agg(F.bool_or("_in_name").alias("_in_name")))
    found = stage(find(wanted, "needle")
                  .groupBy("needle").agg(F.min("pos").alias("pos"), F.count_if("is_name").alias("n_names")), "found")
    direct = candidates.join(found, "needle").select("nq", "rank", "pos")

    # Display names starting with the lone part: prefixes only, so one substring per length.
    prefixed = (lookup.prefixes(texts.where("is_name"), "text", lone, "needle")
                .groupBy("needle").agg(F.min("pos").alias("pos")))
    starting = lone.join(prefixed, "needle").select("nq", F.lit(0).alias("rank"), "pos")

    # Both parts in one name: look up the rarer part, check the other on the matching rows.
    n_first, n_last = (found.select(F.col("needle").alias(side), F.col("n_names").alias("n" + side)) for side in ("_first", "_last"))
    anchored = stage(pairs.join(n_first, "_first").join(n_last, "_last").where("n_first > 0 AND n_last > 0")
                     .select("_first", "_last", F.expr("IF(n_first <= n_last, _first, _last)").alias("needle"),
                             F.expr("IF(n_first <= n_last, _last, _first)").alias("_other")), "anchors")
    bearers = (find(anchored, "needle").where("is_name").where(F.expr("instr(text, needle) = start"))
               .select("needle", "name", "pos"))
    together = lookup.first_verified(anchored, bearers, ["needle"], ["_first", "_last"], "pos", F.expr("contains(name, _other)"))
    both = parts.join(together, ["_first", "_last"]).select("nq", F.lit(0).alias("rank"), F.col("hit").alias("pos"))

    return (direct.unionByName(starting).unionByName(both)
            .groupBy("nq").agg(F.min(F.struct("rank", "pos"))["pos"].alias("pos")))


def resolve_users_ranked(queries: DataFrame, users: DataFrame, domain: str, query: str = "q",
                         pass_ids: str | None = None, index: SubstringIndex | None = None) -> DataFrame:
    """Name or address to account id, best candidate first. ``index``, if given, must hold ``users``.

    ``pass_ids`` names the account-id variant whose values are returned as they are.
    """
    is_id = X.is_account_id(query, pass_ids) if pass_ids else F.lit(False)
    asked = queries.withColumns({"_id": is_id, "nq": X.norm(query)})
    names = asked.where(~F.col("_id") & (F.col("nq") != "")).select("nq").distinct()
    found = _accounts(_ranked_hits(names, _texts(users), domain, _finder(users, index)), users, "nq")
    return (asked.join(found, "nq", "left")
            .withColumn("accountId", F.when(F.col("_id"), F.col(query)).otherwise(F.col("accountId")))
            .drop("nq", "_id"))


def search_users(queries: DataFrame, users: DataFrame, query: str = "q", limit: int = V.SHOWN_USERS,
                 index: SubstringIndex | None = None) -> DataFrame:
    """Users that are not bots and whose name or address contains the query, the first ``limit`` per query.

    Sorted by where the query stands in the name (address-only matches are -1 and come first), then input
    order. ``overflow`` is the number of further matches. ``index``, if given, must hold ``users``.
    """
    asked = queries.withColumn("_needle", X.norm(query)).where("_needle <> ''")
    wanted = asked.select("_needle").distinct()
    people = exclude_bot_users(users)
    matches = _finder(people, index)(wanted, "_needle")
    if index is not None:
        matches = matches.join(people.select("pos"), "pos", "left_semi")
    matches = (matches.where(F.expr("instr(text, _needle) = start AND (is_name OR instr(name, _needle) = 0)"))
               .withColumn("find_pos", F.when(F.col("is_name"), F.col("start") - 1).otherwise(-1)))
    totals = matches.groupBy("_needle").agg(F.count(F.lit(1)).alias("_total"))
    order = Window.partitionBy("_needle").orderBy("find_pos", "pos")
    shown = (matches.select("_needle", "find_pos", "pos")
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit))
    return (asked.join(totals, "_needle").join(shown, "_needle")
            .join(users.select("pos", "accountId", "displayName", "emailAddress"), "pos")
            .withColumn("overflow", F.greatest(F.col("_total") - limit, F.lit(0)))
            .drop("_needle", "_total"))


def first_visible_users(users: DataFrame, limit: int = V.LISTED_USERS) -> DataFrame:
    """The first display names as one comma list."""
    first = users.orderBy("pos").limit(limit)
    return first.agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "displayName"))), lambda u: u["displayName"]), ", ").alias("visible_users"))


def not_found_message(query: Column, visible: Column) -> Column:
    return F.concat(F.lit("User '"), query, F.lit("' not found. Available users: "), visible, F.lit("..."))
