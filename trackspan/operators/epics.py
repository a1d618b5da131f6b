"""Epics: lists, title resolution, title search, standard epics and roll-up.

"First" epic means newest first, then by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import values as V
from ..functions import metrics as M, text as X
from ..functions.ratio import SCORED, best_of_tile
from ..staging import stage
from . import lookup
from .aggregates import measures

TILE_TITLES = 2000
TILE_QUERIES = 500
_ALL = "*"


def list_epics(epics: DataFrame, project: str | None = None) -> DataFrame:
    """Epic rows, newest first."""
    chosen = epics if project is None else epics.where(F.col("project") == project)
    return chosen.select("key", "summary", "description", "status", "assignee", "reporter", "created", "updated",
                         "project").orderBy(F.col("created").desc(), "key")


def epics_of(tickets: DataFrame, project: str | None = None) -> DataFrame:
    """Tickets of type Epic as epic rows, newest first."""
    return list_epics(tickets.where(F.col("issue_type") == V.EPIC_TYPE), project)


def _titles(epics: DataFrame) -> DataFrame:
    """Distinct (project, title) with the first epic that bears it. Blank titles match nothing."""
    first = F.struct(M.newest_first("created").alias("age"), F.col("key"))
    return (epics.select("project", X.norm("summary").alias("title"), first.alias("epic"))
            .where("title <> ''").groupBy("project", "title").agg(F.min("epic").alias("epic")))


def _contains_tier(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """First epic whose title contains the query or is contained in it."""
    wider = lookup.first_containing(titles.withColumnRenamed("title", "_text"), "_text", asked, "q", F.col("epic"),
                                    ["project"]).select("project", "q", "hit")
    narrower = lookup.first_contained(asked, "q", titles.withColumnRenamed("title", "_needle"), "_needle",
                                      ["project", "q"], "epic", ["project"])
    return wider.unionByName(narrower).groupBy("project", "q").agg(F.min("hit").alias("epic"))


def _words_tier(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """First epic whose title has at least half of the query's words.

    With ``need`` of n words required, a match has one of any n - need + 1 of them, so only the rarest
    that many words are looked up; the rest is checked on the rows found. Queries that need a single
    word never meet the titles at all: the first epic per word answers them.
    """
    queries = asked.select("project", "q", X.word_set("q").alias("qw")).where(F.size("qw") > 0)
    queries = queries.withColumn("need", F.ceil(F.size("qw") / 2).cast("int"))
    by_set = (titles.select("project", F.sort_array(X.word_set("title")).alias("tw"), "epic")
              .groupBy("project", "tw").agg(F.min("epic").alias("epic")))
    title_words = by_set.select("project", "tw", "epic", F.explode("tw").alias("word"))
    index = title_words.groupBy("project", "word").agg(F.min("epic").alias("epic"), F.count(F.lit(1)).alias("n"))

    query_words = queries.select("project", "q", "qw", "need", F.explode("qw").alias("word")).join(
        index, ["project", "word"], "left")
    single = query_words.where((F.col("need") == 1) & F.col("epic").isNotNull()).select("project", "q", "epic")

    by_rarity = Window.partitionBy("project", "q").orderBy(F.coalesce("n", F.lit(0)), "word")
    anchors = stage(query_words.where("need > 1").withColumn("_r", F.row_number().over(by_rarity))
                    .where(F.expr("_r <= size(qw) - need + 1 AND n IS NOT NULL"))
                    .select("project", "q", "qw", "need", "word"), "anchors")
    several = lookup.first_verified(anchors, title_words, ["project", "word"], ["project", "q"], "epic",
                                    F.size(F.array_intersect("qw", "tw")) >= F.col("need")).withColumnRenamed("hit", "epic")
    return single.unionByName(several).groupBy("project", "q").agg(F.min("epic").alias("epic"))


def _tiled(asked: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the similarity search laid out in tiles of bounded size.

    A project's titles and queries are hashed over as many tiles as their counts ask for, each query goes
    to all title tiles of its project and each title to all query tiles, so the tile size does not grow
    with a hot project and every pair meets exactly once.
    """
    n_titles = titles.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / TILE_TITLES).cast("int").alias("nt"))
    n_queries = asked.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / TILE_QUERIES).cast("int").alias("nq"))
    grid = n_titles.join(n_queries, "scope")

    def spread(c: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    q = (asked.join(grid, "scope").withColumn("q_tile", F.pmod(F.xxhash64("q"), F.col("nq")).cast("int"))
         .withColumn("t_tile", spread("nt")).select("scope", "q_tile", "t_tile", "q"))
    t = (titles.join(grid, "scope").withColumn("t_tile", F.pmod(F.xxhash64("epic"), F.col("nt")).cast("int"))
         .withColumn("q_tile", spread("nq"))
         .select("scope", "q_tile", "t_tile", "title", F.col("epic.age").alias("age"), F.col("epic.key").alias("key")))
    return lookup.spread(q, *_TILE_KEYS), lookup.spread(t, *_TILE_KEYS)


_TILE_KEYS = ["scope", "q_tile", "t_tile"]


def _best_titles(asked: DataFrame, titles: DataFrame, k: int, floor: float, contains_is_one: bool) -> DataFrame:
    """The ``k`` most similar titles per (scope, q)."""
    q, t = _tiled(asked, titles)
    scored = q.groupBy(*_TILE_KEYS).cogroup(t.groupBy(*_TILE_KEYS)).applyInPandas(
        best_of_tile(k, floor, contains_is_one), SCORED)
    order = Window.partitionBy("scope", "q").orderBy(F.col("score").desc(), "age", "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def resolve_epics(queries: DataFrame, epics: DataFrame, title: str = "title",
                  min_ratio: float | None = V.MIN_TITLE_RATIO) -> DataFrame:
    """Approximate title to epic key within the query's project.

    Adds ``epic_key``, ``tier`` (key, contains, words, ratio or null) and ``ratio``. Texts that already
    are ticket keys pass through. ``min_ratio=None`` leaves the similarity tier out.
    """
    given = queries.withColumns({
        "_is_key": X.is_ticket_key(title), "_scope": X.norm_upper("project"), "_q": X.norm(title)})
    asked = stage(given.where("NOT _is_key AND _q <> ''").select(
        F.col("_scope").alias("project"), F.col("_q").alias("q")).distinct(), "asked")
    titles = stage(_titles(epics), "titles")
    by = ["project", "q"]
    contained = stage(_contains_tier(asked, titles).withColumn("tier", F.lit(1)), "contained")
    left = asked.join(contained, by, "left_anti")
    found = contained.unionByName(_words_tier(left, titles).withColumn("tier", F.lit(2))).select(
        *by, "tier", F.col("epic.key").alias("epic_key"), F.lit(None).cast("double").alias("ratio"))
    if min_ratio is not None:
        found = stage(found, "found")
        left = asked.join(found, by, "left_anti").withColumnRenamed("project", "scope")
        similar = _best_titles(left, titles.withColumn("scope", F.col("project")), 1, min_ratio, False)
        found = found.unionByName(similar.select(F.col("scope").alias("project"), "q", F.lit(3).alias("tier"),
                                                 F.col("key").alias("epic_key"), F.col("score").alias("ratio")))
    found = found.select(F.col("project").alias("_scope"), F.col("q").alias("_q"), "tier", "epic_key", "ratio")
    return (given.join(found, ["_scope", "_q"], "left")
            .withColumns({
                "epic_key": F.when(F.col("_is_key"), F.col(title)).otherwise(F.col("epic_key")),
                "tier": (F.when(F.col("_is_key"), "key").when(F.col("tier") == 1, "contains")
                         .when(F.col("tier") == 2, "words").when(F.col("tier") == 3, "ratio")),
            }).drop("_scope", "_q", "_is_key"))


def epic_title_topk(queries: DataFrame, epics: DataFrame, title: str = "title", limit: int = 10) -> DataFrame:
    """The best ``limit`` epics per query: score is the ratio, or 1 when the title contains the query.

    A query without a project is compared with every project's epics. Queries that have ``limit``
    containing titles already are answered by the substring lookup and never scored.
    """
    k = max(1, int(limit))
    given = queries.withColumns({
        "_scope": F.coalesce(X.blank_to_null(X.norm_upper("project")), F.lit(_ALL)), "_q": X.norm(title)}).where("_q <> ''")
    asked = stage(given.select(F.col("_scope").alias("scope"), F.col("_q").alias("q")).distinct(), "asked")
    scopes = asked.select("scope").distinct()
    each = (epics.select("key", "project", X.strip(F.coalesce("summary", F.lit(""))).alias("shown"),
                         M.newest_first("created").alias("age"))
            .withColumn("scope", F.explode(F.array(X.norm_upper("project"), F.lit(_ALL))))
            .join(scopes, "scope", "left_semi").withColumn("title", F.lower("shown")))

    # Equal titles contain and score alike, so each is looked at once, and only its first k epics can be among the k best.
    by_title = Window.partitionBy("scope", "title").orderBy("age", "key")
    bearers = stage(each.select("scope", "title", "age", "key").withColumn("_n", F.row_number().over(by_title)).where(F.col("_n") <= k), "bearers")
    titles = bearers.where("_n = 1").select("scope", "title", F.struct("age", "key").alias("epic"))
    epics_of_titles = bearers.drop("_n")
    order = Window.partitionBy("scope", "q").orderBy(F.col("score").desc(), "age", "key")

    def first_epics(found: DataFrame) -> DataFrame:
        """The k best epics per query of titles with their scores; they bear the k best titles."""
        return (found.select("scope", "q", "title", "score").join(epics_of_titles, ["scope", "title"])
                .select("scope", "q", "age", "key", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k))

    inside = (lookup.occurrences(titles.select("scope", "title"), "title", asked, "q", ["scope"])
              .where(F.expr("instr(title, q) = start")).withColumn("score", F.lit(1.0)))
    full = stage(first_epics(inside), "contained")
    enough = full.where(F.col("rank") == k).select("scope", "q")
    scored = first_epics(_best_titles(asked.join(enough, ["scope", "q"], "left_anti"), titles, k, 0.0, True))
    best = full.join(enough, ["scope", "q"], "left_semi").unionByName(scored)
    names = epics.select("key", X.strip(F.coalesce("summary", F.lit(""))).alias("epic_title"))
    return (given.join(best.withColumnsRenamed({"scope": "_scope", "q": "_q"}), ["_scope", "_q"])
            .join(names, "key").withColumnRenamed("key", "epic_key").drop("_scope", "_q", "age"))


def match_standard_epic(projects: DataFrame, epics: DataFrame, name: str = V.STANDARD_EPIC_NAME) -> DataFrame:
    """Per project: the epic with the standard title, else the first whose words include all its long words.

    ``epic_key`` is null where an epic is still to be created; ``new_title`` then holds its title.
    """
    summary = X.norm("summary")
    target = F.lit(name.strip().lower())
    target_words = X.word_set(target, 3)
    tier = (F.when(summary == target, 1)
            .when((F.size(target_words) > 0) & (F.size(F.array_except(target_words, X.word_set(summary, 3))) == 0), 2))
    found = (epics.withColumn("_tier", tier).where("_tier IS NOT NULL")
             .groupBy("project").agg(F.min(F.struct("_tier", M.newest_first("created").alias("age"), "key")).alias("e"))
             .select("project", F.col("e.key").alias("epic_key"),
                     F.when(F.col("e._tier") == 1, "exact").otherwise("partial").alias("match")))
    return (projects.select("project").distinct().join(found, "project", "left")
            .withColumns({"match": F.coalesce("match", F.lit("create")),
                          "new_title": F.when(F.col("epic_key").isNull(), X.standard_epic_title("project", name))}))


def standard_epics_to_create(projects: DataFrame, epics: DataFrame, name: str = V.STANDARD_EPIC_NAME) -> DataFrame:
    missing = match_standard_epic(projects, epics, name).where("epic_key IS NULL")
    return missing.select("project", F.col("new_title").alias("summary"),
                          X.standard_epic_description("project").alias("description"), F.lit(V.EPIC_TYPE).alias("issue_type"))


def epic_rollup_of(epics: DataFrame, m: DataFrame) -> DataFrame:
    """Per epic: linked tickets, resolved ones and progress in percent. Epics without tickets stay.

    Tickets are summed per epic before the join, so a hot epic meets its row once.
    """
    linked = m.where("epic_link IS NOT NULL").groupBy("epic_link").agg(
        F.sum("n").alias("tickets"), F.sum("n_resolved").alias("resolved"))
    n, done = (F.coalesce(c, F.lit(0)) for c in ("tickets", "resolved"))
    return epics.select("key", "project").join(linked, F.col("key") == F.col("epic_link"), "left").select(
        F.col("key").alias("epic_key"), "project", n.alias("tickets"), done.alias("resolved"),
        M.round1(M.safe_pct(done, n)).alias("progress"))


def epic_rollup(epics: DataFrame, enriched: DataFrame) -> DataFrame:
    return epic_rollup_of(epics, measures(enriched, "epic_link"))
