"""The order of exported pages and of the records on them.

A page says which token it answers and which token the next page answers; files and rows come in any order. The place of
each page follows from pointer doubling: after round k every page knows the page 2^k further on and the records on the way, and
walking the rounds back from the first page gives all places, the number of pages doubling each time. A chain of n pages takes
some 2 log2(n) joins on the token; no page is ever collected or sorted in one task.

What is wrong with an export is reported and not guessed at:

* ``missing``: a page names a next token that no page answers;
* ``repeated``: several different answers to one token, of which the least by content counts (equal copies count as one);
* ``looping``: a page names a token that stands before it or its own;
* ``unreached``: a page that the chain from the first page does not lead to;
* ``headless``: an export without a first page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage

FIRST = ""
LINKS = "export, token, next, size, checksum"
PROBLEMS = "export string, problem string, token string, pages long"


def token_pages(pages: DataFrame, records: str, export: Column | None = None) -> DataFrame:
    """Pages that name tokens (``pageToken``, ``nextPageToken``, ``isLast``) as ``export, token, next, size, checksum, records``.

    A page ends its chain if it says so, does not say, or names no next token.
    """
    more = ~F.coalesce(F.col("isLast"), F.lit(True)) & (F.coalesce("nextPageToken", F.lit("")) != "")
    return _linked(pages, records, export, F.coalesce("pageToken", F.lit(FIRST)), F.when(more, F.col("nextPageToken")))


def offset_pages(pages: DataFrame, records: str, export: Column | None = None) -> DataFrame:
    """Pages that name the offset of their first record (``startAt``, ``maxResults``), in the form of ``token_pages``.

    A page with fewer records than asked for is the last one.
    """
    start = F.coalesce(F.col("startAt"), F.lit(0))
    full = F.size(F.coalesce(F.col(records), F.array())) >= F.col("maxResults")
    token = F.when(start > 0, start.cast("string")).otherwise(F.lit(FIRST))
    return _linked(pages, records, export, token, F.when(full, (start + F.col("maxResults")).cast("string")))


def _linked(pages: DataFrame, records: str, export: Column | None, token: Column, following: Column) -> DataFrame:
    held = F.coalesce(F.col(records), F.array())
    return pages.select((F.lit("") if export is None else F.coalesce(export.cast("string"), F.lit(""))).alias("export"), token.alias("token"),
                        following.alias("next"), F.size(held).cast("long").alias("size"), F.xxhash64(held, following).alias("checksum"),
                        held.alias("records"))


def _answers(pages: DataFrame) -> DataFrame:
    """One page per export and token, and how many different ones there are."""
    distinct = pages.selectExpr(*[c.strip() for c in LINKS.split(",")]).distinct()
    return stage(distinct.groupBy("export", "token").agg(
        F.min(F.struct("checksum", "next", "size")).alias("p"), F.count("*").alias("answers")).select(
        "export", "token", "p.next", "p.size", "p.checksum", "answers"), "pages")


def _jumps(answers: DataFrame) -> list[DataFrame]:
    """Round k: ``export, token, ahead, weight``, the page 2^k further on and the records before it from here."""
    known = answers.select("export", F.col("token").alias("ahead"))
    jump = stage(answers.where("next IS NOT NULL").select("export", "token", F.col("next").alias("ahead"), F.col("size").alias("weight"))
                 .join(known, ["export", "ahead"], "left_semi").select("export", "token", "ahead", "weight"), "jumps")
    longest = answers.groupBy("export").count().agg(F.max("count")).first()[0] or 0
    rounds = [jump]
    while (1 << len(rounds)) < longest and not jump.isEmpty():
        further = jump.select("export", F.col("token").alias("ahead"), F.col("ahead").alias("beyond"), F.col("weight").alias("more"))
        jump = stage(jump.join(further, ["export", "ahead"]).select(
            "export", "token", F.col("beyond").alias("ahead"), F.expr("weight + more").alias("weight")), "jumps")
        rounds.append(jump)
    return rounds


def page_places(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per page that its export's chain reaches: ``export, token, checksum, page`` (from 0) and ``offset``, the records before it; and the problems.

    ``pages`` has the columns of ``token_pages``. In a loop, pages keep the place where the chain meets them first.
    """
    answers = _answers(pages)
    rounds = _jumps(answers)
    reached = answers.where(F.col("token") == FIRST).select("export", "token", F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("offset"))
    for k in reversed(range(len(rounds))):
        ahead = reached.join(rounds[k], ["export", "token"]).select(
            "export", F.col("ahead").alias("token"), (F.col("page") + (1 << k)).alias("page"), F.expr("offset + weight").alias("offset"))
        reached = stage(reached.union(ahead), "reached")
    first = reached.groupBy("export", "token").agg(F.min(F.struct("page", "offset")).alias("at"))
    places = stage(answers.join(first, ["export", "token"]).select(
        "export", "token", "next", "size", "checksum", "at.page", "at.offset"), "places")
    return places.select("export", "token", "checksum", "size", "page", "offset"), _problems(answers, places)


def _problems(answers: DataFrame, places: DataFrame) -> DataFrame:
    def named(rows: DataFrame, problem: str, pages: Column = F.lit(1)) -> DataFrame:
        return rows.select("export", F.lit(problem).alias("problem"), "token", pages.cast("long").alias("pages"))

    asked = places.where("next IS NOT NULL").select("export", F.col("next").alias("token"), F.col("page").alias("from_page"))
    met = places.select("export", "token", "page")
    missing = asked.join(answers, ["export", "token"], "left_anti")
    looping = asked.join(met, ["export", "token"]).where("page <= from_page").select("export", "token").distinct()
    heads = answers.where(F.col("token") == FIRST).select("export")
    headless = answers.join(heads, "export", "left_anti").groupBy("export").agg(F.count("*").alias("pages")).withColumn("token", F.lit(FIRST))
    return (named(missing, "missing").union(named(looping, "looping"))
            .union(named(answers.where("answers > 1"), "repeated", F.col("answers")))
            .union(named(answers.join(met, ["export", "token"], "left_anti"), "unreached"))
            .union(named(headless, "headless", F.col("pages"))))


def positioned_records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every record of the reached pages as ``export, pos, record``, and the problems.

    ``pos`` counts from 0 through all exports, in the order of their names; within a page the order is the page's own.
    """
    places, problems = page_places(pages)
    # One row per export; the window holds no more than that.
    ends = places.groupBy("export").agg(F.sum("size").alias("total"))
    before = Window.orderBy("export").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("export", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    at = places.join(bases, "export").select("export", "token", "checksum", F.expr("base + offset").alias("start"))
    chosen = pages.select("export", "token", "checksum", "records").join(at, ["export", "token", "checksum"])
    chosen = chosen.dropDuplicates(["export", "token"])
    records = chosen.select("export", "start", F.posexplode("records").alias("at", "record"))
    return records.select("export", F.expr("start + at").alias("pos"), "record"), problems


class BrokenExport(ValueError):
    """An export whose pages do not form one chain from a first page to a last one."""


def whole(records_and_problems: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The records, or an error that names what is wrong with the export."""
    records, problems = records_and_problems
    found = problems.orderBy("export", "problem", "token").limit(10).collect()
    if found:
        raise BrokenExport("; ".join(f"{p.problem} page {p.token!r} in export {p.export!r}" for p in found))
    return records
