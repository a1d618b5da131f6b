"""Substring lookups as equi-joins.

``needle in text`` is a nested loop when written as a join condition. Here needle and text meet in three
equi-joins instead:

1. each text position whose next three characters begin some head, the first few characters of a needle,
2. of those positions the ones where a whole head stands (heads are unique, so a position meets at most one row per head length),
3. from those positions, the substrings as long as the needles with that head, matched to the needles.

The work is linear in the texts, whatever matches nothing is dropped early, and "first match" is a ``min``
per needle, so a needle found in a third of all rows is combined on the map side and never listed. Spark
broadcasts heads and needles when their measured size allows it and shuffles both sides otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage

HEAD, BEGIN = 8, 3
NEAR = 500


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all shuffle partitions. For small tables whose rows are about to cost a lot of work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def substrings(texts: DataFrame, text: str, needles: DataFrame, needle: str, scope: Sequence[str] = ()) -> DataFrame:
    """Substrings of ``text`` (column ``needle``, one-based ``start``) that may be needles of the same scope."""
    size, start = F.length(text), F.col("start")
    heads = stage(needles.where(F.length(needle) > 0).groupBy(*scope, F.substring(needle, 1, HEAD).alias("_head"))
                  .agg(F.collect_set(F.length(needle)).alias("_sizes")), "heads")
    # Heads may be many, what they begin with is not: most positions are dropped before any is shuffled.
    begins = stage(heads.groupBy(*scope, F.substring("_head", 1, BEGIN).alias("_begin"))
                   .agg(F.collect_set(F.length("_head")).alias("_lengths")), "begins")
    begin_sizes = begins.agg(F.sort_array(F.collect_set(F.length("_begin")))).scalar()
    return (spread(texts)
            .withColumn("_begin_sizes", begin_sizes)
            .withColumn("_b", F.explode(F.filter("_begin_sizes", lambda b: b <= size)))
            .withColumn("start", F.explode(F.sequence(F.lit(1), size - F.col("_b") + 1)))
            .withColumn("_begin", F.col(text).substr(start, F.col("_b")))
            .join(begins, [*scope, "_begin"])
            .withColumn("_h", F.explode(F.filter("_lengths", lambda h: h <= size - start + 1)))
            .withColumn("_head", F.col(text).substr(start, F.col("_h")))
            .join(heads, [*scope, "_head"])
            .withColumn("_n", F.explode(F.filter("_sizes", lambda n: n <= size - start + 1)))
            .withColumn(needle, F.col(text).substr(start, F.col("_n")))
            .drop("_begin_sizes", "_b", "_begin", "_lengths", "_h", "_head", "_sizes", "_n"))


def prefixes(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Texts that start with a needle, one row per such needle."""
    wanted = stage(needles.select(needle).distinct(), "needles")
    sizes = wanted.where(F.length(needle) > 0).agg(F.sort_array(F.collect_set(F.length(needle)))).scalar()
    cut = (texts.withColumn("_sizes", sizes)
           .withColumn("_n", F.explode(F.filter("_sizes", lambda n: n <= F.length(text))))
           .withColumn(needle, F.col(text).substr(F.lit(1), F.col("_n"))).drop("_sizes", "_n"))
    return cut.join(wanted, needle, "left_semi")


def occurrences(texts: DataFrame, text: str, needles: DataFrame, needle: str, scope: Sequence[str] = ()) -> DataFrame:
    """Substrings of ``texts`` that are needles (of the same ``scope``)."""
    on = [*scope, needle]
    wanted = stage(needles.select(*on).distinct(), "needles")
    return substrings(texts, text, wanted, needle, scope).join(wanted, on, "left_semi")


def first_containing(texts: DataFrame, text: str, needles: DataFrame, needle: str, hit: Column,
                     scope: Sequence[str] = ()) -> DataFrame:
    """Per needle: the smallest ``hit`` among the texts that contain it and how often it occurs."""
    return occurrences(texts, text, needles, needle, scope).groupBy(*scope, needle).agg(
        F.min(hit).alias("hit"), F.count(F.lit(1)).alias("n_hits"))


def first_contained(texts: DataFrame, text: str, needles: DataFrame, needle: str, by: Sequence[str], hit: str,
                    scope: Sequence[str] = ()) -> DataFrame:
    """Per row key ``by``: the smallest ``hit`` among the needles found inside its text."""
    best = stage(needles.groupBy(*scope, needle).agg(F.min(hit).alias(hit)), "needles")
    return (substrings(texts, text, best, needle, scope).join(best, [*scope, needle])
            .groupBy(*by).agg(F.min(hit).alias("hit")))


def first_verified(anchors: DataFrame, postings: DataFrame, on: Sequence[str], by: Sequence[str], order: str,
                   verify: Column) -> DataFrame:
    """Per ``by``: the smallest ``order`` among the postings of its anchors that pass ``verify``.

    A posting list may be long and shared by many anchors. So the first ``NEAR`` postings of every list are
    tried first. What they yield is final unless a list was cut before that point, as anything unseen comes
    after the cut; only what is not final meets the whole lists. ``anchors`` should be staged.
    """
    def best(asked: DataFrame, lists: DataFrame) -> DataFrame:
        return asked.join(lists, list(on)).where(verify).groupBy(*by).agg(F.min(order).alias("hit"))

    if anchors.isEmpty():
        return best(anchors, postings)
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(order))
    near = stage(postings.withColumn("_rank", rank).where(F.col("_rank") <= NEAR), "postings")
    cuts = near.where(F.col("_rank") == NEAR).select(*on, F.col(order).alias("_cut"))
    unseen_from = anchors.join(cuts, list(on)).groupBy(*by).agg(F.min("_cut").alias("_cut"))
    state = stage(anchors.select(*by).distinct().join(best(anchors, near.drop("_rank")), list(by), "left")
                  .join(unseen_from, list(by), "left"), "state")
    final = F.col("_cut").isNull() | F.coalesce(F.col("hit") <= F.col("_cut"), F.lit(False))
    done = state.where(final & F.col("hit").isNotNull()).select(*by, "hit")
    rest = state.where(~final).select(*by)
    if rest.isEmpty():
        return done
    return done.unionByName(best(anchors.join(rest, list(by), "left_semi"), postings))
