"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage

SIZE_PATTERN = r"[^\x20\x09-\x0D]+"
CYCLE = (3, 1, 2)
SHARE, MOST_COPIES, SEED = 1.5, 2, "pareto"
KEY_BITS, LEVEL_BITS = 52, 13


def text_size(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, cycle=CYCLE, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to one row per ``source`` with its ``source_size``.

    Sources in code point order (null last) weigh by the cycle and divide ``share`` of all sizes. No target exceeds
    ``most`` times its source; the excess goes to the others by weight. The windows run over the list of sources, which
    has one row per source however many documents there are.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    ranked = (sources.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
              .withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
              .withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(everything)))
    # Filling from the smallest ratio up: the level of a row is what a unit of weight gets if all rows before it are full.
    levels = ranked.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    settled = levels.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return settled.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def _scales(sized: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Per source the factor from weight to expected copies, so that copies up to ``most`` add up to the target."""
    goals = targets.select(F.col("source").alias("of"), "target")
    scales, count = None, None
    while True:
        rows, full = sized.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of"), F.lit(False)
        if scales is not None:
            rows = rows.join(scales.select("of", "scale"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
            full = F.col("scale") * F.col("weight") >= most
        words = F.col("size").cast("double")
        found = rows.groupBy("source").agg(
            F.first("target").alias("target"), F.sum(F.when(full, words).otherwise(0.0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(words * F.col("weight"))).alias("open"), F.sum(full.cast("long")).alias("n_full"))
        scale = F.when(F.col("open") > 0, (F.col("target") - most * F.col("full")) / F.col("open")).otherwise(F.lit(float("inf")))
        now = stage(found.select(F.col("source").alias("of"), "target", scale.alias("scale"), "n_full"), "scales")
        before, count = count, now.agg(F.sum("n_full")).first()[0]
        if count == before or not count and scales is not None:
            return now.drop("n_full")
        scales = now


def _plan(sized: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Per source (``of``) its target and the factor from weight to expected copies."""
    if "weight" in sized.columns:
        return _scales(_weighed(sized), targets, most)
    return targets.select(F.col("source").alias("of"), "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("scale"))


def _weighed(rows: DataFrame) -> DataFrame:
    """``weight`` as a number that is not negative; 1 without one."""
    weight = F.coalesce(F.greatest("weight", F.lit(0.0)), F.lit(0.0)) if "weight" in rows.columns else F.lit(1.0)
    return rows.withColumn("weight", weight.cast("double"))


def _drawn(rows: DataFrame, plan: DataFrame, most: int, seed: str) -> DataFrame:
    """Adds ``target``, the certain copies ``whole`` and, where one more is a matter of chance, its ``rank``."""
    rows = _weighed(rows).join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = F.when(F.col("weight") > 0, F.least(F.lit(float(most)), F.col("scale") * F.col("weight"))).otherwise(0.0)
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
            .cast("double") + 0.5) / float(1 << KEY_BITS)
    odds = F.col("draw") / (1 - F.col("draw")) * ((1 - F.col("part")) / F.col("part"))
    return (rows.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long"))
            .withColumn("part", F.col("expected") - F.col("whole")).withColumn("draw", draw)
            .withColumn("rank", F.when(F.col("part") > 0, F.floor(odds / (1 + odds) * float(1 << KEY_BITS)).cast("long")))
            .drop("expected", "part", "draw", "weight", "scale"))


def _cuts(rows: DataFrame) -> DataFrame:
    """Per source (``of``) the rank at which it is full; a source without a row is taken up to its last rank."""
    state = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("room"))
    state = stage(state.select("source", "room", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("used"), F.lit(None).cast("long").alias("held")), "cut")
    in_order = Window.partitionBy("source").orderBy("bin")
    for shift in range(KEY_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        s = state.withColumnRenamed("source", "of")
        inside = (rows.where("rank IS NOT NULL").join(s, F.col("source").eqNullSafe(F.col("of")))
                  .where(F.shiftright("rank", shift + LEVEL_BITS) == F.col("prefix")))
        bins = inside.groupBy("source", F.shiftright("rank", shift).alias("bin")).agg(
            F.sum("size").alias("held"), F.first("room").alias("room"), F.first("used").alias("used"))
        bins = bins.withColumn("upto", F.col("used") + F.sum("held").over(in_order)).where("upto > room")
        state = stage(bins.groupBy("source").agg(F.min(F.struct("bin", "upto", "held", "room")).alias("x"))
                      .select("source", F.col("x.room").alias("room"), F.col("x.bin").alias("prefix"),
                              (F.col("x.upto") - F.col("x.held")).alias("used"), F.col("x.held").alias("held")), "cut")
    return state.select(F.col("source").alias("of"), F.col("prefix").alias("cut"), (F.col("used") + F.col("held") - F.col("room") < F.col("room") - F.col("used")).alias("with_cut"), F.lit(True).alias("has_cut"))


def _counted(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``copies`` to drawn rows."""
    out = rows.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    extra = F.col("rank").isNotNull() & (F.col("has_cut").isNull() | (F.col("rank") < F.col("cut")) | ((F.col("rank") == F.col("cut")) & F.col("with_cut")))
    return out.withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).drop("of", "cut", "with_cut", "has_cut")


def copies(sized: DataFrame, targets: DataFrame, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """Adds ``copies`` (0 to ``most``) to rows with ``doc_id, source, size`` and optionally ``weight``.

    A document is expected in ``scale * weight`` copies, at most ``most``; the whole part is certain. Its fraction is the
    inclusion probability of one more copy: the documents of a source are ranked by their random odds over their
    inclusion odds, and the ones that rank first make up the words still missing. Random numbers are hashes of the seed
    and doc_id, so reruns agree. The rank at which a source is full is found by four rounds of sums over 8192 rank
    intervals, without sorting a source or holding it in one task. Rows that tie in rank (the same doc_id) are taken
    together or not at all. Null ids, sources and weights are allowed (a null weight is 0), empty documents take nothing.
    """
    rows = stage(_drawn(sized, _plan(sized, targets, most), most, seed).select("doc_id", "source", "size", "target", "whole", "rank"), "ranked")
    return _counted(rows, _cuts(rows)).select("doc_id", "source", "size", "target", "copies")


def _sized(docs: DataFrame, weight: Column | None) -> DataFrame:
    return docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), *([weight.cast("double").alias("weight")] if weight is not None else []))


def _targets(sized: DataFrame, cycle, share: float, most: int) -> DataFrame:
    return stage(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, share, most), "targets")


def mix(docs: DataFrame, cycle=CYCLE, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row of ``doc_id, text, source``.

    An empty table gives an empty result; a null or empty text has size 0 and is never taken. Repeated rows are rows of
    their own, though the same doc_id ranks alike. Other columns are not read.
    """
    sized = stage(_sized(docs, weight), "sizes")
    targets = _targets(sized, cycle, share, most)
    chosen, t = copies(sized, targets, most, seed), targets.select(F.col("source").alias("of"), "source_size")
    return chosen.join(t, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, cycle=CYCLE, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them; their order is not defined.

    A row's copies follow from its doc_id, source, size and weight and the cut of its source, so texts are not shuffled: the list of
    sources meets them where they are. Nulls, ties and repeated rows count as in :func:`mix`.
    """
    sized = stage(_sized(docs, weight), "sizes")
    targets = _targets(sized, cycle, share, most)
    plan = stage(_plan(sized, targets, most), "plan")
    cuts = stage(_cuts(stage(_drawn(sized, plan, most, seed).select("doc_id", "source", "size", "target", "whole", "rank"), "ranked")), "cuts")
    # The row travels as one value, so that its columns may have any names.
    own = [weight.cast("double").alias("weight")] if weight is not None else []
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", text_size(F.col("text")).alias("size"), *own)
    taken = _counted(_drawn(rows, plan, most, seed), cuts).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
