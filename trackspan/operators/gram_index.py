"""A kept index for substring lookups.

``lookup`` cuts every text at every position for each call. An index does that once per text: a posting for every position
holds the three characters there, the text's id and the position. A needle is then looked up by one of its grams, a rare one:
where the gram stands in a text, the text has so many characters that may be the needle, and they are joined to the needles.
Needles as long with the same gram at the same place are looked up at once, so the rows do not grow with their number.
Needles shorter than a gram are looked up by the grams they begin.

The index is a pair of logs in a shared folder, postings by hash bucket of the gram, so lookups read the buckets of their grams
alone. New and changed texts are added by batch; a changed text's old postings stay until the next base and
are refused by the text as it is now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..staging import stage
from ..streaming.batchlog import BatchLog
from .lookup import spread

GRAM = 3
BUCKETS = 64


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


class SubstringIndex:
    """Texts with a long ``id``, a ``text`` and the further columns of ``carried`` (a schema), which lookups return."""

    def __init__(self, spark: SparkSession, folder: str, carried: str, buckets: int = BUCKETS, every: int = 16):
        self.spark, self.buckets = spark, buckets
        self.texts = BatchLog(spark, f"{folder}/texts", f"id long, text string, live boolean, {carried}", every)
        self.postings = BatchLog(spark, f"{folder}/postings", "gram string, id long, start int, bucket int", every, ("bucket",))

    def update(self, batch: int, texts: DataFrame, removed: DataFrame | None = None) -> None:
        """Adds texts, or other texts for known ids, and takes out the ids of ``removed``. A batch that comes again changes nothing."""
        columns = self.spark.createDataFrame([], self.texts.schema).columns
        arrived = texts.withColumn("live", F.lit(True)).select(*columns)
        if removed is not None:
            arrived = arrived.unionByName(removed.select("id").withColumn("live", F.lit(False)), allowMissingColumns=True)
        arrived = stage(arrived, "texts")
        self.texts.add(batch, arrived)
        self.postings.add(batch, self._cut(arrived.where("live")))
        if self.texts.due(batch):
            current = stage(self.current(batch), "texts")
            self.texts.rebase(batch, current.withColumn("live", F.lit(True)))
            self.postings.rebase(batch, self._cut(current))

    def _cut(self, texts: DataFrame) -> DataFrame:
        """A posting per position; at the end of a text its gram is shorter."""
        places = spread(texts.select("id", "text")).withColumn("start", F.explode(F.sequence(F.lit(1), F.length("text"))))
        cut = places.where(F.length("text") > 0).select(F.col("text").substr(F.col("start"), F.lit(GRAM)).alias("gram"), "id", "start")
        return cut.withColumn("bucket", _bucket(F.col("gram"), self.buckets))

    def current(self, batch: int | None = None) -> DataFrame:
        """The texts after a batch, by default the last one."""
        rows = self.texts.before((1 << 62) if batch is None else batch + 1)
        content = [c for c in rows.columns if c not in ("id", "batch")]
        last = rows.groupBy("id").agg(F.max(F.struct("batch", F.struct(*content).alias("t"))).alias("v"))
        return last.select("id", "v.t.*").where("live").drop("live")

    def _buckets_of(self, grams: DataFrame) -> list[int]:
        """At most the number of buckets."""
        return [r.bucket for r in grams.select(_bucket(F.col("gram"), self.buckets).alias("bucket")).distinct().collect()]

    def occurrences(self, needles: DataFrame, needle: str) -> DataFrame:
        """Every place where a needle stands in a text: the text's columns, ``needle`` and the one-based ``start``."""
        wanted = stage(needles.select(needle).where(F.length(needle) > 0).distinct(), "needles")
        postings = self.postings.before(1 << 62)
        whole, short = wanted.where(F.length(needle) >= GRAM), wanted.where(F.length(needle) < GRAM)
        at = F.explode(F.sequence(F.lit(1), F.length(needle) - (GRAM - 1)))
        grams = stage(whole.select(needle, at.alias("offset")).withColumns(
            {"gram": F.col(needle).substr(F.col("offset"), F.lit(GRAM)), "size": F.length(needle)}), "grams")
        near = postings.where(F.col("bucket").isin(self._buckets_of(grams) or [-1])) if not grams.isEmpty() else postings.where("false")
        held = near.join(grams.select("gram").distinct(), "gram", "left_semi")
        counts = stage(held.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
        # A needle with a gram that no text has is nowhere. Needles as long that have a gram at the same offset share its postings:
        # of a needle's grams the one is looked up that has the fewest for each of them, and no posting meets the needles one by one.
        shares = grams.groupBy("gram", "offset", "size").agg(F.count("*").alias("m"))
        rated = grams.join(counts, "gram", "left").join(shares, ["gram", "offset", "size"]).groupBy(needle).agg(
            F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min(F.struct(F.expr("n / m").alias("cost"), "offset", "gram", "size")).alias("r"))
        shapes = stage(rated.where("least > 0").select("r.gram", "r.offset", "r.size").distinct(), "shapes")
        found = near.join(shapes, "gram").select("id", (F.col("start") - F.col("offset") + 1).alias("start"), "size").where("start > 0")
        if not short.isEmpty():
            begun = postings.select("gram").distinct().select("gram", F.explode(F.sequence(F.lit(1), F.least(F.length("gram"), F.lit(GRAM - 1)))).alias("size"))
            begun = begun.withColumn(needle, F.col("gram").substr(F.lit(1), F.col("size"))).join(short, needle, "left_semi").select("gram", "size")
            found = found.unionByName(postings.join(begun, "gram").select("id", "start", "size"))
        cut = self.current().join(found.repartition("id").distinct(), "id").withColumn(needle, F.col("text").substr(F.col("start"), F.col("size")))
        return cut.where(F.length(needle) == F.col("size")).join(wanted, needle, "left_semi").drop("id", "size")
