"""Tables that grow by micro-batches and survive their repetition.

Every batch writes a folder named by its number, and a repeated batch replaces its own. What a batch reads are the folders of earlier
batches only, so it finds the same however often it runs. From time to time a batch also writes everything so far as one base;
what came before the base before that is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..staging import delete_folder

EVERY = 16


class BatchLog:
    """``schema`` names the columns; readers also get ``batch``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, every: int = EVERY, by: tuple[str, ...] = ()):
        self.spark, self.folder, self.schema, self.every, self.by = spark, folder.rstrip("/"), schema, every, by

    def _batches(self, kind: str) -> list[int]:
        """Batches written whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.folder}/{kind}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = [f.getPath().getName() for f in files.listStatus(root)]
        return sorted(int(n[6:]) for n in found if n.startswith("batch=") and files.exists(path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def before(self, batch: int) -> DataFrame:
        """All rows of earlier batches: the newest base and what was added since."""
        base = max((b for b in self._batches("base") if b < batch), default=-1)
        added = [b for b in self._batches("added") if base < b < batch]
        parts = [(f"{self.folder}/base/batch={base}", base)] * (base >= 0) + [(f"{self.folder}/added/batch={b}", b) for b in added]
        rows = self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(-1).cast("long"))
        for path, b in parts:
            rows = rows.union(self.spark.read.schema(self.schema).parquet(path).withColumn("batch", F.lit(b).cast("long")).select(*rows.columns))
        return rows

    def add(self, batch: int, rows: DataFrame) -> None:
        self._write(f"{self.folder}/added/batch={batch}", rows)

    def due(self, batch: int) -> bool:
        return batch % self.every == self.every - 1

    def rebase(self, batch: int, rows: DataFrame) -> None:
        """``rows`` stand for everything up to and with the batch from now on."""
        old = [b for b in self._batches("base") if b < batch]
        self._write(f"{self.folder}/base/batch={batch}", rows)
        if old:
            for kind in ("added", "base"):
                for b in self._batches(kind):
                    if b < old[-1] or kind == "added" and b == old[-1]:
                        delete_folder(self.spark, f"{self.folder}/{kind}/batch={b}")

    def _write(self, path: str, rows: DataFrame) -> None:
        columns = [c for c in self.spark.createDataFrame([], self.schema).columns]
        writer = rows.select(*columns).write.mode("overwrite")
        (writer.partitionBy(*self.by) if self.by else writer).parquet(path)
