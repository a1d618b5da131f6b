"""Shared intermediate results and how long they live."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str | None:
    """The folder all executors see, as the session names it.

    A local session without the setting, as in tests, has all its executors in one process and gets a
    temporary folder of its own. On a cluster nothing stands in for the setting.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named or not spark.sparkContext.master.startswith("local"):
        return named or None
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL_FOLDERS[application]


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system; nothing happens if it is not there."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(hadoop_path, True)
    files.cancelDeleteOnExit(hadoop_path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)


class Scope:
    """Owns the folders and persisted tables registered with it until it is released."""

    def __init__(self):
        self._held: list[tuple[SparkSession, str | DataFrame]] = []

    def own(self, spark: SparkSession, held: str | DataFrame) -> None:
        self._held.append((spark, held))

    def paths(self) -> list[str]:
        return [h for _, h in self._held if isinstance(h, str)]

    def release(self) -> None:
        held, self._held = self._held, []
        for spark, x in held:
            if isinstance(x, str):
                delete_folder(spark, x)
            else:
                x.unpersist()


_SCOPES: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


@contextmanager
def scope() -> Iterator[Scope]:
    """What is staged inside is released at the end, by an error too. Results that are still lazy then must be staged with ``kept``."""
    own = Scope()
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield own
    finally:
        _SCOPES.reset(token)
        own.release()


@contextmanager
def staging_into(own: Scope) -> Iterator[Scope]:
    """What is staged inside belongs to ``own``, which lives on; another may release it."""
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield own
    finally:
        _SCOPES.reset(token)


def own_folder(spark: SparkSession, path: str) -> None:
    """Has the innermost open scope, or the application's end, delete a folder."""
    if _SCOPES.get():
        _SCOPES.get()[-1].own(spark, path)
    delete_at_exit(spark, path)


def stage(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """``df`` computed once for several readers, who then plan against its real size.

    Written as a table to the shared folder, where it outlives any executor, keeps column pruning and filter
    push-down, and is deleted when the innermost open scope ends (``kept``: the one around that), or without one when
    the application ends. Without such a folder it is persisted, and lost parts are computed again.
    """
    spark = df.sparkSession
    owners = _SCOPES.get()[:-1] if kept else _SCOPES.get()
    folder = shared_dir(spark)
    if folder is None:
        held = df.persist(StorageLevel.MEMORY_AND_DISK)
        if kept:
            held.count()  # its inputs may go before it is read
        if owners:
            owners[-1].own(spark, held)
        return held
    path = f"{folder.rstrip('/')}/trackspan-{name}-{uuid.uuid4().hex}"
    if owners:
        owners[-1].own(spark, path)
    delete_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class _Version:
    """One load of a snapshot. It goes when it is no longer current and nobody reads it."""

    def __init__(self, df: DataFrame, owned: Scope, path: str | None, loaded_at: float):
        self.df, self.owned, self.path, self.loaded_at = df, owned, path, loaded_at
        self.readers, self.current = 0, True

    def seen_by(self, spark: SparkSession | None) -> DataFrame:
        if spark is None or spark is self.df.sparkSession or self.path is None:
            return self.df
        return spark.read.schema(self.df.schema).parquet(self.path)


class Snapshot:
    """The enriched tickets, loaded again after ``ttl`` seconds or on request. Empty loads are not kept.

    Sessions read it inside ``reading()``. A new load takes the place of the old one when it is whole; who reads the old one
    until then, or after, goes on reading it, and it is released when the last of them is done. While one caller
    loads, others get what is there.
    """

    def __init__(self, load: Callable[[], DataFrame], ttl: float = 300.0, clock: Callable[[], float] = time.time):
        self._load, self._ttl, self._clock = load, ttl, clock
        self._state, self._loading = threading.Lock(), threading.Lock()
        self._version: _Version | None = None

    @property
    def loaded_at(self) -> float | None:
        version = self._version
        return version.loaded_at if version else None

    def _due(self, force_refresh: bool, asked_at: float) -> bool:
        version = self._version
        return version is None or asked_at - version.loaded_at >= self._ttl or force_refresh

    def _refresh(self, asked_at: float) -> DataFrame | None:
        """Loads a new version; returns the rows of an empty load, which is not kept."""
        owned = Scope()
        with staging_into(owned):
            loaded = stage(self._load(), "snapshot")
        if loaded.isEmpty():
            self._replace(None)
            return loaded
        path = (owned.paths() or [None])[-1]
        self._replace(_Version(loaded, owned, path, asked_at))
        return None

    def _replace(self, version: _Version | None) -> None:
        with self._state:
            old, self._version = self._version, version
            if old:
                old.current = False
            unread = old is not None and old.readers == 0
        if unread:
            old.owned.release()

    def get(self, force_refresh: bool = False) -> DataFrame:
        """The rows for a caller that is alone: the next refresh may release them."""
        now = self._clock()
        if self._due(force_refresh, now):
            with self._loading:
                if self._due(force_refresh, now) and (empty := self._refresh(now)) is not None:
                    return empty
        return self._version.df

    def _taken(self, force_refresh: bool) -> _Version | DataFrame:
        """The current version with one more reader, or the rows of an empty load."""
        now = self._clock()
        while True:
            # Only the first caller loads; while there is an older version the others do not wait for it.
            if self._due(force_refresh, now) and self._loading.acquire(blocking=self._version is None):
                try:
                    if self._due(force_refresh, now) and (empty := self._refresh(now)) is not None:
                        return empty
                finally:
                    self._loading.release()
            force_refresh = False
            with self._state:
                if self._version is not None:
                    self._version.readers += 1
                    return self._version

    @contextmanager
    def reading(self, spark: SparkSession | None = None, force_refresh: bool = False) -> Iterator[DataFrame]:
        """The rows, as a table of ``spark``, that stay readable until the block ends."""
        version = self._taken(force_refresh)
        if isinstance(version, DataFrame):
            yield version
            return
        try:
            yield version.seen_by(spark)
        finally:
            with self._state:
                version.readers -= 1
                done = version.readers == 0 and not version.current
            if done:
                version.owned.release()

    def release(self) -> None:
        self._replace(None)
