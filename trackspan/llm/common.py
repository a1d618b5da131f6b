"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

# Executors get these functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ASCII letters and digits and every byte of a non-ASCII character make words; letters A-Z become a-z.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
                   for c in range(256))
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words, letters not yet lower-cased
PIECE_BYTES = 1 << 20


def ship(module: str) -> None:
    """Has the functions of a module travel by value with the tasks that use them."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process of the executor."""
    return sys.modules["builtins"].__dict__.setdefault("_trackspan_worker_cache", {})


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def word_pieces(text: bytes | None, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in lists that cover about ``size`` bytes each, so a long text is never one list."""
    if not text:
        return
    plain, start = text.translate(WORD_BYTES), 0
    while start < len(plain):
        end = len(plain) if start + size >= len(plain) else plain.find(b" ", start + size)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def word_codes(text: bytes | None, code: Callable[[bytes], int], dtype) -> np.ndarray:
    """One number per word of a text."""
    pieces = [np.fromiter(map(code, ws), dtype=dtype, count=len(ws)) for ws in word_pieces(text)]
    return pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.empty(0, dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_array(text: Column) -> Column:
    """The words of :func:`words_of` as a Spark expression; null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def fresh(name: str, df: DataFrame) -> str:
    """A column name the frame does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema, *then: str) -> DataFrame:
    """Runs ``fn`` on complete groups of equal ``key`` (a long), many small groups at a time.

    ``fn`` gets the rows and the positions where groups begin, with the number of rows as the last one. Groups must be
    bounded by the caller; a task holds one Arrow batch and the group that is not complete yet. Rows of a group are sorted
    by the columns ``then``.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            keys = table.column(key).to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            out = fn(table, bounds)
            return [] if out is None else [out]

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            if last is not None and keys[0] != last:
                yield from flush(held)
                held = []
            cuts = np.flatnonzero(keys[1:] != keys[:-1])
            if len(cuts):
                yield from flush([*held, batch.slice(0, cuts[-1] + 1)])
                held = [batch.slice(cuts[-1] + 1)]
            else:
                held.append(batch)
            last = keys[-1]
        if held:
            yield from flush(held)

    return df.repartition(F.col(key)).sortWithinPartitions(key, *then).mapInArrow(run, schema)
