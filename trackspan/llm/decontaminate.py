"""Benchmark decontamination by a broadcast hash set of normalised word windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .common import PIECE_BYTES, WORD_PATTERN, fresh, ship, word_codes, words_of

ship(__name__)

WINDOW = 10
BLOCK_WINDOWS = 200_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SCAN = "row long, doc_id long, n_words long, spans array<struct<first:long,end:long>>, items array<string>"
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``window, items``: the distinct windows of ``n`` words (all words of a shorter item) and the item_ids that have them.

    An item without words, or a null text, has no window. A window of an item with a null id has no item to name, though
    it counts as a hit. Repeated items add nothing.
    """
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                found = sorted({b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}) if words else []
                for first in range(0, len(found), 10_000):
                    own = found[first:first + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([item] * len(own), pa.string())], names=["window", "item"])

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).mapInArrow(cut, "window binary, item string")
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


class WindowSet:
    """Windows as numbers: word codes, a hash per window, and the items of each.

    Built on the driver; what is broadcast are its plain parts, as executors need not have this package.
    """

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.codes: dict[bytes, int] = {}
        self.tables: list[tuple[int, np.ndarray, np.ndarray, list[list[str]]]] = []
        by_length: dict[int, list] = {}
        for window, items in rows:
            words = window.split(b" ")
            by_length.setdefault(len(words), []).append(([self.codes.setdefault(w, len(self.codes) + 1) for w in words], items))
        for length, own in sorted(by_length.items()):
            matrix = np.array([c for c, _ in own], dtype=np.int32)
            hashes = self.hashed(matrix)
            order = np.argsort(hashes, kind="stable")
            self.tables.append((length, hashes[order], matrix[order], [own[i][1] for i in order]))

    def parts(self) -> tuple:
        return self.codes, self.tables

    @classmethod
    def of(cls, parts: tuple) -> WindowSet:
        out = cls.__new__(cls)
        out.codes, out.tables = parts
        return out

    @staticmethod
    def hashed(matrix: np.ndarray) -> np.ndarray:
        out = np.zeros(len(matrix), dtype=np.uint64)
        for column in matrix.T:
            out = (out + column.astype(np.uint64)) * FACTOR
            out ^= out >> np.uint64(29)
        return out

    def hits(self, codes: np.ndarray) -> list[tuple[np.ndarray, int, list]]:
        """Per window length: positions where a window occurs, the length, and the items found at each."""
        found = []
        unknown = np.concatenate([[0], np.cumsum(codes == 0)])
        for length, hashes, matrix, items in self.tables:
            if len(codes) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(at):
                continue
            seen = np.lib.stride_tricks.sliding_window_view(codes, length)
            for begin in range(0, len(at), 1 << 18):
                some = at[begin:begin + (1 << 18)]
                h = self.hashed(seen[some])
                place = np.searchsorted(hashes, h)
                live = np.flatnonzero((place < len(hashes)) & (hashes[np.minimum(place, len(hashes) - 1)] == h))
                some, place = some[live], place[live]
                h = h[live]
                # Equal hashes are verified word by word; windows that share a hash stand next to each other.
                while len(some):
                    same = (matrix[place] == seen[some]).all(axis=1)
                    if same.any():
                        found.append((some[same], length, [items[p] for p in place[same]]))
                    place = place + 1
                    more = ~same & (place < len(hashes))
                    more &= hashes[np.minimum(place, len(hashes) - 1)] == h
                    some, place, h = some[more], place[more], h[more]
        return found


def window_sets(benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK_WINDOWS) -> Iterator[WindowSet]:
    """The windows of the benchmark in sets of about ``block``, each small enough to broadcast whatever its total.

    A set holds at most n words per window: 200,000 windows are about 20 MB.
    """
    windows = stage(item_windows(benchmark, n), "windows")
    blocks = -(-windows.count() // block)
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        yield WindowSet([(bytes(w), list(i)) for w, i in part.collect()])


def _documents(texts, codes) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and their word codes, about a megabyte of text at a time."""
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        raw = text.as_buffer().to_pybytes() if text.is_valid else None
        rows.append(row)
        held.append(word_codes(raw, lambda w: codes.get(w, 0), np.int32))
        size += len(raw or b"")
        if size >= PIECE_BYTES:
            yield rows, held
            rows, held, size = [], [], 0
    if rows:
        yield rows, held


def found_in(texts, windows: WindowSet) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str]]]:
    """Row, number of words, hit word spans (merged) and items of each text."""
    for rows, held in _documents(texts, windows.codes):
        lengths = np.array([len(h) for h in held])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        gap = np.zeros(1, np.int32)  # an unknown word between texts, so that no window spans two
        codes = np.concatenate([x for h in held for x in (h, gap)])
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for at, length, named in windows.hits(codes):
            for doc, place, names in zip(np.searchsorted(starts, at, side="right") - 1, at, named):
                first = int(place - starts[doc])
                spans.setdefault(int(doc), []).append((first, first + length))
                items.setdefault(int(doc), set()).update(names)
        for i, row in enumerate(rows):
            yield row, int(lengths[i]), merged(spans.get(i, [])), items.get(i, set())


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """``row, doc_id, n_words, spans, items`` for every row: hit word spans and the items whose windows occur.

    ``row`` numbers the input rows. One pass over the documents per set of windows; with more than one set the passes are
    merged per row.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCAN.replace("doc_id long", f"doc_id {kind}")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def scanner(held):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = list(found_in(batch.column(2), WindowSet.of(held.value)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array([g[1] for g in got], pa.int64()),
                    pa.array([[{"first": a, "end": b} for a, b in g[2]] for g in got], span),
                    pa.array([sorted(g[3]) for g in got], pa.list_(pa.string()))],
                    names=["row", "doc_id", "n_words", "spans", "items"])
        return run

    passes = [rows.mapInArrow(scanner(spark.sparkContext.broadcast(s.parts())), schema) for s in window_sets(benchmark, n, block)]
    if not passes:
        passes = [rows.mapInArrow(scanner(spark.sparkContext.broadcast(WindowSet([]).parts())), schema)]
    if len(passes) == 1:
        return passes[0]
    everything = passes[0]
    for p in passes[1:]:
        everything = everything.union(p)
    return everything.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def digest(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row of a scan."""
    kind = scanned.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, named, sums = [], [], []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                hits.append(sum(b - a for a, b in merged((s["first"], s["end"]) for s in spans)))
                named.append(len(items))
                sums.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(named, pa.int64()),
                pa.array(sums, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return scanned.select("doc_id", "n_words", "spans", "items").mapInArrow(run, DIGEST.replace("doc_id long", f"doc_id {kind}"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """What of each document is also in the benchmark, one row per row of ``doc_id, text``.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z in lower case. A word is hit if it lies in an
    occurrence of any window. Null and empty texts have no words and no hits; repeated rows and ids give a row each; an
    empty benchmark hits nothing; other columns are not read.
    """
    return digest(scan(docs, benchmark, n, block))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no window occurs. Nothing is shuffled."""
    text = fresh("raw_text", docs)

    def keeper(held):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not spans for _, _, spans, _ in found_in(batch.column(batch.num_columns - 1), WindowSet.of(held.value))]
                yield batch.filter(pa.array(keep, pa.bool_())).select(range(batch.num_columns - 1))
        return run

    out, first = docs, True
    for s in window_sets(benchmark, n, block):
        out = out if first else stage(out, "clean")  # one set in the executors at a time
        first = False
        out = out.withColumn(text, F.col("text").cast("binary")).mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(s.parts())), docs.schema)
    return out


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK_WINDOWS, put: str = "") -> DataFrame:
    """The rows of ``docs`` with each hit span of ``text`` replaced by ``put``; all else, and all other texts, as they are."""
    row, spans = fresh("span_row", docs), fresh("span_list", docs)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    hit = scan(docs, benchmark, n, block).where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(spans))
    word = re.compile(WORD_PATTERN)
    at = docs.columns.index("text")

    def cut(text: str | None, own: list | None) -> str | None:
        if text is None or not own:
            return text
        bounds = [(a, b) for a, b in merged((s["first"], s["end"]) for s in own)]
        out, upto, i = [], 0, 0
        for w, m in enumerate(word.finditer(text)):
            if i < len(bounds) and w == bounds[i][0]:
                out += [text[upto:m.start()], put]
            if i < len(bounds) and w == bounds[i][1] - 1:
                upto, i = m.end(), i + 1
        return "".join(out) + text[upto:]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return numbered.join(hit, row, "left").select(*[numbered[c] for c in docs.columns], spans).mapInArrow(run, docs.schema)
