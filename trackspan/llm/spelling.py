"""Spelling variants of words, grouped by one-edit neighbours found in a reduced alphabet.

Letters are hashed to a few symbols. Words that are one edit apart have reduced forms that are at most one edit apart, so the
full one-edit neighbourhood of each reduced word, a few hundred forms instead of thousands, is generated and joined to
the reduced vocabulary, and what meets is verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .common import mix64, ship

ship(__name__)

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
SLIPS = 31
SYMBOLS = 8
MOST_BITS, BITS_PER_WORD, BLOCK_BITS = 1 << 28, 64, 1 << 15
BATCH_CELLS = 1 << 21
STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
STEP_BACK = pow(STEP, -1, 1 << 64)


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all texts with at least so many letters and occurrences.

    A word is a longest run of letters, A-Z in lower case. Every 31st occurrence, by the CRC-32 of ``<doc_id>:<run>``, loses
    the letter at that number modulo its length.
    """
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    lowered = named.select("id", F.translate("run", CAPITALS, SMALL).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    # Position is h % length + 1; a run keeps what stands before and after it.
    cut = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    found = hashed.select(F.when(F.col("h") % SLIPS == 0, cut).otherwise(F.col("run")).alias("word"))
    return (found.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_count))


def symbols_of(points: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol, from 1, of each letter."""
    return (mix64(points.astype(np.uint64) + np.uint64(7)) % np.uint64(symbols)).astype(np.uint64) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out, x = [], 1
    for _ in range(n):
        out.append(x)
        x = x * STEP % (1 << 64)
    return np.array(out, np.uint64)


def _by_length(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of words of one length and their letters as a matrix."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for first in range(0, len(at), max(1, BATCH_CELLS // (int(size) * 2 * SYMBOLS))):
            own = at[first:first + max(1, BATCH_CELLS // (int(size) * 2 * SYMBOLS))]
            text = "".join(found[i] for i in own)
            yield own, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(own), size)


def reduced(matrix: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """One number per word: its symbols as digits of a number modulo 2^64, the first letter lowest."""
    return (symbols_of(matrix, symbols) * _powers(matrix.shape[1])).sum(axis=1, dtype=np.uint64)


def neighbourhood(matrix: np.ndarray, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every distinct form at most one edit from the reduced form of each word."""
    n, size = matrix.shape
    own, power = symbols_of(matrix, symbols), _powers(size + 1)
    digits = own * power[:size]
    upto = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(digits, axis=1, dtype=np.uint64)], axis=1)
    whole = upto[:, -1:]
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    rows, codes = [np.arange(n)], [whole[:, 0]]

    def add(values: np.ndarray, distinct: np.ndarray) -> None:
        at = np.nonzero(distinct)
        rows.append(at[0])
        codes.append(values[at])

    # Of equal letters in a row, deleting any one gives the same form, as does inserting one more at any place among them.
    last = np.concatenate([own[:, 1:] != own[:, :-1], np.ones((n, 1), bool)], axis=1)
    add(upto[:, :-1] + (whole - upto[:, 1:]) * np.uint64(STEP_BACK), last)
    other = every[None, None, :] != own[:, :, None]
    add((whole - digits)[:, :, None] + every[None, None, :] * power[None, :size, None], other)
    put = np.concatenate([other, np.ones((n, 1, symbols), bool)], axis=1)
    add((upto + (whole - upto) * np.uint64(STEP))[:, :, None] + every[None, None, :] * power[None, :, None], put)
    return np.concatenate(rows), np.concatenate(codes)


def _coded(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """``word, n, code``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            codes = np.empty(len(found), np.uint64)
            for at, matrix in _by_length(found):
                codes[at] = reduced(matrix, symbols)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64))], names=["word", "n", "code"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, code long")


def _place(codes: np.ndarray, bits: int) -> np.ndarray:
    """Where a number stands in a bitmap."""
    return mix64(codes) & np.uint64(bits - 1)


def known_forms(coded: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the hashed reduced forms and its size in bits: 64 per word, at most 2^28 (32 MB)."""
    n = coded.count()
    bits = min(MOST_BITS, max(BLOCK_BITS, 1 << (BITS_PER_WORD * n - 1).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(batch.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + 1)], names=["at"])

    places = coded.select("code").mapInArrow(run, "at long")
    blocks = places.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for block, raw in blocks.collect():
        first = (block - 1) * BLOCK_BITS // 8
        out[first:first + len(raw)] = np.frombuffer(bytes(raw), np.uint8)
    return out, bits


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, other, other_n`` for every word of ``word, n`` (distinct) and each one that differs by one letter put in, left out or replaced."""
    coded = stage(_coded(vocabulary, symbols), "words")
    bitmap, bits = known_forms(coded)
    held = coded.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for at, matrix in _by_length(batch.column(0).to_pylist()):
                rows, codes = neighbourhood(matrix, symbols)
                place = _place(codes, bits)
                live = np.flatnonzero(known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(at[rows[live]])) for c in batch.columns), pa.array(codes[live].view(np.int64))], names=["word", "n", "code"])

    forms = coded.select("word", "n").mapInArrow(run, "word string, n long, code long")
    others = coded.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "code")
    return forms.join(others, "code").where(F.expr("levenshtein(word, other, 1) = 1")).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last word when forms are followed. Forms never lead back.

    Each round follows twice as many steps as the one before.
    """
    links = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES,
                      symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts with enough letters and occurrences.

    Near words differ by exactly one letter put in, left out or replaced. A word's form is its near word of largest ``n`` (of
    equal ones the first in code-point order) if that is at least ``times`` its own, else null; its root is where forms end,
    itself without one. Null and empty texts have no words; a null id counts as an empty one; repeated rows count again; an
    empty table gives no rows; other columns are not read.
    """
    vocabulary = stage(words(docs, least_letters, least_count), "vocabulary")
    best = (near_words(vocabulary, symbols).groupBy("word", "n")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
            .select("word", "n_near", F.when(-F.col("best.less") >= times * F.col("n"), F.col("best.other")).alias("form"), (-F.col("best.less")).alias("form_n")))
    best = stage(best, "near-words")
    ends = roots(best.where("form IS NOT NULL"))
    return (vocabulary.join(best, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n")))


# The CRC-32 table is made by its rule; a string's bytes are read from its hexadecimal form.
ORACLE = r"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda j: CAST('0x' || substr(x, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT))),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM counted, tbl),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
dels AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM words, range(1, length(word) + 1) r(i)),
near AS (SELECT a.word, b.word AS other, b.n FROM dels a JOIN dels b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, w.word, w.n FROM dels a JOIN words w ON a.d = w.word
         UNION SELECT w.word, a.word, a.n FROM dels a JOIN words w ON a.d = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
           FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, 0 AS steps FROM formed UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON c.here = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
