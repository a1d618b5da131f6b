"""Ratcliff-Obershelp title similarity, the one function Spark has no built-in for."""

from __future__ import annotations

import heapq
import sys
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Executors get these functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHAR_BINS, PAIR_BINS = 64, 256
QUERIES_AT_ONCE, LEVELS_AT_ONCE = 256, 1024
SCORED = "scope string, q string, title string, score double, age long, key string"


@F.pandas_udf(T.DoubleType())
def title_ratio(query: pd.Series, title: pd.Series) -> pd.Series:
    """Ratio of (query, title). The argument order matters. Null when either is null."""
    return pd.Series([None if q is None or t is None else SequenceMatcher(None, q, t).ratio()
                      for q, t in zip(query, title)], dtype="float64")


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and hashed counts of characters and of neighbouring pairs, one row per text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.zeros((len(texts), CHAR_BINS), dtype=np.int32)
    pairs = np.zeros((len(texts), PAIR_BINS), dtype=np.int32)
    for row, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        chars[row] = np.bincount(codes % CHAR_BINS, minlength=CHAR_BINS)
        if len(codes) > 1:
            pairs[row] = np.bincount((codes[:-1] * 31 + codes[1:]) % PAIR_BINS, minlength=PAIR_BINS)
    return lengths, chars, pairs


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum over bins of the lesser count, for every row of ``a`` and every row of ``b``.

    The lesser of two counts is the number of levels that both reach, so the sums are a product of matrices of ones and zeros.
    """
    most = np.minimum(a.max(axis=0), b.max(axis=0))
    bins = np.repeat(np.arange(len(most)), most)
    level = np.arange(len(bins)) - np.repeat(np.cumsum(most) - most, most) + 1
    sums = np.zeros((len(a), len(b)), dtype=np.float32)
    for k in range(0, len(bins), LEVELS_AT_ONCE):
        some, at = bins[k:k + LEVELS_AT_ONCE], level[k:k + LEVELS_AT_ONCE]
        sums += (a[:, some] >= at).astype(np.float32) @ (b[:, some] >= at).astype(np.float32).T
    return sums.astype(np.int64)


def tile_bounds(queries: tuple, titles: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Per query and title a value that their ratio cannot exceed, and the number of characters they share at most.

    The matched characters M are at most the shared character count. Between two matching blocks at
    least one character of either text is unmatched, so there are at most la + lb - 2M + 1 blocks and
    at least M minus that many shared neighbouring pairs, hence 3M <= pairs + la + lb + 1. Hashing
    counts into bins can only raise both sums.
    """
    q_len, q_chars, q_pairs = queries
    t_len, t_chars, t_pairs = titles
    total = q_len[:, None] + t_len[None, :]
    chars = shared_counts(q_chars, t_chars)
    matched = np.minimum(chars, (shared_counts(q_pairs, t_pairs) + total + 1) // 3)
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0), chars


def upper_bounds(query: tuple, row: int, titles: tuple) -> np.ndarray:
    """A value no ratio of this query with each title can exceed."""
    return tile_bounds(tuple(part[row:row + 1] for part in query), titles)[0][0]


def best_of_tile(k: int, floor: float, contains_is_one: bool):
    """Scores one tile best bound first and keeps the ``k`` best titles of each query."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        # Plain objects: string columns of a pandas type of their own cannot be sent when empty.
        return pd.DataFrame(rows, columns=["scope", "q", "title", "score", "age", "key"], dtype=object)

    def score(key, queries: pd.DataFrame, titles: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or titles.empty:
            return frame([])
        titles = titles.sort_values(["age", "key"], ignore_index=True)
        texts, asked = titles["title"].tolist(), queries["q"].tolist()
        t_profiles, q_profiles = profiles(texts), profiles(asked)
        matchers: dict[int, SequenceMatcher] = {}
        out = []
        for row, q in enumerate(asked):
            if row % QUERIES_AT_ONCE == 0:
                block, shared = tile_bounds(tuple(part[row:row + QUERIES_AT_ONCE] for part in q_profiles), t_profiles)
            bounds, inside = block[row % QUERIES_AT_ONCE], set()
            if contains_is_one:
                inside = {i for i in np.flatnonzero(shared[row % QUERIES_AT_ONCE] == len(q)).tolist() if q in texts[i]}
                bounds[list(inside)] = 1.0
            best: list[tuple[float, int]] = []
            for i in (-bounds).argsort(kind="stable").tolist():
                if bounds[i] < floor or (len(best) == k and bounds[i] < best[0][0]):
                    break
                if i in inside:
                    value = 1.0
                else:
                    matcher = matchers.get(i)
                    if matcher is None:
                        matcher = matchers[i] = SequenceMatcher(None, "", texts[i])
                    matcher.set_seq1(q)
                    value = matcher.ratio()
                if value >= floor:
                    (heapq.heappushpop if len(best) == k else heapq.heappush)(best, (value, -i))
            out += [(key[0], q, texts[-i], value, int(titles["age"][-i]), titles["key"][-i]) for value, i in best]
        return frame(out)

    return score
