"""Toxic passages as maximum-scoring segments of word log-odds.

Words are scored by how much more often they stand in toxic than in other labelled texts: log-odds under a Dirichlet prior
whose mean is the word's share of the whole corpus, taken towards zero by two standard errors, less a margin that every word
pays. Occurrences count once per pair of neighbours, so copies of a passage teach nothing new. A linear scan gives all maximal
scoring segments of a text. How high segments of texts that are not toxic reach follows an extreme-value law; its two parameters
are fitted to them, and turn the segments of a text into one level of evidence, which a logistic curve maps to a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .common import fresh, ship, word_array, word_pieces
from .rules import held_out

ship(__name__)

CUTOFF = 0.5
MOST_LABELLED = 20_000
PRIOR = 1.0  # weight of the prior, in units of the toxic contexts
ERRORS = 2.0
MARGIN = 1.0
SIGNIFICANT = 0.05
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


# -- segments -------------------------------------------------------------------------------------------


def segments(hits: list[tuple[int, float]], margin: float = MARGIN) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``first, end, score`` of a sequence of words, in order.

    ``hits`` has the places and scores of scored words; every word costs ``margin``. A segment is maximal if all its proper
    parts score less and no segment around it has that property. Each segment knows the nearest one before it that begins
    at a lower total, so the search for it never looks at a segment twice and the scan takes linear time.
    """
    out: list[tuple[float, float, int, int, int]] = []  # total before, total after, first, end, place of the segment that begins lower
    total, upto = 0.0, 0
    for at, score in hits:
        total -= margin * (at - upto)
        upto = at + 1
        low, total = total, total + score - margin
        if total <= low:
            continue
        high, first, end = total, at, at + 1
        lower = len(out) - 1
        while lower >= 0 and out[lower][0] >= low:
            lower = out[lower][4]
        while lower >= 0 and out[lower][1] < high:
            low, _, first, _, link = out[lower]
            del out[lower:]
            lower = link
        out.append((low, high, first, end, lower))
    return [(first, end, high - low) for low, high, first, end, _ in out]


def evidence(scores: Iterable[float], n_words: int, rate: float, density: float) -> float:
    """Minus the logarithm of the chance that segments of a text that is not toxic reach such scores.

    The expected number of segments scoring s or more is density * n_words * exp(-rate * s). The r best ones are judged
    by the law of their sum, for every r, each at half the weight of the one before.
    """
    base, total, best = math.log(max(density * n_words, 1e-300)), 0.0, 0.0
    for r, score in enumerate(sorted(scores, reverse=True), 1):
        total += rate * score - base
        if r == 1:
            # Beyond 700 the inner exponential leaves the range of doubles, and the law is its own argument to all digits.
            own = total if total > 700 else -math.log(-math.expm1(-math.exp(-total))) if total > -3 else 0.0
        elif total > r:
            own = total - (r - 1) * (math.log(total) + math.log(2)) + math.lgamma(r + 1) + math.lgamma(r)
        else:
            continue
        best = max(best, own)
    return best


def expected(score: float, n_words: int, rate: float, density: float) -> float:
    """How many segments of such a score or more a text of that length has by chance."""
    return density * n_words * math.exp(-rate * score)


def scanned(text: bytes | None, lexicon: dict[bytes, float]) -> tuple[int, list[tuple[int, float]]]:
    """The number of words of a text, and place and score of the scored ones."""
    n, hits = 0, []
    for words in word_pieces(text):
        hits += [(n + i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
        n += len(words)
    return n, hits


# -- fitting --------------------------------------------------------------------------------------------


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, label, text`` of at most ``most`` labelled documents: those whose ids have the least hashes.

    Rows held out, labels other than 0 and 1, labels that contradict each other and null ids are not used; of several texts of
    an id the least counts.
    """
    own = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id")
           .agg(F.min("toxic").alias("label"), F.max("toxic").alias("other")).where("label = other"))
    own = stage(own.select("doc_id", "label", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(most), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(own.select("doc_id", "label")), "doc_id")
    return stage(rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "labelled")


def word_contexts(labelled: DataFrame) -> DataFrame:
    """``word, toxic, other``: in how many different pairs of neighbours a word stands in toxic and in other texts."""
    words = labelled.select("label", word_array(F.col("text")).alias("w"))
    around = F.transform("w", lambda x, i: F.struct(x.alias("word"), F.when(i > 0, F.get("w", i - 1)).alias("before"), F.get("w", i + 1).alias("after")))
    rows = words.select("label", F.explode(around).alias("c")).select("label", "c.*").distinct()
    return rows.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("other"))


def word_scores(docs: DataFrame, contexts: DataFrame, prior: float = PRIOR, errors: float = ERRORS) -> DataFrame:
    """``word, score, p_other`` of the words whose log-odds differ from zero by more than their uncertainty.

    ``p_other`` is the word's share in texts that are not toxic. Prior means are shares of the words of all documents.
    """
    everywhere = docs.select(F.explode(word_array(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    everywhere = everywhere.join(contexts, "word", "left").select("word", "n", "toxic", "other")
    counted = stage(everywhere.where("toxic IS NOT NULL").select("word", "n", "toxic", "other")
                    .union(everywhere.agg(F.lit(None).cast("string").alias("word"), F.sum("n"), F.sum("toxic"), F.sum("other"))), "word-counts")
    total = counted.where("word IS NULL").first()
    n_words, n_toxic, n_other = (float(x or 0) for x in total[1:])
    if not n_toxic or not n_other:
        return docs.sparkSession.createDataFrame([], "word string, score double, p_other double")
    weight = prior * n_toxic
    a = F.col("n") * (weight / n_words)
    toxic, other = F.col("toxic") + a, F.col("other") + a
    odds = F.log(toxic / (n_toxic + weight - toxic)) - F.log(other / (n_other + weight - other))
    rows = counted.where("word IS NOT NULL").select(
        "word", odds.alias("odds"), F.sqrt(1 / toxic + 1 / other).alias("error"), (other / (n_other + weight)).alias("p_other"))
    return rows.where(F.abs("odds") > errors * F.col("error")).select(
        "word", (F.col("odds") - F.signum("odds") * errors * F.col("error")).alias("score"), "p_other")


def decay_rate(scores: np.ndarray, shares: np.ndarray, margin: float) -> float:
    """The positive rate at which exp(rate * score) of a word has mean one, words that are not scored included."""
    rest = max(0.0, 1.0 - shares.sum())
    mean = lambda x: (shares * np.exp(np.minimum(x * (scores - margin), 700))).sum() + rest * math.exp(-x * margin)
    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return high


def _logistic(x: np.ndarray, label: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and weight of a logistic curve, the weight held back a little so that it stays finite."""
    b = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ (label - p) - ridge * np.array([0, b[1]])
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-9, ridge])
        step = np.linalg.solve(curve, gradient)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def scale(level: float) -> float:
    """Evidence on the scale that the logistic curve is fitted on."""
    return math.log1p(level)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, margin: float = MARGIN) -> dict:
    """The model as plain values: ``lexicon`` (word in UTF-8 to score), ``margin, rate, density, intercept, weight``.

    The lexicon, and the scores of segments that the law and the curve are fitted to, come from at most ``most`` labelled rows
    and so have a bound that the table's size does not move; the prior counts the words of every document. Without rows of
    both labels the lexicon is empty and every text scores the share of toxic rows (0.5 without any).
    """
    labelled = labelled_texts(docs, labels, most)
    found = word_scores(docs, word_contexts(labelled)).collect()
    lexicon = {r.word.encode(): r.score for r in found}

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, scores = [], []
            for text in batch.column(1):
                n, hits = scanned(text.as_buffer().to_pybytes(), held.value)
                sizes.append(n)
                scores.append([s for _, _, s in segments(hits, margin)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64()))],
                                             names=["label", "n", "scores"])

    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = labelled.select("label", F.col("text").cast("binary")).mapInArrow(scan, "label int, n long, scores array<double>").collect()
    label = np.array([float(r.label) for r in rows])
    share = min(max(label.mean(), 0.01), 0.99) if len(label) else 0.5
    model = {"lexicon": lexicon, "margin": margin, "rate": 1.0, "density": 1.0, "intercept": math.log(share / (1 - share)), "weight": 0.0}
    if not any(r.score > margin for r in found):
        return model
    # Segments of texts that are not toxic beyond the least one: their number is Poisson, their excess exponential.
    model["rate"] = decay_rate(np.array([r.score for r in found]), np.array([r.p_other for r in found]), margin)
    least = min(r.score for r in found if r.score > margin) - margin
    others = [s for r in rows if r.label == 0 for s in r.scores]
    n_other = sum(r.n for r in rows if r.label == 0)
    model["rate"] = (len(others) + 1) / (sum(others) - least * len(others) + 1 / model["rate"])
    model["density"] = (len(others) + 1) * math.exp(model["rate"] * least) / max(n_other, 1)
    levels = np.array([scale(evidence(r.scores, r.n, model["rate"], model["density"])) for r in rows])
    model["intercept"], model["weight"] = _logistic(levels, label)
    return model


# -- scoring --------------------------------------------------------------------------------------------


def _level(text: bytes | None, m: dict) -> tuple[int, list[tuple[int, int, float]], float]:
    n, hits = scanned(text, m["lexicon"])
    found = segments(hits, m["margin"])
    return n, found, evidence([s for _, _, s in found], n, m["rate"], m["density"])


def _probability(level: float, m: dict) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, m["intercept"] + m["weight"] * scale(level)))))


def with_scores(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score, n_passages`` per row: the chance that the text is toxic, and how many passages are significant."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            scores, counts = [], []
            for text in batch.column(1):
                n, found, level = _level(text.as_buffer().to_pybytes() if text.is_valid else None, m)
                scores.append(_probability(level, m))
                counts.append(sum(expected(s, n, m["rate"], m["density"]) <= SIGNIFICANT for _, _, s in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())],
                                             names=["doc_id", "score", "n_passages"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, score double, n_passages long")


def scored(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages`` for every row of ``doc_id, text``.

    Whole texts are scored by their words alone. Null and empty texts have no passage and score like any text without one;
    repeated rows are scored each; a null id is scored, never learned from. An empty table gives an empty result; other
    columns are not read. Nothing is shuffled but the labelled rows and the counts of words.
    """
    rows = with_scores(docs, train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "n_passages")


def accepted(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score stays below the cutoff. No row is shuffled."""
    text = fresh("raw_text", docs)
    model = train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            keep = [_probability(_level(t.as_buffer().to_pybytes() if t.is_valid else None, m)[2], m) < cutoff for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_())).select(range(batch.num_columns - 1))

    return docs.withColumn(text, F.col("text").cast("binary")).mapInArrow(run, docs.schema)


def passages(docs: DataFrame, model: dict, significant: float = SIGNIFICANT) -> DataFrame:
    """``doc_id, start, end, first_word, end_word, score, expected, passage``: every significant passage, a row each.

    A passage is significant if a text of that length has at most ``significant`` such by chance. ``start`` and ``end`` are code
    points, end exclusive; ``passage`` is the text between them. Null and empty texts have none.
    """
    import re

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    word = re.compile(WORD)
    names = ["doc_id", "start", "end", "first_word", "end_word", "score", "expected", "passage"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                n, found, _ = _level(text.as_buffer().to_pybytes() if text.is_valid else None, m)
                chance = [(a, b, s, expected(s, n, m["rate"], m["density"])) for a, b, s in found]
                chance = [c for c in chance if c[3] <= significant]
                if not chance:
                    continue
                whole = text.as_buffer().to_pybytes().decode()
                at = [x.span() for x in word.finditer(whole)]
                rows += [(i, at[a][0], at[b - 1][1], a, b, s, e, whole[at[a][0]:at[b - 1][1]]) for a, b, s, e in chance]
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], names=names)

    schema = f"doc_id {kind}, start long, end long, first_word long, end_word long, score double, expected double, passage string"
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)
