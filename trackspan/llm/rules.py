"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees on the statistics of labelled documents give conjunctive rules, one per path from the root; a lasso logistic
regression weighs them, and those of non-zero weight are compiled into one Spark column expression.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .common import fresh

CUTOFF = 0.3
MOST_LABELLED = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 11
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for ids whose CRC-32 leaves no remainder by five; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.when(whole > 0, whole), F.lit(0.0))


def statistics(text: Column, parts: Column) -> dict[str, Column]:
    """Numbers that describe a text (not null) from it and from its ``parts``. All are built-in expressions.

    Characters other than letters are counted in what is left of the text without letters and most blanks, which is short.
    """
    words, lines, others, signs = (parts.getField(f) for f in ("words", "lines", "others", "signs"))
    n, n_words, n_lines = F.length(text), F.size(words), F.size(lines)
    count = lambda chars: F.length(signs) - F.length(F.translate(signs, chars, ""))
    letters = n - F.length(others)
    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": _share(letters + F.length(F.translate(signs, "\t", "")), n_words),
        "distinct_words": _share(F.size(F.array_distinct(words)), n_words),
        "repeated_words": _share(F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))), n_words),
        "long_words": _share(F.size(F.filter(words, lambda w: F.length(w) > 20)), n_words),
        "lines_per_word": _share(n_lines, n_words),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), n_lines),
        "letters": _share(letters, n),
        "capitals": _share(n - F.length(F.regexp_replace(text, r"\p{Lu}+", "")), n),
        "digits": _share(count("0123456789"), n),
        "marks": _share(count("%#&*$@^~+=<>"), n),
        "bars": _share(count("|\t"), n),
        "brackets": _share(count("{}[]()\\/_;"), n),
        "exclamations": _share(count("!?"), n),
        "stops": _share(count(".,:"), n_words),
    }


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` as column ``name``, made once per row: explode() keeps its readers from making it again."""
    return rows.withColumn(name, F.explode(F.array(value)))


def with_statistics(docs: DataFrame, keep: list[str], only: set[str] | None = None) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Columns ``keep`` and a column per statistic (or per one of ``only``), their names, and name by statistic.

    A null text counts as empty. Parts of the text, what is made from them and the statistics are each made once.
    """
    body, others, parts, found = (fresh(c, docs) for c in ("stat_text", "stat_others", "stat_parts", "stat_found"))
    rows = docs.select(*[docs[c] for c in keep], F.coalesce("text", F.lit("")).alias(body))
    rows = _once(rows, others, F.regexp_replace(body, r"\p{L}+", ""))
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = _once(rows, parts, F.struct(words.alias("words"), F.split(body, "\n").alias("lines"), F.col(others).alias("others"),
                                       F.regexp_replace(others, r"[\x20\x0A-\x0D]+", "").alias("signs")))
    own = {f"stat_{n}": c for n, c in statistics(F.col(body), F.col(parts)).items()}
    names = {n: fresh(n, docs) for n in own if only is None or n in only}
    if names:
        rows = _once(rows, found, F.struct(*[own[n].cast("double").alias(n) for n in names]))
    return rows.select(*keep, *[F.col(found).getField(n).alias(names[n]) for n in names]), list(names.values()), names


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[DataFrame, list[str]]:
    """Statistics and ``label`` of at most ``most`` labelled documents, in a fixed order, as one small table.

    The labels with the least hash of doc_id are taken; being that few, they are broadcast, and statistics are made for
    their documents only. Rows held out, labels other than 0 and 1 and labels that contradict each other are not used; a
    repeated id counts once.
    """
    own = (labels.where("quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id")
           .agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other AND doc_id IS NOT NULL"))
    own = stage(own.select("doc_id", F.col("label").cast("double"), F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(most), "labels")
    rows, features, _ = with_statistics(docs.select("doc_id", "text").join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi"), ["doc_id"])
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*features)).alias("s")).join(F.broadcast(own), "doc_id").select("doc_id", "label", "place", "s.*")
    return stage(rows.coalesce(1).sortWithinPartitions("place", "doc_id"), "labelled"), features


Condition = tuple[str, str, float]  # statistic, "<=" or ">", bound


def tree_rules(node, features: list[str], path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """The conditions on the way to every node below the root of a fitted tree."""
    out = [path] if path else []
    if node.subtreeDepth() > 0:
        split = node.split()
        name, bound = features[split.featureIndex()], float(split.threshold())
        out += tree_rules(node.leftChild(), features, (*path, (name, "<=", bound)))
        out += tree_rules(node.rightChild(), features, (*path, (name, ">", bound)))
    return out


def simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The tightest bound per statistic and direction, in a fixed order."""
    tightest: dict[tuple[str, str], float] = {}
    for name, way, bound in rule:
        key = name, way
        tightest[key] = bound if key not in tightest else (min if way == "<=" else max)(bound, tightest[key])
    return tuple(sorted((name, way, bound) for (name, way), bound in tightest.items()))


def compiled(rule: tuple[Condition, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n) <= b if way == "<=" else F.col(n) > b for n, way, b in rule]).cast("double")


class RuleModel:
    """Weighted rules; ``score()`` is their Spark expression over the statistics."""

    def __init__(self, intercept: float, weights: list[tuple[tuple[Condition, ...], float]]):
        self.intercept, self.weights = intercept, weights

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, [compiled(r) * w for r, w in self.weights], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))

    def renamed(self, names: dict[str, str]) -> RuleModel:
        """The same over columns of other names."""
        return RuleModel(self.intercept, [(tuple((names[n], way, b) for n, way, b in rule), w) for rule, w in self.weights])


def fit(sample: DataFrame, features: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> RuleModel:
    """Rules and weights from a sample with ``label`` 0.0 or 1.0.

    Classes weigh the same while trees are grown, so that rare bad texts shape rules; the weights of the rules are fitted
    to the labels as they are, so that scores are probabilities. A sample without both labels gives its one label (or 0.5)
    as the score of every text.
    """
    counts = dict(sample.groupBy("label").count().collect())
    if len(counts) < 2:
        return RuleModel({0.0: -5.0, 1.0: 5.0}[next(iter(counts))] if counts else 0.0, [])
    total = sum(counts.values())
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(sample.sortWithinPartitions("place", "doc_id"))
    balance = F.when(F.col("label") == 1, total / (2.0 * counts[1.0])).otherwise(total / (2.0 * counts[0.0]))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="balance", featureSubsetStrategy="onethird",
                                    minInstancesPerNode=5, maxBins=64).fit(rows.withColumn("balance", balance))
    found = {simplified(r) for tree in forest._java_obj.trees() for r in tree_rules(tree.rootNode(), features)}
    rules = sorted(found)
    if not rules:
        share = min(max(counts[1.0] / total, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)), [])
    marked = sample.sortWithinPartitions("place", "doc_id").select("label", *[compiled(r).alias(f"r{i}") for i, r in enumerate(rules)])
    marked = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(marked).select("label", "features")
    lr = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=80, standardization=False).fit(marked)
    weights = [(r, float(w)) for r, w in zip(rules, lr.coefficients.toArray()) if abs(w) > 1e-9]
    return RuleModel(float(lr.intercept), weights)


def train(docs: DataFrame, labels: DataFrame, **options) -> RuleModel:
    return fit(*labelled_sample(docs, labels), **options)


def _score(docs: DataFrame, keep: list[str], model: RuleModel) -> tuple[DataFrame, Column]:
    """``keep`` and the statistics that the model uses, and its score over them."""
    rows, _, names = with_statistics(docs, keep, {n for rule, _ in model.weights for n, _, _ in rule})
    return rows, model.renamed(names).score()


def scored(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``doc_id, text``.

    Scores come from statistics of the whole text alone. Null and empty texts are scored like any other, by statistics of
    zero; repeated rows are scored each; a null id is scored, never learned from. An empty table gives an empty result; no
    usable labels give every text 0.5. Other columns are not read. Nothing is shuffled but the labelled sample.
    """
    rows, score = _score(docs.select("doc_id", "text"), ["doc_id"], train(docs, labels, **options))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= cutoff).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches the cutoff. Nothing but the sample is shuffled."""
    rows, score = _score(docs, docs.columns, train(docs, labels, **options))
    return rows.where(score >= cutoff).select(*docs.columns)
