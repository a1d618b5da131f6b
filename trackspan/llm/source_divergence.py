"""How far the sources of each language diverge in their use of words, in exact integer arithmetic.

One ``CountVectorizer`` counts the terms of all languages: every term carries its language, so its document frequency is the
one within the language, and the vocabulary is that of one vectorizer per language, fitted in one pass however many languages
there are. Its sparse document vectors are summed per source. Two sources are then compared by what is not zero in them: terms
that neither has are one product, terms that one has go by a histogram of its shares, and only terms that both have are looked
at one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import delete_at_exit, shared_dir, stage
from .common import ship

ship(__name__)

# ASCII letters and every byte of a non-ASCII character make terms; letters A-Z become a-z.
TERM_BYTES = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
LEAST_DOCS, TOP_TERMS = 10, 10
ALL_TERMS = (1 << 31) - 1
MARK = b"\x00"  # stands in no term, so it parts a term from its language
BATCH_TERMS = 1 << 17
MOST_CELLS = 1 << 23  # of the sums that a task holds before it hands them on: 64 MB
BLOCK = 1 << 12  # cells that are handed on as one row
PER = 1_000_000_000


def keyed_terms(rows: DataFrame, distinct: bool) -> DataFrame:
    """``source, terms`` of ``source, lang, text`` without nulls: the (distinct) terms of a text, each followed by the mark and its language."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, ends, flat = 0, [0], []
            for row, (text, lang) in enumerate(zip(batch.column(2), batch.column(1).to_pylist()), 1):
                terms = text.as_buffer().to_pybytes().translate(TERM_BYTES).split()
                tail = MARK + lang.encode()
                terms = set(terms) if distinct else terms
                # Joined and parted again, all terms get their tail at once.
                flat += [t + tail for t in terms] if b"\x01" in tail else (tail + b"\x01").join([*terms, b""]).split(b"\x01")[:-1]
                ends.append(len(flat))
                if len(flat) >= BATCH_TERMS or row == batch.num_rows:
                    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, row - first), listed], names=["source", "terms"])
                    first, ends, flat = row, [0], []

    return rows.select("source", "lang", F.col("text").cast("binary")).mapInArrow(run, "source string, terms array<string>")


def group_sums(vectors: DataFrame, size: int) -> DataFrame:
    """``term_id, source, n``: the sums of sparse vectors per source, exact.

    A task adds the vectors of a source to one array, as a summarizer does, and hands on what is not zero at its end, or
    before that when the arrays of many sources reach the limit. Blocks of neighbouring cells travel as one row and are added
    up where all blocks of a source and place meet.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for source, own in sums.items():
                at = np.flatnonzero(own)
                cuts = np.flatnonzero(np.diff(at // BLOCK, prepend=-1))
                ends = pa.array(np.append(cuts, len(at)), pa.int32())
                if len(at):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([source] * len(cuts), pa.string()), pa.array((at[cuts] // BLOCK).astype(np.int32)),
                        pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(own[at]))],
                        names=["source", "block", "at", "n"])
            sums.clear()

        for batch in batches:
            places, counts = batch.column(1), batch.column(2)
            ends, ids, values = places.offsets.to_numpy(), places.values.to_numpy(), counts.values.to_numpy().astype(np.int64)
            for i, source in enumerate(batch.column(0).to_pylist()):
                if source not in sums:
                    if (len(sums) + 1) * size > MOST_CELLS:
                        yield from handed_on()
                    sums[source] = np.zeros(size, np.int64)
                sums[source][ids[ends[i]:ends[i + 1]]] += values[ends[i]:ends[i + 1]]
        yield from handed_on()

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(BLOCK, np.int64)

        def whole() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            out = [pa.array((at + held[1] * BLOCK).astype(np.int32)), pa.array([held[0]] * len(at), pa.string()), pa.array(total[at])]
            total[:] = 0
            return pa.RecordBatch.from_arrays(out, names=["term_id", "source", "n"])

        for batch in batches:
            places, counts = batch.column(2), batch.column(3)
            ends, at, values = places.offsets.to_numpy(), places.values.to_numpy(), counts.values.to_numpy()
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key != held:
                    if held:
                        yield whole()
                    held = key
                total[at[ends[i]:ends[i + 1]] - key[1] * BLOCK] += values[ends[i]:ends[i + 1]]
        if held:
            yield whole()

    cells = vectors.select("source", F.unwrap_udt("vector").alias("v")).select("source", "v.indices", "v.values")
    blocks = cells.mapInArrow(run, "source string, block int, at array<int>, n array<long>")
    return (blocks.repartition("source", "block").sortWithinPartitions("source", "block")
            .mapInArrow(added, "term_id int, source string, n long"))


def _vocabulary(spark, model) -> DataFrame:
    """``term_id, key`` of a fitted vectorizer, read from the table that Spark saves it as."""
    folder = shared_dir(spark)
    if folder is None:
        return spark.createDataFrame(list(enumerate(model.vocabulary)), "term_id int, key string")
    path = f"{folder.rstrip('/')}/trackspan-vocabulary-{uuid.uuid4().hex}"
    model.write().save(path)
    delete_at_exit(spark, path)
    return spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("term_id", "key"))


def term_counts(rows: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The kept terms as ``term_id, lang, term``, and ``term_id, source, n`` for each source that has one, both staged.

    ``rows`` has ``source, lang, text`` without nulls. A vectorizer's vocabulary passes through the driver and is broadcast; it
    holds the terms of at least ``least_docs`` documents only. It is fitted on the distinct terms of each document, which have
    the same document frequencies.
    """
    spark = rows.sparkSession
    vectorizer = CountVectorizer(inputCol="terms", outputCol="vector", vocabSize=ALL_TERMS, minDF=float(least_docs))
    try:
        model = vectorizer.fit(keyed_terms(rows, distinct=True).select("terms"))
    except IllegalArgumentException as e:
        if "vocabulary size should be > 0" not in str(e):
            raise
        return (spark.createDataFrame([], "term_id int, lang string, term string"),
                spark.createDataFrame([], "term_id int, source string, n long"))
    mark = F.instr("key", MARK.decode())
    vocabulary = stage(_vocabulary(spark, model).select(
        "term_id", F.substring("key", mark + 1, F.length("key")).alias("lang"), F.substring("key", F.lit(1), mark - 1).alias("term")), "vocabulary")
    vectors = model.transform(keyed_terms(rows, distinct=False)).select("source", "vector")
    return vocabulary, stage(group_sums(vectors, vocabulary.count()), "term-counts")


def share(n: str, total: str) -> Column:
    """1 + floor(10^9 (n + 2) / total), exact for counts of any size; null if the total is not positive."""
    return F.expr(f"1 + CAST({n} + 2 AS DECIMAL(20, 0)) * CAST({PER} AS DECIMAL(10, 0)) DIV CAST(IF({total} > 0, {total}, NULL) AS DECIMAL(20, 0))")


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) of two shares; shares are at most 10^9 + 1."""
    return f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))


def _pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, other, value`` for every two groups of a language.

    With z the share of a term that a group lacks, the sum over all V terms is V gap(z, z'), plus gap(p, z') - gap(z, z') for
    each term of one group, plus gap(p, p') - gap(p, z') - gap(z, p') + gap(z, z') for each term of both.
    """
    one = groups.select("lang", "source", F.col("zero").alias("za"), "n_terms")
    two = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("zb"))
    none = one.join(two, "lang").where("source != other").select(
        "lang", "source", "other", F.coalesce(F.expr(f"n_terms * ({gap('za', 'zb')})"), F.lit(0)).alias("value"))
    spectrum = counts.groupBy("lang", "source", F.col("zero").alias("za"), "p").agg(F.count("*").alias("m"))
    single = spectrum.join(two, "lang").where("source != other").select(
        "lang", "source", "other", F.expr(f"m * ({gap('p', 'zb')} - {gap('za', 'zb')})").alias("value"))
    mine = counts.select("lang", "term_id", "source", F.col("p").alias("pa"), F.col("zero").alias("za"))
    theirs = counts.select("lang", "term_id", F.col("source").alias("other"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    shared = mine.join(theirs, ["term_id", "lang"]).where("source < other").select("lang", "source", "other", F.expr(
        f"{gap('pa', 'pb')} - {gap('pa', 'zb')} - {gap('za', 'pb')} + {gap('za', 'zb')}").alias("value"))
    add = F.sum("value").alias("value")
    keys = ["lang", "source", "other"]
    return (none.union(_both_ways(single.groupBy(*keys).agg(add))).union(_both_ways(shared.groupBy(*keys).agg(add)))
            .groupBy(*keys).agg(add))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others and by which words.

    Part ``pair`` has every other source of the language, part ``term`` the ``top_terms`` kept terms that the source uses more
    than its language does. Shares are counts plus two, in parts of 10^9; ranks go by value, then item in UTF-8 order.

    Null texts, languages and sources are read as empty ones. A text without terms still makes its group, and a group without
    kept terms is compared as one whose counts are all zero. Every row counts as a document, repeated ids and texts included.
    A language without kept terms has pairs of value 0; one source alone has no pairs; an empty table gives no rows. Other
    columns are not read, and long texts are counted whole.
    """
    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    rows = docs.select(lang, source, text)
    vocabulary, counted = term_counts(rows, least_docs)
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("n_terms"))
    counts = stage(counted.join(vocabulary.select("term_id", "lang"), "term_id"), "kept-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = (rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
                      F.expr("coalesce(n, 0) + 2 * coalesce(n_terms, 0)").alias("total"))
              .withColumn("zero", share("0L", "total")))
    groups = stage(groups, "groups")
    shares = stage(counts.join(groups, ["lang", "source"]).withColumn("p", share("n", "total"))
                   .select("lang", "source", "term_id", "p", "zero"), "shares")

    overall = counts.groupBy("lang", "term_id").agg(F.sum("n").alias("n"))
    lang_total = (overall.groupBy("lang").agg(F.sum("n").alias("n_all")).join(sizes, "lang")
                  .select("lang", F.expr("n_all + 2 * n_terms").alias("total")))
    overall = overall.join(lang_total, "lang").select("lang", "term_id", share("n", "total").alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    # Terms themselves are fetched for those only that no ten others exceed; they decide between equal values.
    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    most = (shares.join(overall, ["lang", "term_id"]).where("p > q").select("lang", "source", "term_id", F.expr(gap("p", "q")).alias("value"))
            .withColumn("place", F.rank().over(first)).where(F.col("place") <= top_terms))
    terms = (most.join(vocabulary.select("term_id", "term"), "term_id")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
    pairs = (_pair_values(shares, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
             .withColumn("rank", F.row_number().over(order)))
    return pairs.union(terms)


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occ AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT lang, source, term, coalesce(c, 0) AS c FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
g AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER w + 2 * count(*) OVER w) AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(c) AS c FROM dense GROUP BY lang, term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER w + 2 * count(*) OVER w) AS q FROM whole WINDOW w AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM g JOIN l USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
           UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) FROM terms)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""
