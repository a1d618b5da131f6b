"""From documents to token files: five stages, each over all that the one before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackspan.llm import decontaminate, order_minhash, pareto, rules, token_files
from trackspan.llm.queries import WORD_TOKENIZER, table, tokenizer_path
from trackspan.staging import Scope, stage, staging_into

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_HELD: list[Scope] = []


def lasting_one_stage(fn: Stage) -> Stage:
    """What a stage keeps in the shared folder is released when the next stage begins, as its input has been written by then.

    If that input was not written, but is still to be read from those tables, they stay until it was.
    """
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        for held in list(_HELD):
            if not any(path.rsplit("/", 1)[-1] in file for path in held.paths() for file in read):
                held.release()
                _HELD.remove(held)
        _HELD.append(Scope())
        with staging_into(_HELD[-1]):
            return fn(spark, docs, sf_dir)

    return run


@lasting_one_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return rules.accepted(docs, table(spark, sf_dir, "labels"))


@lasting_one_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return order_minhash.one_of_each(docs)


@lasting_one_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@lasting_one_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return pareto.mixed_documents(docs)


@lasting_one_stage
def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, as read back."""
    folder = token_files.new_folder(spark, "corpus")
    token_files.write_tokens(docs, folder, tokenizer_path(WORD_TOKENIZER))
    return token_files.read_tokens(spark, folder)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

# The classifier is fitted, the copies found and the tokens encoded by means that SQL lacks; tests compare the stages
# with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``; what each stage keeps is a table in the shared folder, until the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), Scope()
    for i, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            written = Scope()
            with staging_into(written):
                docs = stage(docs, name)
            before.release()
            before = written
    return docs
