"""The operators as runnable queries over a folder of Parquet tables, read whole, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, licenses, order_minhash, pareto, rotation_codes, rules, sanitise, snapshots, source_divergence, spelling,
               token_counts, token_files, toxic_segments)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WORD_TOKENIZER, PIECE_TOKENIZER = "word_bpe_49k.json", "piece_bpe_32k.model"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_order_minhash(spark, folder):
    return order_minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op2_license_scan(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query
def op3_decontaminate(spark, folder):
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_rotation_codes(spark, folder):
    return rotation_codes.near_vectors(table(spark, folder, "embeddings"))


@query
def op5_rule_quality(spark, folder):
    return rules.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_sanitise(spark, folder):
    return sanitise.sanitise(table(spark, folder, "documents"), with_text=False).drop("sanitised")


@query
def op7_pareto_mix(spark, folder):
    return pareto.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_collapse_chats(spark, folder):
    return snapshots.collapse_and_render(table(spark, folder, "conversations"))


@query
def op9_token_files(spark, folder):
    out = token_files.new_folder(spark)
    token_files.write_tokens(table(spark, folder, "documents"), out, tokenizer_path(WORD_TOKENIZER))
    return token_files.read_tokens(spark, out)


@query
def op10_token_counts(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_path(PIECE_TOKENIZER))


@query
def op11_toxic_segments(spark, folder):
    return toxic_segments.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op12_source_divergence(spark, folder):
    return source_divergence.divergence(table(spark, folder, "documents"))


@query
def op13_spelling_variants(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))


OP3_SQL = r"""
WITH items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1:i + least(10, len(w))], ' ') AS win
         FROM items, range(0, greatest(1, len(w) - 9)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, text, row_number() OVER () AS row, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
spans AS (SELECT row, i, l.n, array_to_string(w[i + 1:i + l.n], ' ') AS win FROM (SELECT DISTINCT n FROM wins) l, docs, range(0, len(w) - l.n + 1) AS t(i)),
hits AS (SELECT row, i, spans.n, item_id FROM spans JOIN wins ON spans.win = wins.win AND spans.n = wins.n),
hit_words AS (SELECT row, count(DISTINCT i + j) AS n_hit FROM hits, range(0, n) AS t(j) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (row) LEFT JOIN named USING (row)"""

OP7_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight FROM sources),
ratios AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS goal FROM weighed),
levels AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) /
             sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios),
targets AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio)), cap) AS target FROM levels),
expected AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0.0 END AS e FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
drawn AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS part, (CAST('0x' || substr(md5('pareto|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS draw FROM expected),
odds AS (SELECT *, CASE WHEN part > 0 THEN draw / (1 - draw) * ((1 - part) / part) END AS o FROM drawn),
ranked AS (SELECT *, CASE WHEN part > 0 THEN CAST(floor(o / (1 + o) * 4503599627370496.0::DOUBLE) AS BIGINT) END AS rank, target - sum(whole * size) OVER (PARTITION BY source) AS room FROM odds),
filled AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                  sum(size) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS held FROM ranked WHERE rank IS NOT NULL),
taken AS (SELECT doc_id, size, source_size, target, (whole + CASE WHEN upto <= room OR (upto - held <= room AND upto - room < room - (upto - held)) THEN 1 ELSE 0 END) * size AS taken FROM filled
          UNION ALL SELECT doc_id, size, source_size, target, whole * size FROM ranked WHERE rank IS NULL)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM taken"""

ORACLE: dict[str, str] = {
    "op2_license_scan": licenses.oracle(),
    "op3_decontaminate": OP3_SQL,
    "op7_pareto_mix": OP7_SQL,
    "op8_collapse_chats": snapshots.ORACLE,
    "op12_source_divergence": source_divergence.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
