"""Chat formatting: logged snapshots of growing conversations are collapsed, then the maximal ones rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage

BLOCK_TURNS = 256
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"
WIDE = "decimal(38,0)"


def _running(rows: DataFrame, values: list[str]) -> DataFrame:
    """Running sums of ``values`` along each conversation, over rows staged in range partitions.

    Sums run within (partition, conversation); a conversation that spans partitions gets the sums of its earlier
    partitions added, one row each. So no task holds a conversation that is longer than a partition.
    """
    part = F.shiftright("row", 33)
    along = Window.partitionBy("part", "conv_id").orderBy("row")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", part)
    sums = rows.groupBy("conv_id", "part").agg(*[F.sum(F.col(v).cast(WIDE)).cast(WIDE).alias(v) for v in values])
    bases = sums.select("conv_id", "part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).cast(WIDE).alias(f"base_{v}") for v in values])
    bases = stage(bases.where(" OR ".join(f"base_{v} <> 0" for v in values)), "bases")
    local = rows.withColumns({v: F.sum(F.col(v).cast(WIDE)).over(along).cast(WIDE) for v in values})
    out = local.join(bases, ["conv_id", "part"], "left")
    return out.select(*[c for c in rows.columns if c not in values],
                      *[(F.col(v) + F.coalesce(f"base_{v}", F.lit(0))).cast(WIDE).alias(v) for v in values])


def _ordered(turns: DataFrame) -> DataFrame:
    """The turns with ``row``, a number that ascends by conversation and turn over range partitions.

    Turns of one number follow by role and whole text; rows that are wholly equal may part anywhere, so neither a long conversation nor a repeated row fills a partition.
    """
    keys = ["conv_id", "turn", "role", "text", "place"]
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stage(rows.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("row")), "turns")


def _tag(salt: int) -> Column:
    known = [F.col("position"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(F.lit(salt), *known)


def prefix_hashes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, conv_id, position, h1, h2`` and the turns they belong to (``row, conv_id, role, text``).

    Positions count from 1. The hash of a prefix is the sum of hashes of (position, role, text) of its turns, twice 64
    bits, so it rolls by one addition and can be put together from parts of a conversation.
    """
    rows = _ordered(turns)
    placed = _running(rows.withColumn("position", F.lit(1)), ["position"]).withColumn("position", F.col("position").cast("long"))
    tagged = placed.select("row", "conv_id", "position", _tag(1).alias("h1"), _tag(2).alias("h2"))
    tagged = stage(tagged, "tagged")
    return stage(_running(tagged, ["h1", "h2"]).select("row", "conv_id", "position", "h1", "h2"), "prefixes"), rows


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies``: conversations that no other one continues; of equal ones the least id, with their number."""
    ident = ["position", "h1", "h2"]
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct(*ident)).alias("end")).select("conv_id", "end.*")
    ends = stage(last.groupBy(*ident).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")), "ends")
    # A prefix that more conversations have than end there is continued by one of them.
    shared = prefixes.groupBy(*ident).agg(F.count("*").alias("having"))
    continued = shared.join(ends.select(*ident, "copies"), ident).where("having > copies").select(*ident)
    return ends.join(continued, ident, "left_anti").select("conv_id", F.col("position").alias("n_turns"), "copies")


def rendered_turn() -> Column:
    """One turn between marks; the marks' opening inside a text is broken up, so that no text can forge a turn."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(TURN_OPEN), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(TURN_CLOSE + "\n"))


def collapse_and_render(turns: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, block, n_turns, copies, text``: every maximal conversation, rendered in blocks of up to ``block`` turns.

    A conversation that is a prefix of a longer one (same roles and texts, turn by turn) is dropped; of equal ones the
    least conv_id stays. Turns go by number, null first, then by role and text; repeated rows are turns of their own. Null
    roles and texts equal only nulls and are rendered empty. Rows without conv_id belong to no conversation and are left
    out. An empty table gives an empty result; other columns are not read.
    """
    prefixes, rows = prefix_hashes(turns)
    kept = stage(maximal(prefixes), "maximal")
    own = prefixes.join(kept, "conv_id").select("row", "conv_id", "position", "n_turns", "copies")
    pieces = own.join(rows.select("row", rendered_turn().alias("piece")), "row")
    number = F.floor((F.col("position") - 1) / block).cast("long")
    out = pieces.groupBy("conv_id", number.alias("block")).agg(
        F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"),
        F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("pieces"))
    return out.select("conv_id", "block", "n_turns", "copies", F.array_join("pieces.piece", "").alias("text"))


ORACLE = f"""
WITH numbered AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position
                  FROM conversations WHERE conv_id IS NOT NULL),
listed AS (SELECT conv_id, count(*) AS n_turns, list({{'r': role, 't': text}} ORDER BY position) AS turns FROM numbered GROUP BY conv_id),
grouped AS (SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM listed GROUP BY turns, n_turns),
prefixes AS (SELECT DISTINCT turns[1:n] AS turns FROM grouped, range(1, n_turns) AS t(n)),
kept AS (SELECT g.conv_id, g.n_turns, g.copies FROM grouped g ANTI JOIN prefixes p ON g.turns = p.turns)
SELECT k.conv_id, (position - 1) // {BLOCK_TURNS} AS block, n_turns, copies,
       string_agg('{TURN_OPEN}' || replace(coalesce(role, ''), '<|', '< |') || E'\\n' || replace(coalesce(text, ''), '<|', '< |') || '{TURN_CLOSE}' || E'\\n', '' ORDER BY position) AS text
FROM kept k JOIN numbered n ON k.conv_id = n.conv_id GROUP BY k.conv_id, block, n_turns, copies"""
