"""Token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, worker_cache
from .token_files import long_pieces

ship(__name__)

LIMIT = 4096
CACHE_UNITS = 300_000
BATCH_BYTES = 1 << 20
COUNTS = "n_bytes long, n_tokens long"
UNIT = re.compile(" *[^ ]+")
BOUNDARY = re.compile("[^ ▁] (?=.)", re.DOTALL)


class PieceCounter:
    """Counts tokens of a sentencepiece model.

    The model sees a text as a space, then the text, with spaces as the sign U+2581. If no piece of its vocabulary has that
    sign after another character, no merge crosses a place where a space follows another character: those are the safe
    boundaries, and counts of the units between them add up. Each unit is counted once and cached; batches of unknown
    units are filled up to a number of bytes. For a model without safe boundaries, whole texts are encoded.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        sign = "▁"
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = self.model.encode(" a  b ", out_type=str) == self.model.encode("▁a▁▁b▁", out_type=str)
        spaces_kept = "".join(self.model.encode("  a   b ", out_type=str)) == sign * 3 + "a" + sign * 3 + "b" + sign
        self.safe = plain and spaces_kept and not any(sign in p.lstrip(sign) for p in pieces)
        self.cache: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.lengths(texts)
        split, tails = [], []
        for t in texts:
            # The model puts one space before a text; a unit leaves its first space out, as the model puts it back.
            s = " " + t.replace("▁", " ") if t else ""
            units = UNIT.findall(s)
            rest = len(s) - sum(map(len, units))
            split.append([u[1:] for u in units])
            tails.append(rest)
        cache = self.cache
        missing = {u for units in split for u in units if u not in cache}
        if len(cache) + len(missing) > CACHE_UNITS:
            cache.clear()
            missing = {u for units in split for u in units}
        batch, held = [], 0
        for u in missing:
            batch.append(u)
            held += len(u)
            if held >= BATCH_BYTES:
                cache.update(zip(batch, self.lengths(batch)))
                batch, held = [], 0
        cache.update(zip(batch, self.lengths(batch)))
        return [sum([cache[u] for u in units]) + (self.spaces(tail) if tail else 0) for units, tail in zip(split, tails)]

    def spaces(self, n: int) -> int:
        """Tokens of ``n`` spaces at the end of a text, with nothing else after the last safe boundary."""
        if n == 1:
            # One space alone cannot be given to the model, which puts one more before it. A unit before it cannot merge with it.
            return len(self.model.encode("a ")) - len(self.model.encode("a"))
        return self.lengths([" " * (n - 1)])[0]


class TextCounter:
    """Counts tokens of a ``tokenizers`` file, a batch of texts at a time."""

    safe = False

    def __init__(self, path: str):
        import os

        from .token_files import encoder

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = encoder(path)
        self.safe = not self.encoder.whole
        self.width = self.encoder.dtype.itemsize

    def counts(self, texts: list[str]) -> list[int]:
        return [len(b) // self.width for b in self.encoder.packed(texts)]


def counter(path: str):
    cache = worker_cache()
    if ("counter", path) not in cache:
        cache["counter", path] = PieceCounter(path) if path.endswith(".model") else TextCounter(path)
    return cache["counter", path]


def safe_parts(text: str, size: int) -> Iterator[str]:
    """A long text in parts that end before a space which follows another character; that space is left out, as the model
    puts one before each part."""
    start = 0
    while len(text) - start > size:
        cut = BOUNDARY.search(text, start + size)
        if not cut:
            break
        yield text[start:cut.start() + 1]
        start = cut.start() + 2
    yield text[start:]


def _count(path: str):
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            sizes, totals, owners, texts, held = [], [], [], [], 0

            def settle():
                nonlocal owners, texts, held
                for owner, n in zip(owners, c.counts(texts)):
                    totals[owner] += n
                owners, texts, held = [], [], 0

            for row, value in enumerate(batch.column(batch.num_columns - 1)):
                raw = (value.as_buffer() if value.is_valid else None)
                text = raw.to_pybytes().decode() if raw is not None else ""
                sizes.append(raw.size if raw is not None else 0)
                totals.append(0)
                for part in (_parts(c, text) if len(text) > BATCH_BYTES and c.safe else [text]):
                    owners.append(row)
                    texts.append(part)
                    held += len(part)
                    if held >= BATCH_BYTES:
                        settle()
            settle()
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())],
                                             names=[*names, "n_bytes", "n_tokens"])

    return run


def _parts(c, text: str) -> Iterator[str]:
    return safe_parts(text, BATCH_BYTES) if isinstance(c, PieceCounter) else long_pieces(text, BATCH_BYTES)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``doc_id, text``.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each. Texts are never cut short: one of
    more than a million characters is counted in parts that add up exactly. An empty table gives an empty result, other
    columns are not read. Nothing is shuffled; a task holds one Arrow batch and encodes a megabyte at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_count(tokenizer), f"doc_id {kind}, {COUNTS}").withColumn("over_limit", over(limit))


def over(limit: int) -> Column:
    return F.col("n_tokens") > limit
