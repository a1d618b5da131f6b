"""Token ids in flat files of unsigned integers, with 64-bit document offsets, read back by memory mapping.

A folder holds, for each part ``p`` of the table in ascending doc_id order:

* ``part-p.tokens``: the ids of all its documents, little-endian uint16 (uint32 if an id needs it), nothing else;
* ``part-p.offsets``: little-endian int64, where each document begins within the part, and the part's length;
* ``part-p.docs``: little-endian int64 doc_ids, the least int64 for a null id;

and ``index.json`` with the item type and, per part, its documents, tokens and base: the tokens of all parts before it.
A document starts at base + offset.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..staging import CHECKPOINT_DIR, own_folder, shared_dir, stage
from .common import ship, worker_cache

ship(__name__)

END_ID = 1
CACHE_PIECES = 250_000
BATCH_CHARS = 1 << 20
SHARED_CHARS = 1 << 21  # texts whose pieces are numbered together
NULL_ID = -(1 << 63)
PART = "part long, n_docs long, n_tokens long"
SPAN = "doc_id long, start long, n_tokens long, ids_crc32 long"


def mounted(folder: str) -> str:
    """The local path of a folder that all executors mount; memory mapping needs one."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{folder}: token files are memory-mapped, so name a folder that every executor mounts")
    return url.path


def new_folder(spark: SparkSession, name: str = "tokens") -> str:
    """An empty folder under the shared one, deleted with the scope it is made in or when the application ends."""
    shared = shared_dir(spark)
    if shared is None:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors see")
    path = f"{mounted(shared).rstrip('/')}/trackspan-{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    own_folder(spark, f"file://{path}")
    return path


class WordEncoder:
    """Ids of texts by a tokenizer that never joins what a space or line feed separates, with a cache of pieces.

    Such a tokenizer replaces white space by spaces and drops them before it merges (``separable`` looks that up in its
    settings), so the ids of a text are those of its pieces. For any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        largest = max([END_ID, *self.tokenizer.get_vocab(with_added_tokens=True).values()])
        self.dtype = np.dtype("<u2") if largest < 1 << 16 else np.dtype("<u4")
        settings = json.loads(self.tokenizer.to_str())
        self.whole = not self.separable(settings)
        suffix = settings["model"].get("end_of_word_suffix")
        self.ends = np.zeros(largest + 1, bool) if suffix else np.zeros(0, bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def separable(settings: dict) -> bool:
        """True for: white space to spaces, then a split that keeps only matches of a pattern none of which spans a space."""
        def steps(part, name):
            return [] if not part else part[name] if part["type"] == "Sequence" else [part]

        cleaned = steps(settings["normalizer"], "normalizers")
        split = steps(settings["pre_tokenizer"], "pretokenizers")[:1]
        spaces = any(s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in cleaned)
        known = all(s["type"] in ("NFC", "Lowercase", "Replace") for s in cleaned)
        keeps = bool(split) and split[0]["type"] == "Split" and split[0]["behavior"] == "Removed" and split[0]["invert"] and \
            split[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        plain = not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in settings["added_tokens"])
        return spaces and known and keeps and plain

    @staticmethod
    def levelled(texts: pa.Array) -> pa.Array:
        """Texts with fewer different pieces and the same ids: in lower case, full stops and commas parted from the word they follow.

        The tokenizer lowers letters itself and parts marks from letters and digits. Texts are left alone where lowering is not a
        letter by letter matter or a special token might come of it.
        """
        level = pc.replace_substring_regex(pc.utf8_lower(texts), r"([\pL\pN])([.,]+)([ \n]|$)", r"\1 \2\3")
        return pc.if_else(pc.match_substring_regex(texts, "[^\\x00-\\x{24F}]|\u0130|<"), texts, level)

    def plain(self, piece: str) -> tuple[str, str]:
        """A piece without the full stops and commas after its last letter, in lower case, and those marks.

        The tokenizer parts letters from marks and lowers letters itself, so the ids are those of both in turn. Case is
        only changed where that is a letter by letter matter, and special tokens are left alone.
        """
        word = piece.rstrip(".,")
        if word.isascii() and word.isalpha():
            return word.lower(), piece[len(word):]
        simple = word.isascii() or max(word, default="") <= "ɏ" and "İ" not in word  # one lower-case letter for each
        if not simple or not word[-1:].isalpha():
            word = piece
        return (word.lower() if simple and "<" not in word else word), piece[len(word):]

    def encode(self, pieces: set[str]) -> Iterator[tuple[str, bytes]]:
        """Packed ids of pieces. Words of letters alone are given joined by spaces: each ends with a token that ends a word."""
        words = [p for p in pieces if p.isalpha() and max(p) <= "ɏ" and "İ" not in p] if len(self.ends) else []
        for first in range(0, len(words), 5000):
            own = words[first:first + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(own), add_special_tokens=False).ids, dtype=self.dtype)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(cuts) != len(own):
                raise ValueError("a word of letters does not end with one token that ends a word")
            raw = ids.tobytes()
            yield from ((w, raw[a:b]) for w, a, b in zip(own, [0, *cuts], cuts))
        others = list(pieces.difference(words))
        for p, e in zip(others, self.tokenizer.encode_batch(others, add_special_tokens=False)):
            yield p, np.array(e.ids, dtype=self.dtype).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Puts pieces into the cache; when it is full, what was not used since it last was goes."""
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.older, self.cache = self.cache, {}
        cache, older, needed, parts = self.cache, self.older, set(), []
        for p in pieces:
            if p in older:
                cache[p] = older[p]
                continue
            word, marks = self.plain(p)
            if word == p:
                needed.add(p)
                continue
            parts.append((p, word, marks))
            for x in (word, marks):
                if x in older:
                    cache[x] = older[x]
                elif x not in cache:
                    needed.add(x)
        cache.update(self.encode(needed))
        for p, word, marks in parts:
            cache[p] = cache[word] + cache[marks]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        if self.whole:
            return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        # Split, number and look up in Arrow: Python sees each different piece of the batch once.
        split = pc.split_pattern(pc.replace_substring(self.levelled(pa.array(texts, pa.string())), "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_pylist()
        missing = {p for p in pieces if p not in self.cache}
        if missing:
            self.learn(missing)
            again = {p for p in pieces if p not in self.cache}  # the generation has changed
            if again:
                self.learn(again)
        found = [self.cache[p] for p in pieces]
        ends = np.cumsum([0, *map(len, found)]) // self.dtype.itemsize
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), self.dtype)))
        taken = ids.take(numbered.indices)
        bounds = taken.offsets.to_numpy()[split.offsets.to_numpy()] * self.dtype.itemsize
        raw = taken.flatten().to_numpy().tobytes()
        bounds = bounds - bounds[0]
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def encoder(path: str) -> WordEncoder:
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = WordEncoder(path)
    return cache["encoder", path]


def long_pieces(text: str, size: int = BATCH_CHARS) -> Iterator[str]:
    """A long text in parts cut at spaces or line feeds."""
    start = 0
    while len(text) - start > size:
        cut = max(text.rfind(" ", start, start + size), text.rfind("\n", start, start + size))
        if cut <= start:
            after = [x for x in (text.find(" ", start + size), text.find("\n", start + size)) if x >= 0]
            cut = min(after, default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def _encoded(batch: pa.RecordBatch, path: str, end_id: int) -> Iterator[tuple[int | None, list[bytes]]]:
    """``doc_id`` and the packed ids of each row, end id included, a bounded number of characters at a time."""
    enc = encoder(path)
    end = np.array([end_id], dtype=enc.dtype).tobytes()
    rows: list[tuple[int | None, str]] = []
    held = 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        text = text.as_py() or ""
        if len(text) > BATCH_CHARS:
            for (i, _), ids in zip(rows, enc.packed([t for _, t in rows])):
                yield i, [ids, end]
            rows, held = [], 0
            parts = [text] if enc.whole else long_pieces(text)
            yield doc_id, [*(enc.packed([p])[0] for p in parts), end]
            continue
        rows.append((doc_id, text))
        held += len(text)
        if held >= SHARED_CHARS:
            for (i, _), ids in zip(rows, enc.packed([t for _, t in rows])):
                yield i, [ids, end]
            rows, held = [], 0
    for (i, _), ids in zip(rows, enc.packed([t for _, t in rows])):
        yield i, [ids, end]
    pa.default_memory_pool().release_unused()


def _writer(folder: str, path: str, end_id: int):
    kinds = ("tokens", "offsets", "docs")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, n_docs, at, width = task.partitionId(), 0, 0, None
        # Each attempt has files of its own, and they take their place whole: a task that runs again changes nothing.
        temporary = {k: f"{folder}/.part-{part:05d}.{k}.{task.taskAttemptId()}-{uuid.uuid4().hex}" for k in kinds}
        files: dict = {}
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                files = files or {k: open(f, "wb") for k, f in temporary.items()}
                width = encoder(path).dtype.itemsize
                offsets, docs = [], []
                for doc_id, chunks in _encoded(batch, path, end_id):
                    offsets.append(at)
                    docs.append(NULL_ID if doc_id is None else doc_id)
                    for c in chunks:
                        files["tokens"].write(c)
                        at += len(c) // width
                files["offsets"].write(np.array(offsets, "<i8").tobytes())
                files["docs"].write(np.array(docs, "<i8").tobytes())
                n_docs += len(docs)
            if files:
                files["offsets"].write(np.array([at], "<i8").tobytes())
                for k, f in files.items():
                    f.flush()
                    os.fsync(f.fileno())
                    f.close()
                    os.replace(temporary[k], f"{folder}/part-{part:05d}.{k}")
        finally:
            for k, f in files.items():
                f.close()
                if os.path.exists(temporary[k]):
                    os.unlink(temporary[k])
        if files:
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_tokens": [at]},
                                             pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files for every row of ``doc_id, text`` and returns ``part, n_docs, n_tokens, base``.

    Rows are dealt by ranges of doc_id (null first), rows of one id by a hash of the text and their place in the input, so
    neither a hot id nor repeated rows fill one part. A null or empty text has the end id only. An empty table gives no
    part. Other columns are not read. Bases are prefix sums over the list of parts.
    """
    folder = mounted(folder)
    keys = ["doc_id", "spread", "place"]
    rows = docs.select("doc_id", "text").withColumn("spread", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    parts = stage(ordered.mapInArrow(_writer(folder, tokenizer, end_id), PART), "token-parts")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)).cast("long"))
    listed = [r.asDict() for r in based.orderBy("part").collect()]  # one small row per file
    with open(f"{folder}/index.json", "w") as f:
        json.dump({"dtype": encoder(tokenizer).dtype.str, "parts": listed}, f)
    return docs.sparkSession.createDataFrame([tuple(r.values()) for r in listed], PART + ", base long")


def part_arrays(folder: str, part: int, dtype: str):
    """The memory-mapped tokens, offsets and doc_ids of a part."""
    stem = f"{folder}/part-{part:05d}"
    return (np.memmap(f"{stem}.tokens", dtype=dtype, mode="r"), np.memmap(f"{stem}.offsets", dtype="<i8", mode="r"),
            np.memmap(f"{stem}.docs", dtype="<i8", mode="r"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, one task per part.

    ``ids_crc32`` is the unsigned CRC-32 of the document's ids as little-endian unsigned 32-bit integers.
    """
    folder = mounted(folder)
    with open(f"{folder}/index.json") as f:
        index = json.load(f)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                tokens, offsets, ids = part_arrays(folder, part, index["dtype"])
                for first in range(0, len(ids), 10_000):
                    own, at = np.array(ids[first:first + 10_000]), np.array(offsets[first:first + 10_001])
                    sums = []
                    for a, b in zip(at[:-1], at[1:]):
                        value = 0
                        for c in range(a, b, BATCH_CHARS):
                            value = zlib.crc32(tokens[c:min(b, c + BATCH_CHARS)].astype("<u4").tobytes(), value)
                        sums.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(base + at[:-1]),
                                                      pa.array(at[1:] - at[:-1]), pa.array(sums, pa.int64())], schema=schema)

    if not index["parts"]:
        return spark.createDataFrame([], SPAN)
    parts = spark.createDataFrame([(p["part"], p["base"]) for p in index["parts"]], "part long, base long")
    return parts.repartition(len(index["parts"]), "part").mapInArrow(read, SPAN)
