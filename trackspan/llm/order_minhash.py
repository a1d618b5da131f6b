"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Similarity of two texts is one minus the edit distance of their word sequences over the longer length. Order MinHash
samples, per hash function, the ``PICKED`` k-mers of five words with the least hash, each labelled by its occurrence, and
keeps them in text order; texts that agree in one such tuple are candidates. Longer texts also have tuples of the k-mers with the
greatest hash; shorter ones, whose few k-mers make tuples a matter of chance, are also keyed by single least k-mers (``LAYOUT``).
Texts of up to ``EXACT`` words are keyed by what is left of them after few deletions too, which misses no similar pair of such texts.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import scope, stage
from .common import fresh, map_groups, mix64, ship, word_pieces, words_of
from .components import components

ship(__name__)

SHINGLE, SIMILARITY = 5, 0.8
FUNCTIONS, PICKED = 64, 2
# Where numbers of a sketch stand, and the texts, by number of words, that have them. Two similar texts of at least 100 words both have the
# second part, two of less both have the third, and two of which one has less than 40 both have the fourth.
LAYOUT = ((0, 64, 1, 1 << 62), (64, 104, 80, 1 << 62), (104, 120, 1, 125), (120, 168, 1, 50))
WIDTH = 168
EXACT = 15
BINS = 512
TILE = 2000
CHUNK = 1 << 15
SLOTS = 1 << 20
PER_MEETING = 2
SKETCH = "doc_id long, key binary, n_words long, bins binary, sketch array<long>"
SEEDS = mix64(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def kmers(codes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-mers of a text in order, labelled by occurrence; a shorter text is one k-mer."""
    if not len(codes):
        return np.empty(0, np.uint64)
    k = min(k, len(codes))
    size = len(codes) - k + 1
    out = np.zeros(size, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + size].astype(np.uint64) + np.uint64(1)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not first.all():
        place = np.arange(len(out))
        occurrence = np.empty(len(out), np.uint64)
        occurrence[order] = place - np.maximum.accumulate(np.where(first, place, 0))
        out = out + occurrence * np.uint64(0xD1342543DE82EF95)
    return mix64(out)


def places_of(n_words: int) -> np.ndarray:
    """The places of a whole sketch that a text of that length has."""
    return np.concatenate([np.arange(first, end) for first, end, least, most in LAYOUT if least <= n_words < most])


def sketch_of(codes: np.ndarray) -> np.ndarray:
    """One 64-bit number per place that the text has: the least k-mers of each hash function in text order, the greatest ones of
    the first functions, the least one alone."""
    labelled = kmers(codes)
    if not len(labelled):
        return np.empty(0, np.int64)
    short = (labelled >> np.uint64(32)).astype(np.uint32)
    a = (SEEDS[:FUNCTIONS] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
    b = (SEEDS[:FUNCTIONS] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    lines = np.arange(FUNCTIONS)
    ends: tuple[list, list] = ([], [])  # values and places at the low end, at the high end
    for begin in range(0, len(short), CHUNK):
        own = (short[None, begin:begin + CHUNK] ^ a) * b
        own ^= own >> np.uint32(15)
        own *= np.uint32(0x2C1B3C6D)
        own ^= own >> np.uint32(13)
        for found, worst, at_end in ((ends[0], np.uint32(0xFFFFFFFF), np.argmin), (ends[1], np.uint32(0), np.argmax)):
            taken = []
            for _ in range(min(PICKED, own.shape[1])):
                at = at_end(own, axis=1)
                value = own[lines, at].copy()
                found.append((value if worst else ~value, at + begin))
                taken.append((at, value))
                own[lines, at] = worst
            for at, value in reversed(taken):
                own[lines, at] = value
    tuples = []
    for found in ends:
        values, places = (np.stack(x, 1) for x in zip(*found))
        places = np.take_along_axis(places, np.argsort(values, axis=1, kind="stable")[:, :PICKED], 1)
        tuples.append(places)
    low, high = (np.sort(t, axis=1) for t in tuples)
    out = SEEDS.copy()
    for begin, end, picked in ((0, 64, low), (64, 104, high), (104, 168, tuples[0][:, :1])):
        for column in picked[:end - begin].T:
            out[begin:end] = mix64(out[begin:end] ^ labelled[column])
    return out[places_of(len(codes))].view(np.int64)


def _marks(sketch: np.ndarray) -> np.ndarray:
    return (sketch.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype("<u4")


def deletions(codes: np.ndarray, similarity: float) -> np.ndarray:
    """One 64-bit number per way to delete words, none included, as many as a similar text may differ by.

    Two texts at edit distance d are equal after at most d deletions in each. The longer of two similar texts has at most
    n / similarity words, which bounds d.
    """
    n = len(codes)
    most = min(n, distance_limit(int(n / similarity + 1e-9), similarity)) if similarity > 0 else n
    out = []
    for left in range(max(n - most, 1), n + 1):
        chosen = np.array(list(itertools.combinations(range(n), left)), np.int64)
        h = np.full(len(chosen), left + 1, np.uint64)
        for column in chosen.T:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[column].astype(np.uint64))
        out.append(h)
    return np.unique(np.concatenate(out)).view(np.int64)


def sketches(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, key, n_words, bins, sketch`` of every row with words and an id.

    ``key`` is a 128-bit hash of the word sequence, ``bins`` the number of words (little-endian
    uint32) and their counts in 512 hashed bins (a byte each, at most 255), from which a lower bound of the edit distance
    follows. ``sketch`` has the sketch numbers and, for texts of up to ``EXACT`` words, after them those of :func:`deletions`.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sizes, bins, out = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, parts = hashlib.blake2b(digest_size=16), []
                for words in word_pieces(text.as_buffer().to_pybytes()):
                    key.update(b" ".join(words) + b" ")
                    parts.append(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)))
                codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
                if not len(codes):
                    continue
                ids.append(doc_id)
                keys.append(key.digest())
                sizes.append(len(codes))
                counts = np.minimum(np.bincount(codes % BINS, minlength=BINS), 255).astype(np.uint8)
                bins.append(np.array([len(codes)], "<u4").tobytes() + counts.tobytes())
                out.append(sketch_of(codes))
                if len(codes) <= EXACT:
                    out[-1] = np.concatenate([out[-1], deletions(codes, similarity)])
            ends = np.cumsum([0, *map(len, out)])
            flat = pa.array(np.concatenate(out) if out else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                names=["doc_id", "key", "n_words", "bins", "sketch"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, SKETCH)


def banded_distance(long: list, short: list, limit: int) -> int | None:
    """Edit distance of two sequences (the longer first), or None if it exceeds ``limit``.

    Only cells of the alignment matrix within a band around the main diagonal are computed. The band starts narrow and
    doubles until the distance found fits into it, which makes it exact. Differences between neighbouring cells of a
    column are bits of one integer (up: 1 more, down: 1 less), so a column takes a few integer operations.
    """
    apart = len(long) - len(short)
    if apart > limit:
        return None
    if not short:
        return apart
    at: dict = {}
    for i, w in enumerate(long):
        at[w] = at.get(w, 0) | 1 << i
    band = max(apart, 4)
    while True:
        band = min(band, limit)
        # Bit b of column j is row j - band + b; bit `goal` lies on the diagonal that ends in the last cell.
        full, goal, distance = (1 << 2 * band + 1) - 1, band + apart, apart
        up, down = full ^ ((1 << band) - 1), 0
        for j, w in enumerate(short):
            places = at.get(w, 0)
            equal = (places << band - j if j < band else places >> j - band) & full
            level = ((((equal & up) + up) ^ up) | equal | down) & full  # cells equal to their upper left neighbour
            if not level >> goal & 1:
                distance += 1
                if distance > band:
                    break
            more, less = down | full & ~(level | up), level & up  # against the cell to the left
            level >>= 1
            up, down = less | full & ~(level | more), level & more
        if distance <= band:
            return distance
        if band >= limit:
            return None
        band *= 2


def distance_limit(longest: int, similarity: float) -> int:
    """The largest edit distance that keeps the similarity."""
    return int((1 - similarity) * longest + 1e-9)


def similar(a: list, b: list, similarity: float = SIMILARITY) -> bool:
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    return bool(b) and banded_distance(a, b, distance_limit(len(a), similarity)) is not None


def _bound(similarity: float):
    """Keeps pairs whose lengths and word counts allow the similarity: half the difference of counts is a lower bound."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_counts(batch.column(c).to_pylist()) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(_may_match(*x, *y, similarity)))

    return run


def _counts(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 4 + BINS)
    return np.ascontiguousarray(raw[:, :4]).view("<u4").ravel().astype(np.int64), raw[:, 4:].astype(np.int16)


def _may_match(nx, x: np.ndarray, ny, y: np.ndarray, similarity: float) -> np.ndarray:
    """Words that one text has and the other lacks each take an edit, and so does each word of difference in length.

    Hashing words together, and cutting counts at 255, can only lower what is found.
    """
    more = x - y
    least = np.maximum(np.maximum(more, 0).sum(axis=-1, dtype=np.int64), np.maximum(-more, 0).sum(axis=-1, dtype=np.int64))
    least = np.maximum(least, np.abs(nx - ny))
    return least <= ((1 - similarity) * np.maximum(nx, ny) + 1e-9).astype(np.int64)


def slot_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int").alias("slot")


def in_slots(rows: DataFrame, column: str, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose ``column`` may be among the values of ``wanted`` (``left_anti``: the rows where it is not).

    What goes out to the tasks are hash slots of the values, ``SLOTS`` numbers at most, whatever their count. Rows that nobody asks for
    stay where they are; the others meet the values in a join of the caller.
    """
    slots = wanted.select(slot_of(wanted.columns[0])).distinct()
    return rows.select("*", slot_of(column)).join(F.broadcast(slots), "slot", how).drop("slot")


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``a, b`` of node ids, a staged table, that lengths and counts of words allow, as a staged table."""
    counts = in_slots(nodes.select("doc_id", "bins"), "doc_id", pairs.select("a").union(pairs.select("b")))
    near = (pairs.join(counts.withColumnsRenamed({"doc_id": "a", "bins": "x"}), "a")
            .join(counts.withColumnsRenamed({"doc_id": "b", "bins": "y"}), "b").select("a", "b", "x", "y"))
    return stage(near.mapInArrow(_bound(similarity), "a long, b long"), "candidates")


def verified(near: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``a, b`` of node ids whose texts are similar, by banded alignment.

    The texts of the nodes involved are cut from the documents once and staged, then joined to the pairs, which are read
    more than once.
    """
    wanted = stage(near.select("a").union(near.select("b")).distinct().select(F.col("a").alias("node")), "wanted")
    own = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"), "text")
    own = in_slots(own, "node", wanted)
    # Rows of one id should be one text; if they are not, the least text stands for the id.
    texts = stage(own.join(wanted, "node", "left_semi"), "texts")
    texts = texts.groupBy("node").agg(F.min("text").alias("text")) if texts.count() > wanted.count() else texts

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left: tuple = (None, [])
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if left[0] != a:
                    left = (a, words_of(x.as_buffer().to_pybytes()))
                keep.append(similar(left[1], words_of(y.as_buffer().to_pybytes()), similarity))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = (near.join(texts.select(F.col("node").alias("b"), F.col("text").cast("binary").alias("y")), "b")
              .join(texts.select(F.col("node").alias("a"), F.col("text").cast("binary").alias("x")), "a").select("a", "b", "x", "y"))
    return joined.mapInArrow(align, "a long, b long")


def _mark_rows(marks: pa.ListArray, sizes: np.ndarray) -> np.ndarray:
    """The marks of a text per row, at their places; where a text has none stands a number that no other row has."""
    rows = np.repeat(np.arange(len(sizes), dtype=np.uint64)[:, None], WIDTH, axis=1) + np.uint64(1 << 32)
    starts, values = marks.offsets.to_numpy(), marks.values.to_numpy().view(np.uint32)
    places: dict[int, np.ndarray] = {}
    for i, size in enumerate(sizes.tolist()):
        own = places[size] if size in places else places.setdefault(size, places_of(size))
        rows[i, own] = values[starts[i]:starts[i] + len(own)]
    return rows


def _within(sizes: np.ndarray, size: int, similarity: float) -> np.ndarray:
    return np.abs(sizes - size) <= ((1 - similarity) * np.maximum(sizes, size) + 1e-9).astype(np.int64)


def _live_members(similarity: float):
    """The members of a tile that some member of another class there may be similar to, by their numbers of words.

    In the order of these numbers those near one's own stand together, and another class is among them where the class changes.
    """
    def run(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        sizes, roots = table.column("n_words").to_numpy(), table.column("root").to_numpy()
        alive = np.zeros(len(sizes), bool)
        for begin, end in zip(bounds[:-1], bounds[1:]):
            order = begin + np.argsort(sizes[begin:end], kind="stable")
            own, classes = sizes[order], roots[order]
            changes = np.concatenate([[0], np.cumsum(classes[1:] != classes[:-1])])
            # One word of slack either way, as the exact bound follows.
            first = np.searchsorted(own, np.floor(own * similarity) - 1, "left")
            last = np.searchsorted(own, np.ceil(own / similarity) + 1, "right") - 1 if similarity > 0 else np.full(len(own), len(own) - 1)
            alive[order] = changes[last] > changes[first]
        if not alive.any():
            return None
        return table.filter(pa.array(alive)).combine_chunks().to_batches()[0]

    return run


def _tile_pairs(similarity: float, most: int | None):
    """``a, b, h``: pairs of a tile that are in different classes so far and that lengths and word counts allow.

    Two texts meet in every bucket they share. A pair is given out in the bucket of the first sketch that both have alike, so by
    one tile only; a pair that no sketch but deletions bring together, by each of those. (Sketches count as alike by 32 bits: of 10^8 pairs some
    four fall to a bucket they do not share and are not compared there.) Of two classes no more than ``most`` pairs are given
    out, those with most sketches alike; ``h`` is the bucket if it has more, else null.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("h", pa.int64())])

    def run(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        ids, roots, buckets = (table.column(c).to_numpy() for c in ("node", "root", "h"))
        halves, square = table.column("half").to_numpy(), table.column("square").to_numpy(zero_copy_only=False)
        bucket = _marks(buckets)
        sizes, counts = _counts(table.column("bins").to_pylist())
        marks = _mark_rows(table.column("marks").combine_chunks(), sizes)
        out = []
        for begin, end in zip(bounds[:-1], bounds[1:]):
            found = []
            for i in range(begin, end - 1):
                others = np.arange(i + 1, end)
                # Tiles off the diagonal compare the two halves only.
                others = others[(roots[others] != roots[i]) & (square[i] | (halves[others] != halves[i]))]
                others = others[_within(sizes[others], sizes[i], similarity)]
                if not len(others):
                    continue
                alike = marks[others] == marks[i]
                first = alike.argmax(axis=1)
                mine = (marks[i, first] == bucket[i]) | ~alike[np.arange(len(others)), first]
                others, alike = others[mine], alike[mine]
                near = _may_match(sizes[i], counts[i][None, :], sizes[others], counts[others], similarity)
                if near.any():
                    found.append(np.stack([np.full(near.sum(), i), others[near], alike[near].sum(axis=1)]))
            if not found:
                continue
            x, y, shared = np.concatenate(found, axis=1)
            held = np.full(len(x), False)
            if most is not None:
                low, high = np.minimum(roots[x], roots[y]), np.maximum(roots[x], roots[y])
                order = np.lexsort((-shared, high, low))
                x, y, low, high = x[order], y[order], low[order], high[order]
                new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
                at = np.arange(len(x))
                kept = at - np.maximum.accumulate(np.where(new, at, 0)) < most
                x, y, held = x[kept], y[kept], np.full(kept.sum(), not kept.all())
            out.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y])),
                                                   pa.array(buckets[x], mask=~held)], schema=schema))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return run


def tile_pairs(filled: DataFrame, roots: DataFrame, nodes: DataFrame, similarity: float, tile: int, most: int | None) -> DataFrame:
    """``a, b, h`` of :func:`_tile_pairs` for the buckets ``h, node, n`` that hold several classes of ``node, root``, as a staged table.

    Buckets are compared in tiles of at most two times ``tile`` members. What is compared of a text is fetched for those members only
    to which lengths leave a partner.
    """
    classed = stage(filled.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classed")
    mixed = classed.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("h")
    parts = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiles = (classed.join(mixed, "h").withColumn("parts", parts).withColumn("half", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(F.xxhash64("h", F.least("half", "other"), F.greatest("half", "other")).alias("tile"), "h", "node", "root", "half",
                     (F.col("half") == F.col("other")).alias("square")))
    tiles = tiles.join(nodes.select(F.col("doc_id").alias("node"), "n_words"), "node")
    live = stage(map_groups(tiles, "tile", _live_members(similarity), tiles.schema), "live-members")
    low = F.transform(F.slice("sketch", 1, WIDTH), lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    own = in_slots(nodes.select(F.col("doc_id").alias("node"), "bins", low.alias("marks")), "node", live.select("node"))
    compared = live.drop("n_words").join(own, "node")
    return stage(map_groups(compared, "tile", _tile_pairs(similarity, most), "a long, b long, h long"), "tile-pairs")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` for every row of ``doc_id, text``.

    ``class_id`` is the least doc_id that chains of similar texts reach; ``class_size`` counts the rows of the class;
    ``kept`` marks its one representative row by id. Texts of the same words (letters A-Z in lower case) are one class
    without alignment. Null and empty texts, and texts without words, are classes of their own; so is a null id, whose
    class is null. Rows of one doc_id are one document. An empty table gives an empty result, other columns are not read.

    Texts are collapsed to one node per word sequence, so copies cost nothing further. Buckets of equal sketch numbers
    give pairs in three steps that never list all pairs of a bucket of similar texts. Each node first meets one least
    member of its buckets whose length allows it, then any two classes that meet do so in one pair: a group of mutually similar texts is one
    class after that. Buckets that still hold several classes are compared in tiles of at most two times ``tile``
    members, keeping pairs of different classes that word counts allow, each once; first a few of each two classes, then, of the classes
    that are still apart, all. Those are aligned too, so no candidate is lost.
    """
    with scope():  # sketches go as soon as each word sequence has its node
        sketched = stage(sketches(docs, similarity), "sketches")
        groups = stage(sketched.groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
        members = stage(sketched.select("key", "doc_id").join(groups, "key").select("doc_id", "node").distinct(), "members", kept=True)
        several = groups.where("n > 1").select("key", "node")
        wide = sketched.select("doc_id", "key", "n_words", "bins", "sketch")
        copied = in_slots(wide, "key", several).join(several.withColumnRenamed("node", "least"), "key", "left").where("doc_id = coalesce(least, doc_id)")
        nodes = in_slots(wide, "key", several, "left_anti").drop("key").union(copied.drop("key", "least"))
        nodes = stage(nodes.dropDuplicates(["doc_id"]) if _repeats(sketched) else nodes, "sketched-nodes", kept=True)
    hashes = nodes.select(F.col("doc_id").alias("node"), F.explode("sketch").alias("h"))
    bucket = Window.partitionBy("h")
    filled = hashes.select("h", "node", F.min("node").over(bucket).alias("pivot"), F.count("*").over(bucket).alias("n")).where("n > 1")
    filled = stage(filled, "bucketed")
    sizes = nodes.select(F.col("doc_id").alias("node"), F.col("n_words").alias("size"))
    met = (filled.where("node != pivot").groupBy("node", "pivot").agg(F.count("*").alias("shared"))
           .join(sizes, "node").join(sizes.withColumnsRenamed({"node": "pivot", "size": "pivot_size"}), "pivot"))
    room = (F.lit(1 - similarity) * F.greatest("size", "pivot_size") + F.lit(1e-9)).cast("long")
    meetings = stage(met.where(F.abs(F.col("size") - F.col("pivot_size")) <= room).select("node", "pivot", "shared"), "meetings")

    # Each node with the least member it shares most buckets with: at most one pair per node.
    best = meetings.groupBy("node").agg(F.max(F.struct("shared", (-F.col("pivot")).alias("low"))).alias("x"))
    first = stage(best.select((-F.col("x.low")).alias("a"), F.col("node").alias("b")), "first-pairs")
    links = stage(verified(possible(first, nodes, similarity), docs, similarity), "first-links")
    roots = stage(components(links), "first-roots")

    # Then one pair for any two classes that meet.
    other = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    met = (meetings.join(roots, "node", "left").join(other, "pivot", "left")
           .withColumns({"root": F.coalesce("root", "node"), "pivot_root": F.coalesce("pivot_root", "pivot")}).where("root != pivot_root"))
    met = met.groupBy(F.least("root", "pivot_root"), F.greatest("root", "pivot_root")).agg(
        F.max(F.struct("shared", (-F.col("pivot")).alias("a"), (-F.col("node")).alias("b"))).alias("x"))
    second = met.select((-F.col("x.a")).alias("a"), (-F.col("x.b")).alias("b")).join(first, ["a", "b"], "left_anti")
    second = stage(second, "second-pairs")
    links = stage(links.union(verified(possible(second, nodes, similarity), docs, similarity)), "links")
    roots = stage(components(links), "roots")

    # Buckets that still hold several classes, in tiles: the likeliest pairs of each two classes, then all pairs of those that are left.
    tried = first.union(second)
    for most in (PER_MEETING, None):
        more = tile_pairs(filled, roots, nodes, similarity, tile, most)
        found = stage(more.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "more-candidates")
        links = stage(links.union(verified(found, docs, similarity)), "more-links")
        roots, tried = stage(components(links), "more-roots"), tried.union(found)
        held = more.select("h").where("h IS NOT NULL").distinct()
        if held.isEmpty():
            break
        filled = filled.join(held, "h", "left_semi")
    final = roots

    classes = members.join(final, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))
    classes = stage(classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "classes")
    out = docs.select(F.col("doc_id")).join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = stage(out, "classed-rows")
    sizes = stage(out.groupBy("class_id").agg(F.count("*").alias("class_size")), "class-sizes")
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    size = F.when(F.col("class_id").isNull(), 1).otherwise(F.col("class_size")).cast("long")
    return out.join(sizes, "class_id", "left").select("doc_id", "class_id", size.alias("class_size"), kept.alias("kept"))


def _repeats(sketched: DataFrame) -> bool:
    return not sketched.groupBy("doc_id").count().where("count > 1").isEmpty()


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns as they are, less all but one document of each class; a repeated id stays once.

    Rows without an id stay.
    """
    gone = fresh("class_of_row", docs)
    rows = near_duplicates(docs, similarity).where("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(rows, docs["doc_id"] == rows[gone], "left_anti")
    named = left.where(F.col("doc_id").isNotNull())
    if not _repeats(docs):
        return left
    return named.dropDuplicates(["doc_id"]).union(left.where(F.col("doc_id").isNull()))
