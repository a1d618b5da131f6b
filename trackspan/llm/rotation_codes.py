"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector, randomly rotated, is stored as its signs with the correction factor <code, vector>. With another rotated
vector the code gives an unbiased estimate of their inner product and a confidence bound; only pairs whose bound reaches
the threshold are computed exactly. Parts of the same codes deal vectors into buckets, so not all pairs are estimated.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .common import map_groups, ship, worker_cache
from .components import components

ship(__name__)

THRESHOLD = 0.93
RECALL = 0.999
BUCKET = 256
TILE = 2000
CONFIDENCE = 4.0
SLACK = 1e-4  # of single precision in estimates
SEED = 20_200_801
NODE = "node long, dims int, label string, vector array<float>, copies long"


def rotation(dims: int, number: int) -> np.ndarray:
    """The ``number``-th random rotation of a space, the same in every process."""
    cache = worker_cache()
    if ("rotation", dims, number) not in cache:
        q, r = np.linalg.qr(np.random.default_rng([SEED, dims, number]).standard_normal((dims, dims)))
        cache["rotation", dims, number] = q * np.sign(np.diag(r))
    return cache["rotation", dims, number]


def usable(vector: Column) -> Column:
    """True for vectors of a direction: not null, no null or non-finite component, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def plan_tables(largest: int, threshold: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Signs per table and number of tables.

    Two vectors at the threshold differ in a sign with probability angle / pi, so they share a bucket of k signs with p^k.
    k makes buckets of the largest label hold about ``bucket`` vectors, the number of tables then gives the recall.
    """
    same = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    k = max(1, math.ceil(math.log2(max(2, largest / bucket))))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same ** k))) if same < 1 else 1


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated rows and the correction factor <code, row>."""
    turned = unit @ rotation(unit.shape[1], 0).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded rows with rotated unit rows, and the error bound per coded row.

    With code = signs / sqrt(D), <code, y> / <code, x> is unbiased for <x, y> over random rotations. Its error is at most
    sqrt(1 - f^2) / f, f the stored factor, and stays below e / sqrt(D - 1) times that but for a probability that falls
    as exp(-e^2 / 2).
    """
    d = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * np.float32(2) - np.float32(1)
    factors = np.maximum(factors, 1e-9)
    error = np.sqrt(np.maximum(0.0, 1 - factors ** 2)) / factors * min(1.0, CONFIDENCE / math.sqrt(max(1, d - 1)))
    return signs @ turned.T / (factors * math.sqrt(d))[:, None].astype(np.float32), error


def _with_codes(k: int, tables: int):
    """Adds code, correction factor and the bucket number in each table; these signs come from further rotations."""
    weights = (1 << np.arange(k, dtype=np.int64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            flat, at = batch.column(3).flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            keys, factors = np.zeros((batch.num_rows, tables), np.int64), np.zeros(batch.num_rows)
            codes: list[bytes] = [b""] * batch.num_rows
            for d in map(int, np.unique(dims)):
                rows = np.flatnonzero(dims == d)
                x = unit_rows(np.stack([flat[at[r]:at[r] + d] for r in rows]))
                packed, factors[rows] = coded(x)
                for r, c in zip(rows, packed):
                    codes[r] = c.tobytes()
                signs = np.concatenate([x @ rotation(d, 1 + n).T > 0 for n in range(-(-k * tables // d))], axis=1)[:, :k * tables]
                keys[rows] = (signs.reshape(len(rows), tables, k) * weights).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(factors), lists],
                                             names=[*batch.schema.names, "code", "factor", "keys"])

    return run


def _link_tile(threshold: float, tables: int):
    """Per vector of a tile: links found first here, and the least vector of its links within the tile."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    step = 256

    def run(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        column = lambda name: table.column(name).to_numpy(zero_copy_only=False)
        ids, copies, dims, bucket_of = column("node"), column("copies"), column("dims"), column("table")
        halves, square, labels, codes, factors = column("half"), column("square"), column("label"), column("code"), column("factor")
        flat = table.column("vector").combine_chunks().flatten().to_numpy()
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, tables)
        at = np.concatenate([[0], np.cumsum(dims)])
        out_node, out_root, out_links = [], [], []
        # Buckets whose tiles share a 64-bit hash stand next to each other.
        begins = np.zeros(len(ids), bool)
        begins[bounds[:-1]] = True
        for values in (dims, labels, bucket_of, column("key")):
            begins[1:] |= values[1:] != values[:-1]
        bounds = np.append(np.flatnonzero(begins), len(ids))
        for begin, end in zip(bounds[:-1], bounds[1:]):
            n, d, t = end - begin, int(dims[begin]), int(bucket_of[begin])
            if n < 2:
                continue
            unit = unit_rows(flat[at[begin]:at[end]].reshape(n, d))
            turned = (unit @ rotation(d, 0).T).astype(np.float32)
            code = np.frombuffer(b"".join(codes[begin:end]), np.uint8).reshape(n, -1)
            own, half, sq, number = keys[begin:end], halves[begin:end], square[begin:end], ids[begin:end]
            links = np.zeros(n, np.int64)
            parent = np.arange(n)
            for first in range(0, n, step):
                rows = slice(first, min(n, first + step))
                guess, error = estimates(code[rows], factors[begin:end][rows], turned[first:])
                i, j = np.nonzero(guess + error[:, None] >= threshold - SLACK)
                i, j = i + first, j + first
                live = (i < j) & (sq[i] | (half[i] != half[j]))
                i, j = i[live], j[live]
                for a in range(0, len(i), 1 << 16):
                    p, q = i[a:a + (1 << 16)], j[a:a + (1 << 16)]
                    near = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                    p, q = p[near], q[near]
                    new = ~(own[p, :t] == own[q, :t]).any(axis=1)  # an earlier table has not linked this pair
                    p, q = p[new], q[new]
                    np.add.at(links, p, copies[begin + q])
                    np.add.at(links, q, copies[begin + p])
                    _join(parent, p, q, number)
            roots = _roots(parent)
            hit = np.flatnonzero(links)
            out_node.append(number[hit])
            out_root.append(number[roots[hit]])
            out_links.append(links[hit])
        if not out_node:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (out_node, out_root, out_links)], schema=schema)

    return run


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def _join(parent: np.ndarray, p: np.ndarray, q: np.ndarray, number: np.ndarray) -> None:
    """Joins the trees of linked rows in place; the root of a tree is its row with the least id."""
    while len(p):
        parent[:] = _roots(parent)
        p, q = parent[p], parent[q]
        apart = p != q
        p, q = p[apart], q[apart]
        swap = number[p] > number[q]
        low, high = np.where(swap, q, p), np.where(swap, p, q)
        parent[high] = low  # one of several wins; the others are joined in the next round
        p, q = low, high


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET,
                 tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``.

    Rows are compared if their labels are equal and not null, and link at a cosine of ``threshold`` or more, computed in
    double precision. Null vectors, vectors of zeros or with null or non-finite components link with nothing, nor do
    vectors of different lengths or rows with a null id; such rows are components of their own (a null id: null).
    Repeated rows are vectors that link with each other; rows of one id should hold one vector, else the links of all of
    them count for it. An empty table gives an empty result; other columns are not read.

    Equal vectors of a label become one node with a count. Nodes are dealt to buckets by ``tables`` groups of signs, as
    many as give pairs at the threshold the recall asked for whatever the size of the table; a bucket of more than
    ``tile`` nodes is compared in tiles, so none is capped. A pair counts in the first table where it meets. Tiles return
    sums and the least linked node per node, no pairs.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("vector"), F.col("label").cast("string").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    nodes = stage(rows.where(sound).groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
                  .select("node", F.size("vector").alias("dims"), "label", "vector", "copies"), "vectors")
    largest = nodes.groupBy("label", "dims").count().agg(F.max("count")).first()[0]
    k, tables = plan_tables(largest or 1, threshold, recall, bucket)
    keyed = stage(nodes.mapInArrow(_with_codes(k, tables), NODE.replace("array<float>", kind) + ", code binary, factor double, keys array<long>"), "keyed")
    dealt = keyed.select("*", F.posexplode("keys").alias("table", "key"))
    buckets = stage(dealt.groupBy("label", "dims", "table", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    parts = F.ceil(F.col("n") / tile).cast("int")
    split = (dealt.join(buckets, ["label", "dims", "table", "key"]).withColumn("parts", parts)
             .withColumn("half", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(F.xxhash64("label", "dims", "table", "key", F.least("half", "other"), F.greatest("half", "other")).alias("tile"),
                     "node", "dims", "label", "vector", "copies", "code", "factor", "keys", F.col("table").cast("int"), "key", "half", (F.col("half") == F.col("other")).alias("square")))
    found = stage(map_groups(split, "tile", _link_tile(threshold, tables), "node long, root long, links long", "table", "label", "dims", "key"), "links")
    linked = stage(found.groupBy("node").agg(F.sum("links").alias("links")), "link-sums")
    roots = stage(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
    nodes = nodes.select("label", "vector", "node", "copies").join(linked, "node", "left").join(roots, "node", "left")
    nodes = stage(nodes.select("label", "vector", F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.coalesce("root", "node")).toDF("label", "vector", "n_links", "component_id"), "linked")
    out = rows.where(sound).join(nodes, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where(~sound).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
