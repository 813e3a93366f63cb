"""Nearest neighbours by collision counting over single-projection sorted arrays.

*Index.*  Every vector is in exactly one block of about ``BLOCK`` vectors.  A block is
cut into ranges of vector length, as a few long vectors would press all others together.
A range keeps, for each of ``PROJECTIONS`` random directions (orthogonal in groups), its
vectors sorted by their projection.

*Search.*  A query's projection is the centre of a window in each sorted array; a
vector *collides* as often as it lies in the window.  Virtual rehashing widens all
windows by the factor ``GROWTH`` from level to level; a level counts only the entries that are new in it.
It ends when enough vectors, a ``VERIFY`` share of the range and ``k`` more, collide in at least
``THRESHOLD`` of the arrays.  All vectors over the threshold, however many, are verified: their inner
product with the query on the original vectors, in double precision.  Ranges are searched from the longest
vectors on; one whose longest vector can't reach the ``k`` best found so far is not searched.  All of this is
alike for ranges of every size: in a small one the windows widen until all its vectors collide.

Largest inner product becomes nearest point by one more dimension, which brings the
vectors of a range to one length.

*Distribution.*  A stated set of queries meets all rows in blocks: a unit of work is a data block and a group
of queries, keyed by both, so that neither many queries nor many vectors meet in one task; only the ``k`` best of
a query and a block leave it.  They are merged in two steps.  Each query still meets each block, so the work grows with
queries times rows.

Vectors of each length are searched among themselves.  Null, empty, zero and non-finite vectors and rows
with a null id take no part, neither as query nor as candidate.  Rows with the query's own id are not
candidates for it; an id with several vectors is searched once, by the smallest; repeated rows are candidates each.
Ties go to the smaller id; with fewer than ``k`` candidates all are returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .embedding_dedup import packed, same_type, unpacked, usable

BLOCK = 8192
#: queries of a group, at most and at least
QUERIES = (16_384, 128)
#: units of work that smaller searches are cut into, so that all tasks have some
UNITS = 64
#: components of all vectors of a block or a group of queries, at most
BLOCK_VALUES = 1 << 22
PROJECTIONS = 48
#: share of a range that is verified for a query, at least
VERIFY = 0.3
#: share of the arrays in which a vector must collide
THRESHOLD = 0.6
GROWTH = 1.15
#: distance of the sorted arrays from each other; projections lie in [-1, 1]
APART = 4.0
#: the longest vector of a range by the shortest, at most
SPAN = 1.2


def directions(width: int, m: int, seed: int = 23) -> np.ndarray:
    """(width, m) random directions, orthogonal in groups of ``width``."""
    rng, out = np.random.default_rng(seed), []
    while len(out) * width < m:
        out.append(np.linalg.qr(rng.standard_normal((width, width)))[0])
    return np.concatenate(out, axis=1)[:, :m]


def nearest(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores and their ids, ties to the smaller id."""
    if len(ids) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        ids, score = ids[some], score[some]
    at = np.lexsort((ids, -score))[:k]
    return ids[at], score[at]


class Block:
    """The vectors of one block: an index for each range of lengths, the longest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.scale = np.abs(x).max()
        y = x / self.scale  # so that no square overflows
        norms = np.sqrt((y * y).sum(axis=1))
        span = np.floor(np.log(norms.max() / norms) / np.log(SPAN))
        self.parts = [BlockIndex(ids[span == s], x[span == s]) for s in np.unique(span)]
        self.longest = [float(norms[span == s].max()) for s in np.unique(span)]

    def search(self, query: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best of the block, among those verified."""
        ids, score = np.empty(0, np.int64), np.empty(0)
        with np.errstate(over="ignore"):
            length = np.sqrt(((query / np.abs(query).max()) ** 2).sum()) * np.abs(query).max() * self.scale * (1 + 1e-9)
            for part, longest in zip(self.parts, self.longest, strict=True):
                if len(ids) == k and longest * length < score[-1]:
                    continue
                more = part.search(query, k, own)
                ids, score = nearest(np.concatenate([ids, more[0]]), np.concatenate([score, more[1]]), k)
        return ids, score


class BlockIndex:
    """The sorted arrays of one range of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m: int = PROJECTIONS):
        self.ids, self.x, self.m = ids, x, m
        n, width = x.shape
        y = x / np.abs(x).max()  # so that no square overflows
        norms = np.sqrt((y * y).sum(axis=1))
        y = y / norms.max()
        rest = np.sqrt(np.maximum(0.0, 1 - (norms / norms.max()) ** 2))
        self.r = directions(width + 1, m)
        p = np.concatenate([y, rest[:, None]], axis=1) @ self.r
        order = np.argsort(p, axis=0, kind="stable")
        # all arrays end to end, APART from each other, so that one search finds the places in all
        self.values = (np.take_along_axis(p, order, 0) + APART * np.arange(m)).T.reshape(-1)
        # narrow numbers, as counting is bound by memory
        self.order = np.ascontiguousarray(order.T.astype(np.uint16 if n <= 1 << 16 else np.int32)).reshape(-1)
        self.level = 0
        self.rough = y.astype(np.float32)

    def bounds(self, q: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """The window of the radius about q in each array, as places in all of them end to end."""
        edges = np.clip(np.concatenate([q - radius, q + radius]), -APART / 2 + 0.1, APART / 2 - 0.1) + APART * np.tile(np.arange(self.m), 2)
        return np.split(self.values.searchsorted(edges, "left"), 2)

    def entries(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How often each vector is in stretches of the sorted arrays."""
        kind = np.int32 if len(self.order) < 1 << 31 else np.int64
        at = np.arange(length.sum(), dtype=kind)
        at += np.repeat((start - np.concatenate([[0], np.cumsum(length)[:-1]])).astype(kind), length)
        return np.bincount(self.order[at], minlength=len(self.ids))

    def colliding(self, q: np.ndarray, want: int) -> np.ndarray:
        """Vectors over the threshold, at the first level with ``want`` of them."""
        need = int(np.ceil(THRESHOLD * self.m))
        level = self.level  # levels are alike from query to query: begin near the last one's
        while True:
            lo, hi = self.bounds(q, 0.05 * GROWTH**level)
            count = self.entries(lo, hi - lo)
            if level == 0 or (count >= need).sum() < want:
                break
            level = max(0, level - 3)
        while (count >= need).sum() < want:
            level += 1
            left, right = self.bounds(q, 0.05 * GROWTH**level)
            count += self.entries(np.concatenate([left, hi]), np.concatenate([lo - left, right - hi]))
            lo, hi = left, right
        self.level = max(0, level - 2)
        return np.flatnonzero(count >= need)

    def search(self, query: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best of the range, among those verified."""
        n = len(self.ids)
        c = query / np.abs(query).max()
        c = c / np.sqrt((c * c).sum())
        rows = self.colliding(np.append(c, 0.0) @ self.r, min(n, int(k + 1 + VERIFY * n)))
        if own is not None:
            rows = rows[self.ids[rows] != own]
        if len(rows) > 4 * k:  # first in single precision, with room for its error; both sides have a length of 1 at most
            rough = self.rough[rows] @ c.astype(np.float32)
            least = np.partition(rough, len(rough) - k)[len(rough) - k]
            rows = rows[rough >= least - np.float32(4 * (len(c) + 8) * 2.0**-23)]
        return nearest(self.ids[rows], (self.x[rows] * query).sum(axis=1), k)


def search(
    df: DataFrame, is_query: Column, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, id, score) of each query's ``k`` best; ``is_query`` is a condition on ``id``."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), same_type(df, vector_col).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = scratch.cut(rows.select(F.col("id").alias("node"), "vector", F.size("vector").alias("w"), F.monotonically_increasing_id().alias("place")))
    asked = scratch.cut(rows.withColumn("id", F.col("node")).filter(is_query).groupBy("node").agg(F.min("vector").alias("vector")).withColumn("w", F.size("vector")))
    fits = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.col("w")))
    up = lambda n, size: F.ceil(F.col(n) / size).cast("long")
    sizes = rows.groupBy("w").agg(F.count("*").alias("n")).join(asked.groupBy("w").agg(F.count("*").alias("q")), "w")
    sizes = sizes.withColumn("blocks", up("n", F.least(F.lit(block), fits)))
    # groups of queries: large, as every block is sent to each, but enough of them
    group = F.greatest(F.lit(QUERIES[1]), F.least(F.lit(QUERIES[0]), F.ceil(F.col("q") * F.col("blocks") / F.lit(float(UNITS)))))
    sizes = scratch.cut(sizes.withColumn("groups", up("q", F.least(group, fits))).select("w", "blocks", "groups"))
    units = sizes.agg(F.sum(F.col("blocks") * F.col("groups")), F.max("blocks")).first()
    kind = "query_id long, rank int, id long, score double"
    if not units[0]:
        return df.sparkSession.createDataFrame([], kind)
    data = rows.join(sizes, "w").withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")))
    data = scratch.cut(packed(data)).join(sizes, "w").withColumn("group", F.explode(F.expr("sequence(0L, groups - 1)")))
    queries = asked.join(sizes, "w").withColumn("block", F.pmod(F.xxhash64("node"), F.col("groups")))
    queries = scratch.cut(packed(queries)).withColumnRenamed("block", "group").join(sizes, "w").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    # a fixed number of partitions, as a few small rows are much work
    parts = int(min(units[0], 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    key = ["w", "block", "group"]
    data = data.select(*key, "node", "xs").repartition(parts, *key)
    queries = queries.select(*key, F.col("node").alias("q_node"), F.col("xs").alias("q_xs")).repartition(parts, *key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if last != (r["w"], r["block"]):
                    last = (r["w"], r["block"])
                    ids = np.frombuffer(r["node"], np.int64)
                    index = Block(ids, unpacked(r["xs"], len(ids), r["w"]))
                q_ids = np.frombuffer(r["q_node"], np.int64)
                q_x = unpacked(r["q_xs"], len(q_ids), r["w"])
                found = [index.search(x, k, int(q)) for q, x in zip(q_ids, q_x, strict=True)]
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[0] for f in found]))], names=["score", "id"])
                ends = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(np.full(len(q_ids), r["block"])), pa.ListArray.from_arrays(ends, flat)], names=["query_id", "b", "hits"])

    near = data.join(queries, key).select(*key, "node", "xs", "q_node", "q_xs").mapInArrow(run, "query_id long, b long, hits array<struct<score:double,id:long>>")
    first = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c)), lambda x, y: F.when(x.score > y.score, -1).when(x.score < y.score, 1).when(x.id < y.id, -1).when(x.id > y.id, 1).otherwise(0)), 1, k)
    some = near.groupBy("query_id", F.pmod(F.col("b"), F.lit(max(1, round(units[1] ** 0.5)))).alias("part")).agg(first("hits").alias("hits"))
    best = some.groupBy("query_id").agg(first("hits").alias("hits"))
    return best.select("query_id", F.posexplode("hits").alias("at", "h")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.id").alias("id"), F.col("h.score").alias("score"))
