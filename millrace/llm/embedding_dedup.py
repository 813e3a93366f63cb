"""Near-duplicate vectors by sorted projection passes.

1. Vectors that are equal are one *class* with a row count.
2. A *pass* hashes a class to the signs of ``BITS`` random projections and orders
   the classes by these bits, the first projection first.  The keys of all passes are laid
   end to end in one table, which is range-partitioned by (pass, length, bits), so
   equal or hot bits are spread over partitions.  Every class is
   compared with the ``window`` ones before it, by blocks of the order and pairs of blocks.  Pairs with a cosine of at least the
   threshold, in double precision, are links; a pair of blocks hands on a spanning forest of them.
   How many passes there are follows from the number of classes: two vectors at the threshold agree in a
   projection with a known probability, and must agree in as many as tell the classes apart but for a window.
3. The forests of all passes are united to components.
4. *Probes*, about ``PROBES`` classes of each length chosen by hash, are compared with all classes, in blocks.  The share
   of their links that the passes have joined is the measured recall.  While it is below ``RECALL``, as where
   thousands of vectors lie near each other, a further round of passes has windows ``WIDER`` times as wide, at every size of the input.  What the
   probes find is united when all rounds are done, and never counts as found by passes.  Rounds end at the latest with the one pass whose windows hold all pairs.
5. Links are then counted exactly inside every component: its members are compared
   in blocks (a component larger than a block in pairs of blocks, one group each), and only
   the counts leave the tasks.  So the number of neighbours a class can have is not bounded by
   the window, and no pair is emitted.

Vectors of different lengths link with nothing of each other; those of each length are compared.  Vectors that are null,
empty, zero, or hold null or non-finite components link with nothing, nor do rows with a null id, which are alone.
Repeated rows (same id and vector) count as other vectors of their class; equal hashes are ordered by a hash of the vector, so reruns agree.
Each vector's component is the smallest id reachable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

THRESHOLD = 0.9
BITS = 40
#: classes that each class is compared with in a pass of the first round
WINDOW = 48
#: windows of the next round
WIDER = 4
#: share of the links that are found: what passes are reckoned for, and what the probes must measure
RECALL = 0.99
#: classes of a length that are compared with all others, on average
PROBES = 1024
#: classes of a block when links are counted, at least
COUNT_BLOCK = 256
#: blocks that smaller sets are cut into, so that all tasks have work
BLOCKS = 12
#: components of all vectors of a block, at most
BLOCK_VALUES = 1 << 22
#: rows and columns that are compared at once
TILE = (512, 4096)


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that neither huge nor tiny components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors as doubles) for each length in a list column without nulls."""
    lengths = column.value_lengths().to_numpy()
    ends = np.concatenate([[0], np.cumsum(lengths)])
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for w in np.unique(lengths):
        rows = np.flatnonzero(lengths == w)
        yield int(w), rows, values[ends[rows][:, None] + np.arange(w)]


def planes(width: int, passes: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((passes, width, bits))


def sign_keys(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(rows, passes) sort keys: the signs as bits, the first projection highest."""
    weight = (1 << np.arange(p.shape[2] - 1, -1, -1)).astype(np.int64)
    return np.stack([((x @ q) > 0) @ weight for q in p], axis=1)


def passes_for(n: int, window: int, threshold: float, recall: float = RECALL) -> int:
    """Passes in which two vectors at the threshold meet in a window with the probability ``recall``."""
    if window >= n - 1:  # holds all
        return 1
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    meet = agree ** math.log2(max(2.0, n / window))
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet))) if meet < 1 else 1


def window_links(x: np.ndarray, rank: np.ndarray, new: int, window: int, threshold: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j whose ranks differ by ``window`` at most, with a cosine of at least the threshold.

    Rows of x have length 1 and are ordered by rank; ``new`` rows of one block come before those of another, and i is of the first, j of the second.
    With 0, all are of one block.
    """
    margin = (x.shape[1] + 8) * 2.0**-23  # first in single precision, with room for its error
    rough = x.astype(np.float32)
    for at in range(new, len(x), block):
        top = new or min(at + block, len(x))
        for to in range(int(np.searchsorted(rank, rank[at] - window)), top, TILE[1]):
            product = rough[at : at + block] @ rough[to : min(to + TILE[1], top)].T
            j, i = np.nonzero(product >= np.float32(threshold - margin))
            if not len(i):
                continue
            close = product[j, i] <= np.float32(threshold + margin)
            i, j = i + to, j + at
            ok = (i < j) & (rank[j] - rank[i] <= window)
            close = np.flatnonzero(ok & close)
            for k in range(0, len(close), 1 << 14):
                c = close[k : k + (1 << 14)]
                ok[c] = (x[i[c]] * x[j[c]]).sum(axis=1) >= threshold
            yield i[ok], j[ok]


def block_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with a cosine of at least the threshold; of a block with itself (``same``) those with i < j."""
    margin = (x.shape[1] + 8) * 2.0**-23  # twice the error of a product in single precision
    rough_x = units(x.astype(np.float64)).astype(np.float32)
    rough_y = rough_x if same else units(y.astype(np.float64)).astype(np.float32)
    for at in range(0, len(x), TILE[0]):
        for to in range(at if same else 0, len(y), TILE[1]):
            product = rough_x[at : at + TILE[0]] @ rough_y[to : to + TILE[1]].T
            i, j = np.nonzero(product >= np.float32(threshold - margin))
            if not len(i):
                continue
            ok = np.ones(len(i), bool)
            close = np.flatnonzero(product[i, j] <= np.float32(threshold + margin))
            i, j = i + at, j + to
            for k in range(0, len(close), 1 << 14):
                c = close[k : k + (1 << 14)]
                ok[c] = (units(x[i[c]].astype(np.float64)) * units(y[j[c]].astype(np.float64))).sum(axis=1) >= threshold
            if same:
                ok &= i < j
            yield i[ok], j[ok]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j; ``root`` has every node's root before and after."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def block_rows() -> Column:
    """Rows of a block of a set of ``n`` vectors of the length ``w``."""
    return F.least(F.greatest(F.lit(COUNT_BLOCK), F.ceil(F.col("n") / F.lit(float(BLOCKS)))), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.col("w")))).cast("long")


def pass_forest(classes: DataFrame, passes: int, window: int, threshold: float, round_: int, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """(a, b): spanning links of all windows.  ``classes``: node, tie, vector.

    The order of a pass is cut into blocks; a class meets those of its own block and of each that its window
    reaches, one group for each pair of blocks, so that wide windows need no larger tasks and none ends at a partition's edge.
    """

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = np.zeros((batch.num_rows, passes), np.int64)
            for w, rows, x in by_length(batch.column(2)):
                if w not in made:
                    made[w] = planes(w, passes, bits, 17 + round_)
                keys[rows] = sign_keys(units(x), made[w])
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, passes, dtype=np.int32), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node", "tie", "vector", "keys"])

    kind = classes.schema["vector"].dataType.simpleString()
    hashed = scratch.cut(classes.select("node", "tie", "vector").mapInArrow(hash_all, f"node long, tie long, vector {kind}, keys array<long>"))
    laid = hashed.select(F.posexplode("keys").alias("pass", "bits"), F.size("vector").alias("w"), "node", "tie")
    order = ["pass", "w", "bits", "tie", "node"]
    ranged = laid.repartitionByRange(*order).sortWithinPartitions(*order)
    # the rank of a class in its pass: its place in the partition, and what lies in partitions before
    placed = scratch.cut(ranged.select("pass", "w", "node", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)))
    runs = scratch.cut(placed.groupBy("pass", "w", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows")))
    whole = Window.partitionBy("pass", "w").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.withColumns({"n": F.sum("rows").over(whole), "before": F.sum("rows").over(whole.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")})
    runs = runs.select("pass", "w", "part", "n", (F.col("before") - F.col("first")).alias("shift"), block_rows().alias("size"))
    ranked = placed.join(runs, ["pass", "w", "part"]).withColumn("rank", F.col("at") + F.col("shift"))
    # a class goes to its own block, and to each pair of it and a block that its window reaches
    reached = F.expr(f"sequence(greatest(0L, rank - {window}L) div size, least(n - 1, rank + {window}L) div size)")
    sent = ranked.select("pass", "w", "node", "rank", F.expr("rank div size").alias("block"), F.explode(reached).alias("other"))
    met = sent.select("pass", "w", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rank", "node")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        rank, block, ids = (table.column(c).to_numpy().astype(np.int64) for c in ("rank", "block", "node"))
        order = np.argsort(rank)
        (_, _, x), = by_length(table.column("vector").combine_chunks())
        x, rank, ids = units(x[order]), rank[order], ids[order]
        root = np.arange(len(ids))
        for i, j in window_links(x, rank, int((block == low).sum()) if low < high else 0, window, threshold):
            unite(root, i, j)
        other = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[root[other]], "b": ids[other]})

    grouped = met.join(hashed.select("node", "vector"), "node").groupBy("pass", "w", "low", "high")
    forest = scratch.cut(grouped.applyInArrow(compare, "a long, b long").distinct())
    scratch.drop(hashed, placed)
    return forest


def packed(rows: DataFrame, *more: str) -> DataFrame:
    """One row a (w, block): w, block, and as bytes vectors and the long columns node and ``more``."""
    names = ["node", *more]
    single = np.float32 if rows.schema["vector"].dataType.simpleString() == "array<float>" else np.float64

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        (_, _, x), = by_length(table.column("vector").combine_chunks())
        out = {"w": pa.array([key[0].as_py()], pa.int32()), "block": [key[1].as_py()], "xs": [x.astype(single).tobytes()]}
        return pa.table(out | {c: [table.column(c).to_numpy().astype(np.int64).tobytes()] for c in names})

    kinds = ", ".join(f"{c} binary" for c in ("xs", *names))
    return rows.select("w", "block", "vector", *names).groupBy("w", "block").applyInArrow(pack, f"w int, block long, {kinds}")


def unpacked(xs: bytes, n: int, width: int) -> np.ndarray:
    """``n`` packed vectors, as doubles."""
    return np.frombuffer(xs, np.float32 if len(xs) == 4 * n * width else np.float64).reshape(n, width).astype(np.float64)


def in_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add block and blocks.  ``rows``: w, tie; ``sizes``: w, n."""
    return rows.join(sizes.withColumn("blocks", F.ceil(F.col("n") / block_rows()).cast("long")).select("w", "blocks", "n"), "w").withColumn(
        "block", F.pmod(F.xxhash64("tie", F.lit(9)), F.col("blocks"))
    )


def probe(classes: DataFrame, label: DataFrame, sizes: DataFrame, threshold: float, scratch: Scratch, probes: int = PROBES) -> tuple[float, DataFrame]:
    """Share of the links of a sample that ``label`` has joined (1 without any), and (a, b): links that it hasn't.

    A mean over the probes that have a link, each link counted.  Components of ``label``: node, component.
    """
    known = scratch.cut(classes.join(label, "node", "left").select("w", "tie", "node", "vector", F.coalesce("component", "node").alias("comp")))
    dealt = in_blocks(known, sizes)
    data = scratch.cut(packed(dealt, "comp"))
    chosen = dealt.filter(F.shiftrightunsigned(F.xxhash64("tie", F.lit(31)), 11) / F.lit(float(1 << 53)) < F.lit(float(probes)) / F.col("n")).withColumn("block", F.lit(0).cast("long"))
    asked = scratch.cut(packed(chosen, "comp"))
    sent = asked.select("w", F.lit(0).cast("long").alias("tie"), *[F.col(c).alias(f"q_{c}") for c in ("xs", "node", "comp")])
    sent = in_blocks(sent, sizes).drop("block", "tie", "n")
    sent = sent.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                node, comp, q_node, q_comp = (np.frombuffer(r[c], np.int64) for c in ("node", "comp", "q_node", "q_comp"))
                x, q = unpacked(r["xs"], len(node), r["w"]), unpacked(r["q_xs"], len(q_node), r["w"])
                hits, missed = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
                pairs = np.empty((0, 2), np.int64)
                for i, j in block_links(q, x, False, threshold):
                    apart = q_node[i] != node[j]
                    i, j = i[apart], j[apart]
                    joined = q_comp[i] == comp[j]
                    hits += np.bincount(i[joined], minlength=len(q))
                    i, j = i[~joined], j[~joined]
                    missed += np.bincount(i, minlength=len(q))
                    pairs = np.unique(np.concatenate([pairs, np.stack([q_comp[i], comp[j]], axis=1)]), axis=0)
                told = np.flatnonzero(hits + missed)
                n, k = len(told), len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([q_node[told], pairs[:, 0]])),
                        pa.array(pairs[:, 1].tolist() if not n else [None] * n + pairs[:, 1].tolist(), pa.int64()),
                        pa.array(np.concatenate([hits[told], np.zeros(k, np.int64)])),
                        pa.array(np.concatenate([missed[told], np.zeros(k, np.int64)])),
                    ],
                    names=["a", "b", "hits", "missed"],
                )

    met = sent.join(data, ["w", "block"]).select("w", "xs", "node", "comp", "q_xs", "q_node", "q_comp")
    found = scratch.cut(met.mapInArrow(run, "a long, b long, hits long, missed long"))
    each = found.filter("b is null").groupBy("a").agg((F.sum("hits") / F.sum(F.col("hits") + F.col("missed"))).alias("share"))
    share = each.agg(F.avg("share")).first()[0]
    scratch.drop(known, data, asked)
    return 1.0 if share is None else share, found.filter("b is not null").select("a", "b").distinct()


def count_links(members: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, others): vectors linked directly to each class, beside its own copies.

    ``members``: node, tie, w, vector, m (vectors of the class), component.  Components are cut into
    blocks by hash; each pair of blocks of a component is one group of bounded size.
    """
    sizes = scratch.cut(members.groupBy("component").agg(F.count("*").alias("n"), F.max("w").alias("w")))
    sized = scratch.cut(
        members.drop("w").join(sizes, "component").withColumn("k", F.ceil(F.col("n") / block_rows()).cast("int")).withColumn("mine", F.pmod(F.xxhash64("tie", F.lit(9)), F.col("k")).cast("int"))
    )
    # a block meets every block of its component, itself too: pairs (low, high); each class is in k of them
    pairs = sized.withColumn("other", F.explode(F.expr("sequence(0, k - 1)"))).select(
        "component", "k", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "m", "vector"
    )
    # small components share groups, so that there are not as many groups as components
    group = F.when(F.col("k") > 1, F.xxhash64("component", "low", "high")).otherwise(F.pmod(F.xxhash64("component"), F.lit(max(1, sizes.count() // 64 + 1))))

    def run(table: pa.Table) -> pa.Table:
        comp, low, high, mine, ids, m = (table.column(c).to_numpy() for c in ("component", "low", "high", "mine", "node", "m"))
        vectors = table.column("vector").combine_chunks()
        order = np.lexsort((high, low, comp))
        cut = np.flatnonzero((np.diff(comp[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        out = np.zeros(len(ids), np.int64)
        for rows in np.split(order, cut) if len(ids) else ():
            same = low[rows[0]] == high[rows[0]]
            left, right = rows[mine[rows] == low[rows[0]]], rows[mine[rows] == high[rows[0]]]
            if not len(left) or not len(right):  # a block may be empty
                continue
            x, y = (next(by_length(vectors.take(pa.array(part))))[2] for part in (left, right))
            for i, j in block_links(x, y, same, threshold):
                u, v = left[i], right[j]
                out += np.bincount(u, weights=m[v], minlength=len(ids)).astype(np.int64)
                out += np.bincount(v, weights=m[u], minlength=len(ids)).astype(np.int64)
        return pa.table({"node": ids, "others": out})

    grouped = pairs.withColumn("g", group).groupBy("g").applyInArrow(run, "node long, others long")
    return grouped.groupBy("node").agg(F.sum("others").alias("others"))


def same_type(df: DataFrame, vector_col: str) -> Column:
    """The vectors: single precision stays, all other numbers are doubles."""
    kind = df.schema[vector_col].dataType.simpleString()
    return F.col(f"`{vector_col}`") if kind == "array<float>" else F.col(f"`{vector_col}`").cast("array<double>")


def link_components(classes: DataFrame, n: int, sizes: DataFrame, threshold: float, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(node, component) of classes with a link, by rounds of passes until the probes find ``RECALL`` of their links, or windows hold all pairs."""
    links, beside, round_ = None, None, 0
    while True:
        found = pass_forest(classes, passes_for(n, window, threshold), window, threshold, round_, scratch)
        links = found if links is None else links.unionByName(found)
        label = components(links, scratch)
        if window >= n - 1:
            return label
        # the label is that of the passes alone: with what probes found, the same probes would measure themselves
        recall, more = probe(classes, label, sizes, threshold, scratch)
        beside = more if beside is None else beside.unionByName(more)
        if recall >= RECALL:
            return label if beside.isEmpty() else components(links.unionByName(beside), scratch)
        window, round_ = window * WIDER, round_ + 1


def near_duplicates(
    df: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, n_links, component) of every row."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), same_type(df, vector_col).alias("vector"))
    takes_part = F.coalesce(usable(F.col("vector")) & F.col("id").isNotNull(), F.lit(False))
    alone = rows.filter(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    kind = rows.schema["vector"].dataType.elementType
    same = F.sha2(F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)).cast("string"), 256)  # -0.0 is 0.0
    keyed = rows.filter(takes_part).withColumn("h", same)
    grouped = keyed.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("vector").alias("vector"))
    # numbers for the classes: written once, then only read
    classes = scratch.cut(grouped.withColumns({"node": F.monotonically_increasing_id(), "tie": F.xxhash64("h"), "w": F.size("vector")}))
    sizes = scratch.cut(classes.groupBy("w").agg(F.count("*").alias("n")))
    n = sizes.agg(F.max("n")).first()[0]
    if not n:
        return alone
    label = link_components(classes.select("node", "tie", "w", "vector"), n, sizes, threshold, scratch)
    members = scratch.cut(classes.join(label, "node").select("node", "tie", "w", "id", "vector", "m", "component"))
    least = scratch.cut(members.groupBy("component").agg(F.min("id").alias("least")))
    others = scratch.cut(count_links(members.drop("id"), threshold, scratch))
    placed = scratch.cut(members.select("node", "component").join(least, "component").select("node", "least"))
    told = scratch.cut(
        classes.select("h", "node", "id", "m")
        .join(placed, "node", "left")
        .join(others, "node", "left")
        .select("h", F.coalesce("least", "id").alias("component"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"))
    )
    return keyed.select("id", "h").join(told, "h").select("id", "n_links", "component").unionByName(alone)
