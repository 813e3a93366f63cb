"""Near-duplicate texts by Order MinHash and banded alignment.

*Sketch.*  A text is its words (lower case, white space between), its k-mers the
runs of ``K`` words (a shorter text is one run), each labelled with its number
of earlier occurrences, so that all labelled k-mers of a text differ.  Each of
``SKETCHES`` hash functions takes the ``MINIMA`` smallest labelled k-mers and keeps
them in text order; the hash of that sequence is one sketch.  Two texts agree in a
sketch if they share these k-mers *and* their order, which follows edit similarity
more closely than a set of k-mers does.

*Candidates.*  Texts that are equal are one class, by hash, before anything is compared.
Classes that agree in a sketch are a bucket.  Every member is compared with the
bucket's most central class (whose buckets are largest); this joins large groups of copies with one comparison a member.
Buckets may still hold classes of different components: families of looser copies, or
texts that share a passage.  Their pairs are not all compared, as there can be as many as
the square of a bucket.  An exact *prefix filter* first sorts their members into families: with
the k-mers of the members in order of their frequency, rarest first, two texts over the
threshold share one of their first ``n - ceil(THRESHOLD * n) + 1``; what only a passage has in
common is sorted last.  No pair over the threshold is lost.  Inside a family, blocks of bounded
size are compared by counting common k-mers through an index; only links leave a task.

*Verification.*  Pairs whose lengths alone rule out the threshold are dropped.  For the
others the labelled k-mers of both texts are aligned: the longest chain of equal
k-mers in the same order, within the band of diagonals that an alignment over the
threshold can reach (so the band loses nothing).  As labelled k-mers are distinct, the longest
chain is a longest increasing subsequence.  ``chain / (n1 + n2 - chain)`` of at least ``THRESHOLD``
is a link.

Defined results: null and empty texts (no word) are alone and kept; the class of a
text is the smallest id in its component, null ids last; repeated rows are in the
class of their text, and of several rows with the class's id and text one is kept
by :func:`deduplicate`, always the same; other columns are kept, whatever their names.  Ties between
leaders of a bucket go to the smaller node; a long text is hashed whole, alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .flat import mix64, shingle_hashes, slices, word_hashes

K = 5
THRESHOLD = 0.8
SKETCHES = 12
MINIMA = 3
#: labelled k-mers of a block of a family
FAMILY_BLOCK = 50_000

_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)


def label_occurrences(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their number of earlier occurrences in the same text."""
    n = len(h)
    if not n:
        return h
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    with np.errstate(over="ignore"):
        key = mix64(h + doc.astype(_U) * _U(0xA0761D6478BD642F))  # equal k-mers of one text have one key
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    if not same.any():
        return h
    start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    nth = np.empty(n, np.int64)
    nth[order] = np.arange(n) - start
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix64(h + nth.astype(_U) * _U(0xE7037ED1A0B428DB)), h)


def sketch(h: np.ndarray, at: np.ndarray, sketches: int, minima: int) -> np.ndarray:
    """(texts, sketches) order-sensitive sketches; texts without k-mers have 0."""
    lens = np.diff(at)
    some = np.flatnonzero(lens > 0)
    out = np.zeros((len(lens), sketches), _U)
    if not len(some):
        return out
    starts, sizes = at[:-1][some], lens[some]
    doc = np.repeat(np.arange(len(some)), sizes)
    for f in range(sketches):
        with np.errstate(over="ignore"):
            v = (h ^ _U(0x9E3779B97F4A7C15 * (2 * f + 1) & 0xFFFFFFFFFFFFFFFF)) * _U(0xD6E8FEB86659FD93)
            v ^= v >> _U(32)
            v *= _U(0xD6E8FEB86659FD93)
        found = np.full((len(some), minima), len(h), np.int64)
        for j in range(minima):
            least = np.minimum.reduceat(v, starts)
            hit = np.flatnonzero(v == least[doc])
            d = doc[hit]
            first = np.concatenate([[True], d[1:] != d[:-1]])
            hit, d = hit[first], d[first]
            more = sizes[d] > j  # short texts have fewer k-mers
            found[d[more], j] = hit[more]
            v[hit] = _TOP
        found.sort(axis=1)  # back in text order
        total = np.zeros(len(some), _U)
        with np.errstate(over="ignore"):
            for j in range(minima):
                got = found[:, j] < len(h)
                w = h[np.minimum(found[:, j], len(h) - 1)]
                total = np.where(got, mix64(total * _U(0x9FB21C651E98DF25) + w), total)
        out[some, f] = mix64(total + _U(f))
    return out


def longest_chain(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest chain of equal labels in the same order, |i - j| <= band; labels are distinct in a and in b."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i, kind="stable")]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Ordered similarity of two label sequences (0 if the threshold is out of reach)."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    if n == m and (a == b).all():
        return 1.0
    # a similarity of t needs a chain of c >= t (n + m) / (1 + t); the rest bounds the shift
    need = threshold * (n + m) / (1 + threshold)
    band = int(n + m - 2 * need) + 1
    c = longest_chain(a, b, band)
    return c / (n + m - c)


def labels_of(text: str) -> np.ndarray:
    """Labelled k-mers of one text, in order (for tests and small uses)."""
    for _, _, data, offsets in slices(pa.array([text.lower()], pa.string())):
        w, at = word_hashes(data, offsets)
        return label_occurrences(*shingle_hashes(w, at, K))
    return np.empty(0, _U)


def _sketches(text: Column, sketches: int, minima: int) -> Column:
    @F.arrow_udf("n long, sketches array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            ns, rows = np.zeros(len(column), np.int64), np.zeros((len(column), sketches), _U)
            for a, b, data, offsets in slices(column):
                w, at = word_hashes(data, offsets)
                h, to = shingle_hashes(w, at, K)
                rows[a:b] = sketch(label_occurrences(h, to), to, sketches, minima)
                ns[a:b] = np.diff(to)
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, sketches, dtype=np.int32), pa.array(rows.reshape(-1).view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(ns), lists], names=["n", "sketches"])

    return run(text)


def _labels(text: Column) -> Column:
    """The labelled k-mers of a text, in order."""

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            values, ends = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
            for _, _, data, offsets in slices(column):
                w, at = word_hashes(data, offsets)
                h, to = shingle_hashes(w, at, K)
                values.append(label_occurrences(h, to).view(np.int64))
                ends.append(to[1:] + ends[-1][-1])
            yield pa.ListArray.from_arrays(np.concatenate(ends).astype(np.int32), pa.array(np.concatenate(values)))

    return run(text)


def _similar(a: Column, b: Column, threshold: float) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([similarity(x, y, threshold) for x, y in zip(left, right, strict=True)], dtype="float64")

    return run(a, b)


def text_key(text: Column) -> Column:
    """What equal texts share: 16 bytes."""
    return F.unhex(F.md5(F.lower(F.coalesce(text, F.lit("")))))


def _verify(pairs: DataFrame, labels: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) over the threshold.  ``labels``: node, v."""
    short = F.transform("v", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))  # 31 bits are enough within a pair
    held = labels.select("node", short.alias("v"))
    one = pairs.join(held.select(F.col("node").alias("a"), F.col("v").alias("va")), "a")
    two = one.join(held.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
    good = two.select("a", "b", _similar(F.col("va"), F.col("vb"), threshold).alias("s")).filter(F.col("s") >= threshold)
    out = scratch.cut(good.select("a", "b"))
    scratch.release()
    return out


def _families(open_: DataFrame, labels: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, family): classes that an exact prefix filter can't tell apart.

    ``open_``: node, component.  Two classes over the threshold are in one family.
    """
    grams = labels.join(open_, "node").select("node", "component", F.size("v").alias("n"), F.explode("v").alias("gram"))
    grams = scratch.cut(grams)
    # only k-mers that occur in several components can find a pair; the others come first in the order
    spread = grams.groupBy("gram").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("gram", "df")
    shared = scratch.cut(grams.join(scratch.cut(spread), "gram"))
    scratch.drop(grams)
    scratch.release()
    mine = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "gram")) - 1
    prefix = scratch.cut(shared.withColumn("at", place).filter(F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n"))).select("gram", "node", "component"))
    scratch.drop(shared)
    scratch.release()
    heads = prefix.groupBy("gram").agg(F.min("node").alias("a"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("gram", "a")
    out = components(prefix.join(scratch.cut(heads), "gram").select("a", F.col("node").alias("b")).filter("a <> b"), scratch)
    scratch.drop(prefix)
    return out.select("node", F.col("component").alias("family"))


def compare_blocks(left: list[np.ndarray], right: list[np.ndarray], ids: tuple[np.ndarray, np.ndarray], comps: tuple[np.ndarray, np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between two blocks of label sequences that join what is not joined yet.

    Common labels are counted through an index of the right block; only pairs whose count
    allows the threshold, and that no link connects so far, are aligned.
    """
    out: list[tuple[int, int]] = []
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sizes_l, sizes_r = np.array([len(v) for v in left]), np.array([len(v) for v in right])
    gram = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), sizes_r)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    step = max(1, (1 << 21) // max(1, len(right)))
    at = 0
    while at < len(left):
        stop = min(len(left), at + step)
        flat = np.concatenate(left[at:stop])
        lo, hi = np.searchsorted(gram, flat, "left"), np.searchsorted(gram, flat, "right")
        n = hi - lo
        if stop > at + 1 and n.sum() > 1 << 22:  # fewer at once, so that memory is bounded
            step = max(1, (stop - at) // 2)
            continue
        who = np.repeat(np.repeat(np.arange(stop - at), sizes_l[at:stop]), n)
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(who * len(right) + owner[where], minlength=(stop - at) * len(right)).reshape(stop - at, len(right))
        need = threshold / (1 + threshold) * (sizes_l[at:stop, None] + sizes_r[None, :]) - 1e-9
        i, j = np.nonzero((common >= need) & (comps[0][at:stop, None] != comps[1][None, :]) & (ids[0][at:stop, None] != ids[1][None, :]))
        for x, y in zip((i + at).tolist(), j.tolist(), strict=True):
            a, b = find(int(comps[0][x])), find(int(comps[1][y]))
            if a != b and similarity(left[x], right[y], threshold) >= threshold:
                up[max(a, b)] = min(a, b)
                out.append((int(ids[0][x]), int(ids[1][y])))
        at = stop
    return out


def _family_links(families: DataFrame, labels: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) inside families, by blocks of bounded size; no pair that is not a link leaves a task.

    ``families``: node, component, family.
    """
    sized = scratch.cut(labels.join(families, "node").select("node", "component", "family", F.size("v").alias("n"), "v"))
    total = scratch.cut(sized.groupBy("family").agg(F.sum("n").alias("grams")))
    k = F.ceil(F.col("grams") / F.lit(float(FAMILY_BLOCK))).cast("int")
    dealt = sized.join(total.withColumn("k", k).select("family", "k"), "family").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(9)), F.col("k")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0, k - 1)"))).select(
        "family", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "component", "v", "k"
    )
    small = total.filter(F.col("grams") <= FAMILY_BLOCK).agg(F.sum("grams")).first()[0] or 0
    group = F.when(F.col("k") > 1, F.xxhash64("family", "low", "high")).otherwise(F.pmod(F.xxhash64("family"), F.lit(max(1, 16 * small // FAMILY_BLOCK))))

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        fam, low, high, mine, node, comp = (table.column(c).to_numpy() for c in ("family", "low", "high", "mine", "node", "component"))
        v = table.column("v").combine_chunks()
        values, ends = v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
        row = lambda k: values[ends[k] : ends[k + 1]]
        order = np.lexsort((high, low, fam))
        cut = np.flatnonzero((np.diff(fam[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        for rows in np.split(order, cut):
            if len(rows) < 2:
                continue
            a, b = rows[mine[rows] == low[rows[0]]], rows[mine[rows] == high[rows[0]]]
            if len(a) and len(b):
                out += compare_blocks([row(x) for x in a], [row(x) for x in b], (node[a], node[b]), (comp[a], comp[b]), threshold)
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    links = scratch.cut(met.withColumn("g", group).groupBy("g").applyInArrow(run, "a long, b long"))
    scratch.drop(sized)
    scratch.release()
    return links


def classes(
    df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sketches: int = SKETCHES, minima: int = MINIMA
) -> DataFrame:
    """(id, key, class_id, stands, rows): one row for each id and text.

    ``class_id`` is the smallest id of the near-duplicates; ``stands`` tells whether this
    id and text stands for its class; ``rows`` counts the rows alike.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    sketched = scratch.cut(docs.select("id", "key", _sketches(F.lower("text"), sketches, minima).alias("s")).select("id", "key", "s.n", "s.sketches"))
    # equal texts are one node; the numbers are written once and then only read
    least = F.min_by("id", F.struct(F.col("id").isNull(), F.col("id"))).alias("id")
    nodes = sketched.filter("n > 0").groupBy("key").agg(least, F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    nodes = scratch.cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    laid = nodes.select("node", "n", F.posexplode("sketches").alias("band", "sketch"))
    sizes = laid.groupBy("band", "sketch").agg(F.count("*").alias("g")).filter("g > 1")
    members = scratch.cut(laid.join(scratch.cut(sizes), ["band", "sketch"]))
    # the leader of a bucket is its most central class: the one whose buckets are largest
    central = scratch.cut(members.groupBy("node", "n").agg(F.sum(F.log("g")).alias("weight")))
    weighed = members.join(central.select("node", "weight"), "node")
    lead = F.max_by(F.struct("node", "n"), F.struct("weight", -F.col("node"))).alias("lead")
    leads = scratch.cut(weighed.groupBy("band", "sketch").agg(lead).select("band", "sketch", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")))
    close = F.least("n", "lead_n") >= F.lit(threshold) * F.greatest("n", "lead_n")
    first = members.join(leads, ["band", "sketch"]).filter(F.col("node") != F.col("lead")).filter(close)
    first = scratch.cut(first.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct())

    # the texts of all members, one a node: of the rows with the node's id and key
    needed = scratch.cut(central.select("node").join(nodes.select("node", "key", F.col("id").alias("own")), "node"))
    # shuffled at every size: which texts are needed grows with the input
    held = docs.join(needed.hint("merge"), "key").filter(F.col("id").eqNullSafe(F.col("own")))
    labels = scratch.cut(held.groupBy("node").agg(F.first("text").alias("text")).select("node", _labels(F.lower("text")).alias("v")))
    scratch.release()
    links = _verify(first, labels, threshold, scratch)
    label = components(links, scratch)

    # what is left: buckets whose members are in different components
    placed = scratch.cut(members.select("band", "sketch", "node").join(label, "node", "left").select("band", "sketch", "node", F.coalesce("component", "node").alias("component")))
    several = placed.groupBy("band", "sketch").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band", "sketch")
    waiting = scratch.cut(placed.join(scratch.cut(several), ["band", "sketch"]).select("node", "component").distinct())
    if not waiting.isEmpty():
        families = _families(waiting, labels, threshold, scratch)
        # the pairs of the star are known; all others of a family are compared in blocks
        more = _family_links(families.join(waiting, "node"), labels, threshold, scratch)
        if not more.isEmpty():
            label = components(links.unionByName(more), scratch)
    scratch.drop(labels)
    scratch.release()

    # the smallest id of a component
    in_one = scratch.cut(label.join(nodes.select("node", "id", "key"), "node"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    heads = scratch.cut(in_one.groupBy("component").agg(best.alias("h")).select("component", F.col("h.id").alias("class_id"), F.col("h.key").alias("head")))
    by_key = in_one.join(heads, "component").select("key", "class_id", "head")
    single = nodes.join(label, "node", "left_anti").select("key", F.col("id").alias("class_id"), F.col("key").alias("head"))
    told = scratch.cut(by_key.unionByName(single))
    rows = sketched.groupBy("id", "key").agg(F.count("*").alias("rows"), F.first("n").alias("n"))
    out = rows.join(told, "key", "left")
    alone = F.col("n") == 0
    return out.select(
        "id",
        "key",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(alone | ((F.col("key") == F.col("head")) & F.col("id").eqNullSafe(F.col("class_id"))), F.lit(False)).alias("stands"),
        "rows",
        alone.alias("empty"),
    )


def deduplicate(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that stand for their class, one a class; texts without a word all stay.

    Of several rows with the id and text that stand, the one with the least digest of all columns is kept.
    """
    found = classes(df, scratch, id_col, text_col, **how).filter("stands")
    keep = scratch.cut(found.select("id", "key", ((F.col("rows") > 1) & ~F.col("empty")).alias("many")))
    # by place, so that columns of one name don't matter
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row")
    keyed = df.select(F.col(f"`{id_col}`").cast("long").alias("i"), text_key(F.col(f"`{text_col}`")).alias("k"), row)
    rows = keyed.join(keep, (F.col("k") == F.col("key")) & F.col("i").eqNullSafe(F.col("id"))).select("key", "many", "row")
    out = rows.filter("not many").select("row")
    if not keep.filter("many").isEmpty():
        digest = F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256)
        out = out.unionByName(rows.filter("many").groupBy("key").agg(F.min_by("row", digest).alias("row")).select("row"))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])
