"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents are dealt by hash into shards of bounded size; each shard is packed on its
own by best fit in order of falling size.  Open bins are kept in order of their
*residual*; the search starts at the smallest residual that holds the piece and
walks on to the next larger one until a bin is found that the piece may enter.
A bin carries two bitmaps:

* duplicate clusters: no two pieces of a cluster share a bin, so a bin never shows
  one text twice;
* sources: ``per_source`` bit planes; plane j has the bit of a source that has
  more than j pieces in the bin, so no source has more than ``per_source`` there.

A document longer than a bin is cut into whole bins and a rest; every word is
placed.  Rows that are alike (id, source, cluster and size) are counted before they are dealt,
and dealt in blocks of at most ``BLOCK`` rows, so neither a hot key nor repeated rows make a
shard large.

Defined results: null and empty texts have size 0, take no room and come out with a
null bin; null source and null cluster are a source and (each) a cluster of their
own; ties go by id, then piece; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: words of a bin
CAPACITY = 2048
#: pieces of one source in a bin, at most
PER_SOURCE = 4
#: bins of a shard, on average
SHARD_BINS = 512
#: rows alike that stay together
BLOCK = 64

SCHEMA = "key string, occurrence long, piece int, n_pieces int, bin_id long, bin_start int, word_start long, n_words int"


class Bins:
    """Open bins in order of residual, with the successor search."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.clusters: list[int] = []
        self.planes: list[list[int]] = []

    def fits(self, b: int, cluster: int, source: int) -> bool:
        return not self.clusters[b] >> cluster & 1 and not self.planes[b][-1] >> source & 1

    def place(self, size: int, cluster: int, source: int) -> tuple[int, int]:
        """(bin, start in it) of a piece, by best fit."""
        at = bisect.bisect_left(self.order, (size, -1))
        while at < len(self.order) and not self.fits(self.order[at][1], cluster, source):
            at += 1  # the successor: the next tightest bin
        if at < len(self.order):
            left, b = self.order.pop(at)
        else:
            left, b = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.planes.append([0] * self.per_source)
        self.clusters[b] |= 1 << cluster
        for j in range(self.per_source):  # the first plane without the source's bit
            if not self.planes[b][j] >> source & 1:
                self.planes[b][j] |= 1 << source
                break
        if left > size:
            bisect.insort(self.order, (left - size, b))
        return b, self.capacity - left


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int, first_bin: int) -> pd.DataFrame:
    """All pieces of a shard: rows have key, source, cluster, size, first, rows_alike."""
    pieces = []
    for r in rows.itertuples(index=False):
        n = max(1, -(-r.size // capacity))
        for occurrence in range(r.first, r.first + r.rows_alike):
            for piece in range(n):
                pieces.append((min(capacity, r.size - piece * capacity), r.key, occurrence, piece, n, r.source, r.cluster))
    pieces.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or "", x[2], x[3]))
    bit: dict[str, dict] = {"source": {}, "cluster": {}}
    bins, out = Bins(capacity, per_source), []
    for size, key, occurrence, piece, n, source, cluster in pieces:
        if size <= 0:
            out.append((key, occurrence, piece, n, None, None, 0, 0))
            continue
        # a document without a cluster conflicts with itself only
        c = bit["cluster"].setdefault(("own", key, occurrence) if cluster is None else cluster, len(bit["cluster"]))
        s = bit["source"].setdefault(source, len(bit["source"]))
        b, start = bins.place(size, c, s)
        out.append((key, occurrence, piece, n, first_bin + b, start, piece * capacity, size))
    frame = pd.DataFrame(out, columns=["key", "occurrence", "piece", "n_pieces", "bin_id", "bin_start", "word_start", "n_words"])
    return frame.astype({"bin_id": "Int64", "bin_start": "Int32"})


def pack(rows: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_bins: int = SHARD_BINS) -> DataFrame:
    """Places of all pieces.  ``rows``: key (string), source (string), cluster (long), size (long).

    Rows that are alike get occurrences 1, 2, ...; bins are numbered by shard.
    """
    keys = ["key", "source", "cluster", "size"]
    units = rows.groupBy(*keys).agg(F.count("*").alias("m"))
    total = rows.agg(F.sum("size"), F.count("*")).first()
    # by words, and by rows where texts are short, so that a shard is bounded in both
    shards = max(1, -(-(total[0] or 0) // (capacity * shard_bins)), -(-total[1] // (8 * shard_bins)))
    dealt = units.withColumn("b", F.explode(F.expr(f"sequence(0L, (m - 1) div {BLOCK})"))).select(
        "key", "source", F.col("cluster").cast("string").alias("cluster"), "size",
        (F.col("b") * BLOCK + 1).alias("first"),
        F.least(F.lit(BLOCK), F.col("m") - F.col("b") * BLOCK).alias("rows_alike"),
        F.pmod(F.xxhash64(*keys, "b", F.lit(3)), F.lit(shards)).alias("shard"),
    )

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.astype({"key": object, "source": object, "cluster": object})
        group = group.where(group.notna(), None)
        return pack_shard(group, capacity, per_source, int(key[0]) << 24)

    return dealt.groupBy("shard").applyInPandas(run, SCHEMA)


def cluster_of(text) -> F.Column:
    """Duplicate cluster of a text: equal but for case and white space; null for none."""
    return F.when(F.length(text) > 0, F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))))


