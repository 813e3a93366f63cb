from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import packing


def rows_of(n=300):
    import random

    rng = random.Random(1)
    return [(str(i), rng.choice("abcd") if i % 17 else None, rng.choice([None, *range(30)]), rng.choice([0, 1, 5, 30, 70, 99, 100, 101, 250])) for i in range(n)]


def check(rows, placed, capacity, per_source):
    used, clusters, sources, words = defaultdict(int), defaultdict(list), defaultdict(list), defaultdict(int)
    by_key = {k: (s, c) for k, s, c, _ in rows}
    spans = defaultdict(list)
    for r in placed:
        words[r.key] += r.n_words
        if r.bin_id is None:
            assert r.n_words == 0
            continue
        used[r.bin_id] += r.n_words
        s, c = by_key[r.key]
        clusters[r.bin_id].append(("own", r.key, r.occurrence) if c is None else c)
        sources[r.bin_id].append(s)
        spans[r.bin_id].append((r.bin_start, r.bin_start + r.n_words))
    assert max(used.values()) <= capacity
    assert all(len(x) == len(set(x)) for x in clusters.values())
    assert all(x.count(s) <= per_source for x in sources.values() for s in x)
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a[1] == b[0] for a, b in zip(x, x[1:], strict=False))
    return words, used


def test_every_word_is_placed_without_conflicts(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "key string, source string, cluster long, size long")
    placed = packing.pack(df, capacity=100, per_source=2, shard_bins=50).collect()
    words, _ = check(rows, placed, 100, 2)
    assert words == {k: n for k, _, _, n in rows}


def test_shard_equals_brute_best_fit():
    import pandas as pd

    rows = rows_of(120)
    frame = pd.DataFrame([(k, s, None if c is None else str(c), n, 1, 1) for k, s, c, n in rows], columns=["key", "source", "cluster", "size", "first", "rows_alike"]).astype(object)
    got = packing.pack_shard(frame, 100, 2, 0)
    bins = []  # [left, clusters, sources]
    pieces = sorted((-(min(100, n - 100 * p)), k, p) for k, s, c, n in rows for p in range(max(1, -(-n // 100))))
    look = {k: (s, c) for k, s, c, _ in rows}
    want = {}
    for neg, k, p in pieces:
        size = -neg
        if not size:
            continue
        s, c = look[k]
        c = ("own", k) if c is None else c
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and c not in b[1] and b[2].count(s) < 2]
        if fits:
            i = min(fits)[1]
        else:
            bins.append([100, [], []])
            i = len(bins) - 1
        bins[i][0] -= size
        bins[i][1].append(c)
        bins[i][2].append(s)
        want[(k, p)] = i
    mine = {(r.key, r.piece): int(r.bin_id) for r in got.itertuples() if not pd.isna(r.bin_id)}
    assert mine == want


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([("same", "a", 1, 10)] * 200, "key string, source string, cluster long, size long")
    placed = packing.pack(df, capacity=100, per_source=4).collect()
    assert len(placed) == 200 and len({r.bin_id for r in placed}) == 200 and {r.occurrence for r in placed} == set(range(1, 201))
    assert packing.pack(df.limit(0)).collect() == []


def test_clusters_ignore_case_and_space(spark):
    df = spark.createDataFrame([("A  b",), ("a b ",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(packing.cluster_of(F.col("t"))).collect()]
    assert got[0] == got[1] is not None and got[2] is None and got[3] is None


def test_copies_with_other_white_space_at_the_ends_never_share_a_bin(spark):
    ends = [("", ""), ("", "\n"), ("\t", ""), ("\r\n ", " \n"), (" ", "\x0b"), ("\n\n", "\f")]
    df = spark.createDataFrame([(str(i), f"{a}One  text\nof it{b}") for i, (a, b) in enumerate(ends)], "key string, t string")
    rows = df.select("key", F.lit("s").alias("source"), packing.cluster_of(F.col("t")).alias("cluster"), F.lit(4).cast("long").alias("size"))
    assert rows.select("cluster").distinct().count() == 1
    assert len({r.bin_id for r in packing.pack(rows, capacity=100, per_source=len(ends)).collect()}) == len(ends)
