from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.common import Scratch


def brute_targets(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Resharing by weight until no target is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] >= cap * sizes[s]]
        if not over:
            return target | part
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "key string, source string, size long")
    return mixing.per_row(mixing.mix(df, Scratch(spark, "t"), **how)).collect()


def sample(n=600):
    import random

    rng = random.Random(4)
    return [(str(i), rng.choice(["a", "a", "a", "b", "é", "Z", None]), rng.choice([0, 1, 3, 10, 40, 41, 200])) for i in range(n)]


def test_targets_copies_and_mass(spark):
    rows = sample()
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want = brute_targets(sizes)
    got = run(spark, rows)
    assert sorted(r.key for r in got) == sorted(k for k, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9) and r.source_size == sizes[r.source]
        rate = r.target / r.source_size
        assert r.copies in ((int(rate), int(rate) + 1) if r.size else (0,)) and r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s, t in taken.items():
        assert abs(t - want[s]) <= 200  # less than one document
    again = run(spark, rows)
    assert sorted((r.key, r.copies) for r in again) == sorted((r.key, r.copies) for r in got)


def test_repeated_rows_are_one_unit(spark):
    rows = [("same", "a", 10)] * 500 + [(str(i), "b", 10) for i in range(500)]
    got = run(spark, rows)
    assert len(got) == 1000
    assert abs(sum(r.copies * 10 for r in got if r.source == "a") - got[0].target if got[0].source == "a" else 0) <= 10
    assert max(r.copies for r in got) <= 2


def test_marginals_are_kept(spark):
    """Over many keys alike in all but their hash, each size is taken as often as the rate says."""
    sizes = [5, 20, 7, 60, 1]
    rows = [(f"{i}", "a", s) for i in range(400) for s in sizes[i % 5 : i % 5 + 1]]
    total, rate = defaultdict(list), None
    for seed in (1, 2, 3):
        for r in run(spark, rows, seed=seed, share=0.7):
            total[r.size].append(r.copies)
            rate = r.target / r.source_size
    assert rate == pytest.approx(0.7)
    for x in total.values():
        assert abs(sum(x) / len(x) - rate) < 0.12  # 240 draws: four standard deviations


def test_empty_tables_and_words(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(None,), ("",), ("  \t\n",), ("a b c\x0bd",), ("x" * 50_000,)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [0, 0, 0, 3, 1]


def test_each_source_is_near_its_target(spark):
    """Large rows are made up for by small ones."""
    import random

    rng = random.Random(9)
    rows = [(f"{s}{i}", s, 3000 if i < 5 else rng.randrange(1, 120)) for s in "abcdefgh" for i in range(400)]
    got = run(spark, rows)
    taken, goal, size = defaultdict(int), {}, {}
    for r in got:
        taken[r.source] += r.copies * r.size
        goal[r.source], size[r.source] = r.target, r.source_size
    for s in goal:
        assert abs(taken[s] - goal[s]) <= mixing.LARGE * size[s] + 1e-6


def test_registered_query_is_near_its_targets(spark):
    from millrace.llm.queries import op1_mixing

    taken, goal, size = defaultdict(int), {}, {}
    for r in op1_mixing(spark, "/root/testdata/sf0.01").collect():
        taken[r.source] += r.taken
        goal[r.source], size[r.source] = r.target, r.source_size
        assert r.taken <= 2 * r.size
    assert max(abs(taken[s] - goal[s]) / goal[s] for s in goal) <= 0.01


def test_large_rows_keep_their_rate(spark):
    """A large row is taken as often as its probability says, over many keys."""
    rows = [(f"{i} {j}", f"s{i}", 50 if j else 900) for i in range(300) for j in range(40)]
    got = run(spark, rows, share=0.6, weights=(1.0,), cap=2.0)
    big = [r for r in got if r.size == 900]
    assert abs(sum(r.copies for r in big) / len(big) - 0.6) < 0.12


def test_mixed_rows_repeat_whole_rows(spark):
    df = spark.createDataFrame([(i % 50, "w " * (i % 50 + 1), "ab"[i % 2], 1, 2) for i in range(100)], "key long, text string, source string, __key int, row int")
    out = mixing.mixed_rows(df, Scratch(spark, "t"), share=1.0)
    assert out.columns == df.columns
    rows = out.collect()
    words = sum(len(r.text.split()) for r in rows)
    assert abs(words - sum((i % 50 + 1) for i in range(100))) <= 100
    assert set(rows) <= set(df.collect())


def test_mixed_rows_with_nulls_in_other_places(spark):
    """Rows that hold the same values in other columns are different rows."""
    rows = [("x", None, "one two"), (None, "x", "one two"), (None, None, "one two"), ("x", "x", "one two")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    out = [tuple(r) for r in mixing.mixed_rows(df, Scratch(spark, "t"), share=1.0, cap=1.0).collect()]
    assert sorted(out, key=str) == sorted(rows, key=str)


def test_mixed_rows_never_exceed_the_cap(spark):
    rows = [(None if i % 3 else "x", None if i % 5 else "x", "w " * (i % 7), {"k": i % 2}) for i in range(200)]
    df = spark.createDataFrame(rows, "lang string, source string, text string, attrs map<string,int>")
    count = lambda d: {tuple(map(str, r[:-1])): r[-1] for r in d.select("lang", "source", "text", F.col("attrs")["k"].alias("k")).groupBy("lang", "source", "text", "k").count().collect()}
    before, after = count(df), count(mixing.mixed_rows(df, Scratch(spark, "t")))
    assert after and all(n <= 2 * before[k] for k, n in after.items())
    assert mixing.mixed_rows(df.limit(0), Scratch(spark, "t")).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(sample(50), "key string, source string, size long")
    plan = mixing.mix(df, Scratch(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
