import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann
from millrace.llm import embedding_dedup as E
from millrace.llm.common import Scratch
from millrace.llm.components import components

D = 16
KIND = "vec_id long, embedding array<float>, label int"


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal(D) for _ in range(150)]
    x += [x[0] * s for s in (1.0, 1.0, 3.0)]  # copies and a multiple
    x += [x[5] + 0.1 * rng.standard_normal(D) for _ in range(40)]  # a group of near copies
    chain = x[9]
    for _ in range(6):  # a chain whose ends are far apart
        chain = chain / np.linalg.norm(chain) + 0.42 * (lambda v: v / np.linalg.norm(v))(rng.standard_normal(D))
        x.append(chain)
    rows = [(i, [float(np.float32(v)) for v in w], 0) for i, w in enumerate(x)]
    odd = [None, [], [0.0] * D, [float("nan")] + [1.0] * (D - 1), [float("inf")] * D, [1.0] * (D - 1), [None] + [1.0] * (D - 1)]
    return rows + [(1000 + i, v, None) for i, v in enumerate(odd)]


def brute(rows, threshold=0.9, width=D):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if v and len(v) == width and None not in v and np.isfinite(v).all() and np.any(v)]
    ids = np.array([i for i, _ in ok])
    m = np.stack([v / np.linalg.norm(v) for _, v in ok])
    link = m @ m.T >= threshold
    np.fill_diagonal(link, False)
    comp = ids.copy()
    while True:
        new = np.array([min([comp[k], *comp[link[k]]]) for k in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    out = {i: (0, i) for i, _, _ in rows}
    return out | {int(i): (int(link[k].sum()), int(comp[k])) for k, i in enumerate(ids)}


def test_links_and_components_equal_brute_force(spark):
    rows = vectors()
    got = E.near_duplicates(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect()
    assert {r.id: (r.n_links, r.component) for r in got} == brute(rows) and len(got) == len(rows)


def test_counts_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "COUNT_BLOCK", 7)
    monkeypatch.setattr(E, "BLOCKS", 1000)
    rows = vectors(3)
    got = E.near_duplicates(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect()
    assert {r.id: (r.n_links, r.component) for r in got} == brute(rows)


def dense(n=3000, pairs=300, seed=11):
    """Pairs of cosine 0.91 among vectors of a mutual cosine near 0.8."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    hot = unit(0.8**0.5 * unit(rng.standard_normal(64)) + 0.2**0.5 * unit(rng.standard_normal((n, 64))))
    side = unit(rng.standard_normal((pairs, 64)))
    side = unit(side - (side * hot[:pairs]).sum(axis=1, keepdims=True) * hot[:pairs])
    return np.concatenate([hot, 0.91 * hot[:pairs] + (1 - 0.91**2) ** 0.5 * side]).astype(np.float32)


def recall_of(x, got):
    """Share of the linked pairs that share a component, and whether the counts of the found ones are right."""
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.9
    np.fill_diagonal(link, False)
    a, b = np.nonzero(link)
    comp = np.array([got[i].component for i in range(len(x))])
    same = comp[a] == comp[b]
    found = np.bincount(a[same], minlength=len(x))
    return same.mean(), len(a), all(got[i].n_links == found[i] for i in range(len(x)))


def test_pairs_in_a_dense_group_are_found(spark):
    x = dense()
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.id: r for r in E.near_duplicates(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect()}
    recall, n, counts = recall_of(x, got)
    print(f"recall {recall:.4f} of {n} links")
    assert n >= 600 and recall >= E.RECALL - 0.01 and counts


def test_a_larger_dense_group_has_the_same_recall(spark):
    """Where all pairs are far more than a round's windows hold, and most classes aren't probes."""
    x = dense(6000, 600)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.id: r for r in E.near_duplicates(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect()}
    recall, n, counts = recall_of(x, got)
    print(f"recall {recall:.4f} of {n} links")
    assert n >= 3000 and recall >= E.RECALL - 0.01 and counts


def test_probes_do_not_measure_what_they_found(spark, monkeypatch):
    """Links that probes found in a round are no links of passes in the next, but links of the result."""
    seen = []

    def stub(classes, label, sizes, threshold, scratch):
        seen.append({r.node for r in label.collect()})
        return (0.5 if len(seen) == 1 else 1.0), spark.createDataFrame([(0, 59)] if len(seen) == 1 else [], "a long, b long")

    monkeypatch.setattr(E, "probe", stub)
    x = np.concatenate([np.eye(60), np.eye(60)[7:8] + 0.01])
    df = spark.createDataFrame([(i, i, 60, v.tolist()) for i, v in enumerate(x)], "node long, tie long, w int, vector array<double>")
    sizes = spark.createDataFrame([(60, 61)], "w int, n long")
    got = {r.node: r.component for r in E.link_components(df, 61, sizes, 0.9, Scratch(spark, "t"), window=2).collect()}
    assert seen == [{7, 60}, {7, 60}] and got == {0: 0, 59: 0, 7: 7, 60: 7}


def test_recall_with_far_more_rows_than_a_window(spark):
    """4,000 planted pairs of cosine 0.9 to 0.95 among 20,000 vectors."""
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((16_000, 64)))
    side = unit(rng.standard_normal((4000, 64)))
    side = unit(side - (side * x[:4000]).sum(axis=1, keepdims=True) * x[:4000])
    cos = rng.uniform(0.901, 0.95, (4000, 1))
    x = np.concatenate([x, cos * x[:4000] + (1 - cos**2) ** 0.5 * side]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.id: r for r in E.near_duplicates(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect()}
    recall, n, counts = recall_of(x, got)
    print(f"recall {recall:.4f} of {n} links")
    assert n >= 8000 and recall >= E.RECALL - 0.01 and counts


def test_passes_alone_reach_the_recall_they_are_reckoned_for(spark):
    """Without probes and further rounds: 2,000 pairs of cosine 0.9 among 12,000 vectors."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((10_000, 64)))
    side = unit(rng.standard_normal((2000, 64)))
    side = unit(side - (side * x[:2000]).sum(axis=1, keepdims=True) * x[:2000])
    x = np.concatenate([x, 0.9005 * x[:2000] + (1 - 0.9005**2) ** 0.5 * side])
    df = spark.createDataFrame([(i, i * 7919 % 12_000, 64, v.tolist()) for i, v in enumerate(x)], "node long, tie long, w int, vector array<double>")
    passes = E.passes_for(12_000, E.WINDOW, 0.9)
    pairs = {tuple(sorted(r)) for r in E.pass_forest(df, passes, E.WINDOW, 0.9, 0, Scratch(spark, "t")).collect()}
    assert len(pairs & {(i, 10_000 + i) for i in range(2000)}) / 2000 > 0.97


def test_all_pairs_are_the_last_resort(spark, monkeypatch):
    """Where windows would hold as many pairs as there are, every pair is compared."""
    monkeypatch.setattr(E, "probe", lambda classes, label, sizes, threshold, scratch: (0.0, classes.sparkSession.createDataFrame([], "a long, b long")))
    monkeypatch.setattr(E, "COUNT_BLOCK", 16)
    rows = vectors(5)
    got = E.near_duplicates(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect()
    assert {r.id: (r.n_links, r.component) for r in got} == brute(rows) | {1005: (0, 1005)}


def test_rounds_are_the_same_at_every_size(spark, monkeypatch):
    """Nothing but passes with wider windows follows a low recall, also where all pairs would be few; the last one holds all."""
    none = spark.createDataFrame([], "a long, b long")
    windows, forests, real = [], [], E.pass_forest

    def noted(classes, passes, window, *rest):
        windows.append((window, passes))
        forests.append({tuple(r) for r in real(classes, passes, window, *rest).collect()})
        return spark.createDataFrame(list(forests[-1]), "a long, b long") if forests[-1] else none

    monkeypatch.setattr(E, "pass_forest", noted)
    monkeypatch.setattr(E, "probe", lambda classes, label, sizes, threshold, scratch: (0.0, none))
    rows = vectors(5)
    got = E.near_duplicates(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect()
    assert [w for w, _ in windows] == [48, 192, 768] and windows[-1][1] == 1
    assert {r.id: (r.n_links, r.component) for r in got} == brute(rows) | {1005: (0, 1005)}


@pytest.mark.parametrize("window", [5, 40, 900])
def test_windows_reach_over_blocks_and_partitions(spark, monkeypatch, window):
    """A pass joins what lies within its windows, however its order is cut."""
    monkeypatch.setattr(E, "COUNT_BLOCK", 16)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((30, 8)), 20, axis=0) + 0.25 * rng.standard_normal((600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i * 7 % 600, 8, v.tolist()) for i, v in enumerate(x)], "node long, tie long, w int, vector array<double>")
    key = E.sign_keys(x, E.planes(8, 1, E.BITS, 17))[:, 0]
    order = np.lexsort((np.arange(600) * 7 % 600, key))
    place = np.empty(600, int)
    place[order] = np.arange(600)
    i, j = np.nonzero((x @ x.T >= 0.9) & (abs(place[:, None] - place[None]) <= window))
    want = np.arange(600)
    E.unite(want, i, j)
    got = np.arange(600)
    for parts in (1, 23):
        monkeypatch.setattr(E, "BLOCKS", 3 * parts)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = [tuple(r) for r in E.pass_forest(df, 1, window, 0.9, 0, Scratch(spark, "t")).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        got[:] = np.arange(600)
        E.unite(got, *np.array(found).T)
        assert (got == want).all()


def test_vectors_of_every_length_and_type_take_part(spark):
    near = [1.0, 0.01]
    rows = [(1, [1.0, 0.0], 0), (2, near, 0), (3, [0.0, 0.0, 1.0], 0), (4, [0.0, 0.1, 1.0], 0), (5, [1.0, 0.0, 0.0], 0), (6, [-3.0], 0), (7, [-0.5], 0), (8, [-0.0, 5.0], 0), (9, [0.0, 5.0], 0)]
    for kind in ("float", "double", "int"):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        got = {r.id: (r.n_links, r.component) for r in E.near_duplicates(df, Scratch(spark, "t")).collect()}
        if kind != "int":
            assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 8)}
        else:
            assert got[1] == (1, 1) and got[3] == (1, 3) and got[6] == (0, 6) and got[7] == (0, 7)
        found = {(r.query_id, r["rank"]): r.id for r in ann.search(df, F.col("id") <= 4, Scratch(spark, "t")).collect()}
        assert found[1, 1] == 2 and found[3, 1] == 4 and found[4, 2] == 5 and (4, 3) not in found


def test_doubles_are_compared_as_doubles(spark):
    """Cosines just over and just under the threshold, that single precision can't tell apart."""
    def at(cos):
        return [cos, (1 - cos * cos) ** 0.5]

    rows = [(1, [1.0, 0.0], 0), (2, at(0.9 + 1e-12), 0), (3, [0.0, 0.0, 2.0], 0), (4, [(1 - (0.9 - 1e-12) ** 2) ** 0.5, 0.0, 0.9 - 1e-12], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: r.n_links for r in E.near_duplicates(df, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_repeated_rows_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0)] * 3 + [(2, [0.0, 1.0], 0)]
    got = E.near_duplicates(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect()
    assert sorted((r.id, r.n_links, r.component) for r in got) == [(1, 2, 1)] * 3 + [(2, 0, 2)]
    assert E.near_duplicates(spark.createDataFrame([], KIND), Scratch(spark, "t")).collect() == []
    assert E.near_duplicates(spark.createDataFrame([(5, None, 1)], KIND), Scratch(spark, "t")).first()[:] == (5, 0, 5)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (1, 3), (3, 2), (2, 1), (1, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | {1: 1, 2: 1, 3: 1}
    assert got == want


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    x[10] = x[20] = x[40]
    rows = [(i, [float(v) for v in w], 0) for i, w in enumerate(x)] + [(6000, None, 0), (6020, [0.0] * 24, 0)]
    got = ann.search(spark.createDataFrame(rows, KIND), F.col("id") % 20 == 0, Scratch(spark, "t"), block=900).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert set(by) == set(range(0, 3000, 20))
    hit = 0
    y = x.astype(np.float64)
    for q, found in by.items():
        found.sort()
        s = y @ y[q]
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(s[i] - v) < 1e-9 for _, i, v in found)
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
        s[q] = -np.inf
        hit += len({int(i) for i in np.lexsort((np.arange(3000), -s))[:20]} & {f[1] for f in found})
    assert hit / (20 * len(by)) > 0.95


@pytest.mark.parametrize("long", [{7: 3.0}, {7: 10.0}, dict.fromkeys(range(10), 5.0), None])
def test_long_vectors_do_not_hide_neighbours(long):
    """Recall of a block in which a few vectors, or (None) lengths of all scales, are longer."""
    rng = np.random.default_rng(5)
    n = 4096
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    length = np.ones(n)
    if long:
        length[list(long)] = list(long.values())
    else:
        length = rng.lognormal(0, 1, n)
    x = (x * length[:, None]).astype(np.float32).astype(np.float64)
    block, hit, asked = ann.Block(np.arange(n), x), 0, range(100, n, 80)
    for q in asked:
        ids, score = block.search(x[q], 20, q)
        s = x @ x[q]
        assert np.allclose(score, s[ids]) and q not in ids
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(ids.tolist()))
    assert hit / (20 * len(asked)) > 0.95


def test_query_recall_against_exact_sql(spark):
    """The registered query at sf0.01 against DuckDB's exact answer."""
    import duckdb

    from millrace.llm.queries import op7_neighbours

    found = {(r.query_id, r.vec_id): r.score for r in op7_neighbours(spark, "/root/testdata/sf0.01").collect()}
    sql = """
SELECT q.vec_id AS q, c.vec_id AS c, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
FROM '/root/testdata/sf0.01/embeddings.parquet' q JOIN '/root/testdata/sf0.01/embeddings.parquet' c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) <= 20"""
    exact = {(q, c): s for q, c, s in duckdb.sql(sql).fetchall()}
    both = found.keys() & exact.keys()
    recall = len(both) / len(exact)
    print(f"recall {recall:.4f}")
    assert len(found) == len(exact) and recall >= 0.95
    assert all(abs(found[k] - exact[k]) < 1e-12 for k in both)


def test_repeated_rows_equal_scores_and_other_columns(spark):
    rows = [(i, [1.0, 0.0], "x", 1.0) for i in (20, 21, 21, 22, None)] + [(23, [-0.0, 1.0], None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, w string, score double")
    got = [tuple(r) for r in ann.search(df, F.col("id") % 20 == 0, Scratch(spark, "t"), k=4, block=2).orderBy("rank").collect()]
    assert got == [(20, 1, 21, 1.0), (20, 2, 21, 1.0), (20, 3, 22, 1.0), (20, 4, 23, 0.0)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_few_candidates(spark, n):
    rows = [(20 * i, [1.0, float(i)], 0) for i in range(n)]
    got = ann.search(spark.createDataFrame(rows, KIND), F.col("id") % 20 == 0, Scratch(spark, "t")).collect()
    assert len(got) == n * (n - 1)
    assert ann.search(spark.createDataFrame([], KIND), F.col("id") % 20 == 0, Scratch(spark, "t")).collect() == []
