import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import text_dedup as T
from millrace.llm.common import Scratch
from millrace.llm.flat import shingle_hashes, slices, word_hashes


def grams(text):
    """Labelled runs of five words."""
    w = text.lower().split()
    if not w:
        return []
    seen, out = Counter(), []
    for i in range(max(1, len(w) - 4)):
        g = tuple(w[i : i + 5])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ordered(a, b):
    a, b = grams(a), grams(b)
    if not a or not b:
        return 0.0
    c = lcs(a, b)
    return c / (len(a) + len(b) - c)


def brute_classes(rows, threshold=0.8):
    ids = [i for i, _ in rows]
    up = {k: k for k in range(len(rows))}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            s, t = rows[x][1] or "", rows[y][1] or ""
            if s.split() and (s.lower() == t.lower() or ordered(s, t) >= threshold):
                up[find(x)] = find(y)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(ids[k])
    return {ids[k]: min(groups[find(k)]) for k in range(len(rows))}


def edit(text, n, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"new{rng.randrange(10**6)}"], [w[k], f"more{rng.randrange(10**6)}"]])
    return " ".join(w)


def corpus(words):
    base = [words(120, s) for s in range(6)]
    passage = words(60, 99)
    rows = []
    for b, t in enumerate(base):
        rows += [t, t.upper(), edit(t, 1, b), edit(t, 2, b + 50), edit(t, 9, b + 100)]
    rows += [words(40, 300 + k) + " " + passage + " " + words(40, 400 + k) for k in range(12)]  # share a passage only
    chain = words(100, 77)
    for k in range(6):
        chain = edit(chain, 1, 500 + k)
        rows.append(chain)
    t = base[0].split()
    rows += [" ".join(t[60:] + t[:60])]  # the same runs in another order
    rows += ["", None, "  \n", "one two", "one two", "one two three", "same " * 300, "same " * 310, words(4, 1)]
    return list(enumerate(rows))


@pytest.mark.parametrize("minima", [3, 2])
def test_classes_equal_brute_force(spark, words, minima):
    rows = corpus(words)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = {r.id: r.class_id for r in T.classes(df, Scratch(spark, "t"), minima=minima).collect()}
    want = brute_classes(rows)
    assert got == want


def test_families_are_compared_in_blocks(spark, words, monkeypatch):
    """Loose copies of one text: most pairs are just below or above the threshold."""
    monkeypatch.setattr(T, "FAMILY_BLOCK", 2000)
    base = words(110, 5)
    rows = [(i, edit(base, 1 + i % 3, i)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in T.classes(df, Scratch(spark, "t")).collect()}
    assert got == brute_classes(rows)


def test_deduplicate_keeps_one_row_a_class(spark, words):
    t = words(50, 3)
    rows = [(5, t, "x"), (5, t, "x"), (9, t.upper(), "y"), (2, words(50, 8), "z"), (7, None, "n"), (7, None, "n"), (None, t, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rows string")
    out = T.deduplicate(df, Scratch(spark, "t"))
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.rows) for r in out.collect()) == [(2, "z"), (5, "x"), (7, "n"), (7, "n")]
    assert T.deduplicate(df.limit(0), Scratch(spark, "t")).collect() == []


def test_alignment_equals_full_lcs(words):
    rng = random.Random(9)
    for k in range(40):
        a = words(rng.randrange(1, 70), k, vocabulary=3)
        b = edit(a, rng.randrange(0, 12), k) if k % 3 else words(30, k + 1, vocabulary=3)
        s = T.similarity(T.labels_of(a), T.labels_of(b), 0.8)
        want = ordered(a, b)
        assert s == pytest.approx(want) if want >= 0.8 else s < 0.8


def test_sketch_is_minima_in_text_order():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 40).astype(np.uint64)
    at = np.array([0, 25, 25, 27, 40])
    s = T.sketch(h, at, 5, 3)
    assert (s[1] == 0).all()
    for i in range(4):
        own = h[at[i] : at[i + 1]]
        if len(own):
            assert (T.sketch(own, np.array([0, len(own)]), 5, 3)[0] == s[i]).all()
    moved = T.sketch(h[:25][::-1].copy(), np.array([0, 25]), 5, 3)[0]
    assert (moved != s[0]).all()  # the same k-mers in another order


def test_words_and_runs_equal_plain_python():
    texts = ["a b  c\td\ne f", "", " x ", "é ü", "a " * 2000, "b"]
    seen = {}
    for _, _, data, offsets in slices(pa.array(texts)):
        w, at = word_hashes(data, offsets)
        for i, t in enumerate(texts):
            mine = w[at[i] : at[i + 1]]
            assert len(mine) == len(t.split())
            for x, y in zip(mine.tolist(), t.split(), strict=True):
                assert seen.setdefault(y, x) == x
        h, to = shingle_hashes(w, at, 5)
        assert np.diff(to).tolist() == [0 if not t.split() else max(1, len(t.split()) - 4) for t in texts]
        assert len(set(T.label_occurrences(h, to)[to[4] : to[5]].tolist())) == 1996
    assert len(set(seen.values())) == len(seen)


def test_recall_of_the_sketches(words):
    """Texts at the threshold agree in a sketch nearly always."""
    hit = n = 0
    for k in range(60):
        a = words(150, k)
        b = edit(a, 2 + k % 2, k + 1000)
        if ordered(a, b) < 0.8:
            continue
        x, y = (T.sketch(v, np.array([0, len(v)]), T.SKETCHES, T.MINIMA)[0] for v in (T.labels_of(a), T.labels_of(b)))
        n += 1
        hit += bool((x == y).any())
    assert n > 30 and hit / n > 0.97


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    import numpy as np

    from millrace.llm import flat

    rng = random.Random(1)
    texts = [" ".join("w" * rng.choice([1, 3, 8, 400]) + str(rng.randrange(50)) for _ in range(300)), "x" * 5000, "  " * 800 + "a b", "ab " * 900 + "y" * 700 + " z"]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        whole = flat._word_hashes(data, np.array([0, len(data)]))[0]
        assert len(whole) == len(t.split())
        for size in (64, 100, 257):
            monkeypatch.setattr(flat, "SLICE_BYTES", size)
            h, at = flat.word_hashes(data, np.array([0, len(data)]))
            assert np.array_equal(h, whole) and at.tolist() == [0, len(whole)]


def test_a_very_long_text(spark):
    """7 MB in one text, and its copy with a changed word."""
    words = " ".join(f"w{i % 100_003}" for i in range(1_000_000))
    df = spark.createDataFrame([(1, words), (2, words.replace("w77 ", "changed ", 1)), (3, "short and other text here")], "doc_id long, text string")
    got = {r.id: r.class_id for r in T.classes(df, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
