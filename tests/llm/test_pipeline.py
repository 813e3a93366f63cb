from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from millrace.llm import mixing, packing

from test_mixing import brute_targets


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    import random

    out = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(5)
    en = "the river and of a town that people with for was not his are from they she which you were".split()
    de = "der fluss und die stadt das leute mit für war nicht sein sind von sie welche du waren ein auf".split()
    rows = []
    for i in range(160):
        words = en if i % 3 else de
        text = " ".join(rng.choice(words) + rng.choice(["", "s", "en", "ing"]) for _ in range(rng.randrange(20, 400)))
        rows.append((i, text, "de" if words is de else "en", f"s{i % 4}", len(text)))
    rows += [(1000 + k, rows[k][1] + (" tail" if k % 2 else ""), "en", "s0", 1) for k in range(20)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "12 34 !", "en", "s1", 7), (2003, rows[3][1], "en", None, 1), (2003, rows[3][1], "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return out


def test_stages_in_turn(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if k < len(P.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
    language, unique, mixed, packed = seen
    assert {r.doc_id for r in language} == set(range(160)) | set(range(1000, 1020)) | {2003}
    assert sorted(r.doc_id for r in unique) == list(range(160))
    sizes = Counter()
    for r in unique:
        sizes[r.source] += len(r.text.split())
    taken = Counter(r.doc_id for r in mixed)
    assert max(taken.values()) <= 2 and {r.doc_id for r in mixed} <= {r.doc_id for r in unique}
    want, got = brute_targets(dict(sizes)), Counter()
    for r in mixed:
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - want[s]) <= max(mixing.LARGE * sizes[s], 1) + 20 for s in sizes)  # small sources have no smaller rows left at the end
    total = sum(len(r.text.split()) for r in mixed)
    assert abs(total - 1.5 * sum(sizes.values())) <= 4 * 400
    assert sum(r.n_words for r in packed) == total
    bins = Counter()
    for r in packed:
        bins[r.bin_id] += r.n_words
    assert max(bins.values()) <= packing.CAPACITY
    assert all(n == 1 for n in Counter((r.bin_id, r.doc_id) for r in packed if r.n_pieces == 1).values())  # copies of a document are apart


def test_run_is_registered_and_agrees(spark, folder):
    assert entry.queries()["pipeline"] is P.run and P.ORACLE_SQL is None
    one, two = (sorted((r.doc_id, r.occurrence, r.piece, r.bin_id) for r in P.run(spark, folder).collect()) for _ in range(2))
    assert one == two and len(one) > 160


def test_every_operator_has_a_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(entry.queries())
