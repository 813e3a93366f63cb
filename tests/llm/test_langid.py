import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid as L
from millrace.llm.flat import slices

TEXTS = {
    "en": "the river runs through the town and the people of the hills come down to the market with their carts every week in the summer",
    "de": "der fluss fließt durch die stadt und die leute aus den bergen kommen jede woche im sommer mit ihren wagen auf den markt herunter",
    "fr": "la rivière traverse la ville et les gens des collines descendent au marché avec leurs charrettes chaque semaine pendant l'été",
}


def corpus(n=60):
    out = []
    for lang, text in TEXTS.items():
        w = text.split()
        out += [(" ".join(w[(i * 7 + j) % len(w)] for j in range(5 + i % 13)), lang) for i in range(n)]
    return out


def test_grams_equal_one_text_at_a_time():
    texts = ["Hello, World", "", "É à!", "  a ", "x" * 3]
    (_, _, data, offsets), = slices(pa.array(texts))
    g, at = L.grams(data, offsets)
    for i, t in enumerate(texts):
        (_, _, d, o), = slices(pa.array([t]))
        own, to = L.grams(d, o)
        assert g[at[i] : at[i + 1]].tolist() == own[to[0] : to[1]].tolist()


def test_case_and_punctuation_do_not_count():
    def one(t):
        (_, _, d, o), = slices(pa.array([t]))
        return L.grams(d, o)[0].tolist()

    assert one("ÉTÉ à!!! 12") == one("été à   ")
    assert one("a b") != one("ab")


@pytest.mark.parametrize("k", [2, 3, 4, 6, 9, 40, 700])
def test_codewords_are_apart(k):
    m = L.code_matrix(k)
    assert len({tuple(r) for r in m}) == k
    if k > 2:
        assert min((m[i] != m[j]).sum() for i in range(k) for j in range(i)) >= 2 ** (k - 2) if k <= 6 else True


def test_held_out_accuracy(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(corpus(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df.filter(~L.held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    out = L.add_language(df, model).filter(L.held_out(F.col("doc_id"))).collect()
    assert len(out) > 80 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def train(samples):
    """A model learned on the driver, text by text."""
    samples = [(t, lang) for t, lang in samples if t]
    languages = tuple(sorted({lang for _, lang in samples}))
    x = np.stack([brute_counts(t) for t, _ in samples])
    y = np.array([languages.index(lang) for _, lang in samples])
    code = L.code_matrix(len(languages))
    weights = L.classifiers(np.stack([x[y == c].sum(0) for c in range(len(languages))]).astype(float), code)
    m = (x.astype(np.float32) @ weights) / np.maximum(x.sum(1, keepdims=True), 1)
    return L.model_of(languages, code, weights, np.abs(m).sum(0), (m * code[y] > 0).sum(0), len(x))


def brute_counts(text):
    (_, _, data, offsets), = slices(pa.array([text]))
    g, at = L.grams(data, offsets)
    return np.bincount(g[at[0] : at[1]], minlength=L.DIMENSIONS)


def brute_decode(model, text):
    """The language with the least loss, bit by bit."""
    c = brute_counts(text)
    m = (c.astype(np.float32) @ model.weights) / c.sum()
    losses = []
    for word in model.code:
        losses.append(sum(float(model.trust[b]) * np.log1p(np.exp(-3 * float(m[b]) / float(model.scale[b]) * int(word[b]))) for b in range(len(word))))
    best = min(range(len(losses)), key=lambda k: losses[k])
    return model.languages[best], np.exp(-losses[best]) / sum(np.exp(-x) for x in losses)


def test_model_and_predictions_equal_a_plain_version(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(dict.fromkeys(corpus(50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (L.fit(d, "doc_id", "text", "lang") for d in (df.repartition(1), df.repartition(7)))
    want = train([(t, lang) for _, t, lang in rows])
    for m in (one, two):
        assert m.languages == want.languages and (m.code == want.code).all() and np.array_equal(m.weights, want.weights)
        assert np.allclose(m.scale, want.scale, rtol=1e-5) and np.allclose(m.trust, want.trust)
    assert np.array_equal(one.scale, two.scale) and np.array_equal(one.trust, two.trust)
    for r in L.add_language(df, one).collect():
        lang, score = brute_decode(one, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-4)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 100)
    text = (TEXTS["fr"] + "  --  É\n") * 9
    (i, c, n), = L.text_counts(pa.array([text]))
    want = brute_counts(text)
    assert i == 0 and n == want.sum() and np.array_equal(c, want)


def test_sample_takes_each_text_once_and_is_bounded(spark):
    df = spark.range(30_000).select(F.lit(7).alias("doc_id"), F.lit(TEXTS["en"]).alias("text"), F.lit("en").alias("lang"))
    df = df.unionByName(spark.range(3000).select(F.col("id").cast("int").alias("doc_id"), F.concat(F.lit(TEXTS["de"]), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang")))
    assert L.fit(df, "doc_id", "text", "lang", per_language=50).languages == ("de", "en")


def test_clashing_columns(spark):
    rows = [(1, TEXTS["de"], "x", "y", 3.0)]
    df = spark.createDataFrame(rows, "found int, text string, lang_pred string, __l string, Score double")
    out = L.add_language(df, train(corpus()))
    assert out.columns == ["found", "text", "__l", "Score", "lang_pred", "score", "ambiguous"] or out.columns == ["found", "text", "__l", "lang_pred", "score", "ambiguous"]
    assert out.first()["lang_pred"] == "de" and out.first()["found"] == 1


def test_undetermined_and_edges(spark):
    model = train(corpus())
    rows = [(None, 1), ("", 1), ("123 !?", 1), (TEXTS["de"] * 3000, 1), ("a", 1), (TEXTS["fr"], 1), (TEXTS["fr"], 1)]
    df = spark.createDataFrame(rows, "text string, score int").withColumnRenamed("score", "lang")
    got = [(r.lang_pred, r.score) for r in L.add_language(df, model).collect()]
    assert [g[0] for g in got[:4]] == ["und", "und", "und", "de"] and got[0][1] == 0.0 and got[4][0] in TEXTS and got[5] == got[6] and got[5][0] == "fr"
    assert L.add_language(df.limit(0), model).collect() == []
    assert {r.lang_pred for r in L.add_language(df, None).collect()} == {"und"}
    assert L.fit(df.limit(0).withColumn("id", F.lit(1)), "id", "text", "lang") is None


def test_mixed_text_is_ambiguous():
    model = train(corpus())
    texts = [TEXTS["en"] + " " + TEXTS["de"], TEXTS["en"]]
    x = np.stack([brute_counts(t) for t in texts])
    _, score, gap = L.decode(model, (x @ model.weights) / x.sum(1, keepdims=True))
    assert gap[0] < gap[1] and score[0] <= score[1]
