"""Language identification with error-correcting output codes.

Each language has a codeword of bits.  For every bit a binary n-gram classifier
(log odds of hashed byte 2-, 3- and 4-grams, class-balanced) tells whether a text's
language has that bit set.  Decoding is *loss-weighted*: a language's loss is the
logistic loss of the margins against its codeword, every bit weighed by how well it
separates the training texts; the language with the least loss is predicted, and
texts whose two best losses lie close are flagged as ambiguous.

Up to six languages have the exhaustive code (``2^(k-1) - 1`` bits), more have the
best of several seeded random codes.

Training reads about ``PER_LANGUAGE`` whole texts of each language, chosen by a hash of
their id and text, each text once.  They are counted where they lie; the driver gets one row of counts a
language and one of sums a partition.  All sums are of whole numbers, so that a model doesn't depend on the
partitioning.  Prediction reads every whole text; of a long one, n-grams are counted piece by piece.

Defined results: a text that is null or has no letter is ``und`` with score 0;
ties go to the language that comes first; with nothing to learn from, everything
is ``und``; repeated rows are predicted alike; other columns are kept, and columns named
like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused, uniform
from .flat import slices

#: whole texts of a language to learn from, on average
PER_LANGUAGE = 400
#: hashed n-grams
DIMENSIONS = 1 << 13
#: random codes to choose from
CODES = 8
#: bytes of a long text whose n-grams are counted at once
PIECE = 1 << 18
#: margins are summed in whole numbers of this
UNIT = 2.0**-32
#: difference of the two best losses below which a text is ambiguous
AMBIGUOUS = 0.5

_U = np.uint32
# bytes as n-grams see them: ASCII letters in lower case, other ASCII as one blank, the rest as it is
_SEEN = np.full(256, 32, np.uint8)
_SEEN[0x61:0x7B] = np.arange(0x61, 0x7B)
_SEEN[0x41:0x5B] = np.arange(0x61, 0x7B)
_SEEN[0x80:] = np.arange(0x80, 0x100)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of texts laid end to end, and each text's offsets into them.

    Three blanks stand before every text, so that no n-gram reaches into another one; inside, runs of blanks count as one.
    """
    seen, at = normal(data, offsets)
    return _hashed(seen).reshape(-1), at * 3


def _hashed(seen: np.ndarray) -> np.ndarray:
    """The n-grams that begin at each byte; those that reach over the end are as if zeros followed."""
    b = seen.astype(_U)
    m = len(b)
    two, three, four = (np.zeros(m, _U) for _ in range(3))
    with np.errstate(over="ignore"):
        two[: m - 1] = b[:-1] * _U(257) + b[1:]
        three[: m - 2] = (two[: m - 2] * _U(257) + b[2:]) if m > 2 else 0
        four[: m - 3] = (three[: m - 3] * _U(257) + b[3:]) if m > 3 else 0
        out = np.empty((m, 3), _U)
        for j, (g, salt) in enumerate(((two, 0x9E3779B1), (three, 0x85EBCA77), (four, 0xC2B2AE3D))):
            h = (g + _U(j)) * _U(salt)
            h ^= h >> _U(15)
            h *= _U(0x2C1B3C6D)
            out[:, j] = h >> _U(32 - DIMENSIONS.bit_length() + 1)
    return out


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as the n-grams see them, and each text's place in them."""
    n = len(offsets) - 1
    seen = np.full(len(data) + 3 * (n + 1), 32, np.uint8)
    heads = offsets + 3 * np.arange(n + 1)  # of each text, and of the end
    mask = np.ones(len(seen), bool)
    mask[(heads[:, None] + np.arange(3)).reshape(-1)] = False
    seen[mask] = _SEEN[data]
    # letters of the Latin-1 block in lower case
    wide = np.flatnonzero((seen[1:] >= 0x80) & (seen[1:] <= 0x9E) & (seen[:-1] == 0xC3)) + 1
    seen[wide] += 0x20
    blank = seen == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep |= ~mask
    at = np.concatenate([[0], np.cumsum(keep)])[heads]
    return seen[keep], at


def text_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, counts of its hashed n-grams, how many) of every text that has one."""
    for a, b, data, offsets in slices(column):
        if len(data) <= 2 * PIECE:
            g, at = grams(data, offsets)
            for i in range(a, b):
                own = g[at[i - a] : at[i - a + 1]]
                if len(own):
                    yield i, np.bincount(own, minlength=DIMENSIONS), len(own)
            continue
        seen, at = normal(data, offsets)  # one long text: no more than some bytes a byte are held
        seen, total = seen[at[0] :], np.zeros(DIMENSIONS, np.int64)
        last = int(at[1] - at[0])
        for lo in range(0, last, PIECE):
            hi = min(last, lo + PIECE)
            total += np.bincount(_hashed(seen[lo : hi + 3])[: hi - lo].reshape(-1), minlength=DIMENSIONS)
        yield a, total, 3 * last


def code_matrix(k: int, seed: int = 11) -> np.ndarray:
    """k codewords of -1 and 1, a row each."""
    if k <= 2:
        return np.array([[1], [-1]][:k])
    if k <= 6:
        bits = 2 ** (k - 1) - 1
        return np.array([[1 if not (j >> i) & 1 else -1 for j in range(1, bits + 1)] for i in range(k - 1)] + [[1] * bits])
    bits, rng = 12 * int(np.ceil(np.log2(k))), np.random.default_rng(seed)
    best, far, tried = None, -1, 0
    while best is None or tried < CODES:
        m = rng.choice([-1, 1], size=(k, bits))
        tried += 1
        if (np.abs(m.sum(0)) < k).all() and (near := least_distance(m)) > max(far, 0):
            best, far = m, near
    return best


def least_distance(m: np.ndarray) -> int:
    """In how many bits the two nearest codewords differ."""
    x, most = m.astype(np.float32), -m.shape[1]
    for at in range(0, len(x), 512):
        dot = x[at : at + 512] @ x.T
        dot[np.arange(len(dot)), np.arange(at, at + len(dot))] = -m.shape[1]
        most = max(most, int(dot.max()))
    return (m.shape[1] - most) // 2


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # DIMENSIONS x bits
    scale: np.ndarray  # margin units of a bit
    trust: np.ndarray  # weight of a bit in the loss


def classifiers(each: np.ndarray, code: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """DIMENSIONS x bits log odds, from the counts of each language."""
    each = each + smoothing
    each /= each.sum(1, keepdims=True)
    weights = np.empty((DIMENSIONS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        on = each[code[:, b] > 0].mean(0)
        off = each[code[:, b] < 0].mean(0) if (code[:, b] < 0).any() else np.full(DIMENSIONS, 1 / DIMENSIONS)
        weights[:, b] = np.log(on) - np.log(off)
    return weights


def model_of(languages: tuple[str, ...], code: np.ndarray, weights: np.ndarray, size: np.ndarray, hits: np.ndarray, n: int) -> Model:
    """``size``: sum of the margins' amounts a bit; ``hits``: how many of the ``n`` texts a bit tells right."""
    hit = np.clip(hits / n, 0.5 + 1e-3, 1 - 1e-3)
    trust = np.log(hit / (1 - hit))
    return Model(languages, code, weights, np.maximum(size / n, 1e-6), trust / trust.mean())


def margins_of(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Margins of each text, a row each; zeros for texts without n-grams."""
    out = np.zeros((len(column), weights.shape[1]))
    for i, c, n in text_counts(column):
        out[i] = (c.astype(np.float32) @ weights) / n
    return out


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index, score and distance to the runner-up of each row of margins."""
    z = 3.0 * margins / model.scale
    loss = np.stack([(model.trust * np.logaddexp(0, -z * w)).sum(1) for w in model.code], axis=1)
    best = loss.argmin(1)
    low = loss.min(1, keepdims=True)
    score = 1 / np.exp(low - loss).sum(1)
    gap = np.partition(loss, 1, axis=1)[:, 1] - low[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, score, gap


def identify(text: Column, model: Model | None) -> Column:
    """struct(lang, score, ambiguous) of a text."""
    kind = "lang string, score double, ambiguous boolean"
    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    if model is None:
        return none

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array(model.languages, dtype=object)
        for column in batches:
            best, score, gap = decode(model, margins_of(column, model.weights))
            yield pa.StructArray.from_arrays(
                [pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(gap < AMBIGUOUS)], names=["lang", "score", "ambiguous"]
            )

    letters = text.isNotNull() & text.rlike(r"\p{L}")
    return F.when(letters, run(F.when(letters, text).otherwise(""))).otherwise(none)


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from a bounded sample of the rows of ``df`` that have a language."""
    rows = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l")).filter("l is not null and t <> ''")
    found = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not found:
        return None
    languages = tuple(sorted(found))
    code = code_matrix(len(languages))
    share = F.create_map(*[x for lang, n in found.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    scratch = Scratch(df.sparkSession, "langid")
    sample = scratch.cut(rows.filter(uniform(F.col("i").cast("string"), F.col("t"), F.lit(5)) < F.element_at(share, F.col("l"))).select("l", "t").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["l", "c"])
            sums.clear()
            return batch

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, c, _ in text_counts(batch.column(1)):
                sums[langs[i]] = sums.get(langs[i], 0) + c.astype(np.int64)
                if len(sums) >= 64:
                    yield out()
        if sums:
            yield out()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("c").to_pylist())
        return pa.table({"l": [key[0].as_py()], "c": [total.tobytes()]})

    counted = sample.mapInArrow(count, "l string, c binary").groupBy("l").applyInArrow(add, "l string, c binary").collect()  # one row a language
    each = np.zeros((len(languages), DIMENSIONS))
    for r in counted:
        each[languages.index(r["l"])] = np.frombuffer(r["c"], np.int64)
    weights = classifiers(each, code)
    number = {lang: k for k, lang in enumerate(languages)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, hits, n = np.zeros(code.shape[1], np.int64), np.zeros(code.shape[1], np.int64), 0
        for batch in batches:
            m = margins_of(batch.column(1), weights)
            right = m * code[[number[lang] for lang in batch.column(0).to_pylist()]]
            size += np.rint(np.abs(m) / UNIT).astype(np.int64).sum(0)
            hits += (right > 0).sum(0)
            n += len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([size.tobytes()], pa.binary()), pa.array([hits.tobytes()], pa.binary())], names=["n", "s", "h"])

    judged = sample.mapInArrow(judge, "n long, s binary, h binary").collect()  # one row a partition
    scratch.drop(sample)
    if not judged:
        return None
    size, hits = (sum(np.frombuffer(r[c], np.int64) for r in judged) for c in ("s", "h"))
    return model_of(languages, code, weights, size * UNIT, hits, sum(r["n"] for r in judged))


def add_language(df: DataFrame, model: Model | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add lang_pred, score and ambiguous to every row."""
    names = [prefix + n for n in ("lang_pred", "score", "ambiguous")]
    own = [F.col(f"`{c}`") for c in df.columns if c not in names]
    held = unused(df, "found")
    step = df.select(*own, identify(F.col(f"`{text_col}`"), model).alias(held))
    return step.select(*own, *[F.col(held)[f].alias(n) for f, n in zip(("lang", "score", "ambiguous"), names, strict=True)])


def held_out(doc_id: Column) -> Column:
    """The third of the documents that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
