"""A corpus pipeline of four of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
frame, which is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``.

``ORACLE_SQL`` is None: the language model, the sketches and the random rounding are
not SQL; the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, packing, text_dedup
from millrace.llm.common import Scratch, read_table, unused_prefix

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set ``lang`` to the predicted language; documents that are ``und``, or ambiguous without any language near a half, go.

    Null, empty and letterless texts are ``und``; repeated rows are judged alike; other columns are kept.
    """
    learn = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = langid.fit(learn, "doc_id", "text", "lang")
    prefix = unused_prefix(docs)
    found = langid.add_language(docs, model, prefix=prefix)
    lang, score, ambiguous = (F.col(prefix + n) for n in ("lang_pred", "score", "ambiguous"))
    kept = found.filter(~((lang == "und") | (ambiguous & (score < 0.5))))
    return kept.select(*[lang.alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Null and empty texts are no copies of each other and stay; of rows alike in id and text the least by all columns stays.
    """
    return text_dedup.deduplicate(docs, Scratch(spark, "dedup"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times.

    Null and empty texts have no words and are taken 0 times; a null source is a source; ties go by a hash of the row.
    """
    return mixing.mixed_rows(docs, Scratch(spark, "mix"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 2,048 words; copies never share a bin.

    Texts without words have one piece without a bin; ties in size go by id, then piece.
    """
    rows = docs.select(
        F.col("doc_id").cast("string").alias("key"), F.col("source").cast("string").alias("source"), packing.cluster_of(F.col("text")).alias("cluster"), mixing.word_count(F.col("text")).alias("size")
    )
    out = packing.pack(Scratch(spark, "pack").cut(rows))
    return out.select("bin_id", "bin_start", F.col("key").cast("long").alias("doc_id"), "occurrence", "piece", "n_pieces", "word_start", "n_words")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
