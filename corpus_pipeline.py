"""From raw documents to token digests of a mixed, deduplicated corpus.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the
columns of documents; the last returns the tokens of every document it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, jaccard, language, mixing, quality
from tallyspark.llm.common import discard, materialise, table

#: A language is taken as known from this cosine with its prototype on. Of random vectors of this size
#: the best of a few prototypes is under it in about 98 cases of 100; learned rows of at least
#: ``SURE_LETTERS`` letters were all above it (least 0.125), while shorter ones came down to the
#: noise, so nothing is said of those.
MIN_LANGUAGE_SCORE = 0.11
SURE_LETTERS = 32

#: BPE pieces a worker keeps: fewer than by default, for it also holds what the stages before have left in it.
PIECES = 100_000

#: SQL has no language model, forest or hash draw; tests compare with a brute-force version.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: null text, no letters, or many letters unlike all prototypes."""
    names, prototypes = language.learn(docs)
    found = language.classify(docs.withColumn("__row", F.struct(*docs.columns)).select("__row", "text"), names, prototypes)
    strange = (F.col("score") < MIN_LANGUAGE_SCORE) & (F.regexp_count("text", F.lit(r"\p{L}")) >= SURE_LETTERS)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & ~strange).select("__row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose calibrated quality is below the threshold."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs.withColumn("__row", F.struct(*docs.columns)).select("__row", "text"), model)
    return scored.filter(F.col("score") >= quality.THRESHOLD).select("__row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return jaccard.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit every document as often as its source's target asks."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    return bpe.digests(docs.select("doc_id", "source", "lang", "text"), cache=PIECES).drop("text")


STAGES = [
    ("language identification", language_stage),
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("BPE encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; what a stage keeps is a table that the next one reads, and deleted when that has been written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        if read is not None:
            discard(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
