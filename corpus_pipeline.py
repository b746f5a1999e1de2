"""A training corpus from raw documents: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. The driver or `run` writes each result as Parquet and reads it back for the next.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import byte_bpe, langid, mixing, near_copies, secrets
from themeloom.runtime import cut, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_50k.tiktoken"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepared(stage: Stage) -> Stage:
    """The stage in a session made ready by `ship`, whoever calls it: a batch of Spark's default size holds 10,000 texts, in the JVM and in Python."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return run_stage


@prepared
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language: no letters, or a cosine far below what a text of as many n-grams has in its language. `lang` becomes the prediction.

    Short texts have low cosines whatever their language, so little is asked of them and nothing of a few words (`langid.least_cosine`). Prototypes come from the documents that have a language and are not held out.
    """
    prototypes = cut(langid.train(docs.where(~langid.held_out())))
    found = langid.predict(docs, prototypes, COLUMNS, floor=True)
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") > 0) & (F.col("score") >= F.col("least")))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@prepared
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by a Jaccard similarity of 0.8 of five-word shingles the one with the smallest id stays.

    SimHash fingerprints within three bits link first, each link checked on the whole sets; bands of least hashes find what they miss.
    """
    return near_copies.one_of_each(docs.select(*COLUMNS))


@prepared
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret of the whole scan by a marker and count characters anew; no document goes."""
    clean = secrets.redact(docs, whole=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@prepared
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin out documents until each source meets its target; the mix has each document as often as it is taken."""
    sized = docs.select(*COLUMNS, mixing.word_count("text").alias("size"))
    mixed = mixing.repeated(mixing.assign(sized))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@prepared
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether they decode to its text."""
    path = public_tokenizers.path(VOCABULARY)
    tokens = byte_bpe.encode(docs, path)
    return tokens.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

# Fingerprints, seeded hashes and merges have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
