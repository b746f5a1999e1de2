"""The registered queries of the operators in this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.catalog.registry import table
from themeloom.llm import bitsliced, byte_bpe, hard_negatives, hmm, langid, licenses, mixing, oracles, phrases, repetition, secrets, simhash, suffix_dedup, warc_zip
from themeloom.runtime import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: run(ship(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query("op1_language_id")
def language_id(spark, sf):
    docs = table(spark, sf, "documents")
    prototypes = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), prototypes)
    return found.withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score", "margin")


@query("op2_secret_scan", oracles.SECRET_SCAN)
def secret_scan(spark, sf):
    return secrets.scan(table(spark, sf, "documents"))


@query("op3_simhash_dedup")
def simhash_dedup(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op4_mixing", oracles.MIXING)
def mix_sources(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op5_warc_packages", oracles.WARC_PACKAGES)
def warc_packages(spark, sf):
    return warc_zip.archive(table(spark, sf, "pages")).drop("uri")


@query("op6_suffix_dedup", oracles.SUFFIX_DEDUP)
def suffix_dedup_(spark, sf):
    found = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_license_scan")
def license_scan(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query("op8_bitsliced_topk", oracles.BITSLICED_TOPK)
def bitsliced_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return bitsliced.search(bitsliced.build_index(vectors), vectors.where("vec_id % 20 = 0"))


@query("op9_repetition", oracles.REPETITION)
def repetition_rules(spark, sf):
    return repetition.repetition(table(spark, sf, "documents")).withColumn("broken", F.array_join("broken", ","))


VOCABULARY = "byte_bpe_50k.tiktoken"


@query("op10_byte_bpe")
def bpe(spark, sf):
    path = public_tokenizers.path(VOCABULARY)
    encoded = byte_bpe.encode(table(spark, sf, "documents"), path)
    return byte_bpe.decode(encoded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op11_hard_negatives", oracles.HARD_NEGATIVES)
def mine_hard_negatives(spark, sf):
    vectors = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op12_collocations", oracles.COLLOCATIONS)
def mine_collocations(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query("op13_hidden_markov")
def hidden_markov(spark, sf):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return hmm.score(table(spark, sf, "documents"), held_out)
