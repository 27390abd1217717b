"""One query for each operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    collocations, language, licenses, mixing, neighbour_votes, neighbours, ngram_join, packing, quality, secrets, suffixes,
    token_files, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_token_files")
def op1_token_files(spark, sf_dir):
    manifest = token_files.write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op2_language")
def op2_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    model = language.train(docs.where(F.coalesce(~held_out, F.lit(True))), vocabulary)
    return language.with_language(docs.select("doc_id", "text"), model, vocabulary).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query("op3_quality_bands")
def op3_quality_bands(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


@query("op4_neighbours")
def op4_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.search(vectors, F.col("vec_id") % 20 == 0)


@query("op5_licenses")
def op5_licenses(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir), licenses.notices(spark))


@query("op6_suffixes")
def op6_suffixes(spark, sf_dir):
    return suffixes.remove_repeats(documents(spark, sf_dir)).drop("starts", "ends")


@query("op7_secrets")
def op7_secrets(spark, sf_dir):
    found = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("secret_spans")).alias("spans"),
    )


@query("op8_packing")
def op8_packing(spark, sf_dir):
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, domain`` of the labelled documents."""
    domain = "case when toxic = 1 then 'toxic' when quality = 1 then 'good' else 'poor' end"
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.expr(domain).alias("domain"))


#: Shares of the mix's tokens.
TARGETS = {"good": 0.9, "poor": 0.1, "toxic": 0.0}


@query("op9_mixing")
def op9_mixing(spark, sf_dir):
    found = mixing.rates(documents(spark, sf_dir), labelled_domains(spark, sf_dir), TARGETS)
    shares = [F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return found.select("doc_id", "domain", "n_tokens", *shares, "rate")


@query("op10_ngram_join")
def op10_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(documents(spark, sf_dir)).drop("node")


@query("op11_neighbour_votes")
def op11_neighbour_votes(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = neighbour_votes.fit(docs.where(~held_out), labels.where(~held_out))
    return neighbour_votes.with_votes(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )



@query("op12_collocations")
def op12_collocations(spark, sf_dir):
    return collocations.mine(documents(spark, sf_dir))


ORACLES["op12_collocations"] = collocations.SQL


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
