"""Registered queries of the operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import sql
from tidemark.llm.alignment import token_alignment
from tidemark.llm.ann import nearest
from tidemark.llm.common import prepare, read
from tidemark.llm.decontaminate import contamination
from tidemark.llm.fingerprint import fingerprints_with_next
from tidemark.llm.html_text import main_text
from tidemark.llm.langid import language, train
from tidemark.llm.mixing import mix
from tidemark.llm.periodic_runs import periodic_runs
from tidemark.llm.simhash import simhash_components
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.token_ids import read_token_files, write_token_files
from tidemark.llm.toxicity import held_out, score_toxicity
from tidemark.llm.warc import read_warc, write_warc

VOCABULARY = "word_bpe_49k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = write_warc(read(spark, sf_dir, "pages"))
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = write_token_files(read(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
    return read_token_files(spark, folder)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    mixed = mix(read(spark, sf_dir, "documents"), carry=False)
    return mixed.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"), F.round("__p", 6).alias("probability"), F.col("__kept").alias("kept"),
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return main_text(read(spark, sf_dir, "pages"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 3, 1)
    model = train(docs.where(~out))
    found = docs.select("doc_id", out.alias("held_out"), language(model).alias("l"))
    return found.select("doc_id", "held_out", "l.lang_pred", "l.score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    found = contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "item_words")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return periodic_runs(read(spark, sf_dir, "documents"), planted=True).drop("runs")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    vocabularies = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return token_alignment(read(spark, sf_dir, "documents"), *vocabularies)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fingerprints_with_next(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_token_ids, op3_toxicity, op4_mixing, op5_html_text, op6_nearest, op7_language, op8_token_counts,
        op9_decontamination, op10_simhash, op11_periodic_runs, op12_token_alignment, op13_fingerprints,
    )
}
ORACLES: dict[str, str] = {
    "op1_warc": sql.WARC,
    "op4_mixing": sql.mixing(),
    "op6_nearest": sql.NEAREST,
    "op9_decontamination": sql.decontamination(),
}
