"""One query per operator, over the whole given tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankdraft.llm import (
    byte_bpe,
    decontamination,
    fingerprints,
    language_id,
    licenses,
    merkle,
    near_duplicates,
    oracles,
    pii,
    spelling,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
)
from rankdraft.llm.common import fold, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"))
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), trainable=part != 0)
    return toxicity.score(docs, model, held_out=part == 0)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), model)


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_digests(
        read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN
    )


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.token_files(read(spark, sf_dir, "documents"), tokenizer)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"))
    model = language_id.fit(docs, trainable=part != 0)
    return language_id.predict(docs, model, held_out=part == 0)


@query("op8_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(read(spark, sf_dir, "documents"))


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )


@query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))


@query("op11_merkle_manifest")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(read(spark, sf_dir, "documents"))


@query("op12_license_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


ORACLES |= {
    "op5_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op6_decontamination": oracles.DECONTAMINATION,
    "op11_merkle_manifest": oracles.MERKLE_MANIFEST,
    "op13_spelling_variants": oracles.SPELLING_VARIANTS,
}
