"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import (
    collocations, decontamination, divergence, fingerprints, jaccard_join, language_model, mixing, neighbours, oracles, packing, pii, sharding, token_files,
    toxicity,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_classes(fingerprints.fingerprint_documents(_documents(spark, sf_dir)))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sizes_of(_documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.nearest(vectors, vectors.filter("id % 50 = 0"), k=5)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_documents(spark, sf_dir))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_held_out(_documents(spark, sf_dir), order=2)


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_documents(spark, sf_dir), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_stripe_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("spans")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_edit_fingerprints": op1_edit_fingerprints,
    "op2_mix_sources": op2_mix_sources,
    "op3_find_personal_data": op3_find_personal_data,
    "op4_pack_sequences": op4_pack_sequences,
    "op5_vantage_point_search": op5_vantage_point_search,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_files": op7_token_files,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_kd_shards": op9_kd_shards,
    "op10_toxicity_chain": op10_toxicity_chain,
    "op11_stripe_collocations": op11_stripe_collocations,
    "op12_decontaminate": op12_decontaminate,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op11_stripe_collocations": oracles.COLLOCATIONS,
    "op12_decontaminate": oracles.DECONTAMINATION,
    "op13_source_divergence": oracles.DIVERGENCE,
}
